"""URL filter: host and path rules, then a ratio of two character language models.

DataFrame functions only. URLs that a rule decides are the accepted and rejected
examples. Two smoothed variable-order Markov models (Witten-Bell interpolation of
the orders 0 to ``CONTEXT``) give each symbol of a URL a log-likelihood ratio; its
mean over the URL, less a threshold calibrated on held-back examples, decides the
rest. URLs are lower-cased and folded to 34 symbols, so there are at most 34^4
n-grams whatever the number of URLs, and their table is broadcast within that bound.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits
no rule; without examples of both kinds the method allows; ids may be null or
repeat, each row is judged by itself; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import ASCII_UPPER, checkpointed

CONTEXT = 3
SYMBOLS = 34
HELD_BACK = 5
#: (rule, verdict); the host up to the first slash, the path from it on.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda x: -len(x[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def folded(url: Column) -> Column:
    """The url in at most 34 symbols, with marks for its begin and end."""
    text = F.lower(F.coalesce(url, F.lit("")))
    text = F.regexp_replace(text, r"[0-9]+", "0")
    text = F.regexp_replace(text, r"[?=&#:_%+;]", "?")
    text = F.regexp_replace(text, r"[^a-z0/.?-]", "~")
    return F.concat(F.lit("^" * CONTEXT), text, F.lit("$"))


def grams(text: Column) -> Column:
    """Each symbol with its context, in order."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - CONTEXT), lambda k: F.substr(text, k, F.lit(CONTEXT + 1)))


def ratio_table(rows: DataFrame) -> DataFrame:
    """``gram, ratio``: log-likelihood ratio (accepted to rejected) of the last symbol after its context.

    ``rows`` has ``gram, accepted, rejected`` counts, each n-gram once.
    """
    out = rows.select("gram", F.lit(1.0 / SYMBOLS).alias("p_accepted"), F.lit(1.0 / SYMBOLS).alias("p_rejected"))
    for order in range(CONTEXT + 1):
        own = F.right("gram", F.lit(order + 1))
        known = rows.groupBy(own.alias("own")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        known = known.withColumn("context", F.left("own", F.lit(order)))
        context = known.groupBy("context").agg(*(F.sum(k).alias(f"n_{k}") for k in ("accepted", "rejected")), *(F.count_if(F.col(k) > 0).alias(f"kinds_{k}") for k in ("accepted", "rejected")))
        out = out.withColumn("own", own).join(known.join(context, "context"), "own")
        p = {k: F.when(F.col(f"n_{k}") > 0, (F.col(k) + F.col(f"kinds_{k}") * F.col(f"p_{k}")) / (F.col(f"n_{k}") + F.col(f"kinds_{k}"))).otherwise(F.col(f"p_{k}")) for k in ("accepted", "rejected")}
        out = checkpointed(out.select("gram", *(p[k].alias(f"p_{k}") for k in p)))
    return out.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def score_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``page_id, url, host, path, rule, says, score``: ``score`` is the mean ratio over the url's symbols."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = parts(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, says = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says).withColumn("held_back", F.crc32(F.coalesce(F.col("url"), F.lit("")).cast("binary")) % HELD_BACK == 0)
    rows = rows.withColumn("text", folded(F.col("url")))
    learn = F.col("says").isNotNull() & ~F.col("held_back")
    each = rows.select(F.explode(grams(F.col("text"))).alias("gram"), (learn & (F.col("says") == "allow")).alias("a"), (learn & (F.col("says") == "block")).alias("r"))
    counts = checkpointed(each.groupBy("gram").agg(F.count_if("a").alias("accepted"), F.count_if("r").alias("rejected")))
    table = ratio_table(counts)
    keys = ["page_id", "url", "host", "path", "rule", "says", "held_back"]
    scored = rows.select(*keys, (F.length("text") - CONTEXT).alias("n"), F.explode(grams(F.col("text"))).alias("gram")).join(F.broadcast(table), "gram")
    scored = scored.groupBy(*keys, "n").agg(F.avg("ratio").alias("score"), F.count(F.lit(1)).alias("all"))
    return scored.withColumn("again", F.explode(F.sequence(F.lit(1), (F.col("all") / F.col("n")).cast("int")))).drop("again", "all", "n")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: one row for each row of ``pages``.

    The threshold lies between the held-back accepted and rejected examples' mean
    scores, nearer to that kind whose scores vary less.
    """
    scored = checkpointed(score_rows(pages, id_col, url_col, rules))
    seen = {x["says"]: x for x in scored.where("held_back AND says IS NOT NULL").groupBy("says").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("spread"), F.count(F.lit(1)).alias("n")).collect()}
    if {"allow", "block"} <= seen.keys():
        allow, block = seen["allow"], seen["block"]
        wide = allow["spread"] + block["spread"]
        threshold = (allow["mean"] * block["spread"] + block["mean"] * allow["spread"]) / wide if wide else (allow["mean"] + block["mean"]) / 2
    else:
        threshold = float("-inf")
    method = F.when(F.col("score") >= F.lit(threshold), F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), (F.col("score") - F.lit(threshold if threshold > float("-inf") else 0.0)).alias("score"))
