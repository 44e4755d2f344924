"""Threshold detections, findings, and risk scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.functions.scalars import template

SEVERITIES = {"low": 30, "medium": 55, "high": 75, "critical": 90}


@dataclass(frozen=True)
class Rule:
    """A detection: at least ``threshold`` events that ``where`` selects, with equal ``group_by`` fields, inside ``window`` seconds."""

    name: str
    where: str
    group_by: tuple[str, ...] = ()
    threshold: int = 1
    window: int = 300
    severity: str = "medium"
    message: str = ""
    title: str = ""
    category: str = "intrusion_detection"
    tactic: str = ""
    technique: str = ""
    rule_id: str = field(default="")


def _alerts(counted: DataFrame, rule: Rule, at: Column, bucket: Column) -> DataFrame:
    cells = {g: F.coalesce(F.col(g).cast("string"), F.lit("")) for g in rule.group_by}
    gid = F.concat_ws("|", *cells.values()) if cells else F.lit("-")
    severity = F.lit(SEVERITIES.get(rule.severity.lower(), SEVERITIES["medium"])).cast("long")
    said = rule.message or f"{rule.title or rule.name}: {{count}} events in {rule.window} s"
    hits = counted.where(F.col("n") >= max(1, rule.threshold))
    return hits.select(
        F.concat_ws(":", F.lit("alert"), F.lit(rule.name), gid, bucket.cast("string")).alias("event_id"),
        at.alias("ts"),
        F.lit("alert").alias("event_kind"),
        F.lit(rule.category).alias("event_category"),
        F.lit(rule.name).alias("event_action"),
        severity.alias("event_severity"),
        severity.alias("risk_score"),
        F.lit(rule.title or rule.name).alias("rule_name"),
        F.lit(rule.tactic).alias("rule_tactic"),
        F.lit(rule.technique).alias("rule_technique"),
        gid.alias("object_name"),
        template(said, {**cells, "count": F.col("n")}).alias("message"),
        F.col("n").alias("count"),
        "first_ts",
        "last_ts",
    )


def _counted(events: DataFrame, rule: Rule, *more: Column) -> DataFrame:
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in rule.group_by]
    return events.groupBy(*keys, *more).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def selected(events: DataFrame, rule: Rule) -> DataFrame:
    """Events of the rule; alerts never feed detections."""
    kind = F.coalesce(F.col("event_kind"), F.lit("")) != "alert" if "event_kind" in events.columns else F.lit(True)
    return events.where(F.expr(rule.where) & kind)


def detect_asof(events: DataFrame, rule: Rule, as_of: Column) -> DataFrame:
    """The rule as it stands at one time: events from ``window`` seconds before it on; the alert's bucket is that time's."""
    since = as_of - F.expr(f"INTERVAL {int(rule.window)} SECOND")
    rows = _counted(selected(events, rule).where(F.col("ts") >= since), rule)
    return _alerts(rows, rule, as_of, F.floor(F.unix_timestamp(as_of) / F.lit(rule.window)))


def detect_tumbling(events: DataFrame, rule: Rule) -> DataFrame:
    """The rule over the whole history, in windows side by side; also over a stream with a watermark."""
    rows = _counted(selected(events, rule), rule, F.window("ts", f"{int(rule.window)} seconds").alias("_w"))
    return _alerts(rows, rule, F.col("_w.end"), F.floor(F.unix_timestamp(F.col("_w.start")) / F.lit(rule.window)))


@dataclass(frozen=True)
class Finding:
    """A finding: which rows of a table it selects, what is said about each, and in which order.

    ``evidence`` is a template over the table's columns and ``more`` (name, SQL). Rows come by ``number`` descending, then ``newest`` descending,
    then ``order`` ascending; beyond ``cap`` rows only these count. A row counts for as many as ``rows`` says (SQL; 1 without it).
    """

    name: str
    title: str
    severity: str
    table: str
    where: str
    evidence: str
    more: tuple[tuple[str, str], ...] = ()
    number: str = ""
    newest: str = ""
    order: tuple[str, ...] = ()
    cap: int | None = None
    time: str = ""
    rows: str = ""


FINDING_SEVERITIES = {"high": 3, "medium": 2, "low": 1}


def _finding_row(view: DataFrame, f: Finding) -> Column:
    """What the rule says about a row of its table, or null; raises if the table lacks what the rule reads."""
    cells = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in view.columns} | {name: F.coalesce(F.expr(sql).cast("string"), F.lit("")) for name, sql in f.more}
    text = lambda sql: F.coalesce(F.expr(sql).cast("string"), F.lit("")) if sql else F.lit("")
    said = F.struct(
        F.lit(f.name).alias("finding"),
        (-F.coalesce(F.expr(f.number).cast("double"), F.lit(0.0)) if f.number else F.lit(0.0)).alias("number"),
        text(f.newest).alias("newest"),
        F.array(*map(text, f.order)).cast("array<string>").alias("order"),
        F.trim(template(f.evidence, cells)).alias("line"),
        text(f.time).alias("time"),
        (F.expr(f.rows) if f.rows else F.lit(1)).cast("long").alias("rows"),
    )
    found = F.when(F.expr(f.where), said)
    view.select(found)  # analysed here, so that a bad rule shows itself alone
    return found


def run_findings(spark: SparkSession, findings: Sequence[Finding], views: dict[str, DataFrame], most: int = 12) -> DataFrame:
    """``finding, title, severity, n, when, evidence, error``: a row for each finding that has rows, and for each rule that can't be read.

    All rules of a table are evaluated in one scan of it: a row goes on once for each rule that it fits. Each rule is analysed by itself; one
    whose table or columns are missing, or that isn't SQL, has its error's condition and doesn't stop the others. The evidence is
    that of the first ``most`` rows, which each task selects before anything is moved. Severe findings come first, then those of many rows.
    """
    by_table: dict[str, list[Column]] = {}
    errors: list[tuple[str, str]] = []
    for f in findings:
        if f.table not in views:
            errors.append((f.name, "TABLE_OR_VIEW_NOT_FOUND"))
            continue
        try:
            by_table.setdefault(f.table, []).append(_finding_row(views[f.table], f))
        except AnalysisException as error:
            errors.append((f.name, (error.getCondition() or "ANALYSIS_ERROR").split(".")[0]))
    about = spark.createDataFrame([(f.name, f.title, f.severity, f.cap, FINDING_SEVERITIES.get(f.severity, 0)) for f in findings], "finding string, title string, severity string, cap long, weight int")
    wrong = spark.createDataFrame(errors, "finding string, error string")
    out = wrong.select("finding", F.lit(0).cast("long").alias("n"), F.lit("").alias("when"), F.lit("").alias("evidence"), "error")
    rows = [views[t].select(F.explode(F.array_compact(F.array(*said))).alias("x")).select("x.*") for t, said in by_table.items() if said]
    if rows:
        rows = reduce(DataFrame.unionByName, rows)
        place = F.row_number().over(Window.partitionBy("finding").orderBy("number", F.desc("newest"), "order", "line"))
        first = rows.withColumn("_r", place).where(F.col("_r") <= most)
        first = first.groupBy("finding").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "line"))), lambda x: x["line"]), "; ").alias("evidence"))
        whole = rows.groupBy("finding").agg(F.sum("rows").alias("n"), F.max("time").alias("when"))
        out = out.unionByName(whole.join(first, "finding").withColumn("error", F.lit("")))
    out = out.join(F.broadcast(about), "finding").withColumn("n", F.least("n", "cap"))
    return out.orderBy(F.desc("weight"), F.desc("n"), "finding").select("finding", "title", "severity", "n", "when", "evidence", "error")


def first_partners(rows: DataFrame, partners: DataFrame, on: Sequence[str], order: Column, most: int = 12) -> DataFrame:
    """Each of ``rows`` with the first ``most`` of its ``partners``, and ``pairs``: how many pairs a row of the result counts for; the first partner also counts for those left out.

    A finding on pairs has the same report on these as on all, with ``rows="pairs"``, if only its line reads the partner and the lines of one row
    come in ``order``: none but a row's first ``most`` can be among the first of all. The pairs themselves grow with the square of a key's rows.
    """
    place = F.row_number().over(Window.partitionBy(*on).orderBy(order))
    first = partners.withColumn("_r", place).where(F.col("_r") <= most).join(partners.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), list(on))
    first = first.withColumn("pairs", F.when(F.col("_r") == 1, F.greatest(F.col("_n") - most, F.lit(0)) + 1).otherwise(1))
    return rows.join(first.drop("_r", "_n"), list(on))


def findings_total(report: DataFrame, rules: int) -> DataFrame:
    """One row: rows and findings by severity, and how many rules there are and how many failed."""
    good = F.col("error") == ""
    return report.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *(F.count_if(good & (F.col("severity") == s)).alias(s) for s in FINDING_SEVERITIES), F.lit(rules).cast("long").alias("rules"), F.count_if(~good).alias("errors"))


def marker_score(c: Column, markers: Sequence[tuple[str, int, str]]) -> tuple[Column, Column]:
    """Summed weights of the patterns that occur, and their names."""
    score, names = F.lit(0), []
    for pattern, weight, name in markers:
        hit = F.coalesce(c.rlike(pattern), F.lit(False))
        score = score + F.when(hit, weight).otherwise(0)
        names.append(F.when(hit, F.lit(name)))
    return score, F.array_join(F.array_compact(F.array(*names)), ", ")


def risk_level(score: Column) -> Column:
    return F.when(score >= 5, "high").when(score >= 3, "medium").when(score > 0, "low").otherwise("")


def _first_word(c: Column) -> Column:
    return F.substring_index(F.split_part(F.trim(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(1)), "/", -1)


def command_risk(processes: DataFrame, markers: Sequence[tuple[str, str, int]], parents: Sequence[str], by: Sequence[str] = ("host_id",)) -> DataFrame:
    """``cmd_score, cmd_flags, cmd_risk`` of each process: marks in the command, and what makes them worse: no purpose known from a package +2, root +1, one of ``parents`` as parent +1.

    Without a mark there is neither flag nor risk. Flags are the marks by name, then what makes them worse.
    """
    above = processes.groupBy(*by, F.col("pid").alias("ppid")).agg(F.min(_first_word(F.col("command"))).alias("_parent"))
    command = F.coalesce(F.col("command"), F.lit(""))
    hits = [(command.rlike(pattern), name, weight) for pattern, name, weight in markers]
    score = sum((F.when(h, w).otherwise(0) for h, _, w in hits), F.lit(0))
    marks = F.array_sort(F.array_compact(F.array(*(F.when(h, F.lit(name)) for h, name, _ in hits))))
    outside, root, started = F.coalesce(F.col("purpose"), F.lit("")) == "", F.coalesce(F.col("user"), F.lit("")) == "root", F.coalesce(F.col("_parent").isin(list(parents)), F.lit(False))
    worse = F.array_compact(F.array(F.when(outside, "not from a package"), F.when(root, "root"), F.when(started, F.concat(F.lit("started from "), "_parent"))))
    weight = F.when(outside, 2).otherwise(0) + F.when(root, 1).otherwise(0) + F.when(started, 1).otherwise(0)
    out = processes.join(above, [*by, "ppid"], "left").withColumn("_m", score)
    out = out.withColumn("cmd_flags", F.when(F.col("_m") > 0, F.array_join(F.concat(marks, worse), ", ")).otherwise("")).withColumn("cmd_score", F.when(F.col("_m") > 0, F.col("_m") + weight).otherwise(0))
    return out.withColumn("cmd_risk", risk_level(F.col("cmd_score"))).drop("_m", "_parent")


#: Where temporary programs lie, and the beginnings of addresses that are not outside.
TEMPORARY = ("/tmp/", "/dev/shm/", "/var/tmp/", "/run/user/")
INSIDE = ("10.", "192.168.", "127.", "172.16.", "172.17.", "172.18.", "172.19.", "::1")


def process_risk(processes: DataFrame, sockets: DataFrame, files: DataFrame, packages: DataFrame, home: str = "/home/", by: Sequence[str] = ("host_id",)) -> DataFrame:
    """``risk`` and ``reasons`` of each process; kernel threads (commands in brackets) have 0.

    An executable in a temporary directory or cache 3, below ``home`` but not in its ``.local/bin`` 2, deleted 3, neither a packaged file (``files``: ``path``) nor named
    like a package (``packages``: ``name``) 2; a socket (``exposure, remote``) open to the network 3, or with an outside address 2; root 1; a command that names another program 1.
    """
    address = F.trim(F.expr("CASE WHEN contains(remote, ':') THEN substr(remote, 1, length(remote) - length(substring_index(remote, ':', -1)) - 1) ELSE remote END"))
    address = F.regexp_replace(F.coalesce(address, F.lit("")), r"^[\[\]]+|[\[\]]+$", "")
    outside = (address != "") & ~reduce(or_, (address.startswith(x) for x in INSIDE))
    net = sockets.groupBy(*by, "pid").agg(F.max(F.col("exposure") == "OPEN (exposed)").alias("_exposed"), F.max(outside).alias("_external"))
    exe, command = F.coalesce(F.col("exe"), F.lit("")), F.trim(F.coalesce(F.col("command"), F.lit("")))
    named = F.when(exe != "", F.substring_index(exe, "/", -1)).otherwise(_first_word(F.col("command")))
    rows = processes.withColumn("_exe", exe).withColumn("_base", F.lower(named)).join(net, [*by, "pid"], "left")
    rows = rows.join(files.select(*by, F.col("path").alias("_exe"), F.lit(True).alias("_file")).distinct(), [*by, "_exe"], "left")
    rows = rows.join(packages.select(*by, F.lower("name").alias("_base"), F.lit(True).alias("_package")).distinct(), [*by, "_base"], "left")
    has = exe != ""
    tests = [
        (has & (reduce(or_, (exe.startswith(x) for x in TEMPORARY)) | exe.contains("/.cache/")), 3, "runs from temp dir"),
        (has & exe.startswith(home) & ~exe.contains("/.local/bin"), 2, "binary in home"),
        (has & F.coalesce(F.col("command"), F.lit("")).contains("(deleted)"), 3, "binary deleted"),
        (has & F.col("_file").isNull() & F.col("_package").isNull(), 2, "not from a package"),
        (F.col("_exposed"), 3, "listening exposed"),
        (F.col("_external"), 2, "external connection"),
        (F.col("user") == "root", 1, "root"),
        ((named != "") & (command != "") & (named != _first_word(F.col("command"))), 1, "name/exe mismatch"),
    ]
    score, reasons = F.lit(0), []
    for hit, weight, reason in tests:
        hit = F.coalesce(hit, F.lit(False)) & ~command.startswith("[")
        score = score + F.when(hit, weight).otherwise(0)
        reasons.append(F.when(hit, F.lit(reason)))
    return rows.withColumn("risk", score).withColumn("reasons", F.array_join(F.array_compact(F.array(*reasons)), ", ")).drop("_exposed", "_external", "_exe", "_base", "_file", "_package")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
