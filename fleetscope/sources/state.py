"""The state store: snapshots by key, their differences, and change events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANGE_CAP, FIELDS_PER_ROW, BULK_EXAMPLES = 150, 6, 8
SEVERITY = {"added": 30, "removed": 30, "changed": 25}


def as_text(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A state table: all cells text, null the empty text, booleans yes or empty."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.when(F.col(c), F.lit("yes")).otherwise("") if kinds[c] == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(*((F.col(c) if c in keep else cell(c)).alias(c) for c in df.columns))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _key_equal(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.coalesce(F.col(f"o.{k}").cast("string"), F.lit("")) == F.coalesce(F.col(f"n.{k}").cast("string"), F.lit("")) for k in keys])


def state_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], src: str | None = None, src_col: str = "_src") -> DataFrame:
    """``keys…, change, fields``: added, removed and changed rows; ``fields`` lists name, old and new of each changed column.

    Cells compare as text, null equal to empty; only columns of both sides compare.
    With ``src``, only rows of that writer can disappear.
    """
    shared = [c for c in new.columns if c in old.columns and c not in keys and c not in (src_col, "collected_at")]
    cell = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    has_o, has_n = F.lit(True).alias("_there"), F.lit(True).alias("_there")
    joined = old.select("*", has_o).alias("o").join(new.select("*", has_n).alias("n"), _key_equal(keys), "full_outer")
    gone = F.col("n._there").isNull()
    if src is not None:
        gone &= F.col(f"o.{src_col}") == src
    pairs = [F.when(cell("o", c) != cell("n", c), F.struct(F.lit(c).alias("field"), cell("o", c).alias("old"), cell("n", c).alias("new"))) for c in shared]
    fields = F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<struct<field:string,old:string,new:string>>")
    both = F.col("o._there").isNotNull() & F.col("n._there").isNotNull()
    change = F.when(F.col("o._there").isNull(), "added").when(both & (F.size(fields) > 0), "changed").when(~both & gone, "removed")
    none = F.array().cast("array<struct<field:string,old:string,new:string>>")
    found = joined.select(*(F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys), change.alias("change"), F.when(both, fields).otherwise(none).alias("fields"))
    return found.where("change IS NOT NULL")


def field_changes(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each changed field."""
    return diff.where("change = 'changed'").select(*keys, F.explode("fields").alias("f")).select(*keys, "f.field", "f.old", "f.new")


def apply_snapshot(old: DataFrame, new: DataFrame, keys: Sequence[str], src: str, src_col: str = "_src") -> DataFrame:
    """The table after a writer's snapshot: its missing rows go, matched rows take the new cells and this writer's tag, other writers' rows stay, columns that only one side has are kept."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    joined = old.select("*", F.lit(True).alias("_there")).alias("o").join(new.select("*", F.lit(True).alias("_there")).alias("n"), _key_equal(keys), "full_outer")
    stays = F.col("n._there").isNotNull() | (F.col(f"o.{src_col}") != src)

    def cell(c: str) -> Column:
        if c == src_col:
            return F.when(F.col("n._there").isNotNull(), F.lit(src)).otherwise(F.col(f"o.{src_col}"))
        sides = [F.col(f"{s}.{c}").cast("string") for s, t in (("n", new), ("o", old)) if c in t.columns]
        return F.when(F.col("n._there").isNotNull(), F.coalesce(*sides, F.lit(""))).otherwise(F.coalesce(sides[-1], F.lit(""))) if len(sides) > 1 else F.coalesce(sides[0], F.lit(""))

    return joined.where(stays).select(*(cell(c).alias(c) for c in dict.fromkeys([*columns, src_col])))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: number of rows and the XOR of their hashes, whatever their order; two equal rows cancel out, so the number counts too."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("hash"))


def union_schema(*tables: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of tables with different columns; missing cells and key columns are empty text."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    for k in keys:
        if k not in out.columns:
            out = out.withColumn(k, F.lit(""))
    return out.fillna("")


def change_events(diff: DataFrame, keys: Sequence[str], table: str, title: str | None = None, derived: Sequence[str] = (), by: Sequence[str] = (), minute: Column | None = None, cap: int = CHANGE_CAP, first_inventory: bool = False) -> DataFrame:
    """Events of a difference: one for each added or removed row, one for each of the first six changed fields; a group (``by``) of over ``cap`` changes gives one summary instead.

    Changes of derived columns alone are none; a first inventory gives no events.
    """
    title = title or table
    minute = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm") if minute is None else minute
    real = F.filter("fields", lambda x: ~x["field"].isin(list(derived))) if derived else F.col("fields")
    items = diff.withColumn("fields", real).where("change <> 'changed' OR size(fields) > 0").where(F.lit(not first_inventory))
    items = items.withColumn("name", F.concat_ws(" / ", *keys))
    group = [F.col(c) for c in by]
    n = items.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("change") == c).alias(f"n_{c}") for c in SEVERITY))
    counts = items.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    marked = items.join(counts, list(by)) if by else items.join(F.broadcast(counts), F.lit(True))
    small = marked.where(F.col("_n") <= cap)
    fields = F.when(F.col("change") == "changed", F.slice("fields", 1, FIELDS_PER_ROW)).otherwise(F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("old"), F.lit("").alias("new"))))
    each = small.select(*group, "change", "name", F.explode(fields).alias("f")).select(*by, "change", "name", "f.*")
    show = lambda c: F.substring(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("empty")), 1, 60)
    message = F.when(F.col("change") == "changed", F.concat(F.lit(f"{title} / "), "name", F.lit(" - "), "field", F.lit(": "), show("old"), F.lit(" -> "), show("new"))).otherwise(F.concat("change", F.lit(f" in «{title}»: "), "name"))
    severity = F.when(F.col("change") == "changed", SEVERITY["changed"]).otherwise(SEVERITY["added"])
    rows = each.select(*by, F.concat(F.lit("state_"), "change").alias("event_action"), severity.cast("long").alias("event_severity"), F.col("name").alias("object_name"), F.concat_ws(":", F.lit("state"), F.lit(table), F.concat(F.lit("state_"), "change"), "name", F.when(F.col("field") != "", F.col("field")).otherwise(minute)).alias("event_id"), message.alias("message"), F.lit(table).alias("change_table"), F.col("name").alias("change_row"), F.col("field").alias("change_field"), F.col("old").alias("change_old"), F.col("new").alias("change_new"))
    most = F.col("n") > cap
    # The first names of each group that is too large: added, then removed, then changed ones, by name. Tasks keep that many before anything moves.
    kind = F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(kind, "name") if by else Window.partitionBy(F.lit(1)).orderBy(kind, "name"))
    named = items.withColumn("_r", place).where(F.col("_r") <= BULK_EXAMPLES).groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]), "; ").alias("_examples"))
    told = n.where(most).join(named, list(by)) if by else n.where(most).join(F.broadcast(named), F.lit(True))
    text = F.concat(F.lit(f"bulk change '{title}': "), "n_added", F.lit(" added, "), "n_removed", F.lit(" removed, "), "n_changed", F.lit(" changed. Examples: "), "_examples", F.lit(f" (summarised — more than {cap} records)"))
    bulk = told.select(*group, F.lit("state_bulk_change").alias("event_action"), F.lit(35).cast("long").alias("event_severity"), F.lit(title).alias("object_name"), F.concat_ws(":", F.lit("state"), F.lit(table), F.lit("state_bulk_change"), F.lit(title), minute).alias("event_id"), text.alias("message"), F.lit(table).alias("change_table"), *(F.lit("").alias(c) for c in ("change_row", "change_field", "change_old", "change_new")))
    return rows.unionByName(bulk)


BUCKETS = 1024


def bucket_hashes(df: DataFrame) -> DataFrame:
    """``_bucket, n, x, total``: how many rows each bucket has, and two sums of their hashes that no order changes; equal rows don't cancel out in the second."""
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns) if c != "_bucket"))
    return df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit((1 << 31) - 1))).alias("total"))


def write_version(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """A version of a state table: its rows by bucket of their key, and the buckets' hashes. All versions of a table have the same number of buckets."""
    spark, key = df.sparkSession, F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    df.withColumn("_bucket", F.pmod(key, F.lit(buckets)).cast("int")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    bucket_hashes(spark.read.parquet(f"{path}/rows")).coalesce(1).write.parquet(f"{path}/hashes")


def versions_diff(spark: SparkSession, old: str, new: str, keys: Sequence[str], src: str | None = None, src_col: str = "_src") -> DataFrame:
    """``state_diff`` of two written versions; only buckets whose hashes differ are read: their numbers (at most as many as there are buckets) prune both tables' folders."""
    a, b = (spark.read.parquet(f"{p}/hashes").select("_bucket", F.struct("n", "x", "total").alias(name)) for p, name in ((old, "_a"), (new, "_b")))
    changed = [x["_bucket"] for x in a.join(b, "_bucket", "full_outer").where("NOT (_a <=> _b)").select("_bucket").collect()]
    rows = [spark.read.parquet(f"{p}/rows").where(F.col("_bucket").isin(changed)).drop("_bucket") for p in (old, new)]
    return state_diff(*rows, keys, src, src_col)


def snapshot_sequence_events(snaps: DataFrame, keys: Sequence[str], order: str, by: Sequence[str] = ("host_id",), epoch: str | None = None) -> DataFrame:
    """Appearances and disappearances between consecutive snapshots: ``by…, order, keys…, action``.

    A key appears in a snapshot if the one before it (of the same ``by``) lacks it, and
    vanishes in the first that lacks it again. The first snapshot is a baseline and
    gives no events; with ``epoch`` (a boot id) a change of it starts a new baseline.
    """
    rows = snaps.select(*by, order, *keys, *([epoch] if epoch else [])).distinct()
    line = Window.partitionBy(*by).orderBy(order)
    runs = rows.select(*by, order, *([epoch] if epoch else [])).distinct()
    runs = runs.withColumn("_prev", F.lag(order).over(line)).withColumn("_next", F.lead(order).over(line))
    if epoch:
        runs = runs.withColumn("_same_prev", F.lag(epoch).over(line).eqNullSafe(F.col(epoch))).withColumn("_same_next", F.lead(epoch).over(line).eqNullSafe(F.col(epoch)))
    runs = runs.drop(epoch) if epoch else runs.withColumn("_same_prev", F.lit(True)).withColumn("_same_next", F.lit(True))
    own = Window.partitionBy(*by, *keys).orderBy(order)
    seen = rows.join(runs, [*by, order]).withColumn("_was", F.lag(order).over(own)).withColumn("_will", F.lead(order).over(own))
    came = seen.where(F.col("_prev").isNotNull() & F.col("_same_prev") & ~F.col("_was").eqNullSafe(F.col("_prev"))).select(*by, F.col(order), *keys, F.lit("appeared").alias("action"))
    left = seen.where(F.col("_next").isNotNull() & F.col("_same_next") & ~F.col("_will").eqNullSafe(F.col("_next"))).select(*by, F.col("_next").alias(order), *keys, F.lit("vanished").alias("action"))
    return came.unionByName(left)


def search_tables(tables: dict[str, DataFrame], term: str, samples: int = 3) -> DataFrame:
    """``table, n, columns, samples``: rows of each table in which some column holds the term, without regard to case; the columns that do, and some of the values."""
    found = None
    low = term.lower()
    for name, df in tables.items():
        hits = {c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(low) for c in df.columns}
        row = df.where(reduce(or_, hits.values())).agg(
            F.count(F.lit(1)).alias("n"),
            F.array_join(F.array_compact(F.array(*(F.when(F.count_if(h) > 0, F.lit(c)) for c, h in sorted(hits.items())))), ",").alias("columns"),
            F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.array(*(F.coalesce(F.array_compact(F.array(F.min(F.when(h, F.col(c).cast("string"))))), F.array()) for c, h in hits.items()))))), 1, samples), " · ").alias("samples"),
        ).select(F.lit(name).alias("table"), "n", "columns", "samples")
        found = row if found is None else found.unionByName(row)
    return found.where("n > 0")
