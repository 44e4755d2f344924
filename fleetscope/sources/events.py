"""The event table: schema, append without duplicates, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from fleetscope.sources.checkpoints import checkpointed

#: Event fields by group; fixed values of the taxonomy that events are read and written in.
GROUPS = {
    "event": "ts ingested event_id event_kind event_category event_type event_action event_outcome event_severity event_module event_dataset event_provider message raw not_normalized tags subject_type subject_name object_type object_name",
    "user": "user_name user_id user_effective user_audit_id user_target user_group session_id session_started session_tty logon_type",
    "process": "process_pid process_name process_executable process_command_line process_cwd process_exit_code process_source process_alive parent_pid parent_name parent_executable parent_command_line",
    "network": "source_ip source_port destination_ip destination_port destination_host destination_country destination_org network_protocol network_direction network_bytes network_packets network_application",
    "host": "host_id host_name host_ip host_os host_boot_id boot_started",
    "file": "file_path file_name file_directory file_extension file_size file_owner file_mode file_hash",
    "change": "change_table change_row change_field change_old change_new",
    "linux": "service_name service_state service_result syscall audit_type selinux_context package_name package_version package_action unit_file",
    "detection": "rule_id rule_name rule_tactic rule_technique risk_score",
    "intel": "threat_indicator threat_source threat_score as_number as_org",
    "related": "related_ip related_user related_hash",
}
LONGS = frozenset("event_severity process_pid parent_pid file_size network_bytes network_packets source_port destination_port risk_score".split())


def event_schema() -> StructType:
    """The taxonomy as a schema; a field's group is in its metadata."""
    kind = lambda name: TimestampType() if name == "ts" else LongType() if name in LONGS else StringType()
    return StructType([StructField(name, kind(name), True, {"group": group}) for group, names in GROUPS.items() for name in names.split()])


def conform(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Rows in the taxonomy's columns. Names of filled columns outside it go to ``not_normalized``; ``ingested`` is set if empty; ``raw`` is blanked where everything was understood."""
    schema = schema or event_schema()
    names = set(schema.names)
    extra = sorted(c for c in df.columns if c not in names)
    unknown = unmapped(F.array_compact(F.array(*(F.when(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "", F.lit(c)) for c in extra)))) if extra else F.lit("")
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    out = df.withColumn("not_normalized", F.concat_ws(" · ", F.nullif(given("not_normalized"), F.lit("")), F.nullif(unknown, F.lit(""))))
    out = out.withColumn("ingested", F.coalesce(F.nullif(given("ingested"), F.lit("")), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    out = out.withColumn("raw", F.when(F.col("not_normalized") == "", F.lit("")).otherwise(given("raw")))
    cells = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return out.select(*cells)


def unmapped(names, most: int = 20):
    """An array of names as text: sorted, the first ``most``, and how many more."""
    ordered = F.array_sort(names)
    more = F.size(ordered) - most
    return F.concat(F.array_join(F.slice(ordered, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``. Null keys never collide, empty ones do."""
    null = None
    for k in keys:
        null = F.col(k).isNull() if null is None else null | F.col(k).isNull()
    known = df.where(~null).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return known.unionByName(df.where(null))


def append_dedup(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("host_id", "event_id"), order: Sequence[str] = ("_seq",)) -> DataFrame:
    """The rows of ``incoming`` that an append adds: the first of each key that is not stored yet."""
    return first_wins(incoming, keys, order).join(stored.select(*keys).distinct(), list(keys), "left_anti")


def stored_days(spark: SparkSession, path: str, days: Sequence, columns: Sequence[str], date: str = "event_date") -> DataFrame | None:
    """The given columns of a stored table's days, or None if there is no table yet; other days' folders aren't read."""
    try:
        return spark.read.parquet(path).where(F.col(date).isin(list(days))).select(*columns, date)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_by_day(incoming: DataFrame, path: str, keys: Sequence[str] = ("host_id", "event_id"), order: Sequence[str] = ("ts",), ts: str = "ts", date: str = "event_date", small: int = 1_000_000) -> DataFrame:
    """Appends to a table by date what it lacks: the first row of each key; returns these rows as written.

    A key belongs to the day of its event, so the keys that are compared are those of the incoming rows' days: two columns of these days'
    folders, whatever else the table holds. Of them only keys that come in again go on; the incoming keys are sent to the store's
    side if they are at most ``small``. A row that comes late has its own, old day and meets its first copy there. Null keys are always new.
    """
    spark = incoming.sparkSession
    rows = checkpointed(first_wins(incoming.withColumn(date, F.to_date(ts)), [*keys, date], order))
    days = [x[date] for x in rows.select(date).distinct().collect()]
    stored = stored_days(spark, path, days, keys, date)
    if stored is not None:
        on = [*keys, date]
        mine = rows.select(*on).distinct()
        again = stored.join(F.broadcast(mine) if mine.count() <= small else mine, on, "left_semi").distinct()
        rows = checkpointed(rows.join(again, on, "left_anti"))
    rows.repartition(date).write.mode("append").partitionBy(date).parquet(path)
    return rows


def retain_newest(df: DataFrame, n: int = 300_000, order: str = "_seq") -> DataFrame:
    """The newest ``n`` rows by ``order``.

    Only the order column takes part in the top-n that finds the bound; at fleet scale
    a partition by date is dropped instead.
    """
    newest = df.select(F.col(order).alias("_o")).orderBy(F.desc("_o")).limit(n).agg(F.min("_o").alias("_least"))
    return df.join(F.broadcast(newest), F.col(order) >= F.col("_least"), "left_semi")


def union_sources(*sources: DataFrame) -> DataFrame:
    """One table from several, with all columns that any has."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
