"""Aggregations: feeds, group counts, field statistics, panels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.scalars import basename, dirname

SEPARATOR = " · "


def page(df: DataFrame, where: Column | None, order: Sequence[Column], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and a row with ``total`` and whether rows follow (``truncated``). ``order`` must end in a unique column."""
    rows = df if where is None else df.where(where)
    total = rows.agg(F.count(F.lit(1)).alias("total")).select("total", (F.col("total") > offset + limit).alias("truncated"))
    return rows.orderBy(*order).offset(offset).limit(limit), total


def event_stats(events: DataFrame, fields: Sequence[str], top: int = 20, ts: str = "ts") -> DataFrame:
    """``field, value, n``: the top values of each field; the field "" has the total, the least and the largest time."""
    whole = events.agg(F.count(F.lit(1)).alias("n"), F.min(ts).cast("string").alias("a"), F.max(ts).cast("string").alias("b")).select(F.lit("").alias("field"), F.concat_ws(" .. ", "a", "b").alias("value"), "n")
    out = whole
    for f in fields:
        rows = events.groupBy(F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
        out = out.unionByName(rows.select(F.lit(f).alias("field"), "value", "n"))
    return out


def group_counts(df: DataFrame, fields: Sequence[str], limit: int = 300) -> DataFrame:
    """``label, n`` and the fields: counts of their combinations, null and empty being one; the most frequent ``limit``."""
    cells = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]
    rows = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))
    label = F.concat_ws(SEPARATOR, *(F.when(F.col(f) == "", F.lit("(empty)")).otherwise(F.col(f)) for f in fields))
    return rows.withColumn("label", label).orderBy(F.desc("n"), "label").limit(limit)


def field_stats(df: DataFrame, fields: Sequence[str], top: int = 12, approximate: bool = False) -> DataFrame:
    """For each field: filled, percent, unique values, and the top values with counts as text.

    One scan and one shuffle of distinct values a field; ``approximate`` counts distinct values by a sketch.
    """
    total = df.count()
    cells = df.select(*(F.nullif(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields))
    long = cells.unpivot([], list(fields), "field", "value").where("value IS NOT NULL")
    values = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    best = values.withColumn("_r", rank).where(F.col("_r") <= top).groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value", "n"))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), SEPARATOR).alias("top"))
    counts = values.groupBy("field").agg(F.sum("n").alias("filled"), (F.approx_count_distinct("value") if approximate else F.count(F.lit(1))).alias("unique"))
    percent = F.round(F.col("filled") * 100.0 / F.lit(max(total, 1)), 1).alias("percent")
    return counts.join(best, "field").select("field", "filled", percent, "unique", "top")


def hourly(events: DataFrame, ts: str = "ts", external: Column | None = None, buckets: int | None = None) -> DataFrame:
    """``hour, n`` (and ``external``) in ascending order; the last ``buckets`` hours with events."""
    extra = [F.count_if(external).alias("external")] if external is not None else []
    rows = events.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"), *extra)
    return rows.orderBy("hour") if buckets is None else rows.orderBy(F.desc("hour")).limit(buckets).orderBy("hour")


def top_counts(df: DataFrame, field: str, limit: int | None, blank: str = "") -> DataFrame:
    """``value, n`` of a field's ``limit`` most frequent values, or of all; null and empty are called ``blank``."""
    value = F.coalesce(F.nullif(F.col(field).cast("string"), F.lit("")), F.lit(blank))
    rows = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    return rows if limit is None else rows.limit(limit)


@dataclass(frozen=True)
class Panel:
    """A list of a field's values among the rows that ``where`` selects: the ``limit`` most frequent, or the ``limit`` largest (``newest``) in ascending order."""

    name: str
    where: str
    value: str
    limit: int | None = None
    newest: bool = False


def panels(events: DataFrame, wanted: Sequence[Panel], ts: str = "ts", distinct: str = "NULL", largest: str = "NULL") -> DataFrame:
    """``panel, rank, value, n, distinct_n, largest, last_ts`` of all panels from one scan and one exchange of counts.

    A row goes on once for each panel that it belongs to; ``distinct`` and ``largest`` are SQL, whose distinct values and maximum are taken for each value.
    """
    said = [F.when(F.expr(p.where), F.struct(F.lit(p.name).alias("panel"), F.expr(p.value).cast("string").alias("value"))) for p in wanted]
    rows = events.select(F.explode(F.array_compact(F.array(*said))).alias("x"), F.expr(distinct).cast("string").alias("_d"), F.expr(largest).cast("string").alias("largest"), F.col(ts).alias("_ts"))
    counts = rows.groupBy("x.panel", "x.value", "_d").agg(F.count(F.lit(1)).alias("n"), F.max("largest").alias("largest"), F.max("_ts").alias("last_ts"))
    counts = counts.groupBy("panel", "value").agg(F.sum("n").alias("n"), F.count("_d").alias("distinct_n"), F.max("largest").alias("largest"), F.max("last_ts").alias("last_ts"))
    newest = F.col("panel").isin([p.name for p in wanted if p.newest])
    limit = F.coalesce(F.create_map(*(F.lit(x) for p in wanted for x in (p.name, p.limit if p.limit is not None else -1)))[F.col("panel")], F.lit(-1))
    best = Window.partitionBy("panel").orderBy(F.when(newest, F.lit(0)).otherwise(-F.col("n")), F.when(newest, F.col("value")).desc(), "value")
    most = max((p.limit for p in wanted if p.limit is not None), default=None)
    ranked = counts.withColumn("rank", F.row_number().over(best))
    if most is not None and all(p.limit is not None for p in wanted):
        ranked = ranked.where(F.col("rank") <= most)
    ranked = ranked.where((limit < 0) | (F.col("rank") <= limit))
    again = Window.partitionBy("panel").orderBy("value")
    return ranked.withColumn("rank", F.when(newest, F.row_number().over(again)).otherwise(F.col("rank"))).select("panel", "rank", "value", "n", "distinct_n", "largest", "last_ts")


_NAMED = "coalesce(file_path, '') <> ''"
FILE_PANELS = (
    Panel("by_action", "event_category = 'file'", "coalesce(event_action, '')"),
    Panel("by_dir", "event_category = 'file' AND coalesce(file_directory, '') <> ''", "file_directory", 15),
    Panel("by_package", "event_category = 'file'", "coalesce(package_name, '(unpackaged)')", 12),
    Panel("by_who", _NAMED, "coalesce(nullif(subject_name, ''), '(not recorded)')", 12),
    Panel("series", "event_category = 'file'", "date_format(ts, \"yyyy-MM-dd'T'HH\")", 48, True),
)
PRIVILEGE_PANELS = (
    Panel("auth_failures", "event_category = 'authentication' AND event_outcome = 'failure'", "coalesce(subject_name, '?')", 10),
    Panel("sudo_commands", "event_action = 'user_command' AND coalesce(process_command_line, '') <> ''", "process_command_line", 15),
)
NETWORK_PANELS = (
    Panel("dns", "coalesce(destination_domain, '') <> ''", "destination_domain", 25),
    Panel("by_asn", "event_category = 'network' AND coalesce(destination_ip, '') <> ''", "coalesce(destination_as_org, '(unknown)')", 15),
    Panel("by_process", "event_category = 'network'", "coalesce(nullif(process_name, ''), '(owner unknown)')", 15),
)


def file_activity(events: DataFrame) -> DataFrame:
    """File events by action, directory, package and author, and by hour, as ``panels``."""
    return panels(events, FILE_PANELS)


def network_activity(events: DataFrame) -> DataFrame:
    """Names asked for, networks and processes of network events, with their distinct addresses and the largest, as ``panels``."""
    return panels(events, NETWORK_PANELS, distinct="nullif(destination_ip, '')", largest="destination_ip")


def privilege_activity(events: DataFrame) -> DataFrame:
    """Failed authentications by subject and commands run as another user, as ``panels``."""
    return panels(events, PRIVILEGE_PANELS)


def privilege_standing(vectors: DataFrame, suid: DataFrame, users: DataFrame, polkit: DataFrame, by: Sequence[str] = ("host_id",)) -> DataFrame:
    """``by…, panel, rank, name, detail``: of each host the newest 200 ways to more privileges (then by risk), 200 setuid files, all users with administrators' groups, and 60 high-risk actions."""
    desc = lambda c: F.desc(F.coalesce(F.col(c).cast("string"), F.lit("")))
    sides = (
        ("vectors", vectors, F.lit(True), F.concat_ws(": ", "kind", "name"), F.col("detail"), (desc("changed"), desc("risk"), "name"), 200),
        ("suid", suid, F.lit(True), F.col("path"), F.concat_ws(" ", "owner", "perms"), ("path",), 200),
        ("admins", users, F.coalesce(F.col("admin_groups"), F.lit("")) != "", F.col("name"), F.concat_ws(" ", "privilege", "admin_groups"), ("name",), None),
        ("polkit", polkit, F.col("risk") == "high", F.col("action"), F.concat_ws(" ", "title", "allow_active"), ("action",), 60),
    )
    out = []
    for panel, df, where, name, detail, order, limit in sides:
        rows = df.where(where).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        out.append((rows if limit is None else rows.where(F.col("rank") <= limit)).select(*by, F.lit(panel).alias("panel"), "rank", name.alias("name"), detail.alias("detail")))
    return reduce(DataFrame.unionByName, out)


def day_sketches(events: DataFrame, fields: Sequence[str], ts: str = "ts", bits: int = 14) -> DataFrame:
    """``day, field, n, sketch``: for each day and field how many cells are filled and a HyperLogLog sketch of their values, to be kept and merged."""
    long = events.select(F.to_date(ts).alias("day"), *(F.nullif(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields)).unpivot("day", list(fields), "field", "value").where("value IS NOT NULL")
    return long.groupBy("day", "field").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("value", bits).alias("sketch"))


def merged_sketches(sketches: DataFrame, first: Column, last: Column) -> DataFrame:
    """``field, n, distinct_n``: counts and estimated distinct values of the days from ``first`` to ``last``, from their sketches alone. With 14 bits the standard error is 0.8 %."""
    rows = sketches.where(F.col("day").between(first, last))
    return rows.groupBy("field").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_n"))


def who_changed(files: DataFrame, others: DataFrame, path: str, attributes: Sequence[str]) -> DataFrame:
    """Each file event with the largest value of each attribute among other events of its path, and where it came from.

    The attributes are independent of each other: two may come from different events.
    """
    known = others.where(F.coalesce(F.col(path).cast("string"), F.lit("")) != "").groupBy(path).agg(*(F.max(a).alias(f"who_{a}") for a in attributes), F.max("ts").alias("who_ts"))
    out = files.join(known, path, "left")
    return out.withColumn("who_source", F.when(F.col("who_ts").isNull(), F.lit("rpm -Va: the editor is not recorded")).otherwise(F.lit("kernel audit")))


def network_flows(events: DataFrame, key: str, attributes: Sequence[str], port: str, ts: str = "ts") -> DataFrame:
    """For each destination: sessions, distinct ports, first and last time, distinct active hours, and the largest value of each attribute by itself."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.countDistinct(port).alias("ports"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.countDistinct(F.date_trunc("hour", ts)).alias("hours"),
        *(F.max(a).alias(a) for a in attributes),
    )


def rare_sessions(flows: DataFrame, external: Column, owner: Column, threat: Column | None = None) -> DataFrame:
    """``marks`` and ``rare``: at least two of few external sessions, owner unknown, one external hour, threat."""
    unknown = F.coalesce(owner, F.lit("")) == ""
    marks = F.array_compact(F.array(
        F.when(external & (F.col("sessions") <= 3), F.lit("few sessions")),
        F.when(unknown, F.lit("owner unknown")),
        F.when(external & (F.col("hours") <= 1), F.lit("narrow time window")),
        F.when(F.coalesce(threat, F.lit("")) != "", F.lit("matched a threat feed")) if threat is not None else F.lit(None).cast("string"),
    ))
    return flows.withColumn("marks", F.array_join(marks, ", ")).withColumn("rare", F.size(marks) >= 2)


def flow_detail(events: DataFrame, ip_fields: Sequence[str] = ("source_ip", "destination_ip"), cap: int = 200, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The newest events of every address, in either direction: two equi-joins' worth of rows instead of an OR."""
    sides = [events.where(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").withColumn("ip", F.col(f)).withColumn("direction", F.lit(f)) for f in ip_fields]
    both = sides[0].unionByName(sides[1]).dropDuplicates(["ip", "event_id"]) if len(sides) > 1 else sides[0]
    rank = F.row_number().over(Window.partitionBy("ip").orderBy(*(F.desc(c) for c in order)))
    return both.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")


def flow_participants(events: DataFrame, by: Sequence[str] = ("host_id",), ip: str = "destination_ip") -> DataFrame:
    """``by…, ip, name, pid, how, sessions, first_ts, last_ts``: which processes talked to each address, unknown ones being one."""
    text = lambda c: F.max(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in events.columns else F.lit("")
    name = F.coalesce(F.nullif(F.col("process_name"), F.lit("")), F.lit("(unknown)"))
    rows = events.where(F.coalesce(F.col(ip), F.lit("")) != "")
    return rows.groupBy(*by, F.col(ip).alias("ip"), name.alias("name")).agg(text("process_pid").alias("pid"), text("process_source").alias("how"), F.count(F.lit(1)).alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def flow_live(participants: DataFrame, ports: DataFrame, processes: DataFrame, by: Sequence[str] = ("host_id",), most: int = 10) -> DataFrame:
    """``by…, ip, kind, name, detail``: the sockets that are open to each address of ``participants`` now, and of its first ``most`` known programs by name the processes that run them.

    A socket's address is what stands before its last colon, so addresses are joined and no pattern is tried on every pair.
    """
    address = F.expr("substr(remote, 1, length(remote) - length(substring_index(remote, ':', -1)) - 1)")
    ips = participants.select(*by, "ip").distinct()
    sockets = ports.where("remote LIKE '%:%'").withColumn("ip", address).join(ips, [*by, "ip"]).select(*by, "ip", F.lit("socket").alias("kind"), F.col("process").alias("name"), F.concat_ws(" ", "proto", "local", "remote", "exposure").alias("detail"))
    place = F.row_number().over(Window.partitionBy(*by, "ip").orderBy("name"))
    named = participants.where("name <> '(unknown)'").select(*by, "ip", "name").distinct().withColumn("_r", place).where(F.col("_r") <= most).drop("_r")
    program = F.substring_index(F.split_part(F.trim("command"), F.lit(" "), F.lit(1)), "/", -1)
    running = processes.withColumn("name", program).join(named, [*by, "name"]).select(*by, "ip", F.lit("process").alias("kind"), "name", F.concat_ws(" ", F.col("pid").cast("string"), "user", "package", "purpose").alias("detail"))
    return sockets.unionByName(running)


def top_lists(processes: DataFrame, events: DataFrame, programs: DataFrame, ports: DataFrame, n: int = 10) -> DataFrame:
    """``panel, rank, name, detail, value``: the processes with most memory and processor time, the programs with most components, the most frequent destinations, and how many sockets have each exposure."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    program = F.substring_index(F.split_part(F.trim(F.coalesce("command", F.lit(""))), F.lit(" "), F.lit(1)), "/", -1)
    heavy = lambda panel, c: processes.select(F.lit(panel).alias("panel"), program.alias("name"), F.concat_ws(" ", F.col("pid").cast("string"), "user").alias("detail"), F.round(number(c), 1).alias("value"))
    seen = events.where(F.coalesce(F.col("destination_ip"), F.lit("")) != "").groupBy(F.col("destination_ip").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"), *(F.coalesce(F.max(c), F.lit("")).alias(c) for c in ("destination_as_org", "destination_geo_country")))
    lists = [
        heavy("rss", "rss_mb"), heavy("cpu", "cpu").where("value > 0"),
        programs.where("components > 0").select(F.lit("deps").alias("panel"), "name", F.col("kind").alias("detail"), F.col("components").cast("double").alias("value")),
        seen.select(F.lit("destinations").alias("panel"), "name", F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("destination_as_org", "destination_geo_country"))).alias("detail"), "value"),
    ]
    first = [x.orderBy(F.desc("value"), "name", "detail").limit(n) for x in lists]
    exposed = ports.groupBy(F.coalesce("exposure", F.lit("")).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("exposure").alias("panel"), "name", F.lit("").alias("detail"), "value")
    rows = reduce(DataFrame.unionByName, [*first, exposed])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("value"), "name", "detail")))


def sessions_by(events: DataFrame, keys: Sequence[str], blank: str = "(owner unknown)") -> DataFrame:
    """Sessions by address and process, unknown owners being one."""
    cells = [F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit(blank)).alias(k) for k in keys]
    return events.groupBy(*cells).agg(F.count(F.lit(1)).alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def ranked(df: DataFrame, ranks: dict[str, int], field: str, *then: Column) -> DataFrame:
    """Rows by the rank of a field's value (unknown values last), then by other columns."""
    rank = None
    for value, r in ranks.items():
        rank = F.when(F.lower(F.col(field)) == value, F.lit(r)) if rank is None else rank.when(F.lower(F.col(field)) == value, F.lit(r))
    return df.withColumn("rank", rank.otherwise(F.lit(len(ranks)))).orderBy("rank", *then)


def advisory_order(df: DataFrame) -> DataFrame:
    """Open advisories first, then by score (unscored last), then by severity."""
    opened = F.when(F.col("status") == "open", 0).otherwise(1)
    severity = F.when(F.lower("severity") == "critical", 0).when(F.lower("severity") == "important", 1).when(F.lower("severity") == "moderate", 2).when(F.lower("severity") == "low", 3).otherwise(4)
    return df.orderBy(opened, F.col("cvss_score").try_cast("double").desc_nulls_last(), severity, "advisory")


def advisory_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("status") == "closed").alias("n_closed"), F.count_if(F.col("cvss_score").try_cast("double").isNotNull()).alias("n_scored"))


def dashboard_tiles(processes: DataFrame, applications: DataFrame, ports: DataFrame, events: DataFrame) -> DataFrame:
    """One row of counts."""
    p = ports.agg(F.count_if((F.col("state") == "LISTEN")).alias("listening"), F.count_if(F.col("exposure").startswith("OPEN")).alias("exposed"), F.count_if(F.coalesce(F.col("remote"), F.lit("")) != "").alias("connections"))
    one = [t.agg(F.count(F.lit(1)).alias(name)) for t, name in ((processes, "processes"), (applications, "programs"), (events, "events"))]
    out = p
    for t in one:
        out = out.join(F.broadcast(t), F.lit(True))
    return out


def open_file_counts(open_files: DataFrame) -> DataFrame:
    """Descriptors of each path and whether any of them is deleted."""
    return open_files.groupBy("host_id", "path").agg(F.count(F.lit(1)).alias("fds"), F.max("deleted").alias("deleted"))


def files_by_directory(open_files: DataFrame, by: Sequence[str] = ("host_id", "pid"), names: int = 4) -> DataFrame:
    """Files of each process by directory: how many, how many deleted, the first names. Of the names only as many as are shown are gathered."""
    each = open_files.groupBy(*by, dirname(F.col("path")).alias("dir"), basename(F.col("path")).alias("_name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("deleted") == "yes").alias("n_deleted"))
    place = F.row_number().over(Window.partitionBy(*by, "dir").orderBy("_name"))
    shown = F.when(F.col("_r") <= names, F.col("_name"))
    return each.withColumn("_r", place).groupBy(*by, "dir").agg(F.sum("n").alias("n"), F.sum("n_deleted").alias("n_deleted"), F.array_join(F.array_sort(F.collect_list(shown)), ", ").alias("names"))


def per_key_counts(tables: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of each table for each key, 0 where a table has none."""
    out = None
    for name, df in tables.items():
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, list(keys), "full_outer")
    return out.fillna(0, list(tables))


def share_of_total(df: DataFrame, value: str, by: Sequence[str], digits: int = 1) -> DataFrame:
    """``share_pct``: the row's part of its group's sum. The sums are aggregated before they are joined, so a large group meets in no task."""
    total = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return df.join(total, list(by)).withColumn("share_pct", F.round(F.lit(100) * F.col(value) / F.nullif(F.col("_total"), F.lit(0)), digits)).drop("_total")
