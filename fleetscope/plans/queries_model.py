"""Queries over state, enrichment, detections, hierarchies, links and chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions.scalars import basename
from fleetscope.operators import detect, enrich, graph, hierarchy, timeline
from fleetscope.plans.registry import query, stamp
from fleetscope.plans.views import V_DEP, V_EV, V_IV, V_STATE, V_TREE, read, v_dep, v_edges, v_ev, v_iv, v_new, v_old, v_strs, v_tree
from fleetscope.sources import events as E
from fleetscope.sources import state as S
from fleetscope.sources.checkpoints import shared_folder

BY = ["host_id"]
TIME = "'%Y-%m-%d %H:%M:%S'"


# State ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {V_STATE} SELECT key, change FROM diff WHERE change IS NOT NULL""")
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.state_diff(v_old(spark, sf_dir), v_new(spark, sf_dir), ["host_id", "key"]).select("key", "change")


@query(f"""WITH {V_STATE}
SELECT key, 'acctbal' AS field, o_acctbal AS old, n_acctbal AS new FROM diff WHERE change = 'changed' AND o_acctbal <> n_acctbal UNION ALL
SELECT key, 'segment', o_segment, n_segment FROM diff WHERE change = 'changed' AND o_segment <> n_segment""")
def state_field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.field_changes(S.state_diff(v_old(spark, sf_dir), v_new(spark, sf_dir), ["host_id", "key"]), ["key"])


@query(f"""WITH {V_STATE} SELECT key, change FROM diff WHERE change IS NOT NULL AND (change <> 'removed' OR src = 'w0')""")
def state_staleness_by_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.state_diff(v_old(spark, sf_dir), v_new(spark, sf_dir), ["host_id", "key"], src="w0").select("key", "change")


@query(f"""WITH {V_STATE}
SELECT CAST(coalesce(n.key, o.key) AS VARCHAR) AS key, coalesce(n.acctbal, o.acctbal) AS acctbal, CASE WHEN n.key IS NOT NULL THEN 'w0' ELSE o.src END AS src
FROM v_old o FULL JOIN v_new n ON o.key = n.key WHERE n.key IS NOT NULL OR o.src <> 'w0'""")
def state_after_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.apply_snapshot(v_old(spark, sf_dir), v_new(spark, sf_dir), ["host_id", "key"], "w0").select("key", "acctbal", F.col("_src").alias("src"))


@query("SELECT event_id, event_type, value FROM events")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    twice = e.select("*", F.lit(1).alias("_seq")).unionByName(e.withColumn("value", F.col("value") + 1).select("*", F.lit(2).alias("_seq")))
    return E.first_wins(twice, ["event_id"], ["_seq"]).select("event_id", "event_type", "value")


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def append_new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("_seq", F.col("event_id"))
    return E.append_dedup(e.where("event_id % 3 = 0"), e.unionByName(e), ["event_id"]).select("event_id", "event_type")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' AND event_id % 3 <> 0 AND NOT (event_id % 5 = 0 AND CAST(ts AS DATE) < DATE '2024-01-20')")
def append_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has the first days and, up to the 20th, some later events; all events come in, each twice, one in three without a key that counts."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    e = v_ev(spark, sf_dir).select("host_id", "event_id", "ts", "event_type")
    E.append_by_day(e.where("ts < '2024-01-10' OR (event_id % 5 = 0 AND ts < '2024-01-20')"), path)
    E.append_by_day(e.where("event_id % 3 = 0"), path)
    rows = E.append_by_day(e.unionByName(e), path)
    return rows.select("event_id", F.col("event_date").cast("string").alias("day"), "event_type")


@query("""SELECT c_nationkey AS bucket, count(*) AS n, NOT bool_or(c_custkey % 400 = 7 OR c_custkey % 500 = 8) AS equal FROM customer GROUP BY 1""")
def set_fingerprint_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nations' customers are the same in a table where one cell is changed here and there, and two rows are exchanged for others."""
    c = read(spark, sf_dir, "customer")
    new = c.withColumn("c_name", F.when(F.col("c_custkey") % 400 == 7, F.lit("other")).otherwise(F.col("c_name"))).withColumn("c_custkey", F.when(F.col("c_custkey") % 500 == 8, -F.col("c_custkey")).otherwise(F.col("c_custkey"))).repartition(7)
    a, b = (S.bucket_hashes(t.withColumnRenamed("c_nationkey", "_bucket")).select("_bucket", "n", F.struct("n", "x", "total").alias(name)) for name, t in (("_a", c), ("_b", new)))
    return a.join(b.drop("n"), "_bucket").select(F.col("_bucket").alias("bucket"), "n", (F.col("_a") == F.col("_b")).alias("equal"))


CHANGES = f"""WITH {V_STATE},
d AS (SELECT area, key, change, o_acctbal, n_acctbal, o_segment, n_segment FROM diff WHERE change IS NOT NULL),
c AS (SELECT area, count(*) AS n, count(*) FILTER (change = 'added') AS a, count(*) FILTER (change = 'removed') AS r, count(*) FILTER (change = 'changed') AS c FROM d GROUP BY 1),
x AS (SELECT area, string_agg(CAST(key AS VARCHAR), '; ' ORDER BY r) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY CASE change WHEN 'added' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END, CAST(key AS VARCHAR)) AS r FROM d) WHERE r <= 8 GROUP BY 1)"""
BULK = "'bulk change ''customer'': ' || a || ' added, ' || r || ' removed, ' || c || ' changed. Examples: ' || examples || ' (summarised — more than {} records)'"


@query(CHANGES + f"""
SELECT area, 'state_' || change AS event_action, 'customer' AS change_table, CAST(key AS VARCHAR) AS change_row, '' AS change_field, '' AS change_old, '' AS change_new, change || ' in «customer»: ' || key AS message, 'state:customer:state_' || change || ':' || key || ':m' AS event_id FROM d JOIN c USING (area) WHERE n <= 150 AND change <> 'changed' UNION ALL
SELECT area, 'state_changed', 'customer', CAST(key AS VARCHAR), 'acctbal', o_acctbal, n_acctbal, 'customer / ' || key || ' - acctbal: ' || o_acctbal || ' -> ' || n_acctbal, 'state:customer:state_changed:' || key || ':acctbal' FROM d JOIN c USING (area) WHERE n <= 150 AND change = 'changed' AND o_acctbal <> n_acctbal UNION ALL
SELECT area, 'state_changed', 'customer', CAST(key AS VARCHAR), 'segment', o_segment, n_segment, 'customer / ' || key || ' - segment: ' || o_segment || ' -> ' || n_segment, 'state:customer:state_changed:' || key || ':segment' FROM d JOIN c USING (area) WHERE n <= 150 AND change = 'changed' AND o_segment <> n_segment UNION ALL
SELECT area, 'state_bulk_change', 'customer', '', '', '', '', {BULK.format(150)}, 'state:customer:state_bulk_change:customer:m' FROM c JOIN x USING (area) WHERE n > 150""")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = S.state_diff(v_old(spark, sf_dir), v_new(spark, sf_dir), ["host_id", "key"])
    areas = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("area"))
    found = S.change_events(diff.join(areas, "key"), ["key"], "customer", by=["area"], minute=F.lit("m"))
    return found.select("area", "event_action", "change_table", "change_row", "change_field", "change_old", "change_new", "message", "event_id")


@query(CHANGES.replace("SELECT area, key, change", "SELECT src AS area, key, change") + f"""
SELECT area AS writer, 'state_bulk_change' AS event_action, {BULK.format(20)} AS message FROM c JOIN x USING (area) WHERE n > 20""")
def bulk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = S.state_diff(v_old(spark, sf_dir), v_new(spark, sf_dir), ["host_id", "key"])
    writers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("w"), (F.col("c_nationkey") % 2).cast("string")).alias("writer"))
    found = S.change_events(diff.join(writers, "key"), ["key"], "customer", by=["writer"], minute=F.lit("m"), cap=20)
    return found.where("event_action = 'state_bulk_change'").select("writer", "event_action", "message")


@query(f"""WITH {V_STATE},
n AS (SELECT * REPLACE (CASE WHEN key % 400 = 7 THEN 'other' ELSE segment END AS segment) FROM v_old WHERE key % 500 <> 8 UNION ALL SELECT key + 10000000, c_name, acctbal, segment, area, src FROM v_old WHERE key % 300 = 1)
SELECT coalesce(n.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM v_old o FULL JOIN n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.segment <> n.segment""")
def state_diff_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, folder = v_old(spark, sf_dir), f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    new = old.where("key % 500 <> 8").withColumn("segment", F.when(F.col("key") % 400 == 7, "other").otherwise(F.col("segment"))).unionByName(old.where("key % 300 = 1").withColumn("key", F.col("key") + 10_000_000))
    for name, df in (("old", old), ("new", new)):
        S.write_version(df, f"{folder}/{name}", ["host_id", "key"], 64)
    return S.versions_diff(spark, f"{folder}/old", f"{folder}/new", ["host_id", "key"]).select("key", "change")


@query("""WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events),
r AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev, lead(day) OVER (ORDER BY day) AS next FROM (SELECT DISTINCT day FROM s))
SELECT CAST(s.day AS VARCHAR) AS day, s.user_id, 'appeared' AS action FROM s JOIN r ON r.day = s.day WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.day = r.prev AND o.user_id = s.user_id) UNION ALL
SELECT CAST(r.next AS VARCHAR), s.user_id, 'vanished' FROM s JOIN r ON r.day = s.day WHERE next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.day = r.next AND o.user_id = s.user_id)""")
def snapshot_sequence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = read(spark, sf_dir, "events").select(F.lit("h0").alias("host_id"), F.to_date("ts").alias("day"), "user_id")
    return S.snapshot_sequence_events(snaps, ["user_id"], "day").select(F.col("day").cast("string").alias("day"), "user_id", "action")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 3000")
def retention_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.retain_newest(read(spark, sf_dir, "events"), 3000, "event_id").select("event_id")


# Enrichment ----------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE coalesce(c_name, '') END AS owner, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE coalesce(c_mktsegment, '') END AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def lookup_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "nobody").otherwise(F.concat(F.lit("x ("), F.col("o_custkey").cast("string"), F.lit(")"))).alias("process"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(2).alias("seq"))
    older = customer.where("c_custkey % 2 = 0").select("c_custkey", F.lit("zz older").alias("c_name"), F.lit("A").alias("c_mktsegment"), F.lit(1).alias("seq"))
    found = enrich.lookup(o, customer.unionByName(older), "process", "c_custkey", {"owner": "c_name", "segment": "c_mktsegment"}, order="seq", extract=r"\((\d+)\)")
    return found.select("o_orderkey", "owner", "segment")


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_partkey % 3 = 0 THEN p_name END, CASE WHEN l_suppkey % 2 = 0 THEN s_name END, o_orderpriority, '') AS package
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey""")
def attach_first_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = read(spark, sf_dir, "lineitem").select(*keys)
    tables = [
        (F.col("l_partkey"), read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))),
        (F.col("l_suppkey"), read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))),
        (F.col("l_orderkey"), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))),
    ]
    return enrich.attach_first_hit(rows, keys, tables, "package").select("l_orderkey", "l_linenumber", "package")


@query("""WITH one AS (SELECT s_nationkey AS k, min(s_suppkey) AS found FROM supplier WHERE s_suppkey % 7 = 0 GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1)
SELECT c_custkey, found AS s_suppkey FROM customer LEFT JOIN one ON k = c_nationkey""")
def unique_candidate_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = enrich.unique_candidate(read(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").withColumnRenamed("s_nationkey", "c_nationkey"), ["c_nationkey"], "s_suppkey")
    return read(spark, sf_dir, "customer").join(one, "c_nationkey", "left").select("c_custkey", F.col("found").alias("s_suppkey"))


@query(f"""WITH {V_EV},
exact AS (SELECT subject_name, destination_ip, max_by(process_name, (ts, event_id)) AS f FROM v_ev WHERE process_name <> '' GROUP BY 1, 2),
dest AS (SELECT destination_ip, max_by(process_name, (ts, event_id)) AS f FROM v_ev WHERE process_name <> '' GROUP BY 1),
usr AS (SELECT subject_name, max_by(process_name, (ts, event_id)) AS f FROM v_ev WHERE process_name <> '' GROUP BY 1)
SELECT event_id, coalesce(nullif(process_name, ''), e.f, d.f, u.f, '') AS process_name,
  CASE WHEN process_name <> '' THEN 'socket was live' WHEN e.f IS NOT NULL THEN 'exact socket match' WHEN d.f IS NOT NULL THEN 'by destination address (probable)' WHEN u.f IS NOT NULL THEN 'live socket (probable)' ELSE 'owner unknown' END AS process_source
FROM v_ev v LEFT JOIN exact e ON e.subject_name = v.subject_name AND e.destination_ip = v.destination_ip LEFT JOIN dest d ON d.destination_ip = v.destination_ip LEFT JOIN usr u ON u.subject_name = v.subject_name""")
def owner_recovery_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir)
    order = [F.col("ts"), F.col("event_id")]
    lookups = [
        (enrich.latest_value(e, ["subject_name", "destination_ip"], "process_name", order), ["subject_name", "destination_ip"], "exact socket match"),
        (enrich.latest_value(e, ["destination_ip"], "process_name", order), ["destination_ip"], "by destination address (probable)"),
        (enrich.latest_value(e, ["subject_name"], "process_name", order), ["subject_name"], "live socket (probable)"),
    ]
    found = enrich.recover_cascade(e, ["event_id"], "process_name", lookups, "socket was live", "owner unknown")
    return found.select("event_id", "process_name", "process_source")


@query(f"""WITH {V_EV}, {V_IV},
h AS (SELECT event_id, start_ts, row_number() OVER (PARTITION BY event_id ORDER BY start_ts DESC) AS r FROM v_ev JOIN v_iv ON v_iv.user_id = v_ev.user_id AND start_ts <= ts AND (end_ts IS NULL OR ts < end_ts))
SELECT v_ev.event_id, strftime(start_ts, {TIME}) AS session_started FROM v_ev LEFT JOIN h ON h.event_id = v_ev.event_id AND r = 1""")
def interval_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrich.interval_asof(v_ev(spark, sf_dir), v_iv(spark, sf_dir), ["event_id"], by=["user_id"])
    return found.select("event_id", stamp("interval_start").alias("session_started"))


@query(f"""WITH {V_EV}, t AS (SELECT p_partkey AS pid, p_partkey // 8 AS ppid, p_name AS name FROM part)
SELECT event_id, coalesce(t.name, '') AS process_command_line, CAST(t.ppid AS BIGINT) AS up, coalesce(p.name, '') AS parent_command_line FROM v_ev LEFT JOIN t ON t.pid = process_pid LEFT JOIN t p ON p.pid = t.ppid""")
def fill_blank_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = v_tree(spark, sf_dir).select("host_id", "pid", "ppid", F.lit("").alias("exe"), F.col("name").alias("command"))
    found = enrich.event_context(v_ev(spark, sf_dir).drop("parent_pid"), tree)
    return found.select("event_id", "process_command_line", F.col("parent_pid").alias("up"), "parent_command_line")


@query(f"""WITH {V_DEP},
o AS (SELECT child AS pid, count(*) AS n FROM v_dep GROUP BY 1), i AS (SELECT parent AS pid, count(*) AS n FROM v_dep GROUP BY 1),
r AS (SELECT parent AS pid, child, row_number() OVER (PARTITION BY parent ORDER BY child) AS r FROM v_dep),
names AS (SELECT pid, string_agg(child, ', ' ORDER BY child) AS s FROM r WHERE r <= 12 GROUP BY 1)
SELECT p_partkey AS pid, coalesce(o.n, 0) AS deps_count, coalesce(i.n, 0) AS required_by, coalesce(s, '') AS required_by_names FROM part LEFT JOIN o ON o.pid = p_partkey LEFT JOIN i ON i.pid = p_partkey LEFT JOIN names ON names.pid = p_partkey""")
def dependency_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "part").select(F.lit("h0").alias("host_id"), F.col("p_partkey").alias("pid"))
    return enrich.dependency_fan(nodes, v_dep(spark, sf_dir), "pid").drop("host_id")


TOKENS = ("ing", "der", "que", "les")


@query("""WITH t AS (SELECT doc_id, string_split_regex(lower(text), '[\\s=@/:,]+') AS w FROM documents),
k AS (SELECT unnest(['ing', 'der', 'que', 'les']) AS token, unnest([443, 80, 53, 22]) AS port)
SELECT token, min(doc_id) AS owner_pid, 'command line' AS how FROM k JOIN t ON list_contains(w, token) GROUP BY token""")
def token_owner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read(spark, sf_dir, "documents").select(F.lit("h0").alias("host_id"), F.col("doc_id").alias("pid"), F.lower("text").alias("command"))
    some = read(spark, sf_dir, "region").where("r_regionkey < 4").select(F.lit("h0").alias("host_id"), F.element_at(F.array(*map(F.lit, TOKENS)), F.col("r_regionkey") + 1).alias("token"), F.lit("no port").alias("port"))
    return enrich.token_owner(some, tokens, "token", "port", ["token"])


@query("""SELECT p_partkey, CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45) THEN 'yes' ELSE '' END AS unpackaged FROM part""")
def unpackaged_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("/usr/bin/p"), F.col(c).cast("string"))
    parts = read(spark, sf_dir, "part").select(F.lit("h0").alias("host_id"), "p_partkey", path("p_partkey").alias("path"))
    files = read(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.lit("h0").alias("host_id"), F.regexp_replace(path("l_partkey"), "^/usr/bin", "/bin").alias("path"), F.col("l_orderkey").cast("string").alias("package"))
    return enrich.unpackaged(enrich.file_owner(parts, files)).select("p_partkey", "unpackaged")


@query("""SELECT page_id, split_part(split_part(url, '://', 2), '/', 2) AS service FROM pages WHERE split_part(split_part(url, '://', 2), '/', 2) IN (SELECT DISTINCT lang FROM documents)""")
def like_join_to_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_extract("url", r"://[^/]*/([^/]*)/?(.*)$", 1)
    configs = read(spark, sf_dir, "pages").select(F.lit("h0").alias("host_id"), "page_id", F.concat(F.lit("/etc/"), rest, F.lit("/conf")).alias("path"), F.lit("yes").alias("user_owned"))
    procs = read(spark, sf_dir, "documents").select(F.lit("h0").alias("host_id"), F.lit("root").alias("user"), F.concat(F.lit("/usr/bin/"), "lang", F.lit(" -x")).alias("command"))
    return enrich.config_owner_services(configs, procs).select("page_id", "service")


@query("""WITH w AS (SELECT DISTINCT p_type || p_partkey AS wanted FROM part), n AS (SELECT DISTINCT p_type || (p_partkey // 7) AS match FROM part),
    h AS (SELECT wanted, match, abs(length(wanted) - length(match)) AS gap FROM w JOIN n ON (starts_with(wanted, match) OR starts_with(match, wanted)) AND abs(length(wanted) - length(match)) <= 4)
    SELECT wanted, match FROM (SELECT wanted, match, row_number() OVER (PARTITION BY wanted ORDER BY gap, match) AS r FROM h) WHERE r = 1""")
def nearest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    wanted = p.select(F.concat("p_type", F.col("p_partkey").cast("string")).alias("wanted"))
    names = p.select(F.concat("p_type", F.expr("p_partkey div 7").cast("string")).alias("name"))
    return enrich.nearest_name(wanted, names, "wanted", "name")


@query(f"""WITH {V_EV} SELECT event_id, CASE WHEN destination_ip LIKE '10.%' THEN 'local-only' WHEN destination_port BETWEEN 50 AND 60 OR destination_port BETWEEN 400 AND 450 THEN 'OPEN (exposed)' ELSE 'filtered (firewall)' END AS exposure FROM v_ev""")
def range_join_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir).select("host_id", "event_id", "destination_port", "destination_ip")
    bounds = {0: (50, 60), 1: (400, 450)}
    ranges = read(spark, sf_dir, "region").where("r_regionkey < 2").select(F.lit("h0").alias("host_id"), *(F.when(F.col("r_regionkey") == 0, bounds[0][k]).otherwise(bounds[1][k]).alias(c) for k, c in enumerate(("lo", "hi"))))
    return enrich.range_exposure(e, ranges, "destination_port", ~F.col("destination_ip").startswith("10.")).select("event_id", "exposure")


# Detections and findings -----------------------------------------------------------------------------------------------


BRUTE = detect.Rule("auth_bruteforce", "event_category = 'authentication' AND event_outcome = 'failure'", ("subject_name",), 2, 86_400, "high", "{count} failed authentications in a row for {subject_name}", "A series of failed authentications", "authentication")
ALERT = ["event_id", "event_severity", "object_name", "message", "count", "first_ts", "last_ts"]


def _told(alerts: DataFrame) -> DataFrame:
    return alerts.select(*ALERT).withColumn("first_ts", stamp("first_ts")).withColumn("last_ts", stamp("last_ts"))


@query(f"""WITH {V_EV}
SELECT 'alert:auth_bruteforce:' || subject_name || ':' || CAST(floor(epoch(ts) / 86400) AS BIGINT) AS event_id, CAST(75 AS BIGINT) AS event_severity, subject_name AS object_name, count(*) || ' failed authentications in a row for ' || subject_name AS message,
  count(*) AS count, strftime(min(ts), {TIME}) AS first_ts, strftime(max(ts), {TIME}) AS last_ts
FROM v_ev WHERE event_category = 'authentication' AND event_outcome = 'failure' GROUP BY subject_name, floor(epoch(ts) / 86400) HAVING count(*) >= 2""")
def detect_bruteforce_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(detect.detect_tumbling(v_ev(spark, sf_dir), BRUTE))


def _asof(spark: SparkSession, sf_dir: str, rule: detect.Rule) -> DataFrame:
    e = v_ev(spark, sf_dir)
    as_of = e.agg(F.max("ts").alias("m")).first()["m"]
    return _told(detect.detect_asof(e, rule, F.lit(as_of)))


def _asof_sql(name: str, severity: int, where: str, group: str, threshold: int, message: str) -> str:
    gid = group.replace(", ", " || '|' || ") or "'-'"
    return f"""WITH {V_EV}, m AS (SELECT max(ts) AS m FROM events)
SELECT 'alert:{name}:' || {gid} || ':' || any_value(CAST(floor(epoch(m) / 604800) AS BIGINT)) AS event_id, CAST({severity} AS BIGINT) AS event_severity, {gid} AS object_name, {message} AS message, count(*) AS count, strftime(min(ts), {TIME}) AS first_ts, strftime(max(ts), {TIME}) AS last_ts
FROM v_ev, m WHERE {where} AND ts >= m - INTERVAL 7 DAY {'GROUP BY ' + group if group else ''} HAVING count(*) >= {threshold}"""


@query(_asof_sql("auth_bruteforce", 75, "event_category = 'authentication' AND event_outcome = 'failure'", "subject_name", 5, "count(*) || ' failed authentications in a row for ' || subject_name"))
def detect_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, detect.Rule("auth_bruteforce", BRUTE.where, BRUTE.group_by, 5, 604_800, "high", BRUTE.message))


@query(_asof_sql("file_perm_burst", 55, "event_category = 'file'", "", 3, "count(*) || ' at once'"))
def detect_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, detect.Rule("file_perm_burst", "event_category = 'file'", (), 3, 604_800, "medium", "{count} at once"))


@query(_asof_sql("external_beacon", 55, "event_category = 'network' AND NOT destination_ip LIKE '10.%'", "destination_ip", 2, "count(*) || ' to ' || destination_ip"))
def detect_beacon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, detect.Rule("external_beacon", "event_category = 'network' AND destination_ip NOT LIKE '10.%'", ("destination_ip",), 2, 604_800, "medium", "{count} to {destination_ip}"))


@query(_asof_sql("exec_from_temp", 75, "process_name ILIKE 'p1%'", "subject_name, process_name", 1, "'Started: ' || any_value(process_name) || ' (user ' || any_value(subject_name) || ')'"))
def detect_exec_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, detect.Rule("exec_from_temp", "process_name ILIKE 'p1%'", ("subject_name", "process_name"), 1, 604_800, "high", "Started: {process_name} (user {subject_name})"))


FINDINGS = (
    detect.Finding("urgent_open", "Open urgent orders", "high", "orders", "o_orderstatus = 'O' AND o_orderpriority LIKE '1%'", "order {o_orderkey} of {o_custkey} {nowhere}", number="-o_orderkey", time="o_orderdate"),
    detect.Finding("in_debt", "Customers in debt", "medium", "customer", "c_acctbal < 0", "{c_name}", number="-c_custkey"),
    detect.Finding("large_parts", "Large parts", "low", "part", "p_size > 40", "part {p_partkey}: {p_size}", number="-p_partkey"),
    detect.Finding("nothing", "Nothing", "high", "supplier", "s_suppkey < 0", "{s_suppkey}"),
    detect.Finding("bad_column", "A column that isn't there", "low", "part", "no_such_column > 1", "{p_partkey}"),
    detect.Finding("bad_table", "A table that isn't there", "medium", "no_such_table", "TRUE", ""),
    detect.Finding("bad_sql", "No SQL", "low", "part", "p_size >", ""),
)


def _finding_sql(name: str, title: str, severity: str, table: str, where: str, key: str, line: str, latest: str = "''") -> str:
    return f"""SELECT '{name}' AS finding, '{title}' AS title, '{severity}' AS severity, count(*) AS n, {latest} AS "when", (SELECT string_agg(l, '; ' ORDER BY k) FROM (SELECT {line} AS l, {key} AS k FROM {table} WHERE {where} ORDER BY {key} LIMIT 12)) AS evidence, '' AS error FROM {table} WHERE {where} HAVING count(*) > 0"""


FINDINGS_SQL = " UNION ALL ".join([
    _finding_sql("urgent_open", "Open urgent orders", "high", "orders", "o_orderstatus = 'O' AND o_orderpriority LIKE '1%'", "o_orderkey", "'order ' || o_orderkey || ' of ' || o_custkey || ' {nowhere}'", f"strftime(max(o_orderdate), {TIME})"),
    _finding_sql("in_debt", "Customers in debt", "medium", "customer", "c_acctbal < 0", "c_custkey", "c_name"),
    _finding_sql("large_parts", "Large parts", "low", "part", "p_size > 40", "p_partkey", "'part ' || p_partkey || ': ' || p_size"),
    "SELECT 'bad_column', 'A column that isn''t there', 'low', 0, '', '', 'UNRESOLVED_COLUMN'", "SELECT 'bad_table', 'A table that isn''t there', 'medium', 0, '', '', 'TABLE_OR_VIEW_NOT_FOUND'", "SELECT 'bad_sql', 'No SQL', 'low', 0, '', '', 'PARSE_SYNTAX_ERROR'",
])


@query(FINDINGS_SQL)
def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.run_findings(spark, FINDINGS, {t: read(spark, sf_dir, t) for t in ("orders", "customer", "part", "supplier")})


@query(f"WITH f AS ({FINDINGS_SQL}) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (error = '' AND severity = 'high') AS high, count(*) FILTER (error = '' AND severity = 'medium') AS medium, count(*) FILTER (error = '' AND severity = 'low') AS low, CAST(7 AS BIGINT) AS rules, count(*) FILTER (error <> '') AS errors FROM f")
def findings_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.findings_total(findings_report(spark, sf_dir), len(FINDINGS))


# Hierarchies -----------------------------------------------------------------------------------------------------------


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.ancestors(v_edges(spark, sf_dir), 12)


TREE = f"WITH RECURSIVE {V_TREE}"


@query(TREE + """, c AS (SELECT id, string_agg(name, ' ← ' ORDER BY depth) FILTER (depth <= 6) AS s, max(depth) AS d FROM closure JOIN v_tree ON pid = ancestor GROUP BY 1)
SELECT pid AS id, coalesce(s, '') AS launched_by, CAST(coalesce(d, 0) AS BIGINT) AS depth FROM v_tree LEFT JOIN c ON c.id = pid""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = v_tree(spark, sf_dir).select("host_id", F.col("pid").alias("id"), "name")
    found = hierarchy.ancestry_chain(tree.select("host_id", "id"), _closure(spark, sf_dir), tree)
    return found.select("id", "launched_by", F.col("depth").cast("long").alias("depth"))


@query(TREE + """, f AS (SELECT ppid AS p, pid AS c FROM (SELECT *, row_number() OVER (PARTITION BY ppid ORDER BY pid) AS r FROM v_tree WHERE pid <> ppid AND ppid IN (SELECT pid FROM v_tree)) WHERE r <= 5)
SELECT p AS id, c AS descendant, CAST(1 AS BIGINT) AS depth FROM f UNION ALL SELECT a.p, b.c, 2 FROM f a JOIN f b ON b.p = a.c""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.descendants(v_edges(spark, sf_dir), 2, 5)
    return found.select("id", "descendant", F.col("depth").cast("long").alias("depth"))


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS pid, p_partkey // 8 AS ppid, lpad(CAST(CAST(round((3000 - p_retailprice) * 100) AS BIGINT) AS VARCHAR), 9, '0') || ' ' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS k FROM part),
w AS (SELECT pid, k AS path, 0 AS depth FROM t WHERE ppid = pid OR ppid NOT IN (SELECT pid FROM t) UNION ALL SELECT t.pid, w.path || '/' || t.k, w.depth + 1 FROM w JOIN t ON t.ppid = w.pid WHERE t.pid <> t.ppid)
SELECT pid, CAST(depth AS BIGINT) AS depth, path FROM w""")
def forest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.lit("h0").alias("host_id"), F.col("p_partkey").alias("pid"), F.floor(F.col("p_partkey") / 8).cast("long").alias("ppid"), "p_retailprice")
    sort = F.lpad(F.round((F.lit(3000) - F.col("p_retailprice")) * 100).cast("long").cast("string"), 9, "0")
    found = hierarchy.forest(part, sort)
    return found.select("pid", F.col("depth").cast("long").alias("depth"), "path")


@query(TREE + """, up AS (SELECT id, ancestor FROM closure UNION ALL SELECT pid, pid FROM v_tree)
SELECT ancestor AS id, count(*) AS n, CAST(sum(rss) AS DOUBLE) AS rss FROM up JOIN v_tree ON pid = id GROUP BY 1""")
def subtree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = v_tree(spark, sf_dir).select("host_id", F.col("pid").alias("id"), "rss")
    return hierarchy.subtree_sum(metrics, v_edges(spark, sf_dir), ["rss"]).select("id", "n", F.col("rss").cast("double").alias("rss"))


@query(TREE + """, top AS (SELECT pid FROM v_tree ORDER BY rss DESC, pid LIMIT 18),
kept AS (SELECT pid AS id, 1 AS top FROM top UNION ALL SELECT ancestor, 0 FROM top JOIN closure ON id = pid),
d AS (SELECT id, max(depth) AS depth FROM closure GROUP BY 1)
SELECT kept.id, CAST(max(top) AS BIGINT) AS top, CAST(coalesce(any_value(depth), 0) AS BIGINT) AS depth FROM kept LEFT JOIN d ON d.id = kept.id GROUP BY 1""")
def top_with_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = v_tree(spark, sf_dir).select("host_id", F.col("pid").alias("id"), "rss")
    found = hierarchy.top_with_ancestors(nodes, _closure(spark, sf_dir), "rss")
    return found.select("id", F.col("top").cast("long").alias("top"), F.col("depth").cast("long").alias("depth"))


@query(TREE + """, g AS (SELECT id, min_by(pkg, depth) AS pkg, min(depth) AS d FROM closure JOIN v_tree ON pid = ancestor WHERE pkg <> '' GROUP BY 1)
SELECT pid AS id, CASE WHEN v_tree.pkg <> '' THEN v_tree.pkg ELSE coalesce(g.pkg, '') END AS pkg, CAST(CASE WHEN v_tree.pkg <> '' THEN 0 ELSE d END AS BIGINT) AS from_depth FROM v_tree LEFT JOIN g ON g.id = pid""")
def nearest_packaged_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = v_tree(spark, sf_dir).select("host_id", F.col("pid").alias("id"), "pkg")
    found = hierarchy.nearest_ancestor(nodes, v_edges(spark, sf_dir), F.col("pkg") != "", "pkg")
    return found.select("id", "pkg", F.col("from_depth").cast("long").alias("from_depth"))


@query(f"""WITH RECURSIVE {V_DEP},
walk AS (SELECT p_partkey AS id, p_partkey AS owner, 0 AS dist FROM part WHERE p_partkey % 50 = 0
  UNION SELECT parent, owner, dist + 1 FROM walk JOIN v_dep ON child = id WHERE dist < 12)
SELECT id, min_by(owner, (dist, owner)) AS owner, CAST(min(dist) AS BIGINT) AS dist FROM walk GROUP BY 1""")
def program_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = read(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.lit("h0").alias("host_id"), F.col("p_partkey").alias("id"))
    found = hierarchy.nearest_owner(v_dep(spark, sf_dir), programs, 12)
    return found.select("id", "owner", F.col("dist").cast("long").alias("dist"))


@query("""WITH t AS (SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_size % 5 = 0 THEN 'vendor' WHEN p_size % 3 = 0 THEN 'product' WHEN p_size % 2 = 0 THEN 'package' ELSE 'exe' END AS tier, CASE WHEN p_size % 5 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 2 = 0 THEN p_brand || '/' || p_type ELSE p_name END AS entity FROM part)
SELECT tier, entity, count(*) AS n, round(CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS rss, max(p_size) AS worst FROM t GROUP BY 1, 2""")
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetscope.operators.entities import identity

    s = F.col("p_size") % 5 == 0, F.col("p_size") % 3 == 0, F.col("p_size") % 2 == 0
    tiers = [("vendor", F.when(s[0], F.col("p_brand"))), ("product", F.when(s[1], F.col("p_type"))), ("package", F.when(s[2], F.concat_ws("/", "p_brand", "p_type"))), ("exe", F.col("p_name"))]
    tier, entity = identity(tiers)
    rows = read(spark, sf_dir, "part").withColumn("tier", tier).withColumn("entity", entity)
    return rows.groupBy("tier", "entity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double"), 2).alias("rss"), F.max("p_size").alias("worst"))


# Links, neighbourhoods, stories ------------------------------------------------------------------------------------------


STRS = """v AS (
  SELECT 'customer' AS t, 'cust_ref' AS c, 'cust-' || c_custkey AS v FROM customer UNION SELECT 'customer', 'nation_name', lower(n_name) FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT 'customer', 'c_name', lower(c_name) FROM customer UNION SELECT 'customer', 'c_mktsegment', lower(c_mktsegment) FROM customer UNION
  SELECT 'supplier', 'nation_name', lower(n_name) FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'supplier', 's_name', lower(s_name) FROM supplier UNION
  SELECT 'nation', 'n_name', lower(n_name) FROM nation UNION SELECT 'region', 'r_name', lower(r_name) FROM region UNION
  SELECT 'orders', 'order_ref', 'cust-' || o_custkey FROM orders UNION SELECT 'orders', 'o_orderpriority', lower(o_orderpriority) FROM orders),
n AS (SELECT t, c, count(*) AS n FROM v GROUP BY 1, 2),
p AS (SELECT a.t AS from_table, a.c AS from_col, b.t AS to_table, b.c AS to_col, count(*) AS shared FROM v a JOIN v b ON a.v = b.v AND a.t < b.t GROUP BY 1, 2, 3, 4),
links AS (SELECT from_table, from_col, to_table, to_col, shared, round(shared / least(x.n, y.n), 4) AS ratio FROM p JOIN n x ON x.t = from_table AND x.c = from_col JOIN n y ON y.t = to_table AND y.c = to_col WHERE shared >= 3 AND shared / least(x.n, y.n) >= 0.5)"""


@query(f"WITH {STRS} SELECT * FROM links")
def link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.discover_links(v_strs(spark, sf_dir))


@query(f"""WITH {STRS} SELECT t AS "table", count(*) AS degree FROM (SELECT from_table AS t FROM links UNION ALL SELECT to_table FROM links) GROUP BY 1""")
def link_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.link_degree(graph.discover_links(v_strs(spark, sf_dir)))


@query("""WITH e AS (SELECT n_name AS anchor, 'customer' AS category, c_name AS node FROM nation JOIN customer ON c_nationkey = n_nationkey UNION SELECT n_name, 'supplier', s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor, category ORDER BY node) AS r FROM e)
SELECT anchor, category, node FROM r WHERE r <= 400""")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = read(spark, sf_dir, "nation").select(F.col("n_name").alias("anchor"), F.col("n_name").alias("value"))
    t = v_strs(spark, sf_dir)
    _, edges = graph.neighbourhood(anchors, {"customer": (t["customer"], "nation_name", "c_name"), "supplier": (t["supplier"], "nation_name", "s_name")})
    return edges


@query(f"""WITH {V_EV},
b AS (SELECT process_pid AS pid, 'own' AS role, event_id, ts FROM v_ev UNION ALL SELECT parent_pid, 'child', event_id, ts FROM v_ev WHERE parent_pid <> process_pid),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts DESC, event_id DESC) AS r FROM b)
SELECT pid, role, event_id FROM r WHERE r <= 500""")
def activity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.activity_history(v_ev(spark, sf_dir)).select("pid", "role", "event_id")


ACTIVITY = f"""{V_EV}, a AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'process_started' ELSE event_type END AS act, CASE WHEN event_type = 'view' THEN '/f/' || k ELSE '' END AS path, CASE WHEN k % 3 = 0 THEN 'org' || (k % 5) ELSE '' END AS org FROM v_ev),
b AS (SELECT *, process_pid AS pid, 'own' AS role FROM a UNION ALL SELECT *, parent_pid, 'child' FROM a WHERE parent_pid <> process_pid),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts DESC, event_id DESC) AS r FROM b) WHERE r <= 500),
t AS (SELECT *, CASE WHEN act = 'process_started' THEN CASE role WHEN 'own' THEN 'started' ELSE 'launched' END WHEN event_category = 'authentication' THEN 'auth' ELSE event_category END AS kind,
  CASE WHEN act = 'process_started' THEN process_name WHEN event_category = 'network' THEN destination_ip || ':' || destination_port || CASE WHEN org <> '' THEN '  (' || org || ')' ELSE '' END WHEN event_category = 'file' THEN path ELSE 'm' || k END AS target FROM h)"""


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    e = v_ev(spark, sf_dir).withColumn("event_action", F.when(F.col("event_type") == "signup", "process_started").otherwise(F.col("event_type"))).withColumn("file_path", F.when(F.col("event_type") == "view", F.concat(F.lit("/f/"), k)).otherwise(""))
    e = e.withColumn("destination_as_org", F.when(F.col("k") % 3 == 0, F.concat(F.lit("org"), (F.col("k") % 5).cast("string"))).otherwise("")).withColumn("message", F.when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit("m"), k)))
    return timeline.activity_history(e)


@query(f"WITH {ACTIVITY} SELECT pid, event_id, role, kind, target, CASE WHEN kind = 'launched' THEN CAST(process_pid AS VARCHAR) ELSE '' END AS child_pid FROM t")
def activity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.activity_told(_activity(spark, sf_dir)).select("pid", "event_id", "role", "kind", "target", "child_pid")


@query(f"""WITH {ACTIVITY}, l AS (SELECT *, trim(CASE kind WHEN 'network' THEN '→' WHEN 'file' THEN 'changed' ELSE kind END || ' ' || target) || CASE WHEN kind = 'launched' THEN '  [pid ' || process_pid || ']' ELSE '' END AS line FROM t)
SELECT pid, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, strftime(min(ts), {TIME}) AS first_ts, strftime(max(ts), {TIME}) AS last_ts, string_agg(strftime(ts, '%H:%M:%S') || ' ' || line, chr(10) ORDER BY ts, event_id) AS lines FROM l GROUP BY 1, 2""")
def activity_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.by_day(_activity(spark, sf_dir))
    lines = F.array_join(F.transform("lines", lambda x: F.concat_ws(" ", x["at"], x["told"])), "\n")
    return found.select("pid", F.col("day").cast("string").alias("day"), "n", stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts"), lines.alias("lines"))


def _chain_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    item = F.concat(F.lit("item-"), F.col("k").cast("string"))
    e = v_ev(spark, sf_dir).withColumn("process_pid", F.when(F.col("process_name") != "", F.col("process_pid"))).withColumn("event_action", F.col("event_type")).withColumn("event_module", F.lit("m"))
    e = e.withColumn("object_name", F.when(F.col("event_type") == "view", item).otherwise("")).withColumn("process_command_line", F.when(F.col("event_type") == "signup", F.concat(F.lit("/usr/bin/start '"), item, F.lit("' --now"))).otherwise(""))
    names = v_tree(spark, sf_dir).select("host_id", F.col("pid").alias("id"), F.when(F.col("pid") % 10 == 0, "/bin/bash").otherwise("app").alias("name"))
    return e, timeline.chain_roots(v_edges(spark, sf_dir), names), names


ROOTS = """t AS (SELECT p_partkey AS pid, p_partkey // 8 AS ppid FROM part WHERE p_partkey // 8 IN (SELECT p_partkey FROM part) AND p_partkey // 8 <> p_partkey),
w AS (SELECT pid AS id, pid AS root, 0 AS n FROM t UNION ALL
  SELECT w.id, t.ppid, n + 1 FROM w JOIN t ON t.pid = w.root WHERE t.ppid % 10 <> 0 AND t.ppid IN (SELECT pid FROM t)),
roots AS (SELECT id, max_by(root, n) AS root FROM w GROUP BY 1)"""
#: Which event an event follows: that with its socket, its object, the first command that names the object, or its user.
CHAINS = f"""{V_EV}, {ROOTS},
e AS (SELECT *, CASE WHEN process_name <> '' THEN process_pid END AS pid, destination_ip || ':' || destination_port AS sock, CASE WHEN event_type = 'view' THEN 'item-' || k END AS obj, CASE WHEN event_type = 'signup' THEN 'item-' || k END AS word FROM v_ev),
said AS (SELECT word, min((ts, event_id)) AS at FROM e WHERE word IS NOT NULL GROUP BY 1),
o AS (SELECT e.*, coalesce(root, pid) AS root, lag(event_id) OVER (PARTITION BY sock ORDER BY ts, event_id) AS by_socket, CASE WHEN obj IS NOT NULL THEN lag(event_id) OVER (PARTITION BY obj ORDER BY ts, event_id) END AS by_object,
    CASE WHEN said.at < (ts, event_id) THEN said.at[2] END AS by_word, lag(event_id) OVER (PARTITION BY subject_name ORDER BY ts, event_id) AS by_user
  FROM e LEFT JOIN roots ON id = pid LEFT JOIN said ON said.word = obj),
nx AS (SELECT *, CASE WHEN root IS NULL THEN coalesce(by_socket, by_object, by_word, by_user) END AS nxt,
    CASE WHEN root IS NOT NULL THEN 'ancestry' WHEN by_socket IS NOT NULL THEN 'socket' WHEN coalesce(by_object, by_word) IS NOT NULL THEN 'object' ELSE 'time' END AS how FROM o),
climb AS (SELECT event_id, event_id AS cur FROM nx UNION ALL SELECT climb.event_id, nx.nxt FROM climb JOIN nx ON nx.event_id = climb.cur WHERE nx.nxt IS NOT NULL),
chains AS (SELECT climb.event_id, CASE WHEN nx.root IS NOT NULL THEN 'proc:' || nx.root ELSE 'user:' || nx.subject_name END AS chain_id FROM climb JOIN nx ON nx.event_id = climb.cur WHERE nx.nxt IS NULL)"""


@query(f"WITH RECURSIVE {ROOTS} SELECT id, root FROM roots")
def chain_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain_inputs(spark, sf_dir)[1].select("id", "root")


@query("""WITH RECURSIVE t AS (SELECT event_id AS id, CASE WHEN event_id % 4000 = 1 AND event_id < 8000 THEN event_id + 40 ELSE event_id - 1 END AS up FROM events WHERE event_id % 4000 <> 0),
s AS (SELECT id, up FROM t WHERE up % 1999 <> 0 AND up IN (SELECT id FROM t)),
ring AS (SELECT id AS start, id, up, 1 AS n FROM s WHERE id % 4000 = 1 AND id < 8000 UNION ALL SELECT start, s.id, s.up, n + 1 FROM ring JOIN s ON s.id = ring.up WHERE ring.up <> start),
tops AS (SELECT id, id AS root FROM t WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT ring.id, before.id FROM ring JOIN ring AS before ON before.up = ring.id),
w AS (SELECT id, root FROM tops UNION ALL SELECT s.id, w.root FROM w JOIN s ON s.up = w.id WHERE s.id NOT IN (SELECT id FROM ring))
SELECT id, root FROM w""")
def chain_roots_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of thousands of processes; those of the first two groups begin in a cycle of 41."""
    e = read(spark, sf_dir, "events").where("event_id % 4000 <> 0")
    up = F.when((F.col("event_id") % 4000 == 1) & (F.col("event_id") < 8000), F.col("event_id") + 40).otherwise(F.col("event_id") - 1)
    names = read(spark, sf_dir, "events").select(F.lit("h0").alias("host_id"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 1999 == 0, "/usr/bin/zsh").otherwise("app").alias("name"))
    return timeline.chain_roots(e.select(F.lit("h0").alias("host_id"), F.col("event_id").alias("child"), up.alias("parent")), names).select("id", "root")


@query(f"WITH RECURSIVE {CHAINS} SELECT event_id, chain_id, how FROM chains JOIN nx USING (event_id)")
def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, roots, _ = _chain_inputs(spark, sf_dir)
    return timeline.build_chains(e, roots).select("event_id", "chain_id", "how")


@query(f"""WITH RECURSIVE {CHAINS},
r AS (SELECT chain_id, nx.*, (ts, event_id) AS pos FROM chains JOIN nx USING (event_id)),
x AS (SELECT chain_id, 'pid' AS kind, CAST(pid AS VARCHAR) AS v, pos FROM r WHERE pid IS NOT NULL UNION ALL SELECT chain_id, 'category', event_category, pos FROM r UNION ALL SELECT chain_id, 'action', event_type, pos FROM r
  UNION ALL SELECT chain_id, 'destination', destination_ip, pos FROM r UNION ALL SELECT chain_id, 'user', subject_name, pos FROM r),
c AS (SELECT chain_id, kind, v, count(*) AS k, min(pos) AS first FROM x GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY chain_id, kind ORDER BY CASE WHEN kind = 'user' THEN 0 ELSE -k END, first) AS p,
  coalesce(list_position(['process', 'authentication', 'file', 'network', 'package', 'iam', 'intrusion_detection'], v), 100) AS c FROM c),
l AS (SELECT chain_id, count(*) FILTER (kind = 'pid') AS n_pids, count(*) FILTER (kind = 'category') AS span, string_agg(v, ', ' ORDER BY c) FILTER (kind = 'category') AS categories, string_agg(v || ':' || k, ', ' ORDER BY c) FILTER (kind = 'category') AS cat_counts,
  string_agg(v || ':' || k, ', ' ORDER BY p) FILTER (kind = 'action' AND p <= 4) AS actions, string_agg(v || ':' || k, ', ' ORDER BY p) FILTER (kind = 'destination' AND p <= 4) AS destinations, string_agg(v, ', ' ORDER BY p) FILTER (kind = 'user' AND p <= 3) AS users FROM p GROUP BY 1)
SELECT chain_id, strftime(min(ts), {TIME}) AS start, strftime(max(ts), {TIME}) AS "end", count(*) AS n, max(event_severity) AS severity, {', '.join(f"count(*) FILTER (how = '{h}') AS n_{h}" for h in ('ancestry', 'socket', 'object', 'time'))},
  any_value(n_pids) AS n_pids, any_value(span) AS span, any_value(categories) AS categories, any_value(cat_counts) AS cat_counts, any_value(actions) AS actions, any_value(destinations) AS destinations, any_value(users) AS users,
  CASE WHEN chain_id LIKE 'proc:%' THEN chain_id[6:] ELSE '' END AS root_pid, min_by(how, pos) AS how,
  CASE WHEN chain_id LIKE 'proc:%' AND TRY_CAST(chain_id[6:] AS BIGINT) IN (SELECT p_partkey FROM part) THEN CASE WHEN TRY_CAST(chain_id[6:] AS BIGINT) % 10 = 0 THEN '/bin/bash' ELSE 'app' END
    ELSE coalesce(nullif(min_by(CASE WHEN event_type = 'signup' THEN 'start' ELSE '' END, pos), ''), nullif(min_by(process_name, pos), ''), chain_id[6:]) END AS title
FROM r JOIN l USING (chain_id) GROUP BY 1 HAVING count(*) >= 2""")
def event_chains_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, roots, names = _chain_inputs(spark, sf_dir)
    found = timeline.chain_summary(timeline.build_chains(e, roots), e, names)
    return found.drop("host_id").withColumn("start", stamp("start")).withColumn("end", stamp("end"))


@query(f"""WITH RECURSIVE {CHAINS}, c AS (SELECT count(*) AS events, {', '.join(f"count(*) FILTER (how = '{h}') AS n_{h}" for h in ('ancestry', 'socket', 'object', 'time'))} FROM chains JOIN nx USING (event_id))
SELECT *, CAST((n_ancestry + n_socket) * 100 // events AS BIGINT) AS strong_pct, CAST((n_ancestry + n_socket + n_object + n_time) * 100 // events AS BIGINT) AS covered_pct FROM c""")
def event_chains_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, roots, _ = _chain_inputs(spark, sf_dir)
    return timeline.chain_coverage(timeline.build_chains(e, roots))


@query("SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^(\w+://[^/]*)", 1)
    return read(spark, sf_dir, "pages").groupBy(basename(host).alias("host")).agg(F.count(F.lit(1)).alias("n"))
