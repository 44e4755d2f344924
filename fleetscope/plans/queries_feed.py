"""Queries over feeds: filters, groups, statistics, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.functions import predicates as P
from fleetscope.functions.scalars import cvss_rating, cvss_score, hex_text
from fleetscope.operators import enrich, stats
from fleetscope.plans.registry import query, stamp
from fleetscope.plans.rules import SAVED_QUERIES
from fleetscope.plans.views import V_EV, read, v_ev
from fleetscope.sources.events import unmapped
from fleetscope.sources.state import search_tables

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query(f"""WITH {V_EV}
SELECT event_id, {TS} AS ts, subject_name, destination_ip FROM v_ev WHERE event_category = 'authentication' AND event_outcome = 'failure' ORDER BY v_ev.ts DESC, event_id LIMIT 100""")
def feed_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir)
    rows, _ = stats.page(e, P.field_filter(e, event_category="authentication", event_outcome="failure", event_module=""), [F.desc("ts"), F.asc("event_id")], 100)
    return rows.select("event_id", stamp("ts").alias("ts"), "subject_name", "destination_ip")


@query(f"""WITH {V_EV}
SELECT count(*) AS total, count(*) > 100 AS truncated FROM v_ev WHERE event_category = 'network'""")
def feed_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir)
    return stats.page(e, F.col("event_category") == "network", [F.asc("event_id")], 100)[1]


@query("""
SELECT 'eq' AS op, count(*) FILTER (event_type = 'error') AS n FROM events UNION ALL
SELECT 'ne', count(*) FILTER (event_type <> 'error') FROM events UNION ALL
SELECT 'contains', count(*) FILTER (contains(event_type, 'i')) FROM events UNION ALL
SELECT 'not_contains', count(*) FILTER (NOT contains(event_type, 'i')) FROM events UNION ALL
SELECT 'regex', count(*) FILTER (regexp_matches(event_type, '^(v|c).*k?$')) FROM events UNION ALL
SELECT 'in', count(*) FILTER (user_id IN (1, 2, 3)) FROM events UNION ALL
SELECT 'not_in', count(*) FILTER (user_id NOT IN (1, 2, 3)) FROM events UNION ALL
SELECT 'missing_field', count(*) FILTER (false) FROM events UNION ALL
SELECT 'unknown_op', count(*) FROM events""")
def predicate_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    tests = {
        "eq": ("event_type", "eq", "error"), "ne": ("event_type", "ne", "error"), "contains": ("event_type", "contains", "i"), "not_contains": ("event_type", "not_contains", "i"),
        "regex": ("event_type", "regex", "^(v|c).*k?$"), "in": ("user_id", "in", [1, 2, 3]), "not_in": ("user_id", "not_in", [1, 2, 3]), "missing_field": ("nowhere", "eq", "x"), "unknown_op": ("event_type", "like", "x"),
    }
    counts = e.agg(*(F.count_if(P.row_condition(e, *t)).alias(name) for name, t in tests.items()))
    return counts.unpivot([], list(tests), "op", "n")


@query("""
SELECT p_partkey, p_name FROM part
WHERE lower(CAST(p_partkey AS VARCHAR)) LIKE '%17%' OR lower(p_name) LIKE '%17%' OR lower(p_brand) LIKE '%17%' OR lower(p_type) LIKE '%17%' OR lower(CAST(p_size AS VARCHAR)) LIKE '%17%'""")
def quick_search_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.where(P.quick_search(part, "17", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])).select("p_partkey", "p_name")


CONDITIONS = (
    {"field": "o_orderstatus", "op": "=", "value": "F"},
    {"join": "OR", "field": "o_orderpriority", "op": "MATCH", "value": "urgent"},
    {"join": "AND", "field": "o_totalprice", "op": ">", "value": "1000"},
    {"join": "AND NOT", "field": "o_custkey", "op": "<", "value": "40"},
    {"join": "OR", "field": "o_orderstatus", "op": "=", "value": ""},
)


@query("""
SELECT o_orderstatus, count(*) AS n FROM orders
WHERE o_orderstatus = 'F' OR (o_orderpriority ILIKE '%urgent%' AND o_totalprice > 1000 AND NOT (o_custkey < 40)) GROUP BY 1""")
def joiner_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.where(P.query_bar(o, CONDITIONS)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderstatus, count(*) AS n FROM orders
WHERE ((lower(o_orderstatus) = 'f' OR contains(lower(o_orderpriority), 'urgent')) AND o_totalprice > 1000) AND NOT (o_custkey < 40) GROUP BY 1""")
def joiner_left_to_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.where(P.row_matcher(o, CONDITIONS)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'LIKE' AS op, count(*) FILTER (p_name ILIKE 'part%1') AS n FROM part UNION ALL
SELECT 'NOT LIKE', count(*) FILTER (NOT p_name ILIKE 'part%1') FROM part UNION ALL
SELECT 'NOT MATCH', count(*) FILTER (NOT p_brand ILIKE '%#2%') FROM part UNION ALL
SELECT '>=', count(*) FILTER (p_size >= 25) FROM part UNION ALL
SELECT '<=', count(*) FILTER (p_size <= 25) FROM part UNION ALL
SELECT '<>', count(*) FILTER (CAST(p_size AS VARCHAR) <> '25') FROM part UNION ALL
SELECT 'IS NULL', count(*) FILTER (p_brand IS NULL) FROM part UNION ALL
SELECT 'IS NOT NULL', count(*) FILTER (p_brand IS NOT NULL) FROM part""")
def query_bar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    tests = {"LIKE": ("p_name", "part%1"), "NOT LIKE": ("p_name", "part%1"), "NOT MATCH": ("p_brand", "#2"), ">=": ("p_size", "25"), "<=": ("p_size", "25"), "<>": ("p_size", "25"), "IS NULL": ("p_brand", ""), "IS NOT NULL": ("p_brand", "")}
    counts = part.agg(*(F.count_if(P.bar_condition(part, f, op, v)).alias(op) for op, (f, v) in tests.items()))
    return counts.unpivot([], [F.col(f"`{op}`") for op in tests], "op", "n")


NETWORKS = ("10.0.0.0/8", "10.0.0.0/16", "10.0.3.0/24", "10.0.3.7/32", "203.0.0.0/20", "203.0.6.0/23")


@query(f"""WITH {V_EV},
ips AS (SELECT CAST(split_part(destination_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(destination_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(destination_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(destination_ip, '.', 4) AS BIGINT) AS ip FROM v_ev)
SELECT '10.0.0.0/8' AS network, count(*) FILTER (ip // 16777216 = 10) AS n FROM ips UNION ALL
SELECT '10.0.0.0/16', count(*) FILTER (ip // 65536 = 2560) FROM ips UNION ALL
SELECT '10.0.3.0/24', count(*) FILTER (ip // 256 = 655363) FROM ips UNION ALL
SELECT '10.0.3.7/32', count(*) FILTER (ip = 167772935) FROM ips UNION ALL
SELECT '203.0.0.0/20', count(*) FILTER (ip // 4096 = 831488) FROM ips UNION ALL
SELECT '203.0.6.0/23', count(*) FILTER (ip // 512 = 6651907) FROM ips""")
def cidr_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir)
    counts = e.agg(*(F.count_if(P.cidr(F.col("destination_ip"), net)).alias(f"n{k}") for k, net in enumerate(NETWORKS)))
    long = counts.unpivot([], [f"n{k}" for k in range(len(NETWORKS))], "network", "n")
    names = F.create_map(*(F.lit(x) for k, net in enumerate(NETWORKS) for x in (f"n{k}", net)))
    return long.select(names[F.col("network")].alias("network"), "n")


@query(f"""WITH {V_EV} SELECT destination_ip LIKE '10.%' AS private, count(*) AS n FROM v_ev GROUP BY 1""")
def private_ip_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_ev(spark, sf_dir).groupBy(P.is_private_ip(F.col("destination_ip")).alias("private")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT max(ts) AS m FROM events)
SELECT '7 days' AS bound, count(*) FILTER (ts >= m - INTERVAL 7 DAY) AS n FROM events, m UNION ALL
SELECT '24 hours', count(*) FILTER (ts >= m - INTERVAL 24 HOUR) FROM events, m UNION ALL
SELECT '1 months', count(*) FILTER (ts >= m - INTERVAL 1 MONTH) FROM events, m""")
def relative_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("m"))), F.lit(True))
    bounds = {"7 days": (7, "days"), "24 hours": (24, "hours"), "1 months": (1, "months")}
    counts = e.agg(*(F.count_if(P.last_n(F.col("ts"), n, unit, F.col("m"))).alias(name) for name, (n, unit) in bounds.items()))
    return counts.unpivot([], [F.col(f"`{b}`") for b in bounds], "bound", "n")


TEMPLATES = (
    {"event_type": "sign", "action": "drop"},
    {"message": '"k": 1', "action": "tag", "reason": "one"},
    {"event_type": "VIEW", "match": r'"k": [2-4]\}', "action": "tag", "name": "few"},
    {"action": "drop", "name": "no criterion"},
    {"event_type": "error", "match": r'"k": 9', "action": "drop"},
)


@query("""
SELECT tags, count(*) AS n FROM (
  SELECT CASE WHEN contains(event_type, 'sign') THEN 'drop'
    WHEN contains(props, '"k": 1') THEN 'noise:one'
    WHEN contains(event_type, 'view') AND regexp_matches(props, '"k": [2-4]\\}') THEN 'noise:few'
    WHEN contains(event_type, 'error') AND regexp_matches(props, '"k": 9') THEN 'drop' ELSE '' END AS tags FROM events)
WHERE tags <> 'drop' GROUP BY 1""")
def noise_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumnRenamed("props", "message")
    return P.apply_templates(e, TEMPLATES).groupBy("tags").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V_EV} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM v_ev WHERE event_category = 'authentication' AND event_outcome = 'failure' GROUP BY 1""")
def saved_query_failed_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_ev(spark, sf_dir).where(SAVED_QUERIES["failed_auth"]).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_type, g, count(*) AS n, event_type || ' · ' || CASE WHEN g = '' THEN '(empty)' ELSE g END AS label
FROM (SELECT event_type, CASE WHEN user_id % 5 = 0 THEN '' ELSE CAST(user_id % 5 AS VARCHAR) END AS g FROM events) GROUP BY 1, 2""")
def group_counts_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("g", F.when(F.col("user_id") % 5 == 0, F.lit(None)).otherwise((F.col("user_id") % 5).cast("string")))
    return stats.group_counts(e, ["event_type", "g"], 300)


@query("""WITH v AS (
  SELECT 'event_type' AS field, event_type AS value FROM events UNION ALL
  SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT 'props', props FROM events),
c AS (SELECT field, value, count(*) AS n FROM v WHERE coalesce(value, '') <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM c)
SELECT field, CAST(sum(n) AS BIGINT) AS filled, round(sum(n) * 100.0 / (SELECT count(*) FROM events), 1) AS percent, count(*) AS unique,
  string_agg(value || '=' || n, ' · ' ORDER BY r) FILTER (r <= 12) AS top FROM r GROUP BY 1""")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.field_stats(read(spark, sf_dir, "events"), ["event_type", "user_id", "props"])


@query("""
SELECT '' AS field, CAST(min(ts) AS VARCHAR)[1:19] || ' .. ' || CAST(max(ts) AS VARCHAR)[1:19] AS value, count(*) AS n FROM events UNION ALL
SELECT 'event_type', event_type, count(*) FROM events GROUP BY 2""")
def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.event_stats(read(spark, sf_dir, "events").withColumn("ts", stamp("ts")), ["event_type"])


SEARCHED = {"nation": ("n_nationkey", "n_name", "n_regionkey"), "region": ("r_regionkey", "r_name"), "supplier": ("s_suppkey", "s_name"), "customer": ("c_custkey", "c_name", "c_mktsegment")}


def _search_sql(table: str, columns: tuple[str, ...], term: str) -> str:
    hit = {c: f"contains(lower(CAST({c} AS VARCHAR)), '{term}')" for c in sorted(columns)}
    named = ", ".join(f"CASE WHEN bool_or({h}) THEN '{c}' END" for c, h in hit.items())
    least = ", ".join(f"min(CASE WHEN {h} THEN CAST({c} AS VARCHAR) END)" for c, h in hit.items())
    return f"SELECT '{table}' AS tab, count(*) AS n, concat_ws(',', {named}) AS columns, array_to_string(list_sort(list_distinct([{least}]))[1:3], ' · ') AS samples FROM {table} WHERE {' OR '.join(hit.values())} HAVING count(*) > 0"


@query(" UNION ALL ".join(_search_sql(t, c, "1") for t, c in SEARCHED.items()))
def cross_table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_tables({t: read(spark, sf_dir, t).select(*c) for t, c in SEARCHED.items()}, "1")
    return found.select(F.col("table").alias("tab"), "n", "columns", "samples")


@query(f"""WITH {V_EV} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM v_ev WHERE event_category = 'file' GROUP BY 1 ORDER BY 1 DESC LIMIT 48""")
def file_activity_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hourly(v_ev(spark, sf_dir).where("event_category = 'file'"), buckets=48).select(stamp("hour").alias("hour"), "n")


@query(f"""WITH {V_EV},
o AS (SELECT k, max(subject_name) AS who, max(process_name) AS proc, max(ts) AS at FROM v_ev WHERE event_category <> 'file' GROUP BY k)
SELECT f.event_id, f.k, o.who AS who_subject_name, o.proc AS who_process_name, strftime(o.at, '%Y-%m-%d %H:%M:%S') AS who_ts, CASE WHEN o.at IS NULL THEN 'rpm -Va: the editor is not recorded' ELSE 'kernel audit' END AS who_source
FROM v_ev f LEFT JOIN o ON o.k = f.k WHERE f.event_category = 'file'""")
def who_changed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir)
    found = stats.who_changed(e.where("event_category = 'file'"), e.where("event_category <> 'file'"), "k", ["subject_name", "process_name"])
    return found.select("event_id", "k", "who_subject_name", "who_process_name", stamp("who_ts").alias("who_ts"), "who_source")


FLOWS = f"""WITH {V_EV},
flows AS (SELECT destination_ip, count(*) AS sessions, count(DISTINCT destination_port) AS ports, min(ts) AS a, max(ts) AS b, count(DISTINCT date_trunc('hour', ts)) AS hours, max(process_name) AS process_name, max(subject_name) AS subject_name
  FROM v_ev WHERE event_category = 'network' GROUP BY 1)"""


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.network_flows(v_ev(spark, sf_dir).where("event_category = 'network'"), "destination_ip", ["process_name", "subject_name"], "destination_port")


@query(FLOWS + """ SELECT destination_ip, sessions, ports, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_ts, hours, process_name, subject_name FROM flows""")
def network_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir).withColumn("first_ts", stamp("first_ts")).withColumn("last_ts", stamp("last_ts"))


@query(FLOWS + """, m AS (SELECT destination_ip, sessions, NOT destination_ip LIKE '10.%' AS ext, process_name = '' AS unknown, hours FROM flows)
SELECT destination_ip, sessions, concat_ws(', ', CASE WHEN ext AND sessions <= 3 THEN 'few sessions' END, CASE WHEN unknown THEN 'owner unknown' END, CASE WHEN ext AND hours <= 1 THEN 'narrow time window' END) AS marks,
  (CASE WHEN ext AND sessions <= 3 THEN 1 ELSE 0 END + CASE WHEN unknown THEN 1 ELSE 0 END + CASE WHEN ext AND hours <= 1 THEN 1 ELSE 0 END) >= 2 AS rare FROM m""")
def rare_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flows(spark, sf_dir)
    return stats.rare_sessions(f, ~P.is_private_ip(F.col("destination_ip")), F.col("process_name")).select("destination_ip", "sessions", "marks", "rare")


@query(f"""WITH {V_EV} SELECT CASE WHEN process_name = '' THEN '(owner unknown)' ELSE process_name END AS value, count(*) AS n FROM v_ev WHERE event_category = 'network' GROUP BY 1 ORDER BY n DESC, value LIMIT 15""")
def flows_by_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_counts(v_ev(spark, sf_dir).where("event_category = 'network'"), "process_name", 15, "(owner unknown)")


@query(f"""WITH {V_EV} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, count(*) FILTER (NOT destination_ip LIKE '10.%') AS external FROM v_ev WHERE event_category = 'network' GROUP BY 1""")
def hourly_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir).where("event_category = 'network'")
    return stats.hourly(e, external=~P.is_private_ip(F.col("destination_ip"))).withColumn("hour", stamp("hour"))


@query(f"""WITH {V_EV} SELECT destination_ip, CASE WHEN process_name = '' THEN '(owner unknown)' ELSE process_name END AS process_name, count(*) AS sessions, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM v_ev GROUP BY 1, 2""")
def flow_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.sessions_by(v_ev(spark, sf_dir), ["destination_ip", "process_name"])
    return found.withColumn("first_ts", stamp("first_ts")).withColumn("last_ts", stamp("last_ts"))


@query(f"""WITH {V_EV}, r AS (SELECT destination_ip AS ip, event_id, row_number() OVER (PARTITION BY destination_ip ORDER BY ts DESC, event_id DESC) AS r FROM v_ev)
SELECT ip, event_id FROM r WHERE r <= 5""")
def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.flow_detail(v_ev(spark, sf_dir), ["destination_ip"], cap=5).select("ip", "event_id")


def _ranked(panel: str, rows: str, limit: str = "LIMIT 10") -> str:
    return f"SELECT '{panel}' AS panel, CAST(row_number() OVER (ORDER BY value DESC, name, detail) AS INTEGER) AS rank, name, detail, value FROM ({rows} ORDER BY value DESC, name, detail {limit})"


@query(f"WITH {V_EV} " + " UNION ALL ".join([
    _ranked("rss", "SELECT 'p' || p_size AS name, p_partkey || ' u' AS detail, round(p_retailprice, 1) AS value FROM part"), _ranked("cpu", "SELECT 'p' || p_size AS name, p_partkey || ' u' AS detail, CAST(p_size % 7 AS DOUBLE) AS value FROM part WHERE p_size % 7 > 0"),
    _ranked("deps", "SELECT 'c' || o_custkey AS name, 'rpm' AS detail, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY o_custkey"), _ranked("destinations", "SELECT destination_ip AS name, concat_ws(' ', nullif(max(CASE WHEN k % 2 = 0 THEN 'org' || k ELSE '' END), ''), 'NL') AS detail, CAST(count(*) AS DOUBLE) AS value FROM v_ev GROUP BY 1"),
    _ranked("exposure", "SELECT CASE o_orderstatus WHEN 'F' THEN 'OPEN (exposed)' WHEN 'O' THEN 'local-only' ELSE '' END AS name, '' AS detail, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1", ""),
]))
def top_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, orders = read(spark, sf_dir, "part"), read(spark, sf_dir, "orders")
    procs = part.select(F.concat(F.lit("/usr/bin/p"), F.col("p_size").cast("string"), F.lit(" -x")).alias("command"), F.col("p_partkey").alias("pid"), F.lit("u").alias("user"), F.col("p_retailprice").cast("string").alias("rss_mb"), F.when(F.col("p_size") % 7 == 0, "n/a").otherwise((F.col("p_size") % 7).cast("string")).alias("cpu"))
    programs = orders.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("components")).withColumn("kind", F.lit("rpm"))
    ports = orders.select(F.when(F.col("o_orderstatus") == "F", "OPEN (exposed)").when(F.col("o_orderstatus") == "O", "local-only").alias("exposure"))
    e = v_ev(spark, sf_dir).withColumn("destination_as_org", F.when(F.col("k") % 2 == 0, F.concat(F.lit("org"), F.col("k").cast("string"))).otherwise("")).withColumn("destination_geo_country", F.lit("NL"))
    return stats.top_lists(procs, e, programs, ports).select("panel", "rank", "name", "detail", "value")


PARTICIPANTS = f"""{V_EV}, p AS (SELECT destination_ip AS ip, CASE WHEN process_name = '' THEN '(unknown)' ELSE process_name END AS name, max(CAST(process_pid AS VARCHAR)) AS pid, count(*) AS sessions, min(ts) AS a, max(ts) AS b FROM v_ev GROUP BY 1, 2)"""


@query(f"WITH {PARTICIPANTS} SELECT ip, name, pid, sessions, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_ts FROM p")
def flow_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.flow_participants(v_ev(spark, sf_dir))
    return found.select("ip", "name", "pid", "sessions", stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts"))


@query(f"""WITH {PARTICIPANTS}, n AS (SELECT ip, name FROM (SELECT ip, name, row_number() OVER (PARTITION BY ip ORDER BY name) AS r FROM p WHERE name <> '(unknown)') WHERE r <= 10)
SELECT destination_ip AS ip, 'socket' AS kind, 's' || event_id AS name, 'tcp l ' || destination_ip || ':' || destination_port || ' x' AS detail FROM v_ev WHERE event_type = 'click' UNION ALL
SELECT ip, 'process', name, p_partkey || ' u pk pu' FROM n JOIN part ON name = 'p' || (p_partkey % 40)""")
def flow_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, host = v_ev(spark, sf_dir), F.lit("h0").alias("host_id")
    ports = e.where("event_type = 'click'").select("host_id", F.concat_ws(":", "destination_ip", F.col("destination_port").cast("string")).alias("remote"), F.lit("tcp").alias("proto"), F.lit("l").alias("local"), F.lit("x").alias("exposure"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("process"))
    procs = read(spark, sf_dir, "part").select(host, F.concat(F.lit("/usr/bin/p"), (F.col("p_partkey") % 40).cast("string"), F.lit(" -x")).alias("command"), F.col("p_partkey").alias("pid"), F.lit("u").alias("user"), F.lit("pk").alias("package"), F.lit("pu").alias("purpose"))
    return stats.flow_live(stats.flow_participants(e), ports, procs).select("ip", "kind", "name", "detail")


@query("""SELECT o_orderkey, o_orderpriority, CASE lower(o_orderpriority) WHEN '1-urgent' THEN 0 WHEN '2-high' THEN 1 WHEN '3-medium' THEN 2 ELSE 3 END AS rank FROM orders
ORDER BY rank, o_totalprice DESC, o_orderkey LIMIT 200""")
def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = {"1-urgent": 0, "2-high": 1, "3-medium": 2}
    return stats.ranked(read(spark, sf_dir, "orders"), ranks, "o_orderpriority", F.desc("o_totalprice"), F.asc("o_orderkey")).limit(200).select("o_orderkey", "o_orderpriority", "rank")


@query("""SELECT (SELECT count(*) FROM part) AS processes, (SELECT count(*) FROM supplier) AS programs, count(*) FILTER (o_orderstatus = 'O') AS listening, count(*) FILTER (o_orderpriority LIKE '1%') AS exposed, count(*) FILTER (o_orderstatus <> 'O') AS connections, (SELECT count(*) FROM events) AS events FROM orders""")
def dashboard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ports = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "LISTEN").otherwise("ESTAB").alias("state"), F.when(F.col("o_orderpriority").startswith("1"), "OPEN (exposed)").otherwise("local-only").alias("exposure"), F.when(F.col("o_orderstatus") == "O", "").otherwise("x").alias("remote"))
    return stats.dashboard_tiles(read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier"), ports, read(spark, sf_dir, "events"))


@query("""SELECT p_partkey, p_brand, round(100 * p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 4) AS share_pct FROM part""")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.share_of_total(read(spark, sf_dir, "part"), "p_retailprice", ["p_brand"], 4).select("p_partkey", "p_brand", "share_pct")


AS_OF = "1998-08-10"


@query(f"""SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS age_days, CASE WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 0 AND 7 THEN 'yes' ELSE '' END AS recent FROM orders""")
def age_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrich.age(read(spark, sf_dir, "orders"), "o_orderdate", F.to_date(F.lit(AS_OF)))
    return found.select("o_orderkey", F.col("age_days").cast("long").alias("age_days"), "recent")


@query("""WITH k AS (SELECT event_id, list_sort([k FOR k IN json_keys(props) IF k <> 'event_id']) AS names FROM events)
SELECT event_id, array_to_string(names[1:20], ', ') || CASE WHEN len(names) > 20 THEN ' (+' || (len(names) - 20) || ')' ELSE '' END AS not_normalized FROM k""")
def unmapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.filter(F.json_object_keys("props"), lambda x: x != "event_id")
    return read(spark, sf_dir, "events").select("event_id", unmapped(names).alias("not_normalized"))


VECTOR_SQL = """concat('CVSS:3.1/AV:', ['N','A','L','P'][p_partkey % 4 + 1], '/AC:', ['L','H'][p_partkey % 2 + 1], '/PR:', ['N','L','H'][p_partkey % 3 + 1], '/UI:', ['N','R'][(p_partkey // 2) % 2 + 1],
  '/S:', ['U','C'][(p_partkey // 3) % 2 + 1], '/C:', ['H','L','N'][(p_partkey // 4) % 3 + 1], '/I:', ['H','L','N'][(p_partkey // 5) % 3 + 1], '/A:', ['H','L','N'][(p_partkey // 6) % 3 + 1])"""


@query(f"""WITH v AS (SELECT p_partkey, {VECTOR_SQL} AS v FROM part),
w AS (SELECT p_partkey, v,
  CASE regexp_extract(v, 'AV:(.)', 1) WHEN 'N' THEN 0.85::DOUBLE WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END AS av,
  CASE regexp_extract(v, 'AC:(.)', 1) WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44 END AS ac,
  regexp_extract(v, '/S:(.)', 1) = 'C' AS ch,
  CASE regexp_extract(v, 'PR:(.)', 1) WHEN 'N' THEN 0.85::DOUBLE WHEN 'L' THEN CASE WHEN regexp_extract(v, '/S:(.)', 1) = 'C' THEN 0.68 ELSE 0.62 END ELSE CASE WHEN regexp_extract(v, '/S:(.)', 1) = 'C' THEN 0.5 ELSE 0.27 END END AS pr,
  CASE regexp_extract(v, 'UI:(.)', 1) WHEN 'N' THEN 0.85::DOUBLE ELSE 0.62 END AS ui,
  CASE regexp_extract(v, '/C:(.)', 1) WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END AS c,
  CASE regexp_extract(v, '/I:(.)', 1) WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END AS i,
  CASE regexp_extract(v, '/A:(.)', 1) WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END AS a FROM v),
s AS (SELECT *, 1 - (1 - c) * (1 - i) * (1 - a) AS iss FROM w),
x AS (SELECT *, CASE WHEN ch THEN 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42 * iss END AS impact, 8.22 * av * ac * pr * ui AS ex FROM s),
r AS (SELECT *, CAST(round(least(10.0, CASE WHEN ch THEN 1.08 * (impact + ex) ELSE impact + ex END) * 100000) AS BIGINT) AS cents FROM x),
z AS (SELECT p_partkey, CASE WHEN impact <= 0 THEN 0.0 WHEN cents % 10000 = 0 THEN cents / 100000.0 ELSE (cents // 10000 + 1) / 10.0 END AS score FROM r)
SELECT p_partkey, round(CAST(score AS DOUBLE), 1) AS score, CASE WHEN score >= 9 THEN 'Critical' WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' WHEN score > 0 THEN 'Low' ELSE 'None' END AS rating FROM z""")
def cvss_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    div = lambda n: F.floor(k / n)
    vector = F.concat(F.lit("CVSS:3.1/AV:"), pick("NALP", k % 4), F.lit("/AC:"), pick("LH", k % 2), F.lit("/PR:"), pick("NLH", k % 3), F.lit("/UI:"), pick("NR", div(2) % 2), F.lit("/S:"), pick("UC", div(3) % 2), F.lit("/C:"), pick("HLN", div(4) % 3), F.lit("/I:"), pick("HLN", div(5) % 3), F.lit("/A:"), pick("HLN", div(6) % 3))
    found = read(spark, sf_dir, "part").select("p_partkey", cvss_score(vector).alias("score"))
    return found.select("p_partkey", F.round("score", 1).alias("score"), cvss_rating(F.col("score")).alias("rating"))


@query("""WITH t AS (SELECT o_orderkey, 'fixes CVE-20' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || '-' || (10000 + o_custkey) || ' and CVE-2001-' || (1000 + o_orderkey % 9) AS line FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(regexp_extract_all(line, 'CVE-\\d{4}-\\d{4,}'))), ',') AS cves FROM t""")
def cve_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("fixes CVE-20"), F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"), F.lit("-"), (F.col("o_custkey") + 10000).cast("string"), F.lit(" and CVE-2001-"), (F.col("o_orderkey") % 9 + 1000).cast("string"))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(line, F.lit(r"CVE-\d{4}-\d{4,}"), 0)))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("cves"))


@query("""SELECT p_partkey, 'unix ' || p_name AS text, p_name || ' x' AS plain FROM part""")
def hex_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.hex(F.concat(F.lit("unix\x00"), F.col("p_name")).cast("binary"))
    return read(spark, sf_dir, "part").select("p_partkey", hex_text(coded).alias("text"), hex_text(F.concat("p_name", F.lit(" x"))).alias("plain"))


@query("""WITH l AS (SELECT o_orderkey AS n, o_custkey AS who, o_orderkey % 3 = 0 AS is_mark, o_orderkey * 10 AS epoch FROM orders),
p AS (SELECT *, lag(CASE WHEN is_mark THEN epoch END) OVER (PARTITION BY who ORDER BY n) AS "before" FROM l)
SELECT n, who, "before" FROM p WHERE NOT is_mark""")
def carry_forward_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetscope.operators.parse import carry_stamps

    key = F.col("o_orderkey")
    lines = read(spark, sf_dir, "orders").select(F.lit("h0").alias("host_id"), F.col("o_custkey").alias("who"), key.alias("line_no"), F.when(key % 3 == 0, F.concat(F.lit("#"), (key * 10).cast("string"))).otherwise(F.concat(F.lit("ls "), key.cast("string"))).alias("line"))
    return carry_stamps(lines, ["host_id", "who"]).select(F.col("line_no").alias("n"), "who", F.col("epoch").alias("before"))


@query("""SELECT o_orderkey, o_orderpriority AS prio, CAST(o_custkey AS VARCHAR) AS cust, '' AS missing FROM orders""")
def kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetscope.operators.parse import key_values

    line = F.concat(F.lit('prio="'), "o_orderpriority", F.lit('" cust='), F.col("o_custkey").cast("string"), F.lit(" cust=again"))
    m = key_values(line)
    return read(spark, sf_dir, "orders").select("o_orderkey", *(F.coalesce(m[k], F.lit("")).alias(k) for k in ("prio", "cust", "missing")))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem)
SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM r WHERE r = 1""")
def precedence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("l_suppkey"), F.desc("l_orderkey"), F.desc("l_linenumber")))
    return read(spark, sf_dir, "lineitem").withColumn("r", rank).where("r = 1").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")
