"""Panels of file, network and privilege events, sketches by day, and names held in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators import enrich, stats
from fleetscope.plans.registry import query, stamp
from fleetscope.plans.views import V_EV, read, v_ev

TIME = "'%Y-%m-%d %H:%M:%S'"

#: What the panels read, in DuckDB.
V_PANEL = f"""{V_EV}, v AS (SELECT *, CASE WHEN k % 10 = 9 THEN '' ELSE '/d' || (k % 7) || '/f' || k END AS file_path, CASE WHEN k % 10 = 9 THEN '' ELSE '/d' || (k % 7) END AS file_directory, CASE WHEN k % 4 = 0 THEN NULL ELSE 'pkg' || (k % 20) END AS package_name,
  CASE WHEN user_id % 6 = 0 THEN '' ELSE subject_name END AS who, event_type || '_' || (k % 3) AS event_action, CASE WHEN k % 2 = 0 THEN 'host' || (k % 40) || '.example' ELSE '' END AS destination_domain, CASE WHEN k % 5 = 0 THEN NULL ELSE 'as' || (k % 9) END AS destination_as_org,
  CASE WHEN k % 3 = 0 THEN 'sudo cmd' || (k % 30) ELSE '' END AS cmd FROM v_ev)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("k"), lambda x: x.cast("string")
    return v_ev(spark, sf_dir).withColumns({
        "file_path": F.when(k % 10 == 9, "").otherwise(F.concat(F.lit("/d"), text(k % 7), F.lit("/f"), text(k))), "file_directory": F.when(k % 10 == 9, "").otherwise(F.concat(F.lit("/d"), text(k % 7))), "package_name": F.when(k % 4 != 0, F.concat(F.lit("pkg"), text(k % 20))),
        "subject_name": F.when(F.col("user_id") % 6 == 0, "").otherwise(F.col("subject_name")), "event_action": F.concat("event_type", F.lit("_"), text(k % 3)), "destination_domain": F.when(k % 2 == 0, F.concat(F.lit("host"), text(k % 40), F.lit(".example"))).otherwise(""),
        "destination_as_org": F.when(k % 5 != 0, F.concat(F.lit("as"), text(k % 9))), "process_command_line": F.when(k % 3 == 0, F.concat(F.lit("sudo cmd"), text(k % 30))).otherwise(""),
    })


def _panel(name: str, where: str, value: str, limit: int | None, more: str = "CAST(0 AS BIGINT) AS distinct_n, CAST(NULL AS VARCHAR) AS largest") -> str:
    return f"SELECT '{name}' AS panel, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank, * FROM (SELECT {value} AS value, count(*) AS n, {more}, strftime(max(ts), {TIME}) AS last_ts FROM v WHERE {where} GROUP BY 1 ORDER BY n DESC, value{f' LIMIT {limit}' if limit else ''})"


@query(f"WITH {V_PANEL} " + " UNION ALL ".join([
    _panel("by_action", "event_category = 'file'", "event_action", None), _panel("by_dir", "event_category = 'file' AND file_directory <> ''", "file_directory", 15), _panel("by_package", "event_category = 'file'", "coalesce(package_name, '(unpackaged)')", 12),
    _panel("by_who", "file_path <> ''", "CASE WHEN who = '' THEN '(not recorded)' ELSE who END", 12),
    f"SELECT 'series', CAST(row_number() OVER (ORDER BY value) AS INTEGER), * FROM (SELECT strftime(ts, '%Y-%m-%dT%H') AS value, count(*) AS n, CAST(0 AS BIGINT), NULL, strftime(max(ts), {TIME}) FROM v WHERE event_category = 'file' GROUP BY 1 ORDER BY value DESC LIMIT 48)",
]))
def file_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.file_activity(_events(spark, sf_dir)).withColumn("last_ts", stamp("last_ts"))


_ADDRESSES = "count(DISTINCT destination_ip) AS distinct_n, max(destination_ip) AS largest"


@query(f"WITH {V_PANEL} " + " UNION ALL ".join([_panel("dns", "destination_domain <> ''", "destination_domain", 25, _ADDRESSES), _panel("by_asn", "event_category = 'network'", "coalesce(destination_as_org, '(unknown)')", 15, _ADDRESSES), _panel("by_process", "event_category = 'network'", "CASE WHEN process_name = '' THEN '(owner unknown)' ELSE process_name END", 15, _ADDRESSES)]))
def network_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.network_activity(_events(spark, sf_dir)).withColumn("last_ts", stamp("last_ts"))


@query(f"WITH {V_PANEL} " + " UNION ALL ".join([_panel("auth_failures", "event_category = 'authentication' AND event_outcome = 'failure'", "who", 10), _panel("sudo_commands", "event_type = 'purchase' AND cmd <> ''", "cmd", 15)]))
def privilege_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("event_action", F.when(F.col("event_type") == "purchase", "user_command").otherwise(""))
    return stats.privilege_activity(e).withColumn("last_ts", stamp("last_ts"))


@query("""WITH x AS (SELECT s_nationkey AS host, 'suid' AS panel, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS rank, s_name AS name, 'root 4755' AS detail FROM supplier UNION ALL
SELECT c_nationkey, 'admins', row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name), c_name, 'admin wheel' FROM customer WHERE c_custkey % 3 = 0 UNION ALL
SELECT c_nationkey, 'polkit', row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name), c_name, c_mktsegment || ' yes' FROM customer WHERE c_custkey % 2 = 0 UNION ALL
SELECT o_custkey % 25, 'vectors', row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY CAST(CAST(o_orderdate AS DATE) AS VARCHAR) DESC, o_orderstatus DESC, CAST(o_orderkey AS VARCHAR)), 'cap: ' || o_orderkey, o_orderpriority FROM orders)
SELECT * FROM x WHERE rank <= CASE panel WHEN 'polkit' THEN 60 WHEN 'admins' THEN 1000000000 ELSE 200 END""")
def privilege_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, host = read(spark, sf_dir, "customer"), F.col("c_nationkey").cast("long").alias("host")
    vectors = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("host"), F.lit("cap").alias("kind"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("detail"), F.to_date("o_orderdate").cast("string").alias("changed"), F.col("o_orderstatus").alias("risk"))
    suid = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("host"), F.col("s_name").alias("path"), F.lit("root").alias("owner"), F.lit("4755").alias("perms"))
    users = c.select(host, F.col("c_name").alias("name"), F.lit("admin").alias("privilege"), F.when(F.col("c_custkey") % 3 == 0, "wheel").alias("admin_groups"))
    polkit = c.select(host, F.col("c_name").alias("action"), F.col("c_mktsegment").alias("title"), F.lit("yes").alias("allow_active"), F.when(F.col("c_custkey") % 2 == 0, "high").otherwise("").alias("risk"))
    return stats.privilege_standing(vectors, suid, users, polkit, ["host"]).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {V_EV}, w AS (SELECT * FROM v_ev WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'),
l AS (SELECT 'destination_ip' AS field, destination_ip AS v FROM w UNION ALL SELECT 'subject_name', subject_name FROM w UNION ALL SELECT 'event', CAST(event_id AS VARCHAR) FROM w)
SELECT field, count(*) AS n, count(DISTINCT v) AS exact, true AS within FROM l GROUP BY 1""")
def window_from_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of days from their sketches, with the exact number and whether the estimate is within three standard errors (2.5 %)."""
    e = v_ev(spark, sf_dir).withColumn("event", F.col("event_id").cast("string"))
    fields, first, last = ["destination_ip", "subject_name", "event"], F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")
    found = stats.merged_sketches(stats.day_sketches(e, fields), first, last)
    exact = e.where(F.to_date("ts").between(first, last)).select(*fields).unpivot([], fields, "field", "value").groupBy("field").agg(F.countDistinct("value").alias("exact"))
    return found.join(exact, "field").select("field", "n", "exact", (F.abs(F.col("distinct_n") - F.col("exact")) <= F.greatest(F.lit(1), F.col("exact") * 0.025)).alias("within"))


@query("""WITH t AS (SELECT DISTINCT substring(p_name, 1, 1 + p_partkey % 9) AS token FROM part), x AS (SELECT DISTINCT c_name || ' of ' || c_mktsegment || ' ' || p_name AS text FROM customer JOIN part ON p_partkey = c_custkey)
SELECT text, token FROM x JOIN t ON contains(text, token) WHERE length(token) >= 4""")
def token_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, part = F.lit("h0").alias("host_id"), read(spark, sf_dir, "part")
    tokens = part.select(host, F.substring("p_name", F.lit(1), (F.col("p_partkey") % 9 + 1).cast("int")).alias("token"))
    texts = read(spark, sf_dir, "customer").join(part, F.col("c_custkey") == F.col("p_partkey")).select(host, F.concat("c_name", F.lit(" of "), "c_mktsegment", F.lit(" "), "p_name").alias("text"))
    return enrich.containing(texts, tokens, "text", "token").select("text", "token")
