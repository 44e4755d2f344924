"""Queries of the remaining look-ups, merges and parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions.predicates import is_private_ip
from fleetscope.operators import enrich, parse
from fleetscope.plans.registry import query
from fleetscope.plans.rules import SAVED_QUERIES
from fleetscope.plans.views import V_EV, read, v_ev
from fleetscope.sources import events as E


def _host() -> Column:
    return F.lit("h0").alias("host_id")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


@query(f"""WITH {V_EV} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM v_ev WHERE destination_port = 53 AND NOT destination_ip LIKE '10.%' GROUP BY 1""")
def saved_query_public_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir).withColumn("network_direction", F.when(is_private_ip(F.col("destination_ip")), "internal").otherwise("external"))
    return e.where(SAVED_QUERIES["public_dns"]).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V_EV}, i AS (SELECT destination_ip AS ip, max(subject_name) AS org FROM v_ev WHERE event_id % 3 = 0 GROUP BY 1)
SELECT event_id, CASE WHEN destination_ip LIKE '10.%' THEN 'private network' ELSE coalesce(org, '') END AS as_org FROM v_ev LEFT JOIN i ON ip = destination_ip""")
def ip_intel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir)
    intel = e.where("event_id % 3 = 0").select(F.col("destination_ip").alias("ip"), F.lit("").alias("as_number"), F.col("subject_name").alias("as_org"), F.lit("").alias("country"))
    return enrich.ip_intel(e, intel, "destination_ip", is_private_ip(F.col("destination_ip"))).select("event_id", "as_org")


@query("""SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name WHEN n_nationkey IS NOT NULL THEN 'g' ELSE '' END AS category, coalesce(n_name, '') AS purpose FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey""")
def package_meta_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = read(spark, sf_dir, "customer").select(_host(), "c_custkey", _text("c_nationkey").alias("name"))
    meta = read(spark, sf_dir, "nation").where("n_regionkey < 3").select(_host(), _text("n_nationkey").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("category"), F.lit("g").alias("group"), F.lit("").alias("purpose"), F.col("n_name").alias("summary"), F.lit("").alias("url"))
    return enrich.package_meta(apps, meta).select("c_custkey", "category", "purpose")


@query("""SELECT o_orderkey, coalesce(c_mktsegment, '') AS owner_package, CASE o_orderkey % 100 WHEN 22 THEN 'ssh' WHEN 80 THEN 'http' ELSE '' END AS service,
CASE WHEN c_mktsegment IS NOT NULL THEN c_mktsegment WHEN o_orderkey % 100 = 22 THEN 'shell' WHEN o_orderkey % 100 = 80 THEN 'web' ELSE '' END AS service_purpose
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0""")
def socket_owner_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    ports = read(spark, sf_dir, "orders").select(_host(), "o_orderkey", F.col("o_custkey").alias("pid"), (F.col("o_orderkey") % 100).cast("string").alias("port"), F.lit("tcp6").alias("proto"), F.lit("local-only").alias("exposure"))
    procs = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(_host(), F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("package"), F.lit("x").alias("command"), F.lit("u").alias("user"))
    known = read(spark, sf_dir, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, 22).otherwise(80).alias("port"), F.lit("tcp").alias("proto"), F.when(F.col("r_regionkey") == 0, "ssh").otherwise("http").alias("service"), F.when(F.col("r_regionkey") == 0, "shell").otherwise("web").alias("comment"))
    return enrich.port_service(enrich.socket_owner(ports, procs), known).select("o_orderkey", "owner_package", "service", "service_purpose")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS name, CASE WHEN n_regionkey IN (1, 2) THEN r_name ELSE '' END AS purpose FROM (SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 <> 0) UNION ALL
SELECT 'org.x' || n_nationkey || '.' || n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey IN (1, 2) AND n_nationkey % 3 = 0""")
def package_desktop(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    meta = n.where("n_nationkey % 3 <> 0").select(_host(), _text("n_nationkey").alias("name"))
    entry = n.where("n_regionkey IN (1, 2)").select(_host(), F.concat(F.lit("/a/org.x"), _text("n_nationkey"), F.lit("."), _text("n_nationkey"), F.lit(".desktop")).alias("file"), F.lit("other --x").alias("exec"), F.col("r_name").alias("purpose"))
    return parse.package_desktop(meta, entry).select("name", "purpose")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/m' || p_partkey ELSE '/d' END AS mountpoint, CASE WHEN p_partkey % 2 = 0 THEN 'yes' ELSE '' END AS encrypted FROM part""")
def block_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    disk = part.select(_host(), _text("p_partkey").alias("name"), F.lit("disk").alias("type"), F.lit("").alias("pkname"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("/d").alias("mountpoint"), F.lit("x").alias("fstype"))
    crypt = part.where("p_partkey % 2 = 0").select(_host(), F.concat(F.lit("luks"), _text("p_partkey")).alias("name"), F.lit("crypt").alias("type"), _text("p_partkey").alias("pkname"), F.concat(F.lit("/m"), _text("p_partkey")).alias("mountpoint"), F.lit("ext4").alias("fstype"))
    return parse.block_devices(disk.unionByName(crypt)).select(F.col("name").cast("long").alias("p_partkey"), "mountpoint", "encrypted")


@query("""SELECT s_suppkey, coalesce(max(o_orderstatus), '') AS enabled, s_name AS content FROM supplier LEFT JOIN orders ON o_custkey = s_suppkey GROUP BY s_suppkey, s_name""")
def service_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.lit("system").alias("scope")
    units = read(spark, sf_dir, "supplier").select(_host(), scope, F.col("s_suppkey").alias("unit"))
    enabled = read(spark, sf_dir, "orders").select(_host(), scope, F.col("o_custkey").alias("unit"), F.col("o_orderstatus").alias("enabled"))
    files = read(spark, sf_dir, "supplier").select(_host(), scope, F.col("s_suppkey").alias("unit"), F.col("s_name").alias("content"))
    return parse.services(units, enabled, files).select(F.col("unit").alias("s_suppkey"), "enabled", "content")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderkey % 97 AS c1, o_custkey % 89 AS c2 FROM orders WHERE o_custkey % 3 <> 0),
s AS (SELECT DISTINCT p_size AS c, p_size / 10.0 AS score FROM part WHERE p_size % 2 = 0),
x AS (SELECT DISTINCT o_orderkey, c FROM (SELECT o_orderkey, c1 AS c FROM a UNION ALL SELECT o_orderkey, c2 FROM a))
SELECT o_orderkey, CAST(max(score) AS DOUBLE) AS cvss_score, count(score) || '/' || count(*) AS cvss_covered FROM x LEFT JOIN s USING (c) GROUP BY 1""")
def advisory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cve = lambda c: F.concat(F.lit("CVE-2026-"), F.lpad(c.cast("string"), 5, "0"))
    o = read(spark, sf_dir, "orders")
    records = o.select(_host(), F.col("o_orderkey").alias("advisory"), F.lit("open").alias("status"), F.array(F.concat(F.lit("p"), _text("o_custkey")), F.lit("absent")).alias("packages"), F.concat_ws(" and ", cve(F.col("o_orderkey") % 97), cve(F.col("o_custkey") % 89)).alias("text"))
    installed = o.where("o_custkey % 3 <> 0").select(_host(), F.concat(F.lit("p"), _text("o_custkey")).alias("name"))
    scores = read(spark, sf_dir, "part").where("p_size % 2 = 0").select(cve(F.col("p_size")).alias("cve"), (F.col("p_size") / 10.0).cast("string").alias("score"), F.lit("").alias("vector")).distinct()
    return parse.advisories(records, installed, scores).select(F.col("advisory").alias("o_orderkey"), "cvss_score", "cvss_covered")


@query("""WITH prov AS (SELECT l_partkey AS cap, min(l_suppkey) AS pkg FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_custkey = o_orderkey % 1000 AND pkg1.pkg IS NOT NULL THEN 's' || pkg1.pkg ELSE concat_ws(' ', 's' || pkg1.pkg, CASE WHEN pkg2.pkg IS DISTINCT FROM pkg1.pkg THEN 's' || pkg2.pkg END, 'bare') END AS depends_n
FROM orders LEFT JOIN prov pkg1 ON pkg1.cap = o_custkey LEFT JOIN prov pkg2 ON pkg2.cap = o_orderkey % 1000 WHERE o_custkey <> o_orderkey % 1000""")
def capability_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = lambda c: F.concat(F.lit("lib"), c.cast("string"), F.lit(".so()(64bit)"))
    pkgs = read(spark, sf_dir, "orders").where("o_custkey <> o_orderkey % 1000").select(_host(), _text("o_orderkey").alias("name"), F.concat_ws(" ", lib(F.col("o_custkey")), F.lit("(if"), lib(F.col("o_orderkey") % 1000), F.lit("else)"), F.lit("bare")).alias("depends"))
    provides = read(spark, sf_dir, "lineitem").where("l_partkey % 2 = 0").groupBy(lib(F.col("l_partkey")).alias("capability")).agg(F.min("l_suppkey").alias("s")).select(_host(), "capability", F.concat(F.lit("s"), _text("s")).alias("package"))
    return parse.resolve_capabilities(pkgs, provides, "depends").select(F.col("name").cast("long").alias("o_orderkey"), F.col("depends").alias("depends_n"))


@query("""SELECT event_id, '' AS not_normalized, user_id AS process_pid FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'odd_field', user_id FROM events WHERE event_id % 2 = 1""")
def conform_to_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(_text("event_id").alias("event_id"), F.col("user_id").alias("process_pid"), F.when(F.col("event_id") % 2 == 1, "x").otherwise("").alias("odd_field"))
    return E.conform(e).select(F.col("event_id").cast("long").alias("event_id"), "not_normalized", "process_pid")
