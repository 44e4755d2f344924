"""Deterministic host-telemetry views on the sample tables, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CATEGORY = {"error": "authentication", "click": "network", "view": "file", "purchase": "package", "signup": "iam"}
PORTS = (443, 80, 53, 22)


def v_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))
    category = None
    for kind, name in CATEGORY.items():
        category = F.when(F.col("event_type") == kind, name) if category is None else category.when(F.col("event_type") == kind, name)
    return e.select(
        F.lit("h0").alias("host_id"), "event_id", "ts", "user_id", "event_type", "value", "k",
        category.alias("event_category"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("event_outcome"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_name"),
        F.when(F.col("event_type") == "error", 75).otherwise(20).cast("long").alias("event_severity"),
        F.concat(F.when(F.col("k") < 50, "10.0.").otherwise("203.0."), (F.col("user_id") % 8).cast("string"), F.lit("."), F.col("k").cast("string")).alias("destination_ip"),
        F.element_at(F.array(*map(F.lit, PORTS)), (F.col("k") % 4 + 1).cast("int")).cast("long").alias("destination_port"),
        F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string"))).alias("process_name"),
        F.col("user_id").alias("process_pid"),
        F.floor(F.col("user_id") / 8).cast("long").alias("parent_pid"),
    )


V_EV = """v_ev AS (
  SELECT 'h0' AS host_id, event_id, ts, user_id, event_type, value, k,
    CASE event_type WHEN 'error' THEN 'authentication' WHEN 'click' THEN 'network' WHEN 'view' THEN 'file' WHEN 'purchase' THEN 'package' WHEN 'signup' THEN 'iam' END AS event_category,
    CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS event_outcome,
    'u' || user_id AS subject_name,
    CAST(CASE WHEN event_type = 'error' THEN 75 ELSE 20 END AS BIGINT) AS event_severity,
    CASE WHEN k < 50 THEN '10.0.' ELSE '203.0.' END || (user_id % 8) || '.' || k AS destination_ip,
    CAST(CASE k % 4 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 ELSE 22 END AS BIGINT) AS destination_port,
    CASE WHEN k % 5 = 0 THEN '' ELSE 'p' || (user_id % 10) END AS process_name,
    user_id AS process_pid, user_id // 8 AS parent_pid
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def v_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0"), F.col("c_acctbal"), F.col("c_mktsegment"))


def v_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.when(F.col("c_custkey") % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    segment = F.when(F.col("c_custkey") % 17 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return _customers(read(spark, sf_dir, "customer").where("c_custkey % 13 <> 0"), balance, segment)


def _customers(rows: DataFrame, balance, segment) -> DataFrame:
    return rows.select(F.lit("h0").alias("host_id"), F.col("c_custkey").alias("key"), "c_name", balance.cast("decimal(18,2)").cast("string").alias("acctbal"), segment.alias("segment"), F.col("c_mktsegment").alias("area"), F.concat(F.lit("w"), (F.col("c_nationkey") % 2).cast("string")).alias("_src"))


V_STATE = """
v_old AS (SELECT c_custkey AS key, c_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS acctbal, c_mktsegment AS segment, c_mktsegment AS area, 'w' || (c_nationkey % 2) AS src FROM customer WHERE c_custkey % 7 <> 0),
v_new AS (SELECT c_custkey AS key, c_name, CAST(CAST(CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS DECIMAL(18,2)) AS VARCHAR) AS acctbal,
  CASE WHEN c_custkey % 17 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment, c_mktsegment AS area, 'w' || (c_nationkey % 2) AS src FROM customer WHERE c_custkey % 13 <> 0),
diff AS (SELECT coalesce(n.key, o.key) AS key, coalesce(n.area, o.area) AS area, coalesce(o.src, n.src) AS src,
    CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.acctbal <> n.acctbal OR o.segment <> n.segment OR o.c_name <> n.c_name THEN 'changed' END AS change,
    o.acctbal AS o_acctbal, n.acctbal AS n_acctbal, o.segment AS o_segment, n.segment AS n_segment
  FROM v_old o FULL JOIN v_new n ON o.key = n.key)"""


def v_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.lit("h0").alias("host_id"), F.col("p_partkey").alias("pid"), F.floor(F.col("p_partkey") / 8).cast("long").alias("ppid"), F.col("p_retailprice").cast("decimal(18,2)").alias("rss"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("pkg"))


def v_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only parents that exist are edges."""
    t = v_tree(spark, sf_dir)
    return t.select("host_id", F.col("pid").alias("child"), F.col("ppid").alias("parent")).join(t.select("host_id", F.col("pid").alias("parent")), ["host_id", "parent"], "left_semi")


V_TREE = """
v_tree AS (SELECT p_partkey AS pid, p_partkey // 8 AS ppid, CAST(p_retailprice AS DECIMAL(18,2)) AS rss, p_name AS name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS pkg FROM part),
closure AS (
  SELECT t.pid AS id, t.ppid AS ancestor, 1 AS depth FROM v_tree t WHERE t.ppid <> t.pid AND t.ppid IN (SELECT pid FROM v_tree)
  UNION ALL
  SELECT c.id, t.ppid, c.depth + 1 FROM closure c JOIN v_tree t ON t.pid = c.ancestor WHERE t.ppid <> t.pid AND t.ppid IN (SELECT pid FROM v_tree) AND c.depth < 12)"""


def v_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    signups = v_ev(spark, sf_dir).where("event_type = 'signup'")
    return signups.select("user_id", F.col("ts").alias("start"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")).alias("end"))


V_IV = "v_iv AS (SELECT user_id, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS end_ts FROM v_ev WHERE event_type = 'signup')"


def v_dep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a part to two others; the numbers wrap around at the number of parts."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"))
    n = part.agg(F.count(F.lit(1)).alias("n"))
    targets = F.explode(F.array((F.col("child") * 7 + 3) % F.col("n"), (F.col("child") * 5 + 1) % F.col("n")))
    return part.join(F.broadcast(n), F.lit(True)).select(F.lit("h0").alias("host_id"), "child", targets.alias("parent")).where("child <> parent").distinct()


V_DEP = """
n AS (SELECT count(*) AS n FROM part),
v_dep AS (SELECT DISTINCT child, parent FROM (
  SELECT p_partkey AS child, unnest([(p_partkey * 7 + 3) % n, (p_partkey * 5 + 1) % n]) AS parent FROM part, n) WHERE child <> parent)"""


def v_strs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation = read(spark, sf_dir, "nation")
    names = nation.select("n_nationkey", F.col("n_name").alias("nation_name"))
    customer = read(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey").withColumn("cust_ref", F.concat(F.lit("cust-"), "c_custkey"))
    supplier = read(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    orders = read(spark, sf_dir, "orders").withColumn("order_ref", F.concat(F.lit("cust-"), "o_custkey")).drop("o_orderdate")
    tables = {"customer": customer, "supplier": supplier, "nation": nation, "region": read(spark, sf_dir, "region"), "orders": orders}
    money = lambda df: df.select(*(F.col(c).cast("decimal(18,2)").cast("string").alias(c) if kind == "double" else F.col(c).cast("string").alias(c) for c, kind in df.dtypes))
    return {k: money(v) for k, v in tables.items()}
