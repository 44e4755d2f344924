"""Owners and neighbours of processes, journal records, privilege vectors, entities: operators on tables made from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators import entities, graph, parse, records, stats
from fleetscope.operators.enrich import owner_pid
from fleetscope.plans.registry import query
from fleetscope.plans.views import read


def _host():
    return F.lit("h0").alias("host_id")


def _text(c: str):
    return F.col(c).cast("string")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS pid FROM orders""")
def owner_pids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("app ("), _text("o_custkey"), F.lit(")"))).otherwise("nobody").alias("process"), F.when(k % 3 <= 1, F.concat(F.lit("x("), _text("o_orderkey"), F.lit(") y"))).otherwise(None).alias("owner"))
    return rows.select("o_orderkey", owner_pid("process", "owner").alias("pid"))


@query("""WITH a AS (SELECT l_orderkey AS k, min(l_partkey) AS pid FROM lineitem WHERE l_quantity > 40 GROUP BY 1), b AS (SELECT c_custkey AS k, min(c_nationkey) + 1000000 AS pid FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT o_orderkey, coalesce(a.pid, b.pid) AS pid FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN b ON b.k = o_custkey""")
def owner_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    sockets = read(spark, sf_dir, "lineitem").where("l_quantity > 40").select(_host(), F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("pid"))
    files = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(_host(), F.col("c_custkey").alias("key"), (F.col("c_nationkey") + 1_000_000).cast("long").alias("pid"))
    found = graph.owner_process(read(spark, sf_dir, "orders").select(_host(), "o_orderkey", "o_custkey"), [(sockets, "o_orderkey"), (files, "o_custkey")])
    return found.select("o_orderkey", "pid")


@query("""SELECT c_custkey AS pid, 'user' AS kind, 'u' || c_nationkey AS target, 1 AS n FROM customer UNION ALL SELECT c_custkey, 'package', c_mktsegment, 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL
SELECT o_custkey, 'socket', 'l' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' → r' ELSE '' END, 1 FROM orders UNION ALL SELECT o_custkey, 'directory', '/d' || (o_orderkey % 7), count(*) FROM orders GROUP BY 1, 3 UNION ALL
SELECT c_custkey, 'service', s_name, 1 FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE s_suppkey % 2 = 0""")
def process_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, k = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), F.col("o_orderkey")
    procs = c.select(_host(), F.col("c_custkey").alias("pid"), F.concat(F.lit("u"), _text("c_nationkey")).alias("user"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("package"))
    socks = o.select(_host(), F.col("o_custkey").alias("pid"), F.concat(F.lit("l"), _text("o_orderkey")).alias("local"), F.when(k % 2 == 0, "r").otherwise("").alias("remote"))
    files = o.select(_host(), F.col("o_custkey").alias("pid"), F.concat(F.lit("/d"), (k % 7).cast("string"), F.lit("/f")).alias("path"), F.lit("").alias("deleted"))
    services = read(spark, sf_dir, "supplier").select(_host(), F.when(F.col("s_suppkey") % 2 == 0, "user").otherwise("system").alias("scope"), F.concat(F.lit("u"), _text("s_nationkey")).alias("owner"), F.col("s_name").alias("unit"))
    return graph.process_edges(procs, socks, files, services).select("pid", "kind", "target", "n")


@query("""SELECT '/p' || (l_partkey % 500) AS path, count(*) AS fds, CASE WHEN bool_or(l_returnflag = 'R') THEN 'yes' ELSE '' END AS deleted FROM lineitem GROUP BY 1""")
def open_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(_host(), F.concat(F.lit("/p"), (F.col("l_partkey") % 500).cast("string")).alias("path"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("").alias("deleted"))
    return stats.open_file_counts(rows).drop("host_id")


@query("""WITH a AS (SELECT p_name || p_partkey AS advisory, CASE WHEN p_size % 2 = 0 THEN 'open' ELSE 'closed' END AS status, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 10.0 END AS score, p_partkey % 5 AS s FROM part)
SELECT advisory, row_number() OVER (ORDER BY CASE WHEN status = 'open' THEN 0 ELSE 1 END, score DESC NULLS LAST, s, advisory) AS place FROM a QUALIFY place <= 100""")
def advisory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of the ordered list, with their places."""
    s, p = F.col("p_size"), F.element_at(F.array(*map(F.lit, ("Critical", "important", "MODERATE", "low", "none"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.concat("p_name", _text("p_partkey")).alias("advisory"), F.when(s % 2 == 0, "open").otherwise("closed").alias("status"), F.when(s % 5 == 0, "n/a").otherwise((s / 10.0).cast("string")).alias("cvss_score"), p.alias("severity"))
    first = stats.advisory_order(rows).limit(100).select(F.collect_list("advisory").alias("a"))
    return first.select(F.posexplode("a").alias("k", "advisory")).select("advisory", (F.col("k") + 1).cast("long").alias("place"))


MESSAGES = ("Started Daily job.", "Failed to start web.service", "Stopped x", "Reloaded y.", "Accepted key from 203.0.113.7 port 2", "usb 1-1: new device", "hello")
NAMES = ("systemd", "systemd", "Systemd", "systemd", "sshd", "kernel", "app")


@query(f"""WITH j AS (SELECT event_id, event_id % 7 AS m, event_id % 6 AS p FROM events),
x AS (SELECT *, {['service_started', 'service_failed', 'service_stopped', 'service_reloaded', 'authentication', 'kernel_message', 'log']}[m + 1] AS event_action, p <= 3 OR m = 1 AS bad FROM j)
SELECT 'journal:c' || event_id AS event_id, event_action, CASE WHEN m < 4 THEN 'process' WHEN m = 4 THEN 'authentication' ELSE 'host' END AS event_category, CASE m WHEN 0 THEN 'Daily job' WHEN 1 THEN 'web.service' WHEN 2 THEN 'x' WHEN 3 THEN 'y' ELSE '' END AS service_name,
  CASE WHEN bad THEN 'failure' ELSE 'success' END AS event_outcome, CAST(CASE WHEN m = 4 THEN 25 WHEN m < 4 THEN 15 ELSE 10 END + CASE WHEN bad THEN 25 ELSE 0 END AS BIGINT) AS event_severity, CASE WHEN m = 4 THEN '203.0.113.7' ELSE '' END AS source_ip FROM x""")
def journal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (k % 7 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(pick(NAMES).alias("identifier"), (k % 6).cast("string").alias("priority"), pick(MESSAGES).alias("message"), F.concat(F.lit("c"), _text("event_id")).alias("cursor"))
    return parse.journal_events(rows).select("event_id", "event_action", "event_category", "service_name", "event_outcome", "event_severity", "source_ip")


@query("""WITH m AS (SELECT s_nationkey AS run, max(strftime(DATE '2026-01-10' - CAST(s_suppkey % 50 AS INTEGER), '%Y-%m-%d') || ' 06:00:00') AS newest FROM supplier WHERE s_suppkey % 4 = 2 GROUP BY 1)
SELECT s_nationkey AS run, CASE s_suppkey % 4 WHEN 0 THEN 'capability' WHEN 1 THEN 'sudo' ELSE 'sudoers' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN '/usr/bin/' || s_name WHEN 1 THEN '/bin/x ' || s_suppkey ELSE 'u ALL=(root) ' || CASE WHEN s_suppkey % 3 = 0 THEN 'NOPASSWD: ' ELSE '' END || s_suppkey END AS name,
  CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'cap_bpf,cap_net_raw=ep' ELSE 'cap_net_raw=ep' END WHEN 1 THEN 'runas root' ELSE '' END AS detail, CASE WHEN s_suppkey % 3 = 0 THEN 'high' ELSE 'info' END AS risk, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 > 0 THEN 'yes' ELSE '' END AS nopasswd,
  CASE s_suppkey % 4 WHEN 0 THEN 'getcap' WHEN 1 THEN 'sudo -l' ELSE '/etc/sudoers.d/' || s_suppkey END AS source, CASE s_suppkey % 4 WHEN 0 THEN strftime(DATE '2026-01-10' - CAST(s_suppkey % 50 AS INTEGER), '%Y-%m-%d') || ' 06:00:00' WHEN 1 THEN coalesce(newest, '') WHEN 2 THEN strftime(DATE '2026-01-10' - CAST(s_suppkey % 50 AS INTEGER), '%Y-%m-%d') || ' 06:00:00' ELSE '' END AS changed,
  CASE s_suppkey % 4 WHEN 1 THEN datediff('day', CAST(newest[:10] AS DATE), DATE '2026-01-10') WHEN 3 THEN NULL ELSE s_suppkey % 50 END AS age_days
FROM supplier LEFT JOIN m ON run = s_nationkey""")
def privilege_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = read(spark, sf_dir, "supplier").select(_host(), _text("s_nationkey").alias("run_id"), "s_suppkey", "s_name"), F.col("s_suppkey")
    number, free = _text("s_suppkey"), F.when(k % 3 == 0, "NOPASSWD: ").otherwise("")
    caps = F.concat(F.lit("/usr/bin/"), "s_name", F.lit(" "), F.when(k % 3 == 0, "cap_bpf,cap_net_raw=ep").otherwise("cap_net_raw=ep"))
    sudo = F.concat(F.lit("    (root) "), free, F.lit("/bin/x "), number)
    rule = F.concat(F.lit("/etc/sudoers.d/"), number, F.lit("\tu ALL=(root) "), free, number)
    at = F.concat(F.expr("cast(date_sub(date'2026-01-10', cast(s_suppkey % 50 as int)) as string)"), F.lit(" 06:00:00.5\t"), F.when(k % 4 == 0, F.concat(F.lit("/usr/bin/"), "s_name")).otherwise(F.concat(F.lit("/etc/sudoers.d/"), number)))
    parts = ((0, "CAPS", k % 4 == 0, caps), (1, "SUDO", k % 4 == 1, sudo), (2, "SUDOERS", k % 4 >= 2, rule), (3, "MTIME", (k % 4 == 0) | (k % 4 == 2), at))
    lines = None
    for place, name, where, line in parts:
        piece = s.where(where).select("host_id", "run_id", (k + place * 10**9 + 1).alias("line_no"), line.alias("line")).unionByName(s.select("host_id", "run_id", F.lit(place * 10**9).cast("long").alias("line_no"), F.lit(f"==={name}===").alias("line")).distinct())
        lines = piece if lines is None else lines.unionByName(piece)
    found = records.privilege_vectors(lines, F.lit("2026-01-10 12:00:00").cast("timestamp"))
    return found.select(F.col("run_id").cast("int").alias("run"), "kind", "name", "detail", "risk", "nopasswd", "source", "changed", "age_days")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS pid, p_partkey // 8 AS ppid, p_size, p_brand, CASE p_size % 5 WHEN 0 THEN 'vendor' WHEN 1 THEN 'product' WHEN 2 THEN 'package' WHEN 3 THEN 'kernel' ELSE 'exe' END AS tier,
    CASE p_size % 5 WHEN 0 THEN p_brand WHEN 1 THEN 'firefox' WHEN 2 THEN 'pkg' || (p_size % 4) WHEN 3 THEN 'kernel' ELSE 'helper' || (p_size % 3) END AS entity, CAST(round(p_retailprice) AS BIGINT) AS rss FROM part),
w AS (SELECT pid, tier || '|' || entity AS k FROM p WHERE tier <> 'exe' UNION ALL SELECT c.pid, w.k FROM w JOIN p c ON c.ppid = w.pid WHERE c.tier = 'exe' AND c.ppid > 1 AND c.pid <> c.ppid),
own AS (SELECT p.*, coalesce(w.k, tier || '|' || entity) AS k FROM p LEFT JOIN w ON w.pid = p.pid),
s AS (SELECT l_partkey AS pid, count(*) FILTER (l_linenumber = 1) AS ports, count(*) FILTER (l_linenumber = 2) AS connections, max(CASE l_linenumber WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END) AS worst FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT split_part(k, '|', 1) AS tier, split_part(k, '|', 2) AS entity, count(*) AS pids, CAST(sum(rss) AS DOUBLE) AS rss_mb, CAST(coalesce(sum(ports), 0) AS BIGINT) AS ports, CAST(coalesce(sum(connections), 0) AS BIGINT) AS connections, coalesce(max(worst), 0) AS exposure, array_to_string(list_sort(list(DISTINCT 'u' || (p_size % 3))), ', ') AS users
FROM own LEFT JOIN s ON s.pid = own.pid GROUP BY 1, 2""")
def process_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, part, n = F.col("p_size") % 5, read(spark, sf_dir, "part"), F.col("l_linenumber")
    exe = F.when(s == 0, F.concat(F.lit("/opt/"), "p_brand", F.lit("/run"))).when(s == 1, "/usr/lib/firefox/firefox").when(s == 2, "/usr/bin/tool").when(s == 3, "").otherwise(F.concat(F.lit("/home/u/helper"), (F.col("p_size") % 3).cast("string")))
    procs = part.select(_host(), _text("p_partkey").alias("pid"), F.floor(F.col("p_partkey") / 8).cast("string").alias("ppid"), exe.alias("exe"), F.when(s == 3, "[kworker]").otherwise(exe).alias("command"), F.when(s == 2, F.concat(F.lit("pkg"), (F.col("p_size") % 4).cast("string"))).otherwise("").alias("package"), F.concat(F.lit("u"), (F.col("p_size") % 3).cast("string")).alias("user"), F.round("p_retailprice").cast("long").cast("string").alias("rss_mb"), F.lit("0").alias("cpu"), F.lit("01:00").alias("elapsed"))
    apps = read(spark, sf_dir, "region").where("r_regionkey = 0").select(_host(), F.lit("Firefox").alias("name"))
    socks = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(_host(), _text("l_partkey").alias("pid"), F.when(n == 1, "LISTEN").otherwise("ESTAB").alias("state"), F.when(n == 2, "203.0.113.1:5").otherwise("").alias("remote"), F.when(n == 1, "OPEN (exposed)").when(n == 2, "local-only").otherwise("established").alias("exposure"))
    found = entities.entities(procs, apps, socks)
    return found.select("tier", "entity", "pids", "rss_mb", F.col("ports").cast("long").alias("ports"), F.col("connections").cast("long").alias("connections"), "exposure", "users")
