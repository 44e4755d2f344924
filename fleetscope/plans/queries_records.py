"""Records of several lines, and events of snapshots, on lines made from the sample tables: a run of a source for each nation or supplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.operators import parse
from fleetscope.plans.registry import query, stamp
from fleetscope.plans.views import read
from fleetscope.sources import state as S


def _lines(rows: DataFrame, run: str, place: Column, *texts: Column) -> DataFrame:
    """Lines of each row's texts (null: none), one run for each value of ``run``, rows by ``place``."""
    listed = rows.select(F.lit("h0").alias("host_id"), F.col(run).cast("string").alias("run_id"), place.cast("long").alias("_at"), F.posexplode(F.array(*texts)).alias("_k", "line")).where("line IS NOT NULL")
    return listed.select("host_id", "run_id", (F.col("_at") * len(texts) + F.col("_k")).alias("line_no"), "line")


def _text(*parts: str) -> Column:
    """Column names in braces, all else as it is."""
    return F.concat(*(F.col(p[1:-1]).cast("string") if p[:1] == "{" else F.lit(p) for p in parts))


FAR = 1 << 40


@query("""SELECT c_nationkey AS run, 'z' || c_custkey AS zone, 'target' AS item, c_mktsegment AS value FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_nationkey, 'z' || c_custkey, 'services', 'ssh ' || c_custkey FROM customer WHERE c_custkey % 3 > 0 UNION ALL
SELECT c_nationkey, 'policy:p' || c_custkey, 'priority', '-' || c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT c_nationkey, 'global', 'default_zone', 'public' FROM customer""")
def firewall_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    zones = _lines(c.where("c_custkey % 3 > 0"), "c_nationkey", F.col("c_custkey"), _text("z", "{c_custkey}", " (active)"), _text("  target: ", "{c_mktsegment}"), F.lit("  ports:"), _text("\tservices:  ssh ", "{c_custkey}", " "))
    policies = _lines(c.where("c_custkey % 3 = 0"), "c_nationkey", F.col("c_custkey") + 10 * FAR, _text("p", "{c_custkey}", " (active)"), _text("  priority: -", "{c_custkey}"))
    runs = c.select("c_nationkey").distinct()
    marks = _lines(runs, "c_nationkey", F.lit(FAR), F.lit("---POLICIES---")).unionByName(_lines(runs, "c_nationkey", F.lit(FAR * 100), F.lit("---MISC---"), F.lit("default_zone=public"), F.lit("bad line")))
    found = parse.parse_source(zones.unionByName(policies).unionByName(marks), "firewall")
    return found.select(F.col("run_id").cast("int").alias("run"), "zone", "item", "value")


@query("""SELECT s_nationkey AS run, CAST(s_suppkey AS VARCHAR) AS vm_id, 'vm' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'shut off' ELSE 'running' END AS state, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '/d/' || s_name || '; /dev/x' END AS disks, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '52:54:' || s_suppkey END AS networks FROM supplier""")
def virtual_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    head = _lines(s.select("s_nationkey").distinct(), "s_nationkey", F.lit(-1), F.lit(" Id   Name   State"), F.lit("------------"))
    listing = _lines(s, "s_nationkey", F.col("s_suppkey"), F.concat(_text(" ", "{s_suppkey}", "  vm", "{s_suppkey}", "   "), F.when(F.col("s_suppkey") % 2 == 0, "shut off").otherwise("running"), F.lit("  ")))
    xml = _lines(s.where("s_suppkey % 3 > 0"), "s_nationkey", F.col("s_suppkey") + FAR, _text("===VM vm", "{s_suppkey}", "==="), _text("<disk><source file='/d/", "{s_name}", "'/>"), _text("<source dev='/dev/x'/><mac address='52:54:", "{s_suppkey}", "'/></disk>"))
    return parse.parse_source(head.unionByName(listing).unionByName(xml), "vms").select(F.col("run_id").cast("int").alias("run"), "vm_id", "name", "state", "disks", "networks")


@query("""SELECT o_custkey % 25 AS run, 'f' || o_custkey AS name, 'system' AS scope, count(*) FILTER (o_orderkey % 4 <> 0) || ' entries' AS detail, string_agg(CASE WHEN o_orderkey % 4 = 0 THEN ' # ' || o_orderkey ELSE '* * * ' || o_orderkey || ' | run' END, chr(10) ORDER BY o_orderkey) AS content FROM orders GROUP BY o_custkey""")
def cron_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("run", F.col("o_custkey") % 25)
    body = F.when(F.col("o_orderkey") % 4 == 0, _text(" # ", "{o_orderkey}")).otherwise(_text("* * * ", "{o_orderkey}", " | run"))
    lines = _lines(o, "run", F.col("o_orderkey"), F.concat(_text("/etc/cron.d/f", "{o_custkey}", "|"), body))
    return parse.parse_source(lines, "cron").select(F.col("run_id").cast("long").alias("run"), "name", "scope", "detail", "content")


@query("""SELECT c_nationkey AS run, CASE WHEN c_custkey % 4 = 1 THEN '/home/u/' || c_custkey || '.desktop' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'system' ELSE 'user' END AS scope, '/usr/bin/' || c_mktsegment AS detail FROM customer WHERE c_custkey % 5 > 0""")
def autostart_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    where = F.when(k % 2 == 0, "/etc/xdg/autostart/").otherwise("/home/u/")
    lines = _lines(c, "c_nationkey", k, F.concat(F.lit("==> "), where, _text("{c_custkey}", ".desktop")), F.lit("[Desktop Entry]"), F.when(k % 4 != 1, _text("Name=", "{c_name}")), _text("Exec=/usr/bin/", "{c_mktsegment}"), F.when(k % 5 == 0, "Hidden=True"), F.lit("Exec=second"))
    return parse.parse_source(lines, "autostart").select(F.col("run_id").cast("int").alias("run"), "name", "scope", "detail")


@query("""SELECT p_partkey % 25 AS run, CASE p_size % 5 WHEN 0 THEN 'resolv' WHEN 1 THEN 'dns' WHEN 2 THEN 'global' ELSE 'hosts' END AS kind, CASE p_size % 5 WHEN 0 THEN 'nameserver' WHEN 3 THEN p_brand || '  local' ELSE p_brand END AS name, '10.0.0.' || p_partkey AS value FROM part WHERE p_size % 5 <> 4""")
def dns_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = read(spark, sf_dir, "part").withColumn("run", F.col("p_partkey") % 25), F.col("p_size") % 5
    line = F.when(s == 0, _text("resolv\tnameserver  10.0.0.", "{p_partkey}")).when(s == 1, _text("link-dns\t", "{p_brand}", "\t10.0.0.", "{p_partkey}")).when(s == 2, _text("global\t", "{p_brand}", "\t10.0.0.", "{p_partkey}")).when(s == 3, _text("hosts\t10.0.0.", "{p_partkey}", "   ", "{p_brand}", "  local")).otherwise(_text("link-domain\t", "{p_brand}"))
    return parse.parse_source(_lines(p, "run", F.col("p_partkey"), line), "dns").select(F.col("run_id").cast("long").alias("run"), "kind", "name", "value")


@query("""SELECT p_partkey % 25 AS run, 'if' || p_partkey AS iface, CASE WHEN p_size % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS state, '1500' AS mtu, CASE p_size % 3 WHEN 0 THEN 'bridge' WHEN 1 THEN 'tap' ELSE 'ether' END AS kind, CASE WHEN p_size % 4 = 0 THEN 'yes' ELSE '' END AS promisc,
  coalesce(string_agg('10.0.' || l_linenumber || '.' || l_suppkey || '/24', ' ' ORDER BY l_orderkey, l_linenumber, l_suppkey) FILTER (l_linenumber % 2 = 0), '') AS ipv4, coalesce(string_agg('fe80::' || l_suppkey || '/64', ' ' ORDER BY l_orderkey, l_linenumber, l_suppkey) FILTER (l_linenumber % 2 = 1), '') AS ipv6
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size""")
def network_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = read(spark, sf_dir, "part").withColumn("run", F.col("p_partkey") % 25), F.col("p_size")
    kind = F.when(s % 3 == 0, " bridge").when(s % 3 == 1, " tun type tap bridge").otherwise("")
    state, mode = F.when(s % 2 == 0, "UP").otherwise("DOWN"), F.when(s % 4 == 0, "1").otherwise("0")
    older = _text("link\t2: if", "{p_partkey}", ": <UP> mtu 9000 qdisc x state UNKNOWN link/ether 52:54:00:00:00:01")
    links = _lines(p, "run", F.col("p_partkey"), older, _text("addr\t2: if", "{p_partkey}", "    inet 9.9.9.9/8"), F.concat(_text("link\t2: if", "{p_partkey}", "@if3: <UP> mtu 1500 qdisc x state "), state, F.lit(" link/ether 52:54:00:00:00:02 promiscuity "), mode, kind))
    item = read(spark, sf_dir, "lineitem").withColumn("run", F.col("l_partkey") % 25)
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*(F.asc_nulls_last(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey"))))  # an interface's lines only; no number made of keys holds for all of them
    address = F.when(F.col("l_linenumber") % 2 == 0, _text(" inet 10.0.", "{l_linenumber}", ".", "{l_suppkey}", "/24")).when(F.col("l_linenumber") % 2 == 1, _text(" inet6 fe80::", "{l_suppkey}", "/64"))
    lines = links.unionByName(_lines(item.withColumn("place", place), "run", F.col("place") + FAR, F.concat(_text("addr\t2: if", "{l_partkey}", "   "), address)))
    return parse.parse_source(lines, "network").select(F.col("run_id").cast("long").alias("run"), "iface", "state", "mtu", "kind", "promisc", "ipv4", "ipv6")


# Events of snapshots ---------------------------------------------------------------------------------------------------


SEEN = """s AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events), r AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev, lead(day) OVER (ORDER BY day) AS next FROM (SELECT DISTINCT day FROM s)),
c AS (SELECT s.day AS day, user_id, 'appeared' AS action FROM s JOIN r USING (day) WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.day = r.prev AND o.user_id = s.user_id) UNION ALL
  SELECT r.next, user_id, 'vanished' FROM s JOIN r USING (day) WHERE next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.day = r.next AND o.user_id = s.user_id))"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = read(spark, sf_dir, "events").select(F.lit("h0").alias("host_id"), F.to_date("ts").alias("day"), "user_id")
    return S.snapshot_sequence_events(snaps, ["user_id"], "day")


@query(f"""WITH {SEEN} SELECT CAST(day AS VARCHAR) AS day, user_id, CASE action WHEN 'appeared' THEN 'connection_opened' ELSE 'connection_closed' END AS event_action,
CASE WHEN user_id % 4 = 0 THEN 'internal' ELSE 'external' END AS network_direction, CASE WHEN user_id % 3 = 0 THEN 'https' ELSE '' END AS network_application, CAST(CASE WHEN user_id % 3 = 0 THEN 443 ELSE 40000 + user_id END AS BIGINT) AS destination_port,
CAST(CASE WHEN action = 'vanished' OR user_id % 4 = 0 THEN 15 WHEN user_id % 3 = 0 THEN 30 ELSE 40 END AS BIGINT) AS event_severity FROM c WHERE user_id % 5 <> 0""")
def socket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    remote = F.when(u % 5 == 0, "0.0.0.0:*").otherwise(F.concat(F.when(u % 4 == 0, "10.0.0.1").otherwise("[2001:db8::9]"), F.lit(":"), F.when(u % 3 == 0, "443").otherwise((u + 40000).cast("string"))))
    rows = parse.socket_events(_changes(spark, sf_dir).withColumn("proto", F.lit("tcp")).withColumn("local", F.lit("10.0.0.2:5")).withColumn("remote", remote))
    return rows.select(F.col("day").cast("string").alias("day"), "user_id", "event_action", "network_direction", "network_application", "destination_port", "event_severity")


@query(f"""WITH {SEEN} SELECT CAST(day AS VARCHAR) AS day, user_id, CASE action WHEN 'appeared' THEN 'process_started' ELSE 'process_ended' END AS event_action,
CAST(CASE WHEN action = 'vanished' THEN 10 ELSE CASE user_id % 3 WHEN 0 THEN 70 WHEN 1 THEN 45 ELSE 20 END + CASE WHEN user_id % 2 = 0 THEN 5 ELSE 0 END END AS BIGINT) AS event_severity FROM c""")
def process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    rows = _changes(spark, sf_dir).withColumn("exe", F.when(u % 3 == 0, "/var/tmp/x").when(u % 3 == 1, "/home/u/x").otherwise("/usr/bin/x")).withColumn("user", F.when(u % 2 == 0, "root").otherwise("u"))
    return parse.process_events(rows).select(F.col("day").cast("string").alias("day"), "user_id", "event_action", "event_severity")


@query("""SELECT o_orderkey, 'package_' || CASE WHEN o_orderstatus = 'F' THEN 'installed' ELSE lower(o_orderstatus) END AS event_action, strftime(make_timestamp((1700000000 + o_orderkey) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts, 'pkg:p' || o_custkey || ':' || o_orderkey || ':' || (1700000000 + o_orderkey) AS event_id FROM orders WHERE o_orderkey % 7 > 0""")
def package_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("epoch", F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") + 1_700_000_000).cast("string")).otherwise("never")).withColumn("action", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.lower("o_orderstatus")))
    lines = _lines(o, "o_orderpriority", F.col("o_orderkey"), _text("{epoch}", "\tp", "{o_custkey}", "\t", "{o_orderkey}", "\t", "{action}"))
    return parse.package_log(lines).select(F.col("package_version").cast("long").alias("o_orderkey"), "event_action", stamp("ts").alias("ts"), "event_id")


@query("""SELECT event_id, user_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 6 > 0""")
def json_array_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("run_id", F.floor(F.col("event_id") / 50)).withColumn("host_id", F.lit("h0"))
    cell = F.struct("event_id", "user_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    texts = e.where("event_id % 6 > 0").groupBy("host_id", "run_id").agg(F.to_json(F.collect_list(cell)).alias("text")).unionByName(e.where("event_id % 6 = 0").select("host_id", "run_id", F.lit("no array").alias("text")))
    return parse.json_array(texts, "event_id: bigint, user_id: bigint, kind: string, k: bigint").select("event_id", "user_id", "kind", "k")
