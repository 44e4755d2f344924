"""Queries of parsing, privilege, package and detail operators, on lines and tables made from the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions import scalars as SC
from fleetscope.operators import enrich, entities, graph, parse, stats, timeline
from fleetscope.plans.registry import query, stamp
from fleetscope.plans.views import V_EV, V_TREE, read, v_edges, v_ev, v_tree
from fleetscope.sources import lines as LN
from fleetscope.sources import state as S


def _host() -> Column:
    return F.lit("h0").alias("host_id")


def _run() -> Column:
    return F.lit("r").alias("run_id")


def _lines(df: DataFrame, line: Column, no: str) -> DataFrame:
    return df.select(_host(), _run(), F.col(no).alias("line_no"), line.alias("line"))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# Parsing ---------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 10 = 0 THEN upper(o_orderstatus) END AS mark, o_orderpriority AS line FROM orders),
s AS (SELECT n, line, mark, last_value(mark IGNORE NULLS) OVER (ORDER BY n) AS section FROM l)
SELECT n, section, line FROM s WHERE mark IS NULL""")
def sections_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    rows = _lines(o, F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("==="), F.upper("o_orderstatus"), F.lit("==="))).otherwise(F.col("o_orderpriority")), "o_orderkey")
    return LN.with_sections(rows).select(F.col("line_no").alias("n"), "section", "line")


@query("""SELECT p_partkey AS n, p_name AS name, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS kind FROM part WHERE p_size % 5 <> 0""")
def delimited_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    line = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).when(F.col("p_size") % 2 == 0, F.concat_ws("\t", "p_name", "p_brand", "p_type")).otherwise(F.concat_ws("\t", "p_name", "p_brand"))
    return parse.delimited(_lines(part, line, "p_partkey"), ["name", "brand", "kind"], "\t", 2).select(F.col("line_no").alias("n"), "name", "brand", "kind")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 4 <> 0""")
def json_lines_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("noise "), "props")).otherwise(F.col("props"))
    return LN.json_records(_lines(read(spark, sf_dir, "events"), line, "event_id"), "k long").select(F.col("line_no").alias("event_id"), "k")


@query("""SELECT event_id, 'u' || user_id AS user_name, CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS outcome, CAST(user_id AS BIGINT) AS pid,
CASE WHEN event_type = 'click' THEN 'connection_opened' WHEN event_type = 'view' THEN 'file_opened' ELSE 'process_started' END AS action,
CAST(CASE WHEN event_type = 'view' THEN 10 ELSE 20 END + CASE WHEN event_type = 'error' THEN 15 ELSE 0 END + CASE WHEN user_id % 10 = 0 AND event_type NOT IN ('click', 'view') THEN 5 ELSE 0 END AS BIGINT) AS severity FROM events""")
def audit_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    call = F.when(F.col("event_type") == "click", "42").when(F.col("event_type") == "view", "257").otherwise("59")
    first = e.select(_host(), F.lit("b").alias("boot_id"), _text("event_id").alias("audit_id"), F.lit(1).alias("line_no"), F.create_map(F.lit("type"), F.lit("1300")).alias("fields"), F.concat(F.lit("syscall="), call, F.lit(" success="), F.when(F.col("event_type") == "error", "no").otherwise("yes"), F.lit(" pid="), _text("user_id"), F.lit(" uid="), F.when(F.col("user_id") % 10 == 0, "0").otherwise("1000")).alias("message"))
    second = e.select(_host(), F.lit("b").alias("boot_id"), _text("event_id").alias("audit_id"), F.lit(2).alias("line_no"), F.create_map(F.lit("type"), F.lit("1327")).alias("fields"), F.concat(F.lit("syscall=1 msg='acct=\"u"), _text("user_id"), F.lit("\" exe=x'")).alias("message"))
    found = parse.classify_audit(parse.audit_events(parse.audit_records(first.unionByName(second))))
    return found.select(F.col("audit_id").cast("long").alias("event_id"), "user_name", F.col("event_outcome").alias("outcome"), F.col("process_pid").alias("pid"), F.col("event_action").alias("action"), F.col("event_severity").alias("severity"))


@query("""SELECT event_id, user_id AS pid, CASE event_type WHEN 'click' THEN 'connection_opened' WHEN 'view' THEN 'file_modified' WHEN 'error' THEN 'process_ended' ELSE 'process_started' END AS action,
CASE WHEN event_type = 'error' AND (user_id % 3 <> 0) THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN event_type = 'error' THEN CASE user_id % 3 WHEN 0 THEN '0' WHEN 1 THEN 'signal 9' ELSE '1' END ELSE '' END AS code FROM events""")
def exec_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    tab = lambda *c: F.concat_ws("\t", *c)
    pid, at = _text("user_id"), F.concat(_text("event_id"), F.lit("000"))
    status = F.when(F.col("user_id") % 3 == 0, "0").when(F.col("user_id") % 3 == 1, "9").otherwise("256")
    line = F.when(F.col("event_type") == "click", tab(F.lit("N"), at, pid, F.lit("1000"), F.lit("fox"), F.lit("4"), F.lit("203.0.113.9"), F.lit("443"))).when(F.col("event_type") == "view", tab(F.lit("F"), at, pid, F.lit("1000"), F.lit("code"), F.lit("write"), F.lit("/tmp/x.db"))).when(F.col("event_type") == "error", tab(F.lit("X"), at, pid, status)).otherwise(tab(F.lit("E"), at, pid, F.lit("1"), F.lit("1000"), F.lit("ls"), F.lit("/bin/ls -l")))
    boot = read(spark, sf_dir, "region").where("r_regionkey = 0").select(_host(), _run(), F.lit(-1).cast("long").alias("line_no"), F.lit("BTIME 1750000000").alias("line"))
    found = parse.exec_log(boot.unionByName(_lines(e, line, "event_id")))
    return found.select(F.col("line_no").alias("event_id"), F.col("process_pid").alias("pid"), F.col("event_action").alias("action"), F.col("event_outcome").alias("outcome"), F.col("process_exit_code").alias("code"))


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'missing' ELSE CASE WHEN p_size % 2 = 0 THEN 'S' ELSE '.' END || CASE WHEN p_size % 3 = 0 THEN 'M' ELSE '.' END || CASE WHEN p_size % 5 = 0 THEN '5' ELSE '.' END || '......' END AS flags, p_size FROM part)
SELECT p_partkey AS n, flags, CASE WHEN flags = 'missing' THEN '' ELSE concat_ws(', ', CASE WHEN p_size % 2 = 0 THEN 'size' END, CASE WHEN p_size % 3 = 0 THEN 'mode' END, CASE WHEN p_size % 5 = 0 THEN 'digest' END) END AS changed,
CASE WHEN flags = 'missing' THEN 'file_missing' WHEN p_size % 3 = 0 THEN 'file_permissions_changed' ELSE 'file_modified' END AS action FROM f WHERE flags <> '.........'""")
def verify_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    flags = F.concat(F.when(s % 2 == 0, "S").otherwise("."), F.when(s % 3 == 0, "M").otherwise("."), F.when(s % 5 == 0, "5").otherwise("."), F.lit("......"))
    line = F.concat(F.when(s % 7 == 0, F.lit("missing  ")).otherwise(flags), F.lit("    /usr/bin/p"), _text("p_partkey"))
    return parse.verify_events(_lines(read(spark, sf_dir, "part"), line, "p_partkey")).select(F.col("line_no").alias("n"), "flags", "changed", F.col("event_action").alias("action"))


@query("""SELECT l_partkey AS param, CAST(max(l_suppkey) FILTER (l_linenumber = 1) AS VARCHAR) AS declared FROM (SELECT l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_suppkey DESC) AS r FROM lineitem WHERE l_linenumber = 1) WHERE r = 1 GROUP BY 1""")
def kernel_params_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    declared = rows.select(_host(), F.lit("/etc/sysctl.d/50.conf").alias("file"), F.lit(1).alias("priority"), (F.col("l_orderkey") * 100_000 + F.col("l_suppkey")).alias("line_no"), _text("l_partkey").alias("param"), _text("l_suppkey").alias("value"))
    running = read(spark, sf_dir, "part").select(_host(), _text("p_partkey").alias("param"), F.lit("0").alias("value"))
    return parse.kernel_params(declared, running).select(F.col("param").cast("long").alias("param"), "declared")


@query("""SELECT o_custkey AS c, min_by(o_orderpriority, o_orderkey) AS first_priority, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS version, count(*) AS copies FROM orders GROUP BY 1""")
def merge_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("first_priority"), F.col("o_orderstatus").alias("version"))
    return parse.merge_copies(rows, ["c"])


@query("""SELECT p_partkey AS n, round(CAST(CASE WHEN p_size % 3 = 0 THEN p_size * 60 + p_size / 10.0 WHEN p_size % 3 = 1 THEN p_size / 1000.0 ELSE p_size END AS DOUBLE), 3) AS seconds,
CASE WHEN p_size % 3 = 0 OR (p_size % 3 = 2 AND p_size >= 10) THEN 'high' WHEN p_size % 3 = 2 AND p_size >= 3 THEN 'medium' ELSE 'low' END AS impact FROM part""")
def boot_time_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    took = F.when(s % 3 == 0, F.concat(s.cast("string"), F.lit("min "), F.format_string("%.1f", s / 10.0), F.lit("s"))).when(s % 3 == 1, F.concat(s.cast("string"), F.lit("ms"))).otherwise(F.concat(s.cast("string"), F.lit("s")))
    return parse.boot_times(_lines(read(spark, sf_dir, "part"), F.concat(took, F.lit(" unit.service")), "p_partkey")).select(F.col("line_no").alias("n"), "seconds", "impact")


@query("""SELECT page_id, split_part(url, '://', 2) AS path, CASE WHEN page_id % 4 = 0 THEN 'yes' ELSE '' END AS deleted, CASE WHEN page_id % 3 = 0 THEN 'device' ELSE 'file' END AS kind FROM pages""")
def open_file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "/dev/").otherwise("/srv/"), F.regexp_extract("url", r"://(.*)$", 1), F.when(F.col("page_id") % 4 == 0, " (deleted)").otherwise(""))
    line = F.concat_ws("\t", F.lit("1"), F.lit("web"), _text("page_id"), path)
    found = parse.open_files(_lines(read(spark, sf_dir, "pages"), line, "page_id"))
    return found.select(F.col("fd").cast("long").alias("page_id"), F.regexp_replace("path", "^/(dev|srv)/", "").alias("path"), "deleted", "kind")


@query(f"""WITH {V_EV} SELECT event_id, 'user' AS subject_type, subject_name, CASE WHEN event_category = 'network' THEN 'socket' WHEN process_name <> '' THEN 'process' ELSE '' END AS object_type,
CASE WHEN event_category = 'network' THEN destination_ip || ':' || destination_port WHEN process_name <> '' THEN process_name ELSE '' END AS object_name FROM v_ev""")
def subject_object_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir)
    net = F.col("event_category") == "network"
    rows = e.select("event_id", F.col("subject_name").alias("user_name"), F.when(net, F.col("destination_ip")).alias("destination_ip"), F.when(net, F.col("destination_port")).alias("destination_port"), F.col("process_name").alias("process_executable"))
    return parse.subject_object(rows).select("event_id", "subject_type", "subject_name", "object_type", "object_name")


@query("""SELECT doc_id, 60 * 60 * 24 * (doc_id % 3) + 3600 * (doc_id % 24) + 60 * (doc_id % 60) + doc_id % 60 AS seconds FROM documents""")
def elapsed_to_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    etime = F.concat(F.when(d % 3 > 0, F.concat((d % 3).cast("string"), F.lit("-"))).otherwise(""), F.format_string("%02d:%02d:%02d", d % 24, d % 60, d % 60))
    return read(spark, sf_dir, "documents").select("doc_id", SC.elapsed_seconds(etime).alias("seconds"))


# Enrichment and panels ---------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'wheel' ELSE '' END AS admin_groups, CASE WHEN c_custkey = 0 OR c_nationkey % 2 = 0 THEN 'admin' WHEN c_mktsegment = 'BUILDING' THEN 'user' ELSE 'service' END AS privilege FROM customer""")
def user_privileges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    users = c.select(_host(), _text("c_custkey").alias("name"), _text("c_custkey").alias("uid"), F.when(F.col("c_nationkey") % 2 == 0, "users,wheel").otherwise("users").alias("groups"), F.col("c_mktsegment").alias("shell"))
    admin = read(spark, sf_dir, "region").select(_host(), F.lit("wheel").alias("group"))
    shells = c.where("c_mktsegment = 'BUILDING'").select(_host(), F.col("c_mktsegment").alias("shell"))
    return enrich.user_privileges(users, admin, shells).select(F.col("name").cast("long").alias("c_custkey"), "admin_groups", "privilege")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1) THEN 'failed' ELSE 'ok' END AS health FROM supplier""")
def unit_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = read(spark, sf_dir, "supplier").select(_host(), F.lit("system").alias("scope"), _text("s_suppkey").alias("unit"))
    failed = read(spark, sf_dir, "lineitem").where("l_quantity = 50 AND l_linenumber = 1").select(_host(), F.lit("system").alias("scope"), _text("l_suppkey").alias("unit"))
    return enrich.unit_health(units, failed).select(F.col("unit").cast("long").alias("s_suppkey"), "health")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 'yes' ELSE '' END AS exec_risk FROM part""")
def mount_exec_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    mounts = read(spark, sf_dir, "part").select("p_partkey", F.when(s % 4 == 0, "yes").otherwise("").alias("world_writable"), F.when(s % 2 == 0, "yes").otherwise("").alias("user_writable"), F.when(s % 3 == 0, "rw,noexec").otherwise("rw").alias("options"))
    return enrich.mount_exec_risk(mounts).select("p_partkey", "exec_risk")


@query("""WITH own AS (SELECT l_partkey AS k, min(l_suppkey) AS p FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(CAST(a.p AS VARCHAR), CAST(b.p AS VARCHAR), '') AS package FROM orders LEFT JOIN own a ON a.k = o_orderkey % 5000 AND o_orderkey % 3 <> 0 LEFT JOIN own b ON b.k = o_custkey""")
def process_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("/usr/bin/f"), c.cast("string"))
    files = read(spark, sf_dir, "lineitem").select(_host(), path(F.col("l_partkey")).alias("path"), F.col("l_suppkey").alias("package")).groupBy("host_id", "path").agg(F.min("package").cast("string").alias("package"))
    exe = F.when(F.col("o_orderkey") % 3 == 0, "/usr/bin/python3").otherwise(path(F.col("o_orderkey") % 5000))
    procs = read(spark, sf_dir, "orders").select(_host(), F.col("o_orderkey").alias("pid"), exe.alias("exe"), F.concat(exe, F.lit(" --run /bin/f"), _text("o_custkey")).alias("command"))
    return enrich.process_package(procs, files).select(F.col("pid").alias("o_orderkey"), "package")


@query("""WITH k AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity > 48)
SELECT o_orderkey, concat_ws(', ', CASE WHEN o_custkey IN (SELECT p FROM k) THEN '/d/' || o_custkey END, CASE WHEN o_orderkey % 100 <> o_custkey AND o_orderkey % 100 IN (SELECT p FROM k) THEN '/d/' || (o_orderkey % 100) END) AS arg_files FROM orders""")
def argument_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("/d/"), c.cast("string"))
    known = read(spark, sf_dir, "lineitem").where("l_quantity > 48").select(_host(), path(F.col("l_partkey")).alias("path"))
    procs = read(spark, sf_dir, "orders").select(_host(), F.col("o_orderkey").alias("pid"), F.concat_ws(" ", F.lit("/d/run"), path(F.col("o_custkey")), F.lit("-v"), path(F.col("o_orderkey") % 100)).alias("command"))
    return enrich.argument_files(procs, known).select(F.col("pid").alias("o_orderkey"), "arg_files")


@query(f"""WITH {V_EV}, c AS (SELECT p_name AS k, CASE WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey) END AS pid FROM part GROUP BY 1),
s AS (SELECT a AS k, CASE WHEN count(DISTINCT user_id) = 1 THEN min(user_id) END AS pid FROM (SELECT user_id, destination_ip || ':' || destination_port AS a FROM v_ev WHERE event_type = 'click' AND event_id % 7 = 0) GROUP BY 1),
x AS (SELECT event_id, process_pid AS own, CASE WHEN v_ev.event_type = 'view' THEN NULL WHEN event_id % 2 = 0 THEN c.pid END AS named, CASE WHEN event_id % 3 > 0 THEN s.pid END AS bysock, v_ev.event_type = 'view' AS has
  FROM v_ev LEFT JOIN (SELECT p_partkey, p_name FROM part) n ON n.p_partkey = v_ev.k LEFT JOIN c ON c.k = n.p_name LEFT JOIN s ON s.k = destination_ip || ':' || destination_port),
y AS (SELECT event_id, CASE WHEN has THEN own ELSE coalesce(named, bysock) END AS pid, CASE WHEN has THEN '' WHEN named IS NOT NULL THEN 'matched by name' WHEN bysock IS NOT NULL THEN 'matched by socket' ELSE '' END AS source FROM x)
SELECT event_id, pid, source, CASE WHEN pid IS NULL THEN '' WHEN pid IN (SELECT p_partkey FROM part) THEN 'yes' ELSE 'no' END AS alive FROM y""")
def event_process_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, ev = read(spark, sf_dir, "part"), v_ev(spark, sf_dir)
    procs = part.select(_host(), _text("p_partkey").alias("pid"), F.regexp_replace("p_name", " ", "_").alias("command"), F.lit("u").alias("user"), F.lit("").alias("package"))
    names = part.select(F.col("p_partkey").alias("k"), F.regexp_replace("p_name", " ", "_").alias("process_name"))
    ports = ev.where("event_type = 'click' AND event_id % 7 = 0").select(_host(), F.concat_ws(":", "destination_ip", _text("destination_port")).alias("remote"), F.lit("").alias("local"), _text("user_id").alias("pid"))
    e = ev.drop("process_name").join(names, "k", "left")
    sees, i = F.col("event_type") == "view", F.col("event_id")
    e = e.select("host_id", "event_id", F.when(sees, F.col("process_pid")).alias("process_pid"), F.lit("").alias("process_executable"), F.when(i % 2 == 0, F.coalesce("process_name", F.lit(""))).otherwise("").alias("process_name"), F.lit("").alias("object_name"), F.when(i % 3 > 0, F.col("destination_ip")).otherwise("").alias("destination_ip"), F.when(i % 3 > 0, F.col("destination_port")).alias("destination_port"))
    found = enrich.link_events(e, procs, ports)
    return found.select("event_id", F.col("process_pid").alias("pid"), F.coalesce("process_source", F.lit("")).alias("source"), F.col("process_alive").alias("alive"))


@query("""SELECT page_id, CASE WHEN split_part(split_part(url, '://', 2), '/', 2) IN ('en', 'de') THEN split_part(split_part(url, '://', 2), '/', 2) WHEN contains(split_part(url, '://', 2), '/') THEN 'root' END AS owner FROM pages""")
def under_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(_host(), "page_id", F.concat(F.lit("/w/"), F.regexp_extract("url", r"://[^/]*/(.*)$", 1)).alias("path"))
    dirs = read(spark, sf_dir, "documents").where("lang IN ('en', 'de')").select(_host(), F.concat(F.lit("/w/"), "lang").alias("dir"), F.col("lang").alias("owner")).distinct()
    root = read(spark, sf_dir, "region").where("r_regionkey = 0").select(_host(), F.lit("/w").alias("dir"), F.lit("root").alias("owner"))
    return enrich.under_directories(pages, dirs.unionByName(root)).select("page_id", "owner")


@query("""SELECT o_custkey AS pid, 'd' || (o_orderkey % 7) AS dir, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_deleted, array_to_string(list_sort(list_distinct(list('f' || (o_orderkey % 11))))[1:4], ', ') AS names FROM orders GROUP BY 1, 2""")
def files_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    files = o.select(_host(), F.col("o_custkey").alias("pid"), F.concat(F.lit("d"), (F.col("o_orderkey") % 7).cast("string"), F.lit("/f"), (F.col("o_orderkey") % 11).cast("string")).alias("path"), F.when(F.col("o_orderstatus") == "F", "yes").otherwise("").alias("deleted"))
    return stats.files_by_directory(files).drop("host_id")


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS net, coalesce(b.n, 0) AS files FROM a FULL JOIN b ON a.k = b.k""")
def per_process_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_key_counts({"net": read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), "files": read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))}, ["k"])


@query("""SELECT count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus <> 'O') AS n_closed, count(*) FILTER (o_orderkey % 3 = 0) AS n_scored FROM orders""")
def advisory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "7.5").otherwise("n/a").alias("cvss_score"))
    return stats.advisory_counts(rows)


KINDS = ("rpm", "rpm", "rpm", "flatpak", "flatpak-runtime", "pip", "bin", "npm")
PREFIXES, SUFFIXES = ("", "lib", "python3-", "", "glibc-", "gcc", "perl-", ""), ("", "", "", "-devel", "", "", "", "-langpack-de")


@query(f"""WITH b AS (SELECT p_partkey AS k, p_size AS s, {list(KINDS)}[p_partkey % 8 + 1] AS kind, CASE WHEN p_partkey = 8 THEN 'bash' ELSE {list(PREFIXES)}[(p_partkey // 8) % 8 + 1] || 'p' || p_partkey || {list(SUFFIXES)}[(p_partkey // 8) % 8 + 1] END AS name FROM part),
needed AS (SELECT DISTINCT l_partkey AS k FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45 AND l_partkey <> l_suppkey AND l_suppkey IN (SELECT p_partkey FROM part)),
f AS (SELECT b.*, s % 2 = 0 AS u, s % 3 = 0 AS d, s % 4 <> 1 AS bin, s % 7 = 0 AS leaf, s % 5 = 0 AS run, b.k IN (SELECT k FROM needed) AS need,
  name LIKE 'lib%' OR name LIKE 'python3-%' OR name LIKE '%-devel' OR name LIKE 'glibc%' OR name LIKE 'gcc%' OR name LIKE 'perl-%' OR name LIKE '%-langpack-de' AS noise FROM b),
x AS (SELECT *, CASE WHEN u THEN 2 ELSE 0 END + CASE WHEN d THEN 2 ELSE 0 END + CASE WHEN bin THEN 1 ELSE 0 END + CASE WHEN leaf THEN 1 ELSE 0 END + CASE WHEN run THEN 1 ELSE 0 END - CASE WHEN noise AND NOT d THEN 2 ELSE 0 END AS score,
  kind = 'flatpak-runtime' OR need AS served FROM f)
SELECT k, CASE WHEN kind = 'rpm' THEN CASE WHEN score >= 4 AND name <> 'bash' THEN 'program' ELSE 'dependency' END WHEN served OR (kind IN ('pip', 'npm') AND NOT run) THEN 'dependency' ELSE 'program' END AS role,
  CASE WHEN kind = 'rpm' THEN d ELSE kind = 'flatpak' END AS gui, run AS running, CASE WHEN kind = 'rpm' THEN concat_ws(',', CASE WHEN u THEN 'user' END, CASE WHEN d THEN 'desktop' END, CASE WHEN bin THEN 'path-bin' END, CASE WHEN leaf THEN 'leaf' END, CASE WHEN run THEN 'running' END)
    WHEN kind IN ('pip', 'npm') AND NOT served AND NOT run THEN kind || ',library' ELSE kind END AS reasons, CAST(CASE WHEN kind = 'rpm' THEN score ELSE 0 END AS BIGINT) AS score FROM x""")
def program_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (F.floor(k / 8) % 8 + 1).cast("int"))
    own = F.when(k == 8, "bash").otherwise(F.concat(pick(PREFIXES), F.lit("p"), k.cast("string"), pick(SUFFIXES)))
    rows = part.withColumn("name", own).withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), (k % 8 + 1).cast("int")))
    of = lambda cond, *more: rows.where(cond).select(_host(), "name", *more)
    needs = read(spark, sf_dir, "lineitem").where("l_quantity > 45 AND l_partkey <> l_suppkey").select(F.col("l_suppkey").alias("p_partkey"), F.col("l_partkey").alias("needs"))
    needs = needs.join(rows.select(F.col("p_partkey").alias("needs"), F.concat(F.lit("id."), F.col("name")).alias("id")), "needs").groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("id", F.lit("/x86_64/stable")))), ", ").alias("depends"))
    apps = rows.join(needs, "p_partkey", "left").select(_host(), "kind", "name", F.lit("1").alias("version"), F.lit("").alias("path"), F.concat(F.lit("id."), "name").alias("app_id"), F.concat_ws(" ", F.lit("perl(x) nobody"), "depends").alias("depends"))
    files = of("p_size % 4 <> 1", F.lit("/usr/bin/x").alias("path")).unionByName(of("p_size % 3 = 0", F.lit("/usr/share/applications/x.desktop").alias("path"))).withColumnRenamed("name", "package")
    procs = of("p_size % 5 = 0", F.concat(F.lit("/usr/sbin/"), "name", F.lit(": worker -x")).alias("command"))
    found = entities.classify_programs(apps, of("p_size % 2 = 0"), of("p_size % 7 = 0"), files, procs)
    return found.join(rows.select("name", F.col("p_partkey").alias("k")), "name").select("k", "role", "gui", "running", "reasons", F.col("score").cast("long").alias("score"))


@query(f"""WITH RECURSIVE {V_TREE}, {V_EV},
up AS (SELECT id, string_agg(ancestor, ' ← ' ORDER BY depth) AS s FROM closure GROUP BY 1), down AS (SELECT ppid AS id, count(*) AS n FROM v_tree WHERE pid <> ppid GROUP BY 1),
ev AS (SELECT process_pid AS id, count(*) AS n FROM v_ev GROUP BY 1), ord AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT pid, coalesce(up.s, '') AS ancestors, least(coalesce(down.n, 0), 25) AS n_children, coalesce(kids, '') AS children, coalesce(ord.n, 0) AS n_sockets, coalesce(files.n, 0) AS n_files, coalesce(ev.n, 0) AS n_events FROM v_tree LEFT JOIN up ON up.id = pid LEFT JOIN down ON down.id = pid LEFT JOIN ev ON ev.id = pid LEFT JOIN ord ON ord.id = pid
  LEFT JOIN (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1) files ON files.id = pid LEFT JOIN (SELECT ppid AS id, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY CAST(pid AS VARCHAR)) AS kids FROM v_tree WHERE pid <> ppid GROUP BY 1) ch ON ch.id = pid""")
def process_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetscope.operators import hierarchy

    socks = read(spark, sf_dir, "orders").select(_host(), F.col("o_custkey").alias("pid"))
    closure = hierarchy.ancestors(v_edges(spark, sf_dir), 12)
    files = read(spark, sf_dir, "lineitem").select(_host(), F.col("l_partkey").alias("pid"))
    found = timeline.process_detail(v_tree(spark, sf_dir), closure, socks, files, v_ev(spark, sf_dir))
    return found.select("pid", "ancestors", "n_children", "children", "n_sockets", "n_files", "n_events")


@query(f"""WITH {V_EV}, n AS (SELECT DISTINCT destination_ip AS node FROM v_ev WHERE event_category = 'network'),
e AS (SELECT node, event_id, event_type AS line, row_number() OVER (PARTITION BY node ORDER BY ts DESC, event_id) AS r FROM n JOIN v_ev ON destination_ip = node)
SELECT node, 'event' AS kind, line FROM e WHERE r <= 8 UNION ALL
SELECT node, 'related: procs', process_name FROM (SELECT node, process_name, row_number() OVER (PARTITION BY node ORDER BY process_name) AS r FROM (SELECT DISTINCT node, process_name FROM n JOIN v_ev ON destination_ip = node)) WHERE r <= 6""")
def node_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir)
    nodes = e.where("event_category = 'network'").select(F.col("destination_ip").alias("node")).distinct()
    return graph.node_detail(nodes, {"procs": (e, "destination_ip", "process_name")}, e.withColumn("message", F.col("event_type")), ["destination_ip"])


@query("""WITH b AS (SELECT DISTINCT date_trunc('week', ts) AS started FROM events), l AS (SELECT user_id, ts AS s, ts + INTERVAL 2 DAY AS u FROM events WHERE event_type = 'signup'),
p AS (SELECT event_id AS pid, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT pid, strftime((SELECT max(started) FROM b WHERE started <= p.ts), '%Y-%m-%d %H:%M:%S') AS boot_started,
strftime(coalesce((SELECT max(s) FROM l WHERE l.user_id = p.user_id AND s <= p.ts AND p.ts < u), (SELECT max(s) FROM l WHERE l.user_id = p.user_id AND s <= p.ts)), '%Y-%m-%d %H:%M:%S') AS login_start FROM p""")
def origin_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_ev(spark, sf_dir)
    week = F.date_trunc("week", "ts")
    boots = e.select(_host(), week.alias("started")).distinct().withColumn("ended", F.col("started") + F.expr("INTERVAL 7 DAY"))
    logins = e.where("event_type = 'signup'").select(_host(), F.col("user_id").alias("user"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("until"))
    procs = e.where("event_type = 'purchase'").select(_host(), F.col("event_id").alias("pid"), F.col("user_id").alias("user"), F.col("ts").alias("start_ts"))
    found = graph.origin_spine(procs, logins, boots)
    return found.select("pid", stamp("boot_started").alias("boot_started"), stamp("login_start").alias("login_start"))


@query("""SELECT c_custkey AS key, 'w1' AS src FROM customer WHERE c_custkey % 7 <> 0 AND c_nationkey % 2 = 1""")
def clear_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetscope.plans.views import v_old

    old = v_old(spark, sf_dir)
    return S.apply_snapshot(old, old.limit(0), ["host_id", "key"], "w0").select(F.col("key").cast("long").alias("key"), F.col("_src").alias("src"))


@query("""SELECT kind, k, a, b FROM (SELECT 'n' AS kind, CAST(n_nationkey AS VARCHAR) AS k, n_name AS a, '' AS b FROM nation UNION ALL SELECT 'r', CAST(r_regionkey AS VARCHAR), '', r_name FROM region)""")
def union_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.lit("n").alias("kind"), _text("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    r = read(spark, sf_dir, "region").select(F.lit("r").alias("kind"), _text("r_regionkey").alias("k"), F.col("r_name").alias("b"))
    return S.union_schema(n, r, keys=["k"])
