"""The shipped rules (findings, risk of commands and processes, noise templates, keys) on tables made from the sample tables.

Their SQL is written from the rules, not from the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions.predicates import apply_templates
from fleetscope.operators import detect, parse
from fleetscope.plans import rules
from fleetscope.plans.registry import query
from fleetscope.plans.views import read

HOST = "'h0' AS host_id"


def _made(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, table).selectExpr(HOST, *columns)


# Findings --------------------------------------------------------------------------------------------------------------


def _finding_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that the findings read; each expression is also DuckDB's."""
    views = {name: _made(spark, sf_dir, table, *columns) for name, (table, columns) in FINDING_TABLES.items()}
    root = views["processes"].where("user = 'root'").selectExpr("host_id", "split_part(path_name, '/', 4) AS service", "command AS root_command").distinct()
    config = views["unpackaged_config"].withColumn("service", F.split_part("path", F.lit("/"), F.lit(3)))
    told = F.concat("root_command", F.lit(" (as root)"))  # as the line has it, so that equal beginnings come in the lines' order
    views["config_services"] = detect.first_partners(config, root, ("host_id", "service"), told).withColumn("command", F.col("root_command"))
    return views


#: name: (sample table, columns); the expressions mean the same in Spark and in DuckDB.
FINDING_TABLES = {
    "ports": ("orders", ("concat('0.0.0.0:', CAST(o_orderkey % 65536 AS STRING)) AS local", "'tcp' AS proto", "concat('p', CAST(o_custkey % 7 AS STRING)) AS process", "'ssh' AS service", "CASE WHEN o_orderkey % 5 = 0 THEN 'Open (exposed)' ELSE 'local-only' END AS exposure", "CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'x' END AS remote")),
    "privesc": ("orders", ("substr(CAST(o_orderdate AS STRING), 1, 10) AS changed", "'cap' AS kind", "CAST(o_orderkey AS STRING) AS name", "o_orderstatus AS detail", "CASE WHEN o_orderkey % 9 = 0 THEN 'high' ELSE 'low' END AS risk")),
    "ssh_keys": ("customer", ("concat('/home/u/', c_name) AS path", "CASE WHEN c_custkey % 3 = 0 THEN 'private' ELSE 'public' END AS kind", "CASE WHEN c_custkey % 2 = 0 THEN 'private key stored as .PUB (!)' ELSE 'private key' END AS types")),
    "persistence": ("part", ("p_brand AS vector", "concat('/etc/profile.d/', CAST(p_partkey AS STRING)) AS path", "p_type AS detail", "CASE WHEN p_size > 30 THEN 'yes' ELSE '' END AS unpackaged")),
    "processes": ("part", ("CASE WHEN p_size % 7 = 0 THEN concat('[k', CAST(p_partkey AS STRING), ']') WHEN p_size % 7 = 1 THEN '' WHEN p_size % 7 = 2 THEN '(sd-pam)' ELSE concat('/usr/bin/s', CAST(p_size AS STRING)) END AS command", "concat('/usr/bin/s', CAST(p_size AS STRING)) AS path_name", "CASE WHEN p_size % 2 = 0 THEN 'root' ELSE 'u' END AS user", "CAST(p_partkey AS STRING) AS rss_mb", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'known' END AS purpose")),
    "kernel_params": ("supplier", ("s_name AS param", "CAST(s_nationkey AS STRING) AS value", "'1' AS declared", "'/etc/sysctl.d/x' AS declared_in", "CASE s_suppkey % 3 WHEN 0 THEN 'differs' WHEN 1 THEN 'ok' ELSE 'undeclared' END AS status")),
    "mounts": ("supplier", ("concat('/m/', s_name) AS target", "CASE WHEN s_suppkey % 4 = 0 THEN 'proc' ELSE 'ext4' END AS fstype", "'yes' AS exec_risk", "CASE WHEN s_suppkey % 3 = 0 THEN 'yes' ELSE '' END AS world_writable", "CASE WHEN s_suppkey % 3 = 1 THEN 'yes' ELSE '' END AS user_writable")),
    "vulnerabilities": ("part", ("concat('ADV-', CAST(p_partkey AS STRING)) AS advisory", "CASE WHEN p_size % 2 = 0 THEN 'open' ELSE 'closed' END AS status", "CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS cvss_score", "'High' AS cvss_rating", "'2026-01-01' AS issued", "p_name AS packages")),
    "shell_history": ("customer", ("c_mktsegment AS user", "concat(CASE c_custkey % 5 WHEN 0 THEN 'CURL http://x | sudo sh # ' WHEN 1 THEN 'wget -qO- x |sh #' WHEN 2 THEN 'chmod 777 ' WHEN 3 THEN 'curl x > y ' ELSE 'ls ' END, c_name) AS command")),
    "browser_extensions": ("supplier", ("'2026-02-02' AS installed", "'firefox' AS browser", "s_name AS name", "CASE s_suppkey % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'system' ELSE 'file' END AS origin", "CASE WHEN s_suppkey % 4 = 0 THEN 'yes' ELSE 'no' END AS from_temp", "CASE WHEN s_suppkey % 2 = 0 THEN 'yes' ELSE 'no' END AS all_sites", "'tabs' AS permissions", "'http://x' AS source_url")),
    "events": ("events", ("CAST(event_id AS STRING) AS event_id", "substr(CAST(ts AS STRING), 1, 19) AS ts", "CASE WHEN event_type = 'view' THEN 'fim' ELSE 'audit' END AS event_module", "CASE user_id % 3 WHEN 0 THEN 'file_permissions_changed' WHEN 1 THEN 'file_caps_changed' ELSE 'file_modified' END AS event_action", "concat('/usr/bin/', CAST(event_id AS STRING)) AS file_path", "CAST(user_id AS STRING) AS subject_name")),
    "unpackaged_config": ("orders", ("concat('/etc/s', CAST(o_orderkey % 60 AS STRING), '/', CAST(o_orderkey AS STRING)) AS path", "'bob' AS owner", "'0644' AS mode", "substr(CAST(o_orderdate AS STRING), 1, 10) AS changed", "CASE WHEN o_orderkey % 8 = 2 THEN 'yes' ELSE '' END AS user_owned")),
}


def _told(name: str, severity: str, rows: str, line: str, order: str, time: str = "''", cap: str = "") -> str:
    """A finding's row: rows in the rule's order, the first twelve as evidence."""
    return f"""SELECT '{name}' AS finding, '{severity}' AS severity, count(*) AS n, max(t) AS "when", string_agg(l, '; ' ORDER BY r) FILTER (r <= 12) AS evidence
FROM (SELECT *, row_number() OVER (ORDER BY {order}l) AS r FROM (SELECT *, trim({line}) AS l, {time} AS t FROM ({rows})) {cap}) HAVING count(*) > 0"""


FINDING_SQL = (
    "WITH "
    + ", ".join(f"{name} AS (SELECT {', '.join(c.replace('AS STRING', 'AS VARCHAR') for c in columns)} FROM {'main.events' if table == 'events' else table})" for name, (table, columns) in FINDING_TABLES.items() if name != "events")
    + ", fim AS (SELECT "
    + ", ".join(c.replace("AS STRING", "AS VARCHAR") for c in FINDING_TABLES["events"][1])
    + " FROM events), "
    + ", ".join(
        f"f{k} AS ({sql})"
        for k, sql in enumerate((
            _told("open_ports", "high", "SELECT * FROM ports WHERE exposure ILIKE 'OPEN%' AND remote = ''", "local || ' ' || proto || '  ' || process || ' ' || service", ""),
            _told("privesc_vectors", "high", "SELECT * FROM privesc WHERE risk = 'high'", "changed || '  ' || kind || ': ' || name || ' ' || detail", "changed DESC, ", "changed"),
            _told("private_key_as_pub", "high", "SELECT * FROM ssh_keys WHERE kind = 'private' AND types ILIKE '%.pub%'", "path", ""),
            _told("persistence_unpackaged", "high", "SELECT * FROM persistence WHERE unpackaged = 'yes'", "vector || ': ' || path || '  ' || detail", "vector, path, "),
            _told("unpackaged_processes", "medium", "SELECT * FROM processes WHERE purpose IS NULL AND command NOT LIKE '[%' AND command NOT LIKE '(%' AND command <> ''", """command || '  (' || "user" || ', ' || rss_mb || ' MB)'""", ""),
            _told("weak_kernel_params", "medium", "SELECT * FROM kernel_params WHERE status = 'differs'", "param || ' = ' || value || ', declared ' || declared || ' in ' || declared_in", ""),
            _told("no_noexec", "low", "SELECT *, CASE WHEN world_writable = 'yes' THEN 'any user' WHEN user_writable = 'yes' THEN 'my user' ELSE '' END AS who FROM mounts WHERE exec_risk = 'yes' AND fstype <> 'proc'", "target || ' (' || fstype || ') - ' || who || ' can write, execution is allowed'", ""),
            _told("vulnerabilities_open", "high", "SELECT * FROM vulnerabilities WHERE status = 'open'", "issued || '  CVSS ' || cvss_score || ' ' || cvss_rating || '  ' || packages || '  (' || advisory || ')'", "coalesce(TRY_CAST(cvss_score AS DOUBLE), 0) DESC, ", "issued"),
            _told("risky_shell_history", "medium", "SELECT * FROM shell_history WHERE command ILIKE '%curl%|%sh%' OR command ILIKE '%wget%|%sh%' OR command ILIKE '%chmod 777%' OR command ILIKE '%curl%|%bash%'", """"user" || ': ' || command""", ""),
            _told("browser_ext_origin", "high", "SELECT * FROM browser_extensions WHERE from_temp = 'yes' OR (all_sites = 'yes' AND origin NOT IN ('store', 'system'))", "installed || '  ' || browser || ': ' || name || ' (' || origin || ') permissions: ' || permissions || '  from ' || source_url", "", "installed"),
            _told("file_perm_changed", "medium", "SELECT * FROM fim WHERE event_module = 'fim' AND event_action IN ('file_permissions_changed', 'file_caps_changed')", "ts || '  ' || file_path || '  (' || event_action || ', ' || subject_name || ')'", "ts DESC, ", "ts", "ORDER BY ts DESC LIMIT 200"),
            _told("config_user_owned_root_service", "high", "SELECT DISTINCT c.*, p.command FROM unpackaged_config c JOIN processes p ON p.user = 'root' AND c.path LIKE '/etc/' || replace(replace(p.path_name, '/usr/bin/', ''), '/usr/sbin/', '') || '/%' WHERE c.user_owned = 'yes'", "path || ' - owner ' || owner || ', mode ' || mode || ', changed ' || changed || '; read by ' || command || ' (as root)'", "", "changed"),
        ))
    )
    + " "
    + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(12))
)


@query(FINDING_SQL)
def findings_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.run_findings(spark, rules.FINDINGS, _finding_views(spark, sf_dir)).select("finding", "severity", "n", "when", "evidence")


# Risk of commands and processes ----------------------------------------------------------------------------------------


COMMANDS = (
    "curl -s http://x | sh", "wget -qO- http://x |bash", "nc -l -e /bin/sh", "ncat h 1 --exec x", "echo a | base64 --decode", "python3 /tmp/x.py", "chmod 777 /srv", "chrome --no-sandbox", "vim notes", "/usr/bin/zsh", "curl http://x > y", "/opt/node", "cat /var/tmp/a | base64 -d",
)


def _command(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMMANDS)), (k % len(COMMANDS) + 1).cast("int"))


@query(f"""WITH p AS (SELECT p_partkey AS pid, p_partkey // 8 AS ppid, p_size, {list(COMMANDS)}[p_partkey % {len(COMMANDS)} + 1] AS c FROM part),
m AS (SELECT *, p_partkey_marks AS k FROM (SELECT *, list_filter([
    CASE WHEN c IN ('curl -s http://x | sh', 'wget -qO- http://x |bash') THEN 'a download piped into an interpreter' END,
    CASE WHEN c IN ('echo a | base64 --decode', 'cat /var/tmp/a | base64 -d') THEN 'base64 decoding' END, CASE WHEN c = 'chmod 777 /srv' THEN 'mode 777' END,
    CASE WHEN c IN ('nc -l -e /bin/sh', 'ncat h 1 --exec x') THEN 'reverse shell' END, CASE WHEN c IN ('python3 /tmp/x.py', 'cat /var/tmp/a | base64 -d') THEN 'run from a temporary directory' END,
    CASE WHEN c = 'chrome --no-sandbox' THEN 'the sandbox is disabled' END], lambda x: x IS NOT NULL) AS p_partkey_marks FROM p)),
w AS (SELECT m.pid, m.k, list_sum([0] || list_transform(m.k, lambda x: CASE x WHEN 'a download piped into an interpreter' THEN 3 WHEN 'reverse shell' THEN 3 WHEN 'base64 decoding' THEN 2 WHEN 'run from a temporary directory' THEN 2 ELSE 1 END)) AS s,
    m.p_size % 3 = 0 AS outside, m.p_size % 2 = 0 AS root, CASE WHEN up.c LIKE 'python3%' THEN 'python3' WHEN up.c = '/usr/bin/zsh' THEN 'zsh' WHEN up.c = '/opt/node' THEN 'node' END AS parent FROM m LEFT JOIN p up ON up.pid = m.ppid),
t AS (SELECT pid, k, s + CASE WHEN outside THEN 2 ELSE 0 END + CASE WHEN root THEN 1 ELSE 0 END + CASE WHEN parent IS NOT NULL THEN 1 ELSE 0 END AS score,
    concat_ws(', ', array_to_string(k, ', '), CASE WHEN outside THEN 'not from a package' END, CASE WHEN root THEN 'root' END, 'started from ' || parent) AS flags FROM w)
SELECT pid, CAST(CASE WHEN len(k) = 0 THEN 0 ELSE score END AS BIGINT) AS cmd_score, CASE WHEN len(k) = 0 THEN '' ELSE flags END AS cmd_flags, CASE WHEN len(k) = 0 THEN '' WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS cmd_risk FROM t""")
def command_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    procs = read(spark, sf_dir, "part").select(F.lit("h0").alias("host_id"), F.col("p_partkey").alias("pid"), F.floor(F.col("p_partkey") / 8).cast("long").alias("ppid"), _command(F.col("p_partkey")).alias("command"), F.when(F.col("p_size") % 3 == 0, "").otherwise("known").alias("purpose"), F.when(F.col("p_size") % 2 == 0, "root").otherwise("u").alias("user"))
    return detect.command_risk(procs, rules.COMMAND_MARKERS, rules.INTERPRETERS).select("pid", F.col("cmd_score").cast("long").alias("cmd_score"), "cmd_flags", "cmd_risk")


PROGRAMS = ("/usr/bin/x", "/tmp/x", "/run/user/1000/x", "/home/bob/.cache/x", "/home/bob/.local/bin/x", "/home/bob/x", "/opt/Tool", "")


@query(f"""WITH p AS (SELECT p_partkey AS pid, p_size, p_partkey % 8 AS e, {list(PROGRAMS)}[p_partkey % 8 + 1] AS exe, CASE p_size % 4 WHEN 0 THEN '/usr/bin/x -v' WHEN 1 THEN 'y' WHEN 2 THEN '/usr/bin/x (deleted)' ELSE '[kworker]' END AS command FROM part),
s AS (SELECT l_partkey AS pid, bool_or(l_linenumber = 1) AS exposed, bool_or(l_linenumber = 2) AS outside FROM lineitem WHERE l_quantity = 50 GROUP BY 1),
r AS (SELECT p.pid, list_filter([
    CASE WHEN e IN (1, 2, 3) THEN 'runs from temp dir' END, CASE WHEN e IN (3, 5) THEN 'binary in home' END, CASE WHEN e <> 7 AND command LIKE '%(deleted)%' THEN 'binary deleted' END,
    CASE WHEN e IN (1, 2, 3, 4, 5) THEN 'not from a package' END, CASE WHEN exposed THEN 'listening exposed' END, CASE WHEN outside THEN 'external connection' END, CASE WHEN p_size % 3 = 0 THEN 'root' END,
    CASE WHEN e <> 7 AND CASE WHEN e = 6 THEN 'Tool' ELSE 'x' END <> CASE WHEN p_size % 4 = 1 THEN 'y' ELSE 'x' END THEN 'name/exe mismatch' END], lambda x: x IS NOT NULL) AS w, command FROM p LEFT JOIN s ON s.pid = p.pid)
SELECT pid, CAST(CASE WHEN command LIKE '[%' THEN 0 ELSE list_sum([0] || list_transform(w, lambda x: CASE x WHEN 'root' THEN 1 WHEN 'name/exe mismatch' THEN 1 WHEN 'binary in home' THEN 2 WHEN 'not from a package' THEN 2 WHEN 'external connection' THEN 2 ELSE 3 END)) END AS BIGINT) AS risk,
  CASE WHEN command LIKE '[%' THEN '' ELSE array_to_string(w, ', ') END AS reasons FROM r""")
def process_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, host = F.col("p_size") % 4, F.lit("h0").alias("host_id")
    exe = F.element_at(F.array(*map(F.lit, PROGRAMS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    procs = read(spark, sf_dir, "part").select(host, F.col("p_partkey").alias("pid"), exe.alias("exe"), F.when(s == 0, "/usr/bin/x -v").when(s == 1, "y").when(s == 2, "/usr/bin/x (deleted)").otherwise("[kworker]").alias("command"), F.when(F.col("p_size") % 3 == 0, "root").otherwise("u").alias("user"))
    number = F.col("l_linenumber")
    remote = F.when(number == 2, "[2001:db8::1]:443").when(number == 3, "10.0.0.1:22").when(number == 4, "[::1]:80").otherwise("")
    socks = read(spark, sf_dir, "lineitem").where("l_quantity = 50").select(host, F.col("l_partkey").alias("pid"), F.when(number == 1, "OPEN (exposed)").otherwise("local-only").alias("exposure"), remote.alias("remote"))
    files = read(spark, sf_dir, "region").where("r_regionkey = 0").select(host, F.lit("/usr/bin/x").alias("path"))
    names = read(spark, sf_dir, "region").where("r_regionkey = 0").select(host, F.lit("tool").alias("name"))
    return detect.process_risk(procs, socks, files, names).select("pid", F.col("risk").cast("long").alias("risk"), "reasons")


# Noise templates -------------------------------------------------------------------------------------------------------


#: module, provider, message and what becomes of it: kept, dropped, or the tag.
RECORDS = (
    ("procmon", "", "started [kworker/1:0]", "drop"), ("PROCMON", "", "started grep -v x", "drop"), ("procmon", "", "started grepper", ""), ("netmon", "", "10.0.0.1:5 -> 127.0.0.1:80", "drop"), ("netmon", "", "10.0.0.1:5 -> 203.0.113.1:80", ""),
    ("audit", "", "op=PAM:session_open acct=root", "noise:a routine session open"), ("audit", "", 'syscall=42 comm="systemd-resolve" x', "noise:routine DNS queries by the resolver"), ("audit", "", "BPF prog-id=7 op=LOAD", "noise:routine load/unload of BPF programs"),
    ("journal", "kwin_wayland", "js: TypeError: x", "drop"), ("journal", "kwin_wayland", "compositing", ""), ("journal", "CROND", "(root) CMD (run-parts)", "noise:the scheduled start of cron jobs"), ("journal", "systemd", "x.conf is marked executable", "noise:a config with the x bit - the warning never changes"),
    ("journal", "sudo", "bob : a password is required ; COMMAND=/usr/sbin/dmidecode", "drop"), ("journal", "sudo", "bob : a password is required ; COMMAND=/usr/bin/vi", ""), ("journal", "my-NetworkManager", "Activation: successful", "drop"), ("journal", "sshd", "Accepted publickey", ""),
)


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{r[3]}')" for k, r in enumerate(RECORDS)) + f""") AS t(k, tag))
SELECT event_id, tag AS tags FROM events JOIN r ON k = event_id % {len(RECORDS)} WHERE tag <> 'drop'""")
def noise_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("event_id") % len(RECORDS) + 1).cast("int")
    cell = lambda k: F.element_at(F.array(*(F.lit(r[k]) for r in RECORDS)), at)
    e = read(spark, sf_dir, "events").select("event_id", cell(0).alias("event_module"), cell(1).alias("event_provider"), F.lit("log").alias("event_action"), cell(2).alias("message"))
    return apply_templates(e, rules.NOISE).select("event_id", "tags")


# Keys ------------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 2) THEN 'private' ELSE 'public' END AS kind,
CASE p_size % 4 WHEN 0 THEN 'private key' WHEN 2 THEN 'private key stored as .pub (!)' WHEN 1 THEN 'ssh-rsa sk-ssh-ed25519@openssh.com' ELSE 'key' END AS types,
CASE WHEN p_size % 4 = 1 THEN p_brand || ' at home, x' ELSE '' END AS comment,
CASE WHEN p_size % 4 = 1 AND p_size * 10 * 9 // 2 < 2048 THEN 'ssh-rsa ~' || (p_size * 10 * 9 // 2) || ' bits' ELSE '' END AS weak, CASE p_size % 4 WHEN 1 THEN 4 ELSE 1 END AS count FROM part""")
def ssh_key_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = F.col("p_size") % 4, F.repeat(F.lit("A"), F.col("p_size") * 10)
    owner = F.concat(F.col("p_brand"), F.lit(" at home"))
    texts = F.when(s == 0, F.array(F.lit("PRIVATE"))).when(s == 2, F.array(F.lit("-----BEGIN RSA PRIVATE KEY-----"))).when(s == 3, F.array(F.lit("text")))
    texts = texts.otherwise(F.array(F.concat(F.lit("ssh-rsa "), key, F.lit(" "), owner), F.lit("# note"), F.lit("sk-ssh-ed25519@openssh.com AAAA x"), F.concat(F.lit("sk-ssh-ed25519@openssh.com AAAB "), owner)))
    lines = read(spark, sf_dir, "part").select(F.lit("h0").alias("host_id"), F.concat(F.lit("/k/"), F.col("p_partkey").cast("string")).alias("path"), F.posexplode(texts).alias("line_no", "line"))
    return parse.ssh_keys(lines).select(F.substring_index("path", "/", -1).cast("long").alias("p_partkey"), "kind", "types", "comment", "weak", F.col("count").cast("int").alias("count"))
