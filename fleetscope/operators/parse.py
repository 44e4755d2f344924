"""Parsing jobs: tables of raw lines to typed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.predicates import is_private_ip
from fleetscope.functions.scalars import basename, blank, cvss_rating, cvss_score, dirname, extension, filled, hex_text, sockaddr, unit_seconds
from fleetscope.operators import records

KEEP = ("host_id", "run_id", "line_no")
KV = r"""([A-Za-z_][A-Za-z0-9_.-]*)=("[^"]*"|'[^']*'|\S*)"""
WINDOWS_PER_KEY = ("host_id", "run_id")


def kept(df: DataFrame, keep: Sequence[str] = KEEP) -> list[str]:
    return [c for c in keep if c in df.columns]


def delimited(lines: DataFrame, columns: Sequence[str], sep: str = "\t", least: int | None = None, keep: Sequence[str] = KEEP) -> DataFrame:
    """Columns of lines split at a regular expression; the last takes the rest; lines of fewer than ``least`` fields go, missing ones are empty."""
    cells = F.split("line", sep, len(columns))
    rows = lines.withColumn("_f", cells).where(F.size("_f") >= (len(columns) if least is None else least))
    return rows.select(*kept(lines, keep), *(F.trim(F.coalesce(F.get("_f", k), F.lit(""))).alias(c) for k, c in enumerate(columns)))


#: Columns of the sources that are one record a line; fixed formats: separator, columns, least fields.
DELIMITED = {
    "applications": ("\t", "kind name app_id version path depends description", 4),
    "package_files": ("\t", "path mode package", 3),
    "ip_intel": ("\t", "ip as_number as_org country", 1),
    "users": (":", "name password uid gid gecos home shell", 7),
    "browser_history": ("\t", "browser profile url title visits last_visit", 3),
    "persistence": ("\t", "vector path detail", 2),
    "suid": (r"\s+", "mode owner group path", 4),
    "sessions": (r"\s+", "session uid user seat tty", 3),
    "containers": ("\t", "id image name status", 2),
    "flatpak_perms": ("\t", "app permission value", 2),
    "at_jobs": ("\t", "job time queue user", 2),
    "hardware": ("\t", "kind name value", 2),
    "boot": ("\t", "item value", 2),
    "dev_packages": ("\t", "ecosystem name version path", 2),
    "swap_info": (r"\s+", "name type size used priority", 4),
    "memory": (r":\s*", "item value", 2),
    "unix_sockets": ("\t", "type state path process", 3),
    "devices": ("\t", "bus id name driver", 2),
    "app_config": ("\t", "app path scope kind entries origin changed", 2),
    "unpackaged_config": ("\t", "path owner group mode changed", 2),
    "kmods": ("\t", "module size used by description signer", 2),
    "config_files": ("\t", "path owner group mode changed", 2),
    "failed_units": (r"\s+", "unit load active sub description", 4),
    "net_config": ("\t", "item value", 2),
    "pam_config": (r"\s+", "service type control module", 3),
    "pkg_history": (r"\s*\|\s*", "id command time action altered", 4),
    "audit": (r"\s*:\s*", "item value", 2),
}


#: Sources whose records span lines.
RECORDS = {"autostart": records.autostart, "cron": records.cron, "dns": records.dns, "firewall": records.firewall, "network": records.network, "vms": records.virtual_machines}


def parse_source(lines: DataFrame, source: str) -> DataFrame:
    """A source by its name: one record a line, or records of several lines."""
    if source in RECORDS:
        return RECORDS[source](lines)
    sep, columns, least = DELIMITED[source]
    out = delimited(lines, columns.split(), sep, least)
    if source == "kmods":
        out = out.withColumn("signed", F.when(F.col("signer") != "", "yes").otherwise("no"))
    if source == "ip_intel":
        out = out.where("ip <> ''").dropDuplicates([c for c in (*kept(out, ("host_id",)), "ip")])
        out = out.withColumn("scope", F.when(is_private_ip(F.col("ip")), "private").otherwise("public"))
    if source == "users":
        out = out.withColumn("active", F.when(F.col("shell").rlike("(nologin|false)$"), "").otherwise("yes")).drop("password")
    return out


def key_values(line: Column, pattern: str = KV) -> Column:
    """Map of a line's ``key=value`` pairs without quotes; of equal keys the first counts."""
    keys, values = F.regexp_extract_all(line, F.lit(pattern), 1), F.regexp_extract_all(line, F.lit(pattern), 2)
    pairs = F.arrays_zip(keys.alias("k"), F.transform(values, lambda v: F.regexp_replace(v, r"""^["']|["']$""", "")).alias("v"))
    first = F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.map_from_entries(first)


def carry_stamps(lines: DataFrame, by: Sequence[str], order: str = "line_no") -> DataFrame:
    """Shell history: a line ``#<epoch>`` dates the next command of the same file; ``: <epoch>:0;command`` dates itself."""
    own = F.regexp_extract("line", r"^#(\d+)$", 1)
    inline = F.regexp_extract("line", r"^: (\d+):\d+;", 1)
    before = F.lag(own).over(Window.partitionBy(*by).orderBy(order))
    rows = lines.withColumn("_mark", own).withColumn("_before", before).where("_mark = ''")
    epoch = F.coalesce(F.nullif(F.regexp_extract("line", r"^: (\d+):\d+;", 1), F.lit("")), F.nullif("_before", F.lit(""))).try_cast("long")
    command = F.when(inline != "", F.regexp_replace("line", r"^: \d+:\d+;", "")).otherwise(F.col("line"))
    return rows.select(*by, order, epoch.alias("epoch"), command.alias("command"))


def xml_blocks(texts: DataFrame, block: str, fields: dict[str, str], text: str = "text", keep: Sequence[str] = ("host_id",)) -> DataFrame:
    """A row for each match of ``block`` in a text; a field is the first group of its pattern inside the block."""
    rows = texts.select(*kept(texts, keep), F.explode(F.regexp_extract_all(F.col(text), F.lit(block), 0)).alias("_b"))
    return rows.select(*kept(texts, keep), *(F.regexp_extract("_b", p, 1).alias(c) for c, p in fields.items()))


def polkit_actions(texts: DataFrame) -> DataFrame:
    """Actions with what they allow; high risk where an active user needs no password or only their own."""
    out = xml_blocks(texts, r"(?s)<action id=.*?</action>", {"action": r'<action id="([^"]+)"', "title": r"(?s)<description[^>]*>(.*?)</description>", "allow_any": r"<allow_any>(.*?)</allow_any>", "allow_active": r"<allow_active>(.*?)</allow_active>"})
    return out.withColumn("risk", F.when(F.col("allow_active").isin("yes", "auth_self"), "high").otherwise(""))


#: Names of the audit record types and system calls that the events use; fixed values.
AUDIT_TYPES = {"1300": "SYSCALL", "1302": "PATH", "1306": "SOCKADDR", "1307": "CWD", "1309": "EXECVE", "1327": "PROCTITLE", "1100": "USER_AUTH", "1101": "USER_ACCT", "1105": "USER_START", "1106": "USER_END", "1112": "USER_LOGIN", "1130": "SERVICE_START", "1131": "SERVICE_STOP", "1400": "AVC"}
SYSCALLS = {"2": "open", "41": "socket", "42": "connect", "49": "bind", "59": "execve", "62": "kill", "87": "unlink", "90": "chmod", "92": "chown", "105": "setuid", "257": "openat", "263": "unlinkat", "268": "fchmodat", "322": "execveat"}


def code_name(c: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(table[c.cast("string")], c.cast("string"))


def audit_records(rows: DataFrame, by: Sequence[str] = ("host_id", "boot_id", "audit_id")) -> DataFrame:
    """One map of fields for each audit event from its records (``line_no, fields, message``).

    Fields that the journal exposes come before those of the message, those before what
    is nested in ``msg='…'``; of equal names the first record's counts.
    """
    nested = F.regexp_extract("message", r"msg='([^']*)'", 1)
    outer = F.regexp_replace("message", r"msg='[^']*'", "")
    parts = [(0, F.col("fields")), (1, key_values(outer)), (2, key_values(nested))]
    long = None
    for rank, m in parts:
        piece = rows.select(*by, F.lit(rank).alias("_rank"), "line_no", F.explode(m).alias("k", "v"))
        long = piece if long is None else long.unionByName(piece)
    first = long.where("v <> ''").groupBy(*by, "k").agg(F.min_by("v", F.struct("_rank", "line_no")).alias("v"))
    return first.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))


def audit_events(records: DataFrame) -> DataFrame:
    """Event fields of audit maps: identity, outcome, process, socket, file, and what was not understood."""
    m = lambda k: F.coalesce(F.col("m")[k], F.lit(""))
    used = ("acct", "addr", "auid", "comm", "cwd", "euid", "exe", "exit", "hostname", "name", "pid", "ppid", "proctitle", "res", "saddr", "ses", "subj", "success", "syscall", "terminal", "type", "uid", "unit", "cmd", "ts")
    result = F.when(m("success") != "", m("success")).otherwise(m("res"))
    outcome = F.when(result.isin("yes", "success", "1"), "success").when(result.isin("no", "failed", "0"), "failure").otherwise("unknown")
    sock = sockaddr(m("saddr"))
    left = F.array_sort(F.array_except(F.map_keys("m"), F.array(*map(F.lit, used))))
    out = records.select(
        *[c for c in records.columns if c != "m"],
        F.concat_ws(":", F.lit("audit"), "boot_id", "audit_id").alias("event_id"),
        F.lit("audit").alias("event_module"),
        code_name(m("type"), AUDIT_TYPES).alias("audit_type"),
        code_name(m("syscall"), SYSCALLS).alias("syscall"),
        outcome.alias("event_outcome"),
        m("uid").alias("user_id"),
        m("auid").alias("user_audit_id"),
        m("euid").alias("user_effective"),
        m("acct").alias("user_name"),
        m("pid").try_cast("long").alias("process_pid"),
        m("ppid").try_cast("long").alias("parent_pid"),
        m("comm").alias("process_name"),
        m("exe").alias("process_executable"),
        filled(hex_text(m("proctitle")), hex_text(m("cmd"))).alias("process_command_line"),
        m("cwd").alias("process_cwd"),
        m("exit").alias("process_exit_code"),
        m("ses").alias("session_id"),
        m("terminal").alias("session_tty"),
        m("addr").alias("source_ip"),
        sock["ip"].alias("destination_ip"),
        sock["port"].cast("long").alias("destination_port"),
        filled(m("name"), sock["path"]).alias("file_path"),
        m("unit").alias("service_name"),
        F.array_join(F.slice(left, 1, 25), ", ").alias("not_normalized"),
    )
    return with_path_parts(out)


def with_path_parts(df: DataFrame, path: str = "file_path") -> DataFrame:
    p = F.col(path)
    return df.withColumn("file_name", basename(p)).withColumn("file_directory", dirname(p)).withColumn("file_extension", extension(p))


#: Ordered classes of audit events: condition, category, type, action, severity.
AUDIT_CLASSES = (
    ("audit_type = 'AVC'", "intrusion_detection", "denied", "selinux_denied", 60),
    ("audit_type IN ('USER_AUTH', 'USER_LOGIN')", "authentication", "start", "login", 30),
    ("audit_type IN ('USER_START', 'USER_END', 'USER_ACCT')", "authentication", "info", "session", 15),
    ("audit_type LIKE 'SERVICE_%'", "process", "change", "service_changed", 20),
    ("syscall IN ('execve', 'execveat')", "process", "start", "process_started", 20),
    ("syscall = 'kill'", "process", "end", "process_signalled", 30),
    ("syscall IN ('connect', 'socket', 'bind')", "network", "start", "connection_opened", 20),
    ("syscall IN ('chmod', 'fchmodat', 'chown')", "file", "change", "file_permissions_changed", 40),
    ("syscall IN ('unlink', 'unlinkat')", "file", "deletion", "file_deleted", 30),
    ("syscall IN ('open', 'openat')", "file", "access", "file_opened", 10),
    ("syscall = 'setuid'", "iam", "change", "user_changed", 40),
)


def classify_audit(df: DataFrame) -> DataFrame:
    """Category, type, action and severity by the first class that fits; failures count 15 more, root in process, iam and authentication 5 more, 100 at most."""
    what = None
    for cond, category, kind, action, severity in AUDIT_CLASSES:
        s = F.struct(F.lit(category).alias("c"), F.lit(kind).alias("t"), F.lit(action).alias("a"), F.lit(severity).alias("s"))
        what = F.when(F.expr(cond), s) if what is None else what.when(F.expr(cond), s)
    what = what.otherwise(F.struct(F.lit("host").alias("c"), F.lit("info").alias("t"), F.lower(F.concat(F.lit("audit_"), F.col("audit_type"))).alias("a"), F.lit(10).alias("s")))
    out = df.withColumn("_w", what)
    more = F.when(F.col("event_outcome") == "failure", 15).otherwise(0) + F.when((F.col("user_id") == "0") & F.col("_w.c").isin("process", "iam", "authentication"), 5).otherwise(0)
    return out.withColumn("event_category", F.col("_w.c")).withColumn("event_type", F.col("_w.t")).withColumn("event_action", F.col("_w.a")).withColumn("event_severity", F.least(F.lit(100), F.col("_w.s") + more).cast("long")).drop("_w")


UNIT = r"^(Started|Stopped|Failed to start|Reloaded|Finished) (.+?)\.?$"


def journal_events(df: DataFrame) -> DataFrame:
    """Single journal records (``identifier, priority, message, cursor``): units that started, stopped or failed, sessions, kernel and others; priority 3 and below is a failure and counts 25 more."""
    verb = F.regexp_extract("message", UNIT, 1)
    who = F.lower("identifier")
    action = F.when(who.startswith("systemd") & verb.isin("Started", "Finished"), "service_started").when(who.startswith("systemd") & (verb == "Stopped"), "service_stopped").when(who.startswith("systemd") & (verb == "Failed to start"), "service_failed").when(who.startswith("systemd") & (verb == "Reloaded"), "service_reloaded").when(who.isin("sshd", "sudo", "su", "login", "gdm-password"), "authentication").when(who == "kernel", "kernel_message").otherwise("log")
    category = F.when(action.startswith("service"), "process").when(action == "authentication", "authentication").when(action == "kernel_message", "host").otherwise("host")
    bad = (F.col("priority").try_cast("int") <= 3) | (action == "service_failed")
    base = F.when(category == "authentication", 25).when(category == "process", 15).otherwise(10)
    out = df.withColumn("event_action", action).withColumn("event_category", category).withColumn("service_name", F.when(action.startswith("service"), F.regexp_extract("message", UNIT, 2)).otherwise(""))
    out = out.withColumn("event_outcome", F.when(F.coalesce(bad, F.lit(False)), "failure").otherwise("success")).withColumn("event_severity", F.least(F.lit(100), base + F.when(F.coalesce(bad, F.lit(False)), 25).otherwise(0)).cast("long"))
    return out.withColumn("source_ip", F.regexp_extract("message", r"from (\d+\.\d+\.\d+\.\d+)", 1)).withColumn("event_id", F.concat(F.lit("journal:"), F.col("cursor"))).withColumn("event_module", F.lit("journal"))


def subject_object(df: DataFrame) -> DataFrame:
    """Who and what: user, service, process or system; file, socket, package, executable, account or service. Filled subjects and objects stay."""
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    socket = F.when(have("destination_ip") != "", F.concat_ws(":", have("destination_ip"), F.nullif(have("destination_port"), F.lit("")))).otherwise("")

    def axis(prefix: str, choices: Sequence[tuple[str, Column]], last: tuple[str, str]) -> tuple[Column, Column]:
        kind, name = F.when(have(f"{prefix}_name") != "", have(f"{prefix}_type")), F.when(have(f"{prefix}_name") != "", have(f"{prefix}_name"))
        for k, c in choices:
            kind, name = kind.when(c != "", k), name.when(c != "", c)
        return kind.otherwise(last[0]), name.otherwise(last[1])

    s_kind, s_name = axis("subject", [("user", have("user_name")), ("service", have("service_name")), ("process", have("process_name"))], ("system", "system"))
    o_kind, o_name = axis("object", [("file", have("file_path")), ("socket", socket), ("package", have("package_name")), ("process", have("process_executable")), ("account", have("user_target")), ("service", have("service_name"))], ("", ""))
    return df.withColumns({"subject_type": s_kind, "subject_name": s_name, "object_type": o_kind, "object_name": o_name})


#: Applications of well-known ports; fixed values.
PORT_APPLICATIONS = {"53": "dns", "80": "http", "443": "https", "22": "ssh", "25": "smtp", "3389": "rdp"}


def socket_events(changes: DataFrame) -> DataFrame:
    """Connection events of socket appearances and disappearances (``proto, local, remote, action``); listeners are left out."""
    ip = F.regexp_replace(F.regexp_extract("remote", r"^(.*):\d+$", 1), r"[\[\]]", "")
    port = F.regexp_extract("remote", r":(\d+)$", 1)
    rows = changes.where(~F.col("remote").rlike(r"(^$|:\*$|:0$)")).withColumn("destination_ip", ip).withColumn("destination_port", port.try_cast("long"))
    private = is_private_ip(F.col("destination_ip"))
    app = F.create_map(*(F.lit(x) for kv in PORT_APPLICATIONS.items() for x in kv))[port]
    opened = F.col("action") == "appeared"
    severity = F.when(~opened, 15).when(~private & app.isNull(), 40).when(~private, 30).otherwise(15)
    return rows.withColumns({"event_category": F.lit("network"), "event_module": F.lit("netmon"), "event_action": F.when(opened, "connection_opened").otherwise("connection_closed"), "network_direction": F.when(private, "internal").otherwise("external"), "network_application": F.coalesce(app, F.lit("")), "event_severity": severity.cast("long")})


def process_events(changes: DataFrame) -> DataFrame:
    """Start and end events of process appearances (``pid, start, exe, user, action``): temporary directories 70, homes 45, root 5 more."""
    base = F.when(F.col("exe").rlike(r"^/(tmp|var/tmp|dev/shm)/"), 70).when(F.col("exe").rlike("^/home/"), 45).otherwise(20)
    started = F.col("action") == "appeared"
    severity = F.when(started, base + F.when(F.col("user") == "root", 5).otherwise(0)).otherwise(10)
    return changes.withColumns({"event_category": F.lit("process"), "event_module": F.lit("procmon"), "event_action": F.when(started, "process_started").otherwise("process_ended"), "event_severity": severity.cast("long")})


def exec_log(lines: DataFrame) -> DataFrame:
    """The tracer's log: ``E``xec, e``X``it, ``F``ile and ``N``etwork records after a ``BTIME`` line with the boot time.

    Times are nanoseconds since boot. Records of another shape, as a command line with a
    line feed can forge, go. An exit's status has the signal in its low seven bits and
    the code in the next byte.
    """
    run = Window.partitionBy(*kept(lines, ("host_id", "run_id"))).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    boot = F.regexp_extract("line", r"^BTIME (\d+)$", 1)
    rows = lines.withColumn("_boot", F.last(F.nullif(boot, F.lit("")), ignorenulls=True).over(run)).withColumn("f", F.split("line", "\t"))
    shape = F.col("line").rlike(r"^(E\t\d+\t\d+\t\d+\t\d+(\t\d+){0,2}\t|X\t\d+\t\d+\t\d+$|F\t\d+\t\d+\t\d+\t[^\t]+\t[^\t]+\t|N\t\d+\t\d+\t\d+\t[^\t]+\t[46]\t[^\t]+\t\d+$)")
    rows = rows.where(shape & F.col("_boot").isNotNull())
    f = lambda k: F.coalesce(F.get("f", k), F.lit(""))
    kind = f(0)
    long_form = (kind == "E") & F.col("line").rlike(r"^E(\t\d+){6}\t")
    status = F.when(kind == "X", f(3).try_cast("int"))
    signal, code = status.bitwiseAND(F.lit(0x7F)), F.shiftright(status, 8).bitwiseAND(F.lit(0xFF))
    ts = F.timestamp_micros(F.col("_boot").cast("long") * 1_000_000 + F.floor(f(1).cast("decimal(20,0)") / 1000).cast("long"))
    command = F.when(long_form, F.array_join(F.slice("f", 9, 1_000_000), "\t")).when(kind == "E", F.array_join(F.slice("f", 7, 1_000_000), "\t")).otherwise("")
    ip = F.when(kind == "N", f(6)).otherwise("")
    out = rows.select(
        *kept(lines),
        ts.alias("ts"),
        F.when(kind == "E", "process_started").when(kind == "X", "process_ended").when(kind == "N", "connection_opened").otherwise(F.when(f(5) == "write", "file_modified").when(f(5) == "unlink", "file_deleted").when(f(5) == "chmod", "file_permissions_changed").otherwise(F.concat(F.lit("file_"), f(5)))).alias("event_action"),
        F.when(kind.isin("E", "X"), "process").when(kind == "N", "network").otherwise("file").alias("event_category"),
        f(2).try_cast("long").alias("process_pid"),
        F.when(kind == "E", f(3).try_cast("long")).alias("parent_pid"),
        F.when(kind == "E", f(4)).when(kind.isin("F", "N"), f(3)).otherwise("").alias("user_id"),
        F.when(long_form, f(5)).otherwise("").alias("user_audit_id"),
        F.when(long_form, f(6)).otherwise("").alias("session_id"),
        F.when(long_form, f(7)).when(kind == "E", f(5)).when(kind.isin("F", "N"), f(4)).otherwise("").alias("process_name"),
        command.alias("process_command_line"),
        F.when(kind == "F", F.array_join(F.slice("f", 7, 1_000_000), "\t")).otherwise("").alias("file_path"),
        ip.alias("destination_ip"),
        F.when(kind == "N", f(7).try_cast("long")).alias("destination_port"),
        F.when(kind == "N", F.when(is_private_ip(ip), "internal").otherwise("external")).otherwise("").alias("network_direction"),
        F.when(kind == "X", F.when(signal > 0, F.concat(F.lit("signal "), signal.cast("string"))).otherwise(code.cast("string"))).otherwise("").alias("process_exit_code"),
        F.when((kind == "X") & ((signal > 0) | (code > 0)), "failure").otherwise("success").alias("event_outcome"),
    )
    return with_path_parts(out)


#: Letters of a package verification and the attributes that they mean; fixed values.
VERIFY = (("S", "size"), ("M", "mode"), ("5", "digest"), ("D", "device"), ("L", "link"), ("U", "owner"), ("G", "group"), ("T", "time"), ("P", "capabilities"))


def verify_events(lines: DataFrame) -> DataFrame:
    """Changed attributes, action and severity of package verification lines; equal differences have equal ids."""
    flags = F.substring("line", 1, 9)
    missing = F.col("line").startswith("missing")
    rows = lines.where(missing | F.col("line").rlike(r"^[SM5DLUGTP.?]{9}\s")).withColumn("flags", F.when(missing, "missing").otherwise(flags))
    path = F.regexp_extract("line", r"(/.*)$", 1)
    has = lambda letter: F.col("flags").contains(letter) & (F.col("flags") != "missing")
    changed = F.array_join(F.array_compact(F.array(*(F.when(has(letter), F.lit(name)) for letter, name in VERIFY))), ", ")
    config = F.col("line").rlike(r"\sc\s+/")
    action = F.when(F.col("flags") == "missing", "file_missing").when(has("P"), "file_caps_changed").when(has("M") | has("U") | has("G"), "file_permissions_changed").when(has("5") | has("S"), "file_modified").otherwise("file_attributes_changed")
    severity = F.when(F.col("flags") == "missing", 50).when(has("P"), 80).when(has("5") & ~config, 70).when(has("M") | has("U") | has("G"), 55).when(has("5"), 30).otherwise(15)
    out = rows.select(*kept(lines), "flags", path.alias("file_path"), changed.alias("changed"), action.alias("event_action"), severity.cast("long").alias("event_severity"), F.lit("fim").alias("event_module"), F.lit("file").alias("event_category"))
    return with_path_parts(out.where("flags = 'missing' OR changed <> ''").withColumn("event_id", F.concat_ws(":", F.lit("fim"), "file_path", "flags")))


def package_log(lines: DataFrame) -> DataFrame:
    """Install log lines ``epoch, name, version, action`` as events."""
    rows = delimited(lines, ["epoch", "package_name", "package_version", "package_action"], "\t", 3)
    return rows.withColumns({"ts": F.timestamp_seconds(F.col("epoch").try_cast("long")), "event_id": F.concat_ws(":", F.lit("pkg"), "package_name", "package_version", "epoch"), "event_category": F.lit("package"), "event_module": F.lit("rpmdb"), "event_action": F.concat(F.lit("package_"), filled(F.col("package_action"), F.lit("installed")))}).where("ts IS NOT NULL")


def sockets(lines: DataFrame) -> DataFrame:
    """Socket table lines (protocol, state, queues, local, remote, process) with address, port and whether the address is reachable from outside."""
    f = delimited(lines, ["proto", "state", "recv_q", "send_q", "local", "remote", "process"], r"\s+", 6)
    addr = F.regexp_replace(F.regexp_extract("local", r"^(.*):[^:]*$", 1), r"[\[\]]|%.*$", "")
    outside = ~F.when(addr == "", F.lit(False)).otherwise(addr.rlike(r"^(127\.|::1$)"))
    out = f.withColumns({"addr": addr, "port": F.regexp_extract("local", r":(\d+)$", 1), "external": F.when(outside, "yes").otherwise("no"), "state": F.when(F.col("state").isin("LISTEN", "UNCONN"), "LISTEN").otherwise(F.col("state"))})
    return out.withColumn("remote", F.when(F.col("state") == "LISTEN", "").otherwise(F.col("remote"))).drop("recv_q", "send_q")


def processes(lines: DataFrame) -> DataFrame:
    """``pid, exe`` and the ps fields of a line: parent, user, cpu, mem, rss in MB to one decimal, state, elapsed, command."""
    rows = delimited(lines, ["pid", "exe", "rest"], "\t", 3)
    p = F.split("rest", r"\s+", 8)
    cells = {c: F.coalesce(F.get(p, k), F.lit("")) for k, c in enumerate(["ppid", "user", "cpu", "mem", "rss", "stat", "elapsed", "command"])}
    out = rows.where(F.size(p) >= 8).select(*kept(rows), "pid", "exe", *(v.alias(c) for c, v in cells.items()))
    return out.withColumn("rss_mb", F.round(F.col("rss").try_cast("double") / 1024, 1)).drop("rss")


def open_files(lines: DataFrame) -> DataFrame:
    """Kind of what a descriptor leads to, whether it is deleted, and its directory."""
    rows = delimited(lines, ["pid", "process", "fd", "path"], "\t", 4)
    p = F.col("path")
    kind = F.when(p.startswith("socket:"), "socket").when(p.startswith("pipe:"), "pipe").when(p.startswith("anon_inode:") | p.startswith("/memfd:"), "kernel").when(p.rlike("^/(proc|sys)/"), "system state").when(p.startswith("/dev/"), "device").when(p.startswith("/"), "file").otherwise("other")
    gone = p.endswith(" (deleted)")
    clean = F.regexp_replace(p, r" \(deleted\)$", "")
    return rows.withColumns({"kind": kind, "deleted": F.when(gone, "yes").otherwise(""), "path": clean, "dir": dirname(clean)})


def utc(text: Column, formats: Sequence[str] = ("EEE yyyy-MM-dd HH:mm:ss X", "yyyy-MM-dd HH:mm:ss XXX", "yyyy-MM-dd'T'HH:mm:ssXXX")) -> Column:
    """ISO UTC text of a local time with its offset; empty if it can't be read."""
    plain = F.regexp_replace(text, r"^[A-Z][a-z]{2} (?=\d{4})", "")
    plain = F.regexp_replace(plain, r" ([+-]\d{2})$", " $1:00")
    plain = F.regexp_replace(plain, r" ([+-]\d{2})(\d{2})$", " $1:$2")
    at = F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in formats[1:]))
    return F.coalesce(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


BOOT = r"^\s*(-?\d+)\s+([0-9a-f]{32})\s+(\w{3} \d{4}-\d\d-\d\d \d\d:\d\d:\d\d \S+)\s+(\w{3} \d{4}-\d\d-\d\d \d\d:\d\d:\d\d \S+)\s*$"


def boot_sessions(lines: DataFrame) -> DataFrame:
    """``kind, index, boot_id, started, ended, current``: boots with their times in UTC; the present one has no end."""
    text = F.regexp_replace("line", "^boot\t", "")
    rows = lines.where(text.rlike(BOOT))
    current = F.regexp_extract(text, BOOT, 1) == "0"
    return rows.select(*kept(lines), F.lit("boot").alias("kind"), F.regexp_extract(text, BOOT, 1).alias("index"), F.regexp_extract(text, BOOT, 2).alias("boot_id"), utc(F.regexp_extract(text, BOOT, 3)).alias("started"), F.when(current, "").otherwise(utc(F.regexp_extract(text, BOOT, 4))).alias("ended"), F.when(current, "yes").otherwise("").alias("current"))


LOGIN = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d:\d\d)\s+(?:-\s+)?(still logged in|gone - no logout|crash|down|\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d:\d\d)(?:\s+\(([^)]*)\))?"


def logins(lines: DataFrame) -> DataFrame:
    """``user, tty, from, start, until, duration, active``: sessions with their times in UTC; open ones have no end."""
    rows = lines.where(F.col("line").rlike(LOGIN))
    g = lambda k: F.regexp_extract("line", LOGIN, k)
    return rows.select(*kept(lines), g(1).alias("user"), g(2).alias("tty"), g(3).alias("from"), utc(g(4)).alias("start"), utc(g(5)).alias("until"), g(6).alias("duration"), F.when(g(5) == "still logged in", "yes").otherwise("").alias("active"))


def kernel_params(declared: DataFrame, running: DataFrame) -> DataFrame:
    """``param, value, declared, declared_in, status``: declarations (``file, priority, line_no, param, value``) against running values (``param, value``).

    Of files of one name that of the directory with the highest priority counts; later
    files by name, and later lines, win. ``*`` in a name stands for any one part.
    """
    best = Window.partitionBy("host_id", "name")
    files = declared.withColumn("name", basename(F.col("file"))).withColumn("_top", F.max("priority").over(best)).where("priority = _top")
    glob = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("param", r"\.", "\\\\."), r"\*", "[^.]+"), F.lit("$"))
    plain = files.where(~F.col("param").contains("*")).withColumn("key", F.col("param"))
    wild = files.where(F.col("param").contains("*")).withColumn("_glob", glob)
    keys = running.select("host_id", F.col("param").alias("key"), F.substring_index("param", ".", 1).alias("_root"))
    wild = wild.withColumn("_root", F.substring_index("param", ".", 1)).join(keys, ["host_id", "_root"]).where("key RLIKE _glob").drop("_glob", "_root")
    both = plain.unionByName(wild.select(*plain.columns))
    last = both.groupBy("host_id", "key").agg(F.max_by(F.struct("value", "file"), F.struct("name", "line_no")).alias("d"))
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    out = last.join(running.select("host_id", F.col("param").alias("key"), F.col("value").alias("value")), ["host_id", "key"], "left")
    status = F.when(F.col("value").isNull(), "not applied").when(norm(F.col("value")) == norm(F.col("d.value")), "ok").otherwise("differs")
    return out.select("host_id", F.col("key").alias("param"), F.coalesce("value", F.lit("")).alias("value"), F.col("d.value").alias("declared"), F.col("d.file").alias("declared_in"), status.alias("status"))


def merge_copies(df: DataFrame, keys: Sequence[str], order: str = "line_no", joined: Sequence[str] = ("version",)) -> DataFrame:
    """Copies of one thing as one row: of each column the first filled cell, of ``joined`` ones all distinct values, and how many ``copies``."""
    rest = [c for c in df.columns if c not in keys and c not in joined and c not in KEEP]
    first = [F.coalesce(F.min_by(F.nullif(F.col(c).cast("string"), F.lit("")), F.when(~blank(F.col(c).cast("string")), F.col(order))), F.lit("")).alias(c) for c in rest]
    return df.groupBy(*keys).agg(*first, *(F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ", ").alias(c) for c in joined), F.count(F.lit(1)).alias("copies"))


CVE = r"CVE-\d{4}-\d{4,}"


def advisories(records: DataFrame, installed: DataFrame, scores: DataFrame) -> DataFrame:
    """Advisories that concern installed packages, with their worst CVE.

    ``records``: ``host_id, advisory, status, severity, title, packages (array), text``;
    ``installed``: ``host_id, name``; ``scores``: ``cve, score, vector``. A CVE without a
    score gets its vector's; coverage tells for how many of the CVEs a score was found.
    """
    own = records.select("host_id", "advisory", F.explode("packages").alias("name")).join(installed.select("host_id", "name").distinct(), ["host_id", "name"])
    own = own.groupBy("host_id", "advisory").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("packages"), F.countDistinct("name").alias("packages_count"))
    cves = records.select("host_id", "advisory", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CVE), 0))).alias("cve"))
    known = scores.select("cve", F.coalesce(F.col("score").try_cast("double"), cvss_score(F.col("vector"))).alias("_s"), F.col("vector").alias("_v"))
    worst = cves.join(known, "cve", "left").groupBy("host_id", "advisory").agg(F.max("_s").alias("cvss_score"), F.max_by("_v", "_s").alias("cvss_vector"), F.count("_s").alias("_got"), F.count(F.lit(1)).alias("cve_count"), F.array_join(F.array_sort(F.collect_set("cve")), ", ").alias("cve"))
    out = records.drop("packages", "text").join(own, ["host_id", "advisory"]).join(worst, ["host_id", "advisory"], "left")
    out = out.withColumn("cvss_rating", cvss_rating(F.col("cvss_score"))).withColumn("cvss_covered", F.concat_ws("/", F.coalesce("_got", F.lit(0)).cast("string"), F.coalesce("cve_count", F.lit(0)).cast("string"))).drop("_got")
    return out.withColumn("risk", F.when((F.col("status") == "open") & (F.coalesce("cvss_score", F.lit(0.0)) >= 7), "high").when(F.col("status") == "open", "medium").otherwise("low"))


BOOLEAN_WORDS = ("if", "else", "unless", "with", "without", "and", "or")


def resolve_capabilities(packages: DataFrame, provides: DataFrame, field: str, user_installed: DataFrame | None = None) -> DataFrame:
    """A list of capabilities as the packages that provide them: by the whole name, else without what stands in parentheses; bare names stay, words of boolean dependencies go."""
    raw = packages.select("host_id", "name", F.posexplode(F.split(field, r"[\s,]+")).alias("pos", "cap"))
    inner = F.regexp_replace("cap", r"^\(+", "")
    raw = raw.withColumn("cap", F.when(inner.contains("("), inner).otherwise(F.regexp_replace(inner, r"\)+$", "")))
    caps = raw.where((F.col("cap") != "") & ~F.col("cap").isin(list(BOOLEAN_WORDS)) & ~F.col("cap").rlike(r"^[<>=]+$|^\d"))
    table = provides.groupBy("host_id", F.col("capability").alias("cap")).agg(F.min("package").alias("_pkg"))
    short = caps.withColumn("_bare", F.regexp_replace("cap", r"\(.*$", ""))
    hit = short.join(table, ["host_id", "cap"], "left").join(table.select("host_id", F.col("cap").alias("_bare"), F.col("_pkg").alias("_pkg2")), ["host_id", "_bare"], "left")
    kept_name = F.coalesce("_pkg", "_pkg2", F.when(~F.col("cap").rlike(r"[/(.]"), F.col("cap")))
    first = hit.withColumn("_to", kept_name).where("_to IS NOT NULL AND _to <> name").groupBy("host_id", "name", "_to").agg(F.min("pos").alias("pos"))
    text = first.groupBy("host_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_to"))), lambda x: x["_to"]), " ").alias(f"_{field}"))
    out = packages.join(text, ["host_id", "name"], "left").withColumn(field, F.coalesce(f"_{field}", F.lit(""))).drop(f"_{field}")
    if user_installed is not None:
        chosen = user_installed.select("host_id", "name").distinct().withColumn("_u", F.lit(True))
        out = out.join(chosen, ["host_id", "name"], "left").withColumn("install_reason", F.when(F.col("_u"), "user").otherwise("dependency")).drop("_u")
    return out


def package_desktop(meta: DataFrame, desktop: DataFrame) -> DataFrame:
    """Package metadata with their desktop entry by file stem, executable, or the last part of a dotted stem, in this order; entries without a package stay as rows of their own."""
    stem = F.regexp_replace(basename(F.col("file")), r"\.desktop$", "")
    keys = F.array(F.struct(F.lit(0).alias("r"), F.lower(stem).alias("name")), F.struct(F.lit(1).alias("r"), F.lower(basename(F.split("exec", " ")[0])).alias("name")), F.struct(F.lit(2).alias("r"), F.lower(F.substring_index(stem, ".", -1)).alias("name")))
    offers = desktop.select("host_id", "file", "purpose", F.explode(keys).alias("k")).select("host_id", "file", "purpose", "k.r", "k.name").where("name <> ''")
    hits = meta.select("host_id", "name").join(offers, ["host_id", "name"])
    best = hits.groupBy("host_id", "name").agg(F.min(F.struct("r", "file", "purpose")).alias("b"))
    out = meta.join(best, ["host_id", "name"], "left").select(*meta.columns, F.coalesce("b.purpose", F.lit("")).alias("purpose"), F.coalesce("b.file", F.lit("")).alias("desktop"))
    alone = desktop.join(best.select("host_id", F.col("b.file").alias("file")), ["host_id", "file"], "left_anti").select("host_id", stem.alias("name"), "purpose", F.col("file").alias("desktop"))
    return out.unionByName(alone, allowMissingColumns=True)


def block_devices(df: DataFrame) -> DataFrame:
    """Block devices with the mount and file system of the crypt device on them; such devices are no rows of their own."""
    crypt = df.where("type = 'crypt'").select("host_id", F.col("pkname").alias("name"), F.col("mountpoint").alias("_m"), F.col("fstype").alias("_f"), F.lit("yes").alias("_c"))
    out = df.where("type <> 'crypt'").join(crypt, ["host_id", "name"], "left")
    return out.withColumns({"mountpoint": filled(F.col("mountpoint"), F.col("_m")), "fstype": filled(F.col("_f"), F.col("fstype")), "encrypted": F.coalesce("_c", F.lit(""))}).drop("_m", "_f", "_c")


def ssh_keys(lines: DataFrame) -> DataFrame:
    """One row a file (``path, line_no, line``): whether it is private, under which name, its public keys' algorithms and owners, and which of them are weak.

    A file whose whole text is ``PRIVATE`` is a private key; one with a private key's heading is one stored as a public one. Otherwise
    algorithms and comments (six at most) come in order of appearance; an ``ssh-rsa`` key below 2 048 bits, at 4.5 bits for each character, is weak.
    """
    rows = lines.where("path <> ''").groupBy("host_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("l"))
    content = F.array_join("l", "\n")
    parts = F.filter(F.transform("l", lambda x: F.split(F.trim(x), " ", 3)), lambda p: F.get(p, F.lit(0)).rlike("^(ssh-|ecdsa|sk-)"))
    types = F.array_join(F.array_distinct(F.transform(parts, lambda p: F.get(p, F.lit(0)))), " ")
    owners = F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(F.coalesce(F.get(p, F.lit(2)), F.lit("")))), lambda c: c != ""))
    bits = F.transform(F.filter(parts, lambda p: (F.get(p, F.lit(0)) == "ssh-rsa") & (F.size(p) > 1)), lambda p: F.floor(F.length(F.get(p, F.lit(1))) * 4.5))
    weak = F.array_join(F.transform(F.filter(bits, lambda n: (n > 0) & (n < 2048)), lambda n: F.concat(F.lit("ssh-rsa ~"), n.cast("string"), F.lit(" bits"))), ", ")
    plain, hidden = F.col("content") == "PRIVATE", F.col("content").contains("PRIVATE KEY")
    private = plain | hidden
    kind = F.when(types != "", types).otherwise("key")
    out = rows.withColumn("content", content)
    return out.select(
        "host_id", "path", F.when(private, "private").otherwise("public").alias("kind"), F.when(private, "private").otherwise(kind).alias("type"), F.when(private, "").otherwise(F.array_join(F.slice(owners, 1, 6), ", ")).alias("comment"),
        F.when(private, "").otherwise(weak).alias("weak"), F.when(plain, "private key").when(hidden, "private key stored as .pub (!)").otherwise(kind).alias("types"),
        F.when(private, 1).otherwise(F.size("l")).cast("long").alias("count"), F.when(private, "").otherwise(F.col("content")).alias("key"),
    )


def services(units: DataFrame, enabled: DataFrame, files: DataFrame) -> DataFrame:
    """Units with whether they are enabled and what their unit file says."""
    e = enabled.groupBy("host_id", "scope", "unit").agg(F.max("enabled").alias("enabled"))
    t = files.groupBy("host_id", "scope", "unit").agg(F.max("content").alias("content"))
    keys = ["host_id", "scope", "unit"]
    return units.join(e, keys, "left").join(t, keys, "left").fillna("", ["enabled", "content"])


def boot_times(lines: DataFrame) -> DataFrame:
    """Seconds a unit took at boot, and its impact: high from 10 s, medium from 3 s."""
    p = r"^\s*((?:\d+min\s+)?[\d.]+m?s)\s+(\S+)\s*$"
    rows = lines.where(F.col("line").rlike(p))
    seconds = unit_seconds(F.regexp_extract("line", p, 1))
    return rows.select(*kept(lines), F.regexp_extract("line", p, 2).alias("unit"), F.regexp_extract("line", p, 1).alias("time"), F.round(seconds, 3).alias("seconds"), F.when(seconds >= 10, "high").when(seconds >= 3, "medium").otherwise("low").alias("impact"))


PSEUDO = ("proc", "sysfs", "devpts", "cgroup2", "securityfs", "debugfs", "tracefs", "pstore", "bpf", "configfs", "fusectl", "hugetlbfs", "mqueue", "autofs", "rpc_pipefs", "selinuxfs", "efivarfs", "binfmt_misc")


def mounts(lines: DataFrame) -> DataFrame:
    """Mounts with their hardening options; file systems of the kernel are left out."""
    rows = delimited(lines, ["target", "source", "fstype", "options"], r"\s+", 4).where(~F.col("fstype").isin(list(PSEUDO)))
    hard = F.filter(F.split("options", ","), lambda x: x.isin("noexec", "nosuid", "nodev", "ro"))
    return rows.withColumn("hardening", F.array_join(F.array_sort(hard), ", "))


def json_array(texts: DataFrame, schema: str, text: str = "text", keep: Sequence[str] = ("host_id", "run_id")) -> DataFrame:
    """Rows of a text that is a JSON array of objects; a text that isn't one has none."""
    parsed = texts.select(*kept(texts, keep), F.from_json(F.col(text), f"array<struct<{schema}>>").alias("a"))
    return parsed.select(*kept(texts, keep), F.inline("a"))
