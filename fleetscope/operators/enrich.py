"""Enrichment joins: lookups, owners, links, intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.scalars import basename, blank, filled, usr_merged


def one_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def lookup(df: DataFrame, table: DataFrame, from_col: str, key: str, add: dict[str, str], order: str, extract: str | None = None, by: Sequence[str] = (), last: bool = True) -> DataFrame:
    """Columns ``add`` (new: source) from the row of ``table`` whose ``key`` equals ``from_col`` or what ``extract`` finds in it; a miss is empty text. Of rows with one key the last by ``order`` counts (or the first)."""
    value = F.coalesce(F.col(from_col).cast("string"), F.lit(""))
    value = F.regexp_extract(value, extract, 1) if extract else value
    cells = F.struct(*(F.col(s).cast("string").alias(n) for n, s in add.items()))
    pick = F.max_by if last else F.min_by
    small = table.groupBy(*by, F.col(key).cast("string").alias("_key")).agg(pick(cells, F.col(order)).alias("_add"))
    out = df.withColumn("_key", value).join(small, [*by, "_key"], "left")
    found = F.col("_key") != ""
    return out.select(*df.columns, *(F.when(found, F.coalesce(F.col(f"_add.{n}"), F.lit(""))).otherwise("").alias(n) for n in add))


def attach_first_hit(df: DataFrame, row_keys: Sequence[str], candidates: Sequence[tuple[Column, DataFrame]], value: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with column ``value``, empty where no candidate finds anything.

    Each table has one row a key and is joined in turn, by rows that have found nothing yet; the others have keys of their own that nothing
    has, so that they are neither looked up nor gathered in one task.
    """
    out = df.withColumn("_hit", F.lit(None).cast("string"))
    for cell, table in candidates:
        small = table.groupBy(*by, F.col("key").cast("string").alias("_key")).agg(F.min(F.col("value").cast("string")).alias("_found"))
        text = cell.cast("string")
        out = out.withColumn("_key", F.when(F.col("_hit").isNull() & ~blank(text), text).otherwise(F.concat(F.lit("\0"), F.xxhash64(*row_keys).cast("string"))))
        out = out.join(small, [*by, "_key"], "left").withColumn("_hit", F.coalesce("_hit", "_found")).drop("_key", "_found")
    return out.select(*df.columns, F.coalesce("_hit", F.lit("")).alias(value))


def attach_package(df: DataFrame, files: DataFrame, row_keys: Sequence[str], path_cols: Sequence[str], unit_col: str | None = None, module_col: str | None = None) -> DataFrame:
    """``package`` of a row: of its first path that a package owns, else of its unit file by name, else of its kernel module."""
    own = files.select("host_id", usr_merged(F.col("path")).alias("key"), F.col("package").alias("value"))
    units = files.where(F.col("path").rlike(r"/systemd/(system|user)/[^/]+$")).select("host_id", basename(F.col("path")).alias("key"), F.col("package").alias("value"))
    modules = files.where(F.col("path").rlike(r"\.ko(\.\w+)?$")).select("host_id", F.regexp_replace(F.regexp_replace(basename(F.col("path")), r"\.ko(\.\w+)?$", ""), "-", "_").alias("key"), F.col("package").alias("value"))
    candidates = [(usr_merged(F.col(c)), own) for c in path_cols]
    candidates += [(basename(F.col(unit_col)), units)] if unit_col else []
    candidates += [(F.regexp_replace(F.col(module_col), "-", "_"), modules)] if module_col else []
    return attach_first_hit(df, row_keys, candidates, "package", by=["host_id"])


def file_owner(df: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """``package`` that owns the path, /bin and the like counting as /usr/bin."""
    own = files.select("host_id", usr_merged(F.col("path")).alias("_key"), "package").groupBy("host_id", "_key").agg(F.min("package").alias("package"))
    out = df.withColumn("_key", usr_merged(F.col(path))).join(own, ["host_id", "_key"], "left").drop("_key")
    return out.withColumn("package", F.coalesce("package", F.lit("")))


def unpackaged(df: DataFrame, path: str = "path") -> DataFrame:
    """``unpackaged``: yes where no package owns a path of the system's directories (after ``file_owner``)."""
    return df.withColumn("unpackaged", F.when(blank(F.col("package")) & F.col(path).rlike(r"^/(etc|usr|lib|opt)/"), "yes").otherwise(""))


def package_meta(df: DataFrame, meta: DataFrame, name: str = "name") -> DataFrame:
    """``category`` (else group), ``purpose`` (else summary) and ``url`` of a package."""
    small = meta.groupBy("host_id", F.col("name").alias("_key")).agg(*(F.max(c).alias(f"_{c}") for c in ("category", "group", "purpose", "summary", "url")))
    out = df.withColumn("_key", F.col(name)).join(small, ["host_id", "_key"], "left")
    out = out.withColumn("category", filled(F.col("_category"), F.col("_group"))).withColumn("purpose", filled(F.col("_purpose"), F.col("_summary"))).withColumn("url", filled(F.col("_url")))
    return out.drop("_key", "_category", "_group", "_purpose", "_summary", "_url")


def dependency_edges(apps: DataFrame, fields: Sequence[str] = ("depends", "recommends")) -> DataFrame:
    """``host_id, child, parent``: distinct edges from a package to those that it needs, names resolved by name or id."""
    wanted = apps.select("host_id", F.col("name").alias("child"), F.explode(F.split(F.concat_ws(" ", *fields), r"[\s,]+")).alias("_key")).where("_key <> ''").withColumn("_key", F.substring_index("_key", "/", 1))
    alias = apps.select("host_id", F.explode(F.array("name", F.col("app_id"))).alias("_key"), F.col("name").alias("parent")).where("_key <> ''").distinct()
    return wanted.join(alias, ["host_id", "_key"]).where("child <> parent").select("host_id", "child", "parent").distinct()


def dependency_fan(nodes: DataFrame, edges: DataFrame, key: str, by: Sequence[str] = ("host_id",), names: int = 12) -> DataFrame:
    """``deps_count, required_by, required_by_names`` of each node, from edges ``child, parent``."""
    out_n = edges.groupBy(*by, F.col("child").alias(key)).agg(F.count(F.lit(1)).alias("deps_count"))
    in_n = edges.groupBy(*by, F.col("parent").alias(key)).agg(F.count(F.lit(1)).alias("required_by"))
    rank = F.row_number().over(Window.partitionBy(*by, "parent").orderBy("child"))
    first = edges.withColumn("_r", rank).where(F.col("_r") <= names).groupBy(*by, F.col("parent").alias(key)).agg(F.array_join(F.array_sort(F.collect_list(F.col("child"))), ", ").alias("required_by_names"))
    keys = [*by, key]
    out = nodes.join(out_n, keys, "left").join(in_n, keys, "left").join(first, keys, "left")
    return out.fillna(0, ["deps_count", "required_by"]).fillna("", ["required_by_names"])


def age(df: DataFrame, time: str, as_of: Column, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "EEE dd MMM yyyy"), recent_days: int = 7) -> DataFrame:
    """``age_days`` and ``recent`` (yes up to ``recent_days``); a time that no format reads has none."""
    kind = dict(df.dtypes)[time]
    at = F.col(time).cast("timestamp") if kind.startswith(("timestamp", "date")) else F.coalesce(*(F.try_to_timestamp(F.col(time), F.lit(f)) for f in formats))
    out = df.withColumn("age_days", F.datediff(as_of, at))
    return out.withColumn("recent", F.when(F.col("age_days").between(0, recent_days), "yes").otherwise(""))


def path_tokens(df: DataFrame, row_keys: Sequence[str], command: str = "command") -> DataFrame:
    """``row_keys…, pos, token`` of a command line."""
    return df.select(*row_keys, F.posexplode(F.split(command, r"\s+")).alias("pos", "token")).where("token <> ''")


INTERPRETERS = ("bash", "sh", "zsh", "fish", "dash", "python", "python3", "perl", "ruby", "node", "java", "env")


def process_package(processes: DataFrame, files: DataFrame) -> DataFrame:
    """``package`` of each process: of its executable, or, for an interpreter or an unknown one, of the first path in its command that a package owns; kernel threads are ``kernel``."""
    keys = ["host_id", "pid"]
    own = files.select("host_id", usr_merged(F.col("path")).alias("_key"), "package").groupBy("host_id", "_key").agg(F.min("package").alias("_package"))
    by_exe = processes.select(*keys, usr_merged(F.col("exe")).alias("_key")).join(own, ["host_id", "_key"]).select(*keys, F.lit(0).alias("pos"), "_package", F.lit(True).alias("exe_hit"))
    tokens = path_tokens(processes, keys).withColumn("_key", usr_merged(F.col("token"))).where("_key LIKE '/%'").join(own, ["host_id", "_key"]).select(*keys, (F.col("pos") + 1).alias("pos"), "_package", F.lit(False).alias("exe_hit"))
    shell = F.regexp_replace(basename(F.col("exe")), r"[\d.]+$", "").isin(list(INTERPRETERS))
    hits = by_exe.unionByName(tokens).join(processes.select(*keys, shell.alias("_shell"), F.col("exe").alias("_exe")), keys)
    hits = hits.withColumn("_rank", F.when(F.col("_shell") & (F.col("exe_hit") | (F.col("pos") <= 1)), F.col("pos") + 1_000_000).otherwise(F.col("pos")))
    best = hits.groupBy(*keys).agg(F.min_by("_package", F.struct("_rank", "_package")).alias("_found"))
    kernel = blank(F.col("exe")) & F.col("command").startswith("[")
    return processes.join(best, keys, "left").withColumn("package", F.when(kernel, "kernel").otherwise(F.coalesce("_found", F.lit("")))).drop("_found")


def argument_files(processes: DataFrame, known: DataFrame, most: int = 12) -> DataFrame:
    """``arg_files``: paths in the command, other than the program's own, that the inventory knows."""
    keys = ["host_id", "pid"]
    hits = path_tokens(processes, keys).where("pos > 0 AND token LIKE '/%'").join(known.select("host_id", F.col("path").alias("token")).distinct(), ["host_id", "token"])
    first = hits.groupBy(*keys, "token").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    text = first.withColumn("_r", rank).where(F.col("_r") <= most).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), ", ").alias("arg_files"))
    return processes.join(text, keys, "left").fillna("", ["arg_files"])


def owner_pid(*columns: str) -> Column:
    """The pid in the first column that reads ``name (123)``."""
    return filled(*(F.regexp_extract(F.col(c), r"\((\d+)\)", 1) for c in columns))


def socket_owner(ports: DataFrame, processes: DataFrame) -> DataFrame:
    """Package, command, user and purpose of a socket's process, by pid."""
    small = processes.groupBy("host_id", "pid").agg(*(F.max(c).alias(n) for n, c in (("owner_package", "package"), ("owner_cmd", "command"), ("owner_user", "user"))))
    return ports.join(small, ["host_id", "pid"], "left").fillna("", ["owner_package", "owner_cmd", "owner_user"])


def port_service(ports: DataFrame, services: DataFrame) -> DataFrame:
    """``service`` by port and protocol, ``service_purpose`` from the owner, else from the comment of ports below 1024; ``service_risk`` from the exposure."""
    small = services.groupBy(F.col("port").cast("int").alias("_port"), F.col("proto").alias("_proto")).agg(F.min("service").alias("service"), F.min("comment").alias("_comment"))
    out = ports.withColumn("_port", F.col("port").try_cast("int")).withColumn("_proto", F.regexp_extract("proto", r"^[a-z]+", 0)).join(F.broadcast(small), ["_port", "_proto"], "left")
    purpose = F.when(~blank(F.col("owner_package")), F.col("owner_package")).when(F.col("_port") < 1024, F.coalesce("_comment", F.lit(""))).otherwise("")
    risk = F.when(F.col("exposure").startswith("OPEN"), "high").when(F.col("exposure").startswith("filtered"), "medium").otherwise("low")
    return out.withColumn("service", F.coalesce("service", F.lit(""))).withColumn("service_purpose", purpose).withColumn("service_risk", risk).drop("_port", "_proto", "_comment")


def token_owner(sockets: DataFrame, commands: DataFrame, host: str, port: str, key: Sequence[str], pid: str = "pid", command: str = "command", by: Sequence[str] = ("host_id",)) -> DataFrame:
    """``owner_pid, how`` of each socket whose remote host is a whole token of a command; the port beside it confirms; the first process wins."""
    tokens = commands.select(*by, F.col(pid).alias("owner_pid"), F.col(command).alias("_cmd"), F.explode(F.array_distinct(F.split(command, r"[\s=@/:,]+"))).alias("_token")).where("_token <> ''")
    hits = sockets.select(*key, *[b for b in by if b not in key], F.col(host).alias("_token"), F.col(port).cast("string").alias("_port")).join(tokens, [*by, "_token"])
    confirmed = F.array_contains(F.split("_cmd", r"[\s=@/:,]+"), F.col("_port"))
    best = hits.groupBy(*key).agg(F.min(F.struct(F.when(confirmed, 0).otherwise(1).alias("r"), F.col("owner_pid"))).alias("b"))
    return best.select(*key, F.col("b.owner_pid").alias("owner_pid"), F.when(F.col("b.r") == 0, "command line, port confirmed").otherwise("command line").alias("how"))


def recover_cascade(df: DataFrame, row_key: Sequence[str], value: str, lookups: Sequence[tuple[DataFrame, Sequence[str], str]], known: str, unknown: str, source: str = "process_source") -> DataFrame:
    """Fills an empty ``value`` from the lookups in their order, and says which one did.

    A lookup is a table with its keys and ``found``, one row a key, and the name of what it proves.
    """
    out = df
    for k, (table, keys, _) in enumerate(lookups):
        small = table.select(*(F.col(c).alias(f"_k{k}_{c}") for c in keys), F.col("found").alias(f"_f{k}"))
        out = out.join(small, reduce(and_, [F.col(c) == F.col(f"_k{k}_{c}") for c in keys]), "left").drop(*(f"_k{k}_{c}" for c in keys))
    how = F.when(~blank(F.col(value)), F.lit(known))
    for k, (_, _, says) in enumerate(lookups):
        how = how.when(~blank(F.col(f"_f{k}")), F.lit(says))
    filled_in = filled(F.col(value), *(F.col(f"_f{k}") for k in range(len(lookups))))
    return out.withColumn(source, how.otherwise(F.lit(unknown))).withColumn(value, filled_in).drop(*(f"_f{k}" for k in range(len(lookups))))


def latest_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column]) -> DataFrame:
    """``keys…, found``: the value of the last row of each key in which it is filled."""
    rows = df.where(~blank(F.col(value)))
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("found"))


def unique_candidate(df: DataFrame, keys: Sequence[str], candidate: str) -> DataFrame:
    """``keys…, found`` for keys with exactly one candidate; others are a guess and have none."""
    return df.groupBy(*keys).agg(F.min(candidate).alias("found"), F.countDistinct(candidate).alias("_n")).where("_n = 1").drop("_n")


def link_events(events: DataFrame, processes: DataFrame, ports: DataFrame) -> DataFrame:
    """``process_pid, process_source, process_alive`` and blanks filled: by the event's own pid, else by executable, name or object with one candidate, else by socket with one candidate."""
    exe = F.split("command", " ")[0]
    named = processes.select("host_id", F.col("pid").cast("string").alias("_pid"), F.explode(F.array_distinct(F.array(exe, basename(exe)))).alias("_key")).where("_key <> ''")
    names = unique_candidate(named, ["host_id", "_key"], "_pid")
    sockets = ports.select("host_id", F.col("pid").cast("string").alias("_pid"), F.explode(F.array("remote", "local")).alias("_key")).where("_key <> '' AND _pid <> ''")
    sockets = unique_candidate(sockets, ["host_id", "_key"], "_pid")
    out = events.withColumn("_own", F.coalesce(F.col("process_pid").cast("string"), F.lit("")))
    tries = []
    for k, c in enumerate(("process_executable", "process_name", "object_name")):
        for j, key in enumerate((F.col(c), basename(F.col(c)))):
            small = names.select("host_id", F.col("_key").alias(f"_k{k}{j}"), F.col("found").alias(f"_n{k}{j}"))
            out = out.withColumn(f"_k{k}{j}", F.nullif(key, F.lit(""))).join(small, ["host_id", f"_k{k}{j}"], "left")
            tries.append(F.col(f"_n{k}{j}"))
    out = out.withColumn("_sock", F.concat_ws(":", "destination_ip", F.col("destination_port").cast("string")))
    out = out.join(sockets.select("host_id", F.col("_key").alias("_sock"), F.col("found").alias("_bysock")), ["host_id", "_sock"], "left")
    by_name = F.coalesce(*tries)
    pid = filled(F.col("_own"), by_name, F.col("_bysock"))
    how = F.when(~blank(F.col("_own")), F.lit(None).cast("string")).when(by_name.isNotNull(), "matched by name").when(F.col("_bysock").isNotNull(), "matched by socket")
    source = F.col("process_source") if "process_source" in events.columns else F.lit("")
    out = out.withColumn("process_source", F.coalesce(how, source)).withColumn("_pid", pid)
    info = processes.groupBy("host_id", F.col("pid").cast("string").alias("_pid")).agg(F.max("command").alias("_cmd"), F.max("user").alias("_user"), F.max("package").alias("_pkg"))
    out = out.join(info, ["host_id", "_pid"], "left")
    first = F.split("_cmd", " ")[0]
    out = out.withColumn("process_alive", F.when(F.col("_pid") == "", "").when(F.col("_cmd").isNotNull(), "yes").otherwise("no"))
    for c, v in (("process_executable", first), ("process_name", basename(first)), ("user_name", F.col("_user")), ("package_name", F.col("_pkg"))):
        out = out.withColumn(c, filled(F.col(c), v) if c in events.columns else filled(v))
    out = out.withColumn("process_pid", F.col("_pid").try_cast("long"))
    return out.select(*events.columns, *(c for c in ("process_source", "process_alive", "process_executable", "process_name", "user_name", "package_name") if c not in events.columns))


def interval_asof(events: DataFrame, intervals: DataFrame, row_key: Sequence[str], ts: str = "ts", start: str = "start", end: str = "end", by: Sequence[str] = ("host_id",), add: Sequence[str] = ()) -> DataFrame:
    """Each event with the interval that holds its time and starts last; a null end is open.

    Intervals are exploded into days and joined by equality on ``by`` and day, so a
    host's events spread over its days and the join can be split further; open ones
    reach to the last event's day.
    """
    last = events.agg(F.max(ts).alias("_last_ts"))
    own = intervals.select(*by, F.col(start).alias("_start"), F.col(end).alias("_end"), *(F.col(c).alias(f"_v_{c}") for c in add)).join(F.broadcast(last), F.lit(True))
    until = F.greatest(F.coalesce("_end", "_last_ts"), F.col("_start"))
    days = own.withColumn("_day", F.explode(F.sequence(F.to_date("_start"), F.to_date(until)))).drop("_last_ts")
    marks = events.select(*by, *(c for c in row_key if c not in by), F.col(ts).alias("_t"), F.to_date(ts).alias("_day"))
    hits = marks.join(days, [*by, "_day"]).where("_start <= _t AND (_end IS NULL OR _t < _end)")
    facts = F.struct("_start", "_end", *(f"_v_{c}" for c in add))
    best = hits.groupBy(*row_key).agg(F.max_by(facts, F.struct("_start", "_end")).alias("_iv"))
    out = events.join(best, list(row_key), "left")
    return out.select(*events.columns, F.col("_iv._start").alias("interval_start"), F.col("_iv._end").alias("interval_end"), *(F.col(f"_iv._v_{c}").alias(c) for c in add))


def event_context(events: DataFrame, processes: DataFrame) -> DataFrame:
    """Blanks filled from the event's process and its parent: command line, parent's pid, name, executable and command line."""
    p = processes.select("host_id", F.col("pid").cast("long").alias("process_pid"), F.col("ppid").cast("long").alias("_ppid"), F.col("command").alias("_cmd"))
    pp = processes.select("host_id", F.col("pid").cast("long").alias("_ppid"), F.col("exe").alias("_pexe"), F.col("command").alias("_pcmd"))
    out = events.join(p, ["host_id", "process_pid"], "left").join(pp, ["host_id", "_ppid"], "left")
    have = lambda c: F.col(c).cast("string") if c in events.columns else F.lit("")
    added = {
        "process_command_line": filled(have("process_command_line"), F.col("_cmd")),
        "parent_pid": filled(have("parent_pid"), F.col("_ppid").cast("string")).try_cast("long"),
        "parent_name": filled(have("parent_name"), basename(F.split("_pcmd", " ")[0])),
        "parent_executable": filled(have("parent_executable"), F.col("_pexe")),
        "parent_command_line": filled(have("parent_command_line"), F.col("_pcmd")),
    }
    return out.select(*(c for c in events.columns if c not in added), *(v.alias(c) for c, v in added.items()))


#: What authentication messages say, fixed patterns of the programs that write them.
SSHD = r"(Accepted|Failed) (\S+) for (?:invalid user )?(\S+) from (\S+)"
PAM = r"pam_unix\(([^:)]+):session\): session (opened|closed) for user ([^(\s]+)"
SUDO = r"^\s*(\S+) : .*?TTY=(\S+) ; PWD=\S+ ; USER=(\S+) ; COMMAND=(.*)$"
FAILURE = r"(?i)(failed|failure|invalid user|incorrect password|not allowed)"


def authentication(events: DataFrame, message: str = "message") -> DataFrame:
    """``logon_type, user_target, source_ip, session_tty, event_outcome`` from sshd, PAM and sudo messages. Blanks only are filled, but a word of failure always makes a failure."""
    m = F.coalesce(F.col(message), F.lit(""))
    have = lambda c: F.col(c).cast("string") if c in events.columns else F.lit("")
    ssh, pam, sudo = (m.rlike(p) for p in (SSHD, PAM, SUDO))
    kind = F.when(ssh, F.concat(F.lit("ssh "), F.regexp_extract(m, SSHD, 2))).when(sudo, "sudo").when(pam, F.regexp_extract(m, PAM, 1)).otherwise("")
    target = F.when(ssh, F.regexp_extract(m, SSHD, 3)).when(sudo, F.regexp_extract(m, SUDO, 3)).when(pam, F.regexp_extract(m, PAM, 3)).otherwise("")
    good = F.when(ssh & (F.regexp_extract(m, SSHD, 1) == "Accepted"), "success").when(pam | sudo, "success").otherwise("")
    added = {
        "logon_type": filled(have("logon_type"), kind),
        "user_target": filled(have("user_target"), target),
        "source_ip": filled(have("source_ip"), F.regexp_extract(m, SSHD, 4)),
        "session_tty": filled(have("session_tty"), F.regexp_extract(m, SUDO, 2)),
        "event_outcome": F.when(m.rlike(FAILURE), "failure").otherwise(filled(have("event_outcome"), good)),
    }
    return events.select(*(c for c in events.columns if c not in added), *(v.alias(c) for c, v in added.items()))


def unit_health(services: DataFrame, failed: DataFrame) -> DataFrame:
    """``health``: failed where the unit is among the failed ones, else ok."""
    bad = failed.select("host_id", "scope", "unit").distinct().withColumn("_bad", F.lit(True))
    return services.join(bad, ["host_id", "scope", "unit"], "left").withColumn("health", F.when(F.col("_bad"), "failed").otherwise("ok")).drop("_bad")


def user_privileges(users: DataFrame, admin_groups: DataFrame, login_shells: DataFrame) -> DataFrame:
    """``admin_groups, can_login, privilege``: admin by uid 0 or by a group that gives rights, service without a login shell, else user."""
    own = users.select("host_id", "name", F.explode(F.split("groups", r"[\s,]+")).alias("group")).join(admin_groups.select("host_id", "group").distinct(), ["host_id", "group"])
    own = own.groupBy("host_id", "name").agg(F.array_join(F.array_sort(F.collect_set("group")), ", ").alias("admin_groups"))
    shells = login_shells.select("host_id", F.col("shell")).distinct().withColumn("can_login", F.lit("yes"))
    out = users.join(own, ["host_id", "name"], "left").join(shells, ["host_id", "shell"], "left").fillna("", ["admin_groups", "can_login"])
    return out.withColumn("privilege", F.when((F.col("uid") == "0") | (F.col("admin_groups") != ""), "admin").when(F.col("can_login") == "", "service").otherwise("user"))


def mount_exec_risk(mounts: DataFrame) -> DataFrame:
    """``exec_risk``: yes where users can write and programs may run."""
    writable = (F.col("world_writable") == "yes") | (F.col("user_writable") == "yes")
    noexec = F.array_contains(F.split("options", ","), "noexec")
    return mounts.withColumn("exec_risk", F.when(writable & ~noexec, "yes").otherwise(""))


def config_owner_services(configs: DataFrame, processes: DataFrame) -> DataFrame:
    """User-owned files under ``/etc/<name>/`` of programs that run as root: the third part of the path is the key of an equi-join."""
    roots = processes.where("user = 'root'").select("host_id", basename(F.split("command", " ")[0]).alias("service")).where("service <> ''").distinct()
    return configs.where("path LIKE '/etc/%/%' AND user_owned = 'yes'").withColumn("service", F.split("path", "/")[2]).join(roots, ["host_id", "service"])


def nearest_name(wanted: DataFrame, names: DataFrame, key: str, name: str, apart: int = 4) -> DataFrame:
    """``key, match``: the equal name, else one of which either is the other's beginning, at most ``apart`` characters apart; the nearest, then the first.

    Beginnings of up to ``apart`` characters less are joined by equality with the other side's whole names.
    """
    left = wanted.select(F.col(key)).where(~blank(F.col(key))).distinct()
    right = names.select(F.col(name).alias("match")).where(~blank(F.col("match"))).distinct()
    begins = lambda c: F.explode(F.transform(F.sequence(F.greatest(F.length(c) - apart, F.lit(1)), F.length(c)), lambda n: F.left(F.col(c), n))).alias("_begin")
    shorter = left.select(key, begins(key)).join(right.withColumn("_begin", F.col("match")), "_begin")
    longer = right.select("match", begins("match")).join(left.withColumn("_begin", F.col(key)), "_begin")
    hits = shorter.select(key, "match").unionByName(longer.select(key, "match"))
    gap = F.abs(F.length(key) - F.length("match"))
    return hits.groupBy(key).agg(F.min(F.struct(gap.alias("gap"), "match")).alias("b")).select(key, F.col("b.match").alias("match"))


def under_directories(rows: DataFrame, dirs: DataFrame, path: str = "path", by: Sequence[str] = ("host_id",)) -> DataFrame:
    """Rows with the deepest directory of ``dirs`` (``dir, owner``) above their path: paths' ancestors are exploded into an equi-join."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hits = rows.select(*by, path, F.explode(F.array_distinct(ups)).alias("dir")).where("dir <> ''").join(dirs.select(*by, "dir", "owner").distinct(), [*by, "dir"])
    best = hits.groupBy(*by, path).agg(F.max_by("owner", F.struct(F.length("dir"), "owner")).alias("owner"))
    return rows.join(best, [*by, path], "left")


def containing(rows: DataFrame, tokens: DataFrame, text: str, token: str, least: int = 4, by: Sequence[str] = ("host_id",)) -> DataFrame:
    """``by…, text, token``: which texts hold which tokens of at least ``least`` characters, anywhere and in the same case.

    Instead of comparing all texts with all tokens, both meet at a piece of ``least`` characters: each token at that of its own which the fewest texts
    have, so that a piece that most texts share leads to nobody it needn't; whatever meets is compared in whole.
    """
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - least + 1, F.lit(1))), lambda k: F.substring(c, k, F.lit(least))))
    texts = rows.select(*by, text).where(F.length(text) >= least).distinct()
    wanted = tokens.select(*by, token).where(F.length(token) >= least).distinct()
    inside = wanted.select(*by, token, F.explode(pieces(F.col(token))).alias("_piece"))
    held = texts.select(*by, text, F.explode(pieces(F.col(text))).alias("_piece")).join(inside.select(*by, "_piece").distinct(), [*by, "_piece"], "left_semi")
    often = held.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    # A token with a piece that no text has, is in none.
    rare = inside.join(often, [*by, "_piece"], "left").groupBy(*by, token).agg(F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_piece").alias("p"))).alias("_piece"))
    return held.join(rare, [*by, "_piece"]).where(F.contains(F.col(text), F.col(token))).select(*by, text, token)


def entity_files(rows: DataFrame, entities: DataFrame, path: str = "path", by: Sequence[str] = ("host_id",)) -> DataFrame:
    """``by…, path, entity``: which entities (``entity, dir, token``) a file or its description belongs to: it lies below the entity's directory, or holds its name."""
    below = under_all(rows, entities.where("dir <> ''").select(*by, "dir", "entity"), path, by)
    named = containing(rows, entities.select(*by, "token"), path, "token", by=by).join(entities.select(*by, "token", "entity").distinct(), [*by, "token"]).select(*by, path, "entity")
    return below.unionByName(named).distinct()


def under_all(rows: DataFrame, dirs: DataFrame, path: str = "path", by: Sequence[str] = ("host_id",)) -> DataFrame:
    """``by…, path, entity`` for every directory of ``dirs`` (``dir, entity``) above a path."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return rows.select(*by, path, F.explode(F.array_distinct(ups)).alias("dir")).where("dir <> ''").join(dirs.distinct(), [*by, "dir"]).select(*by, path, "entity").distinct()


def range_exposure(ports: DataFrame, ranges: DataFrame, port: str = "port", external: Column | None = None) -> DataFrame:
    """``exposure``: OPEN where the address is external and an allowed range holds the port, filtered where none does, else local-only.

    Ports have 65 536 values, so ranges are merged into one row a port and joined by equality.
    """
    allowed = ranges.select("host_id", F.explode(F.sequence(F.col("lo").cast("int"), F.least(F.col("hi").cast("int"), F.lit(65535)))).alias("_port")).distinct().withColumn("_open", F.lit(True))
    out = ports.withColumn("_port", F.col(port).try_cast("int")).join(allowed, ["host_id", "_port"], "left")
    external = F.col("external") == "yes" if external is None else external
    listening = F.col("state") == "LISTEN" if "state" in ports.columns else F.lit(True)
    exposure = F.when(~listening, "established").when(~external, "local-only").when(F.col("_open"), "OPEN (exposed)").otherwise("filtered (firewall)")
    return out.withColumn("exposure", exposure).drop("_port", "_open")


def ip_intel(df: DataFrame, intel: DataFrame, ip: str, private: Column) -> DataFrame:
    """``as_number, as_org, country`` of an address; private ones are called so."""
    small = intel.groupBy(F.col("ip").alias(ip)).agg(*(F.max(c).alias(c) for c in ("as_number", "as_org", "country")))
    out = df.join(small, ip, "left").fillna("", ["as_number", "as_org", "country"])
    return out.withColumn("as_org", F.when(private, "private network").otherwise(F.col("as_org")))

