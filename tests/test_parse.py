from pyspark.sql import functions as F

from fleetscope.operators import parse as P
from fleetscope.sources.lines import json_records, with_sections


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def test_exec_log(lines):
    r = one(P.exec_log(lines("BTIME 1750000000\nE\t123\t4242\t4200\t1000\t1000\t7\tcurl\t/usr/bin/curl -fsSL http://198.51.100.9/x")))
    assert (r["event_action"], r["process_pid"], r["parent_pid"], r["user_audit_id"], r["session_id"]) == ("process_started", 4242, 4200, "1000", "7")
    assert r["process_command_line"] == "/usr/bin/curl -fsSL http://198.51.100.9/x"
    r = one(P.exec_log(lines("BTIME 1750000000\nF\t200\t4242\t1000\tcode\twrite\t/home/x/.config/app/state.db")))
    assert (r["event_action"], r["event_category"], r["file_name"]) == ("file_modified", "file", "state.db")
    r = one(P.exec_log(lines("BTIME 1750000000\nN\t300\t4242\t1000\tfirefox\t4\t203.0.113.9\t443")))
    assert (r["event_action"], r["destination_port"], r["network_direction"]) == ("connection_opened", 443, "external")
    r = one(P.exec_log(lines("BTIME 1750000000\nX\t400\t4242\t256")))
    assert (r["event_action"], r["process_exit_code"], r["event_outcome"]) == ("process_ended", "1", "failure")
    r = one(P.exec_log(lines("BTIME 1750000000\nX\t400\t4242\t9")))
    assert r["event_outcome"] == "failure" and r["process_exit_code"] == "signal 9"


def test_exec_log_ignores_forged_and_early_lines(lines):
    assert P.exec_log(lines("X\t1\t2\t0\nBTIME 1750000000\nE\tfoo\nX\t400\tabc\t9")).count() == 0


def test_processes(lines):
    r = one(P.processes(lines("1234\t/usr/bin/btop\t1 local 0.5 0.2 20480 S 01:02 btop --utf-force")))
    assert (r["pid"], r["exe"], r["user"], r["rss_mb"], r["command"]) == ("1234", "/usr/bin/btop", "local", 20.0, "btop --utf-force")
    r = one(P.processes(lines("7\t\t2 root 0.0 0.0 0 S 10:00 [kworker/0:1]")))
    assert r["exe"] == "" and r["command"] == "[kworker/0:1]"


def test_delimited_sources(lines):
    assert P.parse_source(lines("rpm\tbash\t\t5.2.15\t/usr/bin/bash\tglibc\tGNU Bourne-Again Shell\nrpm"), "applications").count() == 1
    assert P.parse_source(lines("/usr/bin/btop\t-rwxr-xr-x\tbtop\nnothing"), "package_files").count() == 1
    signed = P.parse_source(lines("nvidia\t1000\t2\tx\ty\tFedora key\nother\t1\t0\t\t\t"), "kmods").select("module", "signed")
    assert {tuple(r) for r in signed.collect()} == {("nvidia", "yes"), ("other", "no")}
    intel = P.parse_source(lines("8.8.8.8\t15169\tExample\tUS\n10.0.0.1\n8.8.8.8\t15169\tExample\tUS"), "ip_intel")
    assert {(r.ip, r.scope) for r in intel.collect()} == {("8.8.8.8", "public"), ("10.0.0.1", "private")}
    assert P.parse_source(lines(""), "users").count() == 0


def test_boots_and_logins(lines):
    r = one(P.boot_sessions(lines("boot\t -3 " + "ab" * 16 + " Wed 2026-07-22 11:05:19 +03 Wed 2026-07-22 11:07:16 +03")))
    assert (r["kind"], r["started"], r["ended"]) == ("boot", "2026-07-22T08:05:19Z", "2026-07-22T08:07:16Z")
    rows = P.logins(lines("local tty2 login 2026-07-22T11:05:19+03:00 - 2026-07-22T12:05:19+03:00 (01:00)\nlocal tty3 login 2026-07-22T11:05:19+03:00 still logged in")).orderBy("tty").collect()
    assert (rows[0].start, rows[0].until, rows[0].duration) == ("2026-07-22T08:05:19Z", "2026-07-22T09:05:19Z", "01:00")
    assert rows[1].until == "" and rows[1].active == "yes"


def test_sections(lines):
    got = with_sections(lines("early\n===PKG===\na\n===PROVIDES===\nb\nc")).orderBy("line_no").select("section", "line").collect()
    assert [tuple(r) for r in got] == [(None, "early"), ("PKG", "a"), ("PROVIDES", "b"), ("PROVIDES", "c")]


def test_json_lines_skip_others(lines):
    assert [r.a for r in json_records(lines('{"a": 1}\nnoise\n{"a": 2}'), "a int").orderBy("line_no").collect()] == [1, 2]


def test_key_values_first_wins(spark):
    m = spark.range(1).select(P.key_values(F.lit("""a="x y" b='z' a=second c=""")).alias("m")).first().m
    assert m == {"a": "x y", "b": "z", "c": ""}


def test_audit_assembly_and_classes(spark):
    rows = spark.createDataFrame(
        [("h", "b", "7", 1, {"type": "1300"}, "syscall=59 success=yes uid=0 pid=10 ppid=2 exe=\"/usr/bin/ls\""), ("h", "b", "7", 2, {"type": "1327"}, "proctitle=6C73002D6C uid=5"), ("h", "b", "8", 3, {"type": "1306"}, "saddr=020001BBC6336409 syscall=42 success=no")],
        "host_id string, boot_id string, audit_id string, line_no long, fields map<string,string>, message string",
    )
    got = {r.event_id: r for r in P.classify_audit(P.audit_events(P.audit_records(rows))).collect()}
    a = got["audit:b:7"]
    assert (a.event_action, a.process_pid, a.process_command_line, a.user_id, a.event_outcome, a.event_severity) == ("process_started", 10, "ls -l", "0", "success", 25)
    b = got["audit:b:8"]
    assert (b.destination_ip, b.destination_port, b.event_category, b.event_severity) == ("198.51.100.9", 443, "network", 35)


def test_subject_object_axis(spark):
    df = spark.createDataFrame([("", "sshd", "", "10.0.0.1", 22, ""), ("u", "", "/etc/x", "", None, ""), ("", "", "", "", None, "")], "user_name string, process_name string, file_path string, destination_ip string, destination_port long, package_name string")
    got = [(r.subject_type, r.subject_name, r.object_type, r.object_name) for r in P.subject_object(df).collect()]
    assert got == [("process", "sshd", "socket", "10.0.0.1:22"), ("user", "u", "file", "/etc/x"), ("system", "system", "", "")]


def test_verify_flags(lines):
    got = {r.file_path: r for r in P.verify_events(lines("S.5....T.  c /etc/a\n.M.......    /usr/bin/b\nmissing     /usr/bin/c\n.........    /usr/d\nrubbish")).collect()}
    assert got["/etc/a"].changed == "size, digest, time" and got["/etc/a"].event_action == "file_modified"
    assert got["/usr/bin/b"].event_action == "file_permissions_changed"
    assert got["/usr/bin/c"].event_action == "file_missing"
    assert "/usr/d" not in got


def test_kernel_params_precedence(spark):
    declared = spark.createDataFrame([("h", "/usr/lib/sysctl.d/10-a.conf", 1, 1, "net.x", "0"), ("h", "/etc/sysctl.d/10-a.conf", 3, 1, "net.x", "1"), ("h", "/etc/sysctl.d/20-b.conf", 3, 1, "net.*.rp", "2"), ("h", "/etc/sysctl.d/30-c.conf", 3, 1, "vm.none", "5")], "host_id string, file string, priority int, line_no int, param string, value string")
    running = spark.createDataFrame([("h", "net.x", "1"), ("h", "net.eth0.rp", "1"), ("h", "net.lo.rp", "2")], "host_id string, param string, value string")
    got = {r.param: (r.status, r.declared) for r in P.kernel_params(declared, running).collect()}
    assert got == {"net.x": ("ok", "1"), "net.eth0.rp": ("differs", "2"), "net.lo.rp": ("ok", "2"), "vm.none": ("not applied", "5")}


def test_advisories(spark):
    records = spark.createDataFrame([("h", "A-1", "closed", "Important", "t", ["openssl", "absent"], "fixes CVE-2026-1001 and CVE-2026-1002")], "host_id string, advisory string, status string, severity string, title string, packages array<string>, text string")
    installed = spark.createDataFrame([("h", "openssl"), ("h", "bash")], "host_id string, name string")
    scores = spark.createDataFrame([("CVE-2026-1001", "5.3", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N"), ("CVE-2026-1002", "", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")], "cve string, score string, vector string")
    r = one(P.advisories(records, installed, scores))
    assert (r["cvss_score"], r["cvss_rating"], r["cvss_covered"], r["packages"]) == (9.8, "Critical", "2/2", "openssl")


def test_capabilities(spark):
    pkgs = spark.createDataFrame([("h", "btop", "(a or b) librocm.so.1()(64bit) /bin/sh"), ("h", "x", "")], "host_id string, name string, recommends string")
    provides = spark.createDataFrame([("h", "librocm.so.1()(64bit)", "rocm-smi")], "host_id string, capability string, package string")
    chosen = spark.createDataFrame([("h", "btop")], "host_id string, name string")
    got = {r.name: r for r in P.resolve_capabilities(pkgs, provides, "recommends", chosen).collect()}
    assert got["btop"].recommends == "a b rocm-smi" and got["btop"].install_reason == "user" and got["x"].recommends == ""


def test_other_parsers(lines, spark):
    t = {r.unit: (r.seconds, r.impact) for r in P.boot_times(lines("1min 2.3s slow.service\n15ms fast.service\n4.5s mid.service")).collect()}
    assert t == {"slow.service": (62.3, "high"), "fast.service": (0.015, "low"), "mid.service": (4.5, "medium")}
    m = P.mounts(lines("/ /dev/sda1 ext4 rw,noexec,nosuid\n/proc proc proc rw")).collect()
    assert [(r.target, r.hardening) for r in m] == [("/", "noexec, nosuid")]
    s = {r.local: r for r in P.sockets(lines("tcp LISTEN 0 128 0.0.0.0:22 0.0.0.0:* sshd\ntcp ESTAB 0 0 10.0.0.2:5000 203.0.113.9:443 firefox")).collect()}
    assert (s["0.0.0.0:22"].port, s["0.0.0.0:22"].external, s["0.0.0.0:22"].remote) == ("22", "yes", "")
    f = {r.fd: (r.kind, r.deleted, r.dir) for r in P.open_files(lines("1\ta\t3\t/home/x/f (deleted)\n1\ta\t4\tsocket:[5]")).collect()}
    assert f == {"3": ("file", "yes", "/home/x"), "4": ("socket", "", "")}
    keys = spark.createDataFrame([("h", "/k/id", 0, "PRIVATE"), ("h", "/k/id.pub", 0, "ssh-rsa AAAA me at home"), ("h", "/k/id.pub", 1, "note"), ("h", "/k/bad.pub", 0, "-----BEGIN RSA PRIVATE KEY-----"), ("h", "/k/odd", 0, "")], "host_id string, path string, line_no int, line string")
    k = {r.path: (r.kind, r.types, r.comment, r.weak, r["count"]) for r in P.ssh_keys(keys).collect()}
    assert k == {"/k/id": ("private", "private key", "", "", 1), "/k/id.pub": ("public", "ssh-rsa", "me at home", "ssh-rsa ~18 bits", 2), "/k/bad.pub": ("private", "private key stored as .pub (!)", "", "", 1), "/k/odd": ("public", "key", "", "", 1)}
    x = spark.createDataFrame([("h", '<action id="a.b"><description>T</description><defaults><allow_any>no</allow_any><allow_active>yes</allow_active></defaults></action>')], "host_id string, text string")
    assert one(P.polkit_actions(x))["risk"] == "high"
    e = P.carry_stamps(lines("#1700000000\nls\npwd\n: 1700000100:0;make"), ["host_id", "run_id"]).orderBy("line_no").collect()
    assert [(r.command, r.epoch) for r in e] == [("ls", 1700000000), ("pwd", None), ("make", 1700000100)]


def test_merge_copies(spark):
    df = spark.createDataFrame([("h", "e", 1, "", "1.0"), ("h", "e", 2, "Name", "1.1"), ("h", "e", 3, "Late", "1.0")], "host_id string, ext_id string, line_no int, title string, version string")
    r = one(P.merge_copies(df, ["host_id", "ext_id"]))
    assert (r["title"], r["version"], r["copies"]) == ("Name", "1.0, 1.1", 3)
