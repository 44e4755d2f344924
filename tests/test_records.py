from fleetscope.operators import records as R
from fleetscope.plans import queries_records


def got(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_firewall_zones_policies_and_settings(lines):
    text = "public (active)\n  target: default\n  services: ssh dhcpv6-client\n\twrong\n  ports: \ndrop\n  target: DROP\n---POLICIES---\n  late: x\nallow-host (active)\n  priority: -15000\n---MISC---\ndefault_zone=public\nBAD=1\nlog_denied= off "
    assert got(R.firewall(lines(text)), "zone", "item", "value") == [("drop", "late", "x"), ("drop", "target", "DROP"), ("global", "default_zone", "public"), ("global", "log_denied", "off"), ("policy:allow-host", "priority", "-15000"), ("public", "ports", ""), ("public", "services", "ssh dhcpv6-client"), ("public", "target", "default")]


def test_virtual_machines(lines):
    text = " Id   Name   State\n----------\n 1    web    running\n -    db     shut off\n\n===VM web===\n<disk><source file='/a.img'/><source dev='/dev/b'/></disk>\n<mac address='52:54'/>\n===VM web=== <source file='/c.img'/>\n"
    assert got(R.virtual_machines(lines(text)), "vm_id", "name", "state", "disks", "networks") == [("-", "db", "shut off", "", ""), ("1", "web", "running", "/c.img", "")]


def test_cron_folds_sources(lines):
    text = "/etc/crontab|# head\n/etc/crontab|1 2 * * * root run\nuser_crontab|@daily x\nno bar\n/etc/crontab|\n/etc/crontab| 5 5 * * * a|b"
    rows = {r.source: (r.name, r.scope, r.detail, r.content) for r in R.cron(lines(text)).collect()}
    assert rows == {"/etc/crontab": ("crontab", "system", "2 entries", "# head\n1 2 * * * root run\n\n 5 5 * * * a|b"), "user_crontab": ("user_crontab", "user", "1 entries", "@daily x")}


def test_autostart_entries(lines):
    text = "==> /etc/xdg/autostart/a.desktop\n[Desktop Entry]\nName= A app\nExec=/usr/bin/a --x\nName=second\n==> /home/u/b.desktop\nHidden=TRUE\nName=B\n==> /home/u/c.desktop\n\n"
    rows = {r.source: (r.name, r.scope, r.detail, r.content) for r in R.autostart(lines(text)).collect()}
    assert rows == {"/etc/xdg/autostart/a.desktop": ("A app", "system", "/usr/bin/a --x", "[Desktop Entry]\nName= A app\nExec=/usr/bin/a --x\nName=second"), "/home/u/c.desktop": ("/home/u/c.desktop", "user", "", "")}


def test_dns_lines(lines):
    text = "resolv\tnameserver  10.0.0.1\nresolv\tedns0\nlink-dns\teth0\t10.0.0.2\nlink-domain\teth0\nglobal\tDNSSEC\tno\nhosts\t127.0.0.1   localhost local\nodd\tx\nnothing"
    assert got(R.dns(lines(text)), "kind", "name", "value") == [("dns", "eth0", "10.0.0.2"), ("global", "DNSSEC", "no"), ("hosts", "localhost local", "127.0.0.1"), ("resolv", "edns0", ""), ("resolv", "nameserver", "10.0.0.1")]


def test_network_interfaces(lines):
    text = "\n".join([
        "link\t1: lo: <LOOPBACK,UP> mtu 65536 qdisc noqueue state UNKNOWN link/loopback 00:00:00:00:00:00 promiscuity 0", "addr\t1: lo inet 127.0.0.1/8", "addr\t1: lo inet6 ::1/128", "addr\t7: eth9 inet 1.1.1.1/8",
        "link\t2: veth1@if3: <UP> mtu 1500 qdisc x state UP link/ether 52:54:00:00:00:01 promiscuity 1 veth", "addr\t2: veth1 inet 10.0.0.2/24", "addr\t2: veth1 inet 10.0.0.3/24",
        "link\t3: tun0: <UP> mtu 1400 state DOWN link/none tun type tap bridge", "link\t4: br0: <UP> mtu 1500 state UP link/ether 52:54:00:00:00:02", "addr\t4: br0 inet 10.1.0.1/24", "link\t4: br0: <UP> mtu 9000 state UP link/ether 52:54:00:00:00:02 bridge", "odd line",
    ])
    assert got(R.network(lines(text)), "iface", "state", "mac", "mtu", "kind", "promisc", "ipv4", "ipv6") == [
        ("br0", "UP", "52:54:00:00:00:02", "9000", "bridge", "", "", ""), ("lo", "UNKNOWN", "00:00:00:00:00:00", "65536", "loopback", "", "127.0.0.1/8", "::1/128"), ("tun0", "DOWN", "", "1400", "tap", "", "", ""), ("veth1", "UP", "52:54:00:00:00:01", "1500", "veth", "yes", "10.0.0.2/24 10.0.0.3/24", ""),
    ]


def test_addresses_come_by_order_line_and_supplier_whatever_the_keys(spark, tmp_path):
    spark.createDataFrame([(7, 1), (8, 2)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    items = [(1, 7, 50_000, 2), (1, 7, 1, 4), (1, 7, 9_000, 4), (1, 7, 60_000, 1), (1, 7, 2, 5), (10**15, 7, 3, 6), (None, 7, 4, 2), (1, 7, 5, None), (2, 8, 6, 2)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = queries_records.network_interfaces(spark, str(tmp_path))
    assert got(found, "iface", "ipv4", "ipv6") == [("if7", "10.0.2.50000/24 10.0.4.1/24 10.0.4.9000/24 10.0.6.3/24 10.0.2.4/24", "fe80::60000/64 fe80::2/64"), ("if8", "10.0.2.6/24", "")]
