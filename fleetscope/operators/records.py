"""Records of several lines: zones with indented items, marked chunks, folded files, interfaces.

Lines of one run of a source (``host_id, run_id``) are put in segments by a running last value over ``line_no``; a segment is then one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.scalars import basename

RUN = ("host_id", "run_id")


def segments(lines: DataFrame, head: Column, by: Sequence[str] = RUN, order: str = "line_no") -> DataFrame:
    """``lines`` with ``segment`` and ``head``: place and value of the last line up to this one whose ``head`` isn't null; null before the first."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(head.isNotNull(), F.struct(F.col(order).alias("segment"), head.alias("head"))), ignorenulls=True).over(before)
    return lines.withColumn("_last", last).select("*", F.col("_last.segment").alias("segment"), F.col("_last.head").alias("head")).drop("_last")


def bodies(segmented: DataFrame, by: Sequence[str] = RUN, order: str = "line_no", line: str = "line", more: Sequence[str] = ("segment", "head")) -> DataFrame:
    """``by…, more…, body``: each segment's lines after its head, joined by line feeds."""
    text = F.when(F.col(order) > F.col("segment"), F.struct(F.col(order).alias("no"), F.col(line).alias("line")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: F.coalesce(x["line"], F.lit(""))), "\n")
    return segmented.where("segment IS NOT NULL").groupBy(*by, *more).agg(listed.alias("body"))


def _group(c: str | Column, pattern: str, k: int = 1) -> Column:
    """A group of the pattern's first match, null if there is none."""
    column = F.col(c) if isinstance(c, str) else c
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, k))


def firewall(lines: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """``zone, item, value``: items of zones, of policies (``policy:<name>``) and global settings; sections are parted by ``---POLICIES---`` and ``---MISC---``."""
    mark = F.when(F.col("line").isin("---POLICIES---", "---MISC---"), F.col("line"))
    rows = segments(lines, mark, by).withColumnRenamed("head", "section").drop("segment").where(mark.isNull())
    misc = rows.where("section = '---MISC---'").select(*by, "line_no", F.lit("global").alias("zone"), _group("line", r"^([a-z_]+)=(.+)$").alias("item"), F.trim(F.regexp_extract("line", r"^([a-z_]+)=(.+)$", 2)).alias("value"))
    listed = rows.where("section IS NULL OR section = '---POLICIES---'")
    name = F.when((F.col("line") != "") & ~F.col("line").rlike(r"^[ \t]"), F.concat(F.when(F.col("section").isNull(), "").otherwise("policy:"), F.split_part("line", F.lit(" "), F.lit(1))))
    item = r"^\s+([a-z_-]+):\s*(.+)$"
    listed = segments(listed, name, by).where((F.col("head") != "") & name.isNull()).select(*by, "line_no", F.col("head").alias("zone"), _group("line", item).alias("item"), F.trim(F.regexp_extract("line", item, 2)).alias("value"))
    return listed.unionByName(misc).where("item IS NOT NULL")


def virtual_machines(lines: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """``vm_id, name, state, disks, networks, content``: a listing, and below ``===VM <name>===`` the definition of each machine; the last one of a name counts."""
    marked = segments(lines, _group("line", r"^===VM (.*?)===").cast("string"), by)
    first = F.regexp_replace("line", r"^===VM .*?===", "")
    text = F.when(F.col("line_no") == F.col("segment"), first).otherwise(F.col("line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("line")))), lambda x: x["line"]), "\n")
    chunks = marked.where("segment IS NOT NULL").groupBy(*by, "segment", F.trim("head").alias("name")).agg(whole.alias("content"))
    chunks = chunks.groupBy(*by, "name").agg(F.max_by("content", "segment").alias("content"))
    listing, parts = F.trim("line"), r"^(\S+)\s+(\S+)\s+(.+)$"
    rows = marked.where(F.col("segment").isNull() & listing.rlike(parts) & ~listing.contains("----")).select(*by, "line_no", *(F.regexp_extract(listing, parts, k).alias(c) for k, c in enumerate(("vm_id", "name", "state"), 1))).where("vm_id <> 'Id'")
    found = rows.join(chunks, [*by, "name"], "left").fillna("", ["content"])
    listed = lambda pattern: F.array_join(F.regexp_extract_all("content", F.lit(pattern), 1), "; ")
    return found.select(*by, "vm_id", "name", F.trim("state").alias("state"), listed("<source (?:file|dev)='([^']+)'").alias("disks"), listed("<mac address='([^']+)'").alias("networks"), "content")


def cron(lines: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """``kind, name, scope, detail, next, source, content``: lines ``<source>|<text>`` folded into one row a source; comments and blank lines are no entries."""
    cells = lines.where(F.col("line").contains("|")).select(*by, "line_no", F.split("line", r"\|", 2).alias("f")).select(*by, "line_no", F.get("f", F.lit(0)).alias("source"), F.get("f", F.lit(1)).alias("body"))
    entry = (F.trim("body") != "") & ~F.ltrim("body").startswith("#")
    files = cells.groupBy(*by, "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), "\n").alias("content"), F.count_if(entry).alias("n"))
    return files.select(*by, F.lit("cron").alias("kind"), basename(F.col("source")).alias("name"), F.when(F.col("source") == "user_crontab", "user").otherwise("system").alias("scope"), F.concat(F.col("n").cast("string"), F.lit(" entries")).alias("detail"), F.lit("").alias("next"), "source", "content")


def autostart(lines: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """``kind, name, scope, detail, next, source, content``: below ``==> <path>`` an entry's text; hidden ones are left out. Text before the first mark is an entry headed by its first line."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy("line_no")) == 1
    rows = lines.withColumn("_first", first)
    head = F.when(F.col("line").startswith("==> ") | F.col("_first"), F.trim(F.regexp_replace("line", "^==> ", "")))
    found = bodies(segments(rows, head, by), by).where((F.col("head") != "") & (F.lower(F.coalesce(_group("body", r"(?m)^Hidden=(.*)$"), F.lit(""))) != "true"))
    said = lambda key: F.trim(_group("body", rf"(?m)^{key}=(.*)$"))
    return found.select(
        *by, F.lit("autostart").alias("kind"), F.coalesce(said("Name"), F.col("head")).alias("name"), F.when(F.col("head").startswith("/etc/xdg"), "system").otherwise("user").alias("scope"),
        F.coalesce(said("Exec"), F.lit("")).alias("detail"), F.lit("").alias("next"), F.col("head").alias("source"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("content"),
    )


def dns(lines: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """``kind, name, value``: lines of resolver, links, global settings and hosts, each tagged before a tab."""
    rows = lines.withColumn("f", F.split("line", "\t")).where(F.size("f") >= 2)
    cell = lambda k: F.coalesce(F.get("f", F.lit(k)), F.lit(""))
    word, rest = F.regexp_extract(cell(1), r"^\s*(\S+)", 1), F.regexp_extract(cell(1), r"(?s)^\s*\S+\s+(\S.*)$", 1)
    tag, three = cell(0), F.size("f") >= 3
    kind = F.when(tag.isin("resolv", "hosts"), tag).when(three & (tag == "link-dns"), "dns").when(three & (tag == "link-domain"), "domain").when(three & (tag == "global"), "global")
    name = F.when(tag == "resolv", word).when(tag == "hosts", rest).otherwise(cell(1))
    value = F.when(tag == "resolv", rest).when(tag == "hosts", word).otherwise(cell(2))
    return rows.select(*by, "line_no", kind.alias("kind"), name.alias("name"), value.alias("value")).where("kind IS NOT NULL")


#: Kinds of interfaces in the order in which they are looked for (fixed values).
INTERFACE_KINDS = ("bridge", "vlan", "veth", "vxlan", "bond", "macvlan", "wireguard", "vrf", "gre", "sit")


def network(lines: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """``iface, state, mac, mtu, kind, promisc, ipv4, ipv6``: lines ``link`` and ``addr`` of the same interface; a link that is told again starts it anew."""
    rows = lines.withColumn("f", F.split("line", "\t", 2)).where(F.size("f") == 2).select(*by, "line_no", F.get("f", F.lit(0)).alias("tag"), F.get("f", F.lit(1)).alias("body"))
    link = r"\d+:\s+(\S+?)(?:@\S+)?:\s+<[^>]*>\s+mtu\s+(\d+).*?state (\S+)"
    hardware = r"link/(\w+)\s+([0-9a-f:]{17})"
    kind = F.when(F.regexp_extract("body", hardware, 1) == "loopback", "loopback").otherwise("ether")
    for name in reversed(INTERFACE_KINDS):
        kind = F.when(F.col("body").rlike(rf"\b{name}\b"), name).otherwise(kind)
    kind = F.coalesce(_group("body", r"\btun type (\w+)"), kind)
    promisc = F.when(F.coalesce(_group("body", r"promiscuity (\d+)"), F.lit("0")) != "0", "yes").otherwise("")
    about = F.struct(F.regexp_extract("body", link, 3).alias("state"), F.regexp_extract("body", hardware, 2).alias("mac"), F.regexp_extract("body", link, 2).alias("mtu"), kind.alias("kind"), promisc.alias("promisc"))
    links = rows.where((F.col("tag") == "link") & F.col("body").rlike(link)).select(*by, "line_no", F.regexp_extract("body", link, 1).alias("iface"), about.alias("about"), F.lit(None).cast("struct<no:bigint,six:boolean,ip:string>").alias("addr"))
    address = r"\d+:\s+(\S+)\s+inet(6?)\s+(\S+)"
    given = F.struct(F.col("line_no").cast("long").alias("no"), (F.regexp_extract("body", address, 2) == "6").alias("six"), F.regexp_extract("body", address, 3).alias("ip"))
    addrs = rows.where((F.col("tag") == "addr") & F.col("body").rlike(address)).select(*by, "line_no", F.regexp_extract("body", address, 1).alias("iface"), F.lit(None).cast(links.schema["about"].dataType).alias("about"), given.alias("addr"))
    found = links.unionByName(addrs).groupBy(*by, "iface").agg(F.max_by("about", F.when(F.col("about").isNotNull(), F.col("line_no"))).alias("about"), F.max(F.when(F.col("about").isNotNull(), F.col("line_no"))).alias("since"), F.array_sort(F.collect_list("addr")).alias("addrs")).where("since IS NOT NULL")
    listed = lambda six: F.array_join(F.transform(F.filter("addrs", lambda x: (x["no"] > F.col("since")) & (x["six"] == six)), lambda x: x["ip"]), " ")
    return found.select(*by, "iface", "about.*", listed(False).alias("ipv4"), listed(True).alias("ipv6"))


#: Capabilities that give root in effect (fixed values).
RISKY_CAPABILITIES = (
    "cap_setuid", "cap_setgid", "cap_dac_override", "cap_dac_read_search", "cap_sys_admin", "cap_sys_ptrace", "cap_sys_module", "cap_sys_rawio", "cap_net_admin", "cap_bpf", "cap_perfmon", "cap_setfcap", "cap_chown", "cap_fowner",
)


def privilege_vectors(lines: DataFrame, as_of: Column, by: Sequence[str] = RUN) -> DataFrame:
    """``kind, name, detail, risk, nopasswd, source, changed, age_days``: file capabilities, rules that ``sudo -l`` lists and rules of sudoers files, from sections ``===CAPS===``, ``===SUDO===``, ``===SUDOERS===`` and, for when their carriers changed, ``===MTIME===``.

    A rule of ``sudo -l`` has the newest time of any sudoers file. Risk is high for risky capabilities and rules without a password, else info.
    """
    trimmed = F.trim("line")
    head = F.when(trimmed.isin("===CAPS===", "===SUDO===", "===SUDOERS===", "===MTIME==="), F.regexp_replace(trimmed, "=", ""))
    rows = segments(lines, head, by).where(head.isNull() & (trimmed != "")).select(*by, "line_no", F.col("head").alias("section"), "line", trimmed.alias("s"))
    times = rows.where((F.col("section") == "MTIME") & F.col("line").contains("\t")).select(*by, "line_no", F.trim(F.split("line", "\t", 2)[1]).alias("source"), F.substring(F.trim(F.split("line", "\t", 2)[0]), 1, 19).alias("at"))
    times = times.groupBy(*by, "source").agg(F.max_by("at", "line_no").alias("at"))
    newest = times.where(F.col("source").startswith("/etc/sudoers")).groupBy(*by).agg(F.max("at").alias("newest"))
    last, rule, tab = F.substring_index("s", " ", -1), r"\(([^)]*)\)\s*(.+)$", F.split("s", "\t", 2)
    risky = F.lit(False)
    for c in RISKY_CAPABILITIES:
        risky = risky | F.col("detail").contains(c)
    free = lambda c: F.when(c.contains("NOPASSWD"), "yes").otherwise("")
    spaced = F.col("s").contains(" ")
    caps = rows.where("section = 'CAPS'").select(*by, "line_no", F.lit("capability").alias("kind"), F.when(spaced, F.expr("substr(s, 1, length(s) - length(substring_index(s, ' ', -1)) - 1)")).otherwise(F.col("s")).alias("name"), F.when(spaced, last).otherwise("").alias("detail"), F.lit("").alias("nopasswd"), F.lit("getcap").alias("source"))
    caps = caps.withColumn("carrier", F.col("name")).withColumn("risk", F.when(risky, "high").otherwise("info"))
    said = F.regexp_extract("s", rule, 2)
    live = rows.where((F.col("section") == "SUDO") & F.col("s").rlike(rule)).select(*by, "line_no", F.lit("sudo").alias("kind"), F.trim(F.regexp_replace(said, r"^\s*(NOPASSWD|PASSWD|SETENV|NOEXEC|EXEC)\s*:\s*", "")).alias("name"), F.concat(F.lit("runas "), F.regexp_extract("s", rule, 1)).alias("detail"), free(said).alias("nopasswd"), F.lit("sudo -l").alias("source"), F.lit("").alias("carrier"))
    kept = rows.where((F.col("section") == "SUDOERS") & F.col("s").contains("\t")).select(*by, "line_no", F.lit("sudoers").alias("kind"), F.trim(tab[1]).alias("name"), F.lit("").alias("detail"), free(tab[1]).alias("nopasswd"), tab[0].alias("source"), tab[0].alias("carrier"))
    ruled = live.unionByName(kept).withColumn("risk", F.when(F.col("nopasswd") != "", "high").otherwise("info"))
    out = caps.unionByName(ruled).join(times.withColumnRenamed("source", "carrier"), [*by, "carrier"], "left").join(newest, list(by), "left")
    changed = F.coalesce(F.when(F.col("kind") == "sudo", F.col("newest")).otherwise(F.col("at")), F.lit(""))
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(F.try_to_timestamp("changed", F.lit("yyyy-MM-dd HH:mm:ss")))) / 86400)
    return out.withColumn("changed", changed).withColumn("age_days", age).select(*by, "kind", "name", "detail", "risk", "nopasswd", "source", "changed", "age_days")
