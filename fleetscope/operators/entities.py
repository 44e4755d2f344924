"""Entities: what programs processes belong to, and which packages are programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.scalars import basename, blank, elapsed_seconds
from fleetscope.operators.enrich import INTERPRETERS, dependency_edges, nearest_name
from fleetscope.operators.hierarchy import nearest_ancestor

TIERS = ("kernel", "vendor", "product", "package", "script", "exe")


def identity(tiers: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """Tier and name by the first tier that has a name."""
    tier = name = None
    for k, c in tiers:
        has = F.coalesce(c, F.lit("")) != ""
        tier = F.when(has, k) if tier is None else tier.when(has, k)
        name = F.when(has, c) if name is None else name.when(has, c)
    return tier.otherwise(""), name.otherwise("")


def identify(processes: DataFrame, applications: DataFrame) -> DataFrame:
    """``tier, entity`` of each process: kernel thread; vendor directory below /opt; application of the executable's or script's name; package; script of an interpreter; executable."""
    exe, command = F.col("exe"), F.col("command")
    words = F.split(command, r"\s+")
    shell = F.regexp_replace(basename(exe), r"[\d.]+$", "").isin(list(INTERPRETERS))
    script = F.when(shell, F.element_at(F.filter(F.slice(words, 2, 1000), lambda w: ~w.startswith("-") & w.contains("/")), 1))
    rows = processes.withColumn("_script", F.coalesce(script, F.lit(""))).withColumn("_name", F.lower(F.when(F.col("_script") != "", F.regexp_replace(basename(F.col("_script")), r"\.\w+$", "")).otherwise(basename(exe))))
    names = applications.select(F.lower("name").alias("app")).distinct()
    match = nearest_name(rows, names, "_name", "app").withColumnRenamed("match", "_product")
    rows = rows.join(match, "_name", "left")
    kernel = F.when(blank(exe) & command.startswith("["), F.lit("kernel"))
    vendor = F.regexp_extract(exe, r"^/opt/([^/]+)/", 1)
    package = F.when(~F.col("package").isin("", "kernel") & ~shell, F.col("package"))
    tier, name = identity([("kernel", kernel), ("vendor", vendor), ("product", F.col("_product")), ("package", package), ("script", basename(F.col("_script"))), ("exe", basename(exe))])
    return rows.withColumn("tier", tier).withColumn("entity", name).drop("_name", "_script", "_product")


def entities(processes: DataFrame, applications: DataFrame, sockets: DataFrame) -> DataFrame:
    """One row an entity: processes without an identity of their own adopt that of the nearest ancestor with one; then sums, users, ports, exposure, the oldest process."""
    own = identify(processes, applications).withColumn("id", F.col("pid"))
    edges = own.where("ppid NOT IN ('0', '1')").select("host_id", F.col("pid").alias("child"), F.col("ppid").alias("parent"))
    strong = F.col("tier").isin("kernel", "vendor", "product", "package")
    named = nearest_ancestor(own.withColumn("_key", F.concat_ws("|", "tier", "entity")), edges, strong, "_key")
    named = named.withColumn("_key", F.when(F.col("_key") == "", F.concat_ws("|", "tier", "entity")).otherwise(F.col("_key")))
    worst = F.max(F.when(F.col("exposure").startswith("OPEN"), 3).when(F.col("exposure").startswith("filtered"), 2).when(F.col("exposure") == "local-only", 1).otherwise(0))
    net = sockets.groupBy("host_id", "pid").agg(F.count_if(F.col("state") == "LISTEN").alias("_ports"), F.count_if(F.col("remote") != "").alias("_connections"), worst.alias("_worst"))
    rows = named.join(net, ["host_id", "pid"], "left")
    out = rows.groupBy("host_id", "_key").agg(
        F.count(F.lit(1)).alias("pids"), F.array_join(F.array_sort(F.collect_set("user")), ", ").alias("users"),
        F.round(F.sum(F.col("rss_mb").try_cast("double")), 1).alias("rss_mb"), F.round(F.sum(F.col("cpu").try_cast("double")), 1).alias("cpu"),
        F.sum("_ports").alias("ports"), F.sum("_connections").alias("connections"), F.max("_worst").alias("exposure"), F.max(elapsed_seconds(F.col("elapsed"))).alias("oldest_s"),
    )
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    out = out.withColumn("tier", F.substring_index("_key", "|", 1)).withColumn("entity", F.regexp_replace("_key", r"^[^|]*\|", "")).fillna(0, ["ports", "connections", "exposure"])
    return out.drop("_key").orderBy(rank, F.desc("pids"), "entity")


#: Names that are seldom programs, what never is one, and kinds with rules of their own.
NOISE_NAMES = r"^(lib|glibc|gcc)|-(libs?|devel|static|headers|doc|javadoc|debuginfo|debugsource|fonts?|data|common|filesystem|langpack.*|selinux|icon-theme)$|^(python3?|perl|ruby|rust|golang|php|nodejs|texlive)-"
CORE = (
    "filesystem", "setup", "glibc", "bash", "coreutils", "systemd", "systemd-libs", "systemd-udev", "dbus", "dbus-broker", "util-linux", "shadow-utils", "rpm", "dnf", "sudo", "pam", "grep", "sed", "gawk", "findutils", "which", "kernel", "kernel-core", "glibc-common",
)
RUNTIME_KINDS, GUI_KINDS, LANGUAGE_KINDS, EXECUTABLE_KINDS = ("flatpak-runtime",), ("flatpak", "appimage"), ("pip", "pipx", "npm", "cargo", "gem", "go"), ("bin", "appimage", "process-bin")


def classify_programs(apps: DataFrame, user: DataFrame, leaves: DataFrame, files: DataFrame, processes: DataFrame, by: Sequence[str] = ("host_id",)) -> DataFrame:
    """``by…, kind, name, role, gui, running, reasons, score``: programs and what only serves them, one row a kind and name.

    A native package (``rpm``) scores 2 if the user installed it (``user``: ``name``), 2 for a desktop entry, 1 for an executable on the path (``files``: ``package, path``), 1 if nothing
    needs it (``leaves``: ``name``), 1 if it runs (``processes``: ``command``), and loses 2 for a name of a library or its like unless it has a desktop entry; with 4 it is a program, core packages never are. Of other kinds
    what something else needs, and every runtime, is a dependency; of a language's packages also what neither runs nor has an executable of its name.
    """
    keys = [*by, "name"]
    cells = [c for c in ("version", "path", "app_id", "depends") if c in apps.columns]
    rows = apps.where("name <> ''").groupBy(*keys, "kind").agg(F.min(F.struct(*cells)).alias("_c")).select(*keys, "kind", "_c.*")
    flag = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    owned = files.select(*by, F.col("package").alias("name"), F.col("path").rlike("^/(usr/)?s?bin/").alias("b"), F.col("path").rlike(r"^/usr/share/applications/.*\.desktop$").alias("d"))
    first = F.split_part(F.trim(F.coalesce(F.col("command"), F.lit(""))), F.lit(" "), F.lit(1))
    runs = processes.where("command <> '' AND NOT startswith(command, '[')").select(*by, F.split_part(F.substring_index(first, "/", -1), F.lit(":"), F.lit(1)).alias("name"))
    needs = dependency_edges(apps, ("depends",)) if {"depends", "app_id"} <= set(apps.columns) else None
    tables = [flag(user, "_u"), flag(leaves, "_l"), flag(owned.where("b"), "_b"), flag(owned.where("d"), "_d"), flag(runs, "_r"), flag(apps.where(F.col("kind").isin(*EXECUTABLE_KINDS)), "_exe")]
    if needs is not None:
        tables.append(flag(needs.where("child <> parent").select(*by, F.col("parent").alias("name")), "_needed"))
    else:
        rows = rows.withColumn("_needed", F.lit(False))
    for t in tables:
        rows = rows.join(t, keys, "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    native, kind = F.col("kind") == "rpm", F.col("kind")
    noise = F.col("name").rlike(NOISE_NAMES) & ~has("_d")
    score = sum((F.when(c, w).otherwise(0) for c, w in ((has("_u"), 2), (has("_d"), 2), (has("_b"), 1), (has("_l"), 1), (has("_r"), 1), (noise, -2))), F.lit(0))
    served = kind.isin(*RUNTIME_KINDS) | has("_needed")
    library = kind.isin(*LANGUAGE_KINDS) & ~served & ~has("_r") & ~has("_exe")
    program = F.when(native, (score >= 4) & ~F.col("name").isin(*CORE)).otherwise(~served & ~library)
    fired = F.array_join(F.array_compact(F.array(*(F.when(has(c), F.lit(name)) for c, name in (("_u", "user"), ("_d", "desktop"), ("_b", "path-bin"), ("_l", "leaf"), ("_r", "running"))))), ",")
    return rows.select(
        *by, "kind", "name", F.when(program, "program").otherwise("dependency").alias("role"), F.when(native, has("_d")).otherwise(kind.isin(*GUI_KINDS)).alias("gui"), has("_r").alias("running"),
        F.when(native, fired).when(library, F.concat(kind, F.lit(",library"))).otherwise(kind).alias("reasons"), F.when(native, score).otherwise(0).alias("score"),
    )
