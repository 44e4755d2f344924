"""Scalar expressions over host telemetry: paths, durations, hexadecimal, scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Null or empty."""
    return F.coalesce(c, F.lit("")) == ""


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def usr_merged(path: Column) -> Column:
    """/bin, /sbin and /usr/sbin are /usr/bin; /lib and /lib64 are below /usr."""
    path = F.regexp_replace(path, r"^/(usr/)?s?bin/", "/usr/bin/")
    return F.regexp_replace(path, r"^/(lib|lib64)/", "/usr/$1/")


def elapsed_seconds(etime: Column) -> Column:
    """Seconds of ``[[DD-]HH:]MM:SS``; null if it isn't one."""
    part = [F.coalesce(F.nullif(F.regexp_extract(etime, r"^(?:(?:(\d+)-)?(\d+):)?(\d+):(\d+)$", k), F.lit("")).try_cast("long"), F.lit(0)) for k in (1, 2, 3, 4)]
    return F.when(etime.rlike(r"^(?:(?:\d+-)?\d+:)?\d+:\d+$"), part[0] * 86400 + part[1] * 3600 + part[2] * 60 + part[3])


def unit_seconds(time: Column) -> Column:
    """Seconds of ``1min 2.3s`` or ``15ms``."""
    of = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(time, pattern, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return of(r"(\d+)min") * 60 + of(r"([\d.]+)s(?:$|\s)") + of(r"([\d.]+)ms") / 1000


def hex_text(c: Column) -> Column:
    """Text of an even number of hexadecimal digits, NUL as a space; anything else as it is."""
    return F.when(c.rlike(r"^([0-9A-Fa-f]{2})+$"), F.trim(F.translate(F.decode(F.unhex(c), "UTF-8"), "\x00", " "))).otherwise(c)


def sockaddr(c: Column) -> Column:
    """Struct ``family, ip, port, path`` of a hexadecimal socket address."""
    byte = lambda k: F.conv(F.substring(c, 2 * k + 1, 2), 16, 10)
    port = (F.conv(F.substring(c, 5, 4), 16, 10)).try_cast("int")
    v4 = F.concat_ws(".", byte(4), byte(5), byte(6), byte(7))
    v6 = F.lower(F.concat_ws(":", *(F.substring(c, 17 + 4 * k, 4) for k in range(8))))
    path = F.regexp_replace(F.decode(F.unhex(F.substring(c, 5, 216)), "UTF-8"), "\x00+$", "")
    kind = F.substring(c, 1, 4)
    none = F.lit("")
    return F.struct(
        F.when(kind == "0200", "inet").when(kind == "0A00", "inet6").when(kind == "0100", "unix").otherwise("").alias("family"),
        F.when(kind == "0200", v4).when(kind == "0A00", v6).otherwise(none).alias("ip"),
        F.when(kind.isin("0200", "0A00"), port).alias("port"),
        F.when(kind == "0100", path).otherwise(none).alias("path"),
    )


#: CVSS 3.1 weights by metric and value; fixed values.
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
CVSS_PR = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}


def _choice(value: Column, weights: dict[str, float]) -> Column:
    found = None
    for k, w in weights.items():
        found = F.when(value == k, F.lit(w)) if found is None else found.when(value == k, F.lit(w))
    return found


def cvss_score(vector: Column) -> Column:
    """CVSS 3.x base score of a vector; null if a metric is missing."""
    metric = lambda name: F.regexp_extract(vector, rf"(?:^|/){name}:([A-Z])", 1)
    w = {name: _choice(metric(name), weights) for name, weights in CVSS.items()}
    changed = metric("S") == "C"
    pr = F.when(changed, _choice(metric("PR"), CVSS_PR["C"])).when(metric("S") == "U", _choice(metric("PR"), CVSS_PR["U"]))
    iss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    exploitability = 8.22 * w["AV"] * w["AC"] * pr * w["UI"]
    raw = F.least(F.lit(10.0), F.when(changed, 1.08 * (impact + exploitability)).otherwise(impact + exploitability))
    cents = F.round(raw * 100000).cast("long")
    up = F.when(cents % 10000 == 0, cents / F.lit(100000.0)).otherwise((F.floor(cents / F.lit(10000.0)) + 1) / F.lit(10.0))
    return F.when(raw.isNull(), F.lit(None)).when(impact <= 0, F.lit(0.0)).otherwise(up)


def cvss_rating(score: Column) -> Column:
    return F.when(score >= 9, "Critical").when(score >= 7, "High").when(score >= 4, "Medium").when(score > 0, "Low").when(score == 0, "None").otherwise("")


def template(pattern: str, fields: dict[str, Column]) -> Column:
    """``{field}`` replaced by the field's text (null: empty); other braces stay."""
    parts = [F.coalesce(fields[p[1:-1]].cast("string"), F.lit("")) if p[:1] == "{" and p[1:-1] in fields else F.lit(p) for p in re.split(r"(\{\w+\})", pattern) if p]
    return F.concat(*parts) if parts else F.lit("")


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, one decimal from KB on."""
    scaled = lambda unit, name: F.concat(F.format_number(n / unit, 1), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1024.0, "KB")).when(n < 1024**3, scaled(1024.0**2, "MB")).otherwise(scaled(1024.0**3, "GB"))


def cut(c: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis if something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)
