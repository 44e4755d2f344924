"""Predicates compiled to Columns: row conditions, query-bar conditions, addresses, time bounds."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of private, loopback and link-local addresses; fixed values.
PRIVATE = r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|::1$|[fF][eE]80:|[fF][cCdD])"
UNITS = {"seconds": "SECOND", "minutes": "MINUTE", "hours": "HOUR", "days": "DAY", "weeks": "WEEK"}
PRESETS = {"5m": (5, "minutes"), "15m": (15, "minutes"), "1h": (1, "hours"), "24h": (24, "hours"), "7d": (7, "days"), "30d": (30, "days")}


def text(df: DataFrame, field: str) -> Column:
    """A field as text; null, or a field that the table lacks, is the empty text."""
    return F.coalesce(F.col(f"`{field}`").cast("string"), F.lit("")) if field in df.columns else F.lit("")


def row_condition(df: DataFrame, field: str, op: str = "eq", value="") -> Column:
    """One condition of a filter node, on text; an operator that isn't known holds."""
    cell = text(df, field)
    many = [str(v) for v in value] if isinstance(value, (list, tuple, set)) else []
    found: dict[str, Callable[[], Column]] = {
        "eq": lambda: cell == str(value),
        "ne": lambda: cell != str(value),
        "contains": lambda: cell.contains(str(value)),
        "not_contains": lambda: ~cell.contains(str(value)),
        "regex": lambda: cell.rlike(str(value)),
        "in": lambda: cell.isin(many),
        "not_in": lambda: ~cell.isin(many),
    }
    return found.get(op, lambda: F.lit(True))()


def row_conditions(df: DataFrame, conditions: Sequence[dict]) -> Column:
    """All conditions of a filter node."""
    return reduce(lambda a, c: a & row_condition(df, c.get("field", ""), c.get("op", "eq"), c.get("value", "")), conditions, F.lit(True))


def bar_condition(df: DataFrame, field: str | None, op: str, value: str = "") -> Column:
    """One condition of the query bar; without a field it is an OR over all of the table's."""
    if field is None:
        return reduce(or_, [bar_condition(df, c, op, value) for c in df.columns])
    cell = F.col(f"`{field}`")
    like = cell.cast("string")
    found: dict[str, Callable[[], Column]] = {
        "MATCH": lambda: like.ilike(f"%{value}%"),
        "NOT MATCH": lambda: ~like.ilike(f"%{value}%"),
        "LIKE": lambda: like.ilike(value),
        "NOT LIKE": lambda: ~like.ilike(value),
        "=": lambda: like == value,
        "<>": lambda: like != value,
        ">": lambda: _typed(df, field, lambda a, b: a > b, value),
        "<": lambda: _typed(df, field, lambda a, b: a < b, value),
        ">=": lambda: _typed(df, field, lambda a, b: a >= b, value),
        "<=": lambda: _typed(df, field, lambda a, b: a <= b, value),
        "IS NULL": lambda: cell.isNull(),
        "IS NOT NULL": lambda: cell.isNotNull(),
    }
    return found[op]()


def _typed(df: DataFrame, field: str, compare, value: str) -> Column:
    """Numbers compare as numbers, all else as text."""
    kind = dict(df.dtypes)[field]
    if kind in ("int", "bigint", "smallint", "tinyint", "float", "double") or kind.startswith("decimal"):
        return compare(F.col(f"`{field}`").cast("double"), F.lit(value).try_cast("double"))
    return compare(F.col(f"`{field}`").cast("string"), F.lit(value))


def _used(conditions: Sequence[dict]) -> list[dict]:
    return [c for c in conditions if c.get("field", "") != "" and (c["op"] in ("IS NULL", "IS NOT NULL") or c.get("value", "") != "")]


def query_bar(df: DataFrame, conditions: Sequence[dict], quick: str = "") -> Column:
    """The bar's conditions with SQL's precedence: AND before OR; those without a value are skipped."""
    terms: list[list[Column]] = [[bar_condition(df, None, "MATCH", quick.strip())]] if quick.strip() else []
    for c in _used(conditions):
        join, hit = c.get("join") or "AND", bar_condition(df, c["field"], c["op"], c.get("value", ""))
        hit = ~hit if "NOT" in join else hit
        if terms and not join.startswith("OR"):
            terms[-1].append(hit)
        else:
            terms.append([hit])
    return reduce(or_, [reduce(lambda a, b: a & b, t) for t in terms]) if terms else F.lit(True)


def row_matcher(df: DataFrame, conditions: Sequence[dict], quick: str = "", fields: Sequence[str] | None = None) -> Column:
    """The dashboard's matcher: left to right without precedence, on text without regard to case; a null is the empty text."""
    found = None
    for c in _used(conditions):
        hit = _match_cell(text(df, c["field"]), c["op"], str(c.get("value", "")))
        join = c.get("join") or "AND"
        hit = ~hit if "NOT" in join else hit
        found = hit if found is None else found | hit if join.startswith("OR") else found & hit
    found = F.lit(True) if found is None else found
    return found & quick_search(df, quick, fields) if quick.strip() else found


def _match_cell(cell: Column, op: str, value: str) -> Column:
    low, want = F.lower(cell), value.lower()
    number, wanted = cell.try_cast("double"), F.lit(value).try_cast("double")
    numeric = {">": number > wanted, "<": number < wanted, ">=": number >= wanted, "<=": number <= wanted}
    if op in numeric:
        return F.coalesce(numeric[op], F.lit(False))
    return {
        "=": low == want,
        "<>": low != want,
        "MATCH": low.contains(want.replace("%", "")),
        "LIKE": low.contains(want.replace("%", "")),
        "NOT MATCH": ~low.contains(want.replace("%", "")),
        "NOT LIKE": ~low.contains(want.replace("%", "")),
        "IS NULL": cell == "",
        "IS NOT NULL": cell != "",
    }.get(op, F.lit(True))


def quick_search(df: DataFrame, term: str, fields: Sequence[str] | None = None) -> Column:
    """The term occurs in some field, without regard to case."""
    term = term.strip().lower()
    return reduce(or_, [F.lower(text(df, c)).contains(term) for c in fields or df.columns]) if term else F.lit(True)


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    part = [F.regexp_extract(ip, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("long") for k in (1, 2, 3, 4)]
    return F.when(F.greatest(*part) <= 255, part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3])


def cidr(ip: Column, network: str) -> Column:
    """The address lies in the network, for any length of prefix."""
    base, _, bits = network.partition("/")
    a, b, c, d = (int(x) for x in base.split("."))
    size = 1 << (32 - int(bits or 32))
    low = (a << 24 | b << 16 | c << 8 | d) // size * size
    return F.coalesce(ip_number(ip).between(low, low + size - 1), F.lit(False))


def is_private_ip(ip: Column) -> Column:
    """Private, loopback, link-local or empty."""
    ip = F.coalesce(ip, F.lit(""))
    return (ip == "") | ip.rlike(PRIVATE)


def last_n(ts: Column, n: int, unit: str, as_of: Column) -> Column:
    """The time lies in the last n units before ``as_of``; months and years by the calendar."""
    if unit in ("months", "years"):
        since = as_of - F.make_interval(**{unit: F.lit(n)})
    else:
        since = as_of - F.expr(f"INTERVAL {n} {UNITS[unit]}")
    return ts >= since


def field_filter(df: DataFrame, **equal) -> Column:
    """Equality on the given fields; empty values don't filter."""
    return reduce(lambda a, kv: a & (F.col(kv[0]) == kv[1]) if kv[1] not in (None, "") else a, equal.items(), F.lit(True))


def templates_hit(df: DataFrame, templates: Sequence[dict]) -> Column:
    """Number of the first noise template that fits, or null.

    A template's fields are sought as parts of the row's, without regard to case; ``match`` is a regular expression over ``message``.
    One without a criterion, or whose expression is none, never fits. Templates of the same fields stand together, and their
    expressions are tried only on rows that have these fields, so a row meets its own module's or provider's expressions.
    """
    service = ("action", "reason", "match", "name")
    groups: dict[tuple[tuple[str, str], ...], list[tuple[int, str]]] = {}
    for k, t in enumerate(templates):
        fields = tuple((f, str(v).lower()) for f, v in t.items() if f not in service and v not in (None, ""))
        pattern = str(t.get("match") or "")
        try:
            re.compile(pattern)
        except re.error:
            continue
        if fields or pattern:
            groups.setdefault(fields, []).append((k, pattern))
    firsts = []
    for fields, own in groups.items():
        first = None
        for k, pattern in own:
            fits = text(df, "message").rlike(pattern) if pattern else F.lit(True)
            first = F.when(fits, F.lit(k)) if first is None else first.when(fits, F.lit(k))
        tests = [F.lower(text(df, f)).contains(v) for f, v in fields]
        firsts.append(F.when(reduce(lambda a, b: a & b, tests), first) if tests else first)
    firsts += [F.lit(None).cast("int")] * max(0, 2 - len(firsts))
    return F.least(*firsts)


def apply_templates(df: DataFrame, templates: Sequence[dict]) -> DataFrame:
    """Rows that a ``drop`` template fits go; a ``tag`` template adds ``noise:<reason>`` to ``tags``."""
    hit = templates_hit(df, templates)
    tags = [f"noise:{t.get('reason') or t.get('name') or 'match'}" for t in templates]
    drops = [str(t.get("action", "drop")).lower() != "tag" for t in templates]
    mark = F.get(F.array(*(F.lit(x) for x in tags)), F.col("_hit"))
    drop = F.coalesce(F.get(F.array(*(F.lit(x) for x in drops)), F.col("_hit")), F.lit(False))
    out = df.withColumn("_hit", hit).where(~drop)
    old = text(df, "tags")
    return out.withColumn("tags", F.when(F.col("_hit").isNotNull(), F.concat_ws(",", F.nullif(old, F.lit("")), mark)).otherwise(old)).drop("_hit")
