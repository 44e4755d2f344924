"""Checks of a parser's or enrichment's rows against what is expected of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, expect: dict, order: Sequence[str] = ()) -> DataFrame:
    """``ok, detail``, one row for each expectation.

    ``rows``: exact number; ``min_rows``: least number; ``contains``: some row has these
    cells; ``row<N>``: the row of that number by ``order`` has these cells. Cells compare as text.
    """
    cells = lambda want: F.forall(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) == str(v) for c, v in want.items())), lambda x: x)
    tests = []
    for name, want in expect.items():
        if name == "rows":
            tests.append((name, F.count(F.lit(1)) == want))
        elif name == "min_rows":
            tests.append((name, F.count(F.lit(1)) >= want))
        elif name == "contains":
            tests.append((name, F.count_if(cells(want)) > 0))
    out = df.agg(*(t.alias(name) for name, t in tests)).select(F.explode(F.array(*(F.struct(F.col(name).alias("ok"), F.lit(name).alias("detail")) for name, _ in tests))).alias("x")).select("x.*") if tests else None
    for name, want in expect.items():
        if name.startswith("row") and name[3:].isdigit():
            at = df.orderBy(*order).offset(int(name[3:])).limit(1).agg((F.count_if(cells(want)) == 1).alias("ok")).select("ok", F.lit(name).alias("detail"))
            out = at if out is None else out.unionByName(at)
    return out


def registry(tables: dict[str, DataFrame], collected_at: str) -> DataFrame:
    """``table, n_rows, collected_at``: a table that was collected and is empty differs from one that is not there."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(collected_at).alias("collected_at"))
        out = row if out is None else out.unionByName(row)
    return out
