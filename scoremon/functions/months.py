"""Arithmetic on ``yyyymm`` cohort months.

A month is turned into a running index (``year * 12 + month - 1``) so that
shifting and comparing are plain integer operations inside code generation,
without a detour over dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- scalars ---------------------------------------------------------------

def index_of(yyyymm: int) -> int:
    return (yyyymm // 100) * 12 + yyyymm % 100 - 1


def yyyymm_of(index: int) -> int:
    return (index // 12) * 100 + index % 12 + 1


def shift_yyyymm(yyyymm: int, k: int) -> int:
    """Move a ``yyyymm`` month by ``k`` months (``k`` may be negative)."""
    return yyyymm_of(index_of(yyyymm) + k)


def month_range(start: int, end: int) -> list[int]:
    """All months from ``start`` to ``end``, both included."""
    return [yyyymm_of(i) for i in range(index_of(start), index_of(end) + 1)]


# -- columns ---------------------------------------------------------------

def month_index(month: Column | str) -> Column:
    m = _col(month).cast("int")
    return (F.floor(m / 100) * 12 + m % 100 - 1).cast("int")


def month_from_index(index: Column | str) -> Column:
    i = _col(index).cast("int")
    return (F.floor(i / 12) * 100 + i % 12 + 1).cast("int")


def shift_month(month: Column | str, k: int) -> Column:
    return month_from_index(month_index(month) + F.lit(k))


def year_text(month: Column | str) -> Column:
    """Calendar year of a month as text."""
    return F.substring(_col(month).cast("string"), 1, 4)


# -- frames ----------------------------------------------------------------

def with_lagged_months(df: DataFrame, n: int, month: str = "codmes") -> DataFrame:
    """Add ``<month>_0 .. <month>_n``: the month and its ``n`` predecessors."""
    return df.withColumns({f"{month}_{k}": shift_month(month, -k) for k in range(n + 1)})


def with_lead_months(df: DataFrame, n: int, month: str = "codmes") -> DataFrame:
    """Add ``<month>_f0 .. <month>_fn``: the month and its ``n`` successors."""
    return df.withColumns({f"{month}_f{k}": shift_month(month, k) for k in range(n + 1)})


def month_spine(df: DataFrame, month: str = "codmes") -> DataFrame:
    """Every month between the first and the last one seen in ``df``.

    Only the two end points are aggregated from the data; the months in
    between are generated, so gaps in the data still get a row.
    """
    ends = df.agg(
        F.min(month_index(month)).alias("lo"), F.max(month_index(month)).alias("hi")
    )
    idx = ends.filter("lo IS NOT NULL").select(
        F.explode(F.sequence("lo", "hi")).alias("month_idx")
    )
    return idx.select(month_from_index("month_idx").alias(month), "month_idx")
