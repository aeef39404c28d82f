"""Joins that add information to the application base."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremon.config import where
from scoremon.functions.months import index_of


def left_enrich(
    base: DataFrame,
    extract: DataFrame,
    on: Sequence[str],
    columns: Mapping[str, str] | Sequence[str],
    keep_if: str = "",
    distinct: bool = True,
) -> DataFrame:
    """Left join to the distinct, filtered rows of a scored extract.

    ``columns`` names what to take over (``{source: new name}`` renames).  A
    column that the base already has is replaced.  Only keys and wanted
    columns are de-duplicated, so the DISTINCT reads no more than it needs.
    The distinct combines copies before the shuffle; a hot key on the base
    side is left to adaptive skew handling, which splits the left input.
    With ``distinct=False`` every matching row counts.
    """
    wanted = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    right = where(extract, keep_if).select(*on, *[F.col(src).alias(new) for src, new in wanted.items()])
    if distinct:
        right = right.distinct()
    clash = [c for c in wanted.values() if c in base.columns and c not in on]
    return base.drop(*clash).join(right, list(on), "left")


def latest_per_key(log: DataFrame, key: str, order: str, keep_if: str = "") -> DataFrame:
    """All rows of each key that carry its latest ``order`` value; ties stay.

    The maximum is combined map-side and joined back.  A window would have to
    bring every row of a key into one task, hot keys included.
    """
    rows = where(log, keep_if)
    newest = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(newest, [key, order], "inner").select(*log.columns)


def forward_panel(
    panel: DataFrame,
    key: str,
    value: str,
    start: int,
    end: int,
    horizons: Sequence[int] = (1, 2, 3),
    month_idx: str = "month_idx",
) -> DataFrame:
    """Value of the same key 1, 2, 3, ... months later, 0 where there is none.

    The later rows are re-keyed to the month they look back to, so all joins
    share one key and the left side is shuffled once for the whole chain.
    The panel should be a stored table: every horizon reads its own months
    of it.  Several later rows per key and month multiply the row, as joins do.
    """
    lo, hi = index_of(start), index_of(end)
    base = panel.filter(F.col(month_idx).between(lo, hi))

    def later(k: int) -> DataFrame:
        return panel.filter(F.col(month_idx).between(lo + k, hi + k)).select(
            key, (F.col(month_idx) - k).alias(month_idx), F.col(value).alias(f"{value}_f{k}")
        )

    joined = reduce(lambda acc, k: acc.join(later(k), [key, month_idx], "left"), horizons, base)
    return joined.withColumns({f"{value}_f{k}": F.coalesce(f"{value}_f{k}", F.lit(0)) for k in horizons})


def rule_lookup(
    base: DataFrame,
    rules: DataFrame,
    area: str,
    place: str,
    outcome: str,
    default: str,
    unknown: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """Rule table ``(area, place, outcome)`` -> one outcome per row.

    A rule for (area, place) wins over a rule for the whole area (null place);
    what no rule covers gets ``default``.  With ``unknown`` a row whose area
    or place is null or blank gets that label, unless a rule covers it.
    Rules of one key must agree; otherwise the smallest outcome is taken.
    """
    name = name or outcome
    exact = (
        rules.filter(F.col(place).isNotNull())
        .groupBy(area, place).agg(F.min(outcome).alias("_exact"))
    )
    whole = (
        rules.filter(F.col(place).isNull())
        .groupBy(area).agg(F.min(outcome).alias("_whole"))
    )
    joined = base.join(exact, [area, place], "left").join(whole, area, "left")
    found: Column = F.coalesce("_exact", "_whole")
    fallback = F.lit(default)
    if unknown is not None:
        blank = [F.coalesce(F.col(c), F.lit("")) == "" for c in (area, place)]
        fallback = F.when(blank[0] | blank[1], unknown).otherwise(default)
    kept = [c for c in base.columns if c != name]
    return joined.select(*kept, F.coalesce(found, fallback).alias(name))


def union_parts(parts: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Stack parts by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), parts)
