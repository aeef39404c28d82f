"""Quantile cut points and the buckets drawn from them.

Cuts are a handful of numbers per column, so they come back to the driver and
enter the bucketing as literals - the labels carry them as text anyway.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from scoremon.config import where

QUARTILES = (0.25, 0.5, 0.75, 1.0)
MISSING = "98. Missing"


class Cuts(NamedTuple):
    """Minimum over all rows and the cut points; ``edges`` is None without data."""

    lowest: float | None
    edges: list[float] | None


def _check_numeric(df: DataFrame, columns: Sequence[str]) -> None:
    for c in columns:
        if not isinstance(df.schema[c].dataType, NumericType):
            raise TypeError(f"column {c} is {df.schema[c].dataType.simpleString()}, not numeric")


def _value(c: str):
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def _sketch(v: Column, ranks: Sequence[float], relative_error: float) -> Column:
    return F.percentile_approx(v, [float(r) for r in ranks], F.lit(ceil(1 / relative_error)))


def approx_cuts(
    df: DataFrame,
    columns: Sequence[str],
    window: str = "",
    probs: Sequence[float] = QUARTILES,
    relative_error: float = 0.01,
) -> dict[str, Cuts]:
    """Approximate quantiles of all columns in one aggregation.

    The rank of a cut is off by at most ``relative_error * n``.
    """
    _check_numeric(df, columns)
    inside = F.expr(window) if window.strip() else F.lit(True)
    aggs = []
    for c in columns:
        aggs += [F.min(_value(c)), _sketch(F.when(inside, _value(c)), probs, relative_error)]
    row = df.agg(*[a.alias(f"c{t}") for t, a in enumerate(aggs)]).first()
    return {
        c: Cuts(row[2 * i], None if row[2 * i + 1] is None else list(row[2 * i + 1]))
        for i, c in enumerate(columns)
    }


class _Search(NamedTuple):
    """Open bracket around the value of one rank: exclusive ends, rows before it, rows in it."""

    rank: int
    lo: float | None
    hi: float | None
    before: int
    size: int


def wanted_rank(p: float, n: int) -> int:
    """ceil(p * n) with ``p`` taken as it is written, not as its binary value; 1 at least."""
    return min(max(ceil(Fraction(str(p)) * n), 1), n)


def rank_check(
    df: DataFrame, cuts: dict[str, Cuts], window: str, probs: Sequence[float], relative_error: float
) -> DataFrame:
    """column_name, cut, n and whether the rank of a cut is within ``relative_error * n``.

    One aggregation counts, for all cuts, the values below and up to them.
    """
    rows = where(df, window)
    names = list(cuts)
    aggs = [F.count(_value(c)) for c in names]
    for c in names:
        for edge in cuts[c].edges or []:
            aggs += [F.count_if(_value(c) < edge), F.count_if(_value(c) <= edge)]
    numbers = iter(rows.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)]).first())
    counts = {c: next(numbers) for c in names}
    out = []
    for c in names:
        for j, _ in enumerate(cuts[c].edges or []):
            below, upto, rank = next(numbers), next(numbers), wanted_rank(probs[j], counts[c])
            far = max(0, below + 1 - rank, rank - upto)
            out.append((c, j + 1, counts[c], far <= relative_error * counts[c]))
    return df.sparkSession.createDataFrame(
        out, "column_name STRING, cut INT, n BIGINT, within_bound BOOLEAN"
    )


def exact_cuts(
    df: DataFrame,
    columns: Sequence[str],
    window: str = "",
    probs: Sequence[float] = QUARTILES,
    relative_error: float = 1e-4,
) -> dict[str, Cuts]:
    """Exact discrete quantiles: the smallest value whose rank reaches ``p * n``.

    Rounds of two plain aggregations: one sketches the values inside the
    bracket around the wanted rank, one counts exactly how many values lie
    below and up to the sketched candidates.  A round finds the value or
    shrinks the bracket by about the sketch accuracy, so two or three rounds
    do for any table.  Nothing is sorted or shuffled, and only a few numbers
    per column come back; the table should be a stored one, as it is read
    several times.
    """
    _check_numeric(df, columns)
    rows = where(df, window)
    in_window = F.expr(window) if window.strip() else F.lit(True)
    head = df.agg(
        *[F.min(_value(c)).alias(f"c{i}") for i, c in enumerate(columns)],
        *[F.count(F.when(in_window, _value(c))).alias(f"n{i}") for i, c in enumerate(columns)],
    ).first()
    lowest, counts = head[: len(columns)], head[len(columns) :]
    found: dict[tuple[int, int], float] = {}
    todo = {
        (i, j): _Search(wanted_rank(p, counts[i]), None, None, 0, counts[i])
        for i, _ in enumerate(columns) if counts[i]
        for j, p in enumerate(probs)
    }

    def inside(i: int, lo: float | None, hi: float | None) -> Column:
        v = _value(columns[i])
        ok = v.isNotNull()
        if lo is not None:
            ok = ok & (v > lo)
        if hi is not None:
            ok = ok & (v < hi)
        return F.when(ok, v)

    def near(s: _Search) -> list[float]:
        at = (s.rank - s.before) / s.size
        return [min(max(at + e, 0.0), 1.0) for e in (-relative_error, 0.0, relative_error)]

    while todo:
        keys = list(todo)
        # Ranks that share a bracket share its sketch.
        shared: dict[tuple, list] = {}
        for key in keys:
            shared.setdefault((key[0], todo[key].lo, todo[key].hi), []).append(key)
        sketches = rows.agg(
            *[
                _sketch(inside(*bracket), [r for k in members for r in near(todo[k])], relative_error).alias(f"g{t}")
                for t, (bracket, members) in enumerate(shared.items())
            ]
        ).first()
        grid_of = {
            k: sorted(set(grid[3 * t : 3 * t + 3]))
            for grid, members in zip(sketches, shared.values()) for t, k in enumerate(members)
        }
        grids = [grid_of[k] for k in keys]
        aggs = []
        for key, grid in zip(keys, grids):
            v = _value(columns[key[0]])
            for g in grid:
                aggs += [F.count_if(v < g), F.count_if(v <= g)]
        ranks = iter(rows.agg(*[a.alias(f"c{t}") for t, a in enumerate(aggs)]).first())
        for key, grid in zip(keys, grids):
            s = todo.pop(key)
            lo, hi, before, end = s.lo, s.hi, s.before, s.before + s.size
            for g in grid:
                below, upto = next(ranks), next(ranks)
                if below < s.rank <= upto:
                    found[key] = g
                elif upto < s.rank:
                    if upto > before or lo is None:
                        lo, before = g, upto
                elif hi is None or below < end:
                    hi, end = g, below
            if key not in found:
                todo[key] = _Search(s.rank, lo, hi, before, end - before)
    return {
        c: Cuts(lowest[i], [found[i, j] for j in range(len(probs))] if counts[i] else None)
        for i, c in enumerate(columns)
    }


def quantile_buckets(
    df: DataFrame,
    columns: Sequence[str],
    window: str = "",
    probs: Sequence[float] = QUARTILES,
    relative_error: float = 0.01,
    exact: bool = False,
) -> DataFrame:
    """Add ``<column>_q``: quantile bucket labels for every column.

    The cut points come from the rows that satisfy ``window``; the labels go
    to all rows.  Label text shows the edges at three decimals, the first one
    starting at the minimum of all rows.  Nulls and values above the largest
    cut are labelled missing, and so is everything when the window is empty.
    All columns share the aggregations, whatever their number.
    """
    if exact:
        cuts = exact_cuts(df, columns, window, probs)
    else:
        cuts = approx_cuts(df, columns, window, probs, relative_error)
    labels = {}
    for c in columns:
        start, edges = cuts[c]
        if edges is None:
            labels[f"{c}_q"] = F.lit(MISSING)
            continue
        out, v = F, _value(c)
        for i, edge in enumerate(edges, 1):
            out = out.when(v <= edge, f"{i}. {start:.3f} - {edge:.3f}")
            start = edge
        labels[f"{c}_q"] = out.otherwise(MISSING)
    return df.withColumns(labels)


def approx_percentile(df: DataFrame, column: str, p: float = 0.99, accuracy: int = 10_000) -> DataFrame:
    """One approximate percentile as a one-row frame."""
    return df.agg(F.percentile_approx(column, p, F.lit(accuracy)).alias(f"p_{round(p * 100)}"))
