"""Label buckets, recodes and flags, all as ``CASE`` columns.

Labels start with a number so that they sort in bucket order.  NaN is treated
as missing throughout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_LABEL = "99. Missing"
SELF = object()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _absent(c: Column) -> Column:
    return c.isNull() | F.isnan(c.cast("double"))


def _cut(c, edges, labels, missing, below) -> Column:
    if len(labels) != len(edges) + 1:
        raise ValueError(f"{len(edges)} edges need {len(edges) + 1} labels, got {len(labels)}")
    if list(edges) != sorted(edges):
        raise ValueError("bucket edges must ascend")
    out = F.when(_absent(c), missing)
    for edge, label in zip(edges, labels):
        out = out.when(below(c, edge), label)
    return out.otherwise(labels[-1])


def bucket_right_open(
    c: Column | str, edges: Sequence[float], labels: Sequence[str], missing: str = MISSING_LABEL
) -> Column:
    """``[a, b)`` buckets; the last label is open upwards."""
    return _cut(_col(c), edges, labels, missing, lambda x, e: x < e)


def bucket_right_closed(
    c: Column | str, edges: Sequence[float], labels: Sequence[str], missing: str = MISSING_LABEL
) -> Column:
    """``(a, b]`` buckets; the last label is open upwards."""
    return _cut(_col(c), edges, labels, missing, lambda x, e: x <= e)


class Band(NamedTuple):
    """One rule of an ordered bucketing: ``lo <= x <= hi``; ``None`` = unbounded.

    ``hi_open`` makes the upper end exclusive.
    """

    label: str
    lo: float | None
    hi: float | None
    hi_open: bool = False


def ordered_bands(
    c: Column | str,
    bands: Sequence[Band],
    missing: str = "98. Missing",
    out_of_range: str = "99. Out of Range",
) -> Column:
    """Overlapping bands where the first matching rule wins."""
    x = _col(c)
    out = F.when(_absent(x), missing)
    for b in bands:
        hit = F.lit(True)
        if b.lo is not None:
            hit = hit & (x >= b.lo)
        if b.hi is not None:
            hit = hit & ((x < b.hi) if b.hi_open else (x <= b.hi))
        out = out.when(hit, b.label)
    return out.otherwise(out_of_range)


def recode(c: Column | str, mapping: Mapping, default=None, missing=None) -> Column:
    """Code to label.

    ``default`` decides what an unlisted code becomes: ``None`` = null,
    ``SELF`` = keep the code, anything else = that constant.  ``missing`` is
    the label of a null code; without it a null code follows ``default``.
    """
    x = _col(c)
    out = F.when(x.isNull(), missing) if missing is not None else None
    for code, label in mapping.items():
        out = (F if out is None else out).when(x == code, label)
    if default is None:
        return out
    return out.otherwise(x if default is SELF else F.lit(default))


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it does not or is null."""
    return F.when(condition, 1).otherwise(0)


def contains_class(c: Column | str, needle: str, hit: str, other: str, missing: str = MISSING_LABEL) -> Column:
    """Two-way text class with a missing label."""
    x = _col(c)
    return F.when(x.isNull(), missing).when(x.contains(needle), hit).otherwise(other)


def purpose_flag(
    purpose: Column | str,
    month: Column | str,
    always: Sequence[str],
    since: Mapping[str, int] | None = None,
) -> Column:
    """1 for a missing purpose, a listed one, or one allowed from some month on."""
    p, m = _col(purpose), _col(month)
    out = F.when(p.isNull(), 1).when(p.isin(*always), 1)
    for value, first_month in (since or {}).items():
        out = out.when((p == value) & (m >= first_month), 1)
    return out.otherwise(0)


def tiered_accept(score: Column | str, segment: Column | str, minimum: Mapping[str, float]) -> Column:
    """1 when the score reaches the minimum of its segment, else 0."""
    s, g = _col(score), _col(segment)
    hit = F.lit(False)
    for name, floor in minimum.items():
        hit = hit | ((g == name) & (s >= floor))
    return flag(hit)
