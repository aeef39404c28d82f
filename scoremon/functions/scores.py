"""Score, logit and amount transforms used across the monitors."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Affine map between the credit-bureau style score and its logit.
SCORE_OFFSET = 174.25
SCORE_SCALE = 57.708

# Codes that mean "no information" in the bureau extracts.
SENTINELS = (
    1111111111, -1111111111, 2222222222, -2222222222, 3333333333, -3333333333,
    4444444444, 5555555555, 6666666666, 7777777777, 99999,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def logit_to_pd(logit: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(logit)))


def with_pds(df: DataFrame, logit_columns: Mapping[str, str]) -> DataFrame:
    """Add one probability column per ``{logit column: new name}`` entry."""
    return df.withColumns({new: logit_to_pd(src) for src, new in logit_columns.items()})


def score_to_logit(score: Column | str) -> Column:
    return (F.lit(SCORE_OFFSET) - _col(score)) / F.lit(SCORE_SCALE)


def logit_to_score(logit: Column | str) -> Column:
    return F.lit(SCORE_OFFSET) - F.lit(SCORE_SCALE) * _col(logit)


def null_safe_sum(*columns: Column | str) -> Column:
    """Sum in which a missing term counts as zero."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(_col(c), F.lit(0))
    return total


def nan_to_null(c: Column | str) -> Column:
    """NaN sorts above every number in Spark; treat it as missing instead."""
    return F.when(~F.isnan(_col(c)), _col(c))


def null_sentinels(c: Column | str, codes: Iterable[int] = SENTINELS) -> Column:
    """Replace "no information" codes by null."""
    return F.when(~_col(c).isin(*codes), _col(c))


def switch_source(month: Column | str, since: int, new: Column | str, old: Column | str) -> Column:
    """Read ``new`` for cohorts from month ``since`` on, ``old`` before."""
    return F.when(_col(month) >= since, _col(new)).otherwise(_col(old))
