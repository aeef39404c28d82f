"""Projection of the default rate of cohorts that have not matured yet.

Every open cohort has a newest usable horizon ``k`` (see
``MonitorConfig.usable``).  The history of ``rate(target) / rate(k)`` over the
last closed cohorts gives a growth factor:

* ``met1``  a percentile of that history,
* ``met2``  the mean of that percentile and the median,
* ``met3``  the linear trend of that history, read at the open cohort.

All of it runs as window aggregates over monthly sums - one row per group and
month - so the base is scanned once, however many horizons take part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig

METHODS = ("met1", "met2", "met3")


def _pick(values: Mapping[int, Column], ahead: Column) -> Column:
    """The value that belongs to the number of months after the closed cohort."""
    out = None
    for j, v in values.items():
        out = (F if out is None else out).when(ahead == j, v)
    return out


def with_projection(
    sums: DataFrame,
    cfg: MonitorConfig,
    view: str = "n",
    method: str = "met1",
    by: Sequence[str] = (),
    suffix: str = "",
) -> DataFrame:
    """Add ``rd_usable``, ``factor`` and ``rd_proj`` to monthly cohort sums.

    ``sums`` comes from ``calibration.cohort_sums`` with the target and the
    usable horizons in it.  The three columns are null outside the open
    cohorts.  ``suffix`` keeps several views apart on one frame.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    ahead = F.col("month_idx") - F.lit(cfg.closed_index)
    past = ahead.between(1 - cfg.history, 0)
    months = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    open_map = {j: h for j, h in cfg.usable.items() if j <= cfg.open_months}

    def d(h: int) -> Column:
        return F.col(f"d{h}_{view}").cast("double")

    def growth(h: int) -> Column:
        ratio = F.when(past, d(cfg.target) / F.nullif(d(h), F.lit(0.0)))
        if method == "met3":
            slope = F.regr_slope(ratio, F.col("month_idx")).over(months)
            start = F.regr_intercept(ratio, F.col("month_idx")).over(months)
            return start + slope * F.col("month_idx")
        high = F.percentile(ratio, cfg.percentile).over(months)
        if method == "met1":
            return high
        return (high + F.percentile(ratio, 0.5).over(months)) / 2

    per_horizon = {h: growth(h) for h in sorted(set(open_map.values()))}
    weight = F.nullif(F.col(view).cast("double"), F.lit(0.0))
    return (
        sums.withColumns(
            {
                f"rd_usable{suffix}": _pick({j: d(h) / weight for j, h in open_map.items()}, ahead),
                f"factor{suffix}": _pick({j: per_horizon[h] for j, h in open_map.items()}, ahead),
            }
        )
        .withColumn(f"rd_proj{suffix}", F.col(f"rd_usable{suffix}") * F.col(f"factor{suffix}"))
    )


def open_cohorts(df: DataFrame, cfg: MonitorConfig) -> DataFrame:
    """Rows of the cohorts that carry a projection."""
    lo = cfg.closed_index + 1
    return df.filter(F.col("month_idx").between(lo, lo + cfg.open_months - 1))


def override_projection(
    projected: DataFrame, overrides: DataFrame, month: str = "codmes", keys: Sequence[str] = (),
    suffix: str = "",
) -> DataFrame:
    """Manual corrections from a table ``(month, op, value)``, op = set | add.

    The factor follows the corrected rate.  ``keys`` are further join columns,
    for corrections that hold for one segment only.  Of several corrections of
    one month the largest (op, value) counts.
    """
    rate, factor = f"rd_proj{suffix}", f"factor{suffix}"
    single = overrides.groupBy(month, *keys).agg(F.max(F.struct("op", "value")).alias("_o"))
    joined = projected.join(single, [month, *keys], "left")
    op, value = F.col("_o.op"), F.col("_o.value")
    corrected = (
        F.when(op == "set", value).when(op == "add", F.col(rate) + value).otherwise(F.col(rate))
    )
    out = joined.withColumn(rate, corrected)
    return out.withColumn(
        factor,
        F.when(op.isNull(), F.col(factor))
        .otherwise(F.col(rate) / F.nullif(F.col(f"rd_usable{suffix}"), F.lit(0.0))),
    ).drop("_o")


def smooth_projection(
    projected: DataFrame, months: int = 1, by: Sequence[str] = (), suffix: str = ""
) -> DataFrame:
    """Centred moving average of the projected rate over calendar months; 1 leaves it as it is.

    A month that is missing is no neighbour, and none farther away takes its place.
    """
    if months == 1:
        return projected
    before, after = months // 2, (months - 1) // 2
    keys = by or (F.lit(0),)
    frame = Window.partitionBy(*keys).orderBy("month_idx").rangeBetween(-before, after)
    rate = f"rd_proj{suffix}"
    # Months without a projection stay without one.
    return projected.withColumn(rate, F.when(F.col(rate).isNotNull(), F.avg(rate).over(frame)))


def adjusted(
    projected: DataFrame, cfg: MonitorConfig, view: str, overrides: DataFrame | None = None,
    smooth: int = 1, by: Sequence[str] = (), suffix: str = "",
) -> DataFrame:
    """Projection after the manual corrections of one view and smoothing.

    ``overrides`` has the month, ``op`` and ``value``, optionally ``view``
    (n | m) and the columns of ``by``; rows without a view hold for both.
    """
    if overrides is not None:
        if "view" in overrides.columns:
            overrides = overrides.filter(F.col("view").isNull() | (F.col("view") == view))
        keys = [c for c in by if c in overrides.columns]
        projected = override_projection(projected, overrides, cfg.month, keys, suffix)
    return smooth_projection(projected, smooth, by, suffix)


def all_methods(
    sums: DataFrame, cfg: MonitorConfig, view: str = "n", by: Sequence[str] = ()
) -> DataFrame:
    """One row per group and open month with the projections of all methods side by side."""
    out = sums
    for method in METHODS:
        out = with_projection(out, cfg, view, method, by, suffix=f"_{method}")
    return open_cohorts(out, cfg).select(
        *by, cfg.month, F.col(f"rd_usable_{METHODS[0]}").alias("rd_usable"),
        *[F.col(f"rd_proj_{m}").alias(m) for m in METHODS],
    )


def portfolio_projection(
    projected: DataFrame, view: str = "n", month: str = "codmes"
) -> DataFrame:
    """Portfolio rate per month: segment projections weighted by their size."""
    weight = F.when(F.col("rd_proj").isNotNull(), F.col(view).cast("double"))
    return projected.groupBy(month).agg(
        F.count("rd_proj").alias("segments"),
        (F.sum(F.col("rd_proj") * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("rd_proj"),
    )
