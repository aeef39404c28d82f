"""Calibration: predicted probability against observed default rate.

Two views run through everything: ``"n"`` counts applications, ``"m"``
weights them by amount.  All cohort figures come from one conditional
aggregation (:func:`cohort_sums`), so a whole calibration - several PDs, all
target horizons, both views - costs one scan and one small shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from scoremon.config import MonitorConfig
from scoremon.functions.months import month_index
from scoremon.operators.projection import adjusted, with_projection

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    """Amounts add up exactly as decimals, whatever the order of the rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def weight_of(view: str) -> str:
    if view not in ("n", "m"):
        raise ValueError("view is 'n' (applications) or 'm' (amount)")
    return view


def rate(total: str | Column, weight: str | Column) -> Column:
    """Ratio as double, null when the weight is zero."""
    t = F.col(total) if isinstance(total, str) else total
    w = F.col(weight) if isinstance(weight, str) else weight
    return t.cast("double") / F.nullif(w.cast("double"), F.lit(0.0))


def cohort_sums(
    df: DataFrame, cfg: MonitorConfig, horizons: Sequence[int], by: Sequence[str] = (),
    early: bool = False,
) -> DataFrame:
    """Counts, amounts, PD sums and default sums per group and month.

    Columns: ``n``, ``m``, ``<pd>_n``, ``<pd>_m``, per horizon k ``d<k>_n``
    and ``d<k>_m``, and with ``early`` also ``early_n`` and ``early_m``.
    """
    amount = money(cfg.amount)
    out = {"n": F.count(F.lit(1)), "m": F.sum(amount)}
    for pd in cfg.pds:
        out[f"{pd}_n"] = F.sum(pd)
        out[f"{pd}_m"] = F.sum(F.col(pd) * F.col(cfg.amount))
    flags = {f"d{k}": cfg.defaulted(k) for k in sorted(set(horizons))}
    if early:
        flags["early"] = cfg.early_flag()
    for name, hit in flags.items():
        out[f"{name}_n"] = F.sum(hit)
        out[f"{name}_m"] = F.sum(F.when(hit == 1, amount).otherwise(F.lit(0).cast(MONEY)))
    return (
        df.groupBy(*by, cfg.month)
        .agg(*[c.alias(name) for name, c in out.items()])
        .withColumn("month_idx", month_index(cfg.month))
    )


def roll_up(sums: DataFrame, by: Sequence[str], month: str = "codmes") -> DataFrame:
    """Coarser cohort sums from finer ones, without going back to the base."""
    keys = [*by, month, "month_idx"]
    measures = [f.name for f in sums.schema if f.name not in keys and isinstance(f.dataType, NumericType)]
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])


def report_horizons(cfg: MonitorConfig, aux: Sequence[int] = ()) -> list[int]:
    """Horizons that the reports need in their cohort sums."""
    return sorted({cfg.target, *aux, *cfg.usable.values()})


def monthly_calibration(df: DataFrame, cfg: MonitorConfig, by: Sequence[str] = ()) -> DataFrame:
    """Monthly validation cube.

    Ratios divide by all rows of the month: an application without PD stays
    in the denominator.
    """
    pd = cfg.pds[0]
    sums = cohort_sums(df, cfg.with_(pds=(pd,)), [cfg.target, cfg.target - 6], by)
    return validation_from_sums(sums, cfg, by)


def validation_from_sums(sums: DataFrame, cfg: MonitorConfig, by: Sequence[str] = ()) -> DataFrame:
    pd, k, k2 = cfg.pds[0], cfg.target, cfg.target - 6
    return sums.select(
        *by, cfg.month, "n",
        (F.col("m").cast("double") / 1_000_000).alias("amount_mm"),
        rate(f"{pd}_n", "n").alias("pd_mean"),
        rate(f"d{k}_n", "n").alias(f"rd{k}"),
        rate(f"d{k2}_n", "n").alias(f"rd{k2}"),
        F.col(f"d{k}_n").alias(f"def{k}"),
    )


def evol_calibration(
    df: DataFrame,
    cfg: MonitorConfig,
    view: str = "n",
    use: str = "",
    aux: Sequence[int] = (21, 12),
    by: Sequence[str] = (),
    method: str = "met1",
    overrides: DataFrame | None = None,
    smooth: int = 1,
) -> DataFrame:
    """Calibration over time.

    Per month: size, mean of every PD, observed rate at the target horizon for
    closed cohorts only, observed rates at the auxiliary horizons once the
    cohort is old enough for them, early rate, and the projected rate with its
    factor for the open cohorts, after manual corrections and smoothing.
    """
    sums = cohort_sums(cfg.select_universe(df, use), cfg, report_horizons(cfg, aux), by, early=True)
    return evol_from_sums(sums, cfg, view, aux, by, method, overrides, smooth)


def evol_from_sums(
    sums: DataFrame,
    cfg: MonitorConfig,
    view: str = "n",
    aux: Sequence[int] = (21, 12),
    by: Sequence[str] = (),
    method: str = "met1",
    overrides: DataFrame | None = None,
    smooth: int = 1,
) -> DataFrame:
    """Calibration over time from stored cohort sums (with ``early``)."""
    w = weight_of(view)
    k = cfg.target
    proj = adjusted(with_projection(sums, cfg, view, method, by), cfg, view, overrides, smooth, by)
    age = F.lit(cfg.closed_index + k) - F.col("month_idx")

    def seen(h: int, name: str | None = None) -> Column:
        return F.when(age >= h, rate(f"{name or f'd{h}'}_{w}", w))

    return proj.select(
        *by, cfg.month, "n", F.col("m").cast("double").alias("amount"),
        *[rate(f"{p}_{w}", w).alias(p) for p in cfg.pds],
        seen(k).alias(f"rd{k}"),
        *[seen(h).alias(f"rd{h}") for h in aux if h != k],
        seen(cfg.early_target, "early").alias(f"early{cfg.early_target}"),
        F.when(age >= k, F.col(f"d{k}_n")).alias("defaults"),
        F.when(age >= k, rate(f"d{k}_{w}", w) * F.col("n")).alias("events"),
        F.col("factor"), F.col("rd_proj"),
    )


def window_mean(df: DataFrame, columns: Sequence[str], start: int, end: int, month: str = "codmes") -> DataFrame:
    """Unweighted mean of monthly results over ``start..end``."""
    return df.filter(F.col(month).between(start, end)).agg(
        *[F.avg(c).alias(c) for c in columns]
    )


def _usable_sum(cfg: MonitorConfig, view: str, ahead: Column) -> Column:
    """Default sum at the newest usable horizon of the cohort; null if it has none."""
    out = F
    for j, h in cfg.usable.items():
        out = out.when(ahead == j, F.col(f"d{h}_{view}").cast("double"))
    return out


# -- by driver ---------------------------------------------------------------

def unpivot_drivers(df: DataFrame, drivers: Sequence[str], keep: Sequence[str | Column]) -> DataFrame:
    """Long form: one row per application and driver, labels as text.

    Only the columns named in ``keep`` travel with it, so the expansion stays
    narrow; the aggregation that follows combines it before the shuffle.
    Flags kept as floating numbers are labelled as whole numbers.
    """
    pairs = ", ".join(f"'{d}', {_label(df, d)}" for d in drivers)
    kept = [c if isinstance(c, Column) else F.col(c) for c in keep]
    return df.select(*kept, F.expr(f"stack({len(drivers)}, {pairs}) AS (variable, bucket)"))


def _label(df: DataFrame, driver: str) -> str:
    text = f"CAST(`{driver}` AS STRING)"
    if not isinstance(df.schema[driver].dataType, (DoubleType, FloatType)):
        return text
    whole = f"CAST(CAST(`{driver}` AS DECIMAL(38,0)) AS STRING)"
    return f"CASE WHEN `{driver}` = floor(`{driver}`) AND abs(`{driver}`) < 1e15 THEN {whole} ELSE {text} END"


def drop_missing(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Leave out missing labels; a null label goes too."""
    return df.filter(~F.col(bucket).like("%issing%"))


def driver_cells(
    df: DataFrame, cfg: MonitorConfig, drivers: Sequence[str], horizons: Sequence[int],
    keep_missing: bool = True, by: Sequence[str] = (),
) -> DataFrame:
    """Sums per (driver, bucket, month): all drivers in one pass.

    ``by`` cuts the cells further, by segment where segments have factors of their own.
    """
    long = unpivot_drivers(
        df, drivers, [*by, cfg.month, cfg.amount, *cfg.target_inputs(horizons), *cfg.pds]
    )
    if not keep_missing:
        long = drop_missing(long)
    return cohort_sums(long, cfg, horizons, by=(*by, "variable", "bucket"))


def factor_keys(factors: DataFrame, cfg: MonitorConfig) -> list[str]:
    """Columns that factors are kept by: the month, and the segment if they have it."""
    return [c for c in (cfg.segment, cfg.month) if c in factors.columns]


def with_factors(cells: DataFrame, factors: DataFrame, cfg: MonitorConfig) -> DataFrame:
    """Cells with ``month_factor``: that of their month, or of their segment and month.

    Factors are unique by these keys; of several rows the largest counts.  Cells without a
    factor, those of a null segment too, keep null and take no part in projected rates.
    """
    keys = factor_keys(factors, cfg)
    if cfg.segment in keys and cfg.segment not in cells.columns:
        raise ValueError(f"factors by {cfg.segment} need cells by {cfg.segment}")
    single = factors.groupBy(*keys).agg(F.max("factor").alias("month_factor"))
    return cells.join(single, keys, "left")


def multi_driver_calibration(
    df: DataFrame,
    cfg: MonitorConfig,
    drivers: Sequence[str],
    factors: DataFrame,
    view: str = "n",
    use: str = "",
    aux: int = 12,
    min_share: float = 0.0,
    keep_missing: bool = False,
) -> DataFrame:
    """Calibration per bucket of every driver.

    ``factors`` is the projection by month (``codmes``, ``factor``) or by segment and month
    (with the segment column too).  It is applied to month sums, not to single applications.
    With segment factors the projected defaults of a bucket are those of its segments, each
    with its own factor, over the size of the segments that have one: a portfolio report from
    segment projections.  Buckets below ``min_share`` of their driver are left out.
    """
    by = [c for c in factor_keys(factors, cfg) if c == cfg.segment]
    cells = driver_cells(
        cfg.select_universe(df, use), cfg, drivers, report_horizons(cfg, [aux]), keep_missing, by
    )
    return drivers_from_cells(cells, cfg, factors, view, aux, min_share)


def drivers_from_cells(
    cells: DataFrame,
    cfg: MonitorConfig,
    factors: DataFrame,
    view: str = "n",
    aux: int = 12,
    min_share: float = 0.0,
) -> DataFrame:
    """Calibration per bucket from stored driver cells, by segment for segment factors."""
    w = weight_of(view)
    k = cfg.target
    joined = with_factors(cells, factors, cfg)
    ahead = F.col("month_idx") - F.lit(cfg.closed_index)
    usable = _usable_sum(cfg, w, ahead)
    weight = F.col(w).cast("double")
    closed = ahead <= 0
    grouped = joined.groupBy("variable", "bucket").agg(
        F.sum("n").alias("n"),
        F.sum(weight).alias("weight"),
        *[F.sum(f"{p}_{w}").alias(f"{p}_sum") for p in cfg.pds],
        F.sum(F.col(f"d{aux}_{w}").cast("double")).alias("aux_sum"),
        F.sum(F.when(closed, F.col(f"d{k}_{w}").cast("double"))).alias("closed_sum"),
        F.sum(F.when(closed, weight)).alias("closed_weight"),
        F.sum(usable * F.col("month_factor")).alias("open_sum"),
        F.sum(F.when(F.col("month_factor").isNotNull() & usable.isNotNull(), weight)).alias("open_weight"),
    )
    total = grouped.groupBy("variable").agg(F.sum("weight").alias("_total"))
    return (
        grouped.join(total, "variable").withColumn("share", rate("weight", "_total"))
        .filter(F.col("share") >= min_share)
        .select(
            "variable", "bucket", "n", "share",
            *[rate(f"{p}_sum", "weight").alias(p) for p in cfg.pds],
            rate("aux_sum", "weight").alias(f"rd{aux}"),
            rate("closed_sum", "closed_weight").alias(f"rd{k}"),
            rate("open_sum", "open_weight").alias("rd_proj"),
        )
    )


def driver_calibration(df: DataFrame, cfg: MonitorConfig, driver: str, factors: DataFrame, **kw) -> DataFrame:
    """Calibration per bucket of one driver."""
    out = multi_driver_calibration(df, cfg, [driver], factors, **kw)
    return out.drop("variable").withColumnRenamed("bucket", driver)


def information_value(
    df: DataFrame, cfg: MonitorConfig, drivers: Sequence[str], view: str = "n", use: str = "",
    floor: float = 1e-4,
) -> DataFrame:
    """Information value of every driver: sum of (good% - bad%) * ln(good% / bad%).

    A bucket without goods or bads enters with the share ``floor``; a driver
    without any goods or bads at all has no information value.
    """
    cells = driver_cells(cfg.select_universe(df, use), cfg.with_(pds=()), drivers, [cfg.target])
    return iv_from_cells(cells, cfg, view, floor)


def iv_from_cells(cells: DataFrame, cfg: MonitorConfig, view: str = "n", floor: float = 1e-4) -> DataFrame:
    """Information value from stored driver cells."""
    w = weight_of(view)
    bad = F.col(f"d{cfg.target}_{w}")
    cells = cells.groupBy("variable", "bucket").agg(
        F.sum(bad).cast("double").alias("bads"), F.sum(F.col(w) - bad).cast("double").alias("goods")
    )
    totals = cells.groupBy("variable").agg(F.sum("goods").alias("_goods"), F.sum("bads").alias("_bads"))
    share = {
        side: F.coalesce(F.col(side), F.lit(0.0)) / F.nullif(F.col(f"_{side}"), F.lit(0.0))
        for side in ("goods", "bads")
    }
    terms = cells.join(totals, "variable").select(
        "variable",
        *[F.when(s.isNotNull(), F.greatest(s, F.lit(floor))).alias(side[0]) for side, s in share.items()],
    )
    return terms.groupBy("variable").agg(
        F.count(F.lit(1)).alias("buckets"),
        F.sum((F.col("g") - F.col("b")) * F.log(F.col("g") / F.col("b"))).alias("iv"),
    )


def evol_calibration_driver(
    df: DataFrame,
    cfg: MonitorConfig,
    driver: str,
    factors: DataFrame,
    view: str = "n",
    use: str = "",
    aux: Sequence[int] = (21, 12),
    keep_missing: bool = False,
    months: int = 1,
    moving: bool = False,
) -> DataFrame:
    """Calibration over time for each bucket of one driver.

    Open cohorts use the factor of their month, or of their segment and month where
    ``factors`` has the segment.  With ``months`` > 1
    cohorts are pooled: into consecutive blocks that end at ``block_end``, or
    with ``moving`` into one window per month, up to the run month.
    """
    by = [c for c in factor_keys(factors, cfg) if c == cfg.segment]
    cells = driver_cells(
        cfg.select_universe(df, use), cfg, [driver], report_horizons(cfg, aux), keep_missing, by
    )
    out = evol_drivers_from_cells(cells, cfg, factors, view, aux, months, moving)
    return out.drop("variable").withColumnRenamed("bucket", driver)


def evol_drivers_from_cells(
    cells: DataFrame,
    cfg: MonitorConfig,
    factors: DataFrame,
    view: str = "n",
    aux: Sequence[int] = (21, 12),
    months: int = 1,
    moving: bool = False,
) -> DataFrame:
    """Calibration over time per bucket of every driver, from stored cells (see above)."""
    w = weight_of(view)
    k = cfg.target
    joined = with_factors(cells, factors, cfg)
    ahead = F.col("month_idx") - F.lit(cfg.closed_index)
    usable = _usable_sum(cfg, w, ahead)
    weight = F.col(w).cast("double")
    # Blocks are aligned to the newest closed cohort.
    block_end = F.col("month_idx") + F.pmod(F.lit(cfg.closed_index) - F.col("month_idx"), F.lit(months))
    if moving:
        block_end = F.explode(F.sequence(F.col("month_idx"), F.col("month_idx") + F.lit(months - 1)))
    joined = joined.withColumn("block_idx", block_end)
    if moving:
        joined = joined.filter(F.col("block_idx") <= cfg.closed_index + k)
    age = F.lit(cfg.closed_index + k) - F.col("month_idx")

    def seen(h: int) -> list[Column]:
        ok = age >= h
        return [
            F.sum(F.when(ok, F.col(f"d{h}_{w}").cast("double"))).alias(f"s{h}"),
            F.sum(F.when(ok, weight)).alias(f"w{h}"),
        ]

    horizons = [k, *[h for h in aux if h != k]]
    grouped = joined.groupBy("variable", "bucket", "block_idx").agg(
        F.sum("n").alias("n"),
        F.sum(weight).alias("weight"),
        *[F.sum(f"{p}_{w}").alias(f"{p}_sum") for p in cfg.pds],
        *[c for h in horizons for c in seen(h)],
        F.sum(usable * F.col("month_factor")).alias("open_sum"),
        F.sum(F.when(F.col("month_factor").isNotNull() & usable.isNotNull(), weight)).alias("open_weight"),
    )
    return grouped.select(
        "variable", "bucket",
        F.expr("CAST(floor(block_idx / 12) * 100 + block_idx % 12 + 1 AS INT)").alias("block_end"),
        "n",
        *[rate(f"{p}_sum", "weight").alias(p) for p in cfg.pds],
        *[rate(f"s{h}", f"w{h}").alias(f"rd{h}") for h in horizons],
        rate("open_sum", "open_weight").alias("rd_proj"),
    )
