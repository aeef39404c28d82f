"""Cohort flags, latest usable target and the projection factor table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.functions.buckets import flag
from scoremon.operators import settings as by_settings
from scoremon.operators.calibration import cohort_sums
from scoremon.operators.projection import adjusted, with_projection

# Fixed value: projected rate of a segment and month without any projection.
DEFAULT_RATE = 0.005


def latest_target(cfg: MonitorConfig) -> Column:
    """0/1 target at the newest usable horizon of the cohort, 0 elsewhere."""
    out = F
    for j, h in cfg.usable.items():
        out = out.when(F.col(cfg.month) == cfg.cutoff(12 - j), cfg.defaulted(h))
    return out.otherwise(0)


def cohort_flags(
    cfg: MonitorConfig, recent: tuple[int, int] | None = None, early_until: int | None = None
) -> dict[str, Column]:
    """Window flags of the cohort month.

    Diagnosis covers the first six open cohorts, recent the youngest three
    (or the given months), closed / temporary / early the cohorts old enough
    for the respective target; ``early_until`` defaults to the 12-month one.
    """
    m = F.col(cfg.month)
    lo, hi = recent or (cfg.cutoff(3), cfg.cutoff(1))
    return {
        "flg_diagnosis": flag(m.between(cfg.cutoff(11), cfg.cutoff(6))),
        "flg_recent": flag(m.between(lo, hi)),
        "flg_closed": flag(m <= cfg.cutoff(12)),
        "flg_temp": flag(m <= cfg.cutoff(9)),
        "flg_early": flag(m <= (early_until or early_month(cfg))),
    }


def early_month(cfg: MonitorConfig) -> int:
    """Newest cohort with twelve months of history."""
    return cfg.cutoff(0)


def segment_id(segment: str, ids: Mapping[str, int]) -> Column:
    """Projection segment of a label; null for labels without one."""
    out = F
    for label, i in ids.items():
        out = out.when(F.col(segment) == label, i)
    return out


def factor_table(
    df: DataFrame,
    cfg: MonitorConfig,
    ids: Mapping[str, int],
    run_month: int,
    use: str = "",
    method: str = "met1",
    projected_months: int | None = None,
    overrides: DataFrame | None = None,
    smooth: int = 1,
) -> DataFrame:
    """Projection factors per segment and month of the base, by accounts and amount.

    The first ``projected_months`` open cohorts (default: those of ``cfg``)
    carry a projection, after corrections and smoothing; all other months get
    the filling values.  Both views come from the same monthly sums, so the
    base is scanned once.  Corrections of one segment name it in ``seg_proy``.
    """
    cfg = cfg.with_(open_months=projected_months or cfg.open_months)
    horizons = [cfg.target, *cfg.usable.values()]
    base = cfg.select_universe(df, use).withColumn("seg_proy", segment_id(cfg.segment, ids))
    sums = cohort_sums(
        base.filter("seg_proy IS NOT NULL"), cfg.with_(pds=()), horizons, by=("seg_proy",)
    )
    both, by = sums, ("seg_proy",)
    for view in ("n", "m"):
        both = with_projection(both, cfg, view, method, by, suffix=f"_{view}")
        both = adjusted(both, cfg, view, overrides, smooth, by, suffix=f"_{view}")
    return _fill(
        both.withColumn("month_def", F.lit(run_month)),
        cfg.month, "rd_proj_m", "factor_m", "rd_proj_n", "factor_n",
    )


def factor_table_by_settings(
    df: DataFrame,
    cfg: MonitorConfig,
    ids: Mapping[str, int],
    run_month: int,
    settings: DataFrame,
    target: str = "def",
    use: str = "",
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Factor table of one target (``def`` or ``early``) with settings per segment id and view.

    Segments are named by ``seg_proy`` in ``settings`` and ``overrides``.  Only open cohorts
    have rows; the base is scanned once for both views.
    """
    base = cfg.select_universe(df, use).withColumn("seg_proy", segment_id(cfg.segment, ids))
    sums = cohort_sums(
        base.filter("seg_proy IS NOT NULL"), cfg.with_(pds=()), by_settings.horizons(cfg), ("seg_proy",), early=True
    )
    projected = by_settings.project(sums, cfg, settings, ("seg_proy",), overrides)
    both = by_settings.side_by_side(projected, cfg, target, ("seg_proy",))
    return _fill(
        both.withColumn("month_def", F.lit(run_month)), cfg.month, "rd_proj_m", "factor_m", "rd_proj_n", "factor_n"
    )


def merge_factor_views(
    accounts: DataFrame, amounts: DataFrame, run_month: int, keys: Sequence[str] = ("seg_proy",),
    month: str = "codmes",
) -> DataFrame:
    """Factor table from two exported views: inner join on segment and month.

    Each view has the keys, the month, ``rd_proj`` and ``factor``.
    """
    on = [*keys, month]

    def view(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*on, *[F.col(c).alias(f"{c}_{tag}") for c in ("rd_proj", "factor")])

    joined = view(accounts, "n").join(view(amounts, "m"), on, "inner")
    return _fill(
        joined.withColumn("month_def", F.lit(run_month)),
        month, "rd_proj_m", "factor_m", "rd_proj_n", "factor_n",
    )


def _fill(df: DataFrame, month: str, rate_m: str, factor_m: str, rate_n: str, factor_n: str) -> DataFrame:
    return df.select(
        "month_def", month, "seg_proy",
        F.coalesce(rate_m, F.lit(DEFAULT_RATE)).alias("projection_amounts"),
        F.coalesce(factor_m, F.lit(0.0)).alias("factor_amounts"),
        F.coalesce(rate_n, F.lit(DEFAULT_RATE)).alias("projection_accounts"),
        F.coalesce(factor_n, F.lit(0.0)).alias("factor_accounts"),
    )


def one_per_key(factors: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Factors with unique keys: of repeated rows the largest values count."""
    return factors.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


FACTORS = ("factor_amounts", "factor_accounts", "projection_amounts", "projection_accounts")


def factor_join(df: DataFrame, factors: DataFrame, cfg: MonitorConfig) -> DataFrame:
    """Apply a factor table to applications.

    Adds the latest target, the factors of segment and month, the factored
    target and the projected rate, by amount and by account.  The factor
    table has one row per segment id and month; whether it is broadcast
    follows from its measured size.
    """
    small = one_per_key(factors, [cfg.month, "seg_proy"], FACTORS).withColumnsRenamed(
        {"projection_amounts": "proj_value_m", "projection_accounts": "proj_value_n"}
    )
    joined = df.withColumn("ult_rd", latest_target(cfg)).join(small, [cfg.month, "seg_proy"], "left")
    return joined.withColumns(
        {
            "proj_factor_m": F.col("ult_rd") * F.col("factor_amounts"),
            "proj_factor_n": F.col("ult_rd") * F.col("factor_accounts"),
        }
    )
