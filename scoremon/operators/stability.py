"""Population stability: mix over time and the population stability index.

Drivers are label columns (buckets), so everything after the first
aggregation is a few rows per driver and month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.functions.months import month_range
from scoremon.operators.calibration import money, unpivot_drivers, weight_of

# Share given to a side on which a bucket does not occur.
EMPTY_SHARE = 1e-4
# Limits of the traffic light: stable below the first, unstable from the second.
PSI_LIMITS = (0.10, 0.25)


def mix_cells(df: DataFrame, cfg: MonitorConfig, drivers: Sequence[str], use: str = "") -> DataFrame:
    """Count and amount per driver, month and bucket; null is a bucket too.

    This is the only step that reads the base; stored ``driver_cells`` of the
    calibration can stand in for it.
    """
    long = unpivot_drivers(cfg.select_universe(df, use), drivers, [cfg.month, cfg.amount])
    return long.groupBy("variable", cfg.month, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money(cfg.amount)).alias("m")
    )


def mix_by_month(df: DataFrame, cfg: MonitorConfig, drivers: Sequence[str], use: str = "") -> DataFrame:
    """Share of every bucket per month, by applications and by amount."""
    return mix_from_cells(mix_cells(df, cfg, drivers, use), cfg)


def mix_from_cells(cells: DataFrame, cfg: MonitorConfig) -> DataFrame:
    month = Window.partitionBy("variable", cfg.month)
    return cells.select(
        "variable", cfg.month, "bucket", "n",
        *[_share(F.col(w), F.sum(w).over(month)).alias(f"share_{w}") for w in ("n", "m")],
    )


def _term(base: Column, recent: Column) -> Column:
    """Contribution of one bucket; null when a whole side is empty."""
    p = F.greatest(base, F.lit(EMPTY_SHARE))
    q = F.greatest(recent, F.lit(EMPTY_SHARE))
    return F.when(base.isNotNull() & recent.isNotNull(), (q - p) * F.log(q / p))


def _share(part: Column, total: Column) -> Column:
    """Share of a bucket; null (not empty) when the whole side is empty."""
    return F.coalesce(part.cast("double"), F.lit(0.0)) / F.nullif(total.cast("double"), F.lit(0.0))


def psi_terms(
    df: DataFrame,
    cfg: MonitorConfig,
    drivers: Sequence[str],
    base: tuple[int, int],
    recent: tuple[int, int],
    view: str = "n",
    use: str = "",
) -> DataFrame:
    """Bucket shares in both windows and the index contribution of a bucket."""
    return terms_from_cells(mix_cells(_in_windows(df, cfg, base, recent), cfg, drivers, use), cfg, base, recent, view)


def terms_from_cells(
    cells: DataFrame, cfg: MonitorConfig, base: tuple[int, int], recent: tuple[int, int], view: str = "n"
) -> DataFrame:
    m, w = F.col(cfg.month), F.col(weight_of(view))
    per_bucket = _in_windows(cells, cfg, base, recent).groupBy("variable", "bucket").agg(
        F.sum(F.when(m.between(*base), w)).alias("base"),
        F.sum(F.when(m.between(*recent), w)).alias("recent"),
    )
    totals = per_bucket.groupBy("variable").agg(*[F.sum(s).alias(f"_{s}") for s in ("base", "recent")])
    shares = {s: _share(F.col(s), F.col(f"_{s}")) for s in ("base", "recent")}
    terms = per_bucket.join(totals, "variable").select(
        "variable", "bucket", shares["base"].alias("share_base"), shares["recent"].alias("share_recent")
    )
    return terms.withColumn("psi_term", _term(F.col("share_base"), F.col("share_recent")))


def _in_windows(df: DataFrame, cfg: MonitorConfig, base, recent) -> DataFrame:
    m = F.col(cfg.month)
    return df.filter(m.between(*base) | m.between(*recent))


def psi(
    df: DataFrame,
    cfg: MonitorConfig,
    drivers: Sequence[str],
    base: tuple[int, int],
    recent: tuple[int, int],
    view: str = "n",
    use: str = "",
    limits: tuple[float, float] = PSI_LIMITS,
) -> DataFrame:
    """Population stability index of every driver between two windows."""
    cells = mix_cells(_in_windows(df, cfg, base, recent), cfg, drivers, use)
    return psi_from_cells(cells, cfg, base, recent, view, limits)


def psi_from_cells(
    cells: DataFrame, cfg: MonitorConfig, base: tuple[int, int], recent: tuple[int, int], view: str = "n",
    limits: tuple[float, float] = PSI_LIMITS,
) -> DataFrame:
    total = terms_from_cells(cells, cfg, base, recent, view).groupBy("variable").agg(
        F.count(F.lit(1)).alias("buckets"), F.sum("psi_term").alias("psi")
    )
    return total.withColumn("status", traffic_light("psi", limits))


def traffic_light(value: str, limits: tuple[float, float] = PSI_LIMITS) -> Column:
    v = F.col(value)
    return F.when(v < limits[0], "green").when(v < limits[1], "amber").when(v >= limits[1], "red")


def evol_psi(
    df: DataFrame,
    cfg: MonitorConfig,
    drivers: Sequence[str],
    base: tuple[int, int],
    recent: tuple[int, int],
    view: str = "n",
    use: str = "",
    limits: tuple[float, float] = PSI_LIMITS,
) -> DataFrame:
    """Index of every month of the recent window against the base window.

    A bucket that a month lacks still counts, with the empty share.  Months
    without any row have no index and no result row.
    """
    cells = mix_cells(_in_windows(df, cfg, base, recent), cfg, drivers, use)
    return evol_psi_from_cells(cells, cfg, base, recent, view, limits)


def evol_psi_from_cells(
    cells: DataFrame, cfg: MonitorConfig, base: tuple[int, int], recent: tuple[int, int], view: str = "n",
    limits: tuple[float, float] = PSI_LIMITS,
) -> DataFrame:
    m, w = F.col(cfg.month), F.col(weight_of(view))
    # One row per bucket with its months as a map, then one row per bucket and
    # recent month, so that absent buckets show up; labels and months are few.
    per_bucket = _in_windows(cells, cfg, base, recent).groupBy("variable", "bucket").agg(
        F.sum(F.when(m.between(*base), w)).alias("base_w"),
        F.map_from_entries(
            F.collect_list(F.when(m.between(*recent), F.struct(m.alias("period"), w.alias("w"))))
        ).alias("by_period"),
    )
    months = F.array(*[F.lit(x) for x in month_range(*recent)])
    shaped = per_bucket.select("variable", "bucket", "base_w", F.explode(months).alias(cfg.month), "by_period")
    cell = Window.partitionBy("variable", cfg.month)
    recent_w = F.col("by_period")[F.col(cfg.month)]
    terms = shaped.withColumn("w", recent_w).select(
        "variable", cfg.month,
        _share(F.col("base_w"), F.sum("base_w").over(cell)).alias("p"),
        _share(F.col("w"), F.sum("w").over(cell)).alias("q"),
    ).filter("q IS NOT NULL")
    out = terms.groupBy("variable", cfg.month).agg(F.sum(_term(F.col("p"), F.col("q"))).alias("psi"))
    return out.withColumn("status", traffic_light("psi", limits))
