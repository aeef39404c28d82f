"""The reporting cube: one wide aggregate for a BI tool."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.operators.calibration import MONEY, money
from scoremon.operators.cohorts import FACTORS, cohort_flags, early_month, latest_target, one_per_key

FLAGS = ("flg_diagnosis", "flg_recent", "flg_closed", "flg_temp", "flg_early")


def measure_names(pds: Sequence[str]) -> list[str]:
    """Measures of the cube, amount view then account view."""
    out = []
    for view, size in (("xm", "m"), ("xn", "n")):
        out += [f"pd_{i:02d}_{view}" for i in range(1, len(pds) + 1)]
        out.append(size)
        out += [f"def_{s}_{view}" for s in ("closed", "temp", "early")]
        out += [f"proj_{s}_{w}_{view}" for s in ("factor", "value") for w in ("dt", "mt")]
    return out


def reporting_cube(
    df: DataFrame,
    cfg: MonitorConfig,
    axes: Mapping[str, str],
    pds: Sequence[str],
    factors: DataFrame,
    tooltip: str = "segment",
    recent: tuple[int, int] | None = None,
    early_until: int | None = None,
    horizons: tuple[int, int, int] = (24, 21, 12),
) -> DataFrame:
    """Group by month, projection segment, cohort flags, tooltip and all axes.

    ``axes`` maps driver columns to axis codes, ``pds`` are the probabilities
    in order; ``df`` has ``seg_proy``.  Each default measure counts only the
    cohorts old enough for it.  Projection measures hold for the first six
    open cohorts (``dt``) and the next three (``mt``).  Month and segment are
    group keys, so factors are applied after the aggregation, to sums; the
    base is shuffled once, combined map-side.
    """
    m = F.col(cfg.month)
    early = early_until or early_month(cfg)
    amount = money(cfg.amount)
    zero = F.lit(0).cast(MONEY)
    until = {"closed": (cfg.cutoff(12), horizons[0]), "temp": (cfg.cutoff(9), horizons[1]),
             "early": (early, horizons[2])}
    keys = [cfg.month, "seg_proy", *FLAGS, "eje_tooltip", *axes.values()]
    # Evaluate shared expressions once, before the aggregate.
    prepared = df.select(
        cfg.month, "seg_proy",
        *[c.alias(name) for name, c in cohort_flags(cfg, recent, early).items()],
        F.col(tooltip).alias("eje_tooltip"),
        *[F.col(c).alias(axis) for c, axis in axes.items()],
        *[F.col(p).alias(f"_pd{i}") for i, p in enumerate(pds)],
        F.col(cfg.amount).alias("_w"), amount.alias("_amount"),
        latest_target(cfg).alias("_ult"),
        *[cfg.defaulted(h).alias(f"_d_{name}") for name, (_, h) in until.items()],
    )
    aggs: list[Column] = []
    for i, _ in enumerate(pds, 1):
        p = F.col(f"_pd{i - 1}")
        aggs += [F.sum(p * F.col("_w")).alias(f"pd_{i:02d}_xm"), F.sum(p).alias(f"pd_{i:02d}_xn")]
    aggs += [F.sum("_amount").alias("m"), F.count(F.lit(1)).alias("n")]
    for name, (last, _) in until.items():
        d = F.col(f"_d_{name}")
        aggs += [
            F.sum(F.when(m > last, zero).when(d == 1, F.col("_amount")).otherwise(zero)).alias(f"def_{name}_xm"),
            F.sum(F.when(m > last, 0).otherwise(d)).alias(f"def_{name}_xn"),
        ]
    aggs += [
        F.sum(F.when(F.col("_ult") == 1, F.col("_amount")).otherwise(zero)).alias("_ult_m"),
        F.sum("_ult").alias("_ult_n"),
    ]
    cells = prepared.groupBy(*keys).agg(*aggs)
    small = one_per_key(factors, [cfg.month, "seg_proy"], FACTORS)
    joined = cells.join(small, [cfg.month, "seg_proy"], "left")
    windows = {"dt": (cfg.cutoff(11), cfg.cutoff(6)), "mt": (cfg.cutoff(5), cfg.cutoff(3))}
    projected = {}
    for tag, (lo, hi) in windows.items():
        inside = m.between(lo, hi)
        for view, size, kind in (("xm", "m", "amounts"), ("xn", "n", "accounts")):
            ult = F.col(f"_ult_{size}").cast("double")
            projected[f"proj_factor_{tag}_{view}"] = F.when(inside, ult * F.col(f"factor_{kind}")).otherwise(0.0)
            projected[f"proj_value_{tag}_{view}"] = F.when(
                inside, F.col(size).cast("double") * F.col(f"projection_{kind}")
            ).otherwise(0.0)
    return joined.withColumns(projected).select(*keys, *measure_names(pds))


def cube_long(cube: DataFrame, axes: Sequence[str], measures: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form of a cube: one row per kept key, axis and label.

    Reads the cube, not the base, so only aggregated rows are unpivoted.
    """
    pairs = ", ".join(f"'{a}', CAST({a} AS STRING)" for a in axes)
    long = cube.select(*keep, *measures, F.expr(f"stack({len(axes)}, {pairs}) AS (axis, label)"))
    return long.groupBy(*keep, "axis", "label").agg(*[F.sum(x).alias(x) for x in measures])


def label_usage(cube: DataFrame, axes: Sequence[str], labels: DataFrame) -> DataFrame:
    """Axis labels with the number of buckets and rows each axis shows."""
    pairs = ", ".join(f"'{a}', CAST({a} AS STRING)" for a in axes)
    used = (
        cube.select("n", F.expr(f"stack({len(axes)}, {pairs}) AS (axis, label)"))
        .groupBy("axis", "label").agg(F.sum("n").alias("n"))
        .groupBy("axis").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("n"))
    )
    return labels.join(used, "axis", "left")
