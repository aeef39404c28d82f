"""Projections with settings of their own per segment, view and target.

A run projects two targets, the default at the target horizon (``def``) and the early
delinquency (``early``), by applications (``n``) and by amount (``m``).  Method, depth of the
history and width of the smoothing differ between them, and single segments may differ again.
They come as a table that is joined to the cohort sums: every combination of segment, month,
view, target and horizon is a row with the settings that hold for it, and all of them are
projected in one pass of window aggregates over these small rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.operators.projection import METHODS, override_projection

VIEWS = ("n", "m")
SETTINGS = ("method", "depth", "width")


@dataclass(frozen=True)
class Target:
    """What is projected: its sums, its newest closed cohort, and the usable horizons after it."""

    name: str
    column: str
    closed_index: int
    usable: Mapping[int, int]


def targets(cfg: MonitorConfig) -> tuple[Target, ...]:
    """Default and, where it can be projected, early delinquency.

    A cohort j months after the newest closed one has j months less of history, so the early
    target is projected from the defaults that came up to then.  Stored targets hold no such
    early horizons unless ``early_usable`` names them.
    """
    k, usable = cfg.early_target, cfg.early_usable
    default = Target(
        "def", f"d{cfg.target}", cfg.closed_index, {j: h for j, h in cfg.usable.items() if j <= cfg.open_months}
    )
    if usable is None:
        usable = {} if cfg.target_prefix else {j: k - j for j in range(1, k)}
    return (default, Target("early", "early", cfg.closed_index + cfg.target - k, usable)) if usable else (default,)


def horizons(cfg: MonitorConfig) -> list[int]:
    """Horizons that the cohort sums of a projection need, beside ``early``."""
    return sorted({cfg.target, *(h for t in targets(cfg) for h in t.usable.values())})


def table(
    spark: SparkSession, rows: Sequence[tuple], segment: str = "segment", kind: str = "STRING"
) -> DataFrame:
    """Settings from (segment, view, target, method, depth, width) tuples.

    A null segment stands for all that have no row of their own.
    """
    for r in rows:
        if r[1] not in VIEWS or r[2] not in ("def", "early") or r[3] not in METHODS:
            raise ValueError(f"settings {r}: view n or m, target def or early, method one of {METHODS}")
        if r[4] < 1 or r[5] < 1:
            raise ValueError(f"settings {r}: depth and width start at 1")
    return spark.createDataFrame(
        list(rows), f"{segment} {kind}, view STRING, target STRING, method STRING, depth INT, width INT"
    )


def same_for_all(spark: SparkSession, cfg: MonitorConfig, method: str = "met1", width: int = 1) -> DataFrame:
    """One method, the depth of the config and one width for both views and targets."""
    return table(spark, [(None, v, t.name, method, cfg.history, width) for v in VIEWS for t in targets(cfg)], cfg.segment)


def _long(sums: DataFrame, cfg: MonitorConfig, by: Sequence[str]) -> DataFrame:
    """A row per cohort, view, target and usable horizon."""
    cases = []
    for t in targets(cfg):
        ahead = F.col("month_idx") - F.lit(t.closed_index)
        for view in VIEWS:
            for h in sorted(set(t.usable.values())):
                cases.append(F.struct(
                    F.lit(view).alias("view"), F.lit(t.name).alias("target"), F.lit(h).alias("horizon"),
                    ahead.cast("int").alias("ahead"),
                    ahead.isin([j for j, own in t.usable.items() if own == h]).alias("is_open"),
                    F.col(view).cast("double").alias("weight"),
                    F.col(f"{t.column}_{view}").cast("double").alias("goal"),
                    F.col(f"d{h}_{view}").cast("double").alias("so_far"),
                ))
    return sums.select(*by, cfg.month, "month_idx", F.inline(F.array(*cases)))


def _with_settings(long: DataFrame, settings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Settings of the own segment, else those for all; rows without any drop out."""
    keys = [c for c in by if c in settings.columns]
    single = settings.groupBy(*keys, "view", "target").agg(F.max(F.struct(*SETTINGS)).alias("_own"))
    some = F.lit(False)
    for c in keys:
        some = some | F.col(c).isNotNull()
    general = single.filter(~some).select("view", "target", F.col("_own").alias("_all"))
    out = long.join(general, ["view", "target"], "left")
    if keys:
        out = out.join(single.filter(some), [*keys, "view", "target"], "left")
    else:
        out = out.withColumn("_own", F.lit(None).cast(out.schema["_all"].dataType))
    chosen = F.coalesce("_own", "_all")
    return out.withColumns({c: chosen[c] for c in SETTINGS}).drop("_own", "_all").filter("method IS NOT NULL")


def _growth(cfg: MonitorConfig, by: Sequence[str]) -> Column:
    """Factor by the method of the row, from the history of its horizon as deep as it says."""
    history = Window.partitionBy(*by, "view", "target", "horizon")
    ratio = F.when(
        F.col("ahead").between(1 - F.col("depth"), 0), F.col("goal") / F.nullif(F.col("so_far"), F.lit(0.0))
    )
    high, middle = (F.percentile(ratio, p).over(history) for p in (cfg.percentile, 0.5))
    trend = (
        F.regr_intercept(ratio, F.col("month_idx")).over(history)
        + F.regr_slope(ratio, F.col("month_idx")).over(history) * F.col("month_idx")
    )
    met1, met2, _ = METHODS
    return F.when(F.col("method") == met1, high).when(F.col("method") == met2, (high + middle) / 2).otherwise(trend)


def _smoothed(by: Sequence[str]) -> Column:
    """Mean of the projections within the width of the row, by calendar months."""
    # The open months of one segment, view and target: a handful.
    group = Window.partitionBy(*by, "view", "target")
    known = F.collect_list(
        F.when(F.col("rd_proj").isNotNull(), F.struct(F.col("month_idx").alias("at"), F.col("rd_proj").alias("value")))
    ).over(group)
    before, after = F.floor(F.col("width") / 2), F.floor((F.col("width") - 1) / 2)
    near = F.transform(
        F.filter(known, lambda x: x["at"].between(F.col("month_idx") - before, F.col("month_idx") + after)),
        lambda x: x["value"],
    )
    mean = F.aggregate(near, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(near), F.lit(0))
    return F.when(F.col("width") > 1, F.when(F.col("rd_proj").isNotNull(), mean)).otherwise(F.col("rd_proj"))


def _for_each(overrides: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Corrections without a view (or target) hold for all of them."""
    every = F.array(*[F.lit(v) for v in values])
    return overrides.withColumn(
        column, F.explode(F.when(F.col(column).isNull(), every).otherwise(F.array(column)))
    )


def project(
    sums: DataFrame, cfg: MonitorConfig, settings: DataFrame, by: Sequence[str] = (),
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Projections of all open cohorts: a row per group, month, view and target.

    ``sums`` are cohort sums with ``horizons`` and ``early``; ``settings`` see ``table``.
    ``overrides`` has the month, ``op``, ``value`` and optionally ``view``, ``target`` and
    columns of ``by``.  Corrections come before smoothing.  Columns: ``by``, the month,
    ``view``, ``target``, ``method``, ``weight``, ``rd_usable``, ``factor``, ``rd_proj``.
    """
    long = _with_settings(_long(sums, cfg, by), settings, by)
    rows = long.withColumn("factor", _growth(cfg, by)).filter("is_open").withColumn(
        "rd_usable", F.col("so_far") / F.nullif(F.col("weight"), F.lit(0.0))
    ).withColumn("rd_proj", F.col("rd_usable") * F.col("factor"))
    if overrides is not None:
        for column, values in (("view", VIEWS), ("target", [t.name for t in targets(cfg)])):
            if column in overrides.columns:
                overrides = _for_each(overrides, column, values)
        keys = [c for c in ("view", "target", *by) if c in overrides.columns]
        rows = override_projection(rows, overrides, cfg.month, keys)
    return rows.withColumn("rd_proj", _smoothed(by)).select(
        *by, cfg.month, "view", "target", "method", "weight", "rd_usable", "factor", "rd_proj"
    )


def side_by_side(projected: DataFrame, cfg: MonitorConfig, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Projections of one target with ``_n`` and ``_m`` columns, as factor tables have them."""
    def of(view: str, column: str) -> Column:
        return F.max(F.when(F.col("view") == view, F.col(column))).alias(f"{column}_{view}")

    return projected.filter(F.col("target") == target).groupBy(*by, cfg.month).agg(
        *[of(v, c) for v in VIEWS for c in ("rd_proj", "factor")]
    )
