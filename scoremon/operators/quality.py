"""Data checks: duplicates, missing values, profiles and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.operators.calibration import money, rate


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def missing_by(
    df: DataFrame, by: Sequence[str], checks: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Rows per group in which all columns of a check are null at once."""
    out = []
    for name, columns in checks.items():
        hit = F.lit(True)
        for c in columns:
            hit = hit & F.col(c).isNull()
        out.append(F.count_if(hit).alias(name))
    return df.groupBy(*by).agg(*out, F.count(F.lit(1)).alias("n"))


def bucket_counts(df: DataFrame, bucket: str) -> DataFrame:
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("count"))


def table_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count, column count and, per column, nulls and value range.

    One aggregation over the table; the single result row is unpivoted.
    """
    columns = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"),
            F.min(c).cast("string").alias(f"min_{i}"),
            F.max(c).cast("string").alias(f"max_{i}"),
        ]
    rows = ", ".join(f"'{c}', nulls_{i}, min_{i}, max_{i}" for i, c in enumerate(columns))
    return df.agg(*aggs).select(
        "n", F.lit(len(df.columns)).alias("n_columns"),
        F.expr(f"stack({len(columns)}, {rows}) AS (column_name, nulls, min, max)"),
    )


def reconcile(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Differences of two monthly cubes on their common months."""
    other = right.select(on, *[F.col(c).alias(f"{c}_2") for c in columns])
    return left.join(other, on, "inner").select(
        on, *[F.round(F.col(c) - F.col(f"{c}_2"), digits).alias(f"dif_{c}") for c in columns]
    )


def reconcile_universes(
    df: DataFrame, cfg: MonitorConfig, left: str, right: str, digits: int = 2
) -> DataFrame:
    """Monthly cube under predicate ``left`` minus the one under ``right``.

    Same result as building both cubes and joining them, but both universes
    are aggregated conditionally in one scan.
    """
    pd, k, k2 = cfg.pds[0], cfg.target, cfg.target - 6
    sides = {"a": F.coalesce(F.expr(left or "true"), F.lit(False)),
             "b": F.coalesce(F.expr(right or "true"), F.lit(False))}
    aggs = []
    for s, inside in sides.items():
        aggs += [
            F.count_if(inside).alias(f"n_{s}"),
            F.sum(F.when(inside, money(cfg.amount))).alias(f"amount_{s}"),
            F.sum(F.when(inside, F.col(pd))).alias(f"pd_{s}"),
            F.sum(F.when(inside, cfg.defaulted(k))).alias(f"d_{s}"),
            F.sum(F.when(inside, cfg.defaulted(k2))).alias(f"d2_{s}"),
        ]
    cube = df.groupBy(cfg.month).agg(*aggs).filter("n_a > 0 AND n_b > 0")

    def diff(of):
        return F.round(of("a") - of("b"), digits)

    return cube.select(
        cfg.month,
        (F.col("n_a") - F.col("n_b")).alias("dif_n"),
        diff(lambda s: F.col(f"amount_{s}").cast("double") / 1_000_000).alias("dif_amount_mm"),
        diff(lambda s: rate(f"pd_{s}", f"n_{s}")).alias("dif_pd_mean"),
        diff(lambda s: rate(f"d_{s}", f"n_{s}")).alias(f"dif_rd{k}"),
        diff(lambda s: rate(f"d2_{s}", f"n_{s}")).alias(f"dif_rd{k2}"),
        (F.col("d_a") - F.col("d_b")).alias(f"dif_def{k}"),
    )


def column_diff(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    """Columns that only one of two frames has."""
    a, b = set(left.columns), set(right.columns)
    return {"left_only": sorted(a - b), "right_only": sorted(b - a)}


def table_diff(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Compare two tables by key, column by column.

    Both sides are stacked and grouped by key, which combines repeated rows
    map-side; a full outer join could not split a hot key.  A key that a side
    repeats is compared by the multisets of its values (their number and the
    sum of their hashes), and counted in ``left_repeated`` / ``right_repeated``.
    One result row per compared column, plus one per one-sided column.
    """
    only = column_diff(left, right)
    shared = [c for c in left.columns if c in right.columns and c not in key]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*key, F.lit(tag).alias("_side"), *shared)

    aggs = [F.count_if(F.col("_side") == s.upper()).alias(f"n_{s}") for s in ("l", "r")]
    for i, c in enumerate(shared):
        for s in ("l", "r"):
            own = F.col("_side") == s.upper()
            aggs += [
                F.max(F.when(own, F.col(c))).alias(f"{s}_{i}"),
                F.sum(F.when(own, F.xxhash64(c).cast("decimal(20,0)"))).alias(f"{s}h_{i}"),
            ]
    per_key = side(left, "L").unionByName(side(right, "R")).groupBy(*key).agg(*aggs)
    in_l, in_r = F.col("n_l") > 0, F.col("n_r") > 0
    both, single = in_l & in_r, (F.col("n_l") == 1) & (F.col("n_r") == 1)

    def differs(i: int) -> Column:
        unlike = (F.col("n_l") != F.col("n_r")) | ~F.col(f"lh_{i}").eqNullSafe(F.col(f"rh_{i}"))
        return F.when(single, ~F.col(f"l_{i}").eqNullSafe(F.col(f"r_{i}"))).otherwise(unlike)

    totals = per_key.agg(
        F.count_if(both).alias("matched"),
        F.count_if(in_l & ~in_r).alias("left_only"),
        F.count_if(in_r & ~in_l).alias("right_only"),
        F.count_if(F.col("n_l") > 1).alias("left_repeated"),
        F.count_if(F.col("n_r") > 1).alias("right_repeated"),
        *[F.count_if(both & differs(i)).alias(f"x_{i}") for i in range(len(shared))],
    )
    rows = [f"'{c}', 'both', x_{i}" for i, c in enumerate(shared)]
    rows += [f"'{c}', '{k}', CAST(NULL AS BIGINT)" for k in ("left_only", "right_only") for c in only[k]]
    if not rows:
        rows = ["CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS BIGINT)"]
    return totals.select(
        F.expr(f"stack({len(rows)}, {', '.join(rows)}) AS (column_name, present, mismatches)"),
        "matched", "left_only", "right_only", "left_repeated", "right_repeated",
    )
