"""Discrimination: Gini and Kolmogorov-Smirnov, tie-aware and exact.

Both views are here: ``"n"`` ranks applications, ``"m"`` ranks money, so that an application
counts as much as its amount, in defaults and non-defaults, in ties and in the curves.  Money
stays in decimals up to the last division, so results do not depend on the order of the rows.

The score is first aggregated to one row per (group, score value).  A group can still have as
many distinct scores as rows, so the scores of a driver are stored in ranges that Spark's
range partitioner cuts: as many as the data need, equal scores in one of them.  Each range
reduces to a few numbers (weights, ordered pairs, extreme distances) and the ranges of a group
are then put together in order.  No task sees a whole group, and the result does not depend on
where the cuts fall.

A higher score means more risk; Gini is ``2 * AUC - 1`` for defaults scored above
non-defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.functions.months import index_of, month_from_index, shift_yyyymm, yyyymm_of
from scoremon.operators.calibration import MONEY, money, rate, unpivot_drivers, weight_of
from scoremon.sources.tables import store


def score_counts(
    df: DataFrame, group: Sequence[str], score: str, targets: dict[str, Column], amount: Column | None = None
) -> DataFrame:
    """Rows and defaults per (group, score value); rows without score drop out.

    With ``amount`` the targets are sums of it, and ``m`` is its sum over all rows; a missing
    amount weighs nothing.
    """
    s = F.col(score).cast("double")
    # -0.0 and 0.0 are one score.
    kept = df.filter(s.isNotNull() & ~F.isnan(s)).withColumn("_score", s + F.lit(0.0))
    sums = {name: F.sum(t) for name, t in targets.items()}
    if amount is not None:
        weight = F.coalesce(money(amount), F.lit(0).cast(MONEY))
        sums = {name: F.sum(F.when(t == 1, weight).otherwise(F.lit(0).cast(MONEY))) for name, t in targets.items()}
        sums["m"] = F.sum(weight)
    return kept.groupBy(*group, F.col("_score").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), *[total.alias(name) for name, total in sums.items()]
    )


def score_ranges(counts: DataFrame, cut_by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Stored ``counts`` with the range (``part``) of their score, in order within ``cut_by``.

    Without a number of ranges adaptive execution decides by the size of the data.
    """
    keys = [*cut_by, "score"]
    cut = counts.repartitionByRange(ranges, *keys) if ranges else counts.repartitionByRange(*keys)
    return store(cut.withColumn("part", F.spark_partition_id()), "score-ranges")


def gini_ks(
    counts: DataFrame, group: Sequence[str], targets: Sequence[str], cut_by: Sequence[str] = (),
    spread: Callable[[DataFrame], DataFrame] | None = None, ranges: int | None = None, weight: str = "n",
) -> DataFrame:
    """Gini and KS per group from ``score_counts`` rows, for several targets.

    The score axis is cut once per ``cut_by``, and rows move by (``cut_by``, range).
    ``spread`` copies rows to the windows they belong to, after that exchange.  A score may
    come in several rows of its group (one per month of a window); the frames below treat
    equal scores as one.  ``weight`` is the column that targets are parts of: ``n`` or ``m``.
    Adds ``n``, with ``m`` also ``amount``, and per target ``t`` ``gini_<t>`` and ``ks_<t>``;
    both are null for a group with defaults only or without any.
    """
    spread = spread or (lambda df: df)
    keys, measures = list(cut_by), list(dict.fromkeys(["n", weight]))
    # Counts of pairs outgrow a long, so they are doubles; money stays decimal.
    number = (lambda c: c) if weight == "m" else (lambda c: c.cast("double"))
    counts = score_ranges(counts, keys, ranges)
    months = [c for c in counts.columns if c not in ("score", "part", *measures, *targets)]
    sums = counts.groupBy(*months).agg(*[F.sum(c).alias(c) for c in (*measures, *targets)])
    totals = spread(sums).groupBy(*group).agg(
        F.sum("n").alias("rows"), F.sum(weight).alias("total"), *[F.sum(t).alias(f"{t}_bads") for t in targets]
    )
    # A row per driver and window; a stored table has a known size, which decides on the join.
    totals = store(totals, "score-totals")
    ranged = spread(counts.repartition(*keys, "part")).join(totals, list(group))
    by_score = Window.partitionBy(*group, "part").orderBy("score")
    upto = by_score.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = by_score.rangeBetween(Window.currentRow, Window.currentRow)
    goods_here = {t: F.col(weight) - F.col(t) for t in targets}
    running = ranged.withColumns(
        {c: e for t in targets for c, e in {
            f"{t}_b": F.sum(t).over(upto),
            f"{t}_g": F.sum(goods_here[t]).over(upto),
            f"{t}_tie": F.sum(goods_here[t]).over(ties),
        }.items()}
    )
    aggs = [F.first("rows").alias("rows"), F.first("total").alias("total"), F.sum(weight).alias("inside")]
    for t in targets:
        bads, goods = F.col(f"{t}_bads"), F.col("total") - F.col(f"{t}_bads")
        # Distance of the two curves inside the range, from its own start.
        gap = rate(f"{t}_b", bads) - rate(f"{t}_g", goods)
        aggs += [
            F.first(bads).alias(f"{t}_bads"),
            F.sum(t).alias(f"{t}_in"),
            # Twice the pairs won inside the range (a tie wins half).
            F.sum(number(F.col(t)) * (2 * F.col(f"{t}_g") - F.col(f"{t}_tie"))).alias(f"{t}_pairs"),
            F.max(gap).alias(f"{t}_hi"),
            F.min(gap).alias(f"{t}_lo"),
        ]
    parts = running.groupBy(*group, "part").agg(*aggs)
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns(
        {c: e for t in targets for c, e in {
            f"{t}_b0": F.coalesce(F.sum(f"{t}_in").over(before), F.lit(0)),
            f"{t}_g0": F.coalesce(F.sum(F.col("inside") - F.col(f"{t}_in")).over(before), F.lit(0)),
        }.items()}
    )
    final = [F.first("rows").alias("n")]
    if weight == "m":
        final.append(F.first("total").cast("double").alias("amount"))
    for t in targets:
        bads, goods = F.col(f"{t}_bads"), F.col("total") - F.col(f"{t}_bads")
        start = rate(f"{t}_b0", bads) - rate(f"{t}_g0", goods)
        won = F.sum(F.col(f"{t}_pairs") + 2 * number(F.col(f"{t}_in")) * F.col(f"{t}_g0")).cast("double")
        pairs = F.nullif(F.first(bads).cast("double") * F.first(goods).cast("double"), F.lit(0.0))
        final += [
            (won / pairs - 1).alias(f"gini_{t}"),
            F.max(
                F.greatest(F.abs(start + F.col(f"{t}_hi")), F.abs(start + F.col(f"{t}_lo")))
            ).alias(f"ks_{t}"),
        ]
    return placed.groupBy(*group).agg(*final)


def _in_months(df: DataFrame, cfg: MonitorConfig, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(cfg.month) >= start)
    if end is not None:
        df = df.filter(F.col(cfg.month) <= end)
    return df


def evol_gini(
    df: DataFrame,
    cfg: MonitorConfig,
    score: str,
    horizons: Sequence[int] = (24, 21, 18),
    use: str = "",
    start: int | None = None,
    end: int | None = None,
    months: int = 1,
    moving: bool = False,
    limits: tuple[float, float] | None = None,
    view: str = "n",
) -> DataFrame:
    """Gini and KS over time, by applications or (``view`` "m") by amount.

    ``moving``: one result per month ``start..end`` from the ``months`` cohorts
    ending there, which reach back before ``start``.  Otherwise consecutive
    blocks of ``months`` cohorts counted from the first month, each named by
    its last month.  A horizon is reported only for
    windows whose youngest cohort is old enough for it.  ``limits`` (low,
    high) adds a status column for the first horizon.
    """
    return _evol(
        df, cfg, {score: score}, horizons, use, start, end, months, moving, limits, view=view
    ).drop("variable")


def multi_driver_gini(
    df: DataFrame,
    cfg: MonitorConfig,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    horizons: Sequence[int] = (24, 21, 18),
    use: str = "",
    start: int | None = None,
    end: int | None = None,
    months: int = 1,
    moving: bool = False,
    limits: tuple[float, float] | None = None,
    cells: DataFrame | None = None,
    view: str = "n",
) -> DataFrame:
    """Gini and KS over time for many drivers in one job.

    A numeric driver is its own score.  A categorical one is ordered by the
    default rate (of the same view) of its labels over all months taken in; stored driver cells
    of the calibration (``cells``) save reading the base for them.
    """
    if cells is None and categorical:
        hits = {f"d{k}": cfg.defaulted(k) for k in horizons}
        kept = [cfg.month, *[t.alias(name) for name, t in hits.items()]]
        sums = [F.count(F.lit(1)).alias("n"), *[F.sum(name).alias(f"{name}_n") for name in hits]]
        if weight_of(view) == "m":
            none = F.lit(0).cast(MONEY)
            kept.append(F.coalesce(money(cfg.amount), none).alias("m"))
            sums += [F.sum("m").alias("m")]
            sums += [F.sum(F.when(F.col(name) == 1, F.col("m")).otherwise(none)).alias(f"{name}_m") for name in hits]
        cells = (
            unpivot_drivers(cfg.select_universe(df, use), categorical, kept)
            .groupBy("variable", "bucket", cfg.month).agg(*sums)
        )
    return _evol(
        df, cfg, {v: v for v in numeric}, horizons, use, start, end, months, moving, limits, cells, view
    )


def _evol(df, cfg, numeric, horizons, use, start, end, months, moving, limits, cells=None, view="n"):
    base = _in_months(cfg.select_universe(df, use), cfg, _oldest(start, months, moving), end)
    counts = driver_counts(base, cfg, numeric, horizons, view) if numeric else None
    return gini_from_counts(counts, cfg, horizons, start, end, months, moving, limits, cells, view)


def _oldest(start: int | None, months: int, moving: bool) -> int | None:
    return shift_yyyymm(start, 1 - months) if moving and start is not None else start


def driver_counts(
    df: DataFrame, cfg: MonitorConfig, numeric: Mapping[str, str], horizons: Sequence[int], view: str = "n"
) -> DataFrame:
    """Score counts per (variable, month) of numeric drivers, name -> column: all in one pass."""
    slim = [F.col(cfg.month), *[cfg.defaulted(k).alias(str(k)) for k in horizons]]
    amount = None
    if weight_of(view) == "m":
        slim.append(F.col(cfg.amount).alias("_amount"))
        amount = F.col("_amount")
    pairs = ", ".join(f"'{v}', CAST(`{c}` AS DOUBLE)" for v, c in numeric.items())
    long = df.select(*slim, F.expr(f"stack({len(numeric)}, {pairs}) AS (variable, value)"))
    return score_counts(long, ["variable", cfg.month], "value", {str(k): F.col(str(k)) for k in horizons}, amount)


def gini_from_counts(
    counts: DataFrame | None,
    cfg: MonitorConfig,
    horizons: Sequence[int] = (24, 21, 18),
    start: int | None = None,
    end: int | None = None,
    months: int = 1,
    moving: bool = False,
    limits: tuple[float, float] | None = None,
    cells: DataFrame | None = None,
    view: str = "n",
) -> DataFrame:
    """Gini and KS over time from stored ``driver_counts``, driver cells, or both."""
    w = weight_of(view)
    names, oldest = [str(k) for k in horizons], _oldest(start, months, moving)
    measures, parts = list(dict.fromkeys(["n", w])), []
    if counts is not None:
        counts = counts.select("variable", cfg.month, "score", *measures, *names)
        parts.append(_in_months(counts, cfg, oldest, end))
    if cells is not None:
        labelled = _in_months(cells, cfg, oldest, end).filter("bucket IS NOT NULL").select(
            "variable", cfg.month, "bucket", *measures, *[F.col(f"d{t}_{w}").alias(t) for t in names]
        )
        label = Window.partitionBy("variable", "bucket")
        default_rate = rate(F.sum(names[0]).over(label), F.sum(w).over(label))
        # Labels of equal rate are one score.
        parts.append(
            labelled.withColumn("score", default_rate).filter("score IS NOT NULL")
            .groupBy("variable", cfg.month, "score").agg(*[F.sum(c).alias(c) for c in (*measures, *names)])
        )
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    result = gini_ks(
        counts, ["variable", "window_end"], names, ["variable"],
        lambda rows: _to_windows(rows, cfg, start, end, months, moving), weight=w,
    )
    age = F.lit(cfg.closed_index + cfg.target) - (
        F.floor(F.col("window_end") / 100) * 12 + F.col("window_end") % 100 - 1
    )
    out = result.select(
        "variable", F.col("window_end").alias(cfg.month), "n", *(["amount"] if w == "m" else []),
        *[
            F.when(age >= k, F.col(f"{s}_{k}")).alias(f"{s}{k}")
            for k in horizons for s in ("gini", "ks")
        ],
    )
    if limits:
        g = F.col(f"gini{horizons[0]}")
        out = out.withColumn(
            "status",
            F.when(g >= limits[1], "green").when(g >= limits[0], "amber").when(g < limits[0], "red"),
        )
    return out


def _to_windows(counts, cfg, start, end, months, moving) -> DataFrame:
    """Move score counts from single months to the windows they belong to.

    Rows are copied, not merged: equal scores of one window stay apart by
    month, which saves aggregating the copies.
    """
    idx = F.floor(F.col(cfg.month) / 100) * 12 + F.col(cfg.month) % 100 - 1
    if months == 1:
        return counts.withColumnRenamed(cfg.month, "window_end")
    if moving:
        ends = F.explode(F.sequence(idx, idx + F.lit(months - 1)))
        spread = counts.withColumn("end_idx", ends)
        if end is None:
            raise ValueError("moving windows need the last month")
        spread = spread.filter(F.col("end_idx") <= index_of(end))
        if start is not None:
            spread = spread.filter(F.col("end_idx") >= index_of(start))
    else:
        if start is None:
            raise ValueError("blocks need the first month")
        first = F.lit(index_of(start))
        spread = counts.withColumn(
            "end_idx", first + F.floor((idx - first) / months) * months + F.lit(months - 1)
        )
        if end is not None:
            spread = spread.withColumn("end_idx", F.least("end_idx", F.lit(index_of(end))))
    return spread.withColumn("window_end", month_from_index("end_idx")).drop("end_idx", cfg.month)


def discrimination_table(
    df: DataFrame,
    cfg: MonitorConfig,
    variables: Sequence[str],
    start: int,
    end: int,
    months: int = 3,
    moving: bool = False,
    target: int = 24,
    measure: str = "gini",
    use: str = "",
    categorical: Sequence[str] = (),
    view: str = "n",
) -> DataFrame:
    """Variables by period, one column ``p<yyyymm>`` per window end."""
    lo, hi = index_of(start), index_of(end)
    if moving:
        ends = range(lo, hi + 1)
    else:
        ends = [min(e, hi) for e in range(lo + months - 1, hi + months, months)]
    periods = [yyyymm_of(i) for i in ends]
    long = multi_driver_gini(
        df, cfg, variables, categorical, (target,), use, start, end, months, moving, view=view
    )
    return by_period(long, cfg.month, periods, f"{measure}{target}")


def by_period(long: DataFrame, month: str, periods: Sequence[int], measure: str) -> DataFrame:
    """Long results as variables by period, one column ``p<yyyymm>`` per period."""
    pivot = long.groupBy("variable").pivot(month, list(periods)).agg(F.first(measure))
    return pivot.select("variable", *[F.col(str(p)).alias(f"p{p}") for p in periods])
