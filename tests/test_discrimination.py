from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.operators import discrimination as ds
from scoremon.sources.tables import store

CFG = MonitorConfig(closed_month=202412)


def brute(pairs):
    """Gini and KS by definition: all pairs, all thresholds."""
    bad = [s for s, b in pairs if b]
    good = [s for s, b in pairs if not b]
    if not bad or not good:
        return None, None
    won = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    ks = max(
        abs(sum(b <= t for b in bad) / len(bad) - sum(g <= t for g in good) / len(good)) for t, _ in pairs
    )
    return 2 * won / (len(bad) * len(good)) - 1, ks


def frame(spark, rows):
    return spark.createDataFrame(rows, "codmes INT, score DOUBLE, dist_def INT")


@pytest.mark.parametrize("levels", [3, 40, 100_000])
def test_gini_and_ks_against_brute_force(spark, levels):
    r = random.Random(levels)
    rows = []
    for i in range(900):
        s = r.randrange(levels) / levels
        # A third of all rows in one month.
        m = 202001 if i % 3 == 0 else 202002 + r.randrange(3)
        rows.append((m, s, 5 if r.random() < 0.2 + 0.5 * s else None))
    got = {x.codmes: x for x in ds.evol_gini(frame(spark, rows), CFG, "score", (24,)).collect()}
    for m in {x[0] for x in rows}:
        gini, ks = brute([(s, d is not None) for mm, s, d in rows if mm == m])
        assert got[m].gini24 == pytest.approx(gini, abs=1e-12)
        assert got[m].ks24 == pytest.approx(ks, abs=1e-12)


def test_moving_and_block_windows(spark):
    r = random.Random(1)
    months = [202301 + k for k in range(12)]
    rows = [(r.choice(months), r.random(), 3 if r.random() < 0.3 else None) for _ in range(600)]
    df = frame(spark, rows)
    moving = {x.codmes: x for x in ds.evol_gini(
        df, CFG, "score", (24,), start=202304, end=202312, months=4, moving=True).collect()}
    assert sorted(moving) == months[3:]
    blocks = {x.codmes: x for x in ds.evol_gini(
        df, CFG, "score", (24,), start=202301, end=202312, months=5).collect()}
    assert sorted(blocks) == [202305, 202310, 202312]
    for got, width in ((moving, 4), (blocks, 5)):
        for end, x in got.items():
            lo = end - width + 1 if end != 202312 or width == 4 else 202311
            gini, ks = brute([(s, d is not None) for m, s, d in rows if lo <= m <= end])
            assert x.gini24 == pytest.approx(gini, abs=1e-12) and x.ks24 == pytest.approx(ks, abs=1e-12)


def test_invariants(spark):
    r = random.Random(5)
    rows = [(202001, r.random(), 1 if i % 4 == 0 else None) for i in range(200)]
    base = frame(spark, rows)
    gini = ds.evol_gini(base, CFG, "score", (24,)).first().gini24
    flipped = ds.evol_gini(base.withColumn("score", -F.col("score")), CFG, "score", (24,)).first().gini24
    assert flipped == pytest.approx(-gini)
    perfect = base.withColumn("score", F.when(F.col("dist_def").isNotNull(), 1.0).otherwise(0.0))
    assert ds.evol_gini(perfect, CFG, "score", (24,)).first().gini24 == pytest.approx(1.0)
    tied = base.withColumn("score", F.lit(2.0))
    row = ds.evol_gini(tied, CFG, "score", (24,)).first()
    assert row.gini24 == pytest.approx(0.0) and row.ks24 == pytest.approx(0.0)


def test_one_class_months_null_and_nan_scores(spark):
    rows = [(202001, 0.1, None), (202001, 0.2, None), (202002, 0.1, 1), (202003, None, 1), (202003, float("nan"), None),
            (202003, 0.3, 1), (202003, 0.1, None)]
    got = {x.codmes: x for x in ds.evol_gini(frame(spark, rows), CFG, "score", (24,)).collect()}
    assert got[202001].gini24 is None and got[202002].ks24 is None
    assert got[202003].n == 2 and got[202003].gini24 == pytest.approx(1.0)


def test_young_cohorts_have_no_result_for_long_horizons(spark):
    cfg = MonitorConfig(closed_month=202001)
    rows = [(m, s, d) for m in (202001, 202004, 202007, 202008) for s, d in ((0.1, None), (0.9, 2))]
    got = {x.codmes: x for x in ds.evol_gini(frame(spark, rows), cfg, "score", (24, 21, 18)).collect()}
    assert [got[202004].gini24, got[202004].gini21, got[202004].gini18] == [None, 1.0, 1.0]
    assert got[202007].gini21 is None and got[202007].gini18 == 1.0 and got[202008].gini18 is None


def test_categorical_driver_is_ranked_by_its_default_rate(spark):
    rows = [(202001, "b", 1)] * 6 + [(202001, "b", None)] * 2 + [(202001, "a", None)] * 9 + [(202001, "a", 1)] * 3
    df = spark.createDataFrame(rows, "codmes INT, label STRING, dist_def INT")
    got = ds.multi_driver_gini(df, CFG, [], ["label"], (24,)).first()
    gini, ks = brute([(6 / 8 if x == "b" else 3 / 12, d is not None) for _, x, d in rows])
    assert got.gini24 == pytest.approx(gini) and got.ks24 == pytest.approx(ks)


def test_table_has_one_column_per_block(spark):
    rows = [(202201 + k, 0.1 * k, 2 if k % 2 else None) for k in range(11)] * 3
    out = ds.discrimination_table(frame(spark, rows), CFG, ["score"], 202201, 202211, 3)
    assert out.columns == ["variable", "p202203", "p202206", "p202209", "p202211"]
    assert out.count() == 1


def test_no_task_sees_a_whole_hot_month(spark):
    """One month with all rows is still spread over the ranges, with one exchange of score rows."""
    df = spark.range(20_000).select(
        F.lit(202001).alias("codmes"), F.rand(1).alias("score"), (F.col("id") % 3).cast("int").alias("bad"))
    counts = store(ds.score_counts(df, ["codmes"], "score", {"t": F.col("bad")}), "counts")
    out = ds.gini_ks(counts, ["codmes"], ["t"], ranges=16)
    assert out.first().n == 20_000
    cuts = counts.agg(F.percentile_approx("score", [i / 16 for i in range(1, 16)], F.lit(1000)).alias("c")).first().c
    sizes = counts.groupBy(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("score")))).count()
    assert sizes.count() == 16 and sizes.agg(F.max("count")).first()[0] < 1.5 * 20_000 / 16
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "rangepartitioning" not in plan


def brute_amount(rows):
    """Gini and KS of (score, bad, amount) by definition, in exact numbers."""
    from fractions import Fraction

    bad = [(s, Fraction(str(a or 0))) for s, b, a in rows if b]
    good = [(s, Fraction(str(a or 0))) for s, b, a in rows if not b]
    b_all, g_all = sum(a for _, a in bad), sum(a for _, a in good)
    if not b_all or not g_all:
        return None, None
    won = sum(x * y * (Fraction(1) if b > g else Fraction(1, 2) if b == g else 0) for b, x in bad for g, y in good)
    ks = max(abs(sum(x for b, x in bad if b <= t) / b_all - sum(y for g, y in good if g <= t) / g_all) for t, _, _ in rows)
    return float(2 * won / (b_all * g_all) - 1), float(ks)


@pytest.mark.parametrize("ranges", [None, 8, 4096])
@pytest.mark.parametrize("levels", [3, 5000])
def test_amount_view_against_brute_force(spark, levels, ranges, monkeypatch):
    cut = ds.score_ranges
    monkeypatch.setattr(ds, "score_ranges", lambda counts, by=(), n=None: cut(counts, by, ranges))
    r = random.Random(levels)
    rows = []
    for i in range(500):
        s = r.randrange(levels) / levels
        m = 202001 if i % 3 == 0 else 202002 + r.randrange(2)
        amount = None if i % 50 == 7 else round(r.random() * 1e6, 2)
        rows.append((m, s, 5 if r.random() < 0.2 + 0.5 * s else None, amount))
    df = spark.createDataFrame(rows, "codmes INT, score DOUBLE, dist_def INT, amount DOUBLE")
    got = {x.codmes: x for x in ds.evol_gini(df, CFG, "score", (24,), view="m").collect()}
    for m in {x[0] for x in rows}:
        mine = [(s, d is not None, a) for mm, s, d, a in rows if mm == m]
        gini, ks = brute_amount(mine)
        assert got[m].gini24 == pytest.approx(gini, abs=1e-12) and got[m].ks24 == pytest.approx(ks, abs=1e-12)
        assert got[m].n == len(mine) and got[m].amount == pytest.approx(sum(a or 0 for _, _, a in mine))


def test_equal_amounts_give_the_view_by_applications(spark):
    r = random.Random(3)
    rows = [(202001 + i % 4, r.randrange(30) / 30, 4 if r.random() < 0.3 else None, 250.0) for i in range(400)]
    df = spark.createDataFrame(rows, "codmes INT, score DOUBLE, dist_def INT, amount DOUBLE")
    for windows in ({}, {"start": 202002, "end": 202004, "months": 2, "moving": True}):
        by = {v: {x.codmes: x for x in ds.evol_gini(df, CFG, "score", (24,), view=v, **windows).collect()} for v in "nm"}
        assert by["n"].keys() == by["m"].keys()
        for m, x in by["n"].items():
            assert by["m"][m].gini24 == pytest.approx(x.gini24) and by["m"][m].ks24 == pytest.approx(x.ks24)


def test_amounts_that_doubles_would_round(spark):
    # One giant and many cents: a double sum loses them, a decimal one does not.
    rows = [(202001, 0.5, None, 9e13)] + [(202001, 0.1 + 0.001 * i, 3, 0.01) for i in range(300)] + [(202001, 0.9, None, 0.01)]
    df = spark.createDataFrame(rows, "codmes INT, score DOUBLE, dist_def INT, amount DOUBLE")
    got = ds.evol_gini(df.repartition(7), CFG, "score", (24,), view="m").first()
    gini, ks = brute_amount([(s, d is not None, a) for _, s, d, a in rows])
    assert got.gini24 == pytest.approx(gini, abs=1e-12) and got.ks24 == pytest.approx(ks, abs=1e-12)


def test_months_without_money_or_without_defaults_have_no_amount_view(spark):
    rows = [(202001, 0.1, 1, 0.0), (202001, 0.2, None, 5.0), (202002, 0.3, None, 5.0), (202003, 0.1, 1, None), (202003, 0.1, None, None)]
    df = spark.createDataFrame(rows, "codmes INT, score DOUBLE, dist_def INT, amount DOUBLE")
    got = ds.evol_gini(df, CFG, "score", (24,), view="m").collect()
    assert len(got) == 3 and all(x.gini24 is None and x.ks24 is None for x in got)


def test_categorical_driver_by_amount(spark):
    rows = [(202001, "b", 1, 10.0), (202001, "b", None, 90.0), (202001, "a", 1, 60.0), (202001, "a", None, 40.0), (202001, None, 1, 5.0)]
    df = spark.createDataFrame(rows, "codmes INT, label STRING, dist_def INT, amount DOUBLE")
    got = ds.multi_driver_gini(df, CFG, [], ["label"], (24,), view="m").first()
    gini, ks = brute_amount([({"b": 0.1, "a": 0.6}[x], d is not None, a) for _, x, d, a in rows if x])
    assert got.gini24 == pytest.approx(gini) and got.ks24 == pytest.approx(ks)
    table = ds.discrimination_table(df, CFG, [], 202001, 202001, 1, categorical=["label"], view="m")
    assert table.first().p202001 == pytest.approx(gini)


def test_ranges_grow_with_the_scores(spark):
    counts = spark.range(0, 40_000, 1, 4).select(F.lit("v").alias("variable"), (F.col("id") / 7).alias("score"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "4k")
    try:
        many = ds.score_ranges(counts, ["variable"]).select("part").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    few = ds.score_ranges(counts.limit(100), ["variable"]).select("part").distinct().count()
    assert few == 1 < many
