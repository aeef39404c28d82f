from __future__ import annotations

import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from scoremon.operators import quantiles as q


def disc(values, p):
    s = sorted(values)
    return s[min(max(ceil(p * len(s)), 1), len(s)) - 1]


@pytest.mark.parametrize(
    "make",
    [
        lambda r: [r.gauss(0, 1) for _ in range(4000)],
        lambda r: [float(r.randrange(7)) for _ in range(3000)],
        lambda r: [0.0] * 2500 + [r.random() * 1e-9 for _ in range(1500)],
        lambda r: [1.0],
        lambda r: [5.0, 5.0, 5.0],
        lambda r: [10.0 ** r.randrange(-9, 9) for _ in range(2000)],
        lambda r: [float(i) for i in range(1001)],
    ],
)
@pytest.mark.parametrize("error", [0.2, 0.01])
def test_exact_cuts_match_sorting(spark, make, error):
    values = make(random.Random(7))
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x DOUBLE")
    probs = (0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    lowest, edges = q.exact_cuts(df, ["x"], probs=probs, relative_error=error)["x"]
    assert lowest == min(values)
    assert edges == [disc(values, p) for p in probs]


def test_approximate_rank_error_is_bounded(spark):
    df = spark.range(20_000).withColumn("x", F.rand(3))
    cuts = q.approx_cuts(df, ["x"], relative_error=0.01)["x"].edges
    for p, cut in zip(q.QUARTILES, cuts):
        assert abs(df.filter(F.col("x") <= cut).count() / 20_000 - p) <= 0.011


def test_labels_from_window_applied_to_all_rows(spark):
    df = spark.createDataFrame([(i, float(i), i <= 8) for i in range(0, 13)], "i INT, x DOUBLE, w BOOLEAN")
    df = df.unionByName(spark.createDataFrame([(99, None, True)], "i INT, x DOUBLE, w BOOLEAN"))
    got = {r.i: r.x_q for r in q.quantile_buckets(df, ["x"], "w AND i >= 1", exact=True).collect()}
    assert got[0] == got[2] == "1. 0.000 - 2.000"
    assert got[3] == "2. 2.000 - 4.000" and got[8] == "4. 6.000 - 8.000"
    assert got[9] == got[12] == got[99] == "98. Missing"


def test_empty_window_labels_everything_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x DOUBLE")
    for exact in (True, False):
        out = q.quantile_buckets(df, ["x"], "x > 10", exact=exact)
        assert [r.x_q for r in out.collect()] == ["98. Missing"] * 2


def test_text_column_is_rejected(spark):
    df = spark.createDataFrame([("a",)], "x STRING")
    with pytest.raises(TypeError):
        q.quantile_buckets(df, ["x"])


def test_ranks_take_probabilities_as_written(spark):
    assert q.wanted_rank(0.55, 100) == 55 and q.wanted_rank(0.99, 10) == 10 and q.wanted_rank(0.0, 5) == 1
    df = spark.range(1, 101).selectExpr("CAST(id AS DOUBLE) AS x")
    assert q.exact_cuts(df, ["x"], probs=(0.55, 0.07, 0.29))["x"].edges == [55.0, 7.0, 29.0]
    cuts = {"x": q.Cuts(1.0, [55.0, 60.0])}
    assert [r.within_bound for r in q.rank_check(df, cuts, "", (0.55, 0.55), 0.01).orderBy("cut").collect()] == [True, False]
