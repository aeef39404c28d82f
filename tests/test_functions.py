from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoremon.functions import buckets as bk
from scoremon.functions import months as mo
from scoremon.functions import scores as sc
from scoremon.plans import fixed_values as fx


@settings(max_examples=200, deadline=None)
@given(st.integers(1990, 2060), st.integers(1, 12), st.integers(-400, 400))
def test_shift_is_invertible(year, month, k):
    m = year * 100 + month
    shifted = mo.shift_yyyymm(m, k)
    assert 1 <= shifted % 100 <= 12
    assert mo.shift_yyyymm(shifted, -k) == m
    assert mo.index_of(shifted) - mo.index_of(m) == k


def test_shift_column_matches_scalar(spark):
    rows = [(m,) for m in mo.month_range(199911, 200202)]
    df = spark.createDataFrame(rows, "codmes INT")
    out = df.select("codmes", *[mo.shift_month("codmes", k).alias(f"k{k + 30}") for k in (-25, -1, 0, 1, 12, 25)]).collect()
    for r in out:
        for k in (-25, -1, 0, 1, 12, 25):
            assert r[f"k{k + 30}"] == mo.shift_yyyymm(r.codmes, k)


def test_lag_and_lead_columns_across_december(spark):
    df = spark.createDataFrame([(200001,), (199912,)], "codmes INT")
    out = {r.codmes: r for r in mo.with_lead_months(mo.with_lagged_months(df, 2), 1).collect()}
    assert (out[200001].codmes_0, out[200001].codmes_1, out[200001].codmes_2) == (200001, 199912, 199911)
    assert (out[199912].codmes_f0, out[199912].codmes_f1) == (199912, 200001)


def test_spine_fills_gaps_and_is_empty_for_no_rows(spark):
    df = spark.createDataFrame([(199911,), (200002,)], "codmes INT")
    assert sorted(r.codmes for r in mo.month_spine(df).collect()) == [199911, 199912, 200001, 200002]
    assert mo.month_spine(df.filter("codmes > 300000")).count() == 0


def _labels(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, x DOUBLE")
    return [r.b for r in df.orderBy("i").select(column.alias("b")).collect()]


def test_edges_right_open_and_right_closed(spark):
    edges, labels = (1, 2), ("a", "b", "c")
    values = [0.5, 1.0, 1.5, 2.0, 3.0, None, float("nan"), math.inf, -math.inf]
    assert _labels(spark, bk.bucket_right_open("x", edges, labels), values) == [
        "a", "b", "b", "c", "c", "99. Missing", "99. Missing", "c", "a"]
    assert _labels(spark, bk.bucket_right_closed("x", edges, labels), values) == [
        "a", "a", "b", "b", "c", "99. Missing", "99. Missing", "c", "a"]


def test_bucket_rejects_bad_edges():
    with pytest.raises(ValueError):
        bk.bucket_right_open("x", (1, 2), ("a", "b"))
    with pytest.raises(ValueError):
        bk.bucket_right_open("x", (2, 1), ("a", "b", "c"))


def test_first_matching_band_wins(spark):
    values = [0.643, 0.65, 0.679, 0.801, 0.85, 0.9, None, float("nan")]
    assert _labels(spark, bk.ordered_bands("x", fx.LTV_BANDS), values) == [
        "1. 0.643 - 0.643", "2. 0.643 - 0.679", "3. 0.679 - 0.801", "3. 0.679 - 0.801",
        "4. 0.801 - 0.888", "99. Out of Range", "98. Missing", "98. Missing"]
    assert _labels(spark, bk.ordered_bands("x", fx.SPOUSE_INCOME_BANDS), [0.0, 1.0, 7929.53, 1e9, -1.0]) == [
        "0. Sin conyuge", "1. 0.000 - 7929.530", "1. 0.000 - 7929.530", "4. 17434.000 - 82...", "99. Out of Range"]
    assert _labels(spark, bk.ordered_bands("x", fx.TERM_BANDS), [4.9, 5.0, 9.5, 14.0, 35.0, 32.0]) == [
        "1. Menor a 4 años", "2. De 5 a 9 años", "99. Out of Range", "3. De 10 a 14 años",
        "8. 35 años o más", "99. Out of Range"]


def test_recode_policies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i INT, c STRING")
    out = df.orderBy("i").select(
        bk.recode("c", {"a": "A"}).alias("null"),
        bk.recode("c", {"a": "A"}, default=bk.SELF).alias("keep"),
        bk.recode("c", {"a": "A"}, default="z").alias("const"),
        bk.recode("c", {"a": "A"}, default="z", missing="m").alias("miss"),
    ).collect()
    assert [tuple(r) for r in out] == [("A", "A", "A", "A"), (None, "b", "z", "z"), (None, None, "z", "m")]


def test_flags_treat_null_as_zero(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x DOUBLE")
    assert sorted(r[0] for r in df.select(bk.flag(F.col("x") >= 1)).collect()) == [0, 1]


def test_purpose_flag(spark):
    rows = [(None, 202301), ("p", 202301), ("late", 202306), ("late", 202307), ("x", 202401)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, purpose STRING, codmes INT")
    f = bk.purpose_flag("purpose", "codmes", ["p"], {"late": 202307})
    assert [r[0] for r in df.orderBy("i").select(f).collect()] == [1, 1, 0, 1, 0]


def test_score_transforms(spark):
    df = spark.createDataFrame([(174.25, 1111111111.0), (174.25 - 57.708, 5.0), (None, None)], "score DOUBLE, d DOUBLE")
    out = df.select(
        sc.logit_to_pd(sc.score_to_logit("score")).alias("pd"), sc.null_sentinels("d").alias("d"),
        sc.null_safe_sum("score", "d").alias("s"),
    ).collect()
    assert out[0].pd == pytest.approx(0.5) and out[0].d is None
    assert out[1].pd == pytest.approx(1 / (1 + math.exp(-1))) and out[1].d == 5.0
    assert out[2].pd is None and out[2].s == 0


def test_zone_rules_have_one_outcome_per_key():
    for rules in (fx.ZONE_RISK_RULES, fx.ZONE_RISK_RULES_2):
        keys = [(a, p) for a, p, _ in rules]
        assert len(keys) == len(set(keys))
