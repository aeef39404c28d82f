from __future__ import annotations

from collections import defaultdict

import pytest

from scoremon.config import MonitorConfig, product_universe, where
from scoremon.operators import enrich, quality
from scoremon.plans import fixed_values as fx
from scoremon.sources.tables import label_table


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_blank_predicate_keeps_everything(spark):
    df = spark.createDataFrame([(1,), (2,)], "x INT")
    assert where(df, "  ").count() == 2 and where(df, None).count() == 2 and where(df, "x > 1").count() == 1


def test_excluded_values_drop_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i INT, p STRING")
    assert rows(product_universe(df, excluded={"p": ["b"]}), "i") == [(1,)]


def test_left_enrich_keeps_rows_and_replaces_columns(spark):
    base = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (None, 13)], "k INT, age INT")
    ext = spark.createDataFrame([(1, 5, 1.0), (1, 5, 1.0), (3, 7, 2.0)], "k INT, a INT, v DOUBLE")
    out = enrich.left_enrich(base, ext, ["k"], {"a": "age", "v": "v"})
    assert out.columns == ["k", "age", "v"]
    assert rows(out, "k", "age", "v") == sorted([(1, 5, 1.0), (1, 5, 1.0), (2, None, None), (None, None, None)], key=repr)
    assert enrich.left_enrich(base, ext, ["k"], ["v"], distinct=False).count() == 6


def test_latest_per_key_keeps_ties_and_filters_first(spark):
    log = spark.createDataFrame(
        [("a", 1, "t"), ("a", 2, "t"), ("a", 2, "t"), ("a", 3, "x"), ("b", 1, "t"), ("b", None, "t")],
        "k STRING, d INT, role STRING",
    )
    assert rows(enrich.latest_per_key(log, "k", "d", "role = 't'"), "k", "d") == [("a", 2), ("a", 2), ("b", 1)]


def test_forward_panel_matches_brute_force_with_duplicates(spark):
    data = [("a", m, v) for m, v in ((0, 5), (1, 6), (1, 7), (2, 8), (4, 9))] + [("b", 0, 1), ("b", 3, 4), ("c", 11, 2)]
    panel = spark.createDataFrame([(k, 24000 + m, v) for k, m, v in data], "id STRING, month_idx INT, late INT")
    out = enrich.forward_panel(panel, "id", "late", 200001, 200012)
    by = defaultdict(list)
    for k, m, v in data:
        by[k, m].append(v)
    want = [
        (k, 24000 + m, v, x, y, z)
        for k, m, v in data
        for x in by.get((k, m + 1), [0]) for y in by.get((k, m + 2), [0]) for z in by.get((k, m + 3), [0])
    ]
    assert rows(out, "id", "month_idx", "late", "late_f1", "late_f2", "late_f3") == sorted(want, key=repr)


@pytest.mark.parametrize(
    "rules, unknown, cases",
    [
        (fx.ZONE_RISK_RULES, None, [
            ("ICA", "X", "ALTO"), ("ICA", None, "ALTO"), ("LIMA", "ATE-LIMA", "ALTO"), ("LIMA", "SURQUILLO-LIMA", "BAJO"),
            (None, None, "BAJO"), ("CALLAO", "VENTANILLA-CALLAO", "ALTO")]),
        (fx.ZONE_RISK_RULES_2, fx.ZONE_RISK_UNKNOWN, [
            ("LIMA", "LURIN-LIMA", "ALTO"), ("LIMA", None, "ND"), ("", "X", "ND"), ("ICA", "ICA", "BAJO"),
            ("CALLAO", "VENTANILLA-LIMA", "ALTO"), (None, "X", "ND")]),
    ],
)
def test_zone_risk_lookup(spark, rules, unknown, cases):
    table = label_table(spark, rules, ["area", "place", "risk"])
    base = spark.createDataFrame([(i, a, p) for i, (a, p, _) in enumerate(cases)], "i INT, area STRING, place STRING")
    out = enrich.rule_lookup(base, table, "area", "place", "risk", fx.ZONE_RISK_DEFAULT, unknown)
    assert [r.risk for r in out.orderBy("i").collect()] == [c[2] for c in cases]


def test_union_parts_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x INT, y INT")
    b = spark.createDataFrame([(3,)], "x INT")
    assert rows(enrich.union_parts([a, b], allow_missing=True), "x", "y") == [(1, 2), (3, None)]


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([(1, None, None), (1, 2.0, None), (2, None, 3)], "m INT, a DOUBLE, b INT")
    assert rows(quality.missing_by(df, ["m"], {"a": ["a"], "ab": ["a", "b"]}), "m", "a", "ab", "n") == [(1, 1, 1, 2), (2, 1, 0, 1)]
    assert rows(quality.duplicate_keys(df, ["m"]), "m", "count") == [(1, 2)]


def test_profile(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (None, "a")], "x INT, s STRING")
    assert rows(quality.table_profile(df), "column_name", "n", "n_columns", "nulls", "min", "max") == [
        ("s", 3, 2, 1, "a", "b"), ("x", 3, 2, 1, "1", "2")]


def test_reconcile_by_join_equals_single_pass(spark):
    from scoremon.operators.calibration import monthly_calibration

    cfg = MonitorConfig(closed_month=200012)
    data = [(199901 + i % 3, 100.0 + i, 0.01 * i, i % 30 if i % 2 else None, i % 4) for i in range(60)]
    df = spark.createDataFrame(data, "codmes INT, amount DOUBLE, pd DOUBLE, dist_def INT, g INT")
    one = quality.reconcile_universes(df, cfg, "g = 0", "g < 3")
    columns = ["n", "amount_mm", "pd_mean", "rd24", "rd18", "def24"]
    two = quality.reconcile(
        monthly_calibration(df.filter("g = 0"), cfg), monthly_calibration(df.filter("g < 3"), cfg), "codmes", columns)
    names = ["codmes", *[f"dif_{c}" for c in columns]]
    assert [tuple(map(float, r)) for r in rows(one, *names)] == [tuple(map(float, r)) for r in rows(two, *names)]


def test_table_diff(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 3.0, "z")], "k INT, v DOUBLE, s STRING")
    b = spark.createDataFrame([(1, 1.5, "x", 1), (2, None, "q", 1), (9, 3.0, "z", 1)], "k INT, v DOUBLE, s STRING, extra INT")
    out = quality.table_diff(a, b, ["k"])
    assert rows(out, "column_name", "present", "mismatches", "matched", "left_only", "right_only") == sorted(
        [("v", "both", 1, 2, 1, 1), ("s", "both", 1, 2, 1, 1), ("extra", "right_only", None, 2, 1, 1)], key=repr)
    assert quality.column_diff(a, b) == {"left_only": [], "right_only": ["extra"]}


def test_table_diff_compares_repeated_keys_as_multisets(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0), (2, 5.0), (3, 1.0)], "k INT, v DOUBLE")
    b = spark.createDataFrame([(1, 2.0), (1, 1.0), (2, 5.0), (3, 1.0), (3, None)], "k INT, v DOUBLE")
    got = quality.table_diff(a, b, ["k"]).first()
    # Key 1 agrees in any order; key 2 differs in number, key 3 by an extra row.
    assert (got.mismatches, got.matched, got.left_repeated, got.right_repeated) == (2, 3, 2, 2)
