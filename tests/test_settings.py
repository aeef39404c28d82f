from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.functions.months import index_of, month_range
from scoremon.operators import calibration as cal
from scoremon.operators import settings as st

CFG = MonitorConfig(closed_month=202301, pds=())
CLOSED = index_of(202301)


@pytest.fixture(scope="module")
def book(spark):
    r = random.Random(5)
    rows = []
    for m in month_range(202101, 202412):
        for i in range(50):
            rows.append((m, 100.0 + i, r.randrange(1, 30) if r.random() < 0.6 else None, "AB"[i % 2]))
    df = spark.createDataFrame(rows, "codmes INT, amount DOUBLE, dist_def INT, segment STRING")
    sums = cal.cohort_sums(df, CFG, st.horizons(CFG), ("segment",), early=True).cache()
    return rows, sums


def total(rows, m, view, segment=None, k=None):
    part = [r for r in rows if index_of(r[0]) == m and segment in (None, r[3])]
    return sum((1 if view == "n" else r[1]) for r in part if k is None or (r[2] is not None and r[2] <= k))


def by_hand(rows, segment, view, target, method, depth, width):
    closed, goal, usable = (CLOSED, 24, {j: h for j, h in CFG.usable.items() if j <= 6}) if target == "def" else (CLOSED + 21, 3, {1: 2, 2: 1})
    rate = {}
    for j, h in usable.items():
        past = np.arange(closed - depth + 1, closed + 1)
        past = np.array([m for m in past if total(rows, m, view, segment, h) > 0])
        ratio = np.array([total(rows, m, view, segment, goal) / total(rows, m, view, segment, h) for m in past])
        high, mid = np.quantile(ratio, [0.75, 0.5])
        factor = {"met1": high, "met2": (high + mid) / 2}.get(method)
        if factor is None:
            slope, start = np.polyfit(past, ratio, 1)
            factor = start + slope * (closed + j)
        rate[closed + j] = total(rows, closed + j, view, segment, h) / total(rows, closed + j, view, segment) * factor
    near = lambda m: [rate[t] for t in range(m - width // 2, m + (width - 1) // 2 + 1) if t in rate]
    return {m: float(np.mean(near(m))) for m in rate}


ROWS = [
    (None, "n", "def", "met1", 14, 1), (None, "m", "def", "met2", 9, 3), (None, "n", "early", "met3", 12, 1),
    ("B", "n", "def", "met3", 6, 2), ("B", "m", "early", "met2", 20, 1),
]


def test_every_segment_view_and_target_has_its_own_settings(spark, book):
    rows, sums = book
    got = {}
    for r in st.project(sums, CFG, st.table(spark, ROWS), ("segment",)).collect():
        got.setdefault((r.segment, r.view, r.target), {})[index_of(r.codmes)] = r.rd_proj
    chosen = {}
    for segment, view, target, *rest in sorted(ROWS, key=lambda r: r[0] is not None):
        for s in "AB" if segment is None else segment:
            chosen[s, view, target] = rest
    assert got.keys() == chosen.keys()
    for (s, view, target), rest in chosen.items():
        assert got[s, view, target] == pytest.approx(by_hand(rows, s, view, target, *rest)), (s, view, target)


def test_total_and_corrections(spark, book):
    rows, sums = book
    whole = cal.roll_up(sums, (), "codmes")
    settings = st.same_for_all(spark, CFG)
    plain = {(r.codmes, r.view, r.target): r for r in st.project(whole, CFG, settings).collect()}
    assert len(plain) == 2 * (6 + 2)
    want = by_hand(rows, None, "m", "early", "met1", 14, 1)
    assert {index_of(m): r.rd_proj for (m, v, t), r in plain.items() if (v, t) == ("m", "early")} == pytest.approx(want)
    fixes = spark.createDataFrame(
        [(202302, "set", 0.5, None, "def"), (202303, "add", 0.1, "m", None)],
        "codmes INT, op STRING, value DOUBLE, view STRING, target STRING",
    )
    fixed = {(r.codmes, r.view, r.target): r for r in st.project(whole, CFG, settings, (), fixes).collect()}
    assert fixed.keys() == plain.keys()
    for k, r in fixed.items():
        want = 0.5 if k[0] == 202302 and k[2] == "def" else plain[k].rd_proj + (0.1 if k[:2] == (202303, "m") else 0)
        assert r.rd_proj == pytest.approx(want)
        assert not r.rd_usable or r.factor == pytest.approx(want / r.rd_usable)


def test_bad_settings_and_empty_sums(spark, book):
    _, sums = book
    for row in [(None, "x", "def", "met1", 1, 1), (None, "n", "late", "met1", 1, 1), (None, "n", "def", "met9", 1, 1),
                (None, "n", "def", "met1", 0, 1)]:
        with pytest.raises(ValueError):
            st.table(spark, [row])
    assert st.project(sums.limit(0), CFG, st.same_for_all(spark, CFG), ("segment",)).count() == 0
    assert st.project(sums, CFG, st.table(spark, []), ("segment",)).count() == 0


def test_a_group_without_history_has_no_factor(spark, book):
    _, sums = book
    young = sums.filter(F.col("month_idx") > CLOSED)
    rows = st.project(young, CFG, st.same_for_all(spark, CFG), ("segment",)).filter("target = 'def'").collect()
    assert len(rows) == 24 and all(r.factor is None and r.rd_proj is None and r.rd_usable is not None for r in rows)


def test_side_by_side_is_one_row_per_month(spark, book):
    _, sums = book
    projected = st.project(sums, CFG, st.same_for_all(spark, CFG), ("segment",))
    wide = st.side_by_side(projected, CFG, "early", ("segment",))
    assert wide.columns == ["segment", "codmes", "rd_proj_n", "factor_n", "rd_proj_m", "factor_m"] and wide.count() == 4


def test_stored_targets_project_early_delinquency_only_where_its_horizons_are_named():
    stored = CFG.with_(target_prefix="DEF", early="MORA")
    assert [t.name for t in st.targets(CFG)] == ["def", "early"] and [t.name for t in st.targets(stored)] == ["def"]
    named = st.targets(stored.with_(early_usable={1: 2}))
    assert named[1].usable == {1: 2} and st.horizons(stored.with_(early_usable={1: 2}))[0] == 2
