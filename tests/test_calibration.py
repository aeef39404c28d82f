from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.functions.months import index_of, month_range, shift_yyyymm
from scoremon.operators import bands, calibration as cal, cohorts, projection as pj

CFG = MonitorConfig(closed_month=202301, pds=("pd",))


@pytest.fixture(scope="module")
def book(spark):
    r = random.Random(11)
    rows = []
    for m in month_range(202101, 202310):
        for i in range(60):
            pd = r.random() * 0.3
            d = r.randrange(1, 30) if r.random() < 0.5 else None
            rows.append((m, 1000.0 + 10 * i, pd, d, "AB"[i % 2], None if i % 7 == 0 else f"{i % 3}. b"))
    return rows, spark.createDataFrame(
        rows, "codmes INT, amount DOUBLE, pd DOUBLE, dist_def INT, segment STRING, driver STRING").cache()


def hit(d, k):
    return d is not None and d <= k


def rd(rows, m, k, view="n"):
    part = [r for r in rows if r[0] == m]
    w = (lambda r: 1) if view == "n" else (lambda r: r[1])
    return sum(w(r) * hit(r[3], k) for r in part) / sum(w(r) for r in part)


@pytest.mark.parametrize("view", ["n", "m"])
@pytest.mark.parametrize("method", ["met1", "met2", "met3"])
def test_projection_matches_numpy(book, view, method):
    rows, df = book
    got = {r.codmes: r for r in cal.evol_calibration(df, CFG, view, method=method).collect()}
    history = [shift_yyyymm(202301, -k) for k in range(14)]
    for j, h in CFG.usable.items():
        m = shift_yyyymm(202301, j)
        if j > CFG.open_months:
            assert got[m].rd_proj is None
            continue
        ratio = np.array([rd(rows, x, 24, view) / rd(rows, x, h, view) for x in history])
        if method == "met3":
            x = np.array([index_of(v) for v in history])
            slope, start = np.polyfit(x - x.mean(), ratio, 1)
            factor = start + slope * (index_of(m) - x.mean())
        else:
            factor = np.percentile(ratio, 75)
            if method == "met2":
                factor = (factor + np.median(ratio)) / 2
        assert got[m].factor == pytest.approx(factor, rel=1e-9)
        assert got[m].rd_proj == pytest.approx(rd(rows, m, h, view) * factor, rel=1e-9)
        assert got[m].rd24 is None
    assert got[202301].rd24 == pytest.approx(rd(rows, 202301, 24, view))
    assert got[202301].rd_proj is None and got[202301].defaults is not None


def test_every_application_is_counted_once(book):
    rows, df = book
    assert sum(r.n for r in cal.monthly_calibration(df, CFG).collect()) == len(rows)
    factors = df.sparkSession.createDataFrame([(202302, 1.5)], "codmes INT, factor DOUBLE")
    out = cal.multi_driver_calibration(df, CFG, ["segment", "driver"], factors, keep_missing=True)
    for variable in ("segment", "driver"):
        part = [r for r in out.collect() if r.variable == variable]
        assert sum(r.n for r in part) == len(rows) and sum(r.share for r in part) == pytest.approx(1)


def test_missing_labels_are_dropped_or_kept(book):
    _, df = book
    factors = df.sparkSession.createDataFrame([(202302, 1.5)], "codmes INT, factor DOUBLE")
    labelled = df.withColumn("driver", F.coalesce("driver", F.lit("99. Missing")))
    for frame, labels in ((df, {None}), (labelled, {"99. Missing"})):
        kept = {r.driver for r in cal.driver_calibration(frame, CFG, "driver", factors, keep_missing=True).collect()}
        left = {r.driver for r in cal.driver_calibration(frame, CFG, "driver", factors).collect()}
        assert kept - left == labels


def test_small_buckets_are_left_out_by_share(book):
    _, df = book
    factors = df.sparkSession.createDataFrame([(202302, 1.5)], "codmes INT, factor DOUBLE")
    rare = df.withColumn("driver", F.when(F.col("pd") < 0.003, "1. rare").otherwise("2. usual"))
    out = cal.driver_calibration(rare, CFG, "driver", factors, min_share=0.05)
    assert [r.driver for r in out.collect()] == ["2. usual"]


def test_driver_projection_uses_the_month_factor(book):
    rows, df = book
    spark = df.sparkSession
    factors = spark.createDataFrame([(shift_yyyymm(202301, j), 1.0 + j / 10) for j in range(1, 7)], "codmes INT, factor DOUBLE")
    got = {r.driver: r for r in cal.driver_calibration(df, CFG, "driver", factors).collect()}
    for label in ("0. b", "1. b", "2. b"):
        part = [r for r in rows if r[5] == label]
        opened = [(r, j) for r in part for j in [index_of(r[0]) - index_of(202301)] if 1 <= j <= 6]
        want = sum(hit(r[3], CFG.usable[j]) * (1.0 + j / 10) for r, j in opened) / len(opened)
        assert got[label].rd_proj == pytest.approx(want)
        closed = [r for r in part if r[0] <= 202301]
        assert got[label].rd24 == pytest.approx(sum(hit(r[3], 24) for r in closed) / len(closed))


def test_calibration_blocks_pool_months(book):
    rows, df = book
    factors = df.sparkSession.createDataFrame([(202302, 1.0)], "codmes INT, factor DOUBLE")
    one = cal.evol_calibration_driver(df, CFG, "segment", factors, months=1).collect()
    three = cal.evol_calibration_driver(df, CFG, "segment", factors, months=3).collect()
    assert sum(r.n for r in one) == sum(r.n for r in three) == len(rows)
    assert {r.block_end for r in three} >= {202301, 202210, 202304}
    block = [r for r in rows if r[4] == "A" and r[0] in (202211, 202212, 202301)]
    got = next(r for r in three if r.segment == "A" and r.block_end == 202301)
    assert got.rd24 == pytest.approx(sum(hit(r[3], 24) for r in block) / len(block))


def test_moving_calibration_windows(book):
    rows, df = book
    factors = df.sparkSession.createDataFrame([(202302, 1.0)], "codmes INT, factor DOUBLE")
    out = cal.evol_calibration_driver(df, CFG, "segment", factors, months=3, moving=True).collect()
    got = {r.block_end: r for r in out if r.segment == "B"}
    window = [r for r in rows if r[4] == "B" and r[0] in (202205, 202206, 202207)]
    assert got[202207].n == len(window)
    assert got[202207].rd24 == pytest.approx(sum(hit(r[3], 24) for r in window) / len(window))


def test_floating_flags_are_labelled_as_whole_numbers(spark):
    df = spark.createDataFrame([(202001, 1.0), (202001, 0.0), (202001, 0.5), (202001, None)], "codmes INT, flg DOUBLE")
    labels = [r.bucket for r in cal.unpivot_drivers(df, ["flg"], ["codmes"]).collect()]
    assert labels == ["1", "0", "0.5", None]


def test_stored_targets_give_the_same_result(book):
    _, df = book
    horizons = {24, 21, 12, *CFG.usable.values()}
    stored = df.withColumns({f"DEF{k}": CFG.defaulted(k) for k in horizons}).withColumn("mora", CFG.defaulted(3))
    a = cal.evol_calibration(df, CFG).orderBy("codmes").collect()
    cfg = CFG.with_(target_prefix="DEF", early="mora")
    b = cal.evol_calibration(stored.drop("dist_def"), cfg).orderBy("codmes").collect()
    assert a == b
    factors = df.sparkSession.createDataFrame([(202302, 1.5)], "codmes INT, factor DOUBLE")
    x = cal.driver_calibration(df, CFG, "driver", factors).orderBy("driver").collect()
    y = cal.driver_calibration(stored.drop("dist_def"), cfg, "driver", factors).orderBy("driver").collect()
    assert x == y


def test_zero_denominators_give_null(spark):
    rows = [(m, 0.0, 0.1, None, "A") for m in month_range(202110, 202305)]
    df = spark.createDataFrame(rows, "codmes INT, amount DOUBLE, pd DOUBLE, dist_def INT, segment STRING")
    for view in ("n", "m"):
        got = cal.evol_calibration(df, CFG, view).collect()
        assert all(r.rd_proj is None for r in got)


def test_overrides_smoothing_and_portfolio(spark):
    rows = [(s, m, 24200 + i, 100 * (i + 1) if s == "A" else 50, 0.1, 2.0, 0.2 + i / 10)
            for s in "AB" for i, m in enumerate((202302, 202303, 202304))]
    df = spark.createDataFrame(rows, "segment STRING, codmes INT, month_idx INT, n LONG, rd_usable DOUBLE, factor DOUBLE, rd_proj DOUBLE")
    table = spark.createDataFrame([("A", 202302, "add", 0.005), ("A", 202303, "set", 0.005)],
                                  "segment STRING, codmes INT, op STRING, value DOUBLE")
    got = {(r.segment, r.codmes): r for r in pj.override_projection(df, table, keys=["segment"]).collect()}
    assert got["A", 202302].rd_proj == pytest.approx(0.205) and got["A", 202302].factor == pytest.approx(2.05)
    assert got["A", 202303].rd_proj == 0.005 and got["B", 202303].rd_proj == pytest.approx(0.3)
    assert got["B", 202303].factor == 2.0
    same = {(r.segment, r.codmes): r.rd_proj for r in pj.smooth_projection(df, 1, ["segment"]).collect()}
    assert same["A", 202304] == pytest.approx(0.4)
    wide = {(r.segment, r.codmes): r.rd_proj for r in pj.smooth_projection(df, 3, ["segment"]).collect()}
    assert wide["A", 202302] == pytest.approx(0.25) and wide["A", 202303] == pytest.approx(0.3)
    total = {r.codmes: r.rd_proj for r in pj.portfolio_projection(df.withColumn(
        "rd_proj", F.when(F.col("segment") == "A", 0.1).otherwise(0.4))).collect()}
    assert total[202302] == pytest.approx((100 * 0.1 + 50 * 0.4) / 150)


def test_factor_table_equals_merged_views(book):
    _, df = book
    ids = {"A": 1, "B": 2}
    direct = cohorts.factor_table(df, CFG, ids, 202501).orderBy("seg_proy", "codmes").collect()
    months = {(r.segment, r.codmes) for r in df.select("segment", "codmes").distinct().collect()}
    assert len(direct) == sum(s in ids for s, _ in months)
    for r in direct:
        if not 202302 <= r.codmes <= 202307:
            assert (r.factor_amounts, r.projection_accounts) == (0.0, 0.005)
    nine = cohorts.factor_table(df, CFG, ids, 202501, projected_months=9).collect()
    assert {r.codmes for r in nine if r.factor_accounts} >= {r.codmes for r in direct if r.factor_accounts}
    views = []
    for view in ("n", "m"):
        sums = cal.cohort_sums(df.withColumn("seg_proy", cohorts.segment_id("segment", ids)), CFG,
                               [24, *CFG.usable.values()], by=("seg_proy",))
        views.append(pj.with_projection(sums, CFG, view, by=("seg_proy",)))
    merged = cohorts.merge_factor_views(*views, 202501).orderBy("seg_proy", "codmes").collect()
    assert direct == merged


def test_missing_factors_get_defaults(spark):
    fc = spark.createDataFrame([(1, 202302, None, None), (1, 202303, 0.1, 2.0)], "seg_proy INT, codmes INT, rd_proj DOUBLE, factor DOUBLE")
    fm = spark.createDataFrame([(1, 202302, 0.3, 3.0), (1, 202305, 0.1, 2.0)], "seg_proy INT, codmes INT, rd_proj DOUBLE, factor DOUBLE")
    assert [tuple(r) for r in cohorts.merge_factor_views(fc, fm, 202501).collect()] == [
        (202501, 202302, 1, 0.3, 3.0, 0.005, 0.0)]


def test_cutoffs_and_flags(spark):
    cfg = MonitorConfig.for_run_month(202501)
    assert [cfg.cutoff(k) for k in (12, 11, 9, 6, 3, 1)] == [202301, 202302, 202304, 202307, 202310, 202312]
    assert cohorts.early_month(cfg) == 202401
    df = spark.createDataFrame([(m, 16) for m in (202301, 202302, 202304, 202307, 202310, 202312, 202401, 202402)],
                               "codmes INT, dist_def INT")
    got = {r.codmes: r for r in df.select("codmes", cohorts.latest_target(cfg).alias("ult"),
                                          *[c.alias(n) for n, c in cohorts.cohort_flags(cfg).items()]).collect()}
    assert [got[m].flg_diagnosis for m in sorted(got)] == [0, 1, 1, 1, 0, 0, 0, 0]
    assert [got[m].flg_recent for m in sorted(got)] == [0, 0, 0, 0, 1, 1, 0, 0]
    assert [got[m].flg_early for m in sorted(got)] == [1, 1, 1, 1, 1, 1, 1, 0]
    assert [got[m].ult for m in sorted(got)] == [0, 1, 1, 1, 1, 0, 0, 0]
    fixed = df.select(*[c.alias(n) for n, c in cohorts.cohort_flags(cfg, (202401, 202402), 202310).items()]).collect()
    assert sum(r.flg_recent for r in fixed) == 2 and sum(r.flg_early for r in fixed) == 5


def test_information_value(spark):
    rows = [(202001, 1.0, 0.1, 5 if i < b else None, label) for label, b, n in (("a", 10, 50), ("b", 30, 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "codmes INT, amount DOUBLE, pd DOUBLE, dist_def INT, d STRING")
    g, b = np.array([40, 30]) / 70, np.array([10, 30]) / 40
    for view in ("n", "m"):
        assert cal.information_value(df, CFG, ["d"], view).first().iv == pytest.approx(((g - b) * np.log(g / b)).sum())


def test_window_mean(spark):
    df = spark.createDataFrame([(202301, 1.0), (202302, 3.0), (202303, 100.0)], "codmes INT, x DOUBLE")
    assert cal.window_mean(df, ["x"], 202301, 202302).first().x == 2.0


# -- bands -------------------------------------------------------------------


def test_beta_quantiles_at_known_points():
    assert bands.beta_quantile(0.025, 0.5, 10.5) == pytest.approx(0.0000479, abs=1e-7)
    assert bands.beta_quantile(0.975, 0.5, 10.5) == pytest.approx(0.217196, abs=1e-6)
    assert bands.beta_quantile(0.025, 5.5, 5.5) == pytest.approx(0.223529, abs=1e-6)
    assert bands.beta_quantile(0.975, 5.5, 5.5) == pytest.approx(0.776471, abs=1e-6)


def test_vasicek_and_normal_functions(spark):
    df = spark.createDataFrame([(0.05,), (0.0,), (1.0,), (None,), (1e-9,)], "p DOUBLE")
    got = [r.v for r in df.select(bands.vasicek_quantile(F.col("p"), 0.15, 0.975).alias("v")).collect()]
    assert got[0] == pytest.approx(0.168340, abs=1e-6) and got[1:4] == [0.0, 1.0, None]
    back = df.select(bands.normal_cdf(bands.normal_quantile(F.col("p"))).alias("v")).collect()
    assert back[0].v == pytest.approx(0.05, abs=1e-14) and back[4].v == pytest.approx(1e-9, rel=1e-6)


@pytest.mark.parametrize("a, b", [
    (0.5, 0.5), (0.5, 10.5), (1.0, 1.0), (40.5, 2_000_000.5), (1500.5, 9000.5), (999.5, 1e14), (1e12, 3e12), (0.8, 7.5),
])
def test_beta_quantile_inverts_at_all_sizes(a, b):
    for p in (0.001, 0.025, 0.5, 0.975, 0.999):
        x = bands.beta_quantile(p, a, b)
        assert bands.beta_cdf(a, b, x) == pytest.approx(p, abs=1e-9)
    # The normal approximation is good where both parameters are large.
    if min(a, b) > 1e3:
        mean, sd = a / (a + b), np.sqrt(a * b / (a + b) ** 2 / (a + b + 1))
        assert bands.beta_quantile(0.975, a, b) == pytest.approx(mean + 1.96 * sd, abs=0.02 * sd)
    # Uniform and arc-sine law in closed form.
    if (a, b) == (1.0, 1.0):
        assert bands.beta_quantile(0.3, a, b) == pytest.approx(0.3, abs=1e-12)
    if (a, b) == (0.5, 0.5):
        assert bands.beta_cdf(a, b, 0.25) == pytest.approx(2 / np.pi * np.arcsin(0.5), abs=1e-12)


def test_bands_on_frames(spark):
    df = spark.createDataFrame([(10, 0, 0.1, 0.0), (10, 5, 0.1, 0.5), (0, 0, 0.1, None), (10, 5, None, 0.5)],
                               "n LONG, d LONG, pd DOUBLE, rd DOUBLE")
    for kind in ("jeffreys", "wilson", "vasicek"):
        out = bands.add_bands(df, kind, "n", "d", "pd", "rd").collect()
        assert len(out) == 4
        for r in out:
            if r.lower is not None:
                assert 0 <= r.lower < r.upper <= 1
    j = bands.bands_jeffreys(df, "n", "d", "pd").collect()
    assert [r.inside for r in j] == [True, False, None, None]
    assert j[2].lower is None
    with pytest.raises(ValueError):
        bands.add_bands(df, "other", "n", "d", "pd", "rd")


# -- segment factors in driver reports ---------------------------------------


def segment_factor(segment, j):
    return (1.0 if segment == "A" else 2.0) + j / 10


def segment_factors(spark, segments="AB"):
    rows = [(s, shift_yyyymm(202301, j), segment_factor(s, j)) for s in segments for j in range(1, 7)]
    return spark.createDataFrame(rows, "segment STRING, codmes INT, factor DOUBLE")


def projected_by_hand(rows, segments="AB", view="n", key=lambda r: r[5]):
    won, base = {}, {}
    for r in rows:
        j = index_of(r[0]) - index_of(202301)
        if not 1 <= j <= 6 or r[5] is None or r[4] not in segments:
            continue
        w = 1 if view == "n" else r[1]
        k = key(r)
        won[k] = won.get(k, 0) + w * hit(r[3], CFG.usable[j]) * segment_factor(r[4], j)
        base[k] = base.get(k, 0) + w
    return {k: won[k] / base[k] for k in base}


@pytest.mark.parametrize("view", ["n", "m"])
@pytest.mark.parametrize("segments", ["AB", "A"])
def test_driver_projection_with_a_factor_per_segment(spark, book, view, segments):
    rows, df = book
    got = cal.driver_calibration(df, CFG, "driver", segment_factors(spark, segments), view=view)
    want = projected_by_hand(rows, segments, view)
    assert {r.driver: r.rd_proj for r in got.collect()} == pytest.approx(want)
    # Sizes and observed rates are those of the whole bucket.
    plain = cal.driver_calibration(df, CFG, "driver", segment_factors(spark).drop("segment"), view=view).drop("rd_proj")
    shown = {r.driver: tuple(r)[1:] for r in got.drop("rd_proj").collect()}
    assert shown.keys() == {r.driver for r in plain.collect()}
    assert all(shown[r.driver] == pytest.approx(tuple(r)[1:]) for r in plain.collect())


def test_driver_months_with_a_factor_per_segment(spark, book):
    rows, df = book
    got = cal.evol_calibration_driver(df, CFG, "driver", segment_factors(spark))
    want = projected_by_hand(rows, key=lambda r: (r[5], r[0]))
    assert {(r.driver, r.block_end): r.rd_proj for r in got.collect() if r.rd_proj is not None} == pytest.approx(want)
    pooled = cal.evol_calibration_driver(df, CFG, "driver", segment_factors(spark), months=3).collect()
    assert len({r.block_end for r in pooled}) < 15 and any(r.rd_proj for r in pooled)


def test_equal_segment_factors_are_a_month_factor(spark, book):
    _, df = book
    one = segment_factors(spark, "A")
    both = one.unionByName(one.withColumn("segment", F.lit("B")))
    by = {
        name: {r.driver: r.rd_proj for r in cal.driver_calibration(df, CFG, "driver", f, view="m").collect()}
        for name, f in (("segment", both), ("month", one.drop("segment")))
    }
    assert by["segment"] == pytest.approx(by["month"])


def test_segment_factors_need_cells_by_segment(spark, book):
    _, df = book
    cells = cal.driver_cells(df, CFG, ["driver"], cal.report_horizons(CFG, [12]))
    with pytest.raises(ValueError, match="cells by segment"):
        cal.drivers_from_cells(cells, CFG, segment_factors(spark))


def test_segments_without_a_value_take_no_part(spark):
    rows = [(202302, 10.0, 0.1, 3, s, "x") for s in ("A", None, "C")]
    df = spark.createDataFrame(rows, "codmes INT, amount DOUBLE, pd DOUBLE, dist_def INT, segment STRING, driver STRING")
    got = cal.driver_calibration(df, CFG, "driver", segment_factors(spark)).first()
    assert got.n == 3 and got.rd_proj == pytest.approx(segment_factor("A", 1))


def test_smoothing_looks_at_calendar_neighbours_only(spark):
    rows = [("A", 24276 + k, 0.1 * k) for k in (0, 1, 4, 5)] + [("A", 24300, None), ("B", 24277, 9.0)]
    df = spark.createDataFrame(rows, "segment STRING, month_idx LONG, rd_proj DOUBLE")
    got = {(r.segment, r.month_idx - 24276): r.rd_proj for r in pj.smooth_projection(df, 3, ("segment",)).collect()}
    assert got["A", 0] == pytest.approx(0.05) and got["A", 1] == pytest.approx(0.05)
    assert got["A", 4] == pytest.approx(0.45) and got["A", 24] is None and got["B", 1] == 9.0
