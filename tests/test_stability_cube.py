from __future__ import annotations

import math
import random
import uuid
from decimal import Decimal
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.functions.months import month_range
from scoremon.operators import calibration as cal, cohorts, cube as cb, discrimination as ds, stability as st
from scoremon.plans import fixed_values as fx
from scoremon.plans import runs
from scoremon.sources import tables as tb

CFG = MonitorConfig(closed_month=202301)


def mix(spark, spec):
    rows = [(m, b, 10.0 * (1 + i % 3)) for m, b, n in spec for i in range(n)]
    return spark.createDataFrame(rows, "codmes INT, b STRING, amount DOUBLE")


def test_psi_of_equal_windows_is_zero_and_never_negative(spark):
    df = mix(spark, [(202201, "a", 6), (202201, "b", 3), (202301, "a", 6), (202301, "b", 3)])
    assert st.psi(df, CFG, ["b"], (202201, 202201), (202201, 202201)).first().psi == 0
    for view in ("n", "m"):
        row = st.psi(df, CFG, ["b"], (202201, 202212), (202301, 202312), view).first()
        assert row.psi == pytest.approx(0) and row.status == "green"


def test_psi_with_a_bucket_on_one_side_only(spark):
    df = mix(spark, [(202201, "a", 8), (202201, "gone", 2), (202301, "a", 5), (202301, None, 5)])
    row = st.psi(df, CFG, ["b"], (202201, 202212), (202301, 202312)).first()
    e = st.EMPTY_SHARE
    want = (0.5 - 0.8) * math.log(0.5 / 0.8) + (e - 0.2) * math.log(e / 0.2) + (0.5 - e) * math.log(0.5 / e)
    assert row.buckets == 3 and row.psi == pytest.approx(want) and row.status == "red"
    monthly = st.evol_psi(df, CFG, ["b"], (202201, 202212), (202301, 202303)).collect()
    assert [(r.codmes, r.status) for r in monthly] == [(202301, "red")]
    assert monthly[0].psi == pytest.approx(want)


def test_psi_without_a_base_is_null(spark):
    df = mix(spark, [(202301, "a", 5)])
    row = st.psi(df, CFG, ["b"], (202201, 202212), (202301, 202312)).first()
    assert row.psi is None and row.status is None


def test_overlapping_windows_count_rows_on_both_sides(spark):
    df = mix(spark, [(202201, "a", 4), (202201, "b", 4), (202202, "a", 6), (202202, "b", 2)])
    got = {r.codmes: r.psi for r in st.evol_psi(df, CFG, ["b"], (202201, 202202), (202201, 202202)).collect()}
    p = (10 / 16, 6 / 16)
    for m, q in ((202201, (0.5, 0.5)), (202202, (0.75, 0.25))):
        assert got[m] == pytest.approx(sum((y - x) * math.log(y / x) for x, y in zip(p, q)))


def test_mix_shares_sum_to_one(spark):
    df = mix(spark, [(202201, "a", 3), (202201, None, 1), (202202, "b", 2)])
    out = st.mix_by_month(df, CFG, ["b"]).collect()
    for m in (202201, 202202):
        assert sum(r.share_n for r in out if r.codmes == m) == pytest.approx(1)
        assert sum(r.share_m for r in out if r.codmes == m) == pytest.approx(1)


@pytest.fixture(scope="module")
def book(spark):
    r = random.Random(2)
    rows = [
        (m, float(r.randrange(100, 900)), r.random() * 0.2, r.randrange(1, 40) if r.random() < 0.4 else None,
         r.choice(["1. Afluente", "2. Consumo", "3. Resto"]), r.choice("xyz"))
        for m in month_range(202101, 202501) for _ in range(40)
    ]
    return rows, spark.createDataFrame(
        rows, "codmes INT, amount DOUBLE, pd DOUBLE, dist_def INT, segment STRING, axis STRING").cache()


def test_cube_totals_match_the_base(book):
    rows, df = book
    spark = df.sparkSession
    ids = fx.TRADITIONAL_SEGMENT_IDS
    factors = cohorts.factor_table(df, CFG, ids, 202501)
    base = df.withColumn("seg_proy", cohorts.segment_id("segment", ids))
    cube = cb.reporting_cube(base, CFG, {"axis": "EJE_P1", "segment": "EJE_P2"}, ["pd", "pd"], factors)
    got = cube.agg(*[F.sum(c).alias(c) for c in cb.measure_names(["pd", "pd"])]).first()
    assert got.n == len(rows) and float(got.m) == pytest.approx(sum(r[1] for r in rows))
    assert got.pd_02_xn == pytest.approx(sum(r[2] for r in rows))
    closed = [r for r in rows if r[0] <= 202301]
    assert got.def_closed_xn == sum(r[3] is not None and r[3] <= 24 for r in closed)
    temp = [r for r in rows if r[0] <= 202304]
    assert float(got.def_temp_xm) == pytest.approx(sum(r[1] for r in temp if r[3] is not None and r[3] <= 21))
    # The same measures from applications one by one.
    joined = cohorts.factor_join(base, factors, CFG)
    inside = F.col("codmes").between(202302, 202307)
    want = joined.agg(
        F.sum(F.when(inside, F.col("proj_factor_m") * F.col("amount"))).alias("fm"),
        F.sum(F.when(inside, F.col("proj_value_n"))).alias("vn"),
    ).first()
    assert got.proj_factor_dt_xm == pytest.approx(want.fm) and got.proj_value_dt_xn == pytest.approx(want.vn)
    # Every measure has a value in every cell of a projected segment, inside and outside its window.
    cells = cube.filter("seg_proy IS NOT NULL").collect()
    assert cells and all(r[c] is not None for r in cells for c in cb.measure_names(["pd", "pd"]))
    assert got.proj_value_mt_xm > 0 and got.proj_value_mt_xn > 0
    more = cohorts.factor_table(df, CFG, ids, 202501, projected_months=9)
    wide = cb.reporting_cube(base, CFG, {"axis": "EJE_P1"}, ["pd"], more.union(more))
    sums = wide.agg(*[F.sum(c).alias(c) for c in ("n", "proj_value_mt_xn", "proj_factor_dt_xn")]).first()
    assert sums.n == len(rows) and sums.proj_value_mt_xn != pytest.approx(got.proj_value_mt_xn)
    assert sums.proj_factor_dt_xn == pytest.approx(got.proj_factor_dt_xn)
    long = cb.cube_long(cube, ["EJE_P1", "EJE_P2"], ["n"], ["codmes"])
    assert long.filter("axis = 'EJE_P1'").agg(F.sum("n")).first()[0] == len(rows)
    labels = tb.label_table(spark, [("EJE_P1", "one"), ("EJE_P9", "none")], ["axis", "title"])
    used = {r.axis: r for r in cb.label_usage(cube, ["EJE_P1", "EJE_P2"], labels).collect()}
    assert used["EJE_P1"].buckets == 3 and used["EJE_P9"].n is None


def test_publish_writes_all_parts(book, tmp_path):
    rows, df = book
    spark = df.sparkSession
    where = runs.publish_cube(
        df, CFG, {"axis": "EJE_P1"}, ["pd"], fx.TRADITIONAL_SEGMENT_IDS, 202501, str(tmp_path / "out"))
    segments = [s for s in fx.TRADITIONAL_SEGMENT_IDS if s in {r[4] for r in rows}]
    months = {(r[4], r[0]) for r in rows if r[4] in segments}
    assert spark.read.parquet(where["factors"]).count() == len(months)
    cube = spark.read.parquet(where["cube"])
    assert cube.agg(F.sum("n")).first()[0] == len(rows)
    back = spark.read.option("header", True).csv(where["cube_csv"])
    assert back.count() == cube.count() and "def_cerrado_xm" in back.columns and "CODMES" in back.columns
    assert spark.read.option("header", True).csv(where["axis_labels_csv"]).count() == 21
    assert spark.read.option("header", True).csv(where["pd_titles_csv"]).count() == 10


def test_published_cube_follows_corrections_and_parameters(book, tmp_path):
    _, df = book
    spark = df.sparkSession
    change = spark.createDataFrame([("n", 202303, "set", 0.9)], "view STRING, codmes INT, op STRING, value DOUBLE")

    def run(tag, **more):
        where = runs.publish_cube(
            df, CFG, {"axis": "EJE_P1"}, ["pd"], fx.TRADITIONAL_SEGMENT_IDS, 202501, str(tmp_path / tag), **more
        )
        return spark.read.parquet(where["cube"]).agg(
            *[F.sum(c).alias(c) for c in ("proj_value_dt_xn", "proj_value_dt_xm", "flg_recent", "def_early_xn")]
        ).first(), where

    plain, _ = run("plain")
    changed, where = run(
        "changed", overrides=change, recent=(202301, 202302), early_until=202206, smooth=1, method="met1",
        pd_titles=fx.GUARANTEE_PD_TITLES, tables={"factors": "published_factors", "cube": "published_cube"},
    )
    assert changed.proj_value_dt_xn > plain.proj_value_dt_xn
    assert changed.proj_value_dt_xm == pytest.approx(plain.proj_value_dt_xm)
    assert changed.flg_recent != plain.flg_recent and changed.def_early_xn < plain.def_early_xn
    titles = {r[1] for r in spark.read.option("header", True).csv(where["pd_titles_csv"]).collect()}
    assert {"04-PD Nueva", "05-PD Modulo Gahi"} <= titles
    stored = spark.table("published_factors")
    assert {"CODMES_DEF", "proyeccion_montos", "factor_cuentas"} <= set(stored.columns) and stored.count() > 0
    assert "def_proy_valor_mt_xn" in spark.table("published_cube").columns


def test_amount_view_is_tested_with_its_own_rate(book):
    _, df = book
    plan = runs.MonitorPlan(drivers=["axis"], **PLAN)
    out = runs.monitor(df, CFG, plan)
    for r in out["calibration_m"].filter("rd24 IS NOT NULL").collect():
        assert r.lower <= r.rd24 <= r.upper
    assert {"met1", "met2", "met3"} <= set(out["all_methods_n"].columns)
    assert [c for c in out["discrimination"].columns if c != "variable"] == ["p202201", "p202202", "p202203"]


PLAN = dict(numeric=["pd", "amount"], base_window=(202101, 202112), recent_window=(202201, 202212),
            gini_months=(202201, 202203), driver_use="codmes BETWEEN 202201 AND 202304")


def same_rows(a, b):
    def rows(df):
        return sorted(
            (tuple(round(float(c), 9) if isinstance(c, (float, Decimal)) else c for c in r)
             for r in df.select(*sorted(df.columns)).collect()), key=repr)
    return rows(a) == rows(b)


def test_run_reports_equal_the_single_operators(book):
    """Reports made from the stored summaries equal the operators on the base."""
    _, df = book
    plan = runs.MonitorPlan(drivers=["segment", "axis"], **PLAN)
    out = runs.monitor(df, CFG, plan)
    base, recent = plan.base_window, plan.recent_window
    factors = {v: cal.evol_calibration(df, CFG, v).filter("rd_proj IS NOT NULL").select("codmes", "factor") for v in "nm"}
    drivers = ["segment", "axis"]
    want = {
        "validation": cal.monthly_calibration(df, CFG),
        "mix": st.mix_by_month(df, CFG, drivers),
        "information_value": cal.information_value(df, CFG, drivers, use=plan.driver_use),
        "gini": ds.multi_driver_gini(df, CFG, ["pd", "amount"], drivers, start=202201, end=202203, months=6,
                                     moving=True, limits=(0.4, 0.5)),
    }
    for v in "nm":
        want[f"calibration_segment_{v}"] = cal.evol_calibration(df, CFG, v, by=("segment",))
        want[f"drivers_{v}"] = cal.multi_driver_calibration(
            df, CFG, drivers, factors[v], v, plan.driver_use, min_share=0.05)
        want[f"psi_{v}"] = st.psi(df, CFG, drivers, base, recent, v)
        want[f"evol_psi_{v}"] = st.evol_psi(df, CFG, drivers, base, recent, v)
        evol = out[f"evol_drivers_{v}"].filter("variable = 'axis'").drop("variable").withColumnRenamed("bucket", "axis")
        assert same_rows(evol, cal.evol_calibration_driver(df, CFG, "axis", factors[v], v))
        bare = out[f"calibration_{v}"]
        assert "inside" in bare.columns
        assert same_rows(bare.drop("lower", "upper", "inside"), cal.evol_calibration(df, CFG, v))
        assert out[f"portfolio_{v}"].count() == 6
    for name, frame in want.items():
        assert same_rows(out[name], frame), name
    assert out["missing"].count() == out["reconcile"].count() == 49


def test_other_column_names_give_the_same_results(book, tmp_path):
    """A base with its own, upper-case names and stored targets."""
    _, df = book
    horizons = (24, 23, 22, 21, 20, 19, 18, 17, 16, 12)
    names = {"codmes": "CODMES", "amount": "MONTO", "pd": "PD_USO", "segment": "SEGMENTO", "axis": "EJE"}
    other = df.withColumns({f"DEF{k}": CFG.defaulted(k) for k in horizons}).withColumn("MORA", CFG.defaulted(3))
    other = other.drop("dist_def").withColumnsRenamed(names)
    cfg = CFG.with_(month="CODMES", amount="MONTO", pds=("PD_USO",), segment="SEGMENTO", target_prefix="DEF", early="MORA")
    a = runs.monitor(df, CFG, runs.MonitorPlan(drivers=["segment", "axis"], **{**PLAN, "numeric": []}))
    b = runs.monitor(other, cfg, runs.MonitorPlan(drivers=["SEGMENTO", "EJE"], **{**PLAN, "numeric": []}))
    for name in ("calibration_m", "drivers_n", "psi_m", "evol_psi_n", "gini", "information_value", "validation"):
        x, y = (
            sorted([tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in f[name].drop("variable").collect()], key=repr)
            for f in (a, b)
        )
        assert x == y, name
    paths = [
        runs.publish_cube(frame, c, {ax: "EJE_P1"}, [pd], fx.TRADITIONAL_SEGMENT_IDS, 202501, str(tmp_path / ax))["cube"]
        for frame, c, ax, pd in ((df, CFG, "axis", "pd"), (other, cfg, "EJE", "PD_USO"))
    ]
    totals = [df.sparkSession.read.parquet(p).agg(*[F.round(F.sum(c), 6) for c in cb.measure_names(["pd"])]).first() for p in paths]
    assert totals[0] == totals[1]


def test_traditional_base(spark):
    apps = spark.createDataFrame(
        [(202301, 1, "r1", "a1", "COMPRA", "F", 300_000.0, 334.9, "20"), (202301, 2, "r2", "a2", None, "F", 1.0, 400.0, "30"),
         (202301, 3, "r3", "a3", "LIBRE DISPONIBILIDAD", "F", 1.0, 400.0, "30"),
         (202302, 4, "r4", "a4", "COMPRA", "F", None, None, "30"), (202302, 5, "r5", "a5", "COMPRA", "G", 1.0, 1.0, "30")],
        "codmes INT, client_id LONG, request_id STRING, account_id STRING, purpose STRING, funding STRING, amount DOUBLE, score DOUBLE, age STRING")
    scored = spark.createDataFrame([(202301, 1, 0.02, "T"), (202301, 1, 0.02, "T"), (202302, 4, 0.5, "other")],
                                   "codmes INT, client_id LONG, pd DOUBLE, campaign STRING")
    mirror = spark.createDataFrame([("r1", "LIMA TOP", 3, 41, 1111111111.0), ("r4", "X", 9, 50, 7.0)],
                                   "request_id STRING, zone STRING, term_group INT, age INT, debt DOUBLE")
    out = runs.traditional_base(apps, scored, mirror, {"funding": "F"}, ["pd"], ["zone", "term_group", "age", "debt"],
                                "campaign = 'T' AND pd IS NOT NULL", ["debt"])
    got = {r.request_id: r for r in out.collect()}
    assert sorted(got) == ["r1", "r4"]
    a, b = got["r1"], got["r4"]
    assert (a.rango_score, a.rango_pd, a.monto_r, a.pauta, a.zone_f, a.term_group, a.age, a.debt_f) == (
        "01. <0 - 335>", "03. <1.51 - 3.53%]", "2. <237,500 - 340,000]", 0, "1. Lima Top", "3. De 10 a 14 años", 41, None)
    assert (b.rango_score, b.rango_pd, b.monto_r, b.miss_pd, b.miss_monto, b.zone_f, b.term_group, b.debt_f) == (
        "99. Missing", "99. Missing", "99. Missing", 1, 1, "98. N.A.", None, 7.0)
    assert runs.duplicate_audit(out).count() == 0


def test_guarantee_base(spark):
    apps = spark.createDataFrame(
        [(202301, "r1", "a1", None, "T1", 87_500.0, 385.0, 0.005), (202306, "r2", "a2", "COMPRA/VENTA BIEN TERMINADO", "T1", 1.0, 1.0, 0.1),
         (202307, "r3", "a3", "COMPRA/VENTA BIEN TERMINADO", "T2", 700_000.0, 345.0, None), (202307, "r4", "a4", None, "T9", 1.0, 1.0, 0.1)],
        "codmes INT, request_id STRING, account_id STRING, purpose STRING, kind STRING, amount DOUBLE, score DOUBLE, pd DOUBLE")
    mirror = spark.createDataFrame([("r1", 2500.0, 1), ("r1", 2500.0, 1), ("r3", None, 0)],
                                   "request_id STRING, spouse_income DOUBLE, amount_flag INT")
    out = runs.guarantee_base(apps, mirror, {"kind": ["T1", "T2"]}, ["spouse_income", "amount_flag"])
    got = {r.request_id: r for r in out.collect()}
    assert sorted(got) == ["r1", "r3"] and out.count() == 2
    a, b = got["r1"], got["r3"]
    assert (a.rsc, a.rpd, a.monto_r, a.pauta, a.ran_ingr_cy, a.flg_monto_r, a.total) == (
        "2. [385 - 415>", "1. <0 - 0.5%]", "1. [0 - 87,500]", 1, "1. [0 - 2,500]", "1. >=325,000", "1")
    assert (b.rpd, b.monto_r, b.pauta, b.miss_pd, b.ran_ingr_cy, b.flg_monto_r) == (
        "99. Missing", "6. <600,000 - ++>", 1, 1, "99. Missing", "2. <325,000")


def test_monitored_columns(spark):
    df = spark.createDataFrame([(174.25, None, 1.0, None, "LIMA NORTE", "MAS DE 20"), (100.0, 0.3, None, None, None, "OTHER")],
                               "sc DOUBLE, pd_state DOUBLE, i1 DOUBLE, i2 DOUBLE, zone STRING, ran STRING")
    a, b = df.withColumns(runs.monitored_columns("sc", "pd_state", ["i1", "i2"], "zone", "ran")).collect()
    assert (a.pd_rbm, a.ingreso_cony_tit, a.cat_zona, a.ran) == (0.5, 1.0, "Lima", "4 MAS DE 20")
    assert (b.pd_rbm, b.ingreso_cony_tit, b.cat_zona, b.ran) == (0.3, 0.0, "99. Missing", "OTHER")


def test_renewed_sources_zone_and_latest_run(spark):
    df = spark.createDataFrame(
        [("r1", 202307, 0.5, 0.7, 12.0, 30.0, 39.0, 0.0, 9409.0, "LIMA", "LURIN-LIMA", 415.0, "2. Consumo"),
         ("r2", 202308, 0.643, 0.7, None, 700.0, 39.5, -1.0, 16000.5, "ICA", None, 414.0, "2. Consumo")],
        "req STRING, codmes INT, ltv_new DOUBLE, ltv_old DOUBLE, term DOUBLE, tenure DOUBLE, age DOUBLE, inc_c DOUBLE, "
        "inc_t DOUBLE, dep STRING, dis STRING, score DOUBLE, segment STRING")
    log = spark.createDataFrame([("r1", 1, "old", "T"), ("r1", 2, "new", "T"), ("r1", 3, "other", "C")],
                                "num STRING, run INT, prov STRING, role STRING")
    out = df.withColumns(runs.renewed_columns("codmes", ("ltv_new", "ltv_old"), "term", "tenure", "age", "inc_c", "inc_t"))
    out = runs.with_latest_run(runs.with_zone_risk(out, "dep", "dis"), log, "req", "num", "run", {"prov": "suite_prov"}, "role = 'T'")
    out = out.withColumns({"one": runs.acceptance("score"), "tier": runs.acceptance("score", "segment")})
    a, b = out.orderBy("req").collect()
    assert (a.ltv_corregido_vf, a.ltv_corregido_vf_q, b.ltv_corregido_vf_q) == (0.7, "3. 0.679 - 0.801", "1. 0.643 - 0.643")
    assert (a.term_q, b.term_q, a.tenure_q, b.tenure_q) == (
        "3. De 10 a 14 años", "98. Missing", "2. 27.000 - 59.000", "99. Out of Range")
    assert (a.age_q, b.age_q, a.inc_c_q, b.inc_c_q, a.inc_t_q, b.inc_t_q) == (
        "2. 34.000 - 39.000", "3. 39.000 - 45.000", "0. Sin conyuge", "99. Out of Range", "2. 6159.000 - 940...", "4. 16000.000 - 43...")
    assert (a.riesgo_zona2, a.riesgo_zona_st, b.riesgo_zona2, b.riesgo_zona_st) == ("BAJO", "ALTO", "ALTO", "ND")
    assert a.riesgo_zona_st_st == fx.ZONE_RISK_WEIGHTS["ALTO"] and b.riesgo_zona_st_st == fx.ZONE_RISK_WEIGHTS["ND"]
    assert (a.suite_prov, b.suite_prov, a.one, a.tier, b.tier) == ("new", None, 1, 1, 0)


# -- sources -----------------------------------------------------------------


def test_extract_roundtrip_and_strict_types(spark, tmp_path):
    path = str(tmp_path / "x")
    df = spark.createDataFrame([(1, "a;b", 1.5), (2, None, None)], "k INT, s STRING, v DOUBLE")
    tb.write_extract(df, path)
    assert sorted(tuple(r) for r in tb.read_extract(spark, path, df.schema).collect()) == [(1, "a;b", 1.5), (2, None, None)]
    with pytest.raises(Exception):
        tb.read_extract(spark, path, "k INT, s INT, v DOUBLE").collect()


def test_tables_are_replaced_and_read_by_name(spark):
    name = f"t_{uuid.uuid4().hex}"
    tb.save_table(spark.range(3).withColumn("codmes", F.lit(202301)), name, by="codmes")
    tb.save_table(spark.range(5).withColumn("codmes", F.lit(202302)), name, by="codmes")
    assert tb.read_table(spark, name, ["id"]).count() == 5
    spark.sql(f"DROP TABLE {name}")


def test_kept_frames_spill_to_disk(spark):
    kept = tb.keep(spark.range(10))
    assert kept.count() == 10 and kept.storageLevel.useDisk and kept.storageLevel.useMemory
    kept.unpersist()


def test_snapshot_projects_before_distinct(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "a INT, b INT")
    assert tb.distinct_snapshot(df).count() == 2 and tb.distinct_snapshot(df, ["a"]).count() == 1


def session_like(settings: dict):
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default))
    return SimpleNamespace(conf=conf)


def test_work_dir_uses_the_shared_folder():
    cluster = session_like({"spark.checkpoint.dir": "hdfs://shared/work/"})
    a, b = tb.work_dir(cluster, "x"), tb.work_dir(cluster, "x")
    assert a != b and a.startswith("hdfs://shared/work/x-")


def test_work_dir_falls_back_to_the_warehouse():
    assert tb.work_dir(session_like({"spark.sql.warehouse.dir": "hdfs://wh/"}), "x").startswith("hdfs://wh/_work/x-")


def test_stored_copies_are_removed(spark):
    kept = tb.store(spark.range(5), "five")
    path = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].removeprefix("//")
    assert Path(path).is_dir() and kept.count() == 5
    others = list(tb._stored[spark.sparkContext.applicationId])
    tb._stored[spark.sparkContext.applicationId] = [p for p in others if path.endswith(p.rsplit("/", 1)[-1])]
    tb.clear_stored(spark)
    assert not Path(path).exists()
    tb._stored[spark.sparkContext.applicationId] = [p for p in others if not path.endswith(p.rsplit("/", 1)[-1])]


def test_rules_may_be_a_table(spark):
    df = spark.createDataFrame([("LIMA", "A"), ("CUSCO", "B")], "dep STRING, dist STRING")
    rules = spark.createDataFrame([("LIMA", "A", "HIGH")], "d STRING, e STRING, r STRING")
    got = {r.dep: r.riesgo_zona2 for r in runs.with_zone_risk(df, "dep", "dist", rules=rules).collect()}
    assert got == {"LIMA": "HIGH", "CUSCO": fx.ZONE_RISK_DEFAULT}
