from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.functions.months import month_range
from scoremon.operators import calibration as cal
from scoremon.operators import incremental as inc
from scoremon.plans import runs

CFG = MonitorConfig(closed_month=202301, pds=("pd",))
SPEC = inc.SummarySpec(("driver",), ("pd", "score"), (24, 21, 18, 12))


def book(spark, months, seed=1, n=40):
    r, rows = random.Random(seed), []
    for m in months:
        for i in range(n):
            d = r.randrange(1, 30) if r.random() < 0.5 else None
            rows.append((m, 1000.0 + 10 * i, r.random() * 0.3, r.choice([None, float("nan"), r.random()]), d, "AB"[i % 2], f"{i % 3}. b"))
    return spark.createDataFrame(
        rows, "codmes INT, amount DOUBLE, pd DOUBLE, score DOUBLE, dist_def INT, segment STRING, driver STRING"
    )


def deliver(df, path):
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("codmes").parquet(path)


def rows_of(df):
    plain = [c for c in df.columns if c != "sketch"]
    return sorted(
        tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(plain)).collect()
    )


def stored(spark, tmp_path, name="kept", cfg=CFG, spec=SPEC):
    return inc.SummaryStore(spark, f"{tmp_path}/{name}", cfg, spec)


def test_a_new_and_a_changed_month_equal_a_full_run(spark, tmp_path):
    base, kept = f"{tmp_path}/base", stored(spark, tmp_path)
    deliver(book(spark, month_range(202201, 202306)), base)
    assert kept.refresh(base).read == tuple(month_range(202201, 202306))
    assert kept.refresh(base) == inc.Refresh((), ())
    deliver(book(spark, [202307], 2).unionByName(book(spark, [202202], 3)), base)
    assert kept.changed(base)[0] == [202202, 202307]
    files = kept.months(base, kept.changed(base)[0]).inputFiles()
    assert files and all("codmes=202307" in f or "codmes=202202" in f for f in files)
    assert kept.refresh(base).read == (202202, 202307)
    full = stored(spark, tmp_path, "full")
    full.refresh(base)
    for name in inc.TABLES:
        assert rows_of(kept.table(name)) == rows_of(full.table(name)), name
    assert len(os.listdir(f"{tmp_path}/kept/parts")) == 2


def test_run_from_stored_months_equals_the_run_on_the_base(spark, tmp_path):
    base, kept = f"{tmp_path}/base", stored(spark, tmp_path)
    deliver(book(spark, month_range(202101, 202305)), base)
    kept.refresh(base)
    deliver(book(spark, month_range(202306, 202310), 5), base)
    kept.refresh(base)
    plan = runs.MonitorPlan(
        drivers=["driver"], numeric=["pd", "score"], base_window=(202101, 202112), recent_window=(202201, 202301),
        gini_months=(202206, 202301), gini_width=3,
    )
    whole = runs.monitor(spark.read.parquet(base), CFG, plan)
    months = runs.monitor_stored(kept, plan)
    assert set(whole) - set(months) == {"missing", "reconcile"}
    for name in ("validation", "calibration_n", "drivers_m", "gini", "projection_segment", "psi_n", "factors_early"):
        assert rows_of(months[name]) == rows_of(whole[name]), name


def test_months_that_leave_and_other_settings(spark, tmp_path):
    base, kept = f"{tmp_path}/base", stored(spark, tmp_path)
    deliver(book(spark, [202201, 202202, 202203]), base)
    kept.refresh(base)
    os.rename(f"{base}/codmes=202202", f"{tmp_path}/gone")
    assert kept.refresh(base) == inc.Refresh((), (202202,))
    assert {r.codmes for r in kept.table("sums").collect()} == {202201, 202203}
    other = stored(spark, tmp_path, cfg=CFG.with_(universe="segment = 'A'"))
    with pytest.raises(ValueError, match="refresh first"):
        other.table("sums")
    assert other.refresh(base).read == (202201, 202203)
    assert {r.segment for r in other.table("sums").collect()} == {"A"}


def test_a_refresh_that_dies_leaves_the_old_summaries(spark, tmp_path, monkeypatch):
    base, kept = f"{tmp_path}/base", stored(spark, tmp_path)
    deliver(book(spark, [202201, 202202]), base)
    kept.refresh(base)
    before = rows_of(kept.table("cells"))
    deliver(book(spark, [202201], 9), base)
    real = inc.month_summaries

    def dies(*args):
        out = real(*args)
        return out | {"scores": out["scores"].withColumn("n", F.raise_error(F.lit("killed")).cast("long"))}

    monkeypatch.setattr(inc, "month_summaries", dies)
    with pytest.raises(Exception, match="killed"):
        kept.refresh(base)
    assert rows_of(kept.table("cells")) == before
    monkeypatch.setattr(inc, "month_summaries", real)
    assert kept.refresh(base).read == (202201,) and rows_of(kept.table("cells")) != before
    # What the dead refresh has left is cleared away.
    assert len(os.listdir(f"{tmp_path}/kept/parts")) == 2


def test_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "PARTS", 2)
    base, kept = f"{tmp_path}/base", stored(spark, tmp_path)
    for m in (202201, 202202, 202203):
        deliver(book(spark, [m], m), base)
        kept.refresh(base)
    assert len(os.listdir(f"{tmp_path}/kept/parts")) == 1
    full = stored(spark, tmp_path, "full")
    full.refresh(base)
    assert all(rows_of(kept.table(n)) == rows_of(full.table(n)) for n in inc.TABLES)


def test_month_without_rows_of_the_universe(spark, tmp_path):
    cfg = CFG.with_(universe="pd > 5")
    base, kept = f"{tmp_path}/base", stored(spark, tmp_path, cfg=cfg)
    deliver(book(spark, [202201]), base)
    assert kept.refresh(base).read == (202201,) and kept.refresh(base).read == ()
    assert all(kept.table(n).count() == 0 for n in inc.TABLES)


def test_quantiles_of_a_window_from_merged_sketches(spark, tmp_path):
    base, kept = f"{tmp_path}/base", stored(spark, tmp_path)
    df = book(spark, month_range(202201, 202206), n=400)
    deliver(df, base)
    kept.refresh(base)
    got = {r.variable: r for r in inc.window_quantiles(kept.table("sketches"), (0.25, 0.5, 0.75), 202202, 202205).collect()}
    for name in ("pd", "score"):
        values = sorted(r[0] for r in df.filter("codmes BETWEEN 202202 AND 202205").select(name).collect() if r[0] is not None and r[0] == r[0])
        assert got[name].n == len(values)
        for p, cut in zip((0.25, 0.5, 0.75), got[name].cuts):
            assert abs(sum(v <= cut for v in values) / len(values) - p) < 0.01
    assert cal.roll_up(kept.table("sums"), (), "codmes").count() == 6
