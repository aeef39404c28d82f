"""Registered queries: stability, discrimination, reporting cube and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scoremon.functions import buckets as bk
from scoremon.functions.scores import with_pds
from scoremon.operators import calibration as cal
from scoremon.operators import cohorts
from scoremon.operators import cube as cb
from scoremon.operators import discrimination as ds
from scoremon.operators import stability as st
from scoremon.operators.incremental import SummarySpec, SummaryStore
from scoremon.plans import fixed_values as fx
from scoremon.plans.calibration_queries import (
    FACTOR_COLUMNS,
    FACTOR_VIEWS,
    SEG_SCORED_SQL,
    SUMS,
    UNIVERSE,
    factors,
    projection_sql,
)
from scoremon.plans.oracle import scored
from scoremon.plans.registry import query
from scoremon.plans.setup import CFG, DRIVERS_SQL, SEGMENT_IDS, r6, with_drivers
from scoremon.sources import tables as tb
from scoremon.sources.views import calendar, scored_base, stored_base

# -- stability ---------------------------------------------------------------

BASE, RECENT = (199501, 199612), (200001, 200012)
MONEY_SQL = "CAST(amount AS DECIMAL(18,2))"


def _long_sql(drivers, predicate: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS variable, CAST({d} AS VARCHAR) AS bucket, codmes, amount FROM drivers WHERE {predicate}"
        for d in drivers
    )


def _psi_sql(drivers, weight: str, select: str) -> str:
    return f"""
, long AS ({_long_sql(drivers, UNIVERSE)}),
cells AS (SELECT variable, bucket,
 CAST(sum(CASE WHEN codmes BETWEEN {BASE[0]} AND {BASE[1]} THEN {weight} END) AS DOUBLE) AS b,
 CAST(sum(CASE WHEN codmes BETWEEN {RECENT[0]} AND {RECENT[1]} THEN {weight} END) AS DOUBLE) AS r
 FROM long WHERE codmes BETWEEN {BASE[0]} AND {BASE[1]} OR codmes BETWEEN {RECENT[0]} AND {RECENT[1]} GROUP BY 1, 2),
shares AS (SELECT variable, bucket, coalesce(b, 0)/sum(b) OVER w AS share_base, coalesce(r, 0)/sum(r) OVER w AS share_recent
 FROM cells WINDOW w AS (PARTITION BY variable)),
terms AS (SELECT *, (greatest(share_recent, 0.0001) - greatest(share_base, 0.0001))
 * ln(greatest(share_recent, 0.0001)/greatest(share_base, 0.0001)) AS psi_term FROM shares)
{select}"""


PSI_TERMS = """SELECT bucket, round(share_base, 6) AS share_base, round(share_recent, 6) AS share_recent,
 round(psi_term, 6) AS psi_term FROM terms"""
STATUS = "CASE WHEN psi < 0.10 THEN 'green' WHEN psi < 0.25 THEN 'amber' ELSE 'red' END AS status"


def _drivers(spark, sf_dir):
    return with_drivers(scored_base(spark, sf_dir))


@query(
    "mix_by_month",
    scored(
        f"""
, cells AS (SELECT codmes, pd_r AS bucket, count(*) AS n, CAST(sum({MONEY_SQL}) AS DOUBLE) AS m
 FROM drivers WHERE def_at_origin = 0 GROUP BY 1, 2)
SELECT codmes, bucket, n, round(n/sum(n) OVER (PARTITION BY codmes), 6) AS share_n,
 round(m/sum(m) OVER (PARTITION BY codmes), 6) AS share_m FROM cells
""",
        DRIVERS_SQL,
    ),
)
def mix_by_month(spark, sf_dir):
    cfg = CFG.with_(universe="def_at_origin = 0")
    out = st.mix_by_month(_drivers(spark, sf_dir), cfg, ["pd_r"])
    return out.select("codmes", "bucket", "n", *r6("share_n", "share_m"))


@query("psi_count", scored(_psi_sql(["segment"], "1", PSI_TERMS), DRIVERS_SQL))
def psi_count(spark, sf_dir):
    out = st.psi_terms(_drivers(spark, sf_dir), CFG, ["segment"], BASE, RECENT)
    return out.select("bucket", *r6("share_base", "share_recent", "psi_term"))


@query("psi_amount", scored(_psi_sql(["amount_r"], MONEY_SQL, PSI_TERMS), DRIVERS_SQL))
def psi_amount(spark, sf_dir):
    out = st.psi_terms(_drivers(spark, sf_dir), CFG, ["amount_r"], BASE, RECENT, "m")
    return out.select("bucket", *r6("share_base", "share_recent", "psi_term"))


PSI_DRIVERS = ("segment", "job_type", "amount_r", "income_r", "score_r", "pd_r")


@query(
    "multi_driver_psi",
    scored(
        _psi_sql(
            PSI_DRIVERS, "1",
            f"""SELECT variable, buckets, round(psi, 6) AS psi, {STATUS}
FROM (SELECT variable, count(*) AS buckets, sum(psi_term) AS psi FROM terms GROUP BY variable)""",
        ),
        DRIVERS_SQL,
    ),
)
def multi_driver_psi(spark, sf_dir):
    out = st.psi(_drivers(spark, sf_dir), CFG, PSI_DRIVERS, BASE, RECENT)
    return out.select("variable", "buckets", *r6("psi"), "status")


@query(
    "evol_psi",
    scored(
        f"""
, long AS ({_long_sql(["pd_r", "job_type"], UNIVERSE)}),
months AS (SELECT DISTINCT variable, codmes FROM long WHERE codmes BETWEEN {RECENT[0]} AND {RECENT[1]}),
b AS (SELECT variable, bucket, CAST(count(*) FILTER (WHERE codmes BETWEEN {BASE[0]} AND {BASE[1]}) AS DOUBLE) AS b
 FROM long WHERE codmes BETWEEN {BASE[0]} AND {BASE[1]} OR codmes BETWEEN {RECENT[0]} AND {RECENT[1]} GROUP BY 1, 2),
r AS (SELECT variable, bucket, codmes, CAST(count(*) AS DOUBLE) AS r FROM long
 WHERE codmes BETWEEN {RECENT[0]} AND {RECENT[1]} GROUP BY 1, 2, 3),
s AS (SELECT m.variable, m.codmes,
  greatest(b.b / sum(b.b) OVER (PARTITION BY m.variable, m.codmes), 0.0001) AS p,
  greatest(coalesce(r.r, 0) / sum(r.r) OVER (PARTITION BY m.variable, m.codmes), 0.0001) AS q
 FROM months m JOIN b ON b.variable = m.variable
 LEFT JOIN r ON r.variable = m.variable AND r.codmes = m.codmes AND r.bucket = b.bucket)
SELECT variable, codmes, round(psi, 6) AS psi, {STATUS}
FROM (SELECT variable, codmes, sum((q-p)*ln(q/p)) AS psi FROM s GROUP BY 1, 2)
""",
        DRIVERS_SQL,
    ),
)
def evol_psi(spark, sf_dir):
    out = st.evol_psi(_drivers(spark, sf_dir), CFG, ["pd_r", "job_type"], BASE, RECENT)
    return out.select("variable", "codmes", *r6("psi"), "status")


# -- discrimination ----------------------------------------------------------


def gini_sql(source: str, targets, select: str) -> str:
    """``source`` has variable, window_end, score and t<k> columns, one row per application."""
    sums = ", ".join(f"CAST(sum(t{k}) AS DOUBLE) AS b{k}, CAST(sum(1-t{k}) AS DOUBLE) AS g{k}" for k in targets)
    run = ", ".join(
        f"sum(b{k}) OVER w AS cb{k}, sum(g{k}) OVER w AS cg{k}, sum(b{k}) OVER a AS tb{k}, sum(g{k}) OVER a AS tg{k}"
        for k in targets
    )
    out = ", ".join(
        f"2*sum(b{k}*(cg{k} - g{k}/2)/nullif(tb{k}*tg{k}, 0)) - 1 AS gini{k}, "
        f"max(abs(cb{k}/nullif(tb{k}, 0) - cg{k}/nullif(tg{k}, 0))) AS ks{k}"
        for k in targets
    )
    return f"""
, rows_ AS ({source}),
byscore AS (SELECT variable, window_end, score, {sums}, count(*) AS n FROM rows_ WHERE score IS NOT NULL GROUP BY 1, 2, 3),
run AS (SELECT *, {run} FROM byscore
 WINDOW w AS (PARTITION BY variable, window_end ORDER BY score), a AS (PARTITION BY variable, window_end)),
res AS (SELECT variable, window_end, CAST(sum(n) AS BIGINT) AS n, {out} FROM run GROUP BY 1, 2)
{select}"""


def _target_columns(targets) -> str:
    return ", ".join(f"CASE WHEN dist_def <= {k} THEN 1 ELSE 0 END AS t{k}" for k in targets)


WINDOW_IDX = "(r.window_end // 100)*12 + r.window_end % 100 - 1"


def _seen(targets) -> str:
    return ", ".join(
        f"round(CASE WHEN {WINDOW_IDX} <= {23995 + 24 - k} THEN {s}{k} END, 6) AS {s}{k}"
        for k in targets for s in ("gini", "ks")
    )


ALL_TARGETS = (24, 21, 18)


@query(
    "gini_ks_month",
    scored(
        gini_sql(
            f"SELECT 'pd' AS variable, codmes AS window_end, pd AS score, {_target_columns(ALL_TARGETS)} FROM scored WHERE {UNIVERSE}",
            ALL_TARGETS,
            f"SELECT window_end AS codmes, n, {_seen(ALL_TARGETS)} FROM res r",
        )
    ),
)
def gini_ks_month(spark, sf_dir):
    out = ds.evol_gini(scored_base(spark, sf_dir), CFG, "pd", ALL_TARGETS)
    return out.select("codmes", "n", *r6(*[f"{s}{k}" for k in ALL_TARGETS for s in ("gini", "ks")]))


def _moving_source(value: str, name: str, targets, months: int, start: int, end: int) -> str:
    return f"""SELECT '{name}' AS variable, e.codmes AS window_end, CAST({value} AS DOUBLE) AS score, {_target_columns(targets)}
 FROM (SELECT DISTINCT codmes, month_idx FROM scored WHERE codmes BETWEEN {start} AND {end}) e
 JOIN scored s ON s.month_idx BETWEEN e.month_idx - {months - 1} AND e.month_idx WHERE {UNIVERSE}"""


@query(
    "gini_moving",
    scored(
        gini_sql(
            _moving_source("pd", "pd", ALL_TARGETS, 6, 199601, 199908), ALL_TARGETS,
            f"""SELECT window_end AS codmes, n, {_seen(ALL_TARGETS)},
 CASE WHEN gini24 >= 0.5 THEN 'green' WHEN gini24 >= 0.4 THEN 'amber' ELSE 'red' END AS status FROM res r""",
        )
    ),
)
def gini_moving(spark, sf_dir):
    out = ds.evol_gini(
        scored_base(spark, sf_dir), CFG, "pd", ALL_TARGETS, start=199601, end=199908, months=6,
        moving=True, limits=(0.4, 0.5),
    )
    names = [f"{s}{k}" for k in ALL_TARGETS for s in ("gini", "ks")]
    return out.select("codmes", "n", *r6(*names), "status")


def _block_source(value: str, name: str, targets, months: int, start_idx: int, end_idx: int) -> str:
    end = f"least({start_idx} + ((month_idx - {start_idx}) // {months})*{months} + {months - 1}, {end_idx})"
    return f"""SELECT '{name}' AS variable, CAST(({end}) // 12 * 100 + ({end}) % 12 + 1 AS INT) AS window_end,
 {value} AS score, {_target_columns(targets)} FROM scored
 WHERE {UNIVERSE} AND month_idx BETWEEN {start_idx} AND {end_idx}"""


# 199501 has month index 23940, 199908 has 23995.
@query(
    "gini_blocks",
    scored(
        gini_sql(
            _block_source("score", "score", (24,), 5, 23940, 23995), (24,),
            "SELECT window_end AS codmes, n, round(gini24, 6) AS gini24, round(ks24, 6) AS ks24 FROM res",
        )
    ),
)
def gini_blocks(spark, sf_dir):
    out = ds.evol_gini(scored_base(spark, sf_dir), CFG, "score", (24,), start=199501, end=199908, months=5)
    return out.select("codmes", "n", *r6("gini24", "ks24"))


NUMERIC, CATEGORICAL = ("pd", "amount", "income"), ("segment", "job_type")


MULTI_SOURCE = " UNION ALL ".join(
    [_moving_source(c, c, (24,), 3, 199801, 199908) for c in NUMERIC]
    + [
        f"""SELECT '{c}' AS variable, e.codmes AS window_end, rate AS score, t24
 FROM (SELECT DISTINCT codmes, month_idx FROM scored WHERE codmes BETWEEN 199801 AND 199908) e
 JOIN (SELECT month_idx, t24, CAST(sum(t24) OVER (PARTITION BY {c}) AS DOUBLE) / count(*) OVER (PARTITION BY {c}) AS rate
  FROM (SELECT *, {_target_columns((24,))} FROM scored WHERE {UNIVERSE} AND codmes BETWEEN 199711 AND 199908)) s
 ON s.month_idx BETWEEN e.month_idx - 2 AND e.month_idx"""
        for c in CATEGORICAL
    ]
)


@query(
    "multi_driver_gini",
    scored(
        gini_sql(
            MULTI_SOURCE, (24,),
            "SELECT variable, window_end AS codmes, n, round(gini24, 6) AS gini24, round(ks24, 6) AS ks24 FROM res",
        )
    ),
)
def multi_driver_gini(spark, sf_dir):
    out = ds.multi_driver_gini(
        stored_base(spark, sf_dir), CFG, NUMERIC, CATEGORICAL, (24,), start=199801, end=199908,
        months=3, moving=True,
    )
    return out.select("variable", "codmes", "n", *r6("gini24", "ks24"))


# 199801 has month index 23976; blocks of three months until 199811.
PERIODS = (199803, 199806, 199809, 199811)


@query(
    "discrimination_table",
    scored(
        gini_sql(
            " UNION ALL ".join(_block_source(c, c, (24,), 3, 23976, 23986) for c in ("pd", "amount", "income")),
            (24,),
            "SELECT variable, "
            + ", ".join(f"round(max(CASE WHEN window_end = {p} THEN gini24 END), 6) AS p{p}" for p in PERIODS)
            + " FROM res GROUP BY variable",
        )
    ),
)
def discrimination_table(spark, sf_dir):
    out = ds.discrimination_table(
        scored_base(spark, sf_dir), CFG, ("pd", "amount", "income"), 199801, 199811, 3
    )
    return out.select("variable", *r6(*[f"p{p}" for p in PERIODS]))


# The amount view: every application counts as much as its amount.


def gini_amount_sql(source: str, targets, select: str) -> str:
    """As ``gini_sql``, over rows that also have ``w``; pairs of rows are compared one by one per score."""
    sums = ", ".join(f"sum(t{k}*w) AS b{k}, sum(w) - sum(t{k}*w) AS g{k}" for k in targets)
    out = ", ".join(
        f"""2*(SELECT sum(CAST(x.b{k} AS DOUBLE)*(CASE WHEN x.score > y.score THEN 1 WHEN x.score = y.score THEN 0.5 ELSE 0 END)*CAST(y.g{k} AS DOUBLE))
   FROM byscore x JOIN byscore y ON x.variable = y.variable AND x.window_end = y.window_end
   WHERE x.variable = t.variable AND x.window_end = t.window_end)
  /nullif(CAST(sum(b{k}) AS DOUBLE)*CAST(sum(g{k}) AS DOUBLE), 0) - 1 AS gini{k}"""
        for k in targets
    )
    run = ", ".join(f"sum(CAST(b{k} AS DOUBLE)) OVER w AS cb{k}, sum(CAST(g{k} AS DOUBLE)) OVER w AS cg{k}" for k in targets)
    ks = ", ".join(
        f"max(abs(cb{k}/nullif(tb{k}, 0) - cg{k}/nullif(tg{k}, 0))) AS ks{k}" for k in targets
    )
    tot = ", ".join(f"sum(CAST(b{k} AS DOUBLE)) OVER a AS tb{k}, sum(CAST(g{k} AS DOUBLE)) OVER a AS tg{k}" for k in targets)
    return f"""
, rows_ AS ({source}),
byscore AS (SELECT variable, window_end, score, {sums}, count(*) AS n, sum(w) AS w FROM rows_ WHERE score IS NOT NULL GROUP BY 1, 2, 3),
ginis AS (SELECT variable, window_end, CAST(sum(n) AS BIGINT) AS n, CAST(sum(w) AS DOUBLE) AS amount, {out} FROM byscore t GROUP BY 1, 2),
run AS (SELECT *, {run}, {tot} FROM byscore
 WINDOW w AS (PARTITION BY variable, window_end ORDER BY score), a AS (PARTITION BY variable, window_end)),
kss AS (SELECT variable, window_end, {ks} FROM run GROUP BY 1, 2),
res AS (SELECT * FROM ginis JOIN kss USING (variable, window_end))
{select}"""


def _with_amount(source: str) -> str:
    """A source of scored rows that also gives the amount as weight."""
    return source.replace(" AS score,", " AS score, CAST(amount AS DECIMAL(18,2)) AS w,")


@query(
    "gini_amount_month",
    scored(
        gini_amount_sql(
            _with_amount(
                f"SELECT 'pd' AS variable, codmes AS window_end, pd AS score, {_target_columns(ALL_TARGETS)} "
                f"FROM scored WHERE {UNIVERSE}"
            ),
            ALL_TARGETS,
            f"SELECT window_end AS codmes, n, round(amount, 2) AS amount, {_seen(ALL_TARGETS)} FROM res r",
        )
    ),
)
def gini_amount_month(spark, sf_dir):
    out = ds.evol_gini(scored_base(spark, sf_dir), CFG, "pd", ALL_TARGETS, view="m")
    names = [f"{s}{k}" for k in ALL_TARGETS for s in ("gini", "ks")]
    return out.select("codmes", "n", F.round("amount", 2).alias("amount"), *r6(*names))


AMOUNT_SOURCE = " UNION ALL ".join(
    [_with_amount(_moving_source(c, c, (24,), 3, 199801, 199808)) for c in ("pd", "income")]
    + [
        f"""SELECT '{c}' AS variable, e.codmes AS window_end, rate AS score, w, t24
 FROM (SELECT DISTINCT codmes, month_idx FROM scored WHERE codmes BETWEEN 199801 AND 199808) e
 JOIN (SELECT month_idx, t24, w, CAST(sum(t24*w) OVER (PARTITION BY {c}) AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY {c}) AS DOUBLE) AS rate
  FROM (SELECT *, CAST(amount AS DECIMAL(18,2)) AS w, {_target_columns((24,))} FROM scored
   WHERE {UNIVERSE} AND codmes BETWEEN 199711 AND 199808)) s
 ON s.month_idx BETWEEN e.month_idx - 2 AND e.month_idx"""
        for c in CATEGORICAL
    ]
)


@query(
    "multi_driver_gini_amount",
    scored(
        gini_amount_sql(
            AMOUNT_SOURCE, (24,),
            "SELECT variable, window_end AS codmes, n, round(gini24, 6) AS gini24, round(ks24, 6) AS ks24 FROM res",
        )
    ),
)
def multi_driver_gini_amount(spark, sf_dir):
    out = ds.multi_driver_gini(
        stored_base(spark, sf_dir), CFG, ("pd", "income"), CATEGORICAL, (24,), start=199801, end=199808,
        months=3, moving=True, view="m",
    )
    return out.select("variable", "codmes", "n", *r6("gini24", "ks24"))


@query(
    "discrimination_table_amount",
    scored(
        gini_amount_sql(
            " UNION ALL ".join(_with_amount(_block_source(c, c, (24,), 3, 23976, 23986)) for c in ("pd", "income")),
            (24,),
            "SELECT variable, "
            + ", ".join(f"round(max(CASE WHEN window_end = {p} THEN ks24 END), 6) AS p{p}" for p in PERIODS)
            + " FROM res GROUP BY variable",
        )
    ),
)
def discrimination_table_amount(spark, sf_dir):
    out = ds.discrimination_table(
        scored_base(spark, sf_dir), CFG, ("pd", "income"), 199801, 199811, 3, measure="ks", view="m"
    )
    return out.select("variable", *r6(*[f"p{p}" for p in PERIODS]))


# -- summaries kept from run to run ------------------------------------------

LATE = 200007


def _kept(spark, sf_dir) -> tuple[SummaryStore, list]:
    """Summaries of a base that came in two deliveries; the second also rewrote one month."""
    base, path = tb.work_dir(spark, "base"), tb.work_dir(spark, "summaries")
    rows = stored_base(spark, sf_dir)
    kept = SummaryStore(spark, path, CFG, SummarySpec(CATEGORICAL, ("pd", "income"), (*ALL_TARGETS, 12)))
    first = rows.filter(F.col("codmes") < LATE)
    # 199503 is not complete yet.
    first.filter("codmes <> 199503 OR app_id % 2 = 0").write.partitionBy("codmes").parquet(base)
    steps = [kept.refresh(base)]
    later = rows.filter((F.col("codmes") >= LATE) | (F.col("codmes") == 199503))
    later.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("codmes").parquet(base)
    steps.append(kept.refresh(base))
    return kept, steps


@query(
    "incremental_calibration",
    scored(
        """
SELECT codmes, n, m AS amount, round(pd_n/n, 6) AS pd, round(factor, 6) AS factor, round(rd_proj, 6) AS rd_proj,
 CASE WHEN codmes >= 200007 OR codmes = 199503 THEN 2 ELSE 1 END AS refresh FROM proj
""",
        SUMS, projection_sql("proj", "sums", "n"),
    ),
)
def incremental_calibration(spark, sf_dir):
    """Calibration from stored months, with the refresh that read each of them."""
    kept, steps = _kept(spark, sf_dir)
    again = [int(m) for m in steps[1].read]
    out = cal.evol_from_sums(cal.roll_up(kept.table("sums"), (), "codmes"), CFG)
    return out.select(
        "codmes", "n", "amount", *r6("pd", "factor", "rd_proj"),
        F.when(F.col("codmes").isin(again), 2).otherwise(1).alias("refresh"),
    )


@query(
    "incremental_gini",
    scored(
        gini_sql(
            " UNION ALL ".join(
                [_moving_source(c, c, (24,), 3, 199801, 199908) for c in ("pd", "income")]
                + MULTI_SOURCE.split(" UNION ALL ")[len(NUMERIC):]
            ),
            (24,),
            "SELECT variable, window_end AS codmes, n, round(gini24, 6) AS gini24, round(ks24, 6) AS ks24 FROM res",
        )
    ),
)
def incremental_gini(spark, sf_dir):
    """Gini of many drivers from stored score counts and driver cells."""
    kept, _ = _kept(spark, sf_dir)
    cells = cal.roll_up(kept.table("cells"), ("variable", "bucket"), "codmes")
    out = ds.gini_from_counts(
        kept.table("scores"), CFG, (24,), 199801, 199908, 3, True, cells=cells
    )
    return out.select("variable", "codmes", "n", *r6("gini24", "ks24"))


# -- reporting cube ----------------------------------------------------------

AXES = {
    "job_type": "eje_p1", "segment": "eje_p2", "codyear": "eje_p3", "score_r": "eje_p4", "pd_r": "eje_p5",
    "amount_r": "eje_s1", "income_r": "eje_s2", "quarter": "eje_s3", "half": "eje_s4", "accept": "eje_s5",
    "flg_high": "eje_s6", "miss_pd": "eje_s7", "zone": "eje_s8", "income_sign": "eje_s9", "job_group": "eje_s10",
    "flg_amount_r": "eje_s11", "flg_low_score": "eje_s12", "flg_low_pd": "eje_s13", "flg_small": "eje_s14",
    "season": "eje_s15", "tiered": "eje_s16",
}
AXIS_LABELS = {
    "eje_p1": "Job type", "eje_p2": "Segment", "eje_p3": "Year", "eje_p4": "Score range", "eje_p5": "PD range",
    "eje_s1": "Amount range", "eje_s2": "Income range", "eje_s3": "Quarter", "eje_s4": "Half year",
    "eje_s5": "Accepted", "eje_s6": "High amount", "eje_s7": "PD missing", "eje_s8": "Zone",
    "eje_s9": "Income sign", "eje_s10": "Job group", "eje_s11": "Amount flag", "eje_s12": "Low score",
    "eje_s13": "Low PD", "eje_s14": "Small amount", "eje_s15": "Season", "eje_s16": "Accepted by tier",
}
PDS = ("pd", "pd_alt", "pd_bureau", "pd", "pd", "pd", "pd", "pd", "pd", "pd")

CUBE_BASE_SQL = """cube_base AS (SELECT d.*, ult_rd, seg_proy,
 substr(CAST(d.codmes AS VARCHAR), 1, 4) AS codyear, 'Q' || CAST((d.codmes % 100 + 2) // 3 AS VARCHAR) AS quarter,
 'H' || CAST((d.codmes % 100 + 5) // 6 AS VARCHAR) AS half,
 CASE WHEN d.score >= 335 THEN 1 ELSE 0 END AS accept, CASE WHEN d.amount >= 400000 THEN 1 ELSE 0 END AS flg_high,
 CASE WHEN d.xb IS NULL THEN 1 ELSE 0 END AS miss_pd,
 CASE WHEN d.job_type LIKE '%BUILD%' THEN 'Site' ELSE 'Elsewhere' END AS zone,
 CASE WHEN d.income < 0 THEN '1. Negative' ELSE '2. Positive' END AS income_sign,
 CASE d.job_type WHEN 'BUILDING' THEN '1. Building' WHEN 'MACHINERY' THEN '2. Machinery' ELSE '98. N.A.' END AS job_group,
 CASE WHEN d.amount >= 325000 THEN '1. >=325,000' ELSE '2. <325,000' END AS flg_amount_r,
 CASE WHEN d.score < 320 THEN 1 ELSE 0 END AS flg_low_score, CASE WHEN d.pd <= 0.02 THEN 1 ELSE 0 END AS flg_low_pd,
 CASE WHEN d.amount <= 50000 THEN 1 ELSE 0 END AS flg_small,
 CASE WHEN d.codmes % 100 IN (12, 1, 2) THEN 'peak' ELSE 'usual' END AS season,
 CASE WHEN d.score >= 335 AND d.segment = '1. Affluent' THEN 1
  WHEN d.score >= 365 AND d.segment IN ('2. Consumer', '3. Rest') THEN 1 ELSE 0 END AS tiered,
 1/(1+exp(-(d.xb+0.25))) AS pd_alt, 1/(1+exp(-((174.25 - d.amount/1000)/57.708))) AS pd_bureau
 FROM drivers d JOIN seg_scored s ON s.app_id = d.app_id WHERE d.def_at_origin = 0 AND d.xb IS NOT NULL)"""


def _cube_sql() -> str:
    keys = ["c.codmes", "c.seg_proy"]
    flags = {
        "flg_diagnosis": "c.codmes BETWEEN 199909 AND 200002", "flg_recent": "c.codmes BETWEEN 200005 AND 200007",
        "flg_closed": "c.codmes <= 199908", "flg_temp": "c.codmes <= 199911", "flg_early": "c.codmes <= 200008",
    }
    keys += [f"CASE WHEN {p} THEN 1 ELSE 0 END AS {n}" for n, p in flags.items()]
    keys += ["c.segment AS eje_tooltip"] + [f"c.{k} AS {a}" for k, a in AXES.items()]
    out = []
    for view, w, kind in (("xm", "c.amount", "amounts"), ("xn", "1", "accounts")):
        out += [f"sum(c.{p} * {w}) AS pd_{i:02d}_{view}" for i, p in enumerate(PDS, 1)]
        out.append(f"sum({MONEY_SQL.replace('amount', 'c.amount')}) AS m" if view == "xm" else "count(*) AS n")
        for name, last, h in (("closed", 199908, 24), ("temp", 199911, 21), ("early", 200008, 12)):
            out.append(
                f"sum(CASE WHEN c.codmes > {last} THEN 0 ELSE CASE WHEN dist_def <= {h} THEN {w} ELSE 0 END END) AS def_{name}_{view}"
            )
        for source, value in (("factor", f"c.ult_rd * factor_{kind}"), ("value", f"projection_{kind}")):
            for tag, lo, hi in (("dt", 199909, 200002), ("mt", 200003, 200005)):
                out.append(
                    f"sum(CASE WHEN c.codmes BETWEEN {lo} AND {hi} THEN {value} * {w} ELSE 0 END) AS proj_{source}_{tag}_{view}"
                )
    return f"""cube AS (SELECT {', '.join(keys)}, {', '.join(out)}
 FROM cube_base c LEFT JOIN factors f ON f.codmes = c.codmes AND f.seg_proy = c.seg_proy GROUP BY ALL)"""


CUBE_VIEWS = (DRIVERS_SQL, *FACTOR_VIEWS, SEG_SCORED_SQL, CUBE_BASE_SQL, _cube_sql())
CUBE_KEYS = ("codmes", "seg_proy", *cb.FLAGS, "eje_tooltip", *AXES.values())
MEASURES = cb.measure_names(PDS)


def _rounded_sql(measures=MEASURES) -> str:
    return ", ".join(
        "n" if c == "n" else f"round(CAST({c} AS DOUBLE), {2 if c.endswith('m') else 4}) AS {c}" for c in measures
    )


def _rounded(df, measures=MEASURES):
    return [
        F.col(c) if c == "n" else F.round(F.col(c).cast("double"), 2 if c.endswith("m") else 4).alias(c)
        for c in measures
    ]


def _cube_base(base):
    df = calendar(with_drivers(CFG.select_universe(base)))
    df = df.withColumns(
        {
            "seg_proy": cohorts.segment_id("segment", SEGMENT_IDS),
            "accept": bk.flag(F.col("score") >= 335),
            "flg_high": bk.flag(F.col("amount") >= 400_000),
            "miss_pd": bk.flag(F.col("xb").isNull()),
            "zone": bk.contains_class("job_type", "BUILD", "Site", "Elsewhere"),
            "income_sign": F.when(F.col("income") < 0, "1. Negative").otherwise("2. Positive"),
            "job_group": bk.recode(
                "job_type", {"BUILDING": "1. Building", "MACHINERY": "2. Machinery"}, default="98. N.A."
            ),
            "flg_amount_r": F.when(F.col("amount") >= 325_000, "1. >=325,000").otherwise("2. <325,000"),
            "flg_low_score": bk.flag(F.col("score") < 320),
            "flg_low_pd": bk.flag(F.col("pd") <= 0.02),
            "flg_small": bk.flag(F.col("amount") <= 50_000),
            "season": F.when(F.expr("codmes % 100 IN (12, 1, 2)"), "peak").otherwise("usual"),
            "tiered": bk.tiered_accept(
                "score", "segment", {"1. Affluent": 335, "2. Consumer": 365, "3. Rest": 365}
            ),
            "xb_alt": F.col("xb") + 0.25,
            "xb_bureau": F.expr("(174.25 - amount / 1000) / 57.708"),
        }
    )
    return with_pds(df, {"xb_alt": "pd_alt", "xb_bureau": "pd_bureau"})


def cube(spark, sf_dir):
    base = stored_base(spark, sf_dir)
    return cb.reporting_cube(_cube_base(base), CFG, AXES, PDS, factors(base))


@query("reporting_cube", scored(f"SELECT {', '.join(CUBE_KEYS)}, {_rounded_sql()} FROM cube", *CUBE_VIEWS))
def reporting_cube(spark, sf_dir):
    out = cube(spark, sf_dir)
    return out.select(*CUBE_KEYS, *_rounded(out))


LONG_KEYS = ("codmes", "seg_proy", "flg_closed")
LONG_MEASURES = ("m", "n", "pd_01_xm", "pd_01_xn", "def_closed_xm", "def_closed_xn")


@query(
    "reporting_cube_long",
    scored(
        ", long AS ("
        + " UNION ALL ".join(
            f"SELECT {', '.join(LONG_KEYS)}, '{a}' AS axis, CAST({a} AS VARCHAR) AS label, {', '.join(LONG_MEASURES)} FROM cube"
            for a in AXES.values()
        )
        + f"""), agg AS (SELECT {', '.join(LONG_KEYS)}, axis, label, sum(m) AS m, CAST(sum(n) AS BIGINT) AS n,
 {', '.join(f'sum({c}) AS {c}' for c in LONG_MEASURES[2:])} FROM long GROUP BY ALL)
SELECT {', '.join(LONG_KEYS)}, axis, label, {_rounded_sql(LONG_MEASURES)} FROM agg""",
        *CUBE_VIEWS,
    ),
)
def reporting_cube_long(spark, sf_dir):
    long = cb.cube_long(cube(spark, sf_dir), list(AXES.values()), LONG_MEASURES, LONG_KEYS)
    return long.select(*LONG_KEYS, "axis", "label", *_rounded(long, LONG_MEASURES))


@query(
    "axis_labels",
    scored(
        ", long AS ("
        + " UNION ALL ".join(f"SELECT '{a}' AS axis, CAST({a} AS VARCHAR) AS label, n FROM cube" for a in AXES.values())
        + "), names AS (SELECT * FROM (VALUES "
        + ", ".join(f"('{a}', '{t}')" for a, t in AXIS_LABELS.items())
        + """) t(axis, title))
SELECT names.axis, names.title, count(DISTINCT label) AS buckets, CAST(sum(n) AS BIGINT) AS n
FROM names LEFT JOIN long ON long.axis = names.axis GROUP BY 1, 2""",
        *CUBE_VIEWS,
    ),
)
def axis_labels(spark, sf_dir):
    labels = tb.label_table(spark, list(AXIS_LABELS.items()), ["axis", "title"])
    return cb.label_usage(cube(spark, sf_dir), list(AXES.values()), labels).select("axis", "title", "buckets", "n")


STORED = ("eje_tooltip", "eje_p1", "eje_p5", "seg_proy", "m", "n", "pd_01_xn", "def_closed_xn", "proj_factor_dt_xn")


def _stored_sql() -> str:
    return scored(
        "SELECT codmes, eje_tooltip, eje_p1, eje_p5, seg_proy, " + _rounded_sql(STORED[4:]) + " FROM cube", *CUBE_VIEWS
    )


@query("cube_roundtrip", _stored_sql())
def cube_roundtrip(spark, sf_dir):
    path = tb.work_dir(spark, "cube")
    tb.write_partitioned(cube(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.select("codmes", *STORED[:4], *_rounded(back, STORED[4:]))


@query("export_csv", _stored_sql())
def export_csv(spark, sf_dir):
    path = tb.work_dir(spark, "export")
    out = cube(spark, sf_dir).select("codmes", *STORED)
    tb.write_extract(out, path, sep=",", compression="gzip")
    back = tb.read_extract(spark, path, out.schema, sep=",")
    return back.select("codmes", *STORED[:4], *_rounded(back, STORED[4:]))


PUBLISHED = {c: fx.PUBLISHED_NAMES[c] for c in ("month_def", "seg_proy", *FACTOR_COLUMNS)}


@query(
    "publish_roundtrip",
    scored(
        "SELECT codmes, month_def AS " + PUBLISHED["month_def"] + ", seg_proy AS " + PUBLISHED["seg_proy"] + ", "
        + ", ".join(f"round({c}, 6) AS {PUBLISHED[c]}" for c in FACTOR_COLUMNS) + " FROM factors",
        *FACTOR_VIEWS,
    ),
)
def publish_roundtrip(spark, sf_dir):
    """The factor table replaced in the catalog under its published names and read back."""
    named = factors(scored_base(spark, sf_dir)).withColumnsRenamed(PUBLISHED)
    table = f"published_factors_{uuid.uuid4().hex}"
    tb.save_table(named, table, tb.work_dir(spark, "published"))
    back = spark.table(table)
    return back.select("codmes", PUBLISHED["month_def"], PUBLISHED["seg_proy"], *r6(*[PUBLISHED[c] for c in FACTOR_COLUMNS]))
