"""Registered queries: calibration, projection, cohort factors and bands."""

from __future__ import annotations

from scoremon.operators import bands
from scoremon.operators import calibration as cal
from scoremon.operators import cohorts
from scoremon.operators import projection as pj
from scoremon.operators import settings as st
from scoremon.plans.oracle import scored
from scoremon.plans.registry import query
from scoremon.plans.setup import ALL_ROWS, CFG, DRIVERS_SQL, RUN_MONTH, SEGMENT_IDS, r6, with_drivers
from scoremon.sources.tables import store
from scoremon.sources.views import scored_base, stored_base

UNIVERSE = "def_at_origin = 0 AND xb IS NOT NULL"
HORIZONS = (1, 2, 3, 12, 16, 17, 18, 19, 20, 21, 22, 23, 24)
# Newest closed cohort 199908 has month index 23995.
CLOSED = 23995
# Open cohort (months after the closed one) -> usable horizon.
OPEN = ((1, 23), (2, 22), (3, 22), (4, 21), (5, 20), (6, 19))


# -- oracle pieces -----------------------------------------------------------


def sums_sql(name: str, source: str, predicate: str, by: str = "") -> str:
    keys = f"{by}, codmes, month_idx" if by else "codmes, month_idx"
    d = ",\n ".join(
        f"CAST(sum(CASE WHEN dist_def<={k} THEN 1 ELSE 0 END) AS DOUBLE) AS d{k}_n, "
        f"CAST(sum(CASE WHEN dist_def<={k} THEN CAST(amount AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS d{k}_m"
        for k in HORIZONS
    )
    return f"""{name} AS (SELECT {keys}, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS m,
 sum(pd) AS pd_n, sum(pd*amount) AS pd_m, {d}
 FROM {source} WHERE {predicate} GROUP BY {keys})"""


def projection_sql(name: str, sums: str, view: str, method: str = "met1", by: str = "") -> str:
    """Long-form growth history, then one row per open cohort."""
    key = f"{by}, " if by else ""
    history = " UNION ALL ".join(
        f"SELECT {key}{h} AS h, month_idx, d24_{view}/nullif(d{h}_{view}, 0) AS r FROM {sums} "
        f"WHERE month_idx BETWEEN {CLOSED - 13} AND {CLOSED}"
        for h in sorted({h for _, h in OPEN})
    )
    usable = "CASE " + " ".join(
        f"WHEN s.month_idx = {CLOSED + j} THEN d{h}_{view}" for j, h in OPEN
    ) + f" END / nullif({view}, 0)"
    pick_h = "CASE " + " ".join(f"WHEN s.month_idx = {CLOSED + j} THEN {h}" for j, h in OPEN) + " END"
    factor = {
        "met1": "g.q75",
        "met2": "(g.q75 + g.q50)/2",
        "met3": "g.icept + g.slope*s.month_idx",
    }[method]
    same = f" AND g.{by} = s.{by}" if by else ""
    group = f"GROUP BY {key}h"
    return f"""{name} AS (SELECT s.*, {usable} AS rd_usable, {factor} AS factor, ({usable})*({factor}) AS rd_proj
 FROM {sums} s LEFT JOIN (SELECT {key}h, quantile_cont(r, 0.75) AS q75, quantile_cont(r, 0.5) AS q50,
   regr_slope(r, month_idx) AS slope, regr_intercept(r, month_idx) AS icept FROM ({history}) {group}) g
 ON g.h = {pick_h}{same})"""


def open_only(name: str) -> str:
    return f"FROM {name} WHERE month_idx BETWEEN {CLOSED + 1} AND {CLOSED + 6}"


SUMS = sums_sql("sums", "scored", UNIVERSE)
SEG_SUMS = sums_sql("seg_sums", "scored", UNIVERSE, "segment")


# -- validation cube ---------------------------------------------------------


@query(
    "monthly_calibration",
    scored(
        """
SELECT codmes, count(*) AS n,
 CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)/1000000 AS amount_mm,
 round(sum(pd)/count(*), 6) AS pd_mean,
 round(CAST(sum(CASE WHEN dist_def<=24 THEN 1 ELSE 0 END) AS DOUBLE)/count(*), 6) AS rd24,
 round(CAST(sum(CASE WHEN dist_def<=18 THEN 1 ELSE 0 END) AS DOUBLE)/count(*), 6) AS rd18,
 CAST(sum(CASE WHEN dist_def<=24 THEN 1 ELSE 0 END) AS BIGINT) AS def24
FROM scored WHERE def_at_origin = 0 GROUP BY codmes
"""
    ),
)
def monthly_calibration(spark, sf_dir):
    base = scored_base(spark, sf_dir).filter("def_at_origin = 0")
    return cal.monthly_calibration(base, ALL_ROWS).select(
        "codmes", "n", "amount_mm", *r6("pd_mean", "rd24", "rd18"), "def24"
    )


# -- calibration over time ---------------------------------------------------


def _evol_sql(view: str) -> str:
    return f"""
SELECT codmes, n, m AS amount, round(pd_{view}/{view}, 6) AS pd,
 round(CASE WHEN month_idx <= {CLOSED} THEN d24_{view}/{view} END, 6) AS rd24,
 round(CASE WHEN month_idx <= {CLOSED + 3} THEN d21_{view}/{view} END, 6) AS rd21,
 round(CASE WHEN month_idx <= {CLOSED + 12} THEN d12_{view}/{view} END, 6) AS rd12,
 round(CASE WHEN month_idx <= {CLOSED + 21} THEN d3_{view}/{view} END, 6) AS early3,
 round(factor, 6) AS factor, round(rd_proj, 6) AS rd_proj
FROM proj
"""


def _evol(spark, sf_dir, view):
    out = cal.evol_calibration(scored_base(spark, sf_dir), CFG, view, use="codmes >= 199601")
    return out.select(
        "codmes", "n", "amount", *r6("pd", "rd24", "rd21", "rd12", "early3", "factor", "rd_proj")
    )


RECENT_SUMS = sums_sql("sums", "scored", UNIVERSE + " AND codmes >= 199601")


@query("evol_calibration_n", scored(_evol_sql("n"), RECENT_SUMS, projection_sql("proj", "sums", "n")))
def evol_calibration_n(spark, sf_dir):
    return _evol(spark, sf_dir, "n")


@query("evol_calibration_m", scored(_evol_sql("m"), RECENT_SUMS, projection_sql("proj", "sums", "m")))
def evol_calibration_m(spark, sf_dir):
    return _evol(spark, sf_dir, "m")


@query(
    "window_mean",
    scored(
        """
SELECT round(avg(pd_m/m), 6) AS pd, round(avg(rd_proj), 6) AS rd_proj
FROM proj WHERE codmes BETWEEN 199909 AND 200002
""",
        SUMS, projection_sql("proj", "sums", "m"),
    ),
)
def window_mean(spark, sf_dir):
    monthly = cal.evol_calibration(scored_base(spark, sf_dir), CFG, "m")
    return cal.window_mean(monthly, ["pd", "rd_proj"], 199909, 200002).select(*r6("pd", "rd_proj"))


# -- projection --------------------------------------------------------------


def projected(base, view="n", method="met1", by=()):
    base = CFG.select_universe(base)
    sums = cal.cohort_sums(base, CFG.with_(pds=()), [24, *CFG.usable.values()], by)
    return pj.with_projection(sums, CFG, view, method, by)


def _register_method(method: str) -> None:
    text = "SELECT codmes, round(rd_usable, 6) AS rd_usable, round(factor, 6) AS factor, round(rd_proj, 6) AS rd_proj "

    @query(
        f"projection_{method}",
        scored(text + open_only("proj"), SUMS, projection_sql("proj", "sums", "n", method)),
    )
    def run(spark, sf_dir):
        out = pj.open_cohorts(projected(scored_base(spark, sf_dir), "n", method), CFG)
        return out.select("codmes", *r6("rd_usable", "factor", "rd_proj"))


for _m in pj.METHODS:
    _register_method(_m)


EARLY_CFG = CFG.with_(
    closed_month=200105, target=3, usable={1: 2, 2: 1}, open_months=2
)


@query(
    "projection_early",
    scored(
        """
, e AS (SELECT codmes, month_idx, count(*) AS n,
  CAST(sum(CASE WHEN dist_def<=1 THEN 1 ELSE 0 END) AS DOUBLE) AS d1,
  CAST(sum(CASE WHEN dist_def<=2 THEN 1 ELSE 0 END) AS DOUBLE) AS d2,
  CAST(sum(CASE WHEN dist_def<=3 THEN 1 ELSE 0 END) AS DOUBLE) AS d3
 FROM scored WHERE def_at_origin = 0 AND xb IS NOT NULL GROUP BY 1, 2),
h AS (SELECT quantile_cont(d3/nullif(d1,0), 0.75) AS f1, quantile_cont(d3/nullif(d2,0), 0.75) AS f2
 FROM e WHERE month_idx BETWEEN 24016-13 AND 24016)
SELECT codmes, round(CASE WHEN month_idx = 24017 THEN f2 ELSE f1 END, 6) AS factor,
 round(CASE WHEN month_idx = 24017 THEN d2/n*f2 ELSE d1/n*f1 END, 6) AS rd_proj
FROM e, h WHERE month_idx IN (24017, 24018)
"""
    ),
)
def projection_early(spark, sf_dir):
    base = CFG.select_universe(scored_base(spark, sf_dir))
    sums = cal.cohort_sums(base, EARLY_CFG.with_(pds=()), [1, 2, 3])
    out = pj.open_cohorts(pj.with_projection(sums, EARLY_CFG), EARLY_CFG)
    return out.select("codmes", *r6("factor", "rd_proj"))


OVERRIDES = [(199909, "add", 0.005), (199911, "set", 0.005), (200001, "set", 0.25)]


@query(
    "projection_override",
    scored(
        """
, fixed AS (SELECT *, CASE codmes WHEN 199909 THEN rd_proj + 0.005 WHEN 199911 THEN 0.005
  WHEN 200001 THEN 0.25 ELSE rd_proj END AS rd_new FROM proj)
SELECT codmes, round(CASE WHEN codmes IN (199909, 199911, 200001) THEN rd_new/nullif(rd_usable, 0) ELSE factor END, 6) AS factor,
 round(rd_new, 6) AS rd_proj """ + open_only("fixed"),
        SUMS, projection_sql("proj", "sums", "n"),
    ),
)
def projection_override(spark, sf_dir):
    table = spark.createDataFrame(OVERRIDES, "codmes INT, op STRING, value DOUBLE")
    out = pj.override_projection(pj.open_cohorts(projected(scored_base(spark, sf_dir)), CFG), table)
    return out.select("codmes", *r6("factor", "rd_proj"))


@query(
    "projection_smooth",
    scored(
        """
, o AS (SELECT * """ + open_only("proj") + """)
SELECT segment, codmes, round(avg(rd_proj) OVER (PARTITION BY segment ORDER BY month_idx
 ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS rd_proj FROM o
""",
        SEG_SUMS, projection_sql("proj", "seg_sums", "n", by="segment"),
    ),
)
def projection_smooth(spark, sf_dir):
    rows = pj.open_cohorts(projected(scored_base(spark, sf_dir), by=("segment",)), CFG)
    return pj.smooth_projection(rows, 3, by=("segment",)).select("segment", "codmes", *r6("rd_proj"))


@query(
    "projection_smooth_gaps",
    scored(
        """
, o AS (SELECT * """ + open_only("proj") + """ AND codmes <> 199911 AND NOT (segment = '3. Rest' AND codmes = 200001))
SELECT segment, codmes, round((SELECT avg(b.rd_proj) FROM o b
 WHERE b.segment = a.segment AND b.month_idx BETWEEN a.month_idx - 1 AND a.month_idx + 1), 6) AS rd_proj FROM o a
""",
        SEG_SUMS, projection_sql("proj", "seg_sums", "n", by="segment"),
    ),
)
def projection_smooth_gaps(spark, sf_dir):
    """Smoothing where months are missing: only neighbours by the calendar count."""
    rows = pj.open_cohorts(projected(scored_base(spark, sf_dir), by=("segment",)), CFG)
    rows = rows.filter("codmes <> 199911 AND NOT (segment = '3. Rest' AND codmes = 200001)")
    return pj.smooth_projection(rows, 3, by=("segment",)).select("segment", "codmes", *r6("rd_proj"))


@query(
    "portfolio_projection",
    scored(
        "SELECT codmes, count(rd_proj) AS segments, round(sum(rd_proj*m)/sum(CASE WHEN rd_proj IS NOT NULL THEN m END), 6) AS rd_proj "
        + open_only("proj") + " GROUP BY codmes",
        SEG_SUMS, projection_sql("proj", "seg_sums", "m", by="segment"),
    ),
)
def portfolio_projection(spark, sf_dir):
    rows = pj.open_cohorts(projected(scored_base(spark, sf_dir), "m", by=("segment",)), CFG)
    return pj.portfolio_projection(rows, "m").select("codmes", "segments", *r6("rd_proj"))


# -- settings per segment, view and target -----------------------------------

# Newest closed cohort of the early target, 21 months after that of the default.
EARLY_CLOSED = CLOSED + 21
SETTINGS = [
    (None, "n", "def", "met1", 14, 1), (None, "m", "def", "met2", 10, 3), (None, "n", "early", "met3", 12, 1),
    (None, "m", "early", "met1", 8, 2), ("1. Affluent", "n", "def", "met3", 6, 1), ("3. Rest", "m", "early", "met2", 20, 1),
]


def _settings_sql(sums: str, rows, by: str) -> str:
    """One row of settings at a time: history, factor by its method, smoothed projection."""
    parts = []
    for segment, view, target, method, depth, width in rows:
        closed, goal, open_ = (
            (CLOSED, 24, OPEN) if target == "def" else (EARLY_CLOSED, 3, ((1, 2), (2, 1)))
        )
        own = [r[0] for r in rows if r[0] is not None and r[1:3] == (view, target)]
        which = "TRUE"
        if by and segment is not None:
            which = f"{by} = '{segment}'"
        elif by and own:
            which = f"{by} NOT IN ({', '.join(repr(x) for x in own)})"
        same = f"AND h.{by} = s.{by}" if by else ""
        for j, k in open_:
            ratio = f"h.d{goal}_{view}/nullif(h.d{k}_{view}, 0)"
            factor = {
                "met1": f"quantile_cont({ratio}, 0.75)",
                "met2": f"(quantile_cont({ratio}, 0.75) + quantile_cont({ratio}, 0.5))/2",
                "met3": f"regr_intercept({ratio}, h.month_idx) + regr_slope({ratio}, h.month_idx)*s.month_idx",
            }[method]
            parts.append(
                f"""SELECT {f'{by}, ' if by else ''}codmes, month_idx, '{view}' AS view, '{target}' AS target, {width} AS width,
  d{k}_{view}/nullif({view}, 0) AS rd_usable,
  (SELECT {factor} FROM {sums} h WHERE h.month_idx BETWEEN {closed - depth + 1} AND {closed} {same}) AS factor
 FROM {sums} s WHERE month_idx = {closed + j} AND {which}"""
            )
    same = f"AND b.{by} = a.{by}" if by else ""
    return f"""
, parts AS ({' UNION ALL '.join(parts)}),
o AS (SELECT *, rd_usable*factor AS rd_proj FROM parts)
SELECT {f'{by}, ' if by else ''}codmes, view, target, round(rd_usable, 6) AS rd_usable, round(factor, 6) AS factor,
 round((SELECT avg(b.rd_proj) FROM o b WHERE b.view = a.view AND b.target = a.target {same}
  AND b.month_idx BETWEEN a.month_idx - a.width // 2 AND a.month_idx + (a.width - 1) // 2), 6) AS rd_proj
FROM o a
"""


def _settings_sums(spark, sf_dir, by=()):
    base = CFG.select_universe(scored_base(spark, sf_dir))
    return store(cal.cohort_sums(base, CFG.with_(pds=()), st.horizons(CFG), by, early=True), "sums")


@query("projection_settings", scored(_settings_sql("seg_sums", SETTINGS, "segment"), SEG_SUMS))
def projection_settings(spark, sf_dir):
    """Other methods, depths and widths per view, target and segment in one pass."""
    sums = _settings_sums(spark, sf_dir, ("segment",))
    out = st.project(sums, CFG, st.table(spark, SETTINGS), ("segment",))
    return out.select("segment", "codmes", "view", "target", *r6("rd_usable", "factor", "rd_proj"))


WHOLE_SETTINGS = [r for r in SETTINGS if r[0] is None]


@query("projection_settings_total", scored(_settings_sql("sums", WHOLE_SETTINGS, ""), SUMS))
def projection_settings_total(spark, sf_dir):
    """The same for the portfolio as a whole: default and early delinquency, both views."""
    out = st.project(_settings_sums(spark, sf_dir), CFG, st.table(spark, WHOLE_SETTINGS))
    return out.select("codmes", "view", "target", *r6("rd_usable", "factor", "rd_proj"))


EARLY_BY_ID = [(None, "n", "early", "met1", 14, 1), (None, "m", "early", "met2", 14, 1), (2, "n", "early", "met2", 6, 1)]


@query(
    "factor_table_early",
    scored(
        f"""
, e AS (SELECT s.segment, s.codmes, s.month_idx, CASE WHEN s.month_idx = {EARLY_CLOSED + 1} THEN 2 ELSE 1 END AS k, s.n, s.m,
  s.d1_n, s.d2_n, s.d1_m, s.d2_m FROM seg_sums s WHERE s.month_idx IN ({EARLY_CLOSED + 1}, {EARLY_CLOSED + 2})
  AND segment IN ('1. Affluent', '2. Consumer')),
r AS (SELECT segment, month_idx, d3_n/nullif(d2_n, 0) AS n2, d3_n/nullif(d1_n, 0) AS n1, d3_m/nullif(d2_m, 0) AS m2, d3_m/nullif(d1_m, 0) AS m1
  FROM seg_sums WHERE month_idx BETWEEN {EARLY_CLOSED - 13} AND {EARLY_CLOSED}),
q AS (SELECT segment, 2 AS k, quantile_cont(n2, 0.75) AS nq,
  (quantile_cont(n2, 0.75) FILTER (WHERE month_idx > {EARLY_CLOSED - 6}) + quantile_cont(n2, 0.5) FILTER (WHERE month_idx > {EARLY_CLOSED - 6}))/2 AS nq6,
  (quantile_cont(m2, 0.75) + quantile_cont(m2, 0.5))/2 AS mq FROM r GROUP BY 1
 UNION ALL SELECT segment, 1, quantile_cont(n1, 0.75),
  (quantile_cont(n1, 0.75) FILTER (WHERE month_idx > {EARLY_CLOSED - 6}) + quantile_cont(n1, 0.5) FILTER (WHERE month_idx > {EARLY_CLOSED - 6}))/2,
  (quantile_cont(m1, 0.75) + quantile_cont(m1, 0.5))/2 FROM r GROUP BY 1),
f AS (SELECT e.*, CASE WHEN e.segment = '2. Consumer' THEN nq6 ELSE nq END AS fn, mq AS fm,
  CASE k WHEN 2 THEN d2_n ELSE d1_n END/n AS un, CASE k WHEN 2 THEN d2_m ELSE d1_m END/m AS um FROM e JOIN q USING (segment, k))
SELECT {RUN_MONTH} AS month_def, codmes, CASE segment WHEN '1. Affluent' THEN 1 ELSE 2 END AS seg_proy,
 round(coalesce(um*fm, 0.005), 6) AS projection_amounts, round(coalesce(fm, 0), 6) AS factor_amounts,
 round(coalesce(un*fn, 0.005), 6) AS projection_accounts, round(coalesce(fn, 0), 6) AS factor_accounts FROM f
""",
        SEG_SUMS,
    ),
)
def factor_table_early(spark, sf_dir):
    """Factor table of the early delinquency, with settings per view and segment id."""
    settings = st.table(spark, EARLY_BY_ID, "seg_proy", "INT")
    out = cohorts.factor_table_by_settings(
        scored_base(spark, sf_dir), CFG, SEGMENT_IDS, RUN_MONTH, settings, "early"
    )
    return out.select("month_def", "codmes", "seg_proy", *r6(*FACTOR_COLUMNS))


# -- factor table ------------------------------------------------------------

FACTOR_VIEWS = (
    SEG_SUMS,
    projection_sql("proj_n", "seg_sums", "n", by="segment"),
    projection_sql("proj_m", "seg_sums", "m", by="segment"),
    # Every month of the base: unprojected ones are filled with factor 0 and rate 0.005.
    f"""factors AS (SELECT {RUN_MONTH} AS month_def, a.codmes,
 CASE a.segment WHEN '1. Affluent' THEN 1 WHEN '2. Consumer' THEN 2 END AS seg_proy,
 coalesce(b.rd_proj, 0.005) AS projection_amounts, coalesce(b.factor, 0) AS factor_amounts,
 coalesce(a.rd_proj, 0.005) AS projection_accounts, coalesce(a.factor, 0) AS factor_accounts
 FROM proj_n a JOIN proj_m b ON a.segment = b.segment AND a.codmes = b.codmes
 WHERE a.segment IN ('1. Affluent', '2. Consumer'))""",
)
FACTOR_COLUMNS = ("projection_amounts", "factor_amounts", "projection_accounts", "factor_accounts")


def factors(base):
    return cohorts.factor_table(base, CFG, SEGMENT_IDS, RUN_MONTH)


@query(
    "factor_table",
    scored(
        "SELECT month_def, codmes, seg_proy, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in FACTOR_COLUMNS) + " FROM factors",
        *FACTOR_VIEWS,
    ),
)
def factor_table(spark, sf_dir):
    return factors(scored_base(spark, sf_dir)).select("month_def", "codmes", "seg_proy", *r6(*FACTOR_COLUMNS))


@query(
    "factor_merge",
    scored(
        "SELECT month_def, codmes, seg_proy, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in FACTOR_COLUMNS) + " FROM factors",
        *FACTOR_VIEWS,
    ),
)
def factor_merge(spark, sf_dir):
    """The factor table joined from two exported views of stored segment sums."""
    base = CFG.select_universe(scored_base(spark, sf_dir))
    base = base.withColumn("seg_proy", cohorts.segment_id("segment", SEGMENT_IDS)).filter("seg_proy IS NOT NULL")
    sums = store(cal.cohort_sums(base, CFG.with_(pds=()), cal.report_horizons(CFG), by=("seg_proy",)), "sums")
    accounts, amounts = (
        pj.with_projection(sums, CFG, view, by=("seg_proy",)) for view in ("n", "m")
    )
    out = cohorts.merge_factor_views(accounts, amounts, RUN_MONTH)
    return out.select("month_def", "codmes", "seg_proy", *r6(*FACTOR_COLUMNS))


OVERRIDDEN = [
    ("n", 199909, "add", 0.005, None), ("m", 199911, "set", 0.004, None), (None, 200001, "set", 0.25, 1),
]


def _corrected(view: str) -> str:
    """Rates of one view after ``OVERRIDDEN``, and their factors."""
    arms = " ".join(
        f"WHEN codmes = {m}{'' if s is None else f' AND segment = {chr(39)}1. Affluent{chr(39)}'} THEN "
        + (f"rd_proj + {v}" if op == "add" else f"{v}")
        for w, m, op, v, s in OVERRIDDEN if w in (None, view)
    )
    hit = f"(CASE {arms} ELSE NULL END)"
    return (
        f"fixed_{view} AS (SELECT codmes, segment, month_idx, rd_usable, {hit} IS NOT NULL AS hit, "
        f"CASE {arms} ELSE rd_proj END AS rd_proj, factor FROM proj_{view})"
    )


def _smoothed(view: str) -> str:
    return (
        f"smooth_{view} AS (SELECT codmes, segment, "
        "CASE WHEN hit THEN rd_proj/nullif(rd_usable, 0) ELSE factor END AS factor, "
        "CASE WHEN rd_proj IS NOT NULL THEN avg(rd_proj) OVER (PARTITION BY segment ORDER BY month_idx "
        f"ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS rd_proj FROM fixed_{view})"
    )


@query(
    "factor_table_overridden",
    scored(
        f"""
SELECT {RUN_MONTH} AS month_def, a.codmes, CASE a.segment WHEN '1. Affluent' THEN 1 ELSE 2 END AS seg_proy,
 round(coalesce(b.rd_proj, 0.005), 6) AS projection_amounts, round(coalesce(b.factor, 0), 6) AS factor_amounts,
 round(coalesce(a.rd_proj, 0.005), 6) AS projection_accounts, round(coalesce(a.factor, 0), 6) AS factor_accounts
FROM smooth_n a JOIN smooth_m b ON a.segment = b.segment AND a.codmes = b.codmes
WHERE a.segment IN ('1. Affluent', '2. Consumer')
""",
        *FACTOR_VIEWS[:3], _corrected("n"), _corrected("m"), _smoothed("n"), _smoothed("m"),
    ),
)
def factor_table_overridden(spark, sf_dir):
    """Factor table after manual corrections per view and segment, smoothed over three months."""
    rows = [(w, m, op, v, s) for w, m, op, v, s in OVERRIDDEN if s is None]
    # A correction without a segment holds for every segment id.
    rows = [(w, m, op, v, s) for w, m, op, v, _ in rows for s in SEGMENT_IDS.values()]
    rows += [r for r in OVERRIDDEN if r[4] is not None]
    table = spark.createDataFrame(rows, "view STRING, codmes INT, op STRING, value DOUBLE, seg_proy INT")
    out = cohorts.factor_table(
        scored_base(spark, sf_dir), CFG, SEGMENT_IDS, RUN_MONTH, overrides=table, smooth=3
    )
    return out.select("month_def", "codmes", "seg_proy", *r6(*FACTOR_COLUMNS))


@query(
    "projection_all",
    scored(
        f"""
SELECT a.codmes, round(a.rd_usable, 6) AS rd_usable, round(a.rd_proj, 6) AS met1,
 round(b.rd_proj, 6) AS met2, round(c.rd_proj, 6) AS met3
FROM p1 a JOIN p2 b ON b.codmes = a.codmes JOIN p3 c ON c.codmes = a.codmes
WHERE a.month_idx BETWEEN {CLOSED + 1} AND {CLOSED + 6}
""",
        SUMS, projection_sql("p1", "sums", "n", "met1"), projection_sql("p2", "sums", "n", "met2"),
        projection_sql("p3", "sums", "n", "met3"),
    ),
)
def projection_all(spark, sf_dir):
    """The projections of all methods side by side."""
    base = CFG.select_universe(scored_base(spark, sf_dir))
    sums = cal.cohort_sums(base, CFG.with_(pds=()), [24, *CFG.usable.values()])
    return pj.all_methods(sums, CFG).select("codmes", *r6("rd_usable", *pj.METHODS))


LATEST_SQL = "CASE " + " ".join(
    f"WHEN month_idx = {CLOSED + j} AND dist_def <= {h} THEN 1"
    for j, h in (*OPEN, (7, 18), (8, 17), (9, 16))
) + " ELSE 0 END"

SEG_SCORED_SQL = f"""seg_scored AS (SELECT *, {LATEST_SQL} AS ult_rd,
 CASE segment WHEN '1. Affluent' THEN 1 WHEN '2. Consumer' THEN 2 END AS seg_proy FROM scored)"""


@query(
    "factor_join",
    scored(
        """
SELECT s.app_id, s.codmes, s.seg_proy, s.ult_rd,
 round(s.ult_rd*f.factor_amounts, 6) AS proj_factor_m, round(s.ult_rd*f.factor_accounts, 6) AS proj_factor_n,
 round(f.projection_amounts, 6) AS proj_value_m, round(f.projection_accounts, 6) AS proj_value_n
FROM seg_scored s LEFT JOIN factors f ON f.codmes = s.codmes AND f.seg_proy = s.seg_proy
""",
        *FACTOR_VIEWS, SEG_SCORED_SQL,
    ),
)
def factor_join(spark, sf_dir):
    base = stored_base(spark, sf_dir)
    segments = base.withColumn("seg_proy", cohorts.segment_id("segment", SEGMENT_IDS))
    out = cohorts.factor_join(segments, factors(base), CFG)
    return out.select(
        "app_id", "codmes", "seg_proy", "ult_rd",
        *r6("proj_factor_m", "proj_factor_n", "proj_value_m", "proj_value_n"),
    )


# -- by driver ---------------------------------------------------------------

USE = "codmes BETWEEN 199801 AND 200002 AND codmes NOT IN (199805, 199903)"


def month_factors(base, view="n"):
    return pj.open_cohorts(projected(base, view), CFG).select("codmes", "factor")


def segment_factors(base, view="n"):
    rows = pj.open_cohorts(projected(base, view, by=("segment",)), CFG)
    return rows.select("segment", "codmes", "factor")


def _by_driver_sql(drivers, view: str, min_share: float, keep_missing: bool, segments: bool = False) -> str:
    w = "1" if view == "n" else "CAST(amount AS DECIMAL(18,2))"
    long = " UNION ALL ".join(
        f"SELECT '{d}' AS variable, CAST({d} AS VARCHAR) AS bucket, segment AS seg, codmes, month_idx, dist_def, pd, amount, {w} AS w "
        f"FROM drivers WHERE {UNIVERSE} AND {USE}" for d in drivers
    )
    missing = "" if keep_missing else "WHERE bucket NOT LIKE '%issing%'"
    usable = "CASE " + " ".join(
        f"WHEN l.month_idx = {CLOSED + j} THEN CASE WHEN dist_def <= {h} THEN w ELSE 0 END" for j, h in OPEN
    ) + " END"
    pd = "sum(pd)" if view == "n" else "sum(pd*amount)"
    by_segment = " AND p.segment = l.seg" if segments else ""
    return f"""
, long AS (SELECT * FROM ({long}) {missing}),
g AS (SELECT variable, bucket, count(*) AS n, CAST(sum(w) AS DOUBLE) AS weight, {pd} AS pd_sum,
  CAST(sum(CASE WHEN dist_def <= 12 THEN w ELSE 0 END) AS DOUBLE) AS aux_sum,
  CAST(sum(CASE WHEN l.month_idx <= {CLOSED} THEN CASE WHEN dist_def <= 24 THEN w ELSE 0 END END) AS DOUBLE) AS closed_sum,
  CAST(sum(CASE WHEN l.month_idx <= {CLOSED} THEN w END) AS DOUBLE) AS closed_weight,
  sum(CAST({usable} AS DOUBLE) * p.factor) AS open_sum,
  CAST(sum(CASE WHEN p.factor IS NOT NULL THEN w END) AS DOUBLE) AS open_weight
 FROM long l LEFT JOIN (SELECT * {open_only('proj')}) p ON p.codmes = l.codmes{by_segment} GROUP BY 1, 2),
s AS (SELECT *, weight/sum(weight) OVER (PARTITION BY variable) AS share FROM g)
SELECT variable, bucket, n, round(share, 6) AS share, round(pd_sum/weight, 6) AS pd, round(aux_sum/weight, 6) AS rd12,
 round(closed_sum/closed_weight, 6) AS rd24, round(open_sum/open_weight, 6) AS rd_proj
FROM s WHERE share >= {min_share}
"""


@query(
    "driver_calibration",
    scored(
        "SELECT * EXCLUDE (variable, bucket), bucket AS pd_r FROM ("
        + "WITH x AS (SELECT 1)" + _by_driver_sql(["pd_r"], "n", 0, False) + ")",
        DRIVERS_SQL, SUMS, projection_sql("proj", "sums", "n"),
    ),
)
def driver_calibration(spark, sf_dir):
    base = stored_base(spark, sf_dir)
    out = cal.driver_calibration(with_drivers(base), CFG, "pd_r", month_factors(base), use=USE)
    return out.select("pd_r", "n", *r6("share", "pd", "rd12", "rd24", "rd_proj"))


CAL_DRIVERS = ("amount_r", "income_r", "score_r", "segment", "job_type")


@query(
    "multi_driver_calibration",
    scored(
        _by_driver_sql(CAL_DRIVERS, "m", 0.05, False),
        DRIVERS_SQL, SUMS, projection_sql("proj", "sums", "m"),
    ),
)
def multi_driver_calibration(spark, sf_dir):
    base = stored_base(spark, sf_dir)
    out = cal.multi_driver_calibration(
        with_drivers(base), CFG, CAL_DRIVERS, month_factors(base, "m"), view="m", use=USE, min_share=0.05
    )
    return out.select("variable", "bucket", "n", *r6("share", "pd", "rd12", "rd24", "rd_proj"))


SEGMENT_DRIVERS = ("amount_r", "job_type", "segment")


@query(
    "driver_calibration_segments",
    scored(
        _by_driver_sql(SEGMENT_DRIVERS, "n", 0.0, False, True),
        DRIVERS_SQL, SEG_SUMS, projection_sql("proj", "seg_sums", "n", by="segment"),
    ),
)
def driver_calibration_segments(spark, sf_dir):
    """Portfolio report by driver bucket, every segment projected with its own factor."""
    base = stored_base(spark, sf_dir)
    out = cal.multi_driver_calibration(
        with_drivers(base), CFG, SEGMENT_DRIVERS, segment_factors(base), use=USE
    )
    return out.select("variable", "bucket", "n", *r6("share", "pd", "rd12", "rd24", "rd_proj"))


@query(
    "driver_calibration_segments_amount",
    scored(
        _by_driver_sql(SEGMENT_DRIVERS, "m", 0.05, False, True),
        DRIVERS_SQL, SEG_SUMS, projection_sql("proj", "seg_sums", "m", by="segment"),
    ),
)
def driver_calibration_segments_amount(spark, sf_dir):
    base = stored_base(spark, sf_dir)
    out = cal.multi_driver_calibration(
        with_drivers(base), CFG, SEGMENT_DRIVERS, segment_factors(base, "m"), view="m", use=USE, min_share=0.05
    )
    return out.select("variable", "bucket", "n", *r6("share", "pd", "rd12", "rd24", "rd_proj"))


@query(
    "evol_calibration_driver_segments",
    scored(
        f"""
, c AS (SELECT job_type, segment, codmes, month_idx, count(*) AS n, sum(pd) AS pd_sum,
 {", ".join(f"CAST(sum(CASE WHEN dist_def<={h} THEN 1 ELSE 0 END) AS DOUBLE) AS d{h}" for h in (24, 23, 22, 21, 20, 19, 12))}
 FROM scored WHERE {UNIVERSE} AND codmes >= 199701 GROUP BY 1, 2, 3, 4),
f AS (SELECT c.*, p.factor FROM c LEFT JOIN (SELECT segment, codmes, factor {open_only('proj')}) p
 ON p.codmes = c.codmes AND p.segment = c.segment)
SELECT job_type, codmes AS block_end, CAST(sum(n) AS BIGINT) AS n, round(sum(pd_sum)/sum(n), 6) AS pd,
 round(CASE WHEN month_idx <= {CLOSED} THEN sum(d24)/sum(n) END, 6) AS rd24,
 round(CASE WHEN month_idx <= {CLOSED + 3} THEN sum(d21)/sum(n) END, 6) AS rd21,
 round(CASE WHEN month_idx <= {CLOSED + 12} THEN sum(d12)/sum(n) END, 6) AS rd12,
 round(sum(CASE month_idx - {CLOSED} {" ".join(f"WHEN {j} THEN d{h}" for j, h in OPEN)} END * factor)
  / sum(CASE WHEN factor IS NOT NULL THEN n END), 6) AS rd_proj
FROM f GROUP BY job_type, codmes, month_idx
""",
        SEG_SUMS, projection_sql("proj", "seg_sums", "n", by="segment"),
    ),
)
def evol_calibration_driver_segments(spark, sf_dir):
    """Months of every job type, projected by the factors of the segments inside."""
    base = stored_base(spark, sf_dir)
    out = cal.evol_calibration_driver(base, CFG, "job_type", segment_factors(base), use="codmes >= 199701")
    return out.select("job_type", "block_end", "n", *r6("pd", "rd24", "rd21", "rd12", "rd_proj"))


@query(
    "information_value",
    scored(
        ", long AS ("
        + " UNION ALL ".join(
            f"SELECT '{d}' AS variable, {d} AS bucket, CASE WHEN dist_def <= 24 THEN 1 ELSE 0 END AS bad "
            f"FROM drivers WHERE {UNIVERSE} AND codmes <= 199908" for d in CAL_DRIVERS
        )
        + """), c AS (SELECT variable, bucket, CAST(sum(bad) AS DOUBLE) AS b, CAST(sum(1-bad) AS DOUBLE) AS g FROM long GROUP BY 1, 2),
s AS (SELECT variable, greatest(g/sum(g) OVER w, 0.0001) AS pg, greatest(b/sum(b) OVER w, 0.0001) AS pb FROM c WINDOW w AS (PARTITION BY variable))
SELECT variable, count(*) AS buckets, round(sum((pg-pb)*ln(pg/pb)), 6) AS iv FROM s GROUP BY variable
""",
        DRIVERS_SQL,
    ),
)
def information_value(spark, sf_dir):
    out = cal.information_value(
        with_drivers(scored_base(spark, sf_dir)), CFG, CAL_DRIVERS, use="codmes <= 199908"
    )
    return out.select("variable", "buckets", *r6("iv"))


@query(
    "evol_calibration_driver",
    scored(
        f"""
, c AS (SELECT job_type, codmes, month_idx, count(*) AS n, sum(pd) AS pd_sum,
 CAST(sum(CASE WHEN dist_def<=24 THEN 1 ELSE 0 END) AS DOUBLE) AS d24,
 CAST(sum(CASE WHEN dist_def<=21 THEN 1 ELSE 0 END) AS DOUBLE) AS d21,
 CAST(sum(CASE WHEN dist_def<=12 THEN 1 ELSE 0 END) AS DOUBLE) AS d12,
 {", ".join(f"CAST(sum(CASE WHEN dist_def<={h} THEN 1 ELSE 0 END) AS DOUBLE) AS u{h}" for h in (23, 22, 20, 19))}
 FROM scored WHERE {UNIVERSE} AND codmes >= 199701 GROUP BY 1, 2, 3)
SELECT c.job_type, c.codmes AS block_end, n, round(pd_sum/n, 6) AS pd,
 round(CASE WHEN month_idx <= {CLOSED} THEN d24/n END, 6) AS rd24,
 round(CASE WHEN month_idx <= {CLOSED + 3} THEN d21/n END, 6) AS rd21,
 round(CASE WHEN month_idx <= {CLOSED + 12} THEN d12/n END, 6) AS rd12,
 round(CASE month_idx - {CLOSED} WHEN 1 THEN u23 WHEN 2 THEN u22 WHEN 3 THEN u22 WHEN 4 THEN d21
  WHEN 5 THEN u20 WHEN 6 THEN u19 END * factor / n, 6) AS rd_proj
FROM c LEFT JOIN (SELECT codmes AS pm, factor {open_only('proj')}) p ON p.pm = c.codmes
""",
        SUMS, projection_sql("proj", "sums", "n"),
    ),
)
def evol_calibration_driver(spark, sf_dir):
    base = stored_base(spark, sf_dir)
    out = cal.evol_calibration_driver(base, CFG, "job_type", month_factors(base), use="codmes >= 199701")
    return out.select("job_type", "block_end", "n", *r6("pd", "rd24", "rd21", "rd12", "rd_proj"))


# -- bands -------------------------------------------------------------------


def _monthly(spark, sf_dir):
    base = CFG.select_universe(scored_base(spark, sf_dir))
    return cal.monthly_calibration(base, CFG).filter("codmes <= 199908")


@query(
    "bands_wilson",
    scored(
        """
, k AS (SELECT codmes, n, d24_n AS d, pd_n/n AS pd_mean, d24_n/n AS p, 1.959963984540054::DOUBLE AS z
 FROM sums WHERE codmes <= 199908),
w AS (SELECT *, (p + z*z/(2*n))/(1 + z*z/n) AS c, z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))/(1 + z*z/n) AS h FROM k)
SELECT codmes, n, round(c-h, 6) AS lower, round(c+h, 6) AS upper, pd_mean BETWEEN c-h AND c+h AS inside FROM w
""",
        SUMS,
    ),
)
def bands_wilson(spark, sf_dir):
    out = bands.bands_wilson(_monthly(spark, sf_dir), "n", "def24", "pd_mean")
    return out.select("codmes", "n", *r6("lower", "upper"), "inside")


# Quantiles of Beta(d + 1/2, n - d + 1/2): cumulated trapezoids over the angle t with
# x = sin(t)^2, on a grid of 24 deviations around the peak, read by interpolation.
JEFFREYS_SQL = """
, k AS (SELECT codmes, n, d24_n AS d, pd_n/n AS pd_mean, atan2(sqrt(d24_n), sqrt(n - d24_n)) AS peak,
  12/sqrt(4.0*(n + 1)) AS w FROM sums WHERE codmes <= 199908),
e AS (SELECT *, greatest(0.0, peak - w) AS lo, least(pi()/2, peak + w) AS hi FROM k),
g AS (SELECT codmes, i, lo + (hi - lo)*i/100000.0 AS t, (hi - lo)/100000.0 AS h,
  CASE WHEN d = 0 THEN 0 ELSE 2*d*ln(greatest(sin(lo + (hi - lo)*i/100000.0), 1e-300)) - 2*d*ln(greatest(sin(peak), 1e-300)) END
  + CASE WHEN d = n THEN 0 ELSE 2*(n - d)*ln(greatest(cos(lo + (hi - lo)*i/100000.0), 1e-300)) - 2*(n - d)*ln(greatest(cos(peak), 1e-300)) END AS f
  FROM e, (SELECT unnest(generate_series(0, 100000)) AS i)),
s AS (SELECT codmes, i, t, h, (exp(f) + lag(exp(f), 1, 0.0) OVER (PARTITION BY codmes ORDER BY i))/2 * CASE WHEN i = 0 THEN 0 ELSE h END AS part FROM g),
c AS (SELECT codmes, i, t, h, sum(part) OVER (PARTITION BY codmes ORDER BY i) AS upto, part FROM s),
z AS (SELECT codmes, max(upto) AS total FROM c GROUP BY codmes),
q AS (SELECT c.codmes, p, max(CASE WHEN upto - part < p*total AND p*total <= upto THEN t - h*(upto - p*total)/part END) AS t
  FROM c JOIN z ON z.codmes = c.codmes, (VALUES (0.025::DOUBLE), (0.975::DOUBLE)) v(p) GROUP BY c.codmes, p),
b AS (SELECT codmes, max(CASE WHEN p < 0.5 THEN sin(t)*sin(t) END) AS lower, max(CASE WHEN p > 0.5 THEN sin(t)*sin(t) END) AS upper FROM q GROUP BY codmes)
SELECT k.codmes, n, round(lower, 6) AS lower, round(upper, 6) AS upper, pd_mean BETWEEN lower AND upper AS inside
FROM k JOIN b ON b.codmes = k.codmes
"""

# Normal distribution function on a grid, cumulated by trapezoids and read by interpolation.
VASICEK_SQL = """
, k AS (SELECT codmes, n, pd_n/n AS pd_mean, d24_n/n AS rd FROM sums WHERE codmes <= 199908),
g AS (SELECT i, -8 + i/5000.0::DOUBLE AS x, exp(-pow(-8 + i/5000.0::DOUBLE, 2)/2)/sqrt(2*pi()) AS f
  FROM (SELECT unnest(generate_series(0, 80000)) AS i)),
c AS (SELECT i, x, f, sum((f + lf)/2/5000.0::DOUBLE) OVER (ORDER BY i) AS upto
  FROM (SELECT *, lag(f, 1, f) OVER (ORDER BY i) AS lf FROM g)),
n2 AS (SELECT i, x, upto, lead(upto) OVER (ORDER BY i) AS nxt FROM c),
a AS (SELECT codmes, n, pd_mean, rd, x + (pd_mean - upto)/(nxt - upto)/5000.0::DOUBLE AS z FROM k JOIN n2 ON upto <= pd_mean AND pd_mean < nxt),
t AS (SELECT *, (z - sqrt(0.15::DOUBLE)*1.959963984540054::DOUBLE)/sqrt(0.85::DOUBLE) AS zl,
  (z + sqrt(0.15::DOUBLE)*1.959963984540054::DOUBLE)/sqrt(0.85::DOUBLE) AS zu FROM a),
l AS (SELECT t.codmes, t.n, t.rd, l.upto + (l.nxt - l.upto)*(zl - l.x)*5000 AS lower, u.upto + (u.nxt - u.upto)*(zu - u.x)*5000 AS upper
  FROM t JOIN n2 l ON l.i = CAST(floor((zl + 8)*5000) AS BIGINT) JOIN n2 u ON u.i = CAST(floor((zu + 8)*5000) AS BIGINT))
SELECT codmes, n, round(lower, 6) AS lower, round(upper, 6) AS upper, rd BETWEEN lower AND upper AS inside FROM l
"""


@query("bands_jeffreys", scored(JEFFREYS_SQL, SUMS))
def bands_jeffreys(spark, sf_dir):
    out = bands.bands_jeffreys(_monthly(spark, sf_dir), "n", "def24", "pd_mean")
    return out.select("codmes", "n", *r6("lower", "upper"), "inside")


@query("bands_vasicek", scored(VASICEK_SQL, SUMS))
def bands_vasicek(spark, sf_dir):
    out = bands.bands_vasicek(_monthly(spark, sf_dir), "pd_mean", "rd24")
    return out.select("codmes", "n", *r6("lower", "upper"), "inside")
