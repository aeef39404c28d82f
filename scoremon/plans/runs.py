"""Whole monthly runs: build the base table, monitor it, publish the cube.

The three stages hand over stored tables, so each monitor scans a narrow,
column-pruned table instead of evaluating the joins of the base again.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig, product_universe, where
from scoremon.functions import buckets as bk
from scoremon.functions.months import index_of, yyyymm_of
from scoremon.functions.scores import (
    logit_to_pd, null_safe_sum, null_sentinels, score_to_logit, switch_source,
)
from scoremon.operators import bands, calibration, cohorts, cube, discrimination, projection, quality, stability
from scoremon.operators import settings as by_settings
from scoremon.operators.enrich import latest_per_key, left_enrich, rule_lookup
from scoremon.operators.incremental import SummaryStore
from scoremon.operators.quantiles import approx_percentile
from scoremon.plans import fixed_values as fx
from scoremon.sources.tables import label_table, save_table, store, write_extract, write_folder, write_partitioned


@dataclass(frozen=True)
class Columns:
    """Column names of the application base; resolved case-insensitively."""

    month: str = "codmes"
    client: str = "client_id"
    request: str = "request_id"
    account: str = "account_id"
    purpose: str = "purpose"
    amount: str = "amount"
    score: str = "score"
    pd: str = "pd"
    zone: str = "zone"
    term_group: str = "term_group"
    income: str = "spouse_income"
    amount_flag: str = "amount_flag"


# -- base tables -------------------------------------------------------------


def traditional_base(
    applications: DataFrame,
    scored: DataFrame,
    mirror: DataFrame,
    equals: Mapping[str, object],
    scored_columns: Sequence[str] | Mapping[str, str],
    mirror_columns: Sequence[str] | Mapping[str, str],
    scored_if: str = "",
    sentinel_columns: Sequence[str] = (),
    names: Columns = Columns(),
) -> DataFrame:
    """Base table of the traditional product.

    ``applications`` is cut to the product (``equals``, excluded purposes),
    enriched with the scored extract by month and client and with the mirror
    extract by request, and labelled.
    """
    base = product_universe(
        applications, equals=dict(equals), excluded={names.purpose: list(fx.TRADITIONAL_EXCLUDED_PURPOSES)}
    )
    base = left_enrich(base, scored, [names.month, names.client], scored_columns, scored_if)
    base = left_enrich(base, mirror, [names.request], mirror_columns, distinct=False)
    return base.withColumns(traditional_columns(names, sentinel_columns))


def traditional_columns(names: Columns = Columns(), sentinel_columns: Sequence[str] = ()) -> dict[str, Column]:
    out = {
        "rango_score": bk.bucket_right_open(names.score, fx.TRADITIONAL_SCORE_EDGES, fx.TRADITIONAL_SCORE_LABELS),
        "rango_pd": bk.bucket_right_closed(names.pd, fx.TRADITIONAL_PD_EDGES, fx.TRADITIONAL_PD_LABELS),
        "monto_r": bk.bucket_right_closed(names.amount, fx.TRADITIONAL_AMOUNT_EDGES, fx.TRADITIONAL_AMOUNT_LABELS),
        "pauta": bk.flag(F.col(names.score) >= fx.TRADITIONAL_MIN_SCORE),
        "miss_pd": bk.flag(F.col(names.pd).isNull()),
        "miss_monto": bk.flag(F.col(names.amount).isNull()),
        "flg_altos": bk.flag(F.col(names.amount) >= fx.TRADITIONAL_HIGH_AMOUNT),
        f"{names.zone}_f": bk.recode(
            names.zone, fx.TRADITIONAL_ZONES, default=fx.ZONE_OTHER, missing=bk.MISSING_LABEL
        ),
        names.term_group: bk.recode(names.term_group, fx.TERM_GROUPS),
    }
    out.update({f"{c}_f": null_sentinels(c) for c in sentinel_columns})
    return out


def guarantee_base(
    applications: DataFrame,
    mirror: DataFrame,
    credit_types: Mapping[str, Sequence[str]],
    mirror_columns: Sequence[str] | Mapping[str, str],
    names: Columns = Columns(),
) -> DataFrame:
    """Base table of the mortgage-guarantee product.

    ``credit_types`` maps the credit type column to the admitted codes.  The
    purpose rule is applied as a filter before the join.
    """
    base = product_universe(applications, allowed={k: list(v) for k, v in credit_types.items()})
    purpose = bk.purpose_flag(names.purpose, names.month, fx.GUARANTEE_PURPOSES, fx.GUARANTEE_PURPOSES_SINCE)
    base = base.withColumn("flg_finalidad", purpose).filter("flg_finalidad = 1")
    base = left_enrich(base, mirror, [names.request], mirror_columns)
    return base.withColumns(guarantee_columns(names))


def guarantee_columns(names: Columns = Columns()) -> dict[str, Column]:
    return {
        "total": F.lit("1"),
        "pauta": bk.flag(F.col(names.score) >= fx.GUARANTEE_MIN_SCORE),
        "rsc": bk.bucket_right_open(names.score, fx.GUARANTEE_SCORE_EDGES, fx.GUARANTEE_SCORE_LABELS),
        "rpd": bk.bucket_right_closed(names.pd, fx.GUARANTEE_PD_EDGES, fx.GUARANTEE_PD_LABELS),
        "monto_r": bk.bucket_right_closed(names.amount, fx.GUARANTEE_AMOUNT_EDGES, fx.GUARANTEE_AMOUNT_LABELS),
        "miss_pd": bk.flag(F.col(names.pd).isNull()),
        "miss_monto": bk.flag(F.col(names.amount).isNull()),
        "ran_ingr_cy": bk.bucket_right_closed(names.income, fx.GUARANTEE_INCOME_EDGES, fx.GUARANTEE_INCOME_LABELS),
        "flg_monto_r": bk.recode(
            names.amount_flag, fx.GUARANTEE_AMOUNT_FLAG,
            default=fx.GUARANTEE_AMOUNT_FLAG_OTHER, missing=bk.MISSING_LABEL,
        ),
    }


def monitored_columns(
    score: str, state_pd: str, incomes: Sequence[str], zone: str, term_range: str
) -> dict[str, Column]:
    """Columns derived when the base table is opened for monitoring."""
    bureau = score_to_logit(score)
    capital, city, province = fx.CAPITAL_LABELS
    return {
        "bureau_xb": bureau,
        "bureau_pd": logit_to_pd(bureau),
        "pd_rbm": F.coalesce(F.col(state_pd), logit_to_pd(bureau)),
        "ingreso_cony_tit": null_safe_sum(*incomes),
        "cat_zona": bk.contains_class(zone, capital, city, province),
        term_range: bk.recode(term_range, fx.TERM_RANGES, default=bk.SELF),
    }


def renewed_columns(
    month: str, ltv: tuple[str, str], term: str, tenure: str, age: str, spouse_income: str, holder_income: str
) -> dict[str, Column]:
    """Ordered bands of the renewed sources; ``ltv`` is (new, old) source."""
    value = switch_source(month, fx.LTV_SOURCE_SINCE, *ltv)
    bands_of = {
        term: fx.TERM_BANDS, tenure: fx.TENURE_BANDS, age: fx.AGE_BANDS,
        spouse_income: fx.SPOUSE_INCOME_BANDS, holder_income: fx.HOLDER_INCOME_BANDS,
    }
    out = {"ltv_corregido_vf": value, "ltv_corregido_vf_q": bk.ordered_bands(value, fx.LTV_BANDS)}
    out.update({f"{c}_q": bk.ordered_bands(c, rules) for c, rules in bands_of.items()})
    return out


def with_zone_risk(
    df: DataFrame, department: str, district: str,
    rules: DataFrame | None = None, rules_2: DataFrame | None = None,
) -> DataFrame:
    """Zone risk by both rule sets, and the numeric weight of the second one.

    Rule tables of any size (department, district, risk) may replace the fixed rules.
    """
    for name, given, fixed, unknown in (
        ("riesgo_zona2", rules, fx.ZONE_RISK_RULES, None),
        ("riesgo_zona_st", rules_2, fx.ZONE_RISK_RULES_2, fx.ZONE_RISK_UNKNOWN),
    ):
        columns = [department, district, "_risk"]
        table = label_table(df.sparkSession, fixed, columns) if given is None else given.toDF(*columns)
        df = rule_lookup(df, table, department, district, "_risk", fx.ZONE_RISK_DEFAULT, unknown, name)
    return df.withColumn("riesgo_zona_st_st", bk.recode("riesgo_zona_st", fx.ZONE_RISK_WEIGHTS))


def with_latest_run(
    df: DataFrame, log: DataFrame, key: str, log_key: str, date: str, columns: Mapping[str, str], keep_if: str = ""
) -> DataFrame:
    """Columns of the latest evaluation run of each request, ties included."""
    needed = dict.fromkeys([log_key, date, *columns, *_mentioned(log, keep_if)])
    newest = latest_per_key(log.select(*needed), log_key, date, keep_if)
    renamed = newest.select(F.col(log_key).alias(key), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(renamed, key, "left")


def _mentioned(df: DataFrame, predicate: str) -> list[str]:
    """Columns whose name occurs in a predicate, to keep projections narrow."""
    words = set(re.findall(r"\w+", predicate.lower()))
    return [c for c in df.columns if c.lower() in words]


def acceptance(score: str, segment: str | None = None) -> Column:
    """Acceptance flag of the cube: one floor, or one floor per segment."""
    if segment is None:
        return bk.flag(F.col(score) >= fx.TRADITIONAL_MIN_SCORE)
    return bk.tiered_accept(score, segment, fx.GUARANTEE_TIERS)


# -- monitoring --------------------------------------------------------------


@dataclass(frozen=True)
class MonitorPlan:
    """What one monitoring run reports.

    ``calibration_use`` may be any predicate on the base; ``driver_use`` cuts
    the months of the driver reports and may use the month column only.
    ``request`` names the request number, to tell a missing PD from a missing
    match of the extract.  ``overrides`` (month, op, value, optionally view)
    corrects portfolio projections before ``smooth`` months are averaged;
    corrections of single segments name them in the segment column.
    With ``segment_factors`` the driver reports project every segment with its own factor.
    ``settings`` (see ``operators.settings``) gives views, targets and segments their own
    method, depth and smoothing in the frames ``projection`` and ``projection_segment``; by
    default ``method``, the history of the config and ``smooth`` hold for all.
    """

    drivers: Sequence[str]
    numeric: Sequence[str]
    base_window: tuple[int, int]
    recent_window: tuple[int, int]
    gini_months: tuple[int, int]
    gini_width: int = 6
    calibration_use: str = ""
    driver_use: str = ""
    min_share: float = 0.05
    aux: tuple[int, int] = (21, 12)
    horizons: tuple[int, ...] = (24, 21, 18)
    gini_limits: tuple[float, float] = (0.4, 0.5)
    bands: str = "jeffreys"
    rho: float = 0.15
    method: str = "met1"
    request: str = ""
    overrides: DataFrame | None = None
    smooth: int = 1
    segment_factors: bool = False
    settings: DataFrame | None = None


def summaries(df: DataFrame, cfg: MonitorConfig, plan: MonitorPlan) -> tuple[DataFrame, DataFrame]:
    """The two small tables that most reports are made of, each from one scan.

    Sums per segment and month, and sums per driver, bucket and month.  They
    are stored, so the reports never go back to the base.
    """
    horizons = calibration.report_horizons(
        cfg, [*plan.aux, *plan.horizons, cfg.target - 6, *by_settings.horizons(cfg)]
    )
    sums = calibration.cohort_sums(
        cfg.select_universe(df, plan.calibration_use), cfg, horizons, by=(cfg.segment,), early=True
    )
    by = (cfg.segment,) if plan.segment_factors else ()
    cells = calibration.driver_cells(cfg.select_universe(df), cfg, plan.drivers, horizons, by=by)
    return store(sums, "sums"), store(cells, "cells")


def monitor(df: DataFrame, cfg: MonitorConfig, plan: MonitorPlan) -> dict[str, DataFrame]:
    """All result frames of a run; ``df`` should be a stored table.

    Five scans of the base in all: missing values, reconciliation, the two
    summaries, and the score counts behind Gini and KS.
    """
    pd, month = cfg.pds[0], cfg.month
    checks = {"miss_pd": [pd]}
    if plan.request:
        checks["miss_sol"] = [pd, plan.request]
    sums, fine = summaries(df, cfg, plan)
    out = {
        "missing": quality.missing_by(df, [month], checks),
        "reconcile": quality.reconcile_universes(df, cfg, cfg.universe, ""),
        **reports(sums, fine, cfg, plan),
    }
    start, end = plan.gini_months
    scores = [pd, *[c for c in plan.numeric if c != pd]]
    return out | discriminated(discrimination.multi_driver_gini(
        df, cfg, scores, horizons=plan.horizons, start=start, end=end, months=plan.gini_width,
        moving=True, limits=plan.gini_limits, cells=_cells(fine, cfg),
    ), cfg, plan)


def monitor_stored(kept: SummaryStore, plan: MonitorPlan) -> dict[str, DataFrame]:
    """The frames of a run that summaries give, from a store of monthly ones.

    The base is not read: ``SummaryStore.refresh`` has read its new months.  Drivers, numeric
    scores, horizons and predicate are those of the store; the data checks ``missing`` and
    ``reconcile`` look at rows and are left to ``monitor``.
    """
    cfg, tables = kept.cfg, kept.tables()
    start, end = plan.gini_months
    gini = discrimination.gini_from_counts(
        tables["scores"], cfg, plan.horizons, start, end, plan.gini_width, True, plan.gini_limits,
        _cells(tables["cells"], cfg),
    )
    return reports(tables["sums"], tables["cells"], cfg, plan) | discriminated(gini, cfg, plan)


def discriminated(gini: DataFrame, cfg: MonitorConfig, plan: MonitorPlan) -> dict[str, DataFrame]:
    """Gini and KS over time, and one column per month."""
    gini = store(gini, "gini")
    start, end = plan.gini_months
    periods = [yyyymm_of(i) for i in range(index_of(start), index_of(end) + 1)]
    return {"gini": gini, "discrimination": discrimination.by_period(gini, cfg.month, periods, f"gini{plan.horizons[0]}")}


def _cells(fine: DataFrame, cfg: MonitorConfig) -> DataFrame:
    """Driver cells of all segments together."""
    if cfg.segment not in fine.columns:
        return fine
    return calibration.roll_up(fine, ("variable", "bucket"), cfg.month)


def reports(sums: DataFrame, fine: DataFrame, cfg: MonitorConfig, plan: MonitorPlan) -> dict[str, DataFrame]:
    """What the two summaries give: sums by segment, and driver cells (also by segment)."""
    pd, month = cfg.pds[0], cfg.month
    total = calibration.roll_up(sums, (), month)
    cells = _cells(fine, cfg)
    fine = fine if plan.segment_factors else cells
    shown = calibration.drop_missing(where(fine, plan.driver_use))
    out: dict[str, DataFrame] = {
        "validation": calibration.validation_from_sums(total, cfg),
        "mix": stability.mix_from_cells(cells, cfg),
        "information_value": calibration.iv_from_cells(where(cells, plan.driver_use), cfg),
    }
    settings = plan.settings
    if settings is None:
        settings = by_settings.same_for_all(sums.sparkSession, cfg, plan.method, plan.smooth)
    # Both targets and views in one pass: the default and the early delinquency.
    out["projection_segment"] = by_settings.project(sums, cfg, settings, (cfg.segment,), plan.overrides)
    whole = settings.filter(F.col(cfg.segment).isNull()) if cfg.segment in settings.columns else settings
    out["projection"] = by_settings.project(total, cfg, whole, (), plan.overrides)
    for target in by_settings.targets(cfg):
        out[f"factors_{target.name}"] = by_settings.side_by_side(
            out["projection_segment"], cfg, target.name, (cfg.segment,)
        )
    for view in ("n", "m"):
        change = (plan.overrides, plan.smooth)
        evol = calibration.evol_from_sums(total, cfg, view, plan.aux, (), plan.method, *change)
        factors = month_factors(
            sums if plan.segment_factors else total, cfg, view, plan.method, *change,
            by=(cfg.segment,) if plan.segment_factors else (),
        )
        # The amount view tests an amount-weighted rate on as many trials as accounts.
        out[f"calibration_{view}"] = bands.add_bands(
            evol, plan.bands, "n", "events", pd, f"rd{cfg.target}", rho=plan.rho
        )
        out[f"calibration_segment_{view}"] = calibration.evol_from_sums(
            sums, cfg, view, plan.aux, (cfg.segment,), plan.method, *change
        )
        out[f"portfolio_{view}"] = portfolio_from_segments(sums, cfg, view, plan.method, *change)
        out[f"all_methods_{view}"] = projection.all_methods(total, cfg, view)
        out[f"drivers_{view}"] = calibration.drivers_from_cells(
            shown, cfg, factors, view, plan.aux[1], plan.min_share
        )
        out[f"evol_drivers_{view}"] = calibration.evol_drivers_from_cells(
            calibration.drop_missing(fine), cfg, factors, view, plan.aux
        )
        out[f"psi_{view}"] = stability.psi_from_cells(cells, cfg, plan.base_window, plan.recent_window, view)
        out[f"evol_psi_{view}"] = stability.evol_psi_from_cells(
            cells, cfg, plan.base_window, plan.recent_window, view
        )
    return out


def month_factors(
    sums: DataFrame, cfg: MonitorConfig, view: str, method: str = "met1",
    overrides: DataFrame | None = None, smooth: int = 1, by: Sequence[str] = (),
) -> DataFrame:
    """Projection factor per open month, from portfolio sums, or by segment from segment sums."""
    projected = projection.with_projection(sums, cfg, view, method, by)
    projected = projection.adjusted(projected, cfg, view, overrides, smooth, by)
    return projection.open_cohorts(projected, cfg).select(*by, cfg.month, "factor")


def portfolio_from_segments(
    sums: DataFrame, cfg: MonitorConfig, view: str, method: str = "met1",
    overrides: DataFrame | None = None, smooth: int = 1,
) -> DataFrame:
    """Portfolio projection put together from the segment projections."""
    projected = projection.with_projection(sums, cfg, view, method, by=(cfg.segment,))
    projected = projection.adjusted(projected, cfg, view, overrides, smooth, (cfg.segment,))
    return projection.portfolio_projection(projection.open_cohorts(projected, cfg), view, cfg.month)


# -- publication -------------------------------------------------------------


def publish_cube(
    df: DataFrame,
    cfg: MonitorConfig,
    axes: Mapping[str, str],
    pds: Sequence[str],
    ids: Mapping[str, int],
    run_month: int,
    path: str,
    axis_labels: Sequence[tuple[str, str]] = fx.TRADITIONAL_AXIS_LABELS,
    pd_titles: Sequence[tuple[str, str]] = fx.TRADITIONAL_PD_TITLES,
    use: str = "",
    tooltip: str | None = None,
    recent: tuple[int, int] | None = None,
    early_until: int | None = None,
    horizons: tuple[int, int, int] = (24, 21, 12),
    method: str = "met1",
    projected_months: int | None = None,
    overrides: DataFrame | None = None,
    smooth: int = 1,
    tables: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Write factor table, cube and label tables below ``path``.

    The cube is evaluated once; its text export reads the stored cube.  Axis
    labels and PD titles differ by product (``fixed_values``).  ``tables``
    names catalog tables to replace with the published ``factors`` and
    ``cube``.  Returns the folder of every part.
    """
    spark = df.sparkSession
    where_to = {
        part: f"{path.rstrip('/')}/{part}"
        for part in ("factors", "cube", "cube_csv", "axis_labels_csv", "pd_titles_csv")
    }
    table = cohorts.factor_table(
        df, cfg, ids, run_month, use, method, projected_months, overrides, smooth
    )
    write_folder(table, where_to["factors"])
    factors = spark.read.parquet(where_to["factors"])

    base = cfg.select_universe(df, use).withColumn("seg_proy", cohorts.segment_id(cfg.segment, ids))
    wide = cube.reporting_cube(
        base, cfg, axes, pds, factors, tooltip or cfg.segment, recent, early_until, horizons
    )
    write_partitioned(wide, where_to["cube"], cfg.month)
    stored = spark.read.parquet(where_to["cube"]).select(*wide.columns)
    published = stored.withColumnsRenamed({k: v for k, v in fx.PUBLISHED_NAMES.items() if k in wide.columns})
    named = factors.withColumnsRenamed({k: v for k, v in fx.PUBLISHED_NAMES.items() if k in factors.columns})
    for part, frame in (("factors", named), ("cube", published)):
        if tables and part in tables:
            save_table(frame, tables[part])
    write_extract(published, where_to["cube_csv"], sep=",", compression="gzip")
    write_extract(label_table(spark, axis_labels, ["EJE", "ETIQUETA"]), where_to["axis_labels_csv"], sep=",")
    write_extract(label_table(spark, pd_titles, ["PD", "DESCRIPTIVO"]), where_to["pd_titles_csv"], sep=",")
    return where_to


def duplicate_audit(df: DataFrame, names: Columns = Columns()) -> DataFrame:
    """Applications that the joins of a base table have multiplied."""
    return quality.duplicate_keys(df, [names.month, names.account])


def high_amount(df: DataFrame, month_from: int, names: Columns = Columns(), p: float = 0.99) -> DataFrame:
    """Approximate upper percentile of the amount since a month."""
    return approx_percentile(where(df, f"{names.month} >= {month_from}"), names.amount, p)
