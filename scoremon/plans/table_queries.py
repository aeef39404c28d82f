"""Registered queries: snapshots, joins, checks, quantiles, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scoremon.config import where
from scoremon.functions.scores import null_sentinels
from scoremon.operators import enrich, quality, quantiles
from scoremon.operators.calibration import monthly_calibration
from scoremon.plans import oracle as sql
from scoremon.plans.registry import query
from scoremon.plans.setup import ALL_ROWS, DRIVERS_SQL, with_drivers
from scoremon.sources import tables as tb
from scoremon.sources import views as v
from scoremon.sources.extracts import read_inferred

# -- snapshots and sinks -----------------------------------------------------

EXTRACT_COLUMNS = ("app_id", "codmes", "client_id", "xb_alt", "debt_raw")
EXTRACT_SCHEMA = "app_id BIGINT, codmes INT, client_id BIGINT, xb_alt DOUBLE, debt_raw DOUBLE"


@query(
    "distinct_snapshot",
    sql.base(
        "SELECT DISTINCT app_id, codmes, client_id, round(xb_alt, 6) AS xb_alt, debt_raw FROM app_ext",
        sql.APP_EXT,
    ),
)
def distinct_snapshot(spark, sf_dir):
    snap = tb.distinct_snapshot(v.app_ext(spark, sf_dir))
    return snap.select("app_id", "codmes", "client_id", F.round("xb_alt", 6).alias("xb_alt"), "debt_raw")


@query(
    "csv_roundtrip",
    sql.base(
        "SELECT app_id, codmes, client_id, round(xb_alt, 6) AS xb_alt, debt_raw FROM app_ext", sql.APP_EXT
    ),
)
def csv_roundtrip(spark, sf_dir):
    path = tb.work_dir(spark, "extract")
    tb.write_extract(v.app_ext(spark, sf_dir), path)
    back = tb.read_extract(spark, path, EXTRACT_SCHEMA)
    return back.select("app_id", "codmes", "client_id", F.round("xb_alt", 6).alias("xb_alt"), "debt_raw")


# An extract as it comes: text, some values that are no numbers, some lines cut short.
ODD_VALUE, CUT_LINE = 97, 101
RAW_SQL = f"""raw AS (SELECT *, app_id % {CUT_LINE} = 0 AS cut, app_id % {ODD_VALUE} = 0 AND debt_raw IS NOT NULL AS odd FROM app_ext)"""


def _inferred(spark, sf_dir):
    path = tb.work_dir(spark, "raw-extract")
    rows = v.app_ext(spark, sf_dir)
    names = EXTRACT_COLUMNS
    fields = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names}
    fields["debt_raw"] = F.when(
        (F.col("app_id") % ODD_VALUE == 0) & F.col("debt_raw").isNotNull(), "n/a"
    ).otherwise(fields["debt_raw"])
    cut = F.col("app_id") % CUT_LINE == 0
    line = F.when(cut, F.concat_ws(";", *[fields[c] for c in names[:3]])).otherwise(
        F.concat_ws(";", *fields.values())
    )
    # One column that is the whole line, so lines may have any number of fields.
    rows.select(line.alias(";".join(names))).write.option("header", True).option("sep", "\u0001").option(
        "quote", "\u0000"
    ).csv(path)
    return read_inferred(spark, path, tolerance=0.05)


@query(
    "csv_inferred",
    sql.base(
        "SELECT app_id, codmes, client_id, round(xb_alt, 6) AS xb_alt, debt_raw FROM raw WHERE NOT cut AND NOT odd",
        sql.APP_EXT, RAW_SQL,
    ),
)
def csv_inferred(spark, sf_dir):
    """Rows of an extract under the types found in it."""
    rows = _inferred(spark, sf_dir).rows
    return rows.select("app_id", "codmes", "client_id", F.round("xb_alt", 6).alias("xb_alt"), "debt_raw")


@query(
    "csv_types",
    sql.base(
        """
, whole AS (SELECT * FROM raw WHERE NOT cut)
SELECT 'app_id' AS "column", 'int' AS type, count(app_id) AS filled, CAST(0 AS BIGINT) AS misfits FROM whole
UNION ALL SELECT 'codmes', 'int', count(codmes), 0 FROM whole
UNION ALL SELECT 'client_id', 'int', count(client_id), 0 FROM whole
UNION ALL SELECT 'xb_alt', 'double', count(xb_alt), 0 FROM whole
UNION ALL SELECT 'debt_raw', 'double', count(debt_raw), count(*) FILTER (WHERE odd) FROM whole
""",
        sql.APP_EXT, RAW_SQL,
    ),
)
def csv_types(spark, sf_dir):
    """The types of an extract, with the values that do not fit them."""
    return _inferred(spark, sf_dir).types


@query(
    "csv_quarantine",
    sql.base(
        """
SELECT CAST(app_id AS VARCHAR) AS app_id, CASE WHEN cut THEN 'fields' ELSE 'debt_raw' END AS reasons,
 CASE WHEN cut THEN app_id || ';' || codmes || ';' || client_id END AS line
FROM raw WHERE cut OR odd
""",
        sql.APP_EXT, RAW_SQL,
    ),
)
def csv_quarantine(spark, sf_dir):
    """The rows of an extract that do not fit, with the reason."""
    bad = _inferred(spark, sf_dir).quarantine
    return bad.select("row.app_id", F.array_join("reasons", ",").alias("reasons"), "line")


@query(
    "replace_from_itself",
    sql.base(
        "SELECT job_type, CAST(3*count(*) AS BIGINT) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)*3 AS amount "
        "FROM app_base GROUP BY job_type"
    ),
)
def replace_from_itself(spark, sf_dir):
    """A folder and a catalog table, each replaced by rows computed from its own old version."""
    rows = v.app_base(spark, sf_dir).groupBy("job_type").agg(
        F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount")
    )
    path, table = tb.work_dir(spark, "replaced"), f"replaced_{uuid.uuid4().hex}"
    tb.write_folder(rows, path)
    old = tb.read_folder(spark, path)
    tb.write_folder(old.withColumns({"n": F.col("n") * 3, "amount": F.col("amount") * 3}), path)
    tb.save_table(tb.read_folder(spark, path).withColumn("n", F.lit(0).cast("long")), table, f"{path}-table")
    # The table keeps the amounts and takes the counts from the folder.
    now = tb.read_folder(spark, path).select("job_type", "n")
    tb.save_table(spark.table(table).drop("n").join(now, "job_type").select("job_type", "n", "amount"), table, f"{path}-table")
    return spark.table(table)


# -- joins -------------------------------------------------------------------


@query(
    "left_join_enrich",
    sql.base(
        """
SELECT b.app_id, b.codmes, b.client_id, round(e.xb_alt, 6) AS xb_alt, e.debt_raw AS income
FROM app_base b LEFT JOIN (SELECT DISTINCT app_id, codmes, xb_alt, debt_raw FROM app_ext WHERE xb_alt IS NOT NULL) e
 ON b.codmes = e.codmes AND b.app_id = e.app_id
""",
        sql.APP_EXT,
    ),
)
def left_join_enrich(spark, sf_dir):
    joined = enrich.left_enrich(
        v.app_base(spark, sf_dir), v.app_ext(spark, sf_dir), ["codmes", "app_id"],
        {"xb_alt": "xb_alt", "debt_raw": "income"}, keep_if="xb_alt IS NOT NULL",
    )
    return joined.select("app_id", "codmes", "client_id", F.round("xb_alt", 6).alias("xb_alt"), "income")


@query(
    "latest_per_key",
    sql.base(
        """
, last_run AS (SELECT req_id, max(run_month) AS run_month FROM eval_log WHERE district <> '3. Rest' GROUP BY req_id),
latest AS (SELECT e.* FROM eval_log e JOIN last_run l ON e.req_id = l.req_id AND e.run_month = l.run_month
 WHERE e.district <> '3. Rest')
SELECT b.app_id, b.client_id AS req_id, l.app_id AS log_app_id, l.run_month, l.district
FROM app_base b LEFT JOIN latest l ON l.req_id = b.client_id
""",
        sql.EVAL_LOG,
    ),
)
def latest_per_key(spark, sf_dir):
    log = tb.store(v.eval_log(spark, sf_dir), "log")
    latest = enrich.latest_per_key(
        log, "req_id", "run_month", keep_if="district <> '3. Rest'"
    ).withColumnRenamed("app_id", "log_app_id")
    base = v.stored_base(spark, sf_dir).select("app_id", F.col("client_id").alias("req_id"))
    return base.join(latest, "req_id", "left").select("app_id", "req_id", "log_app_id", "run_month", "district")


@query(
    "forward_delinquency",
    sql.base(
        """
SELECT p.client_id, p.codmes, CAST(p.balance AS DOUBLE) AS balance, p.days_late,
 coalesce(p1.days_late, 0) AS days_late_f1, coalesce(p2.days_late, 0) AS days_late_f2,
 coalesce(p3.days_late, 0) AS days_late_f3
FROM panel p
LEFT JOIN panel p1 ON p1.client_id = p.client_id AND p1.month_idx = p.month_idx + 1
LEFT JOIN panel p2 ON p2.client_id = p.client_id AND p2.month_idx = p.month_idx + 2
LEFT JOIN panel p3 ON p3.client_id = p.client_id AND p3.month_idx = p.month_idx + 3
WHERE p.codmes BETWEEN 199503 AND 200106
""",
        sql.PANEL,
    ),
)
def forward_delinquency(spark, sf_dir):
    panel = tb.store(v.panel(spark, sf_dir), "panel")
    out = enrich.forward_panel(panel, "client_id", "days_late", 199503, 200106)
    return out.select(
        "client_id", "codmes", F.col("balance").cast("double").alias("balance"),
        "days_late", "days_late_f1", "days_late_f2", "days_late_f3",
    )


@query(
    "union_segments",
    sql.base(
        """
SELECT codmes, segment, count(*) AS n, CAST(sum(CASE WHEN dist_def <= 24 THEN 1 ELSE 0 END) AS BIGINT) AS def24
FROM app_base WHERE segment = '1. Affluent' GROUP BY 1, 2
UNION ALL
SELECT codmes, segment, count(*), NULL FROM app_base WHERE segment = '2. Consumer' GROUP BY 1, 2
UNION ALL
SELECT codmes, segment, count(*), NULL FROM app_base WHERE segment = '3. Rest' GROUP BY 1, 2
"""
    ),
)
def union_segments(spark, sf_dir):
    base = v.app_base(spark, sf_dir)
    full = where(base, "segment = '1. Affluent'").groupBy("codmes", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ALL_ROWS.defaulted(24)).alias("def24")
    )
    short = [
        where(base, f"segment = '{s}'").groupBy("segment", "codmes").agg(F.count(F.lit(1)).alias("n"))
        for s in ("2. Consumer", "3. Rest")
    ]
    return enrich.union_parts([full, *short], allow_missing=True)


# -- checks ------------------------------------------------------------------


@query(
    "duplicate_keys",
    sql.base("SELECT codmes, client_id, count(*) AS count FROM app_base GROUP BY codmes, client_id HAVING count(*) > 1"),
)
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(v.stored_base(spark, sf_dir), ["codmes", "client_id"])


@query(
    "missing_by_month",
    sql.base(
        """
SELECT codmes, CAST(sum(CASE WHEN xb IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS miss_pd,
 CAST(sum(CASE WHEN xb IS NULL AND dist_def IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS miss_both, count(*) AS n
FROM app_base WHERE codmes >= 199701 GROUP BY codmes
"""
    ),
)
def missing_by_month(spark, sf_dir):
    base = where(v.app_base(spark, sf_dir), "codmes >= 199701")
    return quality.missing_by(base, ["codmes"], {"miss_pd": ["xb"], "miss_both": ["xb", "dist_def"]})


@query("bucket_counts", sql.scored("SELECT score_r, count(*) AS count FROM drivers GROUP BY score_r", DRIVERS_SQL))
def bucket_counts(spark, sf_dir):
    return quality.bucket_counts(with_drivers(v.scored_base(spark, sf_dir)), "score_r")


PROFILED = ("app_id", "client_id", "codmes", "job_type", "segment", "def_at_origin", "dist_def")


@query(
    "table_profile",
    sql.base(
        " UNION ALL ".join(
            f"SELECT count(*) AS n, 11 AS n_columns, '{c}' AS column_name, count(*) - count({c}) AS nulls, "
            f"CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM app_base"
            for c in PROFILED
        )
    ),
)
def table_profile(spark, sf_dir):
    return quality.table_profile(v.app_base(spark, sf_dir), PROFILED)


def _cube_sql(name: str, predicate: str) -> str:
    return f"""{name} AS (SELECT codmes, count(*) AS n,
 CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)/1000000 AS amount_mm, sum(pd)/count(*) AS pd_mean,
 CAST(sum(CASE WHEN dist_def<=24 THEN 1 ELSE 0 END) AS DOUBLE)/count(*) AS rd24,
 CAST(sum(CASE WHEN dist_def<=18 THEN 1 ELSE 0 END) AS DOUBLE)/count(*) AS rd18,
 CAST(sum(CASE WHEN dist_def<=24 THEN 1 ELSE 0 END) AS BIGINT) AS def24
 FROM scored WHERE {predicate} GROUP BY codmes)"""


RECONCILE_SQL = sql.scored(
    """
SELECT a.codmes, a.n - b.n AS dif_n, round(a.amount_mm - b.amount_mm, 2) AS dif_amount_mm,
 round(a.pd_mean - b.pd_mean, 2) AS dif_pd_mean, round(a.rd24 - b.rd24, 2) AS dif_rd24,
 round(a.rd18 - b.rd18, 2) AS dif_rd18, a.def24 - b.def24 AS dif_def24
FROM a JOIN b ON a.codmes = b.codmes
""",
    _cube_sql("a", "def_at_origin = 0 AND codmes >= 199601 AND xb IS NOT NULL"),
    _cube_sql("b", "def_at_origin = 0 AND codmes >= 199601"),
)


@query("reconcile_monthly", RECONCILE_SQL)
def reconcile_monthly(spark, sf_dir):
    base = where(v.scored_base(spark, sf_dir), "def_at_origin = 0 AND codmes >= 199601")
    return quality.reconcile_universes(base, ALL_ROWS, "xb IS NOT NULL", "")


@query("reconcile_join", RECONCILE_SQL)
def reconcile_join(spark, sf_dir):
    """The same differences from two monthly cubes joined on the month."""
    base = where(v.stored_base(spark, sf_dir), "def_at_origin = 0 AND codmes >= 199601")
    cubes = [monthly_calibration(where(base, p), ALL_ROWS) for p in ("xb IS NOT NULL", "")]
    columns = ["n", "amount_mm", "pd_mean", "rd24", "rd18", "def24"]
    return quality.reconcile(*cubes, "codmes", columns)


@query(
    "table_diff",
    sql.base(
        """
, a AS (SELECT app_id, codmes, client_id, xb_alt, debt_raw FROM app_ext GROUP BY ALL),
b AS (SELECT app_id, codmes, client_id, xb_alt,
 CASE WHEN debt_raw IN (1111111111, -2222222222) THEN NULL ELSE debt_raw END AS debt_raw, 1 AS extra
 FROM (SELECT * FROM app_ext GROUP BY ALL) WHERE app_id % 7 <> 0),
j AS (SELECT a.app_id AS la, b.app_id AS rb,
 a.codmes IS DISTINCT FROM b.codmes AS x1, a.client_id IS DISTINCT FROM b.client_id AS x2,
 a.xb_alt IS DISTINCT FROM b.xb_alt AS x3, a.debt_raw IS DISTINCT FROM b.debt_raw AS x4
 FROM a FULL OUTER JOIN b ON a.app_id = b.app_id),
twice AS (SELECT app_id FROM app_ext GROUP BY app_id HAVING count(*) > 1),
t AS (SELECT (SELECT count(*) FROM twice) AS left_repeated,
 (SELECT count(*) FROM twice WHERE app_id % 7 <> 0) AS right_repeated, count(*) FILTER (WHERE la IS NOT NULL AND rb IS NOT NULL) AS matched,
 count(*) FILTER (WHERE rb IS NULL) AS left_only, count(*) FILTER (WHERE la IS NULL) AS right_only,
 count(*) FILTER (WHERE la IS NOT NULL AND rb IS NOT NULL AND x1) AS m1,
 count(*) FILTER (WHERE la IS NOT NULL AND rb IS NOT NULL AND x2) AS m2,
 count(*) FILTER (WHERE la IS NOT NULL AND rb IS NOT NULL AND x3) AS m3,
 count(*) FILTER (WHERE la IS NOT NULL AND rb IS NOT NULL AND x4) AS m4 FROM j)
SELECT 'codmes' AS column_name, 'both' AS present, m1 AS mismatches, matched, left_only, right_only, left_repeated, right_repeated FROM t
UNION ALL SELECT 'client_id', 'both', m2, matched, left_only, right_only, left_repeated, right_repeated FROM t
UNION ALL SELECT 'xb_alt', 'both', m3, matched, left_only, right_only, left_repeated, right_repeated FROM t
UNION ALL SELECT 'debt_raw', 'both', m4, matched, left_only, right_only, left_repeated, right_repeated FROM t
UNION ALL SELECT 'extra', 'right_only', NULL, matched, left_only, right_only, left_repeated, right_repeated FROM t
""",
        sql.APP_EXT,
    ),
)
def table_diff(spark, sf_dir):
    ext = tb.store(v.app_ext(spark, sf_dir), "extract")
    cleaned = where(ext, "app_id % 7 <> 0").withColumns(
        {"debt_raw": null_sentinels("debt_raw"), "extra": F.lit(1)}
    )
    return quality.table_diff(ext, cleaned, ["app_id"])


# -- quantiles ---------------------------------------------------------------

WINDOW = "codmes BETWEEN 199601 AND 200012 AND def_at_origin = 0"


def _label_sql(c: str) -> str:
    def f(x: str) -> str:
        return f"CAST(CAST({x} AS DECIMAL(18,3)) AS VARCHAR)"

    return f"""CASE WHEN {c} <= {c}_1 THEN '1. ' || {f(f'{c}_0')} || ' - ' || {f(f'{c}_1')}
 WHEN {c} <= {c}_2 THEN '2. ' || {f(f'{c}_1')} || ' - ' || {f(f'{c}_2')}
 WHEN {c} <= {c}_3 THEN '3. ' || {f(f'{c}_2')} || ' - ' || {f(f'{c}_3')}
 WHEN {c} <= {c}_4 THEN '4. ' || {f(f'{c}_3')} || ' - ' || {f(f'{c}_4')}
 ELSE '98. Missing' END AS {c}_q"""


def _cuts_sql(c: str) -> str:
    qs = ", ".join(
        f"quantile_disc({c}, {p}) FILTER (WHERE {WINDOW} AND {c} IS NOT NULL) AS {c}_{i}"
        for i, p in ((1, 0.25), (2, 0.5), (3, 0.75), (4, 1.0))
    )
    return f"min({c}) AS {c}_0, {qs}"


QUANTILE_COLUMNS = ("amount", "income", "score")


@query(
    "quantile_buckets",
    sql.scored(
        "SELECT app_id, " + ", ".join(_label_sql(c) for c in QUANTILE_COLUMNS) + " FROM scored, cuts",
        "cuts AS (SELECT " + ", ".join(_cuts_sql(c) for c in QUANTILE_COLUMNS) + " FROM scored)",
    ),
)
def quantile_buckets(spark, sf_dir):
    # Exact cuts read their input several times: store the derived base once.
    base = v.scored_base(spark, sf_dir).select("app_id", "codmes", "def_at_origin", *QUANTILE_COLUMNS)
    out = quantiles.quantile_buckets(tb.store(base, "base"), QUANTILE_COLUMNS, WINDOW, exact=True)
    return out.select("app_id", *[f"{c}_q" for c in QUANTILE_COLUMNS])


APPROX_COLUMNS = ("amount", "income", "score", "pd")


@query(
    "quantile_buckets_approx",
    sql.scored(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, cut, count({c}) AS n, true AS within_bound, count({c}) AS labelled "
            f"FROM scored, (VALUES (1), (2), (3), (4)) t(cut) WHERE {WINDOW} GROUP BY cut"
            for c in APPROX_COLUMNS
        )
    ),
)
def quantile_buckets_approx(spark, sf_dir):
    """The rank of every approximate cut is within the promised error, and all rows get a bucket."""
    base = v.stored_base(spark, sf_dir)
    cuts = quantiles.approx_cuts(base, APPROX_COLUMNS, WINDOW)
    ranks = quantiles.rank_check(base, cuts, WINDOW, quantiles.QUARTILES, 0.01)
    labelled = where(quantiles.quantile_buckets(base, APPROX_COLUMNS, WINDOW), WINDOW)
    pairs = ", ".join(f"'{c}', {c}_q" for c in APPROX_COLUMNS)
    used = labelled.selectExpr(f"stack({len(APPROX_COLUMNS)}, {pairs}) AS (column_name, label)").groupBy(
        "column_name"
    ).agg(F.count_if(F.col("label") != quantiles.MISSING).alias("labelled"))
    return ranks.join(used, "column_name")


@query(
    "amount_p99",
    sql.base("SELECT count(amount) AS n, true AS within_bound FROM app_base WHERE codmes >= 199601"),
)
def amount_p99(spark, sf_dir):
    """The approximate percentile stands within 1/10,000 of all rows from the exact rank."""
    base = where(v.stored_base(spark, sf_dir), "codmes >= 199601")
    cut = quantiles.approx_percentile(base, "amount", 0.99).first()[0]
    ranks = quantiles.rank_check(base, {"amount": quantiles.Cuts(None, [cut])}, "", (0.99,), 1e-4)
    return ranks.select("n", "within_bound")
