"""Monitoring inputs derived from the order tables.

The order tables stand in for a loan book: one order is one application.
Each view exists twice: as a DataFrame here and as SQL text for the oracle
(``scoremon.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremon.functions.months import year_text
from scoremon.functions.scores import logit_to_pd, logit_to_score
from scoremon.sources.tables import is_stored, store, work_dir


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returns_by_month(lineitem: DataFrame) -> DataFrame:
    """Returned lines per (order, ship month): count and latest ship time.

    An order with a huge number of lines shrinks to one row per month here,
    with map-side combining, before anything is joined on the order key.
    """
    return (
        lineitem.filter("l_returnflag = 'R'")
        .groupBy(
            "l_orderkey",
            (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("ship_idx"),
        )
        .agg(F.count(F.lit(1)).alias("lines"), F.max("l_shipdate").alias("last_ship"))
    )


def app_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per application.

    ``dist_def`` is the number of months to the first return shipped after
    the order; a month counts when its latest return is later than the order.
    """
    orders = load(spark, sf_dir, "orders").withColumn(
        "order_idx", F.year("o_orderdate") * 12 + F.month("o_orderdate")
    )
    returns = returns_by_month(load(spark, sf_dir, "lineitem"))
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    # The group keys start with the join key, so the aggregate reuses its shuffle.
    keys = [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "order_idx", "o_orderpriority",
    ]
    with_returns = (
        orders.join(returns, orders.o_orderkey == returns.l_orderkey, "left")
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("lines"), F.lit(0)).cast("int").alias("n_ret"),
            F.min(
                F.expr("CASE WHEN last_ship > o_orderdate THEN ship_idx - order_idx END")
            ).alias("dist_def"),
        )
    )
    return with_returns.join(
        customer, with_returns.o_custkey == customer.c_custkey, "inner"
    ).select(
        F.col("o_orderkey").alias("app_id"),
        F.col("o_custkey").alias("client_id"),
        F.expr("CAST(floor((order_idx - 1) / 12) * 100 + (order_idx - 1) % 12 + 1 AS INT)").alias("codmes"),
        F.expr("CAST(order_idx - 1 AS INT)").alias("month_idx"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("income"),
        F.col("c_mktsegment").alias("job_type"),
        F.expr(
            """CASE WHEN o_orderpriority = '1-URGENT' THEN '1. Affluent'
                    WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN '2. Consumer'
                    ELSE '3. Rest' END"""
        ).alias("segment"),
        F.expr(
            "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 1 ELSE 0 END"
        ).alias("def_at_origin"),
        F.expr(
            """CASE WHEN o_orderkey % 17 = 0 THEN NULL
                    ELSE -3.5 + 0.6 * n_ret - 0.0001 * c_acctbal END"""
        ).alias("xb"),
        F.col("dist_def").cast("int").alias("dist_def"),
    )


def scored_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``app_base`` with the probability and score derived from the logit."""
    return app_base(spark, sf_dir).withColumns(
        {"pd": logit_to_pd("xb"), "score": logit_to_score("xb")}
    )


def stored_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored_base`` written once, for queries that read it several times.

    The joins behind it then run once per application and folder, and each
    pass reads only its columns.  A stored table also carries no partitioning
    on the client, so a client with very many rows is combined before the
    shuffle, or split by adaptive execution, wherever it is joined or grouped.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _bases or not is_stored(spark, _bases[key]):
        _bases[key] = work_dir(spark, "base")
        store(scored_base(spark, sf_dir), "base", _bases[key])
    return spark.read.parquet(_bases[key])


_bases: dict[tuple[str, str], str] = {}


def app_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second scored extract: part of the applications, some of them twice."""
    return (
        app_base(spark, sf_dir)
        .withColumn("copies", F.expr("CAST(app_id % 5 <> 0 AS INT) + CAST(app_id % 50 = 1 AS INT)"))
        .filter("copies > 0")
        .select(
            "app_id", "codmes", "client_id",
            F.expr("xb + 0.25").alias("xb_alt"),
            F.expr(
                """CASE WHEN app_id % 23 = 0 THEN CAST(1111111111.0 AS DOUBLE)
                        WHEN app_id % 29 = 0 THEN CAST(-2222222222.0 AS DOUBLE)
                        ELSE floor(income) / 100 END"""
            ).alias("debt_raw"),
            F.explode(F.expr("sequence(1, copies)")).alias("copy"),
        )
        .drop("copy")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delinquency panel: one row per client and month."""
    return (
        stored_base(spark, sf_dir)
        .groupBy("client_id", "month_idx")
        .agg(
            F.max("codmes").alias("codmes"),
            F.sum(F.col("amount").cast("decimal(18,2)")).alias("balance"),
            F.max(F.expr("CASE WHEN dist_def <= 3 THEN 30 * (4 - dist_def) ELSE 0 END")).alias("days_late"),
        )
    )


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation log: several runs per request, ties on the last month."""
    return stored_base(spark, sf_dir).select(
        F.col("client_id").alias("req_id"),
        F.col("codmes").alias("run_month"),
        F.col("segment").alias("district"),
        "app_id",
    )


def app_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with the region and nation of the client."""
    customer = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), "c_nationkey"
    )
    nation = load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"),
        F.col("n_regionkey").alias("r_regionkey"),
    )
    region = load(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("app_id"), F.col("o_custkey").alias("client_id")
    )
    places = customer.join(nation, "c_nationkey").join(region, "r_regionkey")
    return orders.join(places, "client_id").select("app_id", "region", "nation")


def geo_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone risk rules: one for a whole region, some for single nations."""
    region = load(spark, sf_dir, "region")
    return region.select(
        F.col("r_name").alias("region"),
        F.explode(
            F.expr(
                """CASE r_name
                   WHEN 'AFRICA' THEN array(struct(CAST(NULL AS STRING) AS nation, 'HIGH' AS risk))
                   WHEN 'ASIA' THEN array(struct('NATION_2' AS nation, 'HIGH' AS risk),
                                          struct('NATION_7' AS nation, 'HIGH' AS risk))
                   WHEN 'EUROPE' THEN array(struct('NATION_3' AS nation, 'LOW' AS risk)) END"""
            )
        ).alias("rule"),
    ).select("region", "rule.nation", "rule.risk")


def calendar(df: DataFrame) -> DataFrame:
    """Calendar drivers of the cohort month."""
    return df.withColumns(
        {
            "codyear": year_text("codmes"),
            "quarter": F.expr("concat('Q', CAST(floor((codmes % 100 + 2) / 3) AS INT))"),
            "half": F.expr("concat('H', CAST(floor((codmes % 100 + 5) / 6) AS INT))"),
        }
    )
