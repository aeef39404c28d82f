"""Settings of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.functions import buckets as bk

# Newest month of the derived application base; its target window of 24
# months makes 199908 the newest closed cohort.
RUN_MONTH = 200108

CFG = MonitorConfig.for_run_month(
    RUN_MONTH, pds=("pd",), universe="def_at_origin = 0 AND xb IS NOT NULL"
)
ALL_ROWS = CFG.with_(universe="")
SEGMENT_IDS = {"1. Affluent": 1, "2. Consumer": 2}

SCORE_EDGES = (300, 335, 365, 400)
SCORE_LABELS = ("1. <300", "2. [300 - 335>", "3. [335 - 365>", "4. [365 - 400>", "5. [400 - ++>")
PD_EDGES = (0.015, 0.03, 0.06, 0.12)
PD_LABELS = ("1. [0 - 1.5%]", "2. <1.5 - 3%]", "3. <3 - 6%]", "4. <6 - 12%]", "5. <12 - ++>")
AMOUNT_EDGES = (60_000, 120_000, 180_000, 260_000)
AMOUNT_LABELS = (
    "1. up to 60,000", "2. up to 120,000", "3. up to 180,000", "4. up to 260,000", "5. above 260,000",
)
INCOME_EDGES = (0, 2_500, 5_000, 7_500)
INCOME_LABELS = (
    "1. [- - 0]", "2. <0 - 2,500]", "3. <2,500 - 5,000]", "4. <5,000 - 7,500]", "5. <7,500 - ++>",
)


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def with_drivers(df: DataFrame) -> DataFrame:
    """The bucket drivers used by the driver, stability and cube queries."""
    return df.withColumns(
        {
            "score_r": bk.bucket_right_open("score", SCORE_EDGES, SCORE_LABELS),
            "pd_r": bk.bucket_right_closed("pd", PD_EDGES, PD_LABELS),
            "amount_r": bk.bucket_right_closed("amount", AMOUNT_EDGES, AMOUNT_LABELS),
            "income_r": bk.bucket_right_closed("income", INCOME_EDGES, INCOME_LABELS),
        }
    )


def _case(column: str, edges, labels, op: str) -> str:
    arms = " ".join(f"WHEN {column} {op} {e} THEN '{name}'" for e, name in zip(edges, labels))
    return f"CASE WHEN {column} IS NULL THEN '99. Missing' {arms} ELSE '{labels[-1]}' END"


DRIVERS_SQL = f"""drivers AS (
 SELECT *,
  {_case('score', SCORE_EDGES, SCORE_LABELS, '<')} AS score_r,
  {_case('pd', PD_EDGES, PD_LABELS, '<=')} AS pd_r,
  {_case('amount', AMOUNT_EDGES, AMOUNT_LABELS, '<=')} AS amount_r,
  {_case('income', INCOME_EDGES, INCOME_LABELS, '<=')} AS income_r
 FROM scored)"""
