"""Delimited extracts without a declared schema: types found in the data, bad rows set aside.

All columns are read as text once and stored.  One aggregation then counts, for every column
and every type, the values that do not fit, and the narrowest type that (almost) all values fit
is taken.  Rows with a value that does not fit the type of its column, or with another number
of fields than the header, go to a quarantine frame with the reasons; no row is lost.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scoremon.sources.tables import store

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
TIMESTAMP = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}"
#: From the narrowest on; text fits everything and comes last.
TYPES = ("int", "bigint", "double", "date", "timestamp", "boolean")
BROKEN = "_broken"


def fits(value: Column, kind: str) -> Column:
    """Whether a text stands for a value of a type; null for a null text."""
    shape = {"double": NUMBER, "date": DATE, "timestamp": TIMESTAMP, "boolean": "(?i)^(true|false)$"}
    plain = F.trim(value)
    ok = plain.try_cast(kind).isNotNull()
    return F.when(value.isNotNull(), ok & plain.rlike(shape[kind]) if kind in shape else ok)


@dataclass(frozen=True)
class Extract:
    """Typed rows, rows set aside (``row`` as text per column, ``reasons``), and a row per column.

    ``types`` has column, type, filled (values that are not null) and misfits.
    """

    rows: DataFrame
    quarantine: DataFrame
    types: DataFrame


def read_text(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All fields as text, plus the line where it has another number of fields than the header."""
    reader = spark.read.option("header", True).option("sep", sep)
    names = reader.csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in (*names, BROKEN)])
    raw = (
        reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
        # Header names are checked by position, and the broken line has none.
        .option("enforceSchema", True).csv(path)
    )
    return store(raw, "extract-text")


def find_types(
    raw: DataFrame, tolerance: float = 0.0, declared: Mapping[str, str] | None = None
) -> dict[str, tuple[str, int, int]]:
    """column -> (type, filled, misfits), from one aggregation over all rows.

    A type is taken if at most ``tolerance`` of the values do not fit it; a column without
    values is text.  ``declared`` types are taken as they are.
    """
    declared = dict(declared or {})
    names = [c for c in raw.columns if c != BROKEN]
    whole = raw.filter(F.col(BROKEN).isNull()) if BROKEN in raw.columns else raw
    aggs = []
    for i, c in enumerate(names):
        aggs.append(F.count(F.col(c)).alias(f"n{i}"))
        kinds = [declared[c]] if c in declared else TYPES
        aggs += [F.count_if(~fits(F.col(c), k)).alias(f"n{i}_{k}") for k in kinds if k != "string"]
    # One row: a count per column and type.
    counted = whole.agg(*aggs).first()
    found = {}
    for i, c in enumerate(names):
        filled = counted[f"n{i}"]
        found[c] = ("string", filled, 0)
        for k in [declared[c]] if c in declared else TYPES:
            if k == "string":
                break
            misfits = counted[f"n{i}_{k}"]
            if c in declared or (filled and misfits <= tolerance * filled):
                found[c] = (k, filled, misfits)
                break
    return found


def read_inferred(
    spark: SparkSession, path: str, sep: str = ";", tolerance: float = 0.0,
    declared: Mapping[str, str] | None = None,
) -> Extract:
    """Typed rows of an extract, its quarantined rows and the types found.

    Text that reads as a number becomes one, so identifiers with leading zeros have to be
    ``declared`` as string.  With ``tolerance`` 0 a column with a single odd value is text and
    only broken lines are set aside.
    """
    raw = read_text(spark, path, sep)
    found = find_types(raw, tolerance, declared)
    reasons = [F.when(F.col(BROKEN).isNotNull(), F.lit("fields"))]
    for c, (kind, _, misfits) in found.items():
        if misfits:
            reasons.append(F.when(F.col(BROKEN).isNull() & ~fits(F.col(c), kind), F.lit(c)))
    marked = raw.withColumn("reasons", F.array_compact(F.array(*reasons)))
    typed = marked.filter(F.size("reasons") == 0).select(
        *[F.col(c) if kind == "string" else F.trim(c).cast(kind).alias(c) for c, (kind, _, _) in found.items()]
    )
    bad = marked.filter(F.size("reasons") > 0).select(
        F.struct(*found).alias("row"), F.col(BROKEN).alias("line"), "reasons"
    )
    types = spark.createDataFrame(
        [(c, *x) for c, x in found.items()], "column STRING, type STRING, filled BIGINT, misfits BIGINT"
    )
    return Extract(typed, bad, types)
