"""Whole-corpus pipeline: each stage takes the documents that its predecessor kept.

Quality, near duplicates, benchmark passages, source weights, shards.  Every stage function
takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremon.llm import decontaminate, mixing, ngram_join, quality, sharding
from scoremon.llm.common import discard, store, stored, table

SHARDS = 8

#: Folders of the numbered documents of earlier stages.
_copies: list[str] = []


def numbered(docs: DataFrame) -> DataFrame:
    """Stored documents with a number of their own in ``_row``.

    The copy that an earlier stage has made goes, if the documents are no longer read from it.
    """
    files = docs.inputFiles() if _copies else []
    for old in [c for c in _copies if not any(c in f for f in files)]:
        discard(docs.sparkSession, old)
        _copies.remove(old)
    rows, path = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-documents")
    _copies.append(path)
    return rows


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; the score column does not stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model, "_score")
    return scored.where(F.col("_score") >= quality.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest doc_id, null ids last.

    Of rows with that id the least by the hashes of text and row stays, one of equal rows.
    Documents without words are in no group and stay.
    """
    names = docs.columns
    ids = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        # The ids tell the rows apart: the component is the smallest one.
        rows, key = docs, "doc_id"
        groups = ngram_join.similar_groups(docs.select("doc_id", "text"))
        gone = groups.where("doc_id <> component_id").select("doc_id")
    else:
        rows, key = numbered(docs), "_row"
        groups = ngram_join.similar_groups(rows.select(F.col("_row").alias("doc_id"), "text")).where("n_shingles > 0")
        least = F.struct(
            F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64(*names), "_row"
        ).alias("_rank")
        ranked = rows.select("_row", least).join(
            groups.select(F.col("doc_id").alias("_row"), "component_id"), "_row"
        )
        best = ranked.groupBy("component_id").agg(F.min("_rank")["_row"].alias("_best"))
        gone = ranked.select("_row").join(best.select(F.col("_best").alias("_row")), "_row", "left_anti")
    # Stored keys: Spark knows their size and leaves the texts in place while they are few.
    gone = store(gone, "near-duplicates")
    return rows.join(gone, key, "left_anti").select(*names)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; n_chars follows where a text changed."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    hit = F.size("hit_spans") > 0
    clean = decontaminate.remove(found.withColumn("_hit_text", hit))
    return clean.withColumn(
        "n_chars", F.when(F.col("_hit_text"), F.length("text")).otherwise(F.col("n_chars")).cast("long")
    ).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the schedule of the source mix takes them: not at all to 3 times."""
    return mixing.repeated(numbered(docs), row="_row")


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    rows = numbered(docs)
    placed = sharding.assign(sharding.shard_rows(rows, F.col("_row")), SHARDS)
    placed = placed.select(F.col("tie").alias("_row"), "shard", "slot")
    return rows.join(placed, "_row").select(*docs.columns, "shard", "slot")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmarks),
    ("mixing to target weights", mix_sources),
    ("sharding", into_shards),
]

#: No SQL: a trained model, similarity joins and an FM-index search are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
