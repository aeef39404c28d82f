"""The registered queries: each operator over its whole table, as digest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremon.llm import (
    decontaminate,
    language,
    merkle,
    mixing,
    ngram_join,
    oracles,
    quality,
    secrets,
    sharding,
    spelling,
    suffix_family,
    tool_calls,
    topk_search,
    vector_forest,
)
from scoremon.llm.common import table
from scoremon.llm.registry import ORACLES, QUERIES, query  # noqa: F401


@query("op10_benchmark_decontamination", oracles.LEAKS)
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(
            F.array_join(F.sort_array(F.col("hit_items").cast("array<string>")), ","), 256
        ).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query("op9_ngram_jaccard_join", oracles.NEAR_TEXTS)
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents", "doc_id", "text"))
    placed = sharding.assign(rows, 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_source_mixing")
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_rows(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.train(docs)
    return language.labelled(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out().alias("held_out"), "lang_pred", "score"
    )


@query("op6_embedding_near_dedup")
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    return found.select(
        "doc_id", *(secrets.counted(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.listed("base_spans"), 256).alias("base_sha256"),
        secrets.listed("all_spans").alias("spans"),
        secrets.counted("markov", "all_spans").alias("n_markov"),
    )


@query("op8_tool_call_linking", oracles.TOOL_CALLS)
def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns_as_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(tool_calls.TURN_SCHEMAS, "name string, schema string")
    return tool_calls.linked(calls, results, schemas)


@query("op7_suffix_array_dedup", oracles.REPEATS)
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_family.repeated(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda t, s: t + (s["stop"] - s["start"])
    )
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "kept_sha256",
    )


@query("op11_merkle_manifest", oracles.MERKLE)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    found = F.when(merkle.tampered(), merkle.leaf_digest(text=merkle.lowered(F.col("text"))))
    return merkle.manifest(docs, found)


@query("op12_exact_topk", oracles.TOPK)
def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


@query("op13_spelling_variants", oracles.SPELLING)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.spoilt_words(table(spark, sf_dir, "documents", "doc_id", "text")))
