"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import conversations, decontaminate, fingerprints, importance, language, near_dups, ngram_join, packing, quality, suffix_dedup, token_counts, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RULES = [  # Fixed values.
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens are UTF-8 bytes, as for byte-level models."""
    return packing.best_fit(table(spark, folder, "documents"), F.octet_length("text"))


@query
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.classify(docs, quality.labelled_good(labels)).drop("key")


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(~quality.is_held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select(
        "doc_id",
        quality.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query
def op4_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, folder, "documents"))


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(~quality.is_held_out(F.col("doc_id"))))
    held_out = quality.is_held_out(F.col("doc_id")).alias("held_out")
    return language.identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    merges = token_counts.load_merges(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    counts = token_counts.token_counts(table(spark, folder, "documents"), merges)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op7_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.classes(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), slop=0)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Strings of 400 bytes are removed; n_repeated also reports shorter passages of documents that lose nothing."""
    docs = table(spark, folder, "documents")
    return suffix_dedup.removals(docs, gram=suffix_dedup.PASSAGE_GRAM, passage=suffix_dedup.PASSAGE)


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge(table(spark, folder, "pages"), RULES)
    return judged.withColumns({c: F.round(c, 6) for c in ("score", "threshold")})


@query
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.components_of(table(spark, folder, "documents"))


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, folder, "conversations")))
