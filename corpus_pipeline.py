"""Cleaning of a training corpus in five stages; `run` applies them to `documents`.

Each stage takes (spark, docs, sf_dir) and returns documents with their columns, the last one the pieces of
the packed sequences. Documents meet decisions about them by id and the digest of their text, so rows that
share an id are told apart. A document's own columns travel as one, so extra columns may have any name; rows
with null ids or texts are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.llm import decontaminate, near_dups, packing, quality, suffix_dedup
from ledgerlens.session import stage


# Bytes of a repeated string that the third stage removes. A passage of 50 words has some 300 bytes, and 250 at
# least: strings of 400, as in the query of that operator, would miss most passages of 50 to 60 words.
REPEAT = 250
REPEAT_GRAM = 112


def _key() -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def _matching(docs: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """The rows of `docs` as (row, key), joined with `wanted` (id, text, ...) by id and text."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key().alias("key"))
    wanted = wanted.withColumnsRenamed({"id": "wanted_id", "text": "wanted_text"})
    return rows.join(wanted, F.col("row.doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("key") == F.col("wanted_text")), how)


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted text is not above their language's threshold."""
    trusted = quality.labelled_good(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.classify(docs, trusted).where("keep").select(F.col("doc_id").alias("id"), F.col("key").alias("text")).distinct()
    return _columns(_matching(docs, kept, "left_semi"), docs)


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the lowest id."""
    found = near_dups.classes(docs.select("doc_id", "text")).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # Rows that repeat id and text are counted, so that only they need to be told apart afterwards.
    texts = found.groupBy("class_key", "key").agg(F.first("doc_id").alias("id"), F.count("*").alias("n"))
    first = texts.groupBy("class_key").agg(F.min_by(F.struct("id", "key", "n"), "key").alias("one"))
    first = first.select(F.col("one.id").alias("id"), F.col("one.key").alias("text"), F.col("one.n").alias("n"))
    rows = _matching(docs, first, "inner")
    repeated = rows.where("n > 1").dropDuplicates(["key"])
    return _columns(rows.where("n = 1").unionByName(repeated), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of REPEAT that the corpus holds more than once."""
    left = suffix_dedup.without_repeats(docs, REPEAT, REPEAT_GRAM)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = docs.select(F.struct("doc_id", _key().alias("key")).alias("row"), "text")
    found = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=0, id="row").where("n_hit > 0")
    found = found.select(F.col("row.doc_id").alias("id"), F.col("row.key").alias("text")).distinct()
    return _columns(_matching(docs, found, "left_anti"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 512 to 8192 bytes."""
    return packing.best_fit(docs, F.octet_length("text"))


STAGES = [
    ("quality", keep_quality),
    ("near_dups", one_per_class),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

# The first two stages rest on a trained model and on signatures; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
