"""Merkle trees over the sections and paragraphs of documents.

Leaves are pieces of a paragraph (a line), cut after words whose hash is divisible by 8; a paragraph's node
hashes its leaves, a section's its paragraphs, the root its sections. A section ends with a blank line, or
with a paragraph whose own hash says so, so an edit moves only the boundaries beside it. Equal roots mean
equal texts; where roots differ, the branches that differ locate the edit.

A fingerprint is `root|section;section` with paragraphs joined by `,` and eight hex digits for each leaf.

Defined results: a null text is empty and has a tree of one empty leaf; rows with equal ids follow one
another in the order of their texts; null ids come last in descending order; one lone document is its own
next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.bytes_and_words import pieces, words

SECTION = 8  # paragraphs per section, on average
LEAF = 8  # words per leaf, on average


def trees(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    found = words(data, rows)
    cuts = found.end[found.hash % np.uint64(LEAF) == 0]
    first = np.searchsorted(cuts, rows[:-1], side="right")
    last = np.searchsorted(cuts, rows[1:], side="left")
    return [_tree(t, (cuts[a:b] - r).tolist()) for t, a, b, r in zip(texts, first, last, rows)]


def _tree(text: bytes, cuts: list[int]) -> str:
    sha = hashlib.sha256
    sections, section, paragraphs, at, k = [], sha(b"section"), [], 0, 0
    shown = []
    for paragraph in text.split(b"\n"):
        end, begin = at + len(paragraph), at
        leaves = []
        while k < len(cuts) and cuts[k] <= end:
            if begin < cuts[k] < end:
                leaves.append(sha(b"leaf" + text[begin : cuts[k]]).digest())
                begin = cuts[k]
            k += 1
        leaves.append(sha(b"leaf" + text[begin:end]).digest())
        node = sha(b"paragraph" + b"".join(leaves)).digest()
        section.update(node)
        paragraphs.append("".join(x[:4].hex() for x in leaves))
        if not paragraph.strip() or node[0] % SECTION == 0:
            sections.append(section.digest())
            shown.append(",".join(paragraphs))
            section, paragraphs = sha(b"section"), []
        at = end + 1
    if paragraphs:
        sections.append(section.digest())
        shown.append(",".join(paragraphs))
    return sha(b"root" + b"".join(sections)).hexdigest() + "|" + ";".join(shown)


def leaves(fingerprint: str) -> np.ndarray:
    """The leaves in order, 32 bits each."""
    shown = fingerprint.partition("|")[2].replace(";", "").replace(",", "")
    return np.frombuffer(bytes.fromhex(shown), ">u4")


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else the share of leaves that the trees have in common (with multiplicity)."""
    if a[:64] == b[:64]:
        return 1.0
    x, y = leaves(a), leaves(b)
    kinds, where = np.unique(np.concatenate([x, y]), return_inverse=True)
    of_x, of_y = (np.bincount(w, minlength=len(kinds)) for w in (where[: len(x)], where[len(x) :]))
    return float(2 * np.minimum(of_x, of_y).sum() / (len(x) + len(y)))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of b that the tree a does not have; empty for equal texts."""
    if a[:64] == b[:64]:
        return []
    split = lambda f: [s.split(",") for s in f.partition("|")[2].split(";")]
    of_a = split(a)
    known_sections, known = {tuple(s) for s in of_a}, {p for s in of_a for p in s}
    return [(i, j) for i, s in enumerate(split(b)) if tuple(s) not in known_sections for j, p in enumerate(s) if p not in known]


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, fingerprint. No shuffle."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = [(t or "").encode() for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(trees(texts), pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id)


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by the start of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, guest, id, text), partitioned by bucket and sorted: the documents by descending id.

    Ids are cut into buckets of about equal size. Each bucket ends with a guest, the first document of the
    bucket below (of the topmost for the lowest), so every document finds its next one in its own
    partition and texts are shuffled once. Ids must be numbers.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    count = 3 * partitions
    bounds = rows.select("id").approxQuantile("id", [k / count for k in range(1, count)], 0.2 / count)
    bucket = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= F.col("id"))), F.lit(0))
    bucket = F.when(F.col("id").isNull(), 0).otherwise(bucket) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    # One row per bucket.
    heads = sorted(rows.groupBy("bucket").agg(F.max("id").alias("head")).collect(), key=lambda r: r.bucket)
    above = {r.bucket: heads[(k + 1) % len(heads)].bucket for k, r in enumerate(heads)}
    kind = docs.schema[id].dataType.simpleString()
    known = spark.createDataFrame([(r.bucket, r.head, above[r.bucket]) for r in heads], f"bucket int, head {kind}, above int")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("above").alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(F.col("id").eqNullSafe(F.col("head")), F.array(own, guest)).otherwise(F.array(own))
    return (
        rows.join(F.broadcast(known), "bucket")
        .select(F.explode(places).alias("place"), "id", "text")
        .select("place.bucket", "place.guest", "id", "text")
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "guest", F.col("id").desc_nulls_last(), "text")
    )


def compare_with_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (bucket, id, text, fingerprint) of the row whose next row is still to come
        for piece in pieces(batches, "text"):
            texts = ["" if t is None else t for t in piece.column(3).to_pylist()]
            own = trees([t.encode() for t in texts])
            out = []
            for bucket, guest, key, now, tree in zip(*(piece.column(k).to_pylist() for k in range(3)), texts, own):
                if waiting is not None and waiting[0] == bucket:
                    out.append((*waiting[1:], edited(waiting[2], now).encode(), tree))
                waiting = None if guest else (bucket, key, now, tree)
            changed = trees([x[3] for x in out])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], piece.column(2).type),
                    pa.array([len(x[1]) for x in out], pa.int64()),
                    pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string()),
                    pa.array([x[2] for x in out], pa.string()),
                    pa.array(changed, pa.string()),
                    pa.array([likeness(x[2], c) for x, c in zip(out, changed)], pa.float64()),
                    pa.array([likeness(x[2], x[4]) for x in out], pa.float64()),
                ],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id, text).mapInArrow(run, schema).withColumnRenamed("id", id)
