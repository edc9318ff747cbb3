"""Benchmark passages in documents: a distributed positional inverted index.

`build_index` writes one row per shard of documents: the distinct terms of the shard and, term by term,
the sorted places at which each occurs. `search` cuts the items into windows and, in every shard, starts
from the places of each window's rarest term, shifts them by the term's offset in the window and intersects
them with the shifted lists of the other terms, rarest first. What survives with shift 0 everywhere is a
phrase; what survives within `slop` words per term is a proximity match.

Shards are partitioned by document, so a passage that a third of all documents share is spread as the
documents are, and no posting is shuffled. The items go to the shards in blocks of bounded size.

Terms are 64-bit hashes of words. A wrong hit needs a colliding word amid the other words of a window.

Defined results: a null or word-free text has no words and no hits; a null item id counts as the empty
string; rows with the same id stay separate rows; items with the same id are one item; no items, no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.bytes_and_words import pieces, ranges, text_hashes, utf8, words
from ledgerlens.session import small_batches, stage

BLOCK_WINDOWS = 100_000  # windows sent to all shards at once (80 bytes each, and an id)
SHARD_BYTES = 300_000  # of text, so that a shard's row stays below a megabyte
CANDIDATES = 200_000  # places held at once while lists are intersected
SHARD_SCHEMA = "shard string, ids array<{id}>, n_words array<int>, terms binary, counts binary, places binary"


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged table with one row per shard of about SHARD_BYTES of text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in enumerate(pieces(batches, "text", SHARD_BYTES)):
            found = words(*utf8(piece.column(1)))
            order = np.argsort(found.hash, kind="stable")
            terms, counts = np.unique(found.hash, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{piece.column(2)[0].as_py()}-{number}"]),
                    pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), piece.column(0)),
                    pa.array([np.diff(found.first).astype(np.int32)], pa.list_(pa.int32())),
                    *(
                        pa.array([x.tobytes()], pa.binary())
                        for x in (terms, counts.astype(np.uint32), order.astype(np.uint32))
                    ),
                ],
                ["shard", "ids", "n_words", "terms", "counts", "places"],
            )

    return stage(rows.mapInArrow(shards, SHARD_SCHEMA.format(id=kind)))


def item_windows(items: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """(item_id, window): `width` consecutive words, or all words of a shorter item, as bytes of hashes."""
    rows = items.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item_id"), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for item, terms in zip(batch.column(0).to_pylist(), text_hashes(texts)):
                for k in range(max(len(terms) - width + 1, min(len(terms), 1))):
                    ids.append(item)
                    out.append(terms[k : k + width].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["item_id", "window"])

    return rows.mapInArrow(cut, "item_id string, window binary").distinct()


class Queries(NamedTuple):
    """Windows of one block, ready to be intersected with any shard."""

    items: list[str]
    length: np.ndarray  # words of each window
    terms: np.ndarray  # distinct terms of all windows
    term: np.ndarray  # term of each word of each window, as an index
    used: np.ndarray  # whether a window has that word


def as_queries(rows: list, width: int) -> Queries:
    length = np.array([len(r.window) // 8 for r in rows])
    padded = np.zeros((len(rows), width), np.uint64)
    used = np.arange(width) < length[:, None]
    padded[used] = np.frombuffer(b"".join(r.window for r in rows), np.uint64)
    terms, term = np.unique(padded, return_inverse=True)
    return Queries([r.item_id for r in rows], length, terms, term.reshape(padded.shape), used)


def intersect(q: Queries, terms, counts, places, first, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, start and whether it is a phrase, of every match in one shard."""
    at = np.searchsorted(terms, q.terms)
    known = np.zeros(len(q.terms), bool)
    inside = at < len(terms)
    known[inside] = terms[at[inside]] == q.terms[inside]
    size = np.where(known, counts[np.minimum(at, len(terms) - 1)], 0).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.minimum(at, len(terms) - 1)]
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | places.astype(np.int64)
    lists = np.where(q.used, size[q.term], np.iinfo(np.int64).max)
    live = np.flatnonzero(lists.min(axis=1) > 0)
    order = np.argsort(lists[live], axis=1, kind="stable")
    rarest = lists[live, order[:, 0]]
    found = []
    step = np.cumsum(rarest) // CANDIDATES
    for block in np.split(np.arange(len(live)), np.flatnonzero(np.diff(step)) + 1) if len(live) else []:
        window, ranked = live[block], order[block]
        anchor = q.term[window, ranked[:, 0]]
        place = places[ranges(begin[anchor], size[anchor])].astype(np.int64)
        which = np.repeat(np.arange(len(block)), size[anchor])
        start = place - ranked[which, 0]
        row = np.searchsorted(first, place, side="right") - 1
        low, high = first[row], first[row + 1]
        exact = np.ones(len(start), bool)
        if not slop:
            keep = (start >= low) & (start + q.length[window[which]] <= high)
            which, start, low, high, exact = (x[keep] for x in (which, start, low, high, exact))
        for rank in range(1, q.term.shape[1]):
            if not len(which):
                break
            need = rank < q.length[window[which]]
            offset = ranked[which, rank]
            term = at[q.term[window[which], offset]].astype(np.int64)
            want = start + offset
            key = (term << 32) | np.maximum(want, 0)
            i = np.searchsorted(keys, key)
            right = keys[np.minimum(i, len(keys) - 1)]
            near = np.where((i < len(keys)) & (right >> 32 == term), (right & 0xFFFFFFFF) - want, 1 << 40)
            hit = near == 0
            if slop:
                ok_right = (near <= slop) & (want + near < high)
                left = keys[np.maximum(i - 1, 0)]
                back = np.where((i > 0) & (left >> 32 == term), want - (left & 0xFFFFFFFF), 1 << 40)
                keep = ok_right | ((back <= slop) & (want - back >= low))
            else:
                keep = hit
            keep |= ~need
            exact &= hit | ~need
            which, start, low, high, exact = (x[keep] for x in (which, start, low, high, exact))
        exact &= (start >= low) & (start + q.length[window[which]] <= high)
        found.append((window[which], np.maximum(start, low), exact))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def search(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, id: str = "item_id", text: str = "text") -> DataFrame:
    """(shard, row, kind, item_ids, starts, lengths): the matches of each document that has any.

    kind is `phrase` or `proximity`; the three arrays are parallel, starts count words.
    A proximity match has every word of the window within `slop` words of its place.
    """
    spark = index.sparkSession
    windows = stage(item_windows(items, width, id, text))
    blocks = -(-windows.count() // BLOCK_WINDOWS)
    windows = windows.withColumn("block", F.pmod(F.xxhash64("item_id", "window"), F.lit(max(blocks, 1))))
    schema = "shard string, row int, kind string, item_ids array<string>, starts array<int>, lengths array<int>"
    out = None
    for block in range(blocks):
        # Bounded: about BLOCK_WINDOWS rows.
        queries = spark.sparkContext.broadcast(tuple(as_queries(windows.where(F.col("block") == block).collect(), width)))
        matches = stage(index.select("shard", "n_words", "terms", "counts", "places").mapInArrow(_searcher(queries, slop), schema))
        queries.destroy()
        out = matches if out is None else out.union(matches)
    return out if out is not None else spark.createDataFrame([], schema)


def _searcher(queries, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Queries(*queries.value)
        for batch in batches:
            for r in range(len(batch)):
                shard, n_words = batch.column(0)[r].as_py(), batch.column(1)[r].values.to_numpy()
                terms, counts, places = (
                    np.frombuffer(batch.column(k)[r].as_buffer(), kind) for k, kind in ((2, np.uint64), (3, np.uint32), (4, np.uint32))
                )
                if not len(terms):
                    continue
                first = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
                window, start, exact = intersect(q, terms, counts, places, first, slop)
                row = np.searchsorted(first, start, side="right") - 1
                groups: dict[tuple[int, bool], list[int]] = {}
                for k, key in enumerate(zip(row.tolist(), exact.tolist())):
                    groups.setdefault(key, []).append(k)
                picks = [np.array(k) for k in groups.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(groups), pa.string()),
                        pa.array([key[0] for key in groups], pa.int32()),
                        pa.array(["phrase" if key[1] else "proximity" for key in groups], pa.string()),
                        pa.array([[q.items[w] for w in window[k]] for k in picks], pa.list_(pa.string())),
                        pa.array([(start[k] - first[key[0]]).astype(np.int32) for key, k in zip(groups, picks)], pa.list_(pa.int32())),
                        pa.array([q.length[window[k]].astype(np.int32) for k in picks], pa.list_(pa.int32())),
                    ],
                    ["shard", "row", "kind", "item_ids", "starts", "lengths"],
                )

    return run


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, item_ids (sorted), near_ids (proximity only)."""
    index = build_index(docs, id, text)
    matches = search(index, items, width, slop)
    covered = F.expr("flatten(zip_with(starts, lengths, (s, n) -> sequence(s, s + n - 1)))")
    of = lambda kind, value: F.flatten(F.collect_list(F.when(F.col("kind") == kind, value)))
    per_row = matches.groupBy("shard", "row").agg(
        F.array_distinct(of("phrase", F.array_distinct(covered))).alias("hit"),
        F.array_sort(F.array_distinct(of("phrase", F.col("item_ids")))).alias("item_ids"),
        F.array_sort(F.array_distinct(of("proximity", F.col("item_ids")))).alias("near_ids"),
    )
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("row", "doc"))
    none = F.array().cast("array<string>")
    return rows.join(per_row, ["shard", "row"], "left").select(
        F.col("doc.ids").alias(id),
        F.col("doc.n_words").cast("long").alias("n_words"),
        F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.array_except(F.coalesce("near_ids", none), F.coalesce("item_ids", none)).alias("near_ids"),
    )
