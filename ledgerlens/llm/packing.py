"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt by a hash of id and length to blocks of about `BLOCK`, as many as their count asks for, so
the bins are the same however the files are laid out. A block is packed longest first. A piece goes to the open
bin that it leaves fullest. If none has room, a bin is opened in the permitted length that costs least per
token it can still be filled with, given what is left to pack. When a block is packed each bin shrinks to
the cheapest permitted length that holds its contents. Only ids and lengths travel; rows that repeat both are
counted first and dealt to one block after the other, so no block gets more than its share of them.

A document longer than the longest permitted length is split into pieces of that length and a rest.

Defined results: a document without tokens (or of null length) is returned with null bin and piece 0; rows
with the same id are packed separately; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.session import stage

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32  # cost of a sequence besides its length, in tokens
BLOCK = 8_000  # documents packed together, about

SCHEMA = "id {id}, piece int, start long, n_tokens long, bin string, capacity int, place int, bin_tokens int"


def linear_cost(length: int) -> float:
    return length + OVERHEAD


def pack(sizes: np.ndarray, lengths: tuple[int, ...], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Bin and place in it of each size, then content and capacity of each bin. Sizes are 1 to max(lengths)."""
    lengths = sorted(lengths)
    bins = np.zeros(len(sizes), np.int64)
    places = np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    capacity: list[int] = []
    roomy: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by free room
    rooms = 0  # bit r is set while roomy[r] has a bin
    left = int(sizes.sum())
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = roomy[room].pop()
            if not roomy[room]:
                rooms ^= 1 << room
        else:
            room = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / min(c, left), c))
            b = len(filled)
            filled.append(0)
            capacity.append(room)
        bins[k], places[k] = b, filled[b]
        filled[b] += size
        left -= size
        if room > size:
            roomy[room - size].append(b)
            rooms |= 1 << (room - size)
    final = [min((c for c in lengths if c >= f), key=lambda c: (cost(c), c)) for f in filled]
    return bins, places, filled, final


def best_fit(
    docs: DataFrame,
    length: Column,
    lengths: tuple[int, ...] = LENGTHS,
    cost: Callable[[int], float] = linear_cost,
    id: str = "doc_id",
) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bin, capacity, place, bin_tokens.

    `length` gives each document's tokens; `start` counts from the document's first token, `place` from the
    sequence's. Permitted lengths and cost are joint: the cost decides which length a bin is opened in.
    """
    kind = docs.schema[id].dataType.simpleString()
    longest = max(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, block in _blocks(batches):
            count = np.maximum(-(-sizes // longest), 1)
            owner = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            part = np.minimum(sizes[owner] - piece * longest, longest)
            full = np.flatnonzero(part > 0)
            bins, places, filled, final = pack(part[full], lengths, cost)
            none = pa.array(part <= 0)
            spread = np.zeros((4, len(owner)), np.int64)
            spread[:, full] = bins, np.array(final, np.int64)[bins], places, np.array(filled, np.int64)[bins]
            where = pa.array([f"{block}-{b}" for b in spread[0].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(owner)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(piece * longest),
                    pa.array(np.maximum(part, 0)),
                    pa.compute.if_else(none, None, where),
                    *(pa.compute.if_else(none, None, pa.array(x.astype(np.int32))) for x in spread[1:]),
                ],
                ["id", "piece", "start", "n_tokens", "bin", "capacity", "place", "bin_tokens"],
            )

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(length.cast("long"), F.lit(0)).alias("size"))
    kinds = stage(rows.groupBy("id", "size").agg(F.count("*").alias("times")))
    blocks = max(1, -(-(kinds.agg(F.sum("times")).first()[0] or 0) // BLOCK))
    each = kinds.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    block = F.pmod(F.pmod(F.xxhash64("id", "size"), F.lit(blocks)) + F.col("copy"), F.lit(blocks))
    dealt = each.select("id", "size", block.alias("block")).repartition(partitions, "block")
    packed = dealt.sortWithinPartitions("block", F.desc("size"), "id").mapInArrow(run, SCHEMA.format(id=kind))
    return packed.withColumnRenamed("id", id)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """Ids, lengths and number of each block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column(2).to_numpy()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and held[0].column(2)[0].as_py() != int(block[a]):
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, int]:
    table = pa.Table.from_batches(held).combine_chunks()
    ids, sizes, block = (c.chunk(0) for c in table.columns)
    return ids, sizes.to_numpy().astype(np.int64), block[0].as_py()
