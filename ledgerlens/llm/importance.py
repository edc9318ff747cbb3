"""Importance resampling towards a target distribution, over hashed runs of words.

Words come from the untrained regex pre-tokeniser of the tokenizers library, which returns them with their byte
offsets in the ASCII-lowered text. A feature is a window of consecutive offset pairs, its words joined by one
space; its bucket is the CRC-32 of its bytes modulo the number of buckets. Every text is tokenised once: what is
kept of it are its buckets and how often each occurs. Two histograms, of the documents and of the target, give
each bucket a gain; a document's weight is the sum of its features' gains, and its score the weight with Gumbel
noise from a hash of its id, so that the highest scores are a sample without replacement.

Only gains travel to the tasks, as many as there are buckets. Ranks come from a range-partitioned sort.

Defined results: null texts have no words, like empty ones, and weigh 0; a null id is hashed as an empty one and
ranks before other ids of its score; rows that repeat an id and a score are ranked one after the other; texts of
any length are tokenised in stretches that end between words; empty tables give no rows, and an empty target
makes all gains follow the documents alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.ordered import add_rank
from ledgerlens.llm.bytes_and_words import pieces
from ledgerlens.session import stage

BUCKETS = 10_000
SEED = "2024"
PERCENT = 10
LEAST_WORDS = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
STRETCH = 1 << 18
KNOWN = 1 << 20  # features whose bucket a task remembers


def stretches(data: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """Parts of at least `size` bytes (but for the last) that end where no word does go on."""
    first = 0
    while len(data) - first > size:
        cut = BETWEEN.search(data, first + size)
        if cut is None:
            break
        yield data[first : cut.end()]
        first = cut.end()
    yield data[first:]


class Windows:
    """Buckets of the runs of `shortest` to `longest` words of a text."""

    def __init__(self, shortest: int, longest: int, buckets: int):
        from tokenizers import PreTokenizedString, Regex, pre_tokenizers

        self.text, self.split = PreTokenizedString, pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
        self.shortest, self.longest, self.buckets = shortest, longest, buckets
        self.known: dict[bytes, int] = {}

    def bucket(self, feature: bytes) -> int:
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            found = self.known[feature] = crc32(feature) % self.buckets
        return found

    def words(self, part: bytes) -> list[bytes]:
        whole = self.text(part.decode())
        self.split.pre_tokenize(whole)
        return [part[a:b] for _, (a, b), _ in whole.get_splits(offset_referential="original", offset_type="byte")]

    def of(self, data: bytes) -> tuple[int, Counter]:
        """Number of words, and how often each bucket occurs."""
        n, counts, held = 0, Counter(), []
        for part in stretches(data.translate(LOWER)):
            words = self.words(part)
            n += len(words)
            # Windows that end in this stretch may begin in the words held from the one before.
            words, old = held + words, len(held)
            for run in range(self.shortest, self.longest + 1):
                if run == 1:
                    counts.update(map(self.bucket, words[old:]))
                else:
                    ends = range(max(old + 1, run), len(words) + 1)
                    counts.update(self.bucket(b" ".join(words[k - run : k])) for k in ends)
            held = words[len(words) - self.longest + 1 :] if len(words) >= self.longest else words
            held = held if self.longest > 1 else []
        return n, counts


def bags(rows: DataFrame, shortest: int, longest: int, buckets: int) -> DataFrame:
    """(id, place, n_words, bucket array, times array) of the rows (id, place, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shortest, longest, buckets)
        for piece in pieces(batches, "text"):
            n, bucket, times = [], [], []
            for text in piece.column(2).cast(pa.large_binary()):
                count, found = windows.of(text.as_py() or b"")
                n.append(count)
                bucket.append(list(found))
                times.append(list(found.values()))
            arrays = [pa.array(n, pa.int64()), pa.array(bucket, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*piece.columns[:2], *arrays], ["id", "place", "n_words", "bucket", "times"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, place long, n_words long, bucket array<int>, times array<long>")


def histogram(found: DataFrame, name: str) -> DataFrame:
    """(bucket, name): features of all rows by bucket."""
    each = found.select(F.explode(F.arrays_zip("bucket", "times")).alias("e"))
    return each.groupBy(F.col("e.bucket").alias("bucket")).agg(F.sum("e.times").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both histograms smoothed by one."""
    both = histogram(source, "s").join(histogram(target, "t"), "bucket", "full")
    s, t = [0] * buckets, [0] * buckets
    for row in both.collect():  # one row per bucket
        s[row.bucket], t[row.bucket] = row.s or 0, row.t or 0
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log(((b + 1) * all_s) / ((a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, place, n_words, n_features, weight) of bags."""
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, times = batch.column(3), batch.column(4)
            of = pc.list_parent_indices(bucket).to_numpy()
            times = times.flatten().to_numpy()
            features, weight = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(features, of, times)
            np.add.at(weight, of, times * shared.value[bucket.flatten().to_numpy()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(features), pa.array(weight)], ["id", "place", "n_words", "n_features", "weight"]
            )

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(work, f"id {kind}, place long, n_words long, n_features long, weight long")


def noise(id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    runs: tuple[int, int] = (1, 1),
    buckets: int = BUCKETS,
    seed: str = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (null if it is not drawn).

    `target` needs the text column only. Of the documents with `least_words` words or more, `percent` in a
    hundred are drawn, those with the highest scores.
    """
    body = F.col(text).cast("string").alias("text")
    found = stage(bags(docs.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("place"), body), *runs, buckets))
    wanted = bags(target.select(F.lit(0).alias("id"), F.lit(0).cast("long").alias("place"), body), *runs, buckets)
    rows = weights(found, gains(found, wanted, buckets))
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("low", F.col("n_words") < least_words)
    drawn = found.where(F.col("n_words") >= least_words).count() * percent // 100
    ranked = add_rank(rows, [F.col("low"), F.col("score").desc(), F.col("id"), F.col("place")], name="rank")
    chosen = F.when(~F.col("low") & (F.col("rank") <= drawn), F.col("rank")).cast("long")
    return ranked.select(F.col("id").alias(id), "n_words", "n_features", "weight", "score", chosen.alias("rank"))
