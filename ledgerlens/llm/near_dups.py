"""Near-duplicate texts by DartMinHash signatures and banding.

Every element (a run of five words) throws an endless row of darts at the region above its weight: darts
arrive by rank as a Poisson process whose gaps, places and coordinates are hashes of the element, so any two
texts see the same darts of an element they share. Of the darts that land below the element's weight each
coordinate of the signature keeps the earliest. Two signatures agree in a coordinate with a probability equal
to the weighted Jaccard similarity of the texts. Ranks beyond what fills all coordinates are never thrown;
where a coordinate stays empty, the text throws on.

Signatures meet in bands. With 26 bands of 5 coordinates a pair of similarity 0.8 is missed once in 30,000
times. Every candidate is checked exactly. A bucket does not emit its pairs: all members are compared to two
leaders (the members that meet the most others over all bands). Where the members of a bucket are not all
connected then, those that are not in its largest part visit all blocks of the bucket and are compared with what
is there, inside tasks and without a row per pair, so no link is lost and the largest part stays where it is.

Weights are 1 (Jaccard similarity of sets of runs) or the number of times a run occurs.

Defined results: copies of a text are one class; texts of one to four words are one run; texts without words
are near their own copies only; a null text is empty; the class id is the lowest id of the class, null if it
has none; rows with the same id stay separate rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.bytes_and_words import hashed_range, mix, pieces, ranges, utf8, words
from ledgerlens.llm.components import components
from ledgerlens.llm.copies import first_copies, join_by_text
from ledgerlens.session import small_batches, stage

RUN = 5
BANDS = 26
ROWS = 5
SIMILARITY = 0.8
MEMBERS = 800  # of a bucket in one block
COLUMNS = 4096
STRIDE = np.uint64(0x9E3779B97F4A7C15)


def elements(hashes: np.ndarray, first: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every run of `run` words, or of all words of a shorter text."""
    factors = hashed_range(run, 23) | np.uint64(1)
    count = np.diff(first)
    whole = np.maximum(count - run + 1, 0)
    at = ranges(first[:-1], whole)
    value = np.zeros(len(at), np.uint64)
    for k in range(run):
        value += hashes[at + k] * factors[k]
    text = np.repeat(np.arange(len(count)), whole)
    short = np.flatnonzero((count > 0) & (count < run))
    extra = np.zeros(len(short), np.uint64)
    for k in range(run - 1):
        has = k < count[short]
        extra[has] += hashes[(first[short] + k)[has]] * factors[k]
    extra += count[short].astype(np.uint64) * STRIDE
    return np.concatenate([text, short]), mix(np.concatenate([value, extra]))


def weighted(text: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text and how often they occur."""
    order = np.lexsort((element, text))
    text, element = text[order], element[order]
    head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (element[1:] != element[:-1])])) if len(text) else text
    return text[head], element[head], np.diff(np.append(head, len(text))).astype(float)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) ranks of the earliest darts; infinite for texts without elements."""
    best = np.full(n * k, np.inf)
    total = np.bincount(text, weights=weight, minlength=n)
    depth = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    while todo.any():
        chosen = np.flatnonzero(todo[text])
        _throw(text[chosen], element[chosen], weight[chosen], depth, best, k)
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        depth *= 2
    return best.reshape(n, k)


def _throw(text, element, weight, depth, best, k) -> None:
    # Regions of an element: weights [0, 1), [1, 2), [2, 4), ... up to its own.
    low, high, region = 0.0, 1.0, 0
    while len(text):
        seed = mix(element + np.uint64(region * 0xA24BAED4963EE407 % 2**64))
        _darts(text, seed, weight, low, high, depth, best, k)
        over = weight > high
        text, element, weight = text[over], element[over], weight[over]
        low, high, region = high, high * 2, region + 1


def _darts(text, seed, weight, low, high, depth, best, k) -> None:
    rank = np.zeros(len(seed))
    thrown, many = 0, 1
    while len(seed):
        # Block by block, so that the many short rows of a few long texts stay small.
        number = np.arange(thrown + 1, thrown + many + 1, dtype=np.uint64) * STRIDE
        h = mix(seed[:, None] + number)
        ranks = rank[:, None] + np.cumsum(-np.log(_uniform(h)) / (high - low), axis=1)
        h = mix(h ^ np.uint64(0xD1B54A32D192ED03))
        hit = ranks <= depth[text][:, None]
        going = hit[:, -1]
        if weight.min() < high:
            hit &= low + _uniform(mix(h)) * (high - low) <= weight[:, None]
        of, which = np.nonzero(hit)
        coordinate = (h[of, which] % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, text[of] * k + coordinate, ranks[of, which])
        text, seed, weight, rank = text[going], seed[going], weight[going], ranks[going, -1]
        thrown, many = thrown + many, min(2 * many, 64)


def bands(signatures: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    """(texts, bands) bucket numbers; the band is part of the number."""
    bits = signatures[:, : n_bands * n_rows].copy().view(np.uint64).reshape(len(signatures), n_bands, n_rows)
    factors = hashed_range(n_rows, 31) | np.uint64(1)
    value = np.zeros(bits.shape[:2], np.uint64)
    for r in range(n_rows):
        value = mix(value + bits[:, :, r] * factors[r])
    return mix(value + np.arange(n_bands, dtype=np.uint64) * STRIDE).view(np.int64)


def _met(run: int, n_bands: int, n_rows: int, counted: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found = words(*utf8(piece.column(1)))
            text, element = elements(found.hash, found.first, run)
            if counted:
                text, element, weight = weighted(text, element)
            else:
                # An element that comes again throws the same darts again.
                weight = np.ones(len(text))
            has = np.flatnonzero(np.bincount(text, minlength=len(piece)))
            signatures = dart_signatures(text, element, weight, len(piece), n_bands * n_rows)
            buckets = bands(signatures[has], n_bands, n_rows)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(np.repeat(has, n_bands))), pa.array(buckets.ravel())], ["key", "bucket"]
            )

    return work


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted elements, weights)."""
    _, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][left], b[1][right]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _similar(run: int, least: float, counted: bool):
    def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(text.encode(), np.uint8)
        found = words(data, np.array([0, len(data)]))
        _, element, weight = weighted(*elements(found.hash, found.first, run))
        return element, weight if counted else np.ones(len(weight))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            keep = []
            for k in range(len(batch)):
                b = batch.column(1)[k].as_py()
                if b != last:
                    last, of_last = b, profile(batch.column(3)[k].as_py())
                keep.append(similarity(profile(batch.column(2)[k].as_py()), of_last) >= least - 1e-12)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return work


def expanded(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Elements of weight n as n elements: then sets give the weighted similarity."""
    times = weight.astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return mix(np.repeat(element, times) + nth.astype(np.uint64) * STRIDE)


def similar_pairs(sets: list[np.ndarray], own: np.ndarray, label: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels that are similar: of all sets if `own` is one value, else those of unlike `own`.

    Common elements are counted by products of incidence matrices, some thousand elements at a time.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(n), size)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    number = np.cumsum(times > 1) - 1
    member, at = member[shared], number[at[shared]]
    order = np.argsort(at, kind="stable")
    member, at = member[order], at[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, (low, low + COLUMNS))
        x = np.zeros((n, COLUMNS), np.float32)
        x[member[a:b], at[a:b] - low] = 1
        both += x @ x.T
    union = size[:, None] + size[None, :] - both
    hit = (both >= (least - 1e-9) * union) & (label[:, None] != label[None, :])
    if own.min() != own.max():
        hit &= own[:, None] != own[None, :]
    a, b = np.nonzero(hit)
    return a[a < b], b[a < b]


def _met_again(run: int, least: float, counted: bool):
    def links(held: list[tuple]) -> pa.RecordBatch:
        texts = [t.encode() for *_, t in held]
        data = np.frombuffer(b"".join(texts), np.uint8)
        found = words(data, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]))
        text, element, weight = weighted(*elements(found.hash, found.first, run))
        weight = weight if counted else np.ones(len(weight))
        cuts = np.searchsorted(text, np.arange(len(held) + 1))
        sets = [expanded(element[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        label = np.unique([h[2] for h in held], return_inverse=True)[1]
        a, b = similar_pairs(sets, np.array([h[0] for h in held]), label, least)
        keys = pa.array([h[1] for h in held], pa.binary())
        return pa.RecordBatch.from_arrays([keys.take(pa.array(a)), keys.take(pa.array(b))], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, block, own, key, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, block) != now:
                    if len(held) > 1:
                        yield links(held)
                    now, held = (bucket, block), []
                held.append((own, key, label, text))
        if len(held) > 1:
            yield links(held)

    return work


def _checked(pairs: DataFrame, chosen: DataFrame, run: int, least: float, counted: bool) -> DataFrame:
    """The pairs (a, b) of texts that are similar."""
    texts = pairs.join(chosen.toDF("a", "text_a"), "a").join(chosen.toDF("b", "text_b"), "b")
    return texts.select("a", "b", "text_a", "text_b").mapInArrow(_similar(run, least, counted), "a binary, b binary")


def _leader(members: DataFrame) -> DataFrame:
    """(bucket, b): the member with the most company, by numbers alone so that a full bucket combines early."""
    most = members.groupBy("bucket").agg(F.max("company").alias("company"))
    one = members.join(most, ["bucket", "company"]).groupBy("bucket").agg(F.min("node").alias("node"))
    return members.join(one, ["bucket", "node"]).select("bucket", F.col("key").alias("b"))


def classes(
    docs: DataFrame,
    run: int = RUN,
    least: float = SIMILARITY,
    n_bands: int = BANDS,
    n_rows: int = ROWS,
    counted: bool = False,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: id, key (of its text), class_id, class_key, n_links.

    `n_links` counts the checked links of the text to other texts that connect its class.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), body.alias("text"))
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    texts = stage(rows.groupBy("key").agg(F.min("id").alias("one"), F.count("*").alias("copies")))
    schema = "key binary, bucket long"
    met = stage(rows.select("key", "text").mapInArrow(_met(run, n_bands, n_rows, counted), schema).withColumn("node", F.xxhash64("key")))
    shared = met.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"))
    shared = shared.where("low != high").select("bucket", "size")
    members = stage(met.join(shared, "bucket").groupBy("bucket", "key", "node").agg(F.max("size").alias("size")))
    company = members.groupBy("key").agg(F.sum("size").alias("company"))
    # Only texts that met another one travel, each once.
    chosen = stage(first_copies(rows, company.join(texts, "key")).select("key", "text").distinct())
    members = stage(members.drop("size").join(company, "key"))
    # First every member meets the two members of its bucket with the most company ...
    first = stage(_leader(members))
    after = members.join(first, "bucket").where("key != b")
    pairs = after.select(F.col("key").alias("a"), "b")
    second = _leader(after.drop("b"))
    pairs = pairs.union(after.drop("b").join(second, "bucket").where("key != b").select(F.col("key").alias("a"), "b"))
    pairs = stage(pairs.distinct())
    links = labels = None
    if not pairs.isEmpty():
        links = stage(_checked(pairs, chosen, run, least, counted))
        labels = components(links)
        # ... then members of one bucket meet that are not connected by now.
        open_ = members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        parted = open_.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("bucket")
        open_ = stage(open_.join(parted, "bucket", "left_semi").select("bucket", "key", "label"))
        sizes = open_.groupBy("bucket").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
        home = F.pmod(F.xxhash64("key", F.lit(5)), "blocks").cast("int")
        parts = open_.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        sizes = sizes.join(parts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("most")), "bucket")
        # Every member is at home in one block; with several blocks, who is not in the largest part visits all.
        at_home = F.array(F.struct(home.alias("block"), F.lit(0).alias("own")))
        visits = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), F.lit(1).alias("own")))
        where = F.when((F.col("blocks") > 1) & (F.col("label") != F.col("most")), F.concat(at_home, visits)).otherwise(at_home)
        placed = open_.join(sizes, "bucket").select("bucket", "key", "label", F.explode(where).alias("m"))
        placed = placed.join(chosen, "key").select("bucket", "m.block", "m.own", "key", "label", "text")
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met_again = placed.repartition(partitions, "bucket", "block").sortWithinPartitions("bucket", "block", "own")
        more = stage(met_again.mapInArrow(_met_again(run, least, counted), "a binary, b binary").distinct())
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
    classed = texts if links is None else texts.join(labels, "key", "left")
    classed = classed.withColumn("class_key", F.coalesce("label", "key") if links is not None else F.col("key"))
    lowest = classed.groupBy("class_key").agg(F.min("one").alias("class_id"))
    if links is None:
        degrees = texts.select("key", F.lit(0).cast("long").alias("n_links"))
    else:
        pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
        degrees = ends.groupBy("key").agg(F.count("*").alias("n_links"))
    classed = classed.join(lowest, "class_key").join(degrees, "key", "left")
    classed = classed.select("key", "one", "copies", "class_key", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = join_by_text(rows.select("id", "key"), classed)
    return out.select(F.col("id").alias(id), "key", "class_id", "class_key", "n_links")
