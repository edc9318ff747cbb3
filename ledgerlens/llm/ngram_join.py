"""Exact Jaccard join of texts as sets of n-grams, by prefix trees.

A text's set holds its distinct runs of words. All sets are ordered alike: n-grams that the corpus holds often
come first, by counts in a fixed number of hash slots, then by hash. Two similar sets share one of their last
n-grams, the rare ones: the last n - ceil(0.8 n) + 1 of the larger and, as the overlap must be larger between
sets of about one size, the last n - ceil(8/9 n) + 1 of the smaller. So each text sends these with their places
to the shard of the n-gram, packed in arrays. The shard drops n-grams without a pair that sizes and places allow,
names one text of each remaining n-gram its leader, and seats the others with it: all candidates share a leader.
Texts then compare bitmaps in which every n-gram flips one bit: sets differ at least where their bitmaps do, so a
text whose bitmap is too far from all others at its tables is none's partner, and its words stay at home.

A leader's sets meet in one task as a prefix tree (trie). Sets with the same first n-grams share a path, whose
overlap with a query is counted once; a subtree is left when the n-grams that remain on either side can't make up
for those that are missing, or when its sets are connected with the query already. So a group of near copies
costs one walk and gives one link per text, not all pairs. Large groups are split over tasks. Each part has the
leader's set too; afterwards sets that are not connected to the most of their group visit all its parts.

n-grams are 56-bit hashes below one byte for the count, so an overlap is wrong by chance about once in 10^11 pairs.

Defined results: words are runs of anything but white space, A-Z lower-cased; texts of one to four words are one
n-gram; null texts and those without words have an empty set, which is linked with nothing, copies included; the
component of texts whose ids are all null is null; rows that share an id stay separate; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.bytes_and_words import pieces, ranges, utf8, words
from ledgerlens.llm.components import components
from ledgerlens.llm.copies import first_copies, join_by_text
from ledgerlens.llm.near_dups import elements
from ledgerlens.session import stage

RUN = 5
PERCENT = 80
SLOTS = 1 << 18
SLOT_ROWS = 16  # rows in which a task gives its counts
FLUSH = 1 << 21  # n-grams that a task holds before it sends them
NEIGHBOURS = 8  # places beyond which an n-gram's texts are not compared by size and place
PART = 1 << 20  # n-grams of the sets in one tree
EDGE = 32  # n-grams on an edge of a tree
MOST_BITS = 1 << 16  # of a bitmap


def not_white() -> np.ndarray:
    table = np.ones(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return table


def overlap_needed(n, m, percent: int):
    """Common elements from which sets of n and m are similar."""
    return -(-percent * (n + m) // (100 + percent))


def sets(data: np.ndarray, rows: np.ndarray, run: int, classes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text in the common order, and where each text's begin."""
    found = words(data, rows, not_white())
    text, element = elements(found.hash, found.first, run)
    if classes is not None:
        element = classes[element & np.uint64(SLOTS - 1)] | element >> np.uint64(8)
    order = np.lexsort((element, text))
    text, element = text[order], element[order]
    if len(text):
        keep = np.concatenate([[True], (text[1:] != text[:-1]) | (element[1:] != element[:-1])])
        text, element = text[keep], element[keep]
    return element, np.searchsorted(text, np.arange(len(rows)))


def parities(element: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set a bitmap of two bits or more per element (of 64 to MOST_BITS), a power of two, in which each
    element flips one bit."""
    n = np.diff(first)
    size = np.minimum(64 << np.ceil(np.log2(np.maximum(2 * n, 64) / 64)).astype(np.int64), MOST_BITS)
    start = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(n)), n)
    at = start[of] + ((element >> np.uint64(32)) % size[of].astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start, start[1:])]


def possible(n: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which sets can be similar to another one, by sizes and bitmaps."""
    order = np.argsort(n, kind="stable")
    n, size = n[order].astype(np.int64), np.array([len(bits[k]) for k in order])
    rows = {}
    for b in np.unique(size).tolist():
        rows[b] = np.frombuffer(b"".join(bits[k] for k in order[size == b].tolist()), np.uint64).reshape(-1, b // 8)
    begin = {b: int(np.searchsorted(size, b)) for b in rows}
    keep = np.zeros(len(n), bool)
    last = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(n)):
        for b, others in rows.items():
            if b < size[i]:
                continue
            low, high = max(i + 1, begin[b]), min(int(last[i]), begin[b] + len(others))
            if low >= high:
                continue
            theirs = others[low - begin[b] : high - begin[b]]
            while theirs.shape[1] > size[i] // 8:
                half = theirs.shape[1] // 2
                theirs = theirs[:, :half] ^ theirs[:, half:]
            own = rows[int(size[i])][i - begin[int(size[i])]]
            apart = np.bitwise_count(theirs ^ own).sum(axis=1, dtype=np.int64)
            near = apart <= n[i] + n[low:high] - 2 * overlap_needed(n[i], n[low:high], percent)
            keep[low:high] |= near
            keep[i] |= near.any()
    out = np.zeros(len(n), bool)
    out[order] = keep
    return out


def _possible(percent: int):
    """The rows of each leader's group that may have a partner in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def kept() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            mask = possible(rows.column("n").to_numpy(), rows.column("bits").to_pylist(), percent)
            return rows.filter(pa.array(mask)).select(["leader", "key"])

        for batch in batches:
            leader = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(leader)), np.flatnonzero(leader[1:] != leader[:-1]) + 1):
                if not len(part):
                    continue
                if held and held[0].column(0)[0].as_py() != leader[part[0]]:
                    yield from kept().to_batches()
                    held = []
                held.append(batch.slice(part[0], len(part)))
        if held:
            yield from kept().to_batches()

    return work


def _sized(run: int):
    """(id, key, n, bits) of every text, and at the end the counts of n-grams by slot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(SLOTS, np.int64), ["id", "key", "n", "bits", "slots", "counts"]
        kind = None
        for piece in pieces(batches, "text"):
            element, first = sets(*utf8(piece.column(2)), run, None)
            counts += np.bincount((element & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            none, kind, size = pa.nulls(len(piece), pa.int32()), piece.column(0).type, np.diff(first)
            bits = pa.array(parities(element, first), pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(size), bits, none, pa.nulls(len(piece), pa.binary())], names)
        if kind is not None:
            press = zstandard.ZstdCompressor()
            packed = [press.compress(part.astype(np.int64).tobytes()) for part in np.split(counts, SLOT_ROWS)]
            nothing = [pa.nulls(SLOT_ROWS, k) for k in (kind, pa.binary(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(range(SLOT_ROWS), pa.int32()), pa.array(packed, pa.binary())], names)

    return work


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for slots, counts in zip(*(c.to_pylist() for c in batch.columns)):
            total[slots] = total.get(slots, 0) + np.frombuffer(press.decompress(counts), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["slots", "counts"])


def order_classes(sized: DataFrame) -> np.ndarray:
    """For each slot the first byte of its n-grams, lower for those that occur more often."""
    partial = sized.where("slots is not null").select("slots", "counts")
    summed = partial.repartition(SLOT_ROWS, "slots").mapInArrow(_summed, "slots int, counts binary")
    counts = np.zeros(SLOTS, np.int64)
    for row in summed.collect():  # SLOTS numbers
        counts.reshape(SLOT_ROWS, -1)[row.slots] = np.frombuffer(row.counts, np.int64)
    return (255 - np.floor(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint64) << np.uint64(56)


_PACKED = "shard int, element binary, node binary, n binary, place binary"
_WIDTHS = (np.uint64, np.int64, np.uint32, np.uint32)


def _rare(run: int, percent: int, shards: int, classes) -> object:
    """The rare ends of all sets by shard: n-gram, text, size of the set and place from its end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[bytes] = set()

        def sent() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            shard = (columns[0] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            which, first = np.unique(shard[order], return_index=True)
            cuts = np.append(first, len(order))
            press = zstandard.ZstdCompressor()
            packed = [[press.compress(c[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])] for c in (x[order] for x in columns)]
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], ["shard", "element", "node", "n", "place"])

        size = 0
        for piece in pieces(batches, "text"):
            element, first = sets(*utf8(piece.column(1)), run, classes.value)
            keys = piece.column(0).to_pylist()
            n = np.diff(first)
            new = np.array([k not in seen and not seen.add(k) for k in keys], bool)
            count = np.where(new & (n > 0), n - -(-percent * n // 100) + 1, 0)
            at = ranges(first[1:] - count, count)
            node = np.frombuffer(b"".join(k[:8] for k in keys), ">i8").astype(np.int64)
            of = np.repeat(np.arange(len(n)), count)
            held.append((element[at], node[of], n[of].astype(np.uint32), (first[1:][of] - 1 - at).astype(np.uint32)))
            size += len(at)
            if size >= FLUSH:
                yield sent()
                size = 0
        if size:
            yield sent()

    return work


def seats_of(element: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (leader, text) of the n-grams of a shard."""
    order = np.lexsort((node, element))
    element, node, n, place = element[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64)
    head = np.ones(len(element), bool)
    head[1:] = (element[1:] != element[:-1]) | (node[1:] != node[:-1])
    element, node, n, place = element[head], node[head], n[head], place[head]
    group = np.cumsum(np.concatenate([[0], element[1:] != element[:-1]])) if len(element) else np.zeros(0, np.int64)
    size = np.bincount(group)
    keep = (size > NEIGHBOURS + 1)[group]
    left = n - place  # elements up to this one, in the order from the rare end: those that may be shared
    for d in range(1, NEIGHBOURS + 1):
        if len(element) <= d:
            break
        a, b = slice(None, -d), slice(d, None)
        fits = (group[a] == group[b]) & (np.minimum(left[a], left[b]) >= overlap_needed(n[a], n[b], percent))
        keep[a] |= fits
        keep[b] |= fits
    # In a larger group a text must be able to hold the n-gram as the smaller one of a pair, or meet one that can.
    small = place <= n - overlap_needed(n, n, percent)
    keep &= np.bincount(group, weights=small & keep, minlength=len(size))[group] > 0
    group, node = group[keep], node[keep]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
    leader = np.repeat(node[start], np.diff(np.append(start, len(group))))
    pairs = np.unique(np.stack([leader, node], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _seated(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()

        def seats() -> pa.RecordBatch:
            columns = [np.frombuffer(b"".join(c), t) for c, t in zip(zip(*held), _WIDTHS)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in seats_of(*columns, percent)], ["leader", "node"])

        now, held = None, []
        for batch in batches:
            for shard, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now and held:
                    yield seats()
                    held = []
                now = shard
                held.append([press.decompress(p) for p in packed])
        if held:
            yield seats()

    return work


class Tree(NamedTuple):
    """A prefix tree; its nodes are parts of paths of at most EDGE elements."""

    elements: np.ndarray  # of all sets, as numbers in their order
    start: np.ndarray  # where a node's elements are
    length: np.ndarray
    depth: np.ndarray  # at the node's end
    low: np.ndarray  # sets below a node: from low up to high
    high: np.ndarray
    smallest: np.ndarray
    largest: np.ndarray
    child: np.ndarray  # children of node k: child[child_at[k] : child_at[k + 1]]
    child_at: np.ndarray
    leaf: np.ndarray  # the set that ends at a node, or -1


def tree_of(members: list[np.ndarray]) -> Tree:
    """The tree of sets in lexicographic order."""
    size = np.array([len(m) for m in members])
    base = np.concatenate([[0], np.cumsum(size)])
    whole = np.concatenate(members)
    start, depth, length, low, high, leaf, children = [], [], [], [], [], [], []

    def node(parent: int, first: int, a: int, b: int, set_: int) -> int:
        """Nodes for elements a..b of set `first`; the last one's number."""
        while True:
            end = min(b, a + EDGE)
            start.append(base[first] + a), length.append(end - a), depth.append(end)
            low.append(first), high.append(first), leaf.append(set_ if end == b else -1), children.append([])
            me = len(start) - 1
            if parent >= 0:
                children[parent].append(me)
            parent, a = me, end
            if a == b:
                return me

    def grow(parent: int, first: int, last: int, at: int) -> None:
        stack = [(parent, first, last, at)]
        while stack:
            parent, first, last, at = stack.pop()
            # Sets first..last agree in `at` elements; those that go on alike share a path.
            k = first
            while k < last:
                if size[k] == at:
                    high[node(parent, k, at, at, k)] = k + 1
                    k += 1
                    continue
                end = k + 1
                while end < last and common[end - 1] > at:
                    end += 1
                if end == k + 1:
                    before = len(start)
                    node(parent, k, at, size[k], k)
                    high[before:] = [k + 1] * (len(start) - before)
                else:
                    to = int(common[k : end - 1].min())
                    before = len(start)
                    me = node(parent, k, at, to, -1)
                    high[before:] = [end] * (len(start) - before)
                    stack.append((me, k, end, to))
                k = end

    common = np.zeros(max(len(members) - 1, 0), np.int64)
    for k in range(len(members) - 1):
        a, b = members[k], members[k + 1]
        m = min(len(a), len(b))
        differ = a[:m] != b[:m]
        common[k] = differ.argmax() if differ.any() else m
    root = node(-1, 0, 0, 0, -1)
    high[root] = len(members)
    grow(root, 0, len(members), 0)
    low_, high_ = np.array(low), np.array(high)
    # Sizes below a node, from the leaves up: a node's number is higher than its parent's.
    smallest, largest = np.full(len(start), 1 << 60), np.zeros(len(start), np.int64)
    parent = np.full(len(start), -1)
    for k, c in enumerate(children):
        parent[c] = k
    for k in range(len(start) - 1, -1, -1):
        if leaf[k] >= 0:
            smallest[k] = min(smallest[k], size[leaf[k]])
            largest[k] = max(largest[k], size[leaf[k]])
        if parent[k] >= 0:
            smallest[parent[k]] = min(smallest[parent[k]], smallest[k])
            largest[parent[k]] = max(largest[parent[k]], largest[k])
    at = np.concatenate([[0], np.cumsum([len(c) for c in children])])
    child = np.array([x for c in children for x in c], np.int64)
    as_arrays = (np.array(x, np.int64) for x in (start, length, depth))
    return Tree(whole, *as_arrays, low_, high_, smallest, largest, child, at, np.array(leaf))


def walk(tree: Tree, query: np.ndarray, mark: np.ndarray, skip: np.ndarray, percent: int) -> np.ndarray:
    """Sets of the tree that are similar to the query, without those of `skip` (one flag per set)."""
    mark[query] = True
    n, found = len(query), []
    skipped = np.concatenate([[0], np.cumsum(skip)])
    front, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(front):
        length = tree.length[front]
        seen = np.concatenate([[0], np.cumsum(mark[tree.elements[ranges(tree.start[front], length)]])])
        ends = np.cumsum(length)
        overlap = overlap + seen[ends] - seen[ends - length]
        depth = tree.depth[front]
        last = tree.elements[np.maximum(tree.start[front] + length - 1, 0)]
        after = np.where(depth > 0, n - np.searchsorted(query, last, side="right"), n)
        after = np.where(length > 0, after, n - overlap)
        # The size of a set below that is best for it: no more elements than can be shared.
        m = np.clip(depth + after, tree.smallest[front], tree.largest[front])
        alive = overlap + np.minimum(m - depth, after) >= overlap_needed(n, m, percent)
        front, overlap = front[alive], overlap[alive]
        leaf = tree.leaf[front]
        hits = leaf[leaf >= 0]
        found.append(hits[~skip[hits]])
        many = tree.child_at[front + 1] - tree.child_at[front]
        overlap = np.repeat(overlap, many)
        front = tree.child[ranges(tree.child_at[front], many)]
        open_ = skipped[tree.high[front]] - skipped[tree.low[front]] < tree.high[front] - tree.low[front]
        front, overlap = front[open_], overlap[open_]
    mark[query] = False
    return np.concatenate(found)


def connecting_links(members: list[np.ndarray], label: np.ndarray, visits: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Similar pairs that connect labels, enough of them to connect all that are similar.

    Sets with `visits` are queries only, and are compared with those without; if there is none, all are both.
    """
    number = np.unique(np.concatenate(members), return_inverse=True)[1]
    cuts = np.cumsum([len(m) for m in members])
    members = np.split(number, cuts[:-1])
    mark = np.zeros(int(number.max()) + 1, bool)
    label = label.copy()
    order = sorted((k for k in range(len(members)) if not visits[k]), key=lambda k: members[k].astype(">i8").tobytes())
    rank = np.array(order)
    if not len(rank):
        return []
    tree = tree_of([members[k] for k in order])
    queries = np.flatnonzero(visits) if visits.any() else rank
    out = []
    for q in queries.tolist():
        own = label[rank]
        skip = own == label[q]
        if skip.all():
            continue
        hits = rank[walk(tree, members[q], mark, skip, percent)]
        for other in np.unique(label[hits]):
            out.append((q, int(hits[label[hits] == other][0])))
        met = np.isin(label, label[hits])
        label[met] = label[q]
    return out


def _joined(run: int, percent: int, classes):
    """Links among the texts of each (leader, part)."""

    def links(held: list[tuple]) -> pa.RecordBatch:
        _, _, _, keys, labels, visits, texts = zip(*held)
        texts = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        element, first = sets(data, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]), run, classes.value)
        members = [element[a:b] for a, b in zip(first, first[1:])]
        label = np.unique(labels, return_inverse=True)[1]
        pairs = connecting_links(members, label, np.array(visits), percent)
        return pa.RecordBatch.from_arrays([pa.array([keys[p[k]] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:2] != held[0][:2]:
                    if len(held) > 1:
                        yield links(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield links(held)

    return work


def _spread(seats: DataFrame, wanted) -> DataFrame:
    """Rows for all parts of their group where `wanted`, else for their own."""
    parts = F.when(wanted, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    return seats.withColumn("part", F.explode(parts))


def links_of(docs: DataFrame, texts: DataFrame, classes: np.ndarray, run: int, percent: int) -> DataFrame:
    """Links (a, b) of text keys that connect all similar texts: docs (id, key, text), texts (key, one, same, n, bits).

    `one` is the lowest id of the text, `same` the number of rows that have both.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(classes)  # SLOTS numbers
    sent = docs.select("key", "text").mapInArrow(_rare(run, percent, partitions, shared), _PACKED)
    sent = sent.repartition(partitions, "shard").sortWithinPartitions("shard")
    seats = stage(sent.mapInArrow(_seated(percent), "leader long, node long").distinct())
    known = texts.where("n > 0").withColumn("node", F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long"))
    seats = seats.join(known, "node").select("leader", "node", "key", "one", "same", "n", "bits")
    size = seats.groupBy("leader").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    # Few groups are that large; staged, so that the join can spread a large group's rows.
    seats = seats.join(stage(size.where("parts > 1")), "leader", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    seats = stage(seats.withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int")))
    small = seats.where("parts = 1").select("leader", "key", "n", "bits").repartition(partitions, "leader").sortWithinPartitions("leader")
    kept = small.mapInArrow(_possible(percent), "leader long, key binary")
    # A group that is split is mostly one of near copies: all of it goes on.
    seats = seats.drop("bits").join(kept.unionByName(seats.where("parts > 1").select("leader", "key")), ["leader", "key"], "left_semi")
    seats = stage(seats)

    def met(rows: DataFrame) -> DataFrame:
        columns = ["leader", "part", "node", "key", "label", "visits", "text"]
        # Texts are dealt by their key at every size, also where few are wanted.
        rows = first_copies(docs.hint("merge"), rows)
        repeated = rows.where("same > 1").select(columns).dropDuplicates(["leader", "part", "key", "visits"])
        placed = rows.where("same = 1").select(columns).unionByName(repeated)
        placed = placed.repartition(partitions, "leader", "part").sortWithinPartitions("leader", "part", "key")
        return placed.mapInArrow(_joined(run, percent, shared), "a binary, b binary").distinct()

    first = _spread(seats, F.col("leader") == F.col("node")).withColumn("label", F.col("key")).withColumn("visits", F.lit(False))
    links = stage(met(first))
    large = seats.where("parts > 1")
    if links.isEmpty() or large.isEmpty():
        return links
    labels = components(links)
    large = stage(large.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
    counts = large.groupBy("leader", "label").agg(F.count("*").alias("c"))
    most = counts.groupBy("leader").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("labels"))
    parted = large.join(most.where("labels > 1").drop("labels"), "leader")
    visitors = _spread(parted.where("label != most"), F.lit(True)).withColumn("visits", F.lit(True))
    at_home = _spread(parted, F.lit(False)).withColumn("visits", F.lit(False))
    more = stage(met(visitors.unionByName(at_home)))
    return links.union(more)


def components_of(docs: DataFrame, run: int = RUN, percent: int = PERCENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the lowest id that links lead to)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), body.alias("text"))
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, key binary, n long, bits binary, slots int, counts binary"
    sized = stage(rows.select("id", "key", "text").mapInArrow(_sized(run), schema))
    classes = order_classes(sized)
    each = sized.where("slots is null").select("id", "key", "n", "bits")
    rows_of = each.groupBy("key", "id").agg(F.count("*").alias("same"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    lowest = F.min_by("same", F.struct(F.col("id").isNull(), "id")).alias("same")
    texts = stage(rows_of.groupBy("key").agg(F.min("id").alias("one"), lowest, F.sum("same").alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    links = links_of(rows, texts, classes, run, percent)
    labelled = texts.drop("bits").where("n > 0").withColumn("label", F.col("key"))
    if not links.isEmpty():
        labelled = labelled.drop("label").join(components(links), "key", "left").withColumn("label", F.coalesce("label", "key"))
    lowest = labelled.groupBy("label").agg(F.min("one").alias("component_id"))
    found = labelled.join(lowest, "label").select("key", "one", "copies", "component_id")
    out = join_by_text(each.drop("bits"), found)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"))
