"""Removal of long byte strings that occur more than once in the corpus, by suffix arrays.

A window is `length` bytes of one document. A window that starts anywhere else too is repeated, and every
byte under a repeated window goes. Windows meet as follows:

1. Each window chooses the `GRAM`-byte string in it with the lowest hash. Equal windows choose alike, and
   neighbouring windows mostly choose the same place, so a document falls into segments of windows. Only
   segments whose chosen string occurs twice can hold repeated windows.
2. Segments meet in buckets by chosen string. Equal segments collapse; the rest of a bucket becomes one
   string whose suffix array puts equal windows side by side, where they are compared byte by byte.
3. A bucket with many segments is dealt to several arrays. Each gives the digests of its distinct windows
   (128 bits of SHA-256), which are counted across arrays.

Copies of a whole document are counted by digest (SHA-256) first and only one of them is cut into segments.

Defined results: a null text is empty; documents shorter than a window keep all; rows with the same id and
text are copies of each other; where a cut falls inside a character, the text form drops its rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.bytes_and_words import hashed_range, mix, pieces, ranges, utf8
from ledgerlens.llm.copies import first_copies, join_by_text
from ledgerlens.llm.suffix_array import equal_neighbours, suffix_arrays
from ledgerlens.session import small_batches, stage

LENGTH = 400
GRAM = 192
PASSAGE = 250  # a passage of 50 words has some 300 bytes, and 250 at least
PASSAGE_GRAM = 112
PER_ARRAY = 24  # segments of a bucket that share one suffix array
BATCH_BYTES = 1_500_000  # of strings whose arrays are built in step
PIECE = 100_000  # bytes of text whose hashes are made at a time: they fit a core's cache
STRETCH = 1_000_000  # windows of a long text that are hashed at a time
CUT_BYTES = 16_000_000  # of segments that leave a task as one batch


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes at each place: strings of doubled size from two halves."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a, b, c = hashed_range(3, 11) | np.uint64(1)
    size = 1
    level = (data.astype(np.uint64) + np.uint64(1)) * a
    total, covered = None, 0
    while True:
        if gram & size:
            part = level[covered : covered + n]
            total = part if total is None else mix(total * b + part)
            covered += size
        size *= 2
        if size > gram:
            return mix(total)
        level = level[: -(size // 2)] * b + level[size // 2 :] * c
        level ^= level >> np.uint64(29)


def lowest_place(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes the place of its lowest, the first of them where several are equal."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    padded = np.full(-(-len(hashes) // width) * width, np.uint64(2**64 - 1))
    padded[: len(hashes)] = hashes
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
    # Ahead, the lowest so far has the place where it first came; behind, the next place that is itself the lowest.
    place = np.arange(len(padded)).reshape(blocks.shape)
    new = np.ones(blocks.shape, bool)
    new[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, place, 0).ravel())
    behind_at = np.minimum.accumulate(np.where(blocks == behind, place, len(padded)).ravel()[::-1])[::-1]
    last = slice(width - 1, width - 1 + n)
    return np.where(behind.ravel()[:n] <= ahead.ravel()[last], behind_at[:n], ahead_at[last])


def segments(data: np.ndarray, rows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and chosen hash of each segment."""
    found = [_stretch(data, rows, first, length, gram) for first in range(0, max(len(data) - length + 1, 1), STRETCH)]
    row, start, count, mh, place = (np.concatenate(x) for x in zip(*found))
    # A segment that goes on in the next stretch is one.
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])) if len(row) else row
    return row[head], start[head], np.add.reduceat(count, head) if len(row) else count, mh[head]


def _stretch(data: np.ndarray, rows: np.ndarray, first: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments, and the places of their strings, among the `STRETCH` windows from `first`; these reach length - 1 bytes further."""
    hashes = gram_hashes(data[first : first + STRETCH + length - 1], gram)
    chosen = lowest_place(hashes, length - gram + 1)
    low = np.maximum(rows[:-1], first)
    size = np.maximum(np.minimum(rows[1:] - length + 1, first + STRETCH) - low, 0)
    row, start = np.repeat(np.arange(len(size)), size), ranges(low, size)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none
    place = chosen[start - first]
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    return row[head], start[head], np.diff(np.append(head, len(start))), hashes[place[head]], place[head] + first


def identified(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, text, sha, key, n_bytes); key is the first half of the SHA-256."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), body.alias("text")).withColumn("sha", F.sha2("text", 256))
    return rows.select("id", "text", "sha", F.unhex(F.substring("sha", 1, 32)).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))


def _chosen_strings(length: int, gram: int):
    """(key, mh, n): each document's chosen hashes and how many segments have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            row, _, _, mh = segments(*utf8(piece.column(1)), length, gram)
            order = np.lexsort((mh, row))
            row, mh = row[order], mh[order]
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (mh[1:] != mh[:-1])])) if len(row) else row
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(row[head])), pa.array(mh[head].view(np.int64)), pa.array(np.diff(np.append(head, len(row))))],
                ["key", "mh", "n"],
            )

    return run


def _cut(length: int, gram: int):
    """Segments of each document that have a wanted hash, equal ones of a batch as one row with all their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            data, rows = utf8(piece.column(1))
            row, start, count, mh = segments(data, rows, length, gram)
            wanted = [dict(zip(w.as_py(), p.as_py())) for w, p in zip(piece.column(2), piece.column(3))]
            keys = piece.column(0).to_pylist()
            found: dict[tuple, list[int]] = {}
            size = 0
            for r, s, c, m in zip(row.tolist(), start.tolist(), count.tolist(), mh.view(np.int64).tolist()):
                if m in wanted[r]:
                    if size >= CUT_BYTES:
                        yield batch_of(found, keys, wanted)
                        found, size = {}, 0
                    found.setdefault((r, m, data[s : s + c + length - 1].tobytes()), []).append(s - int(rows[r]))
                    size += c + length - 1
            yield batch_of(found, keys, wanted)

    def batch_of(found, keys, wanted):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([m for _, m, _ in found], pa.int64()),
                pa.array([(keys[r][0] * 256 + keys[r][1]) % wanted[r][m] for r, m, _ in found], pa.int32()),
                pa.array([wanted[r][m] for r, m, _ in found], pa.int32()),
                pa.array([keys[r] for r, _, _ in found], pa.binary()),
                pa.array(list(found.values()), pa.list_(pa.int32())),
                pa.array([b for _, _, b in found], pa.binary()),
            ],
            ["mh", "part", "parts", "key", "starts", "bytes"],
        )

    return run


MET = "key binary, low int, high int, digest binary, n int"


def _meet(length: int):
    """Rows of a partition sorted by bucket -> repeated windows [low, high) of documents (digest is null), and
    the distinct windows of buckets that were dealt out (n of them here; low is set where n is 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, list]] = {}
        size, last = 0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for mh, part, parts, key, starts, body in zip(*columns):
                bucket = (mh, part, parts)
                if size >= BATCH_BYTES and bucket != last:
                    yield _resolved(held, length)
                    held, size = {}, 0
                last = bucket
                owners = held.setdefault(bucket, {})
                if body not in owners:
                    owners[body] = []
                    size += len(body)
                owners[body].append((key, starts))
        if held:
            yield _resolved(held, length)

    return run


def _resolved(held: dict, length: int) -> pa.RecordBatch:
    marks: list[tuple] = []
    strings, bodies, dealt, copies = [], [], [], []
    for (_, _, parts), owners in held.items():
        times = [sum(len(s) for _, s in o) for o in owners.values()]
        for body, o, n in zip(owners, owners.values(), times):
            if n > 1:
                marks += [(key, low, high, None, n) for key, starts in o for low, high in _joined(starts, len(body) - length + 1)]
        if len(owners) > 1 or parts > 1:
            strings.append(len(owners))
            bodies += owners.items()
            dealt += [parts > 1] * len(owners)
            copies += times
    if bodies:
        marks += _compared(strings, bodies, np.array(dealt), np.array(copies), length)
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array([m[0] for m in marks], pa.binary()),
            "low": pa.array([m[1] for m in marks], pa.int32()),
            "high": pa.array([m[2] for m in marks], pa.int32()),
            "digest": pa.array([m[3] for m in marks], pa.binary()),
            "n": pa.array([m[4] for m in marks], pa.int32()),
        }
    )


def _joined(starts: list[int], count: int) -> Iterator[tuple[int, int]]:
    """Ranges of `count` windows from each start, those that touch as one."""
    low = high = None
    for s in sorted(starts):
        if high is None or s > high:
            if high is not None:
                yield low, high
            low = s
        high = s + count
    if high is not None:
        yield low, high


def _compared(strings: list[int], bodies: list, dealt: np.ndarray, copies: np.ndarray, length: int) -> list[tuple]:
    """`strings`: how many of the bodies make up each string."""
    data = np.frombuffer(b"".join(b for b, _ in bodies), np.uint8)
    size = np.array([len(b) for b, _ in bodies], np.int64)
    first = np.cumsum(size) - size
    body = np.arange(len(bodies))
    # Each body gets a mark after it: 1 between bodies, 0 at the end of a string.
    symbols = np.ones(len(data) + len(bodies), np.int64)
    symbols[ranges(first + body, size)] = data.astype(np.int64) + 2
    ends = np.cumsum(strings) - 1
    symbols[(first + size + body)[ends]] = 0
    lengths = np.add.reduceat(size + 1, np.cumsum(strings) - strings)
    order = suffix_arrays(symbols, lengths)
    # Where whole windows start, in bytes and in symbols.
    windows = size - length + 1
    is_window = np.zeros(len(symbols), bool)
    is_window[ranges(first + body, windows)] = True
    order = order[is_window[order]]
    of = np.repeat(body, size + 1)[order]
    at = order - of
    string = np.repeat(np.arange(len(strings)), strings)[of]
    same = equal_neighbours(data, at[:-1], at[1:], length) & (string[1:] == string[:-1])
    kind = np.cumsum(np.concatenate([[0], ~same]))
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    total = np.add.reduceat(copies[of], head)[kind]
    out = []
    repeated = np.zeros(len(data), bool)
    repeated[at[total > 1]] = True
    for b in np.unique(of[(total > 1) & (copies[of] == 1)]).tolist():
        flags = np.concatenate([[False], repeated[first[b] : first[b] + windows[b]], [False]])
        edges = np.flatnonzero(flags[1:] != flags[:-1]).reshape(-1, 2).tolist()
        out += [(key, s + low, s + high, None, 2) for key, starts in bodies[b][1] for s in starts for low, high in edges]
    whole = data.tobytes()
    for k in head[dealt[of[head]]].tolist():
        n, a = int(total[k]), int(at[k])
        digest = hashlib.sha256(whole[a : a + length]).digest()[:16]
        if n > 1:
            out.append((None, None, None, digest, n))
        else:
            key, starts = bodies[of[k]][1][0]
            low = starts[0] + a - int(first[of[k]])
            out.append((key, low, low + 1, digest, 1))
    return out


def _kept(length: int):
    """Removes the bytes under repeated windows from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            keys, n_removed, n_spans, sha, kept = piece.column(0), [], [], [], []
            for text, low, high in zip(*(piece.column(k).to_pylist() for k in (1, 2, 3))):
                data, low = text.encode(), np.array(low)
                order = np.argsort(low)
                low, high = low[order], np.maximum.accumulate(np.array(high)[order] + length - 1)
                first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
                low, high = low[first].tolist(), high[np.append(first[1:], len(high)) - 1].tolist()
                rest = b"".join(data[a:b] for a, b in zip([0, *high], [*low, len(data)]))
                n_removed.append(len(data) - len(rest))
                n_spans.append(len(low))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays(
                [keys, piece.column(4), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                ["key", "one", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def _texts(rows: DataFrame) -> DataFrame:
    # min(id) spreads the copies of a text over the partitions of the joins by text: only one meets its id.
    return rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("one"), F.max("n_bytes").alias("n_bytes"))


def _sharing(rows: DataFrame, texts: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per text that chooses a string which is chosen elsewhere too: key, text, mhs, parts, copies, one."""
    strings = stage(rows.select("key", "text").mapInArrow(_chosen_strings(length, gram), "key binary, mh long, n long"), tidy=True)
    owner = F.xxhash64("key")
    met = strings.groupBy("mh").agg(F.min(owner).alias("a"), F.max(owner).alias("b"), F.max("n").alias("n"), F.sum("n").alias("all"))
    met = met.where("a != b or n > 1").select("mh", F.ceil(F.col("all") / PER_ARRAY).cast("int").alias("parts"))
    wanted = _wanted(strings.join(met, "mh")).join(texts.drop("n_bytes"), "key")
    return stage(
        first_copies(rows, wanted).select("key", "text", F.map_keys("wanted").alias("mhs"), F.map_values("wanted").alias("parts"), "copies", "one"),
        tidy=True,
    )


def _wanted(strings: DataFrame) -> DataFrame:
    return strings.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("mh", "parts"))).alias("wanted"))


def _windows(sharing: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, low, high): the ranges of repeated windows of each text, as arrays."""
    cut = sharing.select("key", "text", "mhs", "parts").mapInArrow(
        _cut(length, gram), "mh long, part int, parts int, key binary, starts array<int>, bytes binary"
    )
    partitions = int(sharing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = stage(cut.repartition(partitions, "mh", "part").sortWithinPartitions("mh", "part").mapInArrow(_meet(length), MET), tidy=True)
    across = met.where("digest is not null")
    again = across.groupBy("digest").agg(F.sum("n").alias("total")).where("total > 1").select("digest")
    far = across.where("n = 1").join(again, "digest", "left_semi")
    windows = met.where("digest is null").select("key", "low", "high").unionByName(far.select("key", "low", "high"))
    return windows.groupBy("key").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))


def _cut_out(sharing: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """(key, one, n_removed, n_spans, kept_sha256, kept) of texts that occur once."""
    single = sharing.where("copies = 1").select("key", "text", "one").join(windows, "key")
    id_type = single.schema["one"].dataType.simpleString()
    return single.select("key", "text", "low", "high", "one").mapInArrow(
        _kept(length), f"key binary, one {id_type}, n_removed long, n_spans long, kept_sha256 string, kept string"
    )


def _losing(sharing: DataFrame, texts: DataFrame, length: int, gram: int) -> DataFrame:
    kept = _cut_out(sharing, _windows(sharing, length, gram), length).withColumn("copies", F.lit(1).cast("long"))
    gone = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select(
        "key", "one", "copies", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").alias("kept"),
    )
    return kept.unionByName(gone)


def repeated_strings(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, one, copies, n_removed, n_spans, kept_sha256, kept) of every text that loses bytes; one is its
    lowest id. Texts that occur several times lose all."""
    if not length > gram >= 8:
        raise ValueError("a window must be longer than the string it chooses")
    small_batches(docs.sparkSession)
    rows = identified(docs, id, text).where(F.col("n_bytes") >= length)
    texts = _texts(rows)
    return _losing(_sharing(rows, texts, length, gram), texts, length, gram)


def _with_passages(docs: DataFrame, length: int, gram: int, passage: int, id: str, text: str) -> DataFrame:
    """`repeated_strings` without the text, and n_repeated: n_removed or, of a text that loses nothing, the bytes
    under repeated strings of `passage` bytes.

    What a longer window chooses, some shorter window of it chooses too, so strings are chosen once, by the
    shorter ones. Only buckets of texts that lose nothing meet a second time, with all who are in them.
    """
    if not length >= passage > gram >= 8:
        raise ValueError("a window must be at least as long as a passage, and that longer than the string it chooses")
    small_batches(docs.sparkSession)
    rows = identified(docs, id, text).where(F.col("n_bytes") >= passage)
    texts = stage(_texts(rows), tidy=True)
    sharing = _sharing(rows, texts, passage, gram)
    losing = stage(_losing(sharing, texts, length, gram).drop("kept"), tidy=True)
    lost = losing.select("key")
    strings = sharing.select("key", "copies", F.explode(F.map_from_arrays("mhs", "parts")).alias("mh", "parts"))
    left = strings.where("copies = 1").join(lost, "key", "left_anti").select("mh").distinct()
    wanted = _wanted(strings.join(left, "mh", "left_semi"))
    again = stage(
        sharing.drop("mhs", "parts").join(wanted, "key")
        .select("key", "text", F.map_keys("wanted").alias("mhs"), F.map_values("wanted").alias("parts"), "copies", "one"),
        tidy=True,
    )
    found = _cut_out(again, _windows(again, passage, gram).join(lost, "key", "left_anti"), passage)
    found = found.select("key", "one", F.lit(1).cast("long").alias("copies"), F.col("n_removed").alias("n_repeated"))
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") < length)).select("key", "one", "copies", F.col("n_bytes").alias("n_repeated"))
    return losing.withColumn("n_repeated", F.col("n_removed")).unionByName(found.unionByName(whole), allowMissingColumns=True)


def removals(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id: str = "doc_id", text: str = "text", passage: int | None = None
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, n_kept (bytes left), changed.

    With `passage`, the length of a shorter string, also n_repeated: n_removed or, of a document that loses nothing,
    the bytes under strings of `passage` bytes that start elsewhere too. These are reported and stay in the text.
    """
    if passage is None:
        found = repeated_strings(docs, length, gram, id, text).drop("kept")
    else:
        found = _with_passages(docs, length, gram, passage, id, text)
    rows = join_by_text(identified(docs, id, text).select("id", "key", "sha", "n_bytes"), found)
    none = F.lit(0).cast("long")
    more = [] if passage is None else [F.coalesce("n_repeated", none).alias("n_repeated")]
    return rows.select(
        F.col("id").alias(id),
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        (F.col("n_bytes") - F.coalesce("n_removed", none)).alias("n_kept"),
        (F.coalesce("n_removed", none) > 0).alias("changed"),
        *more,
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with its columns, the repeated bytes taken out of the text. A null text stays null."""
    found = repeated_strings(docs, length, gram, id, text).select("key", "one", "copies", "kept")
    key = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))
    # The document's own columns travel as one, so that their names are free.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id).alias("id"), key.alias("key"))
    # Texts travel once: documents that lose nothing drop out before.
    losing = join_by_text(rows.select("id", "key"), found).where(F.col("kept").isNotNull()).distinct()
    losing = losing.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "kept")
    out = rows.join(losing, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    return out.select(*(F.coalesce("kept", f"row.`{c}`").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))
