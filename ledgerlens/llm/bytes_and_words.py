"""UTF-8 columns as numpy arrays, and their words.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased, that is of digits,
ASCII letters and everything beyond ASCII. Every byte of a character beyond ASCII is 0x80 or more, so
words can be found byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed_range(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most `limit` bytes of text, or one longer row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


class Words(NamedTuple):
    start: np.ndarray  # byte where each word starts
    end: np.ndarray
    hash: np.ndarray  # 64 bits of each word
    first: np.ndarray  # word where each row starts, and the number of all words


def words(data: np.ndarray, rows: np.ndarray, table: np.ndarray | None = None) -> Words:
    """Words of the rows; `table` says which bytes they consist of, if not those above."""
    lowered = lower_table()[data]
    inside = (word_table() if table is None else table)[lowered]
    begins = inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        # A row's end closes a word.
        cuts = rows[1:-1][rows[1:-1] < len(data)]
        begins[cuts] |= inside[cuts]
    start = np.flatnonzero(begins)
    kept = lowered[inside]
    ordinal = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    offset = ordinal[start].astype(np.int64) - 1
    length = np.diff(np.append(offset, len(kept)))
    return Words(start, start + length, _hashes(kept, offset, length), np.searchsorted(start, rows))


def _hashes(kept: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    if not len(offset):
        return np.zeros(0, np.uint64)
    place = np.arange(len(kept)) - np.repeat(offset, length)
    powers = np.full(int(length.max()), np.uint64(0xD6E8FEB86659FD93))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    parts = hashed_range(256, 7)[kept] * powers[place]
    return mix(np.add.reduceat(parts, offset) + length.astype(np.uint64))


def text_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    found = words(data, rows)
    return [found.hash[a:b] for a, b in zip(found.first[:-1], found.first[1:])]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), then the same for start[1] and so on."""
    total = int(length.sum())
    base = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return base + np.arange(total)
