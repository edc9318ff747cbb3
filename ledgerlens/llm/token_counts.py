"""Token counts of byte-pair vocabularies by merging whole arrays, one rank per sequence and round.

Texts are split into pre-tokens; the distinct pre-tokens of a piece of text become one ragged array of
symbols. In every round each sequence looks up the ranks of its neighbouring pairs, takes the lowest and
merges all places of that pair at once (left to right where they overlap). A sequence without a known pair
is done, and its surviving symbols are counted. As every merge makes its own symbol, pairs with that symbol
have higher ranks, so merging all places at once equals merging them one by one.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows with the same id stay separate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.bytes_and_words import pieces, utf8

NO_RANK = np.int32(2**31 - 1)


class Merges(NamedTuple):
    byte_ids: np.ndarray  # symbol of each byte
    first: np.ndarray  # rank of each pair of bytes
    keys: np.ndarray  # left << 32 | right, sorted
    ranks: np.ndarray
    made: np.ndarray  # symbol made by each rank
    adjacent: np.ndarray  # whether any symbol has these two bytes side by side
    pattern: str
    special: tuple[str, ...]


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_merges(path: str, pattern: str) -> Merges:
    """The merges of a byte-level BPE vocabulary file in JSON."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, characters = spec["model"], byte_characters()
    vocabulary = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right, made = (np.array([vocabulary[t] for t in side], np.int64) for side in (*zip(*pairs), ["".join(p) for p in pairs]))
    if len(np.unique(made)) != len(made):
        raise ValueError("a symbol is made by two merges, so merging by rank could give other counts")
    keys = left << 32 | right
    order = np.argsort(keys)
    byte_ids = np.zeros(256, np.int64)
    for character, byte in characters.items():
        byte_ids[byte] = vocabulary[character]
    adjacent = np.zeros((256, 256), bool)
    for symbol in vocabulary:
        codes = [characters[c] for c in symbol]
        adjacent[codes[:-1], codes[1:]] = True
    table = Merges(byte_ids, np.zeros(0), keys[order], order.astype(np.int32), made, adjacent, pattern, tuple(
        t["content"] for t in spec.get("added_tokens", [])
    ))
    grid = (byte_ids[:, None] << 32 | byte_ids[None, :]).ravel()
    return table._replace(first=_ranks(table, grid))


def _ranks(m: Merges, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(m.keys, keys), len(m.keys) - 1)
    return np.where(m.keys[at] == keys, m.ranks[at], NO_RANK)


def symbol_counts(sequences: list[bytes], m: Merges) -> np.ndarray:
    """How many symbols survive in each sequence."""
    data = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64)
    size = np.array([len(s) for s in sequences], np.int64)
    counts = np.zeros(len(sequences), np.int64)
    if not len(data):
        return counts
    owner = np.repeat(np.arange(len(sequences)), size)
    # No merge crosses two bytes that no symbol holds side by side, so long sequences part there.
    apart = (owner[1:] != owner[:-1]) | ~m.adjacent[data[:-1], data[1:]]
    part = np.concatenate([[0], np.cumsum(apart)])
    of_part = owner[np.concatenate([[True], apart])]
    symbols = m.byte_ids[data]
    ranks = np.where(part[1:] == part[:-1], m.first[data[:-1] << 8 | data[1:]], NO_RANK)
    while True:
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        lowest = np.minimum.reduceat(np.append(ranks, NO_RANK), starts)
        length = np.diff(np.append(starts, len(part)))
        done = lowest == NO_RANK
        np.add.at(counts, of_part[part[starts[done]]], length[done])
        if done.all():
            return counts
        alive = np.repeat(~done, length)
        symbols, part = symbols[alive], part[alive]
        ranks = np.append(ranks, NO_RANK)[alive][:-1]
        lowest = np.repeat(lowest[~done], length[~done])
        chosen = np.append(ranks, NO_RANK) == lowest
        # In a run of overlapping pairs every other one is merged.
        at = np.flatnonzero(chosen)
        run = np.concatenate([[True], np.diff(at) > 1])
        run_start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        symbols[at] = m.made[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, part = symbols[keep], part[keep]
        same = part[1:] == part[:-1]
        ranks = np.full(len(symbols) - 1, NO_RANK)
        ranks[same] = _ranks(m, symbols[:-1][same] << 32 | symbols[1:][same])


def count_tokens(texts: list[str], m: Merges, split, special) -> np.ndarray:
    """Tokens of each text. Special strings inside a text are one token each."""
    found, sizes, extra = [], [], []
    for text in texts:
        before, n_special = len(found), 0
        if special is not None and special.search(text):
            parts = special.split(text)
            n_special = len(parts) - 1
            for part in parts:
                found += split(part)
        else:
            found += split(text)
        sizes.append(len(found) - before)
        extra.append(n_special)
    total = np.array(extra, np.int64)
    if found:
        codes, distinct = pd.factorize(np.array(found, dtype=object))
        each = symbol_counts([s.encode() for s in distinct], m)[codes]
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])]
        total += np.diff(ends)
    return total


def token_counts(docs: DataFrame, merges: Merges, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens. No shuffle; distinct pre-tokens are merged once per piece."""
    kind = docs.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(merges))  # fixed by the vocabulary file, about 2 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Merges(*shared.value)
        split = regex.compile(m.pattern).findall
        special = regex.compile("|".join(map(regex.escape, m.special))) if m.special else None
        for piece in pieces(batches, "text"):
            texts = ["" if t is None else t for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(np.diff(utf8(piece.column(1))[1])), pa.array(count_tokens(texts, m, split, special))],
                ["id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id)
