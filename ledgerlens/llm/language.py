"""Language by hierarchical discrimination: family first, then one-versus-one linear SVMs within it.

A text is the vector of its character pairs and triples (of UTF-8 bytes, ASCII lower-cased, hashed to a table
of fixed size), scaled to unit length. One linear support vector machine per family, against all others,
chooses the family; within a family each pair of languages has its own machine, and the language with the
most votes wins (then the larger sum of margins, then the first by name).

The machines are trained in numpy, in one task, on a bounded sample of labelled rows: those of every language whose
hash is low enough for `per_language` of them on average, or for an equal share of `SAMPLE_ROWS` where there are
many languages. Only the sample goes to that task. Predicting needs one small matrix; no text is shuffled.

Defined results: null texts and texts without a letter are `und` with score 0; without training rows every
text is `und`; a family of one language needs no second step; rows with the same id stay separate rows.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.bytes_and_words import hashed_range, lower_table, mix, pieces, utf8
from ledgerlens.session import stage

# Families of related languages. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "hi", "mr", "ne", "pa", "ur"),
}
TABLE = 4096
PER_LANGUAGE = 1_200
SAMPLE_ROWS = 24_000  # of all languages, at least one of each
BROADCAST_LANGUAGES = 10_000  # with more of them their sizes are joined by shuffle
COST = 20.0
ROUNDS = 150


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def letters() -> np.ndarray:
    """Bytes that can be part of a letter, others are one mark."""
    table = lower_table()
    keep = np.zeros(256, bool)
    keep[97:123] = keep[128:] = True
    return np.where(keep[table], table, 32).astype(np.uint8)


def features(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(texts, TABLE) unit vectors, zero for texts without pairs."""
    n = len(rows) - 1
    symbols = letters()[data].astype(np.uint64)
    text = np.repeat(np.arange(n), np.diff(rows))
    out = np.zeros(n * TABLE, np.float32)
    factors = hashed_range(3, 53) | np.uint64(1)
    for size in (2, 3):
        if len(data) < size:
            continue
        stop = len(data) - size + 1
        value = np.full(stop, np.uint64(size))
        for k in range(size):
            value += symbols[k : k + stop] * factors[k]
        inside = text[:stop] == text[size - 1 :]
        # Runs of marks say nothing.
        inside &= (symbols[:stop] != 32) | (symbols[1 : stop + 1] != 32)
        at = text[:stop] * TABLE + (mix(value) % np.uint64(TABLE)).astype(np.int64)
        out += np.bincount(at[inside], minlength=n * TABLE).astype(np.float32)
    out = np.sqrt(out.reshape(n, TABLE))
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)


def machines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss for each column of y.

    y is 1, -1, or 0 for texts that a machine does not see; both sides weigh the same.
    """
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    y = y.astype(np.float32)
    side = lambda s: s / np.maximum(2 * s.sum(axis=0), 1)
    each = (side(y > 0) + side(y < 0)).astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    ahead, t = w.copy(), 1.0
    step = np.float32(1.0 / (1.0 + 2 * COST * 2))
    for _ in range(ROUNDS):
        slack = np.maximum(1 - y * (x @ ahead), 0) * each
        gradient = ahead - np.float32(2 * COST) * (x.T @ (slack * y))
        new = ahead - step * gradient
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w.T


def train(texts: list[str], languages: list[str]) -> dict:
    """Family machines, pair machines and their names, in rows of one matrix."""
    names = sorted(set(languages))
    families = sorted({family_of(n) for n in names})
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    rows = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts], dtype=np.int64)])
    x = np.concatenate([features(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a]) for a, b in _steps(len(texts), 200)])
    lang = np.array(languages)
    family = np.array([family_of(n) for n in languages])
    pairs = [(a, b) for f in families for a, b in itertools.combinations([n for n in names if family_of(n) == f], 2)]
    weights = [np.zeros((0, TABLE + 1), np.float32)]
    if len(families) > 1:
        weights.append(machines(x, np.where(family[:, None] == np.array(families), 1, -1)))
    for f in families:
        of = family == f
        own = [(lang[of] == a).astype(int) - (lang[of] == b) for a, b in pairs if family_of(a) == f]
        if own:
            weights.append(machines(x[of], np.stack(own, axis=1)))
    matrix = np.concatenate(weights)
    return {"matrix": matrix, "names": names, "families": families, "pairs": pairs}


def _steps(n: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, n)) for a in range(0, n, size)]


def predict(model: dict, data: np.ndarray, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the smaller of the confidences of both steps."""
    n, names, families = len(rows) - 1, model["names"], model["families"]
    if not names:
        return ["und"] * n, np.zeros(n)
    x = features(data, rows)
    margins = x @ model["matrix"][:, :-1].T + model["matrix"][:, -1] if len(model["matrix"]) else np.zeros((n, 0))
    chance = lambda m: 1 / (1 + np.exp(-4 * m))
    if len(families) > 1:
        family = margins[:, : len(families)].argmax(axis=1)
        sure = chance(margins[np.arange(n), family])
        margins = margins[:, len(families) :]
    else:
        family, sure = np.zeros(n, np.int64), np.ones(n)
    out = np.empty(n, object)
    for f, name in enumerate(families):
        own = np.flatnonzero(family == f)
        members = [m for m in names if family_of(m) == name]
        votes = np.zeros((len(own), len(members)))
        least = np.ones(len(own))
        for k, (a, b) in enumerate(model["pairs"]):
            if a in members:
                m = margins[own, k]
                votes[:, members.index(a)] += (m > 0) + chance(m) * 1e-3
                votes[:, members.index(b)] += (m <= 0) + chance(-m) * 1e-3
        best = votes.argmax(axis=1)
        for k, (a, b) in enumerate(model["pairs"]):
            if a in members:
                for side, sign in ((a, 1), (b, -1)):
                    won = best == members.index(side)
                    least[won] = np.minimum(least[won], chance(sign * margins[own[won], k]))
        out[own] = np.array(members, object)[best]
        sure[own] = np.minimum(sure[own], least)
    return out.tolist(), sure.astype(np.float64)


def has_letter(text: str | None) -> bool:
    return text is not None and (any(c.isalpha() for c in text[:64]) or any(c.isalpha() for c in text[64:]))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", id: str = "doc_id") -> dict:
    """The model, from a bounded sample of the rows of `docs` that have a language.

    Rows that repeat an id and a language count once. However many languages there are, all are learned.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    known = rows.where("lang is not null and id is not null")
    sizes = stage(known.groupBy("lang").agg(F.count("*").alias("of")))
    n_languages = sizes.count()
    if not n_languages:
        return {"matrix": np.zeros((0, TABLE + 1), np.float32), "names": [], "families": [], "pairs": []}
    wanted = min(per_language, max(SAMPLE_ROWS // n_languages, 1))
    draw = F.xxhash64("id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    sizes = F.broadcast(sizes) if n_languages <= BROADCAST_LANGUAGES else sizes
    drawn = known.join(sizes, "lang").where(draw < F.lit(float(wanted)) / F.col("of"))
    sample = drawn.groupBy("id", "lang").agg(F.min("text").alias("text")).select("text", "lang").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.take(pc.sort_indices(table, [("lang", "ascending"), ("text", "ascending")]))
        model = train([t or "" for t in table.column("text").to_pylist()], table.column("lang").to_pylist())
        rest = json.dumps({k: v for k, v in model.items() if k != "matrix"})
        yield pa.RecordBatch.from_arrays([pa.array([model["matrix"].astype(np.float32).tobytes()], pa.binary()), pa.array([rest])], ["matrix", "rest"])

    made = sample.mapInArrow(run, "matrix binary, rest string").collect()[0]
    return {"matrix": np.frombuffer(bytes(made.matrix), np.float32).reshape(-1, TABLE + 1)} | json.loads(made.rest)


def identify(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per document."""
    kind = docs.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            languages, sure = predict(shared.value, *utf8(piece.column(1)))
            known = np.array([has_letter(t) for t in piece.column(1).to_pylist()], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array([x if k else "und" for x, k in zip(languages, known.tolist())], pa.string()),
                    pa.array(np.where(known, sure, 0.0)),
                ],
                ["id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id)
