"""Toxicity by subword-bag embeddings and a linear softmax, learned together in numpy.

A word is the mean of the vectors of itself and of its character runs of 3 to 5 (with marks for its ends),
all hashed to a table of fixed size; a window of words is the mean of its words, and a linear softmax gives
its class. A misspelling shares most runs with its word. A text's score is that of its worst window,
calibrated by logistic regression on the training texts to the share of toxic rows among the labelled.

Training rows are a bounded sample of the labelled rows (`per_class` of each class, in the order of a hash);
they are learned from in one task. Scoring needs one number per subword, so the model is two arrays of fixed
size that go to every task, and no text is shuffled.

Defined results: a text without words, or null, has a window without words, whose score is that of the bias;
without labels of both classes every score is the share of toxic rows (0 without labels); rows with the same
id stay separate rows and share their labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.bytes_and_words import hashed_range, lower_table, mix, pieces, ranges, utf8, words

TABLE = 1 << 16
DIM = 8
WINDOW = 16
STEP = 8
PER_CLASS = 2_500
EPOCHS = 3
STEPS = 500  # of training at least, so that few texts get more passes
BATCH = 128
RATE = 0.5
LEAST_TEXTS = 4  # training texts that must share a subword before it is learned
RUNS = (3, 4, 5)


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the table of each word's subwords, and how many each word has."""
    length = end - start
    lowered = lower_table()[data].astype(np.uint64) + np.uint64(1)
    # Words between marks: byte 0 before and after.
    size = length + 2
    first = np.cumsum(size) - size
    marked = np.zeros(int(size.sum()), np.uint64)
    marked[ranges(first + 1, length)] = lowered[ranges(start, length)]
    parts = [(np.arange(len(start)), hashes)]
    factors = hashed_range(max(RUNS), 41) | np.uint64(1)
    for n in RUNS:
        count = np.maximum(size - n + 1, 0)
        at = ranges(first, count)
        value = np.full(len(at), np.uint64(n))
        for k in range(n):
            value += marked[at + k] * factors[k]
        parts.append((np.repeat(np.arange(len(start)), count), mix(value)))
    word = np.concatenate([p[0] for p in parts])
    row = (np.concatenate([p[1] for p in parts]) % np.uint64(TABLE)).astype(np.int32)
    order = np.argsort(word, kind="stable")
    return row[order], np.bincount(word, minlength=len(start))


def distinct_words(data: np.ndarray, rows: np.ndarray):
    """Subwords and their numbers for each distinct word, the word at each place, and where each text starts."""
    found = words(data, rows)
    _, at, which = np.unique(found.hash, return_index=True, return_inverse=True)
    row, count = subwords(data, found.start[at], found.end[at], found.hash[at])
    return row, count, which, found.first


def window_bounds(first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of each window; the last window of a text ends with it."""
    count = np.diff(first)
    number = np.maximum(-(-(count - WINDOW) // step), 0) + 1
    text = np.repeat(np.arange(len(count)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    low = np.minimum(k * step, np.maximum(count[text] - WINDOW, 0))
    return text, first[text] + low, first[text] + np.minimum(low + WINDOW, count[text])


def worst_window(value: np.ndarray, which: np.ndarray, first: np.ndarray, bias: float) -> np.ndarray:
    """The highest mean of word values over the windows of each text, plus the bias."""
    text, low, high = window_bounds(first, STEP)
    mean = _window_means(value, which, low, high)
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else text
    return np.maximum.reduceat(mean, starts) + bias if len(text) else np.zeros(0)


def _window_means(value: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(value[which])]) if len(which) else np.zeros(1)
    return (sums[high] - sums[low]) / np.maximum(high - low, 1)


def word_values(scores: np.ndarray, row: np.ndarray, count: np.ndarray) -> np.ndarray:
    if not len(count):
        return np.zeros(0)
    return np.add.reduceat(scores[row].astype(np.float64), np.cumsum(count) - count) / count


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str], toxic: np.ndarray, rate: float, seed: int = 7) -> dict:
    """Embeddings and softmax over windows, then the calibration of whole texts.

    A toxic text may be toxic in few places, so training runs twice: first every window has its text's label,
    then of the windows of a toxic text only the worst stay (those that score above most clean ones, or the
    single worst). A fifth of the texts is left out and calibrates.
    """
    random = np.random.default_rng(seed)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    rows = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts], dtype=np.int64)])
    bag = distinct_words(data, rows)
    row, count, which, first = bag
    left_out = random.random(len(texts)) < 0.2
    if any(len(np.unique(toxic[left_out == side])) < 2 for side in (True, False)) or len(texts) < 50:
        left_out[:] = False
    text, low, high = window_bounds(first, WINDOW)
    chosen = np.flatnonzero((high > low) & ~left_out[text])
    if not len(chosen):
        return untrained(rate)
    # What few texts hold can only be learned by heart.
    begin = np.cumsum(count) - count
    learned = np.flatnonzero(~left_out[np.repeat(np.arange(len(texts)), np.diff(first))])
    owner = np.repeat(np.arange(len(texts)), np.diff(first))[learned]
    held = np.unique(np.repeat(owner, count[which[learned]]) * TABLE + row[ranges(begin[which[learned]], count[which[learned]])])
    known = np.bincount(held % TABLE, minlength=TABLE) >= LEAST_TEXTS
    scores, bias = _fitted(bag, text, low, high, chosen, toxic, known, random)
    mean = _window_means(word_values(scores, row, count), which, low, high)
    usual = np.quantile(mean[chosen][toxic[text[chosen]] == 0], 0.99)
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, text[chosen], mean[chosen])
    clear = (mean > usual) | (mean >= worst[text])
    chosen = chosen[(toxic[text[chosen]] == 0) | clear[chosen]]
    scores, bias = _fitted(bag, text, low, high, chosen, toxic, known, random)
    raw = worst_window(word_values(scores, row, count), which, first, bias)
    calibrates = left_out if left_out.any() else ~left_out
    share = np.where(toxic == 1, rate / (toxic[calibrates] == 1).sum(), (1 - rate) / (toxic[calibrates] == 0).sum()) * calibrates.sum()
    slope, shift = calibration(raw[calibrates], toxic[calibrates], share[calibrates])
    return {"scores": scores, "bias": bias, "slope": slope, "shift": shift, "rate": rate}


def untrained(rate: float) -> dict:
    return {"scores": np.zeros(TABLE, np.float32), "bias": 0.0, "slope": 0.0, "shift": None, "rate": rate}


def _fitted(bag, text, low, high, chosen, toxic, known, random) -> tuple[np.ndarray, float]:
    """Adagrad over the chosen windows; both classes weigh the same, and so do the texts of a class."""
    row, count, which, _ = bag
    begin = np.cumsum(count) - count
    n_texts = len(toxic)
    per_text = np.bincount(text[chosen], minlength=n_texts)
    used = per_text > 0
    of_class = np.array([max(((toxic == y) & used).sum(), 1) for y in (0, 1)])
    weight = (0.5 / of_class[toxic] / np.maximum(per_text, 1))[text] * len(chosen)
    table = random.uniform(-1, 1, (TABLE, DIM)).astype(np.float32) / DIM
    table[~known] = 0
    softmax = np.zeros((DIM, 2), np.float32)
    softmax[:, 1] = random.normal(0, 0.3, DIM)
    softmax[:, 0] = -softmax[:, 1]
    bias = np.zeros(2, np.float32)
    seen = np.full(TABLE, 1e-6, np.float32)
    seen_softmax = np.full((DIM, 2), 1e-6, np.float32)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(chosen)))):
        order = random.permutation(chosen)
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            n = high[batch] - low[batch]
            words_, at = np.unique(which[ranges(low[batch], n)], return_inverse=True)
            owner = np.repeat(np.arange(len(batch)), n)
            subs = row[ranges(begin[words_], count[words_])]
            vectors = np.add.reduceat(table[subs], np.cumsum(count[words_]) - count[words_]) / count[words_][:, None]
            hidden = np.add.reduceat(vectors[at], np.cumsum(n) - n) / n[:, None]
            logits = hidden @ softmax + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), toxic[text[batch]]] -= 1
            error *= weight[batch][:, None]
            to_softmax = hidden.T @ error / len(batch)
            to_hidden = (error @ softmax.T) / n[:, None]
            to_word = np.stack([np.bincount(at, weights=to_hidden[owner, k], minlength=len(words_)) for k in range(DIM)], axis=1)
            to_word /= count[words_][:, None]
            places, where = np.unique(subs, return_inverse=True)
            word_of = np.repeat(np.arange(len(words_)), count[words_])
            step = np.stack([np.bincount(where, weights=to_word[word_of, k], minlength=len(places)) for k in range(DIM)], axis=1)
            step[~known[places]] = 0
            seen[places] += (step**2).mean(axis=1)
            table[places] -= (RATE * step / np.sqrt(seen[places])[:, None]).astype(np.float32)
            seen_softmax += to_softmax**2
            softmax -= 0.1 * to_softmax / np.sqrt(seen_softmax)
            bias -= (0.05 * error.mean(axis=0)).astype(np.float32)
    scores = (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    # A subword that training never met leans to neither side.
    scores[seen <= 1e-6] = 0
    return scores, float(bias[1] - bias[0])


def calibration(raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic regression, slightly drawn to slope 0, by Newton's method."""
    mean, spread = raw.mean(), raw.std() + 1e-9
    x = np.stack([(raw - mean) / spread, np.ones(len(raw))], axis=1)
    beta = np.zeros(2)
    ridge = np.diag([0.5, 1e-6])
    for _ in range(50):
        p = logistic(x @ beta)
        gradient = x.T @ (weight * (p - toxic)) + ridge @ beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + np.eye(2) * 1e-9
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return float(beta[0] / spread), float(beta[1] - beta[0] * mean / spread)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The model. `labels` holds the rows that may be learned from."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return untrained(rate)
    # At most 2 * per_class ids.
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    # The join is made where the documents are; one task gets the sample alone.
    sample = rows.join(F.broadcast(chosen[0].union(chosen[1])), "id").select("text", "y").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        order = pa.compute.sort_indices(table, [("y", "ascending"), ("text", "ascending")]) if len(table) else None
        y = np.zeros(0, np.int64)
        if len(table):
            table = table.take(order)
            y = table.column("y").to_numpy().astype(np.int64)
        if len(np.unique(y)) < 2:
            model = untrained(rate)
        else:
            model = train([t or "" for t in table.column("text").to_pylist()], y, rate)
        rest = json.dumps({k: v for k, v in model.items() if k != "scores"})
        yield pa.RecordBatch.from_arrays([pa.array([model["scores"].tobytes()], pa.binary()), pa.array([rest])], ["scores", "rest"])

    made = sample.mapInArrow(run, "scores binary, rest string").collect()[0]
    return {"scores": np.frombuffer(bytes(made.scores), np.float32)} | json.loads(made.rest)


def score(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score), one row per document."""
    kind = docs.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for piece in pieces(batches, "text"):
            row, count, which, first = distinct_words(*utf8(piece.column(1)))
            raw = worst_window(word_values(m["scores"], row, count), which, first, m["bias"])
            value = np.full(len(raw), m["rate"]) if m["shift"] is None else logistic(m["slope"] * raw + m["shift"])
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(value)], ["id", "score"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id)
