"""Text quality by an interpolated modified Kneser-Ney model of trusted text.

The symbols are the characters of the text, whatever its script, and the model has five of them per n-gram; its
vocabulary is that of the documents. (`folded=True` takes bytes as 32 symbols instead: letters, one for capitals,
one each for white space, punctuation, digits, other signs and bytes beyond ASCII.) Documents are dealt to shards
by id. One pass brings the ids of trusted documents to each shard, and the shard says which n-grams its texts
hold and how often its trusted ones do. Counts, continuation counts, contexts and lower orders are joined as
tables keyed by n-gram, which gives the probability of every n-gram that any document holds; a second pass
brings each shard its own. A document's perplexity is that of its symbols.

Documents are kept up to a quantile, per language, of the perplexities of trusted documents that the model has
not seen (a fifth of them, by a hash of the id). The level leaves out a hundredth of them, so that a few texts
that are trusted wrongly do not set the threshold, however many documents there are.

Shards stream: their ids or probabilities come first, then their texts in compressed blocks, so memory
depends on the number of distinct n-grams and not on the texts.

Defined results: null and empty texts have no perplexity and are not kept; a null language is `und`; a
language without trusted documents uses the quantile over all trusted ones, and without any trusted document
all texts are kept; rows with the same id stay separate rows and are trusted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.bytes_and_words import pieces, utf8
from ledgerlens.session import small_batches, stage

ORDER = 5
BITS = 5
SYMBOLS = 1 << BITS
CAPITAL, SPACE, PUNCTUATION, DIGIT, SIGN, OTHER = range(26, 32)
QUANTILE = 0.99
WIDTH = 3  # bytes of a character in the tables of n-grams
SHARD_BYTES = 48_000_000
SYMBOLS_AT_ONCE = 250_000
BROADCAST_LANGUAGES = 10_000  # with more of them their thresholds are joined by shuffle


def symbol_table() -> np.ndarray:
    table = np.full(256, SIGN, np.uint8)
    table[97:123] = np.arange(26)
    table[65:91] = CAPITAL
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = PUNCTUATION
    table[48:58] = DIGIT
    table[128:] = OTHER
    return table


def characters(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 texts as numbers, and how many each text has."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint32), lengths
    ends = np.cumsum(lengths, dtype=np.int64)
    leads = (data & 0xC0) != 0x80
    leads[(ends - lengths)[np.asarray(lengths) > 0]] = True
    starts = np.flatnonzero(leads)
    size = np.minimum(np.diff(np.append(starts, len(data))), 4)
    out = data[starts].astype(np.uint32)
    long = np.flatnonzero(size > 1)
    out[long] &= (0xFF >> (size[long] + 1)).astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(size > k)
        out[long] = out[long] << 6 | data[starts[long] + k] & 0x3F
    before = np.concatenate([[0], np.cumsum(leads)])
    return out, before[ends] - before[ends - lengths]


def grams(symbols: np.ndarray, lengths: np.ndarray, blank: int):
    """The n-gram that ends with each symbol, as ORDER arrays for some symbols at a time, and the first of these; texts begin with blanks."""
    lengths = np.asarray(lengths, np.int64)
    pad = ORDER - 1
    padded = np.full(len(symbols) + pad * len(lengths), blank, np.uint32)
    at = np.arange(len(symbols)) + pad * (np.repeat(np.arange(len(lengths)), lengths) + 1)
    padded[at] = symbols
    for first in range(0, len(at), SYMBOLS_AT_ONCE):
        part = at[first : first + SYMBOLS_AT_ONCE]
        yield first, [padded[part - k] for k in range(pad, -1, -1)]


def folded_codes(gram: list[np.ndarray]) -> np.ndarray:
    code = np.zeros(len(gram[0]), np.int32)
    for symbol in gram:
        code = code << BITS | symbol.astype(np.int32)
    return code


def codes(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For every folded symbol the number of the n-gram that ends with it."""
    return np.concatenate([np.zeros(0, np.int32), *(folded_codes(g) for _, g in grams(symbols, lengths, SPACE))])


def packed(gram: list[np.ndarray], folded: bool) -> pa.Array:
    """N-grams as they are joined: numbers, or three bytes for each character."""
    if folded:
        return pa.array(folded_codes(gram))
    data = np.stack(gram, axis=1).astype(">u4").view(np.uint8).reshape(-1, ORDER, 4)[:, :, 1:].tobytes()
    ends = np.arange(len(gram[0]) + 1, dtype=np.int32) * (ORDER * WIDTH)
    return pa.Array.from_buffers(pa.binary(), len(gram[0]), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(data: bytes, folded: bool) -> list[np.ndarray]:
    if folded:
        code = np.frombuffer(data, np.int32)
        return [(code >> BITS * k & SYMBOLS - 1).astype(np.uint32) for k in range(ORDER - 1, -1, -1)]
    a, b, c = np.frombuffer(data, np.uint8).reshape(-1, ORDER, WIDTH).astype(np.uint32).transpose(2, 1, 0)
    return list(a << 16 | b << 8 | c)


def hashed(gram: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(gram[0]), np.uint64)
    for symbol in gram:
        out = (out ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Numbered:
    """Numbers 64-bit hashes in the order in which they come: an open table that grows with them."""

    def __init__(self):
        self.keys, self.bits = np.zeros(1 << 12, np.uint64), 16
        self._empty()

    def _empty(self):
        self.count = 0
        self.held, self.number = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def _slots(self, keys):
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        """`keys` are new."""
        if 2 * (self.count + len(keys)) > len(self.held):
            keys = np.concatenate([self.keys[: self.count], keys])
            self.bits = max(self.bits + 1, int(2 * len(keys)).bit_length())
            self._empty()
        total = self.count + len(keys)
        if total > len(self.keys):
            self.keys = np.concatenate([self.keys[: self.count], np.zeros(2 * total - self.count, np.uint64)])
        self.keys[self.count : total] = keys
        number, slot = np.arange(self.count, total, dtype=np.int32), self._slots(keys)
        self.count = total
        while len(number):
            free = self.number[slot] < 0
            self.number[slot[free]] = number[free]
            lost = self.number[slot] != number
            won = ~lost
            self.held[slot[won]] = keys[won]
            keys, number, slot = keys[lost], number[lost], (slot[lost] + 1) & (len(self.held) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of `keys`, -1 for those that are new."""
        slot = self._slots(keys)
        out = self.number[slot]
        todo = np.flatnonzero((self.held[slot] != keys) & (out >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.held) - 1)
            found = self.number[slot]
            out[todo] = found
            on = (self.held[slot] != keys[todo]) & (found >= 0)
            todo, slot = todo[on], slot[on]
        return out


BLOCKS = "shard int, kind int, ids array<{id}>, langs array<string>, lengths array<int>, keys array<binary>, data binary, more binary"


def _blocks(folded: bool):
    """Documents as compressed blocks of bytes or symbols, one per shard and piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squeeze = symbol_table(), zstandard.ZstdCompressor(level=3)
        for piece in pieces(batches, "text", 8_000_000):
            data, rows = utf8(piece.column(1))
            symbols, shard, keys = table[data] if folded else data, piece.column(3).to_numpy(), piece.column(4)
            out = []
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                body = b"".join(symbols[rows[r] : rows[r + 1]].tobytes() for r in own.tolist())
                pick = pa.array(own)
                out.append((s, piece.column(0).take(pick), piece.column(2).take(pick), np.diff(rows)[own].astype(np.int32), keys.take(pick), squeeze.compress(body)))
            one = pa.array(np.cumsum([0] + [len(x[1]) for x in out]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int32()),
                    pa.array([1] * len(out), pa.int32()),
                    pa.ListArray.from_arrays(one, pa.concat_arrays([x[1] for x in out])),
                    pa.ListArray.from_arrays(one, pa.concat_arrays([x[2] for x in out])),
                    pa.ListArray.from_arrays(one, pa.array(np.concatenate([x[3] for x in out]))),
                    pa.ListArray.from_arrays(one, pa.concat_arrays([x[4] for x in out])),
                    pa.array([x[5] for x in out], pa.binary()),
                    pa.nulls(len(out), pa.binary()),
                ],
                ["shard", "kind", "ids", "langs", "lengths", "keys", "data", "more"],
            )

    return run


def _stream(batches, first: int):
    """Rows of a partition sorted by shard and kind, as (shard, kind, row): a new shard's tables come first."""
    for batch in batches:
        for r in range(len(batch)):
            yield batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), [batch.column(k)[r] for k in range(first, batch.num_columns)]


def _symbols(row, folded: bool) -> tuple[np.ndarray, np.ndarray]:
    lengths = row[2].values.to_numpy()
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row[4].as_py(), max_output_size=int(lengths.sum()) + 1), np.uint8)
    return (data, lengths) if folded else characters(data, lengths)


def _counted(folded: bool):
    """(shard, code, n): the n-grams of each shard and how often its trusted documents hold them."""

    def rows(shard, held, counts):
        gram = [np.concatenate(x) for x in zip(*held)]
        for a in range(0, len(gram[0]) if gram else 0, 100_000):
            code = packed([x[a : a + 100_000] for x in gram], folded)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(code), shard, np.int32)), code, pa.array(counts[a : a + len(code)])], ["shard", "code", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trusted, known, held, counts = None, set(), None, [], None
        for shard, kind, row in _stream(batches, 2):
            if shard != now:
                if known is not None:
                    yield from rows(now, held, counts)
                now, trusted, known, held, counts = shard, set(), Numbered(), [], np.zeros(1 << 16, np.int64)
            if kind == 0:
                trusted.update(row[0].as_py())
                continue
            symbols, lengths = _symbols(row, folded)
            good = np.repeat(np.array([i in trusted for i in row[0].as_py()], bool), lengths)
            for first, gram in grams(symbols, lengths, SPACE if folded else 32):
                keys = hashed(gram)
                number = known.find(keys)
                new = np.flatnonzero(number < 0)
                if len(new):
                    fresh, where = np.unique(keys[new], return_index=True)
                    known.add(fresh)
                    held.append([x[new[where]] for x in gram])
                    number[new] = known.find(keys[new])
                    if known.count > len(counts):
                        counts = np.concatenate([counts, np.zeros(known.count, np.int64)])
                np.add.at(counts, number[good[first : first + len(keys)]], 1)
        if known is not None:
            yield from rows(now, held, counts)

    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """For n-grams seen once, twice and more often; where counts of counts are missing, less than the count."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), top) for d, top in zip(raw, (0.95, 1.95, 2.95)))


def probabilities(counted: DataFrame) -> DataFrame:
    """(code, p) for every n-gram in `counted` (shard, code, n). Codes are numbers (folded) or bytes (characters)."""
    spark = counted.sparkSession
    folded = counted.schema["code"].dataType.typeName() != "binary"
    if folded:
        last = lambda k: F.col("code").bitwiseAND((1 << BITS * k) - 1).cast("int")
    else:
        last = lambda k: F.substring("code", WIDTH + 1, WIDTH * k)
    tables = {ORDER: stage(counted.groupBy("code").agg(F.sum("n").alias("c")))}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = stage(tables[k + 1].groupBy(last(k).alias("code")).agg(F.count_if(F.col("c") > 0).alias("c")))
    tallies = [t.agg(F.lit(k).alias("k"), F.count("*").alias("size"), *(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5))) for k, t in tables.items()]
    found = tallies[0]
    for t in tallies[1:]:
        found = found.union(t)
    found = found.collect()  # ORDER rows
    d = {r.k: discounts(r.n1, r.n2, r.n3, r.n4) for r in found}
    size = SYMBOLS if folded else max(1, *(r["size"] for r in found if r.k == 1), 1)
    lower = spark.createDataFrame([(0 if folded else b"", 1.0 / size)], f"code {'int' if folded else 'binary'}, p double")
    for k in range(1, ORDER + 1):
        off = lambda c, k=k: F.when(c == 1, d[k][0]).when(c == 2, d[k][1]).when(c > 2, d[k][2]).otherwise(0.0)
        context = F.shiftright("code", BITS) if folded else F.substring("code", 1, WIDTH * (k - 1))
        rows = tables[k].withColumns({"context": context, "rest": last(k - 1)})
        contexts = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum(off(F.col("c"))).alias("held"))
        rows = rows.join(contexts, "context").join(lower.select(F.col("code").alias("rest"), F.col("p").alias("below")), "rest")
        own = (F.col("c") - off(F.col("c")) + F.col("held") * F.col("below")) / F.col("total")
        lower = rows.select("code", F.when(F.col("total") > 0, own).otherwise(F.col("below")).alias("p"))
    return lower


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, code, log p) -> one row per shard and batch."""
    for batch in batches:
        shard, value = (batch.column(k).to_numpy() for k in (0, 2))
        code = batch.column(1)
        if code.type == pa.binary():
            data, _ = utf8(code)
            code = data.reshape(len(shard), -1)
        else:
            code = code.to_numpy()
        order = np.argsort(shard, kind="stable")
        kinds, starts = np.unique(shard[order], return_index=True)
        groups = np.split(order, starts[1:])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds.astype(np.int32)),
                pa.array([code[g].tobytes() for g in groups], pa.binary()),
                pa.array([value[g].astype(np.float32).tobytes() for g in groups], pa.binary()),
            ],
            ["shard", "data", "more"],
        )


def _scored(kind: pa.DataType, folded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, values = None, None, None
        for shard, table, row in _stream(batches, 2):
            if shard != now:
                now, known, values = shard, Numbered(), np.zeros(1 << 16, np.float32)
            if table == 0:
                keys, value = hashed(unpacked(row[4].as_py(), folded)), np.frombuffer(row[5].as_py(), np.float32)
                used = known.count
                known.add(keys)
                if known.count > len(values):
                    values = np.concatenate([values, np.zeros(known.count, np.float32)])
                values[used : known.count] = value
                continue
            symbols, lengths = _symbols(row, folded)
            each = np.zeros(len(symbols))
            for first, gram in grams(symbols, lengths, SPACE if folded else 32):
                each[first : first + len(gram[0])] = values[known.find(hashed(gram))]
            sums = np.diff(np.concatenate([[0.0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])])
            mean = -sums / np.maximum(lengths, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    row[0].values.cast(kind),
                    row[3].values,
                    row[1].values,
                    pa.array(lengths.astype(np.int64)),
                    pa.array(np.exp(mean), mask=lengths == 0),
                ],
                ["id", "key", "lang", "n_symbols", "perplexity"],
            )

    return run


def perplexities(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", folded: bool = True) -> DataFrame:
    """Staged (id, key, lang, n_symbols, perplexity), one row per document; key is half of the text's SHA-256. `trusted` has the ids of trusted documents."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id].dataType
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    key = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)).alias("key")
    # Texts without an id are never trusted, so they need not meet an id.
    dealt = lambda by: F.pmod(by, F.lit(shards)).cast("int").alias("shard")
    shard = dealt(F.xxhash64("id"))
    of_text = dealt(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")))
    schema = BLOCKS.format(id=id_type.simpleString())
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)
    blocks = rows.select("id", "text", "lang", of_text, key).mapInArrow(_blocks(folded), schema)
    ids = trusted.select(F.col(id).cast(id_type).alias("id")).where("id is not null").distinct().select("id", shard)
    # Some hundred rows of ids for each shard; a shard that is large gets more of them, not larger ones.
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(256))
    ids = ids.groupBy("shard", part.alias("part")).agg(F.collect_list("id").alias("ids"))
    none = {n: F.lit(None) for n in ("ids", "langs", "lengths", "keys", "data", "more")}
    as_block = lambda df: df.select("shard", F.lit(0).alias("kind"), *(
        (F.col(n) if n in df.columns else none[n]).cast(blocks.schema[n].dataType).alias(n) for n in none
    ))
    met = lambda extra: as_block(extra).union(blocks).repartition(min(partitions, shards), "shard").sortWithinPartitions("shard", "kind")
    counted = stage(met(ids).mapInArrow(_counted(folded), f"shard int, code {'int' if folded else 'binary'}, n long"))
    values = counted.select("shard", "code").join(probabilities(counted), "code").select("shard", "code", F.log("p").alias("value"))
    tables = values.mapInArrow(_tables, "shard int, data binary, more binary")
    out = met(tables).mapInArrow(_scored(kind, folded), f"id {id_type.simpleString()}, key binary, lang string, n_symbols long, perplexity double")
    return stage(out)


def classify(
    docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """One row per document: id, key (half of the text's SHA-256), lang, n_symbols, perplexity, threshold, keep."""
    unseen = F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(5)) == 0
    scored = perplexities(docs, trusted.where(~unseen), id, text, lang, folded=False)
    known = trusted.where(unseen).select(F.col(id).cast(scored.schema["id"].dataType).alias("id")).distinct()
    good = scored.where("perplexity is not null").join(known, "id", "left_semi")
    cut = F.percentile_approx("perplexity", quantile, 20_000)
    by_lang = stage(good.groupBy("lang").agg(cut.alias("own")))
    if by_lang.count() <= BROADCAST_LANGUAGES:
        by_lang = F.broadcast(by_lang)
    overall = good.agg(cut.alias("overall"))
    out = scored.join(by_lang, "lang", "left").join(F.broadcast(overall))
    threshold = F.coalesce("own", "overall")
    return out.select(
        F.col("id").alias(id), "key", "lang", "n_symbols", "perplexity", threshold.alias("threshold"),
        (F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.coalesce(threshold, F.lit(float("inf"))))).alias("keep"),
    )


def labelled_good(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    return labels.where(F.col("quality") == 1).select(id)


def is_held_out(id: Column) -> Column:
    """Whether a row may not be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
