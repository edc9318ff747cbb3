"""Operators that learn: against plain restatements, and on held-out rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language, quality, toxicity, url_filter
from ledgerlens.llm.bytes_and_words import hashed_range, mix, text_hashes
from tests.llm import brute

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


# --- quality -------------------------------------------------------------------


def plain_kneser_ney(texts, trusted, order=5):
    """Perplexity of each text under a model of the trusted ones, by dictionaries."""
    table = quality.symbol_table()
    symbols = [bytes(table[b] for b in (t or "").encode()) for t in texts]
    pad = bytes([quality.SPACE]) * (order - 1)
    grams = lambda s: [(pad + s)[i : i + order] for i in range(len(s))]
    counts = {order: Counter(g for s, t in zip(symbols, trusted) if t for g in grams(s))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {}
    for k, c in counts.items():
        n = Counter(c.values())
        off[k] = quality.discounts(*(float(n[i]) for i in range(1, 5)))
    total, held = defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            total[k, g[:-1]] += n
            held[k, g[:-1]] += off[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 32
        below, context = p(g[1:]), (k, g[:-1])
        if not total[context]:
            return below
        n = counts[k][g]
        return (n - (off[k][min(n, 3) - 1] if n else 0) + held[context] * below) / total[context]

    return [math.exp(-sum(math.log(p(g)) for g in grams(s)) / len(s)) if s else None for s in symbols]


def test_perplexities_match_a_plain_model(spark, odd, odd_rows):
    trusted_ids = set(range(0, 30, 2))
    trusted = spark.createDataFrame([(i,) for i in trusted_ids] * 2, "doc_id long")
    got = quality.perplexities(odd, trusted).collect()
    want = plain_kneser_ney([r[1] for r in odd_rows], [r[0] in trusted_ids for r in odd_rows])
    key = lambda d, l, p: (d is None, d or 0, l, -1 if p is None else round(math.log(p), 4))
    assert sorted(key(r.id, r.lang, r.perplexity) for r in got) == sorted(key(r[0], r[2] or "und", p) for r, p in zip(odd_rows, want))


def test_several_shards_give_the_same(spark, odd, monkeypatch):
    trusted = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "doc_id long")
    rows = lambda: sorted((str(r.id), r.lang, r.n_symbols, None if r.perplexity is None else round(r.perplexity, 5)) for r in quality.perplexities(odd, trusted).collect())
    one = rows()
    monkeypatch.setattr(quality, "SHARD_BYTES", 5000)
    assert str(rows()) == str(one)


def test_probabilities_of_a_context_add_up(spark):
    texts = ["abab abba baab", "abba abab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    # All n-grams of one context, by texts that hold them.
    probe = [f"abab{chr(c)}" for c in range(97, 123)] + ["ababA", "abab ", "abab.", "abab1", "abab#", "ababé"]
    both = docs.unionByName(spark.createDataFrame([(9 + k, t) for k, t in enumerate(probe)], "doc_id long, text string").withColumn("lang", F.lit("en")))
    rows = both.select(F.col("doc_id").alias("id"), "text")
    symbols = quality.symbol_table()
    code = {int(quality.codes(symbols[np.frombuffer(t.encode()[:5], np.uint8)], [5])[-1]) for t in probe}
    assert rows.count() == 34 and len(code) == 32
    counted = []
    for t, trusted in [(t, 1) for t in texts] + [(t, 0) for t in probe]:
        s = symbols[np.frombuffer(t.encode(), np.uint8)]
        counted += [(0, int(c), trusted) for c in quality.codes(s, [len(s)])]
    table = spark.createDataFrame(counted, "shard int, code int, n long")
    p = {r.code: r.p for r in quality.probabilities(table).collect()}
    assert sum(p[c] for c in code) == pytest.approx(1.0, abs=1e-9)


def test_junk_is_rejected_and_clean_text_kept(spark, small_docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.classify(small_docs, quality.labelled_good(labels)).join(labels, "doc_id")
    good = got.where("quality = 1").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    bad = got.where("quality = 0").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    assert good > 0.95 and bad < 0.4


def test_threshold_is_the_quantile_and_one_wrong_label_does_not_set_it(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(800)]
    junk = ["".join(r.choice("qwxyzjkv#+<> ") for _ in range(300)) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts + junk)], "doc_id long, text string, lang string").cache()
    unseen = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(5)) == 0
    wrong = docs.where(unseen & (F.col("doc_id") >= 800)).select(F.min("doc_id")).first()[0]
    trusted = docs.where((F.col("doc_id") < 800) | (F.col("doc_id") == wrong)).select("doc_id")
    got = quality.classify(docs, trusted)
    known = sorted(x.perplexity for x in got.join(trusted.where(unseen), "doc_id").collect())
    rows = got.collect()
    assert {x.threshold for x in rows} == {known[math.ceil(0.99 * len(known)) - 1]}
    assert not any(x.keep for x in rows if x.doc_id >= 800)
    assert sum(x.keep for x in rows if x.doc_id < 800) > 0.97 * 800


def test_characters_of_any_script_are_told_apart(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(60)]
    clean = [" ".join(r.choice(words) for _ in range(60)) for _ in range(300)]
    junk = [" ".join("".join(r.choice("abcdefgh") for _ in w) for w in t.split()) for t in clean[:30]]
    other = {ord(a): b for a, b in zip("abcdefgh", "бвгд漢字ñ𝒜")}
    frame = lambda texts: spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = spark.range(300).toDF("doc_id")
    here = quality.perplexities(frame(clean + junk), trusted, folded=False).collect()
    there = quality.perplexities(frame([t.translate(other) for t in clean + junk]), trusted, folded=False).collect()
    assert {x.id: (x.n_symbols, round(x.perplexity, 5)) for x in here} == {x.id: (x.n_symbols, round(x.perplexity, 5)) for x in there}
    got = quality.classify(frame([t.translate(other) for t in clean + junk]), trusted).collect()
    assert not any(x.keep for x in got if x.doc_id >= 300)
    assert sum(x.keep for x in got if x.doc_id < 300) > 0.95 * 300


def test_quality_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long")
    got = quality.classify(odd, none).collect()
    assert len(got) == odd.count()
    assert all(r.keep == (r.n_symbols > 0) for r in got)
    assert quality.classify(empty, none).count() == 0


# --- toxicity ------------------------------------------------------------------


def toxic_texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows = []
    for k in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 120))]
        bad = k % 3 == 0
        if bad:
            for _ in range(max(1, len(text) // 25)):
                text.insert(r.randrange(len(text)), r.choice(("grumblok", "zwackig", "fibberdunk")))
        rows.append((k, " ".join(text), int(bad)))
    return rows


def test_toxic_words_and_their_misspellings_are_found(spark):
    rows = toxic_texts(300, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic").where("doc_id < 200"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(scores[d], y) for d, _, y in rows if d >= 200]
    bad, good = ([s for s, y in held if y == side] for side in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.9
    base = next(t for d, t, y in rows if d >= 200 and not y)
    spelled = spark.createDataFrame([(0, base + " grumblokk zwackigg"), (1, base)], "doc_id long, text string")
    near = {r.doc_id: r.score for r in toxicity.score(spelled, model).collect()}
    assert near[0] > 2 * near[1]


def plain_toxicity(model, text):
    """Score of a text by loops over its words, their subwords and its windows."""
    factors = [int(f) | 1 for f in hashed_range(5, 41)]
    hashed = lambda v: int(mix(np.array([v % 2**64], np.uint64))[0]) % toxicity.TABLE
    values = []
    for word in brute.words(text):
        marked = [0, *(b + 1 for b in word), 0]
        rows = [int(text_hashes([word])[0][0]) % toxicity.TABLE]
        for n in (3, 4, 5):
            rows += [hashed(n + sum(marked[i + k] * factors[k] for k in range(n))) for i in range(len(marked) - n + 1)]
        values.append(sum(float(model["scores"][r]) for r in rows) / len(rows))
    n, size = len(values), toxicity.WINDOW
    starts = [k for k in range(0, n - size, toxicity.STEP)] + [max(n - size, 0)]
    worst = max(sum(values[s : s + size]) / max(min(size, n), 1) for s in starts) + model["bias"]
    return 1 / (1 + math.exp(-max(min(model["slope"] * worst + model["shift"], 30), -30)))


def test_toxicity_scores_match_a_plain_version(spark, odd, odd_rows):
    rows = toxic_texts(120, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    texts = [r[1] for r in rows[:40]] + [r[1] for r in odd_rows if len(r[1] or "") < 3000] + ["Long " * 2000]
    many = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in toxicity.score(many, model).collect():
        assert r.score == pytest.approx(plain_toxicity(model, texts[r.doc_id]), abs=1e-9)


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(3, 1), (900, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    for few in (labels.where("toxic = 1"), labels.where("false"), labels.where("doc_id = 900")):
        model = toxicity.fit(odd, few)
        assert {round(r.score, 9) for r in toxicity.score(odd, model).collect()} == {round(model["rate"], 9)}


# --- language ------------------------------------------------------------------


def test_languages_are_told_apart_on_held_out_rows(spark, small_docs):
    model = language.fit(small_docs.where(~quality.is_held_out(F.col("doc_id"))))
    got = language.identify(small_docs, model).join(small_docs.select("doc_id", "lang"), "doc_id").where(quality.is_held_out(F.col("doc_id")))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert set(model["families"]) == {"germanic", "romance"} and len(model["pairs"]) == 2


def plain_votes(model, vector):
    """Language by the largest family margin, then by votes of the pairs; ties by sums of confidence."""
    margin = [float(w[:-1] @ vector + w[-1]) for w in model["matrix"]]
    chance = lambda m: 1 / (1 + np.exp(-4 * m))
    families = model["families"]
    head = len(families) if len(families) > 1 else 0
    family = families[int(np.argmax(margin[:head]))] if head else families[0]
    votes = {n: 0.0 for n in model["names"] if language.family_of(n) == family}
    for (a, b), m in zip(model["pairs"], margin[head:]):
        if a in votes:
            votes[a] += (m > 0) + chance(m) * 1e-3
            votes[b] += (m <= 0) + chance(-m) * 1e-3
    return max(sorted(votes), key=votes.get)


def test_votes_match_a_plain_version(small_docs):
    rows = small_docs.where("lang is not null and text is not null").select("text", "lang").limit(60).collect()
    model = language.train([r.text for r in rows], [r.lang for r in rows])
    data = [r.text.encode() for r in rows] + [b"", b"x", b"der the la"]
    joined = np.frombuffer(b"".join(data), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    got, _ = language.predict(model, joined, starts)
    assert got == [plain_votes(model, v) for v in language.features(joined, starts)]


def test_more_languages_than_any_list_are_all_learned(spark):
    rows = [(k * 10 + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q " * 12 + "xyz " * j, f"l{k:03}") for k in range(250) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model["names"] == sorted({r[2] for r in rows})
    got = language.identify(docs, model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 10:03}" for r in got) > 0.98 * len(rows)


def test_a_row_repeated_very_often_counts_once(spark):
    rows = [(1, "immer wieder", "de")] * 500 + [(2 + k, f"the text {k}", "en") for k in range(20)] + [(40 + k, f"der Satz {k}", "de") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs)["names"] == ["de", "en"]


def test_language_edges(spark, odd, empty):
    for docs in (odd, odd.where("lang = 'en'"), odd.where("lang is null"), empty):
        model = language.fit(docs)
        got = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
        assert {x for _, x, _ in got} <= {"en", "fr", "und"} and all(0 <= s <= 1 for _, _, s in got)
        assert all((x, s) == ("und", 0) for d, x, s in got if d in (34, 35, 36, 37, 38, 43, 44))
    assert language.identify(empty, model).count() == 0


# --- urls ----------------------------------------------------------------------

URLS = [
    "http://a.org/x", "HTTP://A.Example.ORG/es/1?q=/y", "https://example.org/en/12#t", "https://badexample.org/es/1", "http://x.com/fr/",
    "http://x.com/FR/", "http://x.com/de/a", "http://com/de/", "http://x.net", "http://x.net?y", "x.org/y", "", None, "a://b://c/d", "http://org",
    "http://x.com#/de/", "http://example.org/es/", "ftp://ü.org/é", "http://x.org:80/a", "://org/",
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, URLS[0]), (0, URLS[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "gram": F.lit(2), "id": F.lit(3), "row": F.lit(4)})
    got = url_filter.judge(pages, RULES).collect()
    want = Counter()
    for k, u in rows:
        host, path, best = plain_rule(u)
        want[k, host, path, best and best[1]] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    assert all(r.verdict == plain_rule(rows[r.page_id][1])[2][0] for r in got if r.rule and r.page_id)
    assert all(r.verdict in ("allow", "block") and r.score is not None for r in got)


def plain_ratio(train, url, order=2):
    fold = lambda u: "^" * order + "".join(
        "0" if c.isdigit() else c if c in url_filter.ALPHABET[:-2] else "~" for c in (u or "").lower()
    ) + "^"
    models = []
    for side in (True, False):
        n = Counter()
        for u, accepted in train:
            t = fold(u)
            if accepted == side:
                for i in range(order, len(t)):
                    for k in range(order + 1):
                        n[t[i - k : i + 1]] += 1
        models.append(n)

    def p(n, gram):
        if not gram:
            return 1 / len(url_filter.ALPHABET)
        below = p(n, gram[1:])
        after = [v for g, v in n.items() if len(g) == len(gram) and g[:-1] == gram[:-1]]
        return (n[gram] + len(after) * below) / (sum(after) + len(after)) if after else below

    t = fold(url)
    parts = [t[i - order : i + 1] for i in range(order, len(t))]
    return sum(math.log(p(models[0], g)) - math.log(p(models[1], g)) for g in parts) / len(parts)


def test_scores_match_a_plain_markov_model(spark):
    r = random.Random(4)
    urls = [f"http://{r.choice(('news', 'shop', 'spam-win'))}{r.randrange(9)}.example.com/{r.choice('abc')}/{r.randrange(99)}" for _ in range(60)]
    labelled = spark.createDataFrame([(u, "spam" not in u) for u in urls], "url string, accepted boolean")
    pages = spark.createDataFrame(list(enumerate([*URLS, *urls])), "page_id long, url string")
    got = {x.page_id: x for x in url_filter.judge(pages, [], labelled, order=2).collect()}
    held = {x.url for x in labelled.where(url_filter.is_held_out(F.col("url"))).collect()}
    train = sorted({(u, "spam" not in u) for u in urls if u not in held})
    for k, u in enumerate([*URLS, *urls]):
        assert got[k].score == pytest.approx(plain_ratio(train, u), abs=1e-9)
    assert all((got[len(URLS) + k].verdict == "allow") == ("spam" not in u) for k, u in enumerate(urls))


def test_url_edges(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://x.net/a")], "page_id long, url string")
    row = url_filter.judge(one, RULES).first()
    assert (row.score, row.verdict, row.rule) == (0.0, "allow", None)


def test_the_table_of_ngrams_is_no_larger_than_four_places_for_each():
    from ledgerlens.llm.quality import Numbered

    keys, table = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 40_000).astype(np.uint64) * np.uint64(2)), Numbered()
    table.add(keys)
    assert len(table.held) <= 4 * len(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and table.find(keys + np.uint64(1)).max() == -1
