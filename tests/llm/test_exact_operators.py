"""Operators whose results are fixed: against brute force, a library or a round trip."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, fingerprints, near_dups, packing, suffix_dedup, token_counts
from ledgerlens.llm.bytes_and_words import text_hashes
from ledgerlens.llm.queries import QUERIES
from ledgerlens.llm.suffix_array import suffix_arrays
from tests.llm import brute


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def texts_of(rows):
    return [r[1] for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAé1 .\n", max_size=30), min_size=1, max_size=6))
def test_words_are_runs_of_the_pattern(texts):
    for text, hashes in zip(texts, text_hashes([t.encode() for t in texts])):
        found = brute.words(text)
        assert len(found) == len(hashes)
        assert len(set(found)) == len(set(hashes.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=24), min_size=1, max_size=5))
def test_suffix_arrays_sort_suffixes(strings):
    strings = [[*s, 0] for s in strings]
    order = suffix_arrays(np.array(sum(strings, [])), np.array([len(s) for s in strings]))
    first = 0
    for s in strings:
        assert (order[first : first + len(s)] - first).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        first += len(s)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_repeats_match_brute_force(which, request, odd_rows, small_docs):
    docs = request.getfixturevalue("odd") if which == "odd" else small_docs
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute.removals(texts_of(rows), 400)))
    assert by_row(suffix_dedup.removals(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_buckets_dealt_to_several_arrays_give_the_same(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PER_ARRAY", 2)
    rows = [(r[0], r[1]) for r in odd_rows]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute.removals(texts_of(rows), 60)))
    got = suffix_dedup.removals(odd, length=60, gram=24)
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 9))
def test_lowest_places(values, width):
    hashes = np.array(values, np.uint64) + np.uint64(2**64 - 5)
    want = [k + values[k : k + width].index(min(values[k : k + width])) for k in range(len(values) - width + 1)]
    assert suffix_dedup.lowest_place(hashes, width).tolist() == want


def test_stretches_and_batches_of_a_text_give_the_same(odd, odd_rows, monkeypatch):
    rng = np.random.default_rng(3)
    data, rows = rng.integers(97, 99, 5000).astype(np.uint8), np.array([0, 10, 4000, 4030, 5000])
    whole = suffix_dedup.segments(data, rows, 60, 24)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 70)
    for a, b in zip(whole, suffix_dedup.segments(data, rows, 60, 24)):
        assert a.tolist() == b.tolist()
    monkeypatch.setattr(suffix_dedup, "CUT_BYTES", 500)
    want = Counter((r[0], *x) for r, x in zip(odd_rows, brute.removals(texts_of(odd_rows), 60)))
    assert by_row(suffix_dedup.removals(odd, length=60, gram=24), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_a_text_beyond_16_mb_loses_its_repeats(spark):
    rng = np.random.default_rng(4)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    passage, between = letters(700), letters(17_000_000)
    long = f"1{passage}2{between}3{passage}4"
    other = letters(500)
    docs = spark.createDataFrame([(1, long), (2, f"5{between[16_900_000:16_900_450]}6{other}")], "doc_id long, text string")
    kept = {1: f"12{between[:16_900_000]}{between[16_900_450:]}34", 2: f"56{other}"}
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removals(docs).collect()}
    sha = lambda k: hashlib.sha256(kept[k].encode()).hexdigest()
    assert got == {1: (1850, 3, sha(1)), 2: (450, 1, sha(2))}


@pytest.mark.parametrize("per_array", [24, 2])
def test_passages_shorter_than_a_window_are_reported_and_stay(spark, odd, odd_rows, per_array, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PER_ARRAY", per_array)
    r = random.Random(9)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    short, long, twin = letters(55), letters(90), letters(50)
    # A short passage alone, beside a long one, shared with a document that loses bytes, and in the same document twice.
    texts = [letters(80) + short + letters(80), letters(30) + short, letters(40) + long + letters(20) + short, long + letters(60)]
    texts += [short + letters(70) + short + letters(9), twin, twin, letters(10) + twin, letters(300), letters(39)]
    rows = [(r[0], r[1]) for r in odd_rows] + [(1000 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lost, shorter = brute.removals(texts_of(rows), 60), brute.removals(texts_of(rows), 40)
    want = Counter((d, *x, x[0] - x[1], x[1] or y[1]) for (d, _), x, y in zip(rows, lost, shorter))
    got = suffix_dedup.removals(docs, length=60, gram=24, passage=40)
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "n_repeated") == want
    assert sum(not x[1] and y[1] > 0 for x, y in zip(lost, shorter)) > 5


def test_query_reports_passages_of_over_50_words(spark, tmp_path):
    r = random.Random(11)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n))
    passage = words(56)
    texts = [f"{words(60)} {passage} {words(60)}", f"{words(30)} {passage}", words(200), words(56), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in QUERIES["op9_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert 250 <= len(passage) < 400
    assert [got[k].n_repeated >= len(passage) for k in range(5)] == [True, True, False, False, False]
    assert [got[k].n_repeated for k in (2, 3, 4)] == [0, 0, 0]
    assert all(x.n_removed == 0 and x.n_kept == x.n_bytes and not x.changed for x in got.values())


def test_text_form_of_repeat_removal_keeps_rows_and_columns(odd):
    out = suffix_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text is null").count() == odd.where("text is null").count()


@pytest.mark.parametrize("which", ["odd", "small"])
def test_contamination_matches_brute_force(spark, which, request, odd_rows, small_docs, folder):
    if which == "odd":
        docs = request.getfixturevalue("odd")
        texts = [r[1] for r in odd_rows if r[1]]
        items = [(1, " ".join(texts[2].split()[:25])), (2, "one TWO"), (2, None), (3, ""), (4, "x y z"), (None, texts[1]), (5, "absent words here")]
        bench = spark.createDataFrame(items, "item_id int, text string")
        items = [("" if i is None else i, t) for i, t in items]
    else:
        docs, bench = small_docs, spark.read.parquet(f"{folder}/benchmark.parquet")
        items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute.contamination(texts_of(rows), items)))
    got = decontaminate.contamination(docs, bench)
    got = got.select("doc_id", "n_words", "n_hit", F.size("item_ids").alias("n"), F.sha2(F.array_join("item_ids", ","), 256).alias("sha"))
    assert by_row(got, "doc_id", "n_words", "n_hit", "n", "sha") == want
    assert any(k[2] for k in want)


def test_items_in_several_blocks_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 3)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 2)
    words = [f"w{k}" for k in range(40)]
    loose = words[:5] + ["extra"] + words[5:20]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(loose[:11])), (3, "w1 w3 w5")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(words[:15])), ("b", " ".join(words[20:38]))], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, slop=1).collect()}
    assert got[1].item_ids == ["a", "b"] and got[1].n_hit == 15 + 18
    assert got[2].item_ids == [] and got[2].near_ids == ["a"] and got[3].near_ids == []


def test_token_counts_equal_the_library(odd, small_docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    merges = token_counts.load_merges(P.path("byte_bpe_50k.json"), P.PATTERN)
    for docs in (odd, small_docs):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = Counter((d, len(t.encode()), len(library.encode(t, add_special_tokens=False))) for d, t in rows)
        assert by_row(token_counts.token_counts(docs, merges), "doc_id", "n_bytes", "n_tokens") == want


def test_special_strings_and_odd_characters_are_counted_as_the_library_does():
    P = pytest.importorskip("public_tokenizers")
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    merges = token_counts.load_merges(P.path("byte_bpe_50k.json"), P.PATTERN)
    texts = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "aaaa" * 500, "\x85\x1c ᠎  x  \n\n y", "it's we'LL ’s", "".join(map(chr, range(1, 0x3000)))]
    special = regex.compile("|".join(map(regex.escape, merges.special)))
    got = token_counts.count_tokens(texts, merges, regex.compile(merges.pattern).findall, special)
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_fingerprints_of_documents_their_edits_and_the_next(odd, odd_rows):
    rows = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    # Null ids are last; their order is by text, null texts first.
    nulls = [r for r in odd_rows if r[0] is None]
    rows = [r for r in rows if r[0] is not None] + sorted(((None, r[1] or "") for r in nulls), key=lambda r: r[1])
    for k, (d, t) in enumerate(rows):
        changed = fingerprints.edited(t, rows[(k + 1) % len(rows)][1])
        want[d, len(t), hashlib.sha256(changed.encode()).hexdigest()] += 1
    got = fingerprints.compare_with_edits(odd)
    assert by_row(got, "doc_id", "n_chars", "edited_sha256") == want
    trees = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert trees[29].fingerprint == trees[31].fingerprint and trees[30].fingerprint != trees[29].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in trees.values())


def test_differing_branches_locate_an_edit():
    lines = [f"line {k} with a few words of its own number {k * 7919}" for k in range(60)]
    a = fingerprints.trees(["\n".join(lines).encode()])[0]
    lines[41] = "line 41 was edited"
    b = fingerprints.trees(["\n".join(lines).encode()])[0]
    places = fingerprints.differing(a, b)
    sections = [s.split(",") for s in b.partition("|")[2].split(";")]
    assert len(places) == 1
    assert sum(len(s) for s in sections[: places[0][0]]) + places[0][1] == 41
    assert fingerprints.differing(a, a) == [] and 0.9 < fingerprints.likeness(a, b) < 1


def test_classes_match_brute_force(odd, small_docs):
    for docs in (odd.where("doc_id is not null"), small_docs):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = Counter(zip([r[0] for r in rows], brute.near_classes([r[0] for r in rows], [r[1] for r in rows])))
        assert by_row(near_dups.classes(docs), "doc_id", "class_id") == want


def test_a_chain_of_near_copies_is_one_class_whoever_leads(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = []
    for k in range(60):  # each differs from the first in four places, from each other in eight
        copy = list(base)
        for at in r.sample(range(400), 6 if k else 0):
            copy[at] = f"x{k}"
        rows.append((k, " ".join(copy)))
    rows += [(100 + k, " ".join(f"z{r.randrange(10**6)}" for _ in range(50))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(zip([x[0] for x in rows], brute.near_classes([x[0] for x in rows], [x[1] for x in rows])))
    assert by_row(near_dups.classes(docs), "doc_id", "class_id") == want


def test_dart_signatures_estimate_weighted_similarity():
    random = np.random.default_rng(2)
    n, k = 200, 2000
    for weights in (np.ones((2, n)), random.integers(1, 9, (2, n)).astype(float)):
        shared = random.random(n) < 0.7
        weights[1, shared] = weights[0, shared]
        names = near_dups.mix(np.arange(2 * n, dtype=np.uint64))
        b = np.where(shared, np.arange(n), np.arange(n, 2 * n))
        text = np.repeat([0, 1], n)
        s = near_dups.dart_signatures(text, np.concatenate([names[:n], names[b]]), weights.ravel(), 2, k)
        both = np.minimum(weights[0], weights[1])[shared].sum()
        want = both / (weights.sum() - both)
        assert abs((s[0] == s[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)
        assert np.isfinite(s).all()


def test_weighted_signatures_do_not_depend_on_the_other_texts_of_a_piece():
    names = near_dups.mix(np.arange(60, dtype=np.uint64))
    light, heavy = np.full(30, 3.0), np.full(30, 9.0)
    alone = near_dups.dart_signatures(np.zeros(30, int), names[:30], light, 1, 500)
    beside = near_dups.dart_signatures(np.repeat([0, 1], 30), names, np.concatenate([light, heavy]), 2, 500)
    assert np.array_equal(alone[0], beside[0])


def check_packing(rows, sizes, lengths):
    """Every token once, no overlap, no bin beyond the cheapest length that holds it."""
    bins, seen = defaultdict(list), Counter()
    for r in rows:
        if r.bin is None:
            assert r.n_tokens == 0
            seen[r.doc_id] += 0
            continue
        bins[r.bin].append(r)
        seen[r.doc_id] += r.n_tokens
    assert seen == sizes
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.place):
            assert r.place == at
            at += r.n_tokens
        assert at == pieces[0].bin_tokens and pieces[0].capacity == min(c for c in lengths if c >= at)


@pytest.mark.parametrize("members", [800, 15])
def test_strays_among_many_near_copies_lose_no_link(spark, members, monkeypatch):
    monkeypatch.setattr(near_dups, "MEMBERS", members)
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    base = [r.choice(words) for _ in range(120)]
    rows = []
    for k in range(90):
        text = list(base)
        text[r.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(text)))
    # Strays of about 0.7, and pairs of them that are near each other.
    for k in range(12):
        text = base[:102] + [r.choice(words) for _ in range(18)]
        rows += [(100 + 2 * k, " ".join(text)), (101 + 2 * k, " ".join([*text[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.class_id for x in near_dups.classes(docs).collect()}
    ids, texts = zip(*rows)
    assert [got[i] for i in ids] == brute.near_classes(ids, texts)


def plain_pack(rows, lengths, block, cost):
    """Bins of (id, size) rows by loops over open bins; blocks as the operator deals them."""
    out = []
    for number in sorted({b for *_, b in rows}):
        pieces = []
        for k, (i, size, _) in enumerate(sorted((r for r in rows if r[2] == number), key=lambda r: (-r[1], r[0] is not None, r[0] or 0))):
            pieces += [(k, i, p, min(size - p, max(lengths))) for p in range(0, size, max(lengths))]
        left, bins = sum(p[3] for p in pieces), []
        for k, i, start, size in sorted(pieces, key=lambda p: -p[3]):
            open_ = [b for b in bins if b["room"] >= size]
            if open_:
                least = min(b["room"] for b in open_)
                chosen = [b for b in open_ if b["room"] == least][-1]
            else:
                length = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / min(c, left), c))
                chosen = {"room": length, "held": []}
                bins.append(chosen)
            chosen["held"].append((i, start, size))
            chosen["room"] -= size
            # A bin that changed comes after those that had its room before.
            bins.remove(chosen)
            bins.append(chosen)
            left -= size
        out += [tuple(sorted(b["held"], key=str)) for b in bins]
    return Counter(out)


@pytest.mark.parametrize("block", [8_000, 12])
def test_packing_matches_a_plain_version_in_any_layout(spark, block, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", block)
    r = random.Random(2)
    rows = [(k, r.randint(0, 300)) for k in range(60)] + [(None, 50)] * 7 + [(3, 40)] * 5
    lengths = (64, 128, 256)
    results = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, size long").repartition(parts)
        got = packing.best_fit(docs, F.col("size"), lengths).collect()
        bins = defaultdict(list)
        for x in got:
            if x.bin is not None:
                bins[x.bin].append((x.doc_id, x.start, x.n_tokens))
        results.append(Counter(tuple(sorted(b, key=str)) for b in bins.values()))
        blocks = {x.bin.split("-")[0] for x in got if x.bin}
        assert len(blocks) <= -(-len(rows) // block)
    assert results[0] == results[1]
    if block == 8_000:
        assert results[0] == plain_pack([(i, n, 0) for i, n in rows], lengths, block, packing.linear_cost)


def test_packing_is_a_partition_of_all_tokens(odd, odd_rows):
    sizes = Counter()
    for r in odd_rows:
        sizes[r[0]] += len((r[1] or "").encode())
    rows = packing.best_fit(odd, F.octet_length("text"), lengths=(64, 128, 512, 2048)).collect()
    check_packing(rows, sizes, (64, 128, 512, 2048))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_best_fit_bins(sizes):
    lengths = (8, 16, 64)
    bins, places, filled, final = packing.pack(np.array(sizes), lengths, packing.linear_cost)
    content = np.bincount(bins, weights=sizes)
    assert content.tolist() == filled and all(f <= c and c in lengths for f, c in zip(filled, final))
    assert len(filled) <= len(sizes)


def test_empty_tables(spark, empty):
    P = pytest.importorskip("public_tokenizers")
    bench = spark.createDataFrame([], "item_id int, text string")
    assert packing.best_fit(empty, F.octet_length("text")).count() == 0
    assert suffix_dedup.removals(empty).count() == 0
    assert near_dups.classes(empty).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert fingerprints.compare_with_edits(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0
    merges = token_counts.load_merges(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert token_counts.token_counts(empty, merges).count() == 0
