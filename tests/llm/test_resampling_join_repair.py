"""Importance resampling, the n-gram join and conversation repair against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import conversations, importance, ngram_join
from tests.llm import brute

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Importance resampling


def plain_resample(rows, target, runs, buckets):
    def features(text):
        w = brute.words(text)
        return [zlib.crc32(b" ".join(w[k : k + n])) % buckets for n in range(runs[0], runs[1] + 1) for k in range(len(w) - n + 1)]

    found = [features(t) for _, t in rows]
    s, t = Counter(b for f in found for b in f), Counter(b for x in target for b in features(x))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * all_s) / ((s[b] + 1) * all_t))) for f in found for b in f}
    out = []
    for (d, text), f in zip(rows, found):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d, len(brute.words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    long = sorted((-r[4], r[0] is not None, r[0] or 0) for r in out if r[1] >= 20)
    return out, long[: len(long) * 10 // 100]


@pytest.mark.parametrize("runs", [(1, 1), (1, 3), (2, 2)])
def test_resampling_matches_brute_force(spark, odd, runs):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    target = [rows[1][1], None, "", "one two three"]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    got = importance.resample(odd, benchmark, runs, buckets=500).collect()
    want, drawn = plain_resample(rows, target, runs, 500)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, r.doc_id is not None, r.doc_id or 0) for r in ranked] == drawn


def test_long_texts_are_cut_between_words(monkeypatch):
    windows = importance.Windows(1, 3, 997)
    text = ("Wörter and 日本 l'été x" * 40 + " " + "a" * 50 + "!") * 3
    whole = windows.of(text.encode())
    monkeypatch.setattr(importance.stretches, "__defaults__", (16,))
    assert windows.of(text.encode()) == whole
    assert importance.Windows(1, 1, 997).of(text.encode())[0] == len(brute.words(text))


def test_resampling_of_nothing(spark, empty, odd):
    assert importance.resample(empty, odd).collect() == []
    rows = importance.resample(odd, empty).collect()
    assert len(rows) == odd.count()


# N-gram join


def grams(text, run=5):
    w = WHITE.findall(lowered(text))
    return {tuple(w[k : k + run]) for k in range(len(w) - run + 1)} if len(w) >= run else ({tuple(w)} if w else set())


def plain_components(rows, percent=80):
    found = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[root(i)] = min(lowest.get(root(i), d), d)
    return Counter((d, len(f), lowest.get(root(i)) if f else d) for i, ((d, _), f) in enumerate(zip(rows, found)))


def components_of(docs, **options):
    return Counter(tuple(r) for r in ngram_join.components_of(docs, **options).collect())


@pytest.mark.parametrize("which", ["odd", "small"])
def test_join_matches_brute_force(which, request, small_docs):
    docs = request.getfixturevalue("odd") if which == "odd" else small_docs
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert components_of(docs) == plain_components(rows)


@pytest.fixture(scope="module")
def crowd(spark):
    """One large group of near copies, chains of small changes, and strays that share half of a text with it."""
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    base = [words[k] for k in r.integers(0, 300, 90)]
    rows = []
    for k in range(150):
        text = list(base)
        text[int(r.integers(0, 90))] = f"n{k % 40}"
        rows.append((k, " ".join(text)))
    for k in range(30):
        rows.append((200 + k, " ".join(base[:60] + [words[x] for x in r.integers(0, 300, 30)])))
    for k in range(40):
        rows.append((300 + k, " ".join(f"c{x}" for x in range(k * 4, k * 4 + 60))))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows


@pytest.mark.parametrize("part", [1 << 20, 700])
def test_large_groups_split_over_parts_lose_no_link(crowd, part, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", part)
    docs, rows = crowd
    assert components_of(docs) == plain_components(rows)


def test_join_has_other_thresholds(crowd):
    docs, rows = crowd
    assert components_of(docs, percent=50) == plain_components(rows, 50)


def test_join_of_nothing(empty, spark):
    assert ngram_join.components_of(empty).collect() == []
    blank = spark.createDataFrame([(1, None), (1, ""), (None, " \n"), (3, "\t")], "doc_id long, text string")
    assert components_of(blank) == Counter([(1, 0, 1), (1, 0, 1), (None, 0, None), (3, 0, 3)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=14), min_size=2, max_size=14), st.sampled_from([50, 80, 100]), st.integers(0, 3))
def test_trees_connect_what_is_similar(found, percent, visitors):
    members = [np.array(sorted(s), np.uint64) for s in found]
    visits = np.arange(len(found)) >= len(found) - min(visitors, len(found) - 1)
    pairs = ngram_join.connecting_links(members, np.arange(len(found)), visits, percent)
    similar = lambda i, j: 100 * len(found[i] & found[j]) >= percent * len(found[i] | found[j])
    assert all(similar(a, b) for a, b in pairs)
    meet = lambda i, j: visits[i] != visits[j] if visits.any() else True

    def classes(links):
        label = list(range(len(found)))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return [label.index(x) for x in label]

    everything = [(i, j) for i in range(len(found)) for j in range(i) if meet(i, j) and similar(i, j)]
    assert classes(pairs) == classes(everything)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 200), st.integers(0, 5)), min_size=1, max_size=10), st.sampled_from([50, 80, 100]))
def test_bitmaps_let_all_similar_sets_pass(shapes, percent):
    r = np.random.default_rng(len(shapes))
    values = r.integers(0, 2**63, 300).astype(np.uint64)
    found = [np.unique(np.concatenate([values[a : a + n], r.integers(0, 2**63, e).astype(np.uint64)])) for a, n, e in shapes]
    first = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    passed = ngram_join.possible(np.diff(first), ngram_join.parities(np.concatenate(found), first), percent)
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            both = len(np.intersect1d(a, b))
            if i != j and 100 * both >= percent * (len(a) + len(b) - both):
                assert passed[i] and passed[j]


def test_bitmaps_hold_back_sets_that_share_little():
    r = np.random.default_rng(1)
    shared = r.integers(0, 2**63, 60).astype(np.uint64)
    found = [np.unique(np.concatenate([shared, r.integers(0, 2**63, 500).astype(np.uint64)])) for _ in range(50)]
    first = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    assert not ngram_join.possible(np.diff(first), ngram_join.parities(np.concatenate(found), first), 80).any()


# Conversation repair


def plain_repair(turns):
    """Cheapest (cost, audit) by the states of the grammar."""
    after = {"start": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, symbol in after.items():
                if state in best:
                    edit = (best[state][0] + 2, best[state][1] + "I")
                    best[symbol] = min(best.get(symbol, edit), edit)
        return best

    best = inserted({"start": (0, "")})
    for initial, forced, cut in turns:
        new = {}
        for state, (cost, audit) in best.items():
            options = [(state, cost + 3, "D")]
            if not forced:
                same = initial == after[state]
                options.append((after[state], cost + cut + (0 if same else 2), "K" if same else "R"))
                if initial == "s" and state == "start":
                    options.append(("s", cost + cut, "K"))
            for to, c, letter in options:
                new[to] = min(new.get(to, (c, audit + letter)), (c, audit + letter))
        best = inserted(new)
    return min(best[s] for s in ("start", "a") if s in best)


def plain_conversations(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", hashlib.sha256((" " if r[3] is None else r[3]).encode()).digest()))
        own = [(t, " " if role is None else role, " " if text is None else text) for _, t, role, text in own]
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        counts, seen, turns = Counter(), set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = plain_repair(turns)
        lines, left, symbol = [], list(own), "u"
        for letter in audit:
            _, role, text = left.pop(0) if letter != "I" else (None, "", "")
            if letter == "D":
                continue
            name = role if letter == "K" else {"u": "user", "a": "assistant"}[symbol]
            lines.append(f"{name}:{text}")
            if not (letter == "K" and role[:1] == "s"):
                symbol = "a" if symbol == "u" else "u"
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


turn = st.tuples(st.sampled_from(["s", "u", "a", "u", "a", " ", ""]), st.booleans(), st.booleans())


@settings(max_examples=250, deadline=None)
@given(st.lists(turn, max_size=9))
def test_alignment_with_all_lengths_is_cheapest(turns):
    assert conversations.repaired_turns(turns, {}) == plain_repair(turns)


@settings(max_examples=60, deadline=None)
@given(st.lists(turn, min_size=1, max_size=16), st.integers(1, 5))
def test_chained_segments_give_the_same(turns, size):
    was, conversations.SEGMENT = conversations.SEGMENT, size
    try:
        assert conversations.outcome(conversations.run_table(turns)) == plain_repair(turns)
    finally:
        conversations.SEGMENT = was


@pytest.fixture(scope="module")
def talks(spark):
    r = np.random.default_rng(8)
    texts = ["Yes.", "No", "", " \n", "What?", "Fine! ", "Yes.", None, "ok\x0b", "a. b"]
    rows = [(int(c), int(t), ["system", "user", "assistant", "user", "assistant", "tool", None, ""][r.integers(0, 8)], texts[r.integers(0, 10)]) for c in range(40) for t in range(r.integers(1, 9))]
    # One conversation with most of the rows, longer than a partition; null ids and numbers; repeated rows.
    rows += [(99, int(t), ["user", "assistant"][int(t + (r.random() < 0.1)) % 2], f"turn {t}" + ".!? "[r.integers(0, 4)]) for t in range(400)]
    rows += [(None, None, "user", "Hi."), (None, 3, "assistant", "Ho."), (None, 3, "assistant", "Ho."), (7, None, None, None), (7, None, "user", "Null first."), (8, 2**62, "user", "Far."), (8, -(2**62), "user", "Near.")]
    columns = "conv_id long, turn long, role string, text string, digest string, part int, audit string"
    return spark.createDataFrame([(*x, "d", 1, "z") for x in rows], columns).repartition(3), rows


def got_repairs(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("held", [1000, 3])
def test_repairs_match_brute_force(talks, held, monkeypatch):
    monkeypatch.setattr(conversations, "HELD", held)
    df, rows = talks
    assert got_repairs(conversations.repair(df)) == plain_conversations(rows)


def test_damage_then_repair(talks):
    df, rows = talks
    hurt, gone = [], set()
    for conv, number, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if number is None else number}".encode()) % 20
        if kind == 0:
            gone.add(conv)
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        hurt += [(conv, number, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = plain_conversations(hurt)
    nothing = hashlib.sha256(b"").hexdigest()
    want.update((c, 0, 0, 0, 0, 0, 0, "", nothing) for c in gone - {r[0] for r in hurt})
    assert got_repairs(conversations.repair(conversations.damaged(df))) == want


def test_repair_of_nothing(talks):
    df, _ = talks
    assert conversations.repair(df.where("false")).collect() == []
    dropped = conversations.repair(df.where("conv_id = 7").withColumn("dropped", F.lit(True))).collect()
    assert [tuple(r) for r in dropped] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
