import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, bucket int, shard int, label string, row int, copies int"


def sentence(random, words, n):
    return " ".join(random.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, shared passages."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)] + ["Ärger", "l'été", "señor"]
    passage = sentence(r, words, 120)
    base = sentence(r, words, 150).split()
    near = base[:70] + ["changed"] + base[71:]
    texts = [sentence(r, words, r.randint(5, 200)) for _ in range(25)]
    texts += [f"{sentence(r, words, 30)}\n{passage}\n{sentence(r, words, 30)}" for _ in range(4)]
    texts += [" ".join(base), " ".join(near), " ".join(base), texts[0], texts[0]]
    texts += [None, None, "", "", "!!! ... ***", "one two", "one two", "a" * 3000, "ab" * 900 + "x", "\n\n\n", "12 34 56"]
    texts += ["x y z\n" * 300, sentence(r, words, 6000), "é" * 500]
    rows = [(k, t, ("en", "fr", None)[k % 3], f"src{k % 2}") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], "en", None), (None, None, None, None), (None, f"{sentence(r, words, 40)} {passage}", "en", None), (7, "other text of the same id " * 20, "fr", "src1")]
    return [(*x, len(x[1] or ""), 1, "k", 2, 3, "l", 4, 5) for x in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, COLUMNS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small_docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
