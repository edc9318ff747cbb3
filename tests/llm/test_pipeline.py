"""Each stage against a plain version over its own input."""

import os
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from ledgerlens.llm import quality
from tests.llm import brute
from tests.llm.test_exact_operators import check_packing


@pytest.fixture(scope="module")
def inputs(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{folder}/documents.parquet")
    ids = [r.doc_id for r in odd.select("doc_id").distinct().collect() if r.doc_id is not None]
    spark.createDataFrame([(i, int(i % 7 != 3), 0) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    text = odd.where("doc_id = 8").first().text
    spark.createDataFrame([(1, " ".join(text.split()[:12]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_keep_what_plain_versions_keep(spark, odd, inputs, tmp_path):
    columns = odd.columns
    docs = odd
    before = rows_of(docs)
    text = columns.index("text")

    def written(number):
        name, apply = pipeline.STAGES[number]
        path = str(tmp_path / name)
        apply(spark, docs, inputs).write.parquet(path)
        return spark.read.parquet(path)

    labels = spark.read.parquet(f"{inputs}/labels.parquet")
    kept = Counter((r.doc_id, r.key) for r in quality.classify(docs, quality.labelled_good(labels)).where("keep").collect())
    docs = written(0)
    assert docs.columns == columns and docs.count() == sum(kept.values()) < len(before)

    before = rows_of(docs)
    # By place, as several classes can share their lowest id.
    lowest = {}
    for (d, *_), c in zip(before, brute.near_classes(list(range(len(before))), [r[text] for r in before])):
        lowest[c] = min((x for x in (lowest.get(c), d) if x is not None), default=None)
    docs = written(1)
    after = rows_of(docs)
    assert Counter(r[0] for r in after) == Counter(lowest.values()) and not Counter(after) - Counter(before)

    before = rows_of(docs)
    docs = written(2)
    want = brute.removals([r[text] for r in before], pipeline.REPEAT)
    got = {(r[0], r[1]): r for r in rows_of(docs.select("doc_id", "n_chars", "text"))}
    assert docs.columns == columns and docs.count() == len(before)
    assert Counter(n - gone for n, gone, _, _ in want) == Counter(len((r[2] or "").encode()) for r in got.values())
    assert all(n == len(t) for _, n, t in got.values() if t is not None)

    before = rows_of(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{inputs}/benchmark.parquet").collect()]
    hit = brute.contamination([r[text] for r in before], items)
    docs = written(3)
    assert Counter(rows_of(docs)) == Counter(r for r, h in zip(before, hit) if not h[1])

    sizes = Counter()
    for r in rows_of(docs):
        sizes[r[0]] += len((r[text] or "").encode())
    check_packing(pipeline.STAGES[4][1](spark, docs, inputs).collect(), sizes, (512, 1024, 2048, 4096, 8192))


def test_run_applies_the_stages_in_order(spark, folder):
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["quality", "near_dups", "suffix_dedup", "decontaminate", "packing"]
    out = pipeline.run(spark, folder)
    assert out.where("bin is not null").count() > 50 and out.agg(F.sum("n_tokens")).first()[0] > 0


def test_columns_of_any_name_travel_along(spark, odd, inputs):
    extra = odd.select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(["row", "key", "id", "n", "wanted_id", "__key", "a.b", "kept", "lang", "source"])))
    docs = extra
    for _, apply in pipeline.STAGES[:-1]:
        out = apply(spark, docs, inputs)
        assert out.columns == extra.columns
        docs = spark.createDataFrame(out.collect(), extra.schema)
    assert {tuple(r)[2:] for r in docs.collect()} == {tuple(range(10))}
    assert pipeline.STAGES[-1][1](spark, docs, inputs).count() >= docs.count()


def test_empty_documents(spark, empty, inputs):
    docs = empty
    for _, apply in pipeline.STAGES:
        docs = apply(spark, docs, inputs)
        assert docs.count() == 0
    assert os.path.isdir(inputs)


@pytest.mark.parametrize("number", range(4))
def test_texts_reach_workers_in_small_batches(spark, empty, inputs, number):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([len(batch)])], ["size", "n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(key)
    texts = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    try:
        spark.conf.unset(key)
        pipeline.STAGES[number][1](spark, empty, inputs).count()
        found = texts.mapInArrow(sizes, "size long, n long").collect()
        assert sum(r.n for r in found) == 3000 and max(r["size"] for r in found) < 5_000_000
        spark.conf.set(key, "1m")
        pipeline.STAGES[number][1](spark, empty, inputs)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
