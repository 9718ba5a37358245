from collections import defaultdict

from pyspark.sql import functions as F
from test_decontaminate import brute_pairs
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline as cp
from regmesh.llm import pii, quality_classifier


def test_stages_match_brute_force(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").withColumn("extra", F.lit(1))
    labels = spark.read.parquet(f"{tiny_dir}/labels.parquet")
    first = cp.quality(spark, docs, tiny_dir).cache()
    want = {r.doc_id for r in quality_classifier.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in first.collect()} == want and first.columns == docs.columns

    second = cp.near_duplicates(spark, first, tiny_dir).cache()
    rows = sorted((r.doc_id, r.text) for r in first.collect())
    groups = brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(groups)) and second.columns == docs.columns

    third = cp.leaks(spark, second, tiny_dir).cache()
    bench = [tuple(r) for r in spark.read.parquet(f"{tiny_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in second.collect()]
    leaky = {d for d, _ in brute_pairs(rows, bench, 0.5)}
    assert {r.doc_id for r in third.collect()} == {d for d, _ in rows} - leaky and third.columns == docs.columns

    fourth = cp.personal_data(spark, third, tiny_dir).cache()
    texts = {r.doc_id: r.text for r in third.collect()}
    assert fourth.columns == docs.columns
    for r in fourth.collect():
        assert r.text == pii.mask(texts[r.doc_id], pii.train()) and r.n_chars == len(r.text)

    held = defaultdict(int)
    for r in cp.pack(spark, fourth, tiny_dir).collect():
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 4096


def test_run_on_the_small_table(spark, tiny_dir):
    assert cp.run(spark, tiny_dir).count() > 0


def test_repeated_rows_stay_once(spark, tiny_dir):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, "other words are here in this text"), (None, "alone in the null group of this table")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in cp.near_duplicates(spark, docs, tiny_dir).collect()) == [0, 1, 3, 4]


def test_documents_without_ids_or_with_one_id_stay_by_group(spark, tiny_dir):
    a, b, c, d = ("red green blue black white pink", "how many roads lead to the old town", "a wholly different line of many words", "some more text that no one else wrote")
    rows = [(None, a), (None, a), (None, b), (None, c), (5, c), (6, d), (6, "not at all like the other row of this id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in cp.near_duplicates(spark, docs, tiny_dir).collect()))
    assert got == sorted([(0, a), (0, b), (5, c), (6, d), (6, rows[6][1])])
