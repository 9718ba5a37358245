import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from regmesh.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 96), st.integers(1, 9), max_size=40))
def test_plan_is_a_gapless_packing(histogram):
    rows, sequences = packing.plan(histogram, 96)
    seen, bins = defaultdict(list), defaultdict(list)
    for size, rank, n, first, each, offset in rows:
        for k in range(n):
            seen[size].append(rank + k)
            bins[first + k // each].append((offset + k % each * size, size))
    assert {s: sorted(v) for s, v in seen.items()} == {s: list(range(n)) for s, n in histogram.items()}
    assert set(bins) == set(range(sequences))
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= 96
    total = sum(s * n for s, n in histogram.items())
    assert sequences <= max(1, 1.7 * total / 96 + 1) if total else sequences == 0


def test_ids_match_the_tokenizer(spark, tiny_dir):
    tok = Tokenizer.from_file(PATH)
    texts = [r.text for r in spark.read.parquet(f"{tiny_dir}/documents.parquet").collect()]
    texts += ["", "It's 2024!'s  don't\x0bwe'll x", "é İ ΣΣ 中文", "a<|endoftext|>b", "×÷ ßxÀÿ_", "'S 'T's" * 3, "x" * 3000, "\x1c a\x85b ​"]
    got = packing.encode(texts, PATH)
    for t, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t[:60]


@pytest.mark.parametrize("per_bucket", [3, 512])
def test_rows_pack(spark, tiny_dir, per_bucket):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    rows = [(1, None), (1, None), (None, ""), (7, "a b c"), (7, "a b c")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = packing.pack(docs, PATH, per_bucket=per_bucket).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
        assert r.start == 4096 * r.piece
    for held in by.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= 4096
    tok = Tokenizer.from_file(PATH)
    want = sorted(((r.doc_id is None, r.doc_id, k), zlib.crc32(np.array(ids[k * 4096 : (k + 1) * 4096], "<u4").tobytes())) for r in docs.collect() for ids in [[*tok.encode(r.text or "", add_special_tokens=False).ids, 1]] for k in range(-(-len(ids) // 4096)))
    assert sorted((((r.doc_id is None), r.doc_id, r.piece), r.ids_crc32) for r in got) == want
    assert len(by) <= 1.02 * sum(r.length for r in got) / 4096 + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0
