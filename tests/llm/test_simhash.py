import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from regmesh.llm import simhash
from regmesh.llm.common import Scratch
from regmesh.llm.golay import nearby, nearest


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    prints = np.array(prints, np.uint64)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [min(ids[j] for j in range(len(ids)) if root(j) == root(i)) for i in range(len(ids))]


def test_golay_neighbours_share_a_codeword():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 20_000)
    y = x ^ (1 << rng.integers(0, 23, len(x)))
    assert (nearby(x) == nearest(y)[:, None]).any(axis=1).all()
    assert (np.bitwise_count(x ^ 0) >= 0).all()


def test_keys_lose_no_link_within_four_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**63), 2**63 - 1, 3000)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in x]
    y = np.array([int(np.int64(v).view(np.uint64)) ^ f for v, f in zip(x, flips)], np.uint64).view(np.int64)
    kx, sx, ix = simhash.keys(x)
    ky, sy, iy = simhash.keys(y)
    left = {(int(k), int(i)): int(s) for k, s, i in zip(kx, sx, ix)}
    found = {int(i) for k, s, i in zip(ky, sy, iy) if (int(k), int(i)) in left and (k >> 56 < 3 or left[int(k), int(i)] != s)}
    assert found == set(range(len(x)))


def test_matches_brute_force_on_the_small_table(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").withColumn("fp", F.lit(1)).withColumn("key", F.lit("x"))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    rows = sorted(docs.select("doc_id", "text").collect())
    prints = [brute_fingerprint(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints)
    assert [int(got[r.doc_id].fingerprint, 16) for r in rows] == prints
    assert [got[r.doc_id].component_id for r in rows] == want


def test_edges_nulls_and_repeats(spark):
    rows = [(1, "A b c d e"), (2, "a B c d e"), (2, "a B c d e"), (3, None), (4, " \t\n"), (None, "a b c d e"), (5, "one"), (6, "x " * 30_000)]
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    ids = {r.doc_id: r.component_id for r in got}
    assert len(got) == 8 and ids[1] == ids[2] == ids[None] == 1 and ids[3] == ids[4] == 3 and ids[5] == 5
    assert next(r for r in got if r.doc_id == 3).fingerprint == "0" * 16
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [50, 10_000])
def test_chains_and_hot_keys(spark, hot):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**63))
    prints = {centre ^ (1 << a) ^ (1 << b) for a in range(63) for b in range(a)} | {int(x) for x in rng.integers(0, 2**63, 500)}
    walk = int(rng.integers(0, 2**63))
    for b in rng.permutation(63)[:40]:
        walk ^= 1 << int(b)
        prints.add(walk)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    scratch = Scratch(spark, "test")
    edges = simhash.links(df, scratch, hot=hot, block=40)
    got = {r.node: r.root for r in simhash.connected_components(edges, scratch).collect()}
    want = brute_components(prints, prints)
    assert [got.get(p, p) for p in prints] == want


@pytest.mark.parametrize("share", [1, 4, 10**6])
def test_groups_reach_hot_and_other_fingerprints_alike(spark, share):
    rows = [(i, "the hot text that a third of all rows hold") for i in range(40)] + [(100 + i, f"text number {i} of its own kind {i * i}") for i in range(60)] + [(None, None)] * 20
    scratch = Scratch(spark, "test")
    prints = scratch.cut(simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash._grouped(prints, scratch, share).collect())
    ids = [i for i, _ in rows if i is not None]
    want = brute_components(ids, [brute_fingerprint(t) for i, t in rows if i is not None])
    assert got == sorted([(str(i), str(c)) for i, c in zip(ids, want)] + [("None", "None")] * 20)


def test_no_task_joins_a_hot_fingerprint(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "one text that is copied very often").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" a b c d"))).alias("text"))
    scratch = Scratch(spark, "test")
    prints = scratch.cut(simhash.fingerprints(rows.withColumnRenamed("id", "doc_id")))
    plan = simhash._grouped(prints, scratch)._jdf.queryExecution().toString()
    assert "Union" in plan and "BroadcastHashJoin" in plan
