import numpy as np
import pytest
import xxhash

from regmesh.llm import maglev


def brute_fill(shards, slots):
    import zlib

    table = [None] * slots
    prefs = [[(zlib.crc32(s.encode()) % slots + k * (zlib.crc32(b"skip:" + s.encode()) % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
    while None in table:
        for i, p in enumerate(prefs):
            slot = next((x for x in p if table[x] is None), None)
            if slot is not None:
                table[slot] = i
    return table


def test_fill_matches_turn_taking():
    names = [f"s{i}" for i in range(7)]
    assert maglev.fill(names, 101).tolist() == brute_fill(names, 101)


def test_shares_even_and_few_moves():
    names = [f"s{i}" for i in range(32)]
    a, b = maglev.fill(names, 4099), maglev.fill(names[:-1], 4099)
    assert np.ptp(np.bincount(a)) <= 1
    stay = a != 31
    assert (a[stay] != b[stay]).mean() < 0.1
    with pytest.raises(ValueError):
        maglev.fill(names, 4096)


def test_rows(spark):
    names = [f"s{i}" for i in range(5)]
    rows = [(1, "x"), (1, "y"), (None, "z"), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, shard string")
    got = maglev.place(df, ["doc_id"], names, 101).collect()
    held = maglev.fill(names, 101)
    assert len(got) == 5 and all(r.shard == names[held[r.slot]] for r in got)
    for r in got:
        want = 42 if r.doc_id is None else xxhash.xxh64_intdigest(int(r.doc_id).to_bytes(8, "little", signed=True), 42)
        want = want - (1 << 64) if want >> 63 else want
        assert r.slot == want % 101
    assert maglev.place(df.limit(0), ["doc_id"], names, 101).count() == 0
