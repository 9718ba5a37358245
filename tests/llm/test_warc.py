import gzip
import hashlib
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from regmesh.llm import warc
from regmesh.llm.registry import OP8_SQL

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_matches_sql(spark, tiny_dir):
    got = sorted(tuple(r) for r in warc.round_trip(spark.read.parquet(f"{tiny_dir}/pages.parquet")).collect())
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tiny_dir}/pages.parquet'")
    assert got == sorted(con.sql(OP8_SQL).fetchall())


def test_payload_magic_nulls_and_copies(spark):
    long = "x" * 120
    rows = [
        (5, "http://a/\r\nb", FAKE * 3 + long), (2, None, FAKE), (3, "u", None), (9, "u", long), (4, "u", long), (4, "u", long), (None, "u", long), (6, "u", "short"), (7, "u", "short"), (8, "é", "é" * 60), (10, "u", "a\r\n\r\nb" + "\r\n\r\n" * 40),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(1))
    got = sorted(warc.round_trip(pages).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        html = next(h for p, _, h in rows if p == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_bytes == 120 and r.page_id != 8) == [("4", "response", None)] * 2 + [("9", "revisit", 4), ("None", "revisit", 4)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pointer_jumping_rejects_what_no_chain_reaches():
    rng = np.random.default_rng(0)
    real = np.cumsum(rng.integers(5, 50, 1000)) - 0
    real = np.concatenate([[0], real])
    fake = np.setdiff1d(rng.integers(1, real[-1], 500), real)
    at = np.sort(np.concatenate([real[:-1], fake]))
    after = np.array([real[np.searchsorted(real, a, side="right")] if a in set(real) else a + 3 for a in at])
    assert at[warc.reachable(at, after)].tolist() == real[:-1].tolist()


def test_a_damaged_archive_gives_what_the_chain_reaches(spark, tmp_path):
    one = FAKE.encode()
    (tmp_path / "x.warc").write_bytes(one + b"junk" + one)
    (tmp_path / "y.warc").write_bytes(b"no archive at all")
    (tmp_path / "z.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one * 2))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(one * 3)[:-30])
    (tmp_path / "end.warc").write_bytes(one + one[:-9])
    count = {r.file.rsplit("/", 1)[1]: r.n for r in warc.read(spark, str(tmp_path)).groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert count["x.warc"] == 1 and count["z.warc.gz"] == 3 and count["end.warc"] == 1 and "y.warc" not in count
    broken = {r.file.rsplit("/", 1)[1]: (r.size, r.reached) for r in warc.damage(spark, str(tmp_path)).collect()}
    assert broken["x.warc"] == (2 * len(one) + 4, len(one)) and broken["y.warc"] == (17, 0) and broken["end.warc"] == (2 * len(one) - 9, len(one)) and "z.warc.gz" not in broken


def test_long_urls_and_ids_of_any_type(spark):
    long, body = "http://a/" + "x" * 70_000, "<p>" + "y" * 200
    rows = [("b>1", long, body), ("a\r\n 2", "u", body), (None, long, "z"), ("null", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n", "z"), ("é", None, FAKE)]
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {("b>1", "revisit", "a\r\n 2"), ("a\r\n 2", "response", None), (None, "response", None), ("null", "response", None), ("é", "response", None)}
    alone = spark.createDataFrame(rows[:1], "page_id string, url string, html string")
    assert warc.round_trip(alone).count() == 1
    path = warc.Scratch(spark, "test").path()
    warc.write(alone, path)
    assert warc.read(spark, path).first().url == long


def test_header_search_is_linear_in_the_archive():
    data = b"WARC/1.1\r\n" * 200_000 + b"WARC-Type: response\r\nContent-Length: 0\r\n\r\n" + b"WARC/1.1\r\n" * 200_000
    headers, began = warc.Headers(data), time.perf_counter()
    found = [headers.at(m.start()) is not None for m in warc.MAGIC.finditer(data)]
    assert sum(found) == 200_000 and all(found[:200_000]) and time.perf_counter() - began < 10
