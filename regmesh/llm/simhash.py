"""SimHash near-duplicates, candidates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two
fingerprints with at most four differing bits have, by the pigeonhole principle,
either one segment without an error, or two segments with exactly one error each
(three segments with one or more each, four at most in all). So the keys are
  - each segment as it is: 3 keys;
  - for each two segments the pair of codeword indices to which they decode.
A word and its one-bit neighbour differ in parity: the even one sends every
codeword that the neighbour may decode to (one or six), the odd one its own. Rows
that share a key, on opposite sides for pairs, are verified by Hamming distance.
No link is lost, and no cap is set.

Rows of one key meet sorted in a stream. What a key links leaves as a spanning
forest, never as all pairs. A key with more than ``HOT`` rows is deferred: a second
pass deals its rows out as pairs of bounded blocks.

Defined results: a null or wordless text has fingerprint zero; a null doc_id takes
part in links, and component_id is the smallest non-null id reachable (null if
there is none); repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, text_of
from .components import connected_components
from .golay import nearby, nearest

WIDTHS = (22, 21, 21)
SHIFTS = (42, 21, 0)
PAIRS = ((0, 1), (0, 2), (1, 2))
RADIUS = 4
SHINGLE = 4
SEED = 42
HOT = 8192
BLOCK = 2048
EDGE = "deferred boolean, key long, a long, b long"

_xx = xxhash.xxh64_intdigest
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - size + 1)
    if n == 1:
        return _xx(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = [_xx(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def text_key(text: Column) -> Column:
    """With doc_id a key of the row; null and empty texts share one."""
    return F.xxhash64(text_of(text))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); keyed: text_key too."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"), *[text_key(text).alias("text_key")] * keyed)

    def fn(c: dict) -> dict:
        return c | {"fp": [f - (1 << 64) if f >> 63 else f for f in map(fingerprint, c["text"])]}

    return arrow_map(rows, fn, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long" + ", text_key long" * keyed)


def segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.astype(np.int64).view(np.uint64)
    return [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for w, s in zip(WIDTHS, SHIFTS, strict=True)]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, side and the fingerprint's index, for all keys of all fingerprints."""
    segs = segments(fp)
    at = np.arange(len(fp))
    out = [((np.int64(k) << 56) | s, np.zeros(len(fp), np.int8), at) for k, s in enumerate(segs)]
    odd = [np.bitwise_count(s) & 1 for s in segs]
    sent = []
    for s, o in zip(segs, odd, strict=True):
        ids = nearby(s)
        ids[o == 1, 1:] = -1
        ids[:, 0] = np.where(o == 1, nearest(s), ids[:, 0])
        sent.append(ids)
    for k, (p, q) in enumerate(PAIRS):
        both = (sent[p][:, :, None] << 12) | sent[q][:, None, :]
        ok = (sent[p][:, :, None] >= 0) & (sent[q][:, None, :] >= 0)
        mixed = (odd[p] ^ odd[q]).astype(np.int64)
        head = (np.int64(3 + k) << 56) | (mixed << 48)
        i = np.nonzero(ok)
        out.append((both[i] | head[i[0]], odd[p][i[0]].astype(np.int8), i[0]))
    return tuple(np.concatenate([x[j] for x in out]) for j in range(3))


def key_rows(prints: DataFrame) -> DataFrame:
    """key, side, fp: about 33 rows for each distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(fp), 2048):
                part = fp[start : start + 2048]
                key, side, at = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(part[at])], names=["key", "side", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, side byte, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: at most one link fewer than nodes."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:  # least label of the neighbours, then jump, until nothing changes
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = np.minimum(least, least[least])
        if np.array_equal(least, label):
            break
        label = least
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[own]], nodes[own]


def _links(key: np.ndarray, side: np.ndarray, fp: np.ndarray, long_run: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between rows that share a key; rows come sorted by key and side."""
    n = len(key)
    if n < 2:
        return fp[:0], fp[:0]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.concatenate([first, [n]]))
    left = np.repeat(first + length, length) - np.arange(n)  # rows of this key from here on
    exact = (key >> 56) < 3
    short = np.repeat(length <= long_run, length)
    a, b = [], []
    at = np.flatnonzero(short & (left > 1))
    step = 1
    while len(at):
        to = at + step
        ok = (np.bitwise_count(fp[at].view(np.uint64) ^ fp[to].view(np.uint64)) <= RADIUS) & (exact[at] | (side[at] != side[to]))
        a.append(fp[at[ok]])
        b.append(fp[to[ok]])
        step += 1
        at = at[left[at] > step]
    for s, m in zip(first[length > long_run].tolist(), length[length > long_run].tolist(), strict=True):
        run, sides = fp[s : s + m].view(np.uint64), side[s : s + m]
        halves = (run, run) if exact[s] else (run[sides == 0], run[sides == 1])
        for i in range(0, len(halves[0]), 512):
            x = halves[0][i : i + 512]
            for j in range(i if exact[s] else 0, len(halves[1]), 4096):
                y = halves[1][j : j + 4096]
                p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= RADIUS)
                u, v = forest(x[p].view(np.int64), y[q].view(np.int64))
                a.append(u)
                b.append(v)
    a, b = np.concatenate(a) if a else fp[:0], np.concatenate(b) if b else fp[:0]
    own = a != b
    return forest(a[own], b[own])


def _verify(rows: DataFrame, hot: int | None) -> DataFrame:
    """Links of rows sorted by key in each partition; keys with more than ``hot`` rows leave as deferred rows (a: fingerprint, b: side)."""

    def pack(deferred: bool, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), deferred)), pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["deferred", "key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64))
        passing = None  # the hot key whose rows are being passed on
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(now[0]):
                continue
            if passing is not None:
                m = int(np.searchsorted(now[0], passing, side="right"))
                if m:
                    yield pack(True, now[0][:m], now[2][:m], now[1][:m].astype(np.int64))
                    now = [x[m:] for x in now]
                if not len(now[0]):
                    continue
                passing = None
            key, side, fp = (np.concatenate([h, x]) for h, x in zip(held, now, strict=True))
            tail = int(np.searchsorted(key, key[-1], side="left"))
            done = [key[:tail], side[:tail], fp[:tail]]
            held = (key[tail:], side[tail:], fp[tail:])
            if hot and len(done[0]):
                _, at, many = np.unique(done[0], return_index=True, return_counts=True)
                for s, m in zip(at[many > hot].tolist(), many[many > hot].tolist(), strict=True):
                    yield pack(True, done[0][s : s + m], done[2][s : s + m], done[1][s : s + m].astype(np.int64))
                if (many > hot).any():
                    ok = np.repeat(many <= hot, many)
                    done = [x[ok] for x in done]
            a, b = _links(*done)
            if len(a):
                yield pack(False, np.zeros(len(a), np.int64), a, b)
            if hot and len(held[0]) > hot:
                yield pack(True, held[0], held[2], held[1].astype(np.int64))
                passing = int(held[0][0])
                held = tuple(x[:0] for x in held)
        a, b = _links(*held)
        if len(a):
            yield pack(False, np.zeros(len(a), np.int64), a, b)

    return rows.mapInArrow(run, EDGE)


def links(prints: DataFrame, scratch: Scratch, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints that connect every two within the radius."""
    dealt = key_rows(prints).repartition("key").sortWithinPartitions("key", "side")
    found = scratch.cut(_verify(dealt, hot))
    edges = found.where(~F.col("deferred")).select("a", "b")
    late = found.where("deferred").select("key", F.col("b").cast("byte").alias("side"), F.col("a").alias("fp"))
    if late.isEmpty():
        return edges.distinct()
    blocks = late.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("m"))
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    pairs = late.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = pairs.select("key", "side", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    # each two blocks of a hot key get a key of their own; its kind stays in the top byte
    tag = F.col("key").bitwiseAND(F.lit(0x7F << 56)).bitwiseOR(F.xxhash64("key", "lo", "hi").bitwiseAND(F.lit((1 << 56) - 1)))
    again = pairs.select(tag.alias("key"), "side", "fp").repartition("key").sortWithinPartitions("key", "side")
    more = scratch.cut(_verify(again, None))
    return edges.unionByName(more.select("a", "b")).distinct()


def _grouped(prints: DataFrame, scratch: Scratch, share: int = 1000) -> DataFrame:
    """prints with component_id and root (a key of the component, never null).

    A fingerprint with more than one row in ``share`` is one of fewer than ``share``: their groups go to the rows by
    broadcast, so no task gets the rows of such a fingerprint together; all others are joined by shuffle.
    """
    first = scratch.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    found = connected_components(links(first.select("fp"), scratch), scratch)  # node, root: linked fingerprints only
    linked = first.join(found.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("fp", "root", "least")
    component = F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first"))
    groups = scratch.cut(first.join(named, "fp", "left").select("fp", component.alias("component_id"), F.coalesce("root", "fp").alias("root"), "n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(groups.where(F.col("n") * share > total).drop("n"))
    rest = prints.join(often.select("fp"), "fp", "left_anti")
    return prints.join(often, "fp").unionByName(rest.join(groups.drop("n"), "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    out = _grouped(scratch.cut(fingerprints(docs, id_col, text_col)), scratch)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kept_id, kept_key (text_key), n: one for each component, the smallest id (null only where the component has no other); n rows of the table are so."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.cut(fingerprints(docs, id_col, text_col, keyed=True))
    rows = _grouped(prints, scratch).groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("row"))
    return least.select(F.col("row.doc_id").alias("kept_id"), F.col("row.text_key").alias("kept_key"), F.col("row.n").alias("n"))
