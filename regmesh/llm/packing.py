"""Best-fit packing with large-item matching.

Only the lengths of the pieces matter, and a length is at most the capacity: so the
corpus is packed as a histogram. Pieces above one third of the capacity share a
sequence with at most one other such piece, by greedy matching: the largest left
takes the largest partner that still fits. Smaller pieces follow in falling size,
each into the tightest gap. Equal sequences stay together as ranges, so the plan has
at most a few rows for each length, whatever the number of documents. Each piece
then finds its place from its rank among the pieces of its length; ranks come from
counts by (length, bucket), so a hot length, and a row that is repeated however often, is
dealt out over buckets.

Defined results: a null text is the empty text: the end token alone; only documents
longer than the capacity are cut; repeated rows are packed each; null ids stay null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, text_of, trim_memory

CAPACITY = 4096
END = 1
#: Texts of these characters are normal in form and split alike by Python; others go to the tokenizer whole.
PLAIN = re.compile("[\t-\r -~À-ÿ]*")
#: Fixed value: the vocabulary's own split of plain, lower-case text, for RE2.
PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\t-\\r a-zß-öø-ÿ0-9]+"
CACHE = 600_000


class _Recent:
    """At most about CACHE entries; when they are full it starts anew, and what is in use soon comes back."""

    def __init__(self):
        self.held: dict[str, bytes] = {}

    def look(self, keys: list[str]) -> tuple[list, list[int]]:
        """Values in the order of the keys, None where unknown, and the places of those."""
        values = list(map(self.held.get, keys))
        return values, [i for i, v in enumerate(values) if v is None]

    def keep(self, new: dict[str, bytes]) -> None:
        if len(self.held) + len(new) > CACHE:
            self.held = {}
        self.held.update(new)


class Encoder:
    """Little-endian 32-bit ids of texts, without the end token.

    The vocabulary splits a text into parts before anything else, so the ids of a plain
    text are those of its parts. Ids of parts in recent use are kept. Any other text goes
    to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.parts = _Recent()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _part_ids(self, parts: list[str]) -> dict[str, bytes]:
        """All parts in one text; each ends with its one token that ends a word."""
        out: dict[str, bytes] = {"": b""}
        parts = [p for p in parts if p]
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            ids = self._ids(" ".join(some))
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some) and stop[-1] == len(ids):
                raw, low = ids.tobytes(), 0
                for part, high in zip(some, (4 * stop).tolist(), strict=True):
                    out[part] = raw[low:high]
                    low = high
            else:
                out.update((part, self._ids(part).tobytes()) for part in some)
        return out

    def _known_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, in order."""
        values, unknown = self.parts.look(parts)
        if unknown:
            new = self._part_ids([parts[i] for i in unknown])
            for i in unknown:
                values[i] = new[parts[i]]
            self.parts.keep(new)
        return values

    def encode(self, texts: list[str]) -> list[bytes]:
        """Parts are split and numbered by Arrow; ids are gathered for all texts at once."""
        plain = ["<|" not in t and PLAIN.fullmatch(t) is not None for t in texts]
        lower = pc.utf8_lower(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, PARTS, r"\0 "))
        coded = split.flatten().dictionary_encode()
        ids = self._known_ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        by_word = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        in_order = by_word.take(coded.indices)
        gathered = in_order.values.to_numpy()
        bounds = in_order.offsets.to_numpy()[split.offsets.to_numpy()] if len(in_order) else np.zeros(len(texts) + 1, np.int64)
        return [gathered[bounds[i] : bounds[i + 1]].tobytes() if p else self._ids(t).tobytes() for i, (t, p) in enumerate(zip(texts, plain, strict=True))]


_encoders: dict[str, Encoder] = {}


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids by the encoder that this process keeps for the vocabulary at path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode(texts)


def _portions(batches: Iterator[pa.RecordBatch], size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of whole texts together, until they pass ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column(1).nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row, or more for a document longer than the capacity."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches):
            own, nth, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(encode(part.column(1).to_pylist(), tokenizer)):
                raw += end
                for k, s in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[s : s + 4 * capacity]
                    own.append(i)
                    nth.append(k)
                    start.append(s // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(own, pa.int64())), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        trim_memory()

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class _Gaps:
    """Ranges of equal sequences by the room that is left in them."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def put(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in self.by:
                self.by[room] = []
                insort(self.rooms, room)
            self.by[room].append((first, count))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """room, first, count of a range with the least room that holds size."""
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, count = self.by[room].pop()
        if not self.by[room]:
            del self.by[room]
            self.rooms.pop(at)
        return room, first, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, pieces, first sequence, pieces in a sequence, offset), and the number of sequences."""
    left = {size: n for size, n in histogram.items() if n > 0}
    if any(not 0 < size <= capacity for size in left):
        raise ValueError("lengths must lie in 1..capacity")
    rows: list[tuple[int, int, int, int, int, int]] = []
    rank = dict.fromkeys(left, 0)
    gaps, sequences = _Gaps(), 0

    def lay(size: int, n: int, first: int, each: int, offset: int) -> None:
        rows.append((size, rank[size], n, first, each, offset))
        rank[size] += n
        left[size] -= n

    large = sorted(size for size in left if 3 * size > capacity)
    while large:
        size = large[-1]
        at = bisect_right(large, capacity - size) - 1
        if at < 0:  # no partner fits
            n = left[size]
            lay(size, n, sequences, 1, 0)
            gaps.put(capacity - size, sequences, n)
        elif large[at] == size:
            n = left[size] // 2
            if n:
                lay(size, 2 * n, sequences, 2, 0)
                gaps.put(capacity - 2 * size, sequences, n)
            sequences += n
            n = left[size]
            if n:  # one is left over; it pairs with the next smaller one, if there is any
                lay(size, 1, sequences, 1, 0)
                if len(large) > 1:
                    other = large[-2]
                    lay(other, 1, sequences, 1, size)
                    gaps.put(capacity - size - other, sequences, 1)
                    if not left[other]:
                        large.pop(-2)
                else:
                    gaps.put(capacity - size, sequences, 1)
        else:
            other = large[at]
            n = min(left[size], left[other])
            lay(size, n, sequences, 1, 0)
            lay(other, n, sequences, 1, size)
            gaps.put(capacity - size - other, sequences, n)
            if not left[other]:
                large.pop(at)
        sequences += n
        if not left[size]:
            large.pop(bisect_left(large, size))
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            found = gaps.take(size)
            if found is None:
                each = capacity // size
                room, first, count = capacity, sequences, -(-left[size] // each)
                sequences += count
            else:
                room, first, count = found
                each = room // size
            full = min(count, left[size] // each)
            if full:
                lay(size, full * each, first, each, capacity - room)
                gaps.put(room - each * size, first, full)
            rest = left[size] if full < count else 0
            if rest:
                lay(size, rest, first + full, rest, capacity - room)
                gaps.put(room - rest * size, first + full, 1)
                full += 1
            gaps.put(room, first + full, count - full)
    return rows, sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 512) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.cut(pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))  # written: a number that stays
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(histogram, capacity)
    buckets = min(16_384, max(1, -(-max(histogram.values(), default=1) // per_bucket)))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "row"))
    ranked = dealt.withColumn("nth", nth).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth") - 1)
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)  # bounded by the capacity, not by the documents
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        start = t[:, 0] * (1 << 48) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            own = t[np.searchsorted(start, length * (1 << 48) + rank, side="right") - 1]
            k = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(own[:, 3] + k // own[:, 4]), pa.array(own[:, 5] + k % own[:, 4] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    id_type = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
