"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, names (capitalised inside a sentence) and units
turn into typed placeholders, everything else into its lower-case form. A number is one
token with its sign, separators and decimals. A capitalised word that opens a sentence
may be a name or not, unless it is a known function word: it counts as both. Windows of
``WINDOW`` template tokens of the documents are hash-joined to those of the
benchmark. Matched windows of a document and an item are then checked for slot
consistency: an item's number, name or unit must stand for one and the same value
wherever it recurs in one occurrence, so a re-parameterised question matches and chance
does not; several variants in one document are judged one by one. A
document is a leak of an item when consistent windows cover at least ``coverage`` of
the item's tokens.

The windows of the benchmark travel to the tasks only while they number at most
``broadcast_windows``; a larger benchmark is joined by shuffle, with the same result.
There a bit map of fixed size, of the benchmark's windows, tells which windows of the
documents are worth sending, so what moves is little more than the hits.

Templates of placeholders alone say nothing, so windows with fewer than half literal
tokens, and items under ``LEAST`` tokens, match on their words (case aside) instead.
So do windows with a capitalised word, besides their template, as its type depends on
the text around it: verbatim copies always count.

Defined results: every row, of documents and of the benchmark, is judged by its own text,
whatever its id. Null or wordless texts match nothing; items shorter than a window are
matched whole. leaks gives a pair of ids once, null ids too, with the best of the rows
that share them (most coverage, then verbatim, then most windows); drop_leaks drops the
rows whose text leaks and no other row of their id. Empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, small_batches, text_of, trim_memory
from .html_extract import STOPS

WINDOW = 8
LEAST = 5
TOKEN = re.compile(
    r"[^\W\d_][^\W_]*"  # words
    r"|(?=[\d.+\-\u2212])(?:[+\-\u2212](?<![^\W_].)(?=\.?\d))?(?:\d|\.(?<![^\W_]\.)\d)\d*(?:[.,]\d+|['\u2019\u00a0\u202f]\d{3}(?!\d))*(?![^\W_])"  # numbers
    r"|[^\W_]+|[.!?:\n]"
)
# Words that open sentences and are no names.
FUNCTION_WORDS = STOPS | frozenset("how why where who whom whose while until since because although though after before during under over between among through than then also only just even still yet however therefore thus hence these those each every both either neither any all most more much many few several such same another others some none nothing something everything she we you i me my your his her our us let given suppose assume does did do is was were can could will would shall should may might must what which when if so but or nor not no yes here there now in on at by for from with about into of as to".split())
# Units that become one placeholder.
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent mph kmh degrees celsius fahrenheit watt watts volt volts".split())
LITERAL, NUMBER, NAME, UNIT, MARK = range(5)
CHUNK = 8192
_xx = xxhash.xxh64_intdigest
_PLACEHOLDER = {NUMBER: _xx(b"<number>"), NAME: _xx(b"<name>"), UNIT: _xx(b"<unit>")}
_BASE = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(CHUNK + WINDOW)], np.uint64)
_BACK = np.array([pow(pow(0x9E3779B97F4A7C15, -1, 1 << 64), k, 1 << 64) for k in range(CHUNK + WINDOW)], np.uint64)


class _Ids(dict):
    """Words to numbers; a new word is classified once, when it is first looked up."""

    def __init__(self, limit: int):
        super().__init__()
        self.lit = np.zeros(limit, np.uint64)
        self.raw = np.zeros(limit, np.uint64)
        self.kind = np.zeros(limit, np.int8)
        self.function = np.zeros(limit, bool)

    def __missing__(self, w: str) -> int:
        low = w.lower()
        if w in ".!?:\n":
            kind = MARK
        elif not w.isalpha():
            kind = NUMBER if w[-1].isdigit() and not any(map(str.isalpha, w)) else LITERAL
        elif low in UNITS:
            kind = UNIT
        else:
            kind = NAME if len(w) > 1 and w[0].isupper() and w[1:].islower() else LITERAL
        at = len(self)
        if at == len(self.lit):
            self.lit, self.raw, self.kind, self.function = (np.resize(x, 2 * at) for x in (self.lit, self.raw, self.kind, self.function))
        self.raw[at] = _xx(low.encode("utf-8", "surrogatepass"))
        self.lit[at] = _PLACEHOLDER[kind] if kind in (NUMBER, UNIT) else self.raw[at]
        self.kind[at] = kind
        self.function[at] = low in FUNCTION_WORDS
        self[w] = at
        return at


class Tokens(NamedTuple):
    """A text without its sentence marks: hashes of the template and of the words, kinds, which words are capitalised, which of them may be a name or not, and the words."""

    lit: np.ndarray
    raw: np.ndarray
    kind: np.ndarray
    titled: np.ndarray
    either: np.ndarray
    words: Callable[[], list[str]]


class Canon:
    """Texts to templates; words of former texts are remembered, up to LIMIT."""

    LIMIT = 250_000

    def __init__(self):
        self.ids = _Ids(1 << 16)

    def template(self, text: str) -> tuple[np.ndarray, np.ndarray, Callable[[], list[str]]]:
        """Token hashes, kinds, and a function that gives the words, all without sentence marks. A capital at a sentence start makes no name here; tokens() tells which may be one."""
        t = self.tokens(text)
        return t.lit, t.kind, t.words

    def tokens(self, text: str) -> Tokens:
        raw = TOKEN.findall(text)
        if len(self.ids) > self.LIMIT:
            self.ids = _Ids(1 << 16)
        ids = self.ids
        at = np.fromiter(map(ids.__getitem__, raw), np.int64, len(raw))
        lit, kind = ids.lit[at], ids.kind[at]
        first = np.concatenate([[True], kind[:-1] == MARK])[: len(kind)]
        name = kind == NAME
        kind[name & first] = LITERAL
        lit[name & ~first] = np.uint64(_PLACEHOLDER[NAME])
        keep = np.flatnonzero(kind != MARK)
        return Tokens(lit[keep], ids.raw[at[keep]], kind[keep], name[keep], (name & first & ~ids.function[at])[keep], lambda: [raw[i] for i in keep.tolist()])


def window_hashes(lit: np.ndarray, size: int, verbatim: bool = False) -> np.ndarray:
    """Polynomial hashes of all windows of ``size`` tokens; those of words (verbatim) never equal those of templates."""
    n = len(lit) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for low in range(0, n, CHUNK):  # differences of running sums, modulo 2 ** 64
        part = lit[low : low + CHUNK + size - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _BASE[: len(part)], out=total[1:])
        out[low : low + CHUNK] = (total[size:] - total[:-size]) * _BACK[: len(total) - size]
    return out ^ np.uint64(size + 2 * WINDOW * verbatim)


def template_windows(t: Tokens, size: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, hashes and literal tokens of all windows, with each word that may be a name or not as both; a chunk of positions at a time.

    wanted: flags of the tokens that stand in a window searched for. Windows with any other are left out, as none can match.
    """
    whole = None if wanted is None else _sliding(wanted | t.either, size) == size
    if len(t.lit) < size or (whole is not None and not whole.any()):
        return
    plain = window_hashes(t.lit, size)
    literal, many = _sliding(t.kind == LITERAL, size), _sliding(t.either, size) > 0
    mark = np.uint64(size)
    at = np.arange(len(plain)) if whole is None else np.flatnonzero(whole)
    yield at, plain[at], literal[at]
    with_either = np.flatnonzero(many if whole is None else many & whole)
    for low in range(0, len(with_either), CHUNK):
        pos = with_either[low : low + CHUNK]
        h, lits = plain[pos] ^ mark, literal[pos]
        first = len(pos)
        for k in range(size):
            at = np.flatnonzero(t.either[pos + k])
            if len(at):
                own = pos[at]
                h = np.concatenate([h, h[at] + (np.uint64(_PLACEHOLDER[NAME]) - t.lit[own + k]) * _BASE[k]])
                lits, pos = np.concatenate([lits, lits[at] - 1]), np.concatenate([pos, own])
        yield pos[first:], h[first:] ^ mark, lits[first:]


def _sliding(flags: np.ndarray, size: int) -> np.ndarray:
    """How many of the flags each window of ``size`` holds."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[size:] - total[:-size]


def keyed_windows(t: Tokens) -> tuple[int, list[tuple[bool, int, int]]]:
    """An item's window size, and (verbatim, position, hash) of all that it is found by: each window has its templates, its words or both."""
    size = min(WINDOW, len(t.lit))
    if not size:
        return 0, []
    words = (_sliding(t.kind == LITERAL, size) * 2 < size) | (_sliding(t.titled, size) > 0) | (size < LEAST)
    out = [(True, p, h) for p, h in enumerate(window_hashes(t.raw, size, True).tolist()) if words[p]]
    for pos, h, literal in template_windows(t, size) if size >= LEAST else ():
        solid = 2 * literal >= size  # templates of placeholders alone say nothing
        out += [(False, p, x) for p, x in zip(pos[solid].tolist(), h[solid].tolist(), strict=True)]
    return size, out


def slot_kinds(t: Tokens) -> np.ndarray:
    """Kinds with every word that may be a name as one."""
    return np.where(t.either, NAME, t.kind)


def item_windows(items: list[tuple]) -> dict:
    """hash -> [(index of the item, position)], (size, verbatim) of all windows, each item's kinds and words, and the hashes of all tokens."""
    canon, table, sizes, held, tokens = Canon(), defaultdict(list), set(), [], {_PLACEHOLDER[NAME]}
    for item, text in items:
        t = canon.tokens(text or "")
        size, found = keyed_windows(t)
        for verbatim, p, h in found:
            sizes.add((size, verbatim))
            table[h].append((len(held), p))
        tokens.update(t.lit.tolist(), t.raw.tolist())
        held.append((item, size, slot_kinds(t), t.words()))
    return {"table": dict(table), "sizes": sorted(sizes), "items": held, "tokens": np.array(sorted(tokens), np.uint64)}


def _votes(stands: list[tuple]) -> dict:
    """The most frequent value of each slot, from (slot, value) pairs."""
    count: dict = defaultdict(Counter)
    for slot, value in stands:
        count[slot][value] += 1
    return {slot: max(sorted(c), key=c.__getitem__) for slot, c in count.items()}


def consistent_cover(pairs: list[tuple[int, int]], size: int, kinds, item_words: list[str], doc_words) -> tuple[int, bool, int]:
    """Item tokens covered by windows whose slots agree, whether all those tokens are the same words, and the windows kept.

    pairs: (position in the document, position in the item). doc_words(p): the words of the document's window at p.
    A document may hold several variants of an item, so values are voted for by occurrence: windows of one alignment
    (document position less item position), then those of nearby alignments (words put in or left out), then all. The
    best cover of any occurrence counts, of equal ones the verbatim one.
    """
    own = [w.lower() for w in item_words]
    slots = {i: [(k, (int(kinds[i + k]), own[i + k])) for k in range(size) if kinds[i + k] != LITERAL] for i in {i for _, i in pairs}}
    seen: dict[int, Counter] = defaultdict(Counter)  # by item position: how often which values stand there
    stands: dict[int, list] = defaultdict(list)  # by alignment
    for d, i in pairs:
        words = doc_words(d)
        values = tuple(words[k].lower() for k, _ in slots[i])
        seen[i][values] += 1
        stands[d - i] += zip((slot for _, slot in slots[i]), values, strict=True)
    every = _votes([x for v in stands.values() for x in v])
    order, near, at = sorted(stands), min(size, len(own) // 2), 0
    tried, best = set(), (0, False, 0)

    def consider(stand: dict) -> bool:
        """Whether no other values can do better."""
        nonlocal best
        key = tuple(stand[slot] for slot in every)
        if key not in tried:
            tried.add(key)
            covered, same, kept = set(), True, 0
            for i, found in seen.items():
                n = found[tuple(stand[slot] for _, slot in slots[i])]
                if n:
                    kept += n
                    covered.update(range(i, i + size))
                    same = same and all(stand[slot] == slot[1] for _, slot in slots[i])
            best = max(best, (len(covered), same and kept > 0, kept))
        return best[:2] == (len(own), True)

    done = consider(every) or consider({slot: slot[1] for slot in every})
    while at < len(order) and not done:
        end = at + 1
        while end < len(order) and order[end] - order[end - 1] <= near:
            end += 1
        around = every | _votes([x for a in order[at:end] for x in stands[a]])
        done = consider(around) or any(consider(around | _votes(stands[a])) for a in order[at:end])
        at = end
    return best


def _low_bits(hashes: np.ndarray) -> np.ndarray:
    """Flags by the low bits of the hashes."""
    out = np.zeros(1 << 20, bool)
    out[(hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return out


def leaks_of(text: str, canon: Canon, index: dict, low_bits: np.ndarray, known: np.ndarray, coverage: float, tokens: np.ndarray | None = None) -> list[tuple]:
    """(item, coverage, verbatim, windows) of each item that a text leaks. tokens: low bits of the tokens of all indexed windows."""
    t = canon.tokens(text)
    found: dict[int, set[tuple[int, int]]] = defaultdict(set)
    told: list[str] = []
    for size, verbatim in index["sizes"]:
        wanted = None if tokens is None else tokens[((t.raw if verbatim else t.lit) & np.uint64(0xFFFFF)).astype(np.int64)]
        if verbatim:
            h = window_hashes(t.raw, size, True)
            pos = np.arange(len(h)) if wanted is None else np.flatnonzero(_sliding(wanted, size) == size)
            keyed = [(pos, h[pos])]
        else:
            keyed = [(pos, h) for pos, h, _ in template_windows(t, size, wanted)]
        for pos, h in keyed:
            at = np.flatnonzero(low_bits[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            if len(at):
                spot = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
                at = at[known[spot] == h[at]]
                for p, x in zip(pos[at].tolist(), h[at].tolist(), strict=True):
                    for item, i in index["table"][x]:
                        if index["items"][item][1] == size:
                            found[item].add((p, i))
    out = []
    for item, pairs in sorted(found.items()):
        name, size, kinds, item_words = index["items"][item]
        told = told or t.words()
        n, same, kept = consistent_cover(sorted(pairs), size, kinds, item_words, lambda p, s=size, told=told: told[p : p + s])
        if n >= coverage * len(item_words):
            out.append((name, n / len(item_words), same, kept))
    return out


class _Search:
    """An index as a task uses it."""

    def __init__(self, index: dict, coverage: float):
        self.index, self.coverage, self.canon = index, coverage, Canon()
        self.known = np.array(sorted(index["table"]), np.uint64)
        self.low_bits, self.tokens = _low_bits(self.known), _low_bits(index["tokens"])

    def leaks(self, text: str) -> list[tuple]:
        return leaks_of(text, self.canon, self.index, self.low_bits, self.known, self.coverage, self.tokens) if len(self.known) else []


def _by_map(docs: DataFrame, index: dict, names: pa.Array, coverage: float, schema: str) -> DataFrame:
    """names: the item ids that the index's numbers stand for."""
    held = docs.sparkSession.sparkContext.broadcast((index, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, ids = _Search(held.value[0], coverage), held.value[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, rest = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    for leak in search.leaks(t):
                        own.append(i)
                        rest.append(leak)
                cols = list(zip(*rest, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own, pa.int64())), ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())],
                    names=["doc_id", "item_id", "coverage", "verbatim", "n_windows"],
                )
        del search
        trim_memory()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


BITS = 27  # of the bit map: 16 MB, whatever the benchmark


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _windows(rows: DataFrame, sizes: list[tuple[int, bool]] | None, bits: np.ndarray | None = None) -> DataFrame:
    """k1, k2 (the text's key), pos, size, verbatim, total, h, words, kinds of windows. rows: k1, k2, text.

    sizes: (size, verbatim) of the benchmark's windows, for documents, whose windows outside the bit map are left out;
    None: the windows that items are found by.
    """
    held = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)

    def keyed(t: Tokens) -> Iterator[tuple[int, bool, int, int]]:
        if sizes is None:
            size, found = keyed_windows(t)
            yield from ((size, *x) for x in found)
            return
        for size, verbatim in sizes:
            if verbatim:
                h = window_hashes(t.raw, size, True)
                every = [(np.arange(len(h)), h)]
            else:
                every = [(pos[2 * literal >= size], h[2 * literal >= size]) for pos, h, literal in template_windows(t, size)]
            for pos, h in every:
                low = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
                at = np.flatnonzero(held.value[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                yield from ((size, verbatim, p, x) for p, x in zip(pos[at].tolist(), h[at].tolist(), strict=True))

    types = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                own, cols = [], [[] for _ in types]
                for i, text in enumerate(part.column(2).to_pylist()):
                    t = canon.tokens(text)
                    words = kinds = None
                    for size, verbatim, p, h in keyed(t):
                        if words is None:
                            words, kinds = t.words(), slot_kinds(t)
                        own.append(i)
                        for c, v in zip(cols, (p, size, verbatim, len(words), _signed(h), words[p : p + size], kinds[p : p + size].tolist()), strict=True):
                            c.append(v)
                keys = [part.column(k).take(pa.array(own, pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["k1", "k2", "pos", "size", "verbatim", "total", "h", "words", "kinds"])

    small_batches(rows.sparkSession)
    return rows.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, pos int, size int, verbatim boolean, total int, h long, words array<string>, kinds array<int>")


def _text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def _bit_map(windows: DataFrame) -> np.ndarray:
    """Bits set for the low bits of the windows' hashes: 4,096 rows of 4 KB come here at most."""
    low = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    got = windows.groupBy(F.shiftright(low, 15).alias("part")).agg(F.bitmap_construct_agg(low.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in got:
        out[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def _by_shuffle(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """k1, k2 (of the document's text), i1, i2 (of the item's), coverage, verbatim, n_windows, for a benchmark of any size. docs, items: k1, k2, text."""
    scratch = Scratch(docs.sparkSession, "windows")
    mine = scratch.cut(_windows(items, None)).select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), F.col("pos").alias("ipos"), "size", "verbatim", "total", "h", F.col("words").alias("iwords"), F.col("kinds").alias("ikinds"))
    sizes = sorted((r["size"], r["verbatim"]) for r in mine.select("size", "verbatim").distinct().collect())  # two for each window size
    theirs = _windows(docs, sizes, _bit_map(mine)).select("k1", "k2", F.col("pos").alias("dpos"), "size", "verbatim", "h", F.col("words").alias("dwords"))
    # texts with copies hold the same pairs again: each is kept once, before it moves and after; a hot window is split by AQE
    pair = ["k1", "k2", "i1", "i2", "dpos", "ipos"]
    hits = theirs.join(mine.dropDuplicates(["i1", "i2", "ipos", "h"]), ["h", "size", "verbatim"]).dropDuplicates(pair)

    def check(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size, total = int(rows["size"].iloc[0]), int(rows["total"].iloc[0])
        kinds, words, window = [LITERAL] * total, [""] * total, {}
        for r in rows.itertuples():
            kinds[r.ipos : r.ipos + size], words[r.ipos : r.ipos + size] = list(r.ikinds), list(r.iwords)
            window[r.dpos] = list(r.dwords)
        pairs = sorted(zip(rows["dpos"].tolist(), rows["ipos"].tolist(), strict=True))
        n, same, kept = consistent_cover(pairs, size, kinds, words, window.__getitem__)
        out = dict(zip(("k1", "k2", "i1", "i2"), ([k] for k in key), strict=True)) | {"coverage": [n / total], "verbatim": [same], "n_windows": [kept]}
        return pd.DataFrame(out)[: int(n >= coverage * total)]

    return hits.groupBy("k1", "k2", "i1", "i2").applyInPandas(check, "k1 long, k2 long, i1 long, i2 long, coverage double, verbatim boolean, n_windows long")


def _index(items: DataFrame, broadcast_windows: int) -> tuple[dict, pa.Array] | None:
    """The index and the item ids it numbers, of a benchmark with few enough windows."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > 16 * broadcast_windows:  # few enough bytes to gather here; then the windows are counted
        return None
    rows = items.orderBy("text", "item_id").collect()
    index = item_windows([(k, r["text"]) for k, r in enumerate(rows)])
    if sum(map(len, index["table"].values())) > broadcast_windows:
        return None
    return index, pa.array([r["item_id"] for r in rows], to_arrow_type(items.schema["item_id"].dataType))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, broadcast_windows: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, verbatim, n_windows: one row for each leaking pair, none for clean documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), text_of(F.col(item_text)).alias("text"))
    types = [x.schema[c].dataType.simpleString() for x, c in ((rows, "doc_id"), (items, "item_id"))]
    if (index := _index(items, broadcast_windows)) is not None:
        found = _by_map(rows, *index, coverage, f"doc_id {types[0]}, item_id {types[1]}, coverage double, verbatim boolean, n_windows long")
    else:
        text = F.col("text")
        found = _by_shuffle(rows.select("text", *_text_keys(text)), items.select("text", *_text_keys(text)).dropDuplicates(["k1", "k2"]), coverage)
        found = Scratch(docs.sparkSession, "leaks").cut(found)
        names = items.select("item_id", *(k.alias(n) for k, n in zip(_text_keys(text), ("i1", "i2"), strict=True)))
        found = found.join(names, ["i1", "i2"]).join(rows.select("doc_id", *_text_keys(text)), ["k1", "k2"])
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "verbatim", "n_windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.coverage", "best.verbatim", "best.n_windows")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, broadcast_windows: int = 500_000, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text leaks an item."""
    items = benchmark.select(F.col(item_col).alias("item_id"), text_of(F.col(item_text)).alias("text"))
    if (index := _index(items, broadcast_windows)) is not None:
        held = docs.sparkSession.sparkContext.broadcast(index[0])
        small_batches(docs.sparkSession)

        @F.pandas_udf("boolean")
        def leaky(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            search = _Search(held.value, coverage)
            for texts in parts:
                yield pd.Series([bool(search.leaks(t)) for t in texts], dtype=bool)

        return docs.where(~leaky(text_of(F.col(text_col))))
    text = text_of(F.col(text_col))
    rows = docs.select(text.alias("text"), *_text_keys(text))
    found = _by_shuffle(rows, items.select("text", *_text_keys(F.col("text"))).dropDuplicates(["k1", "k2"]), coverage)
    found = Scratch(docs.sparkSession, "leaks").cut(found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct())  # its size is then known
    return docs.join(found, [k == F.col(n) for k, n in zip(_text_keys(text), ("__k1", "__k2"), strict=True)], "left_anti")
