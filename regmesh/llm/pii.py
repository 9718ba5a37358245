"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

The base kinds are found leftmost and non-overlapping, each kind by itself, in time
linear in the text. The field then reads the stretches of text around digits, @ and
spelled-out at signs that no base span covers. A segment is a token outside, or a
whole span of at most ``MAX_TOKENS`` tokens with a kind; features see the whole span
(digit groups, check digit, separators, octets, context word). The entity bound
keeps the dynamic program linear: it chooses boundaries and kinds jointly. Spans
that it adds pass an exact check of their kind. The weights are trained here, on
generated sentences (``examples``), by gradient ascent on the likelihood.

Bounds of added spans, none of base ones: ``MAX_TOKENS`` tokens, 80 characters and 19
digits; the stretch that is read reaches three words, of at most 60 characters each,
to both sides of its anchor. A spelled-out address beyond them is not added.

Defined results: a null text is the empty text and has no spans; offsets are code
points, end exclusive; base spans always stay; an added span never overlaps one;
an empty table gives an empty result; repeated rows each get a row; other columns
are ignored (redact keeps them).
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24

# The base patterns of the contract. The look-behinds only skip starts that cannot be leftmost.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i & 1:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 4 and int(s or "0") <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        part = text[floor:at]
        start = floor + len(part.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the contract's spans, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field -----------------------------------------------------------------

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\d")
ANCHOR = re.compile(r"[0-9]{2}|@|[\[({]\s?(?:at|AT)\s?[\])}]|\s(?:at|AT)\s\S+\s(?:dot|DOT)\s")
SPELLED = re.compile(r"^[\w.%+-]+\s*(?:@|[\[({]\s?at\s?[\])}]|\sat\s)\s*[\w-]+(?:(?:\.|\s*[\[({]\s?dot\s?[\])}]\s*|\s+dot\s+)[\w-]+)+$", re.I)
CUES = {"phone": ("tel", "phone", "call", "fax", "mobile", "cell"), "card": ("card", "visa", "mastercard", "credit", "amex"), "ip": ("ip", "host", "server", "address"), "email": ("mail", "email", "contact", "write")}
NAMES = (
    "bias", "digits<7", "digits7", "digits8-9", "digits10", "digits11", "digits12-13", "digits14-15", "digits16", "digits17-19", "digits>19", "one group", "groups2", "groups3", "groups4", "groups5+",
    "luhn14+", "no luhn14+", "octets", "over 255", "plus", "bracketed area", "3-3-4", "quads", "amex", "date", "has @", "spelled", "has letters", "sep space", "sep dash", "sep dot", "sep odd", "glued left", "glued right",
    "cue email", "cue ip", "cue card", "cue phone", "dots around", "long",
)
AT = {n: i for i, n in enumerate(NAMES)}


def span_features(text: str, start: int, end: int, left: str) -> list[int]:
    s = text[start:end]
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    n, lens = len(digits), tuple(map(len, groups))
    on = ["bias"]
    on.append("digits<7" if n < 7 else "digits7" if n == 7 else "digits8-9" if n < 10 else "digits10" if n == 10 else "digits11" if n == 11 else "digits12-13" if n < 14 else "digits14-15" if n < 16 else "digits16" if n == 16 else "digits17-19" if n < 20 else "digits>19")
    on.append("one group" if len(groups) < 2 else "groups5+" if len(groups) > 4 else f"groups{len(groups)}")
    if 14 <= n <= 19:
        on.append("luhn14+" if luhn(digits) else "no luhn14+")
    if len(groups) == 4 and re.fullmatch(r"\d+(?:\s?[\[(]?\.[\])]?\s?\d+){3}", s):
        on.append("octets" if all(map(_octet, groups)) else "over 255")
    if s[0] == "+" or s.startswith("00"):
        on.append("plus")
    if re.match(r"\+?\d{0,3}[\s-]?\(\d{2,4}\)", s):
        on.append("bracketed area")
    if lens[-3:] == (3, 3, 4):
        on.append("3-3-4")
    if lens == (4, 4, 4, 4):
        on.append("quads")
    if lens == (4, 6, 5):
        on.append("amex")
    if sorted(lens) in ([2, 2, 4], [1, 2, 4], [1, 1, 4]):
        on.append("date")
    if "@" in s:
        on.append("has @")
    if SPELLED.match(s):
        on.append("spelled")
    if any(c.isalpha() for c in s):
        on.append("has letters")
    for name, c in (("sep space", " "), ("sep dash", "-"), ("sep dot", ".")):
        if c in s:
            on.append(name)
    if re.search(r"[^\w\s().+@\[\]{}-]", s):
        on.append("sep odd")
    before, after = text[start - 1 : start], text[end : end + 1]
    if before and (before.isalnum() or before in "_=#$/"):
        on.append("glued left")
    if after and (after.isalnum() or after in "_=%/"):
        on.append("glued right")
    if (before and before in ".-+") or (after and after in ".-" and text[end + 1 : end + 2].isdigit()):
        on.append("dots around")
    on += [f"cue {k}" for k, words in CUES.items() if left in words]
    if end - start > 40:
        on.append("long")
    return [AT[x] for x in on]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(first token, token after the last, features) of each span that could be an entity."""
    out = []
    cum = [0]
    for a, b in tokens:
        cum.append(cum[-1] + (b - a if text[a].isdigit() and text[a] in "0123456789" else 0))
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        left = next((text[x:y].lower() for x, y in reversed(tokens[max(0, i - 3) : i]) if text[x].isalpha()), "")
        mail = False
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            x, y = tokens[j - 1]
            mail = mail or text[x] == "@" or text[x:y].lower() == "at"
            n = cum[j] - cum[i]
            if n > 19 or y - a > 80:
                break
            if not text[y - 1].isalnum():
                continue
            if text[a].isalpha():
                if not mail or not SPELLED.match(text[a:y]):
                    continue
            elif n < 4 or (n < 7 and text.count(".", a, y) < 3) or re.search(r"[^\W\d]", text[a:y]):
                if not (mail and SPELLED.match(text[a:y])):
                    continue
            out.append((i, j, span_features(text, a, y, left)))
    return out


@dataclass
class Field:
    """weights (features, kinds); a token outside scores zero."""

    weights: np.ndarray

    def scores(self, spans: list) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) for _, _, f in spans]).reshape(-1, len(KINDS))

    def decode(self, n: int, spans: list) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, token after the last, kind) of its entities."""
        if not spans:
            return []
        score = self.scores(spans)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j, _) in enumerate(spans):
            ending[j].append(k)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for k in ending[j]:
                kind = int(score[k].argmax())
                if best[spans[k][0]] + score[k, kind] > best[j]:
                    best[j], back[j] = best[spans[k][0]] + score[k, kind], (spans[k][0], kind)
        out, j = [], n
        while j:
            if back[j]:
                out.append((back[j][0], j, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]


def _log_add(v: list[float]) -> float:
    m = max(v)
    return m + float(np.log(np.exp(np.array(v) - m).sum()))


def _marginals(n: int, spans: list, score: np.ndarray) -> np.ndarray:
    """Posterior of each span and kind, by the forward and backward sums."""
    ending, begin = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(spans):
        ending[j].append(k)
        begin[i].append(k)
    fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        fwd[j] = _log_add([fwd[j - 1]] + [fwd[spans[k][0]] + v for k in ending[j] for v in score[k]])
    for i in range(n - 1, -1, -1):
        bwd[i] = _log_add([bwd[i + 1]] + [bwd[spans[k][1]] + v for k in begin[i] for v in score[k]])
    return np.array([np.exp(np.array(score[k]) + fwd[i] + bwd[j] - fwd[n]) for k, (i, j, _) in enumerate(spans)])


def _card(r: random.Random, n: int) -> str:
    body = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(n - 2))
    return next(body + d for d in "0123456789" if luhn(body + d))


def examples(count: int = 500, seed: int = 17) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with their spans (start, kind, end): entities in many spellings, and numbers that are none."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvwz") for _ in range(r.randint(2, 9)))

    def entity() -> tuple[str, int, str]:
        k = r.randrange(4)
        cue = r.choice(CUES[KINDS[k]]) + r.choice([" ", ": "]) if r.random() < 0.3 else ""
        if k == 0:
            name, host, top = word() + r.choice(["", "." + word(), d(2)]), word(), r.choice(["com", "org", "net", "de"])
            return cue, k, r.choice([f"{name}@{host}.{top}", f"{name} (at) {host} (dot) {top}", f"{name}[at]{host}[dot]{top}", f"{name} at {host} dot {top}", f"{name} [at] {host}.{top}", f"{name} @ {host}.{top}"])
        if k == 1:
            return cue, k, r.choice([".", " . ", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4))
        if k == 2:
            c = _card(r, 16)
            quads = [c[i : i + 4] for i in (0, 4, 8, 12)]
            return cue, k, r.choice([c, " ".join(quads), "-".join(quads), ".".join(quads), (a := _card(r, 15))[:4] + " " + a[4:10] + " " + a[10:]])
        a, b, c = d(3), d(3), d(4)
        return cue, k, r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+49 {d(2)} {d(7)}", f"0049 {d(2)} {d(7)}", f"({a}) {b} {c}", f"+1 {a} {b} {c}"])

    def plain() -> str:
        bad = d(15)
        bad += next(x for x in "0123456789" if not luhn(bad + x))
        year, month, day = r.randint(1900, 2030), r.randint(10, 12), r.randint(10, 28)
        return r.choice([
            f"{year}-{month}-{day}", f"{day}/{month}/{year}", f"{day}.{month}.{year}", f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", f"{d(3)},{d(3)}.{d(2)}", bad,
            f"{d(10)}", f"{d(8)}", f"{d(12)}", f"{d(3)} {d(3)} {d(4)} {d(5)} {d(4)}", f"AKIA{d(4)}QX{d(6)}Z", f"{d(3)}ab{d(5)}e{d(8)}", f"{300 + r.randint(0, 600)}.{d(3)}.{d(3)}.{d(2)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            f"{d(2)}:{d(2)}:{d(2)}", f"{year}-{year + 4}", f"{word()} at {word()}", f"page={d(9)}&ref={d(4)}", f"1.2.3.4.{d(1)}.{d(1)}", f"{d(5)} {d(5)} {d(5)}", f"{d(4)} {d(4)} {d(4)}", f"{d(7)}", f"#{d(10)}",
        ])

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 3))) + " "
            if r.random() < 0.55:
                cue, k, s = entity()
                text += cue
                spans.append((len(text), k, len(text) + len(s)))
                text += s + r.choice(["", ",", "."]) + " "
            else:
                text += plain() + r.choice(["", ",", "."]) + " "
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=2)
def train(count: int = 500, epochs: int = 8, seed: int = 17, l2: float = 1e-4) -> Field:
    """Fits the field to the generated sentences; takes seconds, and gives the same weights each time."""
    data = []
    for text, gold in examples(count, seed):
        tokens = [m.span() for m in TOKEN.finditer(text)]
        spans = candidates(text, tokens)
        want = np.zeros((len(spans), len(KINDS)))
        at = {(s, e): k for s, k, e in gold}
        for i, (a, b, _) in enumerate(spans):
            if (k := at.get((tokens[a][0], tokens[b - 1][1]))) is not None:
                want[i, k] = 1
        if spans:
            x = np.zeros((len(spans), len(NAMES)))
            for i, (_, _, f) in enumerate(spans):
                x[i, f] = 1
            data.append((len(tokens), spans, x, want))
    w, g2 = np.zeros((len(NAMES), len(KINDS))), np.full((len(NAMES), len(KINDS)), 1e-6)
    order = list(range(len(data)))
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(order)
        for i in order:
            n, spans, x, want = data[i]
            grad = x.T @ (want - _marginals(n, spans, x @ w)) - l2 * w
            g2 += grad * grad
            w += 0.3 * grad / np.sqrt(g2)
    return Field(w)


def valid(kind: int, s: str) -> bool:
    """The exact check of an added span."""
    digits = NOT_DIGIT.sub("", s)
    if kind == 0:
        return bool(SPELLED.match(s))
    if kind == 1:
        groups = re.findall("[0-9]+", s)
        return len(groups) == 4 and all(map(_octet, groups))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in s)


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans by the field in the stretches around anchors that no base span covers."""
    windows: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        s = m.start()
        for _ in range(3):  # three words to the left, two to the right
            cut = max(text.rfind(" ", max(0, s - 60), s), text.rfind("\n", max(0, s - 60), s))
            s = max(0, s - 60) if cut < 0 else cut
        e = m.end()
        for _ in range(3):
            cut = min((x for x in (text.find(" ", e + 1, e + 60), text.find("\n", e + 1, e + 60)) if x >= 0), default=min(len(text), e + 60))
            e = cut
        if windows and s <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], e)
        else:
            windows.append([max(0, s), e])
    out = []
    at = 0
    for s, e in windows:
        parts, low = [], s
        while at < len(base) and base[at][2] <= s:
            at += 1
        k = at
        while k < len(base) and base[k][0] < e:
            if base[k][0] > low:
                parts.append((low, base[k][0]))
            low = max(low, base[k][2])
            k += 1
        if low < e:
            parts.append((low, e))
        for a, b in parts:
            tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
            for i, j, kind in field.decode(len(tokens), candidates(text, tokens)):
                x, y = tokens[i][0], tokens[j - 1][1]
                if valid(kind, text[x:y]):
                    out.append((x, kind, y))
    return out


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans (all) and n_added for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(train())  # a table of weights, of fixed size

    def fn(c: dict) -> dict:
        base = [base_spans(t) for t in c["text"]]
        more = [added_spans(t, b, held.value) for t, b in zip(c["text"], base, strict=True)]
        out = {"doc_id": c["doc_id"]} | {f"n_{k}": [sum(x[1] == i for x in b) for b in base] for i, k in enumerate(KINDS)}
        out["base_sha256"] = [hashlib.sha256(_named(b).encode()).hexdigest() for b in base]
        out["spans"] = [_named(sorted(b + m)) for b, m in zip(base, more, strict=True)]
        return out | {"n_added": [len(m) for m in more]}

    return arrow_map(rows, fn, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, field: Field) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its kind."""
    base = base_spans(text)
    out, low = [], 0
    for s, k, e in sorted(base + added_spans(text, base, field)):
        if s >= low:
            out += [text[low:s], f"<{KINDS[k].upper()}>"]
        low = max(low, e)
    return "".join([*out, text[low:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data masked in the text column; null texts stay null and all other columns stay."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train())

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mask(t, held.value))

    return docs.withColumn(text_col, masked(F.col(text_col)))
