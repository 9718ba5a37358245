"""The formula language: ``depvar ~ covariates | fixed effects``, IV as ``+ [endog ~ instruments]``.

A formula string is rewritten (legacy IV part, ``^`` between fixed effects, several
dependent variables), its stepwise calls are expanded, and each expansion is parsed to
a ``Formula`` of terms. A term is a product of factors; a factor is a column, a call
or an arithmetic expression, kept as a small tree that ``design`` turns into columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

from ..errors import EndogVarsAsCovarsError, FormulaSyntaxError, InstrumentsAsCovarsError, UnderDeterminedIVError

STEPWISE = ("sw0", "csw0", "mvsw", "csw", "sw")
_CALL = re.compile(r"(?<![\w.])(?:" + "|".join(STEPWISE) + r")\s*\(")
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([^\W\d][\w.]*)|`([^`]+)`|(\"[^\"]*\"|'[^']*')|(\*\*|::|[-+*/:()\[\]{},=^|~]))")


# --- splitting ------------------------------------------------------------------


def split_top(text: str, sep: str) -> list[str]:
    """Splits at sep outside brackets and quotes."""
    out, depth, quote, low = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                raise FormulaSyntaxError(f"unbalanced brackets: {text}")
        elif c == sep and not depth:
            out.append(text[low:i])
            low = i + 1
    if depth or quote:
        raise FormulaSyntaxError(f"unbalanced brackets or quotes: {text}")
    return [x.strip() for x in [*out, text[low:]]]


def rewrite(text: str) -> str:
    """Legacy spellings to the current ones."""
    parts = split_top(text.replace("\n", " ").strip(), "|")
    iv = [p for p in parts[1:] if "~" in p]
    if len(iv) > 1:
        raise FormulaSyntaxError(f"only one endogenous part is allowed: {text}")
    if iv:
        at = parts.index(iv[0])
        parts[0] = f"{parts[0]} + [{iv[0]}]"
        parts = parts[:at] + parts[at + 1 :]
    if len(parts) > 2:
        raise FormulaSyntaxError(f"at most two parts separated by '|': {text}")
    sides = split_top(parts[0], "~")
    if len(sides) != 2 or not all(sides):
        raise FormulaSyntaxError(f"a formula has a left and a right side separated by '~': {text}")
    left = split_top(sides[0], "+")
    if len(left) > 1:
        sides[0] = f"sw({', '.join(left)})"
    out = f"{sides[0]} ~ {sides[1]}"
    if len(parts) == 2 and parts[1] not in ("", "0", "1"):
        out += f" | {parts[1].replace('^', ':')}"
    return out


def expand_stepwise(text: str) -> list[str]:
    """One formula for each choice of the stepwise calls; equal calls choose alike."""
    m = _CALL.search(text)
    if m is None:
        return [text]
    depth, end = 0, m.end() - 1
    for end in range(m.end() - 1, len(text)):
        depth += (text[end] == "(") - (text[end] == ")")
        if not depth:
            break
    else:
        raise FormulaSyntaxError(f"unbalanced brackets: {text}")
    kind = m[0].rstrip("( ").strip()
    args = split_top(text[m.end() : end], ",")
    if len(args) < 2 and kind != "mvsw":
        raise FormulaSyntaxError(f"{kind}() needs at least two arguments: {text}")
    if kind == "mvsw":
        steps = [" + ".join(c) for n in range(1, len(args) + 1) for c in combinations(args, n)]
    elif kind in ("csw", "csw0"):
        steps = [" + ".join(args[: i + 1]) for i in range(len(args))]
    else:
        steps = args
    if kind in ("sw0", "csw0", "mvsw"):
        steps = ["1", *steps]
    call = text[m.start() : end + 1]
    return [x for s in steps for x in expand_stepwise(text.replace(call, s))]


# --- expressions ----------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """kind: name, number, text, call, op or dict; args: children, or (keyword, child) pairs for calls."""

    kind: str
    value: str
    args: tuple = ()
    keywords: tuple = ()

    def __str__(self) -> str:
        if self.kind == "call":
            inner = [str(a) for a in self.args] + [f"{k}={v}" for k, v in self.keywords]
            return f"{self.value}({', '.join(inner)})"
        if self.kind == "op":
            return f"{self.args[0]} {self.value} {self.args[1]}" if len(self.args) == 2 else f"{self.value}{self.args[0]}"
        if self.kind == "dict":
            return "{" + ", ".join(f"{k}: {v}" for k, v in self.args) + "}"
        if self.kind == "list":
            return "[" + ", ".join(map(str, self.args)) + "]"
        return self.value

    def names(self) -> set[str]:
        if self.kind == "name":
            return {self.value}
        out: set[str] = set()
        for a in (*self.args, *[v for _, v in self.keywords]):
            for x in a if isinstance(a, tuple) else (a,):
                out |= x.names() if isinstance(x, Node) else set()
        return out


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise FormulaSyntaxError(f"cannot read {text[at:]!r} in {text!r}")
            kind = ("number", "name", "name", "text", "op")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if value is not None and t[1] != value:
            raise FormulaSyntaxError(f"expected {value!r} in {self.text!r}")
        self.at += 1
        return t

    # arithmetic, inside calls: + - * / ** and unary minus
    def arithmetic(self, floor: int = 0) -> Node:
        power = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 4, "**": 4}
        if self.peek()[1] == "-":
            self.take()
            left = Node("op", "-", (self.arithmetic(3),))
        else:
            left = self.atom()
        while self.peek()[0] == "op" and power.get(self.peek()[1], 0) > floor:
            op = self.take()[1]
            right = self.arithmetic(power[op] - (op in ("**", "^")))
            left = Node("op", "**" if op == "^" else op, (left, right))
        return left

    def atom(self) -> Node:
        kind, value = self.take()
        if kind == "number":
            return Node("number", value)
        if kind == "text":
            return Node("text", value[1:-1])
        if value == "(":
            inner = self.arithmetic()
            self.take(")")
            return inner
        if value == "[":
            items = []
            while self.peek()[1] != "]":
                items.append(self.arithmetic())
                if self.peek()[1] == ",":
                    self.take()
            self.take("]")
            return Node("list", "list", tuple(items))
        if value == "{":
            items = []
            while self.peek()[1] != "}":
                key = self.arithmetic()
                self.take(":")
                items.append((key, self.arithmetic()))
                if self.peek()[1] == ",":
                    self.take()
            self.take("}")
            return Node("dict", "dict", tuple(items))
        if kind == "name" and self.peek()[1] == "(":
            self.take()
            args, keywords = [], []
            while self.peek()[1] != ")":
                if self.peek()[0] == "name" and self.peek(1)[1] == "=":
                    key = self.take()[1]
                    self.take("=")
                    keywords.append((key, self.arithmetic()))
                else:
                    args.append(self.arithmetic())
                if self.peek()[1] == ",":
                    self.take()
            self.take(")")
            return Node("call", value, tuple(args), tuple(keywords))
        if kind == "name":
            return Node("name", value)
        raise FormulaSyntaxError(f"unexpected {value!r} in {self.text!r}")

    # terms: + - * : and brackets; a term is a tuple of factors
    def terms(self) -> tuple[list[tuple[Node, ...]], bool | None]:
        """Terms in order, and whether an intercept was asked for (True), removed (False) or not named."""
        out: list[tuple[Node, ...]] = []
        intercept: bool | None = None
        sign = "+"
        while True:
            if self.peek()[1] in "+-" and self.peek()[0] == "op":
                sign = self.take()[1]
                continue
            kind, value = self.peek()
            nxt = self.peek(1)[1]
            if kind == "number" and value in ("0", "1") and nxt in ("+", "-", "", ")"):
                self.take()
                intercept = (value == "1") == (sign == "+")
            else:
                for t in self.product():
                    if sign == "-":
                        out = [x for x in out if x != t]
                    elif t not in out:
                        out.append(t)
            sign = "+"
            if self.peek()[1] not in ("+", "-"):
                return out, intercept

    def product(self) -> list[tuple[Node, ...]]:
        left = self.colon()
        while self.peek()[1] in ("*", "/"):
            op = self.take()[1]
            right = self.colon()
            both = [_join(a, b) for a in left for b in right]
            left = left + ([] if op == "/" else right) + both
        return left

    def colon(self) -> list[tuple[Node, ...]]:
        left = self.factor()
        while self.peek()[1] == ":":
            self.take()
            right = self.factor()
            left = [_join(a, b) for a in left for b in right]
        return left

    def factor(self) -> list[tuple[Node, ...]]:
        if self.peek()[1] == "(":
            self.take()
            inner, _ = self.terms()
            self.take(")")
            power = 1
            if self.peek()[1] == "**":
                self.take()
                power = int(self.take()[1])
            out = inner
            for _ in range(power - 1):
                out = list(dict.fromkeys(out + [_join(a, b) for a in out for b in inner]))
            return out
        return [(self.atom(),)]


def _join(a: tuple[Node, ...], b: tuple[Node, ...]) -> tuple[Node, ...]:
    return a + tuple(x for x in b if x not in a)


def parse_terms(text: str) -> tuple[list[tuple[Node, ...]], bool | None]:
    reader = _Reader(text)
    if not reader.tokens:
        return [], None
    out = reader.terms()
    if reader.peek()[0] != "end":
        raise FormulaSyntaxError(f"unexpected {reader.peek()[1]!r} in {text!r}")
    return out


def term_name(term: tuple[Node, ...]) -> str:
    return ":".join(map(str, term))


@dataclass(frozen=True)
class Formula:
    """One model: dependent term, covariate terms, fixed effects as tuples of columns, and the IV block."""

    text: str
    dependent: Node
    exogenous: tuple
    intercept: bool
    fixed_effects: tuple
    endogenous: tuple = ()
    instruments: tuple = ()
    _: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def is_iv(self) -> bool:
        return bool(self.endogenous)

    @property
    def fe_name(self) -> str:
        return "+".join(":".join(f) for f in self.fixed_effects) or "0"

    @property
    def depvar(self) -> str:
        return str(self.dependent)

    @staticmethod
    def parse(text: str) -> list[Formula]:
        """All models that a formula stands for, in order."""
        return [_parse_one(x) for x in expand_stepwise(rewrite(text))]


def _parse_one(text: str) -> Formula:
    parts = split_top(text, "|")
    sides = split_top(parts[0], "~")
    if len(sides) != 2:
        raise FormulaSyntaxError(f"a formula has a left and a right side separated by '~': {text}")
    left = _Reader(sides[0])
    dependent = left.arithmetic()
    if left.peek()[0] != "end":
        raise FormulaSyntaxError(f"one dependent term is allowed: {text}")
    blocks = re.findall(r"\[([^\[\]]*~[^\[\]]*)\]", sides[1])
    if len(blocks) > 1:
        raise FormulaSyntaxError(f"only one endogenous part is allowed: {text}")
    rest = re.sub(r"\s*\+?\s*\[[^\[\]]*~[^\[\]]*\]", "", sides[1]).strip().lstrip("+").strip()
    terms, intercept = parse_terms(rest)
    fixed: list[tuple[str, ...]] = []
    if len(parts) == 2:
        for t in parse_terms(parts[1])[0]:
            if any(n.kind != "name" for n in t):
                raise FormulaSyntaxError(f"fixed effects are columns: {parts[1]}")
            fixed.append(tuple(n.value for n in t))
    endogenous: tuple = ()
    instruments: tuple = ()
    if blocks:
        e, z = (tuple(parse_terms(x)[0]) for x in split_top(blocks[0], "~"))
        endogenous, instruments = e, z
        if len(e) != 1:
            raise FormulaSyntaxError("exactly one endogenous variable is supported")
        if len(z) < len(e):
            raise UnderDeterminedIVError("the system needs at least as many instruments as endogenous variables")
        used = {n for t in terms for x in t for n in x.names()}
        if used & {n for t in e for x in t for n in x.names()}:
            raise EndogVarsAsCovarsError("an endogenous variable is also a covariate")
        if used & {n for t in z for x in t for n in x.names()}:
            raise InstrumentsAsCovarsError("an instrument is also a covariate")
    return Formula(text, dependent, tuple(terms), (intercept is not False) and not fixed, tuple(fixed), endogenous, instruments)
