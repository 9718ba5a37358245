"""Main text of web pages by two-pass block rules.

A page becomes a list of text blocks with their length, link density, stop-word
density and the containers around them. The first pass decides what it can: blocks
inside menus, notices, forms and the like, or made of links, are boilerplate; long
blocks are content if rich in stop words, or if an article element holds them. Short
blocks stay open. In the second pass they inherit the label of the nearest decided
neighbours, those in an article from others in an article only; between two unlike
ones a heading looks to what follows, other blocks to the nearer side, and a tie is
boilerplate. Without any decided neighbour they are content.

The stop words are those of English, French, German and Spanish. Where the long blocks
of a page hold too few of them, its language is taken as unknown, and length and link
density decide alone; ideographs and syllable signs count as three letters there.
Whole pages are read in linear time; nothing is cut.

Defined results: a null or empty html gives the empty text; markup that is never
closed ends with the page; an empty table gives an empty result; repeated rows each
get a row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_of

# Frequent function words of four languages.
STOPS = frozenset(
    "the of and to a in is that it for was on are as with his they at be this from have or by one had not but what all were we when your can there an which their if will other about out many then them these so her would him has no do "
    "le la les de des du un une et est que qui dans en pour pas sur au aux avec ce il elle ne se par plus son sa ses "
    "der die das und ist nicht von zu mit sich auf den dem ein eine als auch es an werden aus er hat dass sie nach bei um noch wie "
    "el los las una y por con para su al lo como pero sus este esta entre cuando muy sin sobre ser donde desde".split()
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg math xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form header menu select button dialog label fieldset object canvas audio video".split())
GOOD_TAGS = frozenset(("article", "main"))
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form tooltip".split())
BAD_WORDS = frozenset(
    "nav navbar navigation menu sidebar aside footer footnav header masthead topbar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay "
    "comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login form search breadcrumb breadcrumbs widget toolbar pagination pager copyright disclaimer hidden skip outbrain taboola".split()
)
GOOD_CLASSES = frozenset("articlebody article-body article-content article-text post-content post-body entry-content story-body story-content".split())
OPENS_AFTERMATH = re.compile(r"(?i)^(?:\d+\s+)?(?:(?:reader|user)s?['’]?\s+)?comments?\b.{0,12}$|^leave an? (?:reply|comment)|^related (?:articles|posts|stories)|^you (?:may|might) also like")

NEXT = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
TAG = re.compile(r"""</?([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"</?([A-Za-z][^\s/>]*)([^>]*)>?")
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/>]|$))""")
HREF = re.compile(r"(?i)(?:^|[\s\"'])href\s*=")
WORD = re.compile(r"[^\W\d_]+")
DENSE_SCRIPT = re.compile("[\u2e80-\ua4cf\uac00-\ud7af\uf900-\ufaff]")
LABEL_WORD = re.compile(r"[a-z0-9]+")

#: A layout wrapper is often named after the menu or sidebar beside the article; an article inside it still counts.
LAYOUT_WORDS = frozenset("sidebar header footer nav menu aside widget".split())
LAYOUT, BAD, OPEN, GOOD = -2, -1, 0, 1


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    heading: bool
    inside: int  # GOOD in an article container, BAD in a boilerplate one, else OPEN
    label: int = OPEN


@dataclass
class _State:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    heading: bool = False
    link: int = -1  # how many elements were open where the link began; -1: outside links


class _Open:
    """Elements that are open, what they make of their inside, and where each tag stands."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def __len__(self) -> int:
        return len(self.stack)

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def inside(self) -> int:
        return self.stack[-1][1] if self.stack else OPEN

    def push(self, tag: str, inside: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, inside))

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def closed_by(self, tag: str) -> int:
        """How many elements stay open after a closing tag; one of an inline element ends no block."""
        at = self.places.get(tag)
        if not at or (tag not in BLOCKS and self.blocks and self.blocks[-1] > at[-1]):
            return len(self.stack)
        return at[-1]


def _container(tag: str, attrs: str, inside: int) -> int:
    """What a new element makes of its inside."""
    if tag in GOOD_TAGS and not attrs:
        return GOOD if inside != BAD else BAD
    by_tag = tag in BAD_TAGS
    words: set[str] = set()
    good = tag in GOOD_TAGS
    bad = tag in BAD_TAGS
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words.update(LABEL_WORD.findall(value))
            good = good or not GOOD_CLASSES.isdisjoint(value.split())
        elif name == "role":
            bad, good = bad or value in BAD_ROLES, good or value == "main"
        elif name == "itemprop":
            good = good or value == "articlebody"
        elif name == "style":
            bad = bad or "display:none" in value.replace(" ", "")
        elif name == "hidden" or value == "true":
            bad = True
    if tag in ("html", "body"):
        return inside
    hits = words & BAD_WORDS
    if inside == GOOD:  # an article has a header of its own
        hits -= {"header"}
        bad = bad and tag != "header"
    if bad or (hits and not (good and not hits & {"comment", "comments", "reply", "related", "ad", "ads", "advert", "sponsored", "promo"})):
        return LAYOUT if not by_tag and not bad and inside != BAD and hits <= LAYOUT_WORDS else BAD
    return GOOD if good and inside != BAD else inside


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    st = _State()
    stack = _Open()
    aftermath = -1  # depth of the container whose rest is comments or related links

    def inside() -> int:
        return BAD if aftermath >= 0 else stack.inside()

    def flush() -> None:
        nonlocal aftermath
        if st.parts:
            raw = "".join(st.parts)
            text = " ".join(raw.split())
            if text:
                links = len("".join(" ".join(st.link_parts).split()))
                st.blocks.append(Block(text, links, st.heading, inside()))
                if st.heading and aftermath < 0 and OPENS_AFTERMATH.match(text):
                    st.blocks[-1].inside = BAD
                    aftermath = len(stack) - (stack.top()[:1] == "h" and stack.top()[1:].isdigit())
            st.parts.clear()
            st.link_parts.clear()

    def add(piece: str) -> None:
        if piece:
            if "&" in piece:
                piece = entities.unescape(piece)
            st.parts.append(piece)
            if st.link >= 0:
                st.link_parts.append(piece)

    def pop_to(at: int) -> None:
        nonlocal aftermath
        stack.pop_to(at)
        if aftermath > at:
            aftermath = -1
        if st.link > at:  # a link that is never closed ends with the element around it
            st.link = -1

    pos, size, breaks = 0, len(page), 0
    while pos < size:
        m = NEXT.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            piece = page[pos : m.start()]
            add(piece)
            if breaks and not piece.isspace():
                breaks = 0
        at = m.start()
        if m[0] == "<!--":
            end = page.find("-->", at + 4)
            pos = size if end < 0 else end + 3
            continue
        if m[0][1] in "!?":
            end = page.find(">", at)
            pos = size if end < 0 else end + 1
            continue
        t = TAG.match(page, at) or LOOSE.match(page, at)
        pos = t.end()
        tag, attrs, closing = t[1].lower(), t[2], page[at + 1] == "/"
        if tag in RAW and not closing:
            flush()
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
                pos = size if end is None else end.end()
            continue
        if tag == "br":
            breaks += 1
            if breaks == 2:
                flush()
            else:
                st.parts.append(" ")
            continue
        breaks = 0
        if tag == "a":
            st.link = -1 if closing or not HREF.search(attrs) else len(stack)
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if closing:
            pop_to(stack.closed_by(tag))
            if block:
                st.heading = False
            continue
        if tag in VOID:
            continue
        if block:
            if stack.top() == "p" or (stack.top() == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option")):
                pop_to(len(stack) - 1)
            st.heading = tag[0] == "h" and tag[1:].isdigit()
        if block or attrs or tag in BAD_TAGS:
            now = _container(tag, attrs, stack.inside())
            if now != stack.inside() and not block and st.parts:
                flush()
            if not attrs.endswith("/"):
                stack.push(tag, now)
    flush()
    return st.blocks


def _letters(text: str) -> int:
    return len(text) + 2 * len(DENSE_SCRIPT.findall(text))


def _stop_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOPS for w in words) / max(1, len(words))


def _nearest(labels: list[int]) -> tuple[list, list]:
    """For each place the last decided one before it and the first after it, as (place, label) or None."""
    found = []
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        seen, last = [None] * len(labels), None
        for i in order:
            seen[i] = last
            last = (i, labels[i]) if labels[i] else last
        found.append(seen)
    return found[0], found[1]


def label(blocks: list[Block], short: int = 70, long: int = 200, stops_low: float = 0.2, stops_high: float = 0.3, links: float = 0.33, known: float = 0.25) -> None:
    """Labels the blocks in place: pass one decides, pass two passes labels on to the short ones."""
    loose = [b.text for b in blocks if b.inside >= OPEN and len(b.text) >= short and b.links <= links * len(b.text)]
    foreign = not loose or _stop_share(" ".join(loose)) < known
    for b in blocks:
        n = len(b.text)
        if b.inside < OPEN or b.links > links * n:
            b.label = BAD
        elif b.inside == GOOD:
            b.label = GOOD if n >= short else OPEN
        elif foreign:
            size = _letters(b.text)
            b.label = GOOD if size >= long or (size >= short and not b.links) else BAD if b.links else OPEN
        elif n < short:
            b.label = BAD if b.links else OPEN
        else:
            share = _stop_share(b.text)
            b.label = GOOD if share >= stops_high or (share >= stops_low and n >= long) else OPEN if share >= stops_low else BAD
    everywhere = _nearest([b.label for b in blocks])
    in_article = _nearest([b.label if b.inside == GOOD else OPEN for b in blocks])
    for i, b in enumerate(blocks):
        if b.label:
            continue
        before, after = in_article if b.inside == GOOD else everywhere
        p, q = before[i], after[i]
        if p is None or q is None or p[1] == q[1]:
            b.label = (p or q or (i, GOOD))[1]
        elif b.heading:
            b.label = q[1]
        else:
            near, far = i - p[0], q[0] - i
            b.label = p[1] if near < far else q[1] if far < near else BAD


def extract(page: str) -> str:
    blocks = blocks_of(page)
    label(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("html"))

    def fn(c: dict) -> dict:
        texts = [extract(h) for h in c["html"]]
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(rows, fn, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
