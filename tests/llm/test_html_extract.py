import html
import random
import re
import time

from pyspark.sql import functions as F

from regmesh.llm.html_extract import BAD, GOOD, OPEN, STOPS, Block, blocks_of, extract, label, main_text

PARA = "The river is one of the longest in the region and it has been used for the transport of goods since the time when the first towns were built on its banks by people who came from the north of the country in search of land."
MIXED = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="no-sidebar">
<header class="site-header"><a href=/>Home</a> Slogan of the site that is here for all of the people</header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>{PARA}</p></div>
<div><h1>Rivers &amp; towns</h1><p>{PARA}&nbsp;&#8212; {PARA}<p>Short one.</p><p>{PARA}</p></div>
<form><p>{PARA}</p><textarea>x</textarea></form>
<section id="comments"><h2>Comments</h2><div class="comment"><p>{PARA}</p></div></section>
<aside><p>{PARA}</p></aside><div class="ad">Buy</div><!-- <p>{PARA}</p> --><footer>&copy; all of us</footer></body></html>"""


def test_text_rules_without_an_article():
    assert extract(MIXED) == f"Rivers & towns\n{PARA} — {PARA}\nShort one.\n{PARA}"


def test_article_with_parts_that_are_none():
    page = f"""<body><div class="layout sidebar-left"><article><header><h1>Head</h1></header><p>{PARA}</p><div class="ad-box">Buy <b>now</b></div>
    <ul><li>first<li>second</ul><h2>Comments</h2><p>{PARA}</p></article></div><p>{PARA}</p></body>"""
    assert extract(page) == f"Head\n{PARA}\nfirst\nsecond\n{PARA}"  # the comments end with the article; what follows is judged by the rules


def test_hard_markup_ends():
    for page in ("", "<", "<a", "<script>x", "<!-- x", "a < b & c", "<p a='", "<" * 3000, '<a "' * 500, "<div>" * 3000 + PARA):
        assert isinstance(extract(page), str)
    assert [b.text for b in blocks_of("a<br>b<br><br>c")] == ["a b", "c"]


def test_table_matches_the_article_element(spark, tiny_dir):
    pages = spark.read.parquet(f"{tiny_dir}/pages.parquet").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        want = "\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_nulls(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", MIXED)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and sum(r.text == "" and r.n_chars == 0 for r in got) == 3
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_link_around_blocks_stays_a_link():
    assert extract(f'<body><a href="/x"><div>{PARA}</div><p>{PARA}</p></a><p>{PARA}</p></body>') == PARA
    assert extract(f'<body><div><a href="/x">teaser</div><p>{PARA}</p><a name="here"><p>{PARA}</p></body>') == f"{PARA}\n{PARA}"


def test_other_languages_go_by_length_and_links():
    italian = "Il fiume attraversa tutta la regione, dalle montagne fino al mare, ed è stato usato per secoli dai mercanti che portavano sale, legno e stoffe verso le città costruite sulle sue rive."
    chinese = "这条河流是该地区最长的河流之一，自从第一批城镇在河岸上建成以来，它就一直被用来运输货物，来自北方的人们也沿着它寻找新的土地。" * 2
    for text in (italian, chinese):
        links = "".join(f'<li><a href="/{i}">{text[:30]}</a></li>' for i in range(9))
        assert extract(f"<body><div><ul>{links}</ul></div><div><h1>{text[:12]}</h1><p>{text}</p></div><footer>{text}</footer></body>") == f"{text[:12]}\n{text}"


def test_text_outside_the_article_is_judged_by_the_rules():
    page = f'<body><p>{PARA}</p><p>Buy now, buy cheap, free shipping, best price, top quality, limited offer, order today!</p><article><p>{PARA}</p><p>End.</p></article><div><a href="/a">More</a></div></body>'
    assert extract(page) == f"{PARA}\n{PARA}\nEnd."
    assert extract("<p>Just a line.</p>") == "Just a line."


def test_time_is_linear_in_the_markup():
    for page in ("<div>" * 40_000 + "</span>" * 40_000, "<span class=x>" * 40_000 + "</div>" * 40_000, '<a href="x"><div>' * 30_000, "<p>" + "a<br>" * 100_000, "<p a='" * 50_000, "<b" * 100_000, "<div " + 'a="b' * 50_000):
        began = time.perf_counter()
        extract(page)
        assert time.perf_counter() - began < 8


def naive_label(blocks):
    """The rules again, one block at a time, by the definitions."""
    share = lambda t: (lambda w: sum(x in STOPS for x in w) / max(1, len(w)))([x for x in re.split(r"[\W\d_]+", t.lower()) if x])
    open_blocks = [b for b in blocks if b.inside != BAD and len(b.text) >= 70 and b.links / len(b.text) <= 0.33]
    unknown = not open_blocks or share(" ".join(b.text for b in open_blocks)) < 0.25
    first = []
    for b in blocks:
        n = len(b.text)
        if b.inside == BAD or b.links / n > 0.33:
            first.append(BAD)
        elif b.inside == GOOD:
            first.append(GOOD if n >= 70 else OPEN)
        elif unknown:
            first.append(GOOD if n >= 200 or (n >= 70 and b.links == 0) else BAD if b.links else OPEN)
        elif n < 70:
            first.append(BAD if b.links else OPEN)
        else:
            s = share(b.text)
            first.append(BAD if s < 0.2 else GOOD if s >= 0.3 or n >= 200 else OPEN)
    out = []
    for i, b in enumerate(blocks):
        decided = [(abs(j - i), j > i, first[j]) for j in range(len(blocks)) if first[j] and (b.inside != GOOD or blocks[j].inside == GOOD)]
        left, right = min((d for d in decided if not d[1]), default=None), min((d for d in decided if d[1]), default=None)
        if first[i]:
            out.append(first[i])
        elif not left or not right:
            out.append((left or right or (0, 0, GOOD))[2])
        elif b.heading:
            out.append(right[2])
        else:
            out.append(left[2] if left[0] < right[0] else right[2] if right[0] < left[0] else left[2] if left[2] == right[2] else BAD)
    return out


def test_labels_match_the_definitions():
    rng = random.Random(3)
    words = "the of and to in is was river town sale price offer le der que casa holz".split()
    for _ in range(600):
        pool = words[: rng.choice((7, 11, 16))] if rng.random() < 0.8 else words[7:]
        blocks = []
        for _ in range(rng.randrange(1, 14)):
            text = " ".join(rng.choice(pool) for _ in range(rng.choice((1, 3, 8, 16, 25, 50, 80))))
            blocks.append(Block(text, rng.choice((0, 0, 0, len(text) // 5, len(text) // 2)), rng.random() < 0.2, rng.choice((OPEN, OPEN, OPEN, GOOD, GOOD, BAD))))
        want = naive_label(blocks)
        label(blocks)
        assert [b.label for b in blocks] == want
