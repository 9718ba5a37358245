import random
import re

import numpy as np
from pyspark.sql import functions as F

from regmesh.llm import decontaminate as dc

ITEM = "Alice paid 12 dollars and met Bob who owes 12 more. Later on the same day Alice counted how many coins of 5 cents her brother Bob still had hidden in the old kitchen jar."


def brute_pairs(docs, items, coverage):
    """Pairs by plain comparison of template windows, for texts without slots that conflict."""
    canon, out = dc.Canon(), set()
    for item, text in items:
        il, ik, _ = dc.Canon().template(text or "")
        size = min(dc.WINDOW, len(il))
        if size < dc.LEAST:
            continue
        mine = [(i, tuple(il[i : i + size].tolist())) for i in range(len(il) - size + 1) if 2 * sum(ik[i : i + size] == dc.LITERAL) >= size]
        for doc, t in docs:
            dl, _, _ = canon.template(t or "")
            have = {tuple(dl[p : p + size].tolist()) for p in range(len(dl) - size + 1)}
            covered = {k for i, w in mine if w in have for k in range(i, i + size)}
            if covered and len(covered) >= coverage * len(il):
                out.add((doc, item))
    return out


def test_both_paths_match_brute_force(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    bench = spark.read.parquet(f"{tiny_dir}/benchmark.parquet")
    want = brute_pairs([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()], 0.5)
    a = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    b = {(r.doc_id, r.item_id) for r in dc.leaks(docs.withColumn("h", F.lit(0)), bench, broadcast_windows=0).collect()}
    plain = {(r.doc_id, i.item_id) for r in docs.collect() for i in bench.collect() if i.text in r.text}
    assert a == b == want and plain <= a and plain


def test_reparameterised_questions_and_slots(spark):
    swap = lambda s, m: re.sub("|".join(m), lambda x: m[x[0]], s)
    rows = [
        (1, "Intro words here. " + ITEM), (2, swap(ITEM, {"Alice": "Carol", "Bob": "Dave", "12": "47", "dollars": "euros", "5": "9"})),
        (3, "Nothing of the sort is said in here, only words."), (4, None), (5, ""), (6, ITEM[:40]), (None, ITEM), (1, "Intro words here. " + ITEM),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short")], "item_id long, text string")
    for limit in (0, 10**6):
        got = {(r.doc_id, r.item_id): r.verbatim for r in dc.leaks(docs, bench, broadcast_windows=limit).collect()}
        assert got == {(1, 7): True, (2, 7): False, (None, 7): True}
    assert sorted(r.doc_id or 0 for r in dc.drop_leaks(docs, bench).collect()) == [3, 4, 5, 6]
    assert dc.leaks(docs.limit(0), bench).count() == 0 and dc.leaks(docs, bench.limit(0)).count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    half = ITEM.split()
    cut = len(half) // 2
    long = "So they said. " * 4000
    rows = [
        (1, "Some words before. " + ITEM), (1, long + ITEM.replace("12", "47")), (1, "a clean row of the same id that stays"), (2, " ".join(half[: cut - 4])), (2, " ".join(half[cut + 4 :])), (3, None),
        (None, "For nobody. " + ITEM), (None, "another clean row without an id"), (4, "x " + ITEM + " " + ITEM), (4, "x " + ITEM + " " + ITEM),
    ]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, k1 int, h int")
    other = "how many of the small grey birds that nest on the cliffs come back in spring"
    bench = spark.createDataFrame([("a", ITEM), ("a", ITEM.replace("jar", "tin")), (None, ITEM), ("b", other), (None, None)], "item_id string, text string")
    got = [sorted(map(str, dc.leaks(docs, bench, coverage=0.9, broadcast_windows=n).collect())) for n in (0, 10**6)]
    pairs = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench, coverage=0.9).collect()}
    assert got[0] == got[1] and len(got[0]) == len(pairs) and pairs == {(d, i) for d in (1, None, 4) for i in ("a", None)}
    for n in (0, 10**6):
        kept = dc.drop_leaks(docs, bench, coverage=0.9, broadcast_windows=n)
        assert kept.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (rows[k] for k in (2, 3, 4, 5, 7))))


def plain_canon(text):
    """An independent reading of the template rules for plain ASCII prose: (kind, value) of each token."""
    out, opens = [], True
    for w in re.findall(r"[A-Za-z][A-Za-z0-9]*|\d+|[.!?:\n]", text):
        if w in ".!?:\n":
            opens = True
            continue
        if w.isdigit():
            out.append(("number", w))
        elif w.lower() in dc.UNITS:
            out.append(("unit", w.lower()))
        elif w.istitle() and len(w) > 1 and not opens:
            out.append(("name", w.lower()))
        else:
            out.append(("word", w.lower()))
        opens = False
    return out


def test_one_variant_against_plain_comparison(spark):
    rng = random.Random(5)
    nouns, names = "boats fish nets ropes sails oars hooks planks lamps casks".split(), "Anna Boris Clara David Elena Frank Greta Henry".split()

    def question():
        """Words of its own, with numbers, names and units between, and its values."""
        frame = [rng.choice(nouns + ["word%d" % rng.randrange(50)]) for _ in range(24)]
        for k in rng.sample(range(2, 22), 5):
            frame[k] = rng.choice(("<n>", "<p>", "<u>"))
        return frame

    def fill(frame):
        pick = {"<n>": lambda: str(rng.randrange(2, 999)), "<p>": lambda: rng.choice(names), "<u>": lambda: rng.choice(("miles", "hours", "pounds"))}
        return " ".join(["so"] + [pick[w]() if w in pick else w for w in frame]) + " are there."

    frames = [question() for _ in range(40)]
    items = [(i, fill(f)) for i, f in enumerate(frames)]
    docs = [(i, ("they say that " * rng.randrange(3) + fill(frames[i % 40]) if i % 3 else fill(question()))) for i in range(120)]
    want = set()
    for item, text in items:
        mine = plain_canon(text)
        for doc, other in docs:
            theirs = plain_canon(other)
            best = 0
            for shift in range(-len(mine), len(theirs)):  # one variant at most: windows of one alignment, one value a slot
                value, covered = {}, set()
                for i in range(len(mine) - 7):
                    d = i + shift
                    if d < 0 or d + 8 > len(theirs):
                        continue
                    a, b = mine[i : i + 8], theirs[d : d + 8]
                    if any(x[0] != y[0] or (x[0] == "word" and x[1] != y[1]) for x, y in zip(a, b, strict=True)) or 2 * sum(x[0] == "word" for x in a) < 8:
                        continue
                    if all(value.setdefault(x, y[1]) == y[1] for x, y in zip(a, b, strict=True) if x[0] != "word"):
                        covered.update(range(i, i + 8))
                best = max(best, len(covered))
            if best * 2 >= len(mine):
                want.add((doc, item))
    assert len(want) > 40
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for n in (0, 10**6):
        got = {(r.doc_id, r.item_id) for r in dc.leaks(d, b, broadcast_windows=n).collect()}
        assert got == want


def test_inconsistent_slots_do_not_count():
    index = dc.item_windows([(1, ITEM)])
    _, size, kinds, words = index["items"][0]
    doc = list(words)
    at = [i for i, w in enumerate(words) if w == "Bob"]
    doc[at[1]] = "Mallory"  # the second Bob is someone else
    pairs = [(p, p) for p in range(len(words) - size + 1)]
    n, same, kept = dc.consistent_cover(pairs, size, kinds, words, lambda p: doc[p : p + size])
    assert 0 < kept < len(pairs) and not same or n < len(words)


def test_verbatim_copies_of_short_and_placeholder_items(spark):
    items = ["What is 12 + 7 * 3 - 45 / 9?", "Which of Mercury, Venus, Earth, Mars, Jupiter, Saturn, Uranus, Neptune has rings?", "Solve 3x + 5 = 20.", "What is rain"]
    docs = spark.createDataFrame([*((i, f"Some page says a) {t} and goes on.") for i, t in enumerate(items)), (9, "What is 13 + 8 * 4 - 46 / 10? Solve 4x + 6 = 21.")], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for limit in (0, 10**6):
        got = {(r.doc_id, r.item_id, r.coverage, r.verbatim) for r in dc.leaks(docs, bench, broadcast_windows=limit).collect()}
        assert got == {(i, i, 1.0, True) for i in range(len(items))}


def variants(n, seed, verbatim=False):
    """An item of 20 tokens with a number at every fourth, and a page with n variants of it, one of them verbatim on demand."""
    rng = random.Random(seed)
    words = "pack carry stack bring crates barrels sacks boxes over under behind along docks yards sheds lanes".split()
    write = lambda v: " ".join(" ".join([*words[3 * k : 3 * k + 3], str(v[k])]) for k in range(5)) + "."
    draw = lambda: rng.sample(range(10, 100), 5)
    item = draw()
    page = [item if verbatim and k == n // 2 else draw() for k in range(n)]
    return write(item), " ".join(map(write, page))


def test_several_variants_in_one_document(spark):
    rows, items = [], []
    for n in (1, 2, 10):
        for seed in range(20):
            for verbatim in (False, True):
                item, page = variants(n, seed, verbatim)
                items.append((len(items), " ".join(f"w{len(items)}{w}" if w.isalpha() else w for w in item.split())))
                rows.append((len(rows), " ".join(f"w{len(rows)}{w}" if w.isalpha() else w for w in page.split())))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (0, 10**6):
        got = {r.doc_id: r for r in dc.leaks(docs, bench, broadcast_windows=limit).collect()}
        assert len(got) == len(rows) and all(r.coverage == 1.0 and r.doc_id == r.item_id for r in got.values())
        assert all(got[i].verbatim for i in range(1, len(rows), 2))


def test_names_that_open_sentences_and_formats_of_numbers(spark):
    names = "Alice has 5 apples. Bob has 3 apples. Carol has 2 apples. How many in total?"
    shop = "A shop sold 950 pens on one day and -3 on the next. It took 1200 coins for all of them, which makes how much a pen?"
    rows = [
        (1, "Some page. Dan has 6 apples. Eve has 4 apples. Frank has 3 apples. How many in total?"),
        (2, "1) A shop sold 1,200 pens on one day and 3.5 on the next. It took 1.234,50 coins for all of them, which makes how much a pen?"),
        (3, "They said that Dan has 6 apples. Eve has 4 apples. And then Frank has 3 apples. How many in total?"),
    ]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, names), (2, shop)], "item_id long, text string")
    for limit in (0, 10**6):
        got = {(r.doc_id, r.item_id): r.coverage for r in dc.leaks(docs, bench, broadcast_windows=limit).collect()}
        assert set(got) == {(1, 1), (2, 2), (3, 1)} and got[1, 1] == 1.0 and got[2, 2] == 1.0


def test_numbers_are_one_token():
    words = lambda s: dc.Canon().template(s)[2]()
    assert words("1,200 or 3.5 or -7 or .5 in 1999, 2000. Then 3x and 1\u2019000.") == ["1,200", "or", "3.5", "or", "-7", "or", ".5", "in", "1999", "2000", "Then", "3x", "and", "1\u2019000"]
    assert words("covid-19 10-15 v1 33x end.5 a.b") == ["covid", "19", "10", "15", "v1", "33x", "end", "5", "a", "b"]
    plain = np.array([3, 5, 7, 11] * 5000, np.uint64)
    want = [sum(int(plain[i + k]) * int(dc._BASE[k]) for k in range(8)) % (1 << 64) ^ 8 for i in (0, 1, 8190, 8191, 8192, 8193, 19992)]
    assert dc.window_hashes(plain, 8)[[0, 1, 8190, 8191, 8192, 8193, 19992]].tolist() == want
