import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regmesh.llm import quality_classifier as qc
from regmesh.llm import quality_rules as qr
from regmesh.llm import toxicity as tx


def brute_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in lines
            lines.add(line)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {k for at in grams.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts_match_brute_force(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = [(9001, None, None, None), (9001, None, "en", None), (9002, "", "en", "s"), (None, "a b " * 40, "en", "s"), (9003, "x\n\nx\n \n \r\nx", "en", "s"), (9004, "é\x0bü ñ " * 5000, "fr", "s")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("kept", F.lit(0)).withColumn("grp", F.lit(0))
    want = sorted(((str(r.doc_id), brute_counts(r.text)) for r in docs.collect()), key=str)
    got = qr.quality_rules(docs).collect()
    assert sorted(((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert qr.quality_rules(docs.limit(0)).count() == 0


def test_scatter_resists_a_quarter_of_outliers(spark):
    rng = np.random.default_rng(2)
    clean, bad = rng.normal(0, 1, (3000, qr.DIMS)), rng.normal(25, 1, (600, qr.DIMS))
    rows = spark.createDataFrame([("g", x.tolist()) for x in np.vstack([clean, bad])], "grp string, x array<double>")
    from regmesh.llm.common import Scratch

    r = qr.fit_mcd(rows, Scratch(spark, "test"), ridge=0.001).first()
    z = clean - np.array(r.m)
    d2 = np.einsum("ij,jk,ik->i", z, qr._square(r.p), z)
    assert np.abs(np.array(r.m)).max() < 0.15 and 4.3 < np.median(d2) < 6.4  # the median of chi-squared is 5.35


def test_consistency_and_bounds():
    x = np.random.default_rng(3).normal(0, 1, (400_000, qr.DIMS))
    d2 = (x * x).sum(axis=1)
    for h in (0.5, 0.75, 0.9):
        near = x[d2 <= np.quantile(d2, h)]
        assert abs(qr.consistency(h) * near.var() - 1) < 0.01
    assert abs((d2 > qr.chi2_bound(0.025)).mean() - 0.025) < 0.002 and abs(qr.chi2_bound(0.025) - 14.449) < 0.01


def test_least_determinant_matches_all_subsets_of_small_groups(spark):
    """Brute force: the determinant of every subset of nine rows out of twelve."""
    from regmesh.llm.common import Scratch

    rng = np.random.default_rng(11)
    groups = {}
    for g in range(6):
        x = rng.normal(0, 1, (12, qr.DIMS)) @ (np.eye(qr.DIMS) + 0.4 * rng.normal(0, 1, (qr.DIMS, qr.DIMS)))
        x[:3] += rng.normal(0, 1, (3, qr.DIMS)) + 15 * rng.choice((-1, 1), (3, 1))
        groups[f"g{g}"] = x
    rows = spark.createDataFrame([(g, r.tolist()) for g, x in groups.items() for r in x], "grp string, x array<double>")
    target = qr.pooled_scales(rows)
    got = {r.grp: r for r in qr.fit_mcd(rows, Scratch(spark, "test")).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        best = min((qr.ridged(np.cov(x[list(s)].T, bias=True), target, 0.1)[1], s) for s in itertools.combinations(range(12), 9))
        mine = -np.linalg.slogdet(qr._square(got[g].p) * qr.consistency(0.75))[1]
        assert abs(mine - best[0]) < 1e-6 and np.allclose(got[g].m, x[list(best[1])].mean(axis=0))


def test_groups_of_copies_and_constant_statistics(spark):
    words = "the of and to a in is it you that he was for on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()
    rng = np.random.default_rng(4)
    clean = [" ".join(rng.choice(words, rng.integers(60, 400))) + "." for _ in range(260)]
    copies = [clean[0]] * 600
    junk = ["#$% " * 3 + " ".join("%X$Y|Z&"[k % 5 :] + str(k) for k in range(80))] * 3
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*clean, *copies, *junk])], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in qr.quality_rules(docs).collect()}
    kept = [got[i].kept for i in range(860)]
    assert sum(kept) >= 0.99 * 860 and all(kept[260:]) and not any(got[i].kept for i in range(860, 863))


@pytest.mark.parametrize("few", [0, 10**6])
def test_broadcast_and_shuffle_agree(spark, tiny_dir, few, monkeypatch):
    monkeypatch.setattr(qr, "FEW", few)
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    got = {r.doc_id: (r.kept, r.distance2 and round(r.distance2, 6)) for r in qr.quality_rules(docs).collect()}
    _SEEN.setdefault("first", got)
    assert got == _SEEN["first"] and len(got) == docs.count()


_SEEN: dict = {}


def test_junk_goes_and_clean_stays(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = qr.quality_rules(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in got}
    assert share[1] > 0.995 and share[0] < 0.05


@pytest.mark.parametrize("module, label, mod, rest", [(qc, "quality", 4, 2), (tx, "toxic", 5, 0)])
def test_held_out_accuracy(spark, module, label, mod, rest):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = module.classify(docs, labels)
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("right"), F.avg(F.when(F.col(label) == 1, F.col("predicted"))).alias("recall")).first()
    assert r.right > 0.97 and r.recall > 0.85
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest)).count() == 0


@pytest.mark.parametrize("module", [qc, tx])
def test_labels_of_the_held_out_fold_do_not_matter(spark, sf_dir, module):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = (crc % 4 == 2) if module is qc else (crc % 5 == 0)
    flipped = labels.select("doc_id", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    a, b = (sorted(tuple(r) for r in module.classify(docs, x).collect()) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("module", [qc, tx])
def test_nulls_and_empty_tables(spark, module):
    docs = spark.createDataFrame([(1, None, 5.0), (1, "", 1.0), (None, "idiot " * 9, 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        got = module.classify(docs, labels).collect()
        assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert module.classify(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("module", [qc, tx])
def test_repeated_ids_long_texts_and_labels_that_disagree(spark, sf_dir, module):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    base = {r.doc_id: r.score for r in module.classify(docs, labels).collect()}
    again = docs.unionByName(docs).unionByName(docs.where("doc_id % 7 = 0")).withColumn("y", F.lit(9)).withColumn("role", F.lit(9)).withColumn("x", F.lit(9))
    got = module.classify(again, labels.unionByName(labels)).collect()
    assert len(got) == again.count() and all(abs(base[r.doc_id] - r.score) < 1e-9 for r in got)
    long = spark.createDataFrame([(1, "word and other words " * 200_000), (2, "x" * 2_000_000)], "doc_id long, text string")
    both = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in module.classify(long, both).collect())


def test_prior_is_estimated_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(8)
    for share in (0.3, 0.6, 0.9):
        n = 4000
        good, bad = rng.normal(0, 1, (2 * n, qc.FEATURES)), rng.normal(0, 1, (n, qc.FEATURES)) + 2
        unl = np.vstack([good[n : n + int(share * n)], bad[: n - int(share * n)]])
        m = qc.fit(good[:n], unl)
        assert abs(m.prior - share) < 0.06
        assert (m.score(bad[: n // 2]) < 0.5).mean() > 0.95


def test_pairs_of_terms_have_weights_of_their_own():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2), rng.integers(0, 2)
        rows.append(np.array(sorted([10 + a, 20 + b, 100 + rng.integers(0, 50)])))
        y.append(int(a == 1 and b == 1))
    m = tx.fit(rows, np.array(y), np.ones(len(y)), epochs=40)
    slot = lambda r: [s for s in m.slot[r] if s >= 0]
    s = m.score_terms([np.array(slot(np.array([10 + a, 20 + b]))) for a, b in ((1, 1), (1, 0), (0, 1), (0, 0))])
    assert s[0] > 0.7 and s[1:].max() < 0.35


def test_risk_stays_right_when_positives_are_common():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0, 1, (4000, qc.FEATURES)), rng.normal(0, 1, (4000, qc.FEATURES)) + 3
    unl = np.vstack([good[2000:], bad[:600]])
    m = qc.fit(good[:2000], unl)
    assert 0.5 < m.prior < 0.95
    assert (m.score(good[:2000]) > 0.5).mean() > 0.9 and (m.score(bad[2000:]) < 0.5).mean() > 0.9


def test_machine_scores_are_sums_over_pairs():
    rng = np.random.default_rng(6)
    m = tx.Machine(np.arange(20), 0.3, rng.normal(size=20), rng.normal(size=(20, 5)))
    for size in (0, 1, 2, 7, 20):
        r = np.sort(rng.choice(20, size, replace=False))
        raw = 0.3 + sum(m.w[i] for i in r) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(r, 2))
        assert m.score_terms([r])[0] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_no_nearby_weights_have_a_smaller_risk():
    """The stated risk, written out, at the fit and around it."""
    rng = np.random.default_rng(5)
    pos, unl = rng.normal(0, 1, (1500, qc.FEATURES)), np.vstack([rng.normal(0, 1, (1400, qc.FEATURES)), rng.normal(0.4, 1, (600, qc.FEATURES))])
    m = qc.fit(pos, unl, steps=3000, rate=0.01, l2=0.02, prior=0.7)  # strong enough a penalty that the bound at zero stays away

    def risk(w, bias):
        f = lambda x: (x[:, :, None] > m.edges[None]).reshape(len(x), -1) @ w + bias
        loss = lambda v: np.log1p(np.exp(-v)).mean()
        p, u = f(pos), f(unl)
        return 0.7 * loss(p) + max(0.0, loss(-u) - 0.7 * loss(-p)) + 0.01 * (w @ w + bias * bias)

    best = risk(m.weights, m.bias)
    for scale in (0.02, 0.1, 0.5):
        for _ in range(40):
            assert risk(m.weights + scale * rng.normal(size=len(m.weights)), m.bias + scale * rng.normal()) > best - 2e-4
