import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgate.llm import lm_logbilinear, quality_knn, topk_pivot, toxicity_ssk


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    syllables = ["ka", "lo", "mi", "ren", "tu", "sol", "vex", "dra", "pin", "qua"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(500):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["blorgh", "snarfle", "gruntz"]))
        text = " ".join(words).capitalize() + "."
        bad = i % 7 == 0
        rows.append((i, " | ".join(words) if bad else text, 0.5, "x", 1))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, 0.5, "x", 1), (1001, "", 0.5, "x", 1), (None, "Ka lo mi.", 0.5, "x", 1), (1002, "ka lo " * 20000, 0.5, "x", 1), (0, rows[0][1], 0.5, "x", 1)]
    labels += [(None, 1, 0), (1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, k0 string, label int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def check(got, labels, pos, cut, at_least):
    want = {r[0]: r[pos] for r in labels if r[0] is not None and r[pos] is not None}
    held = [(want[r.doc_id], r.score >= cut) for r in got if r.doc_id in want and r.doc_id % 3 == 0]
    assert sum(bool(a) == b for a, b in held) / len(held) >= at_least and all(0 <= r.score <= 1 for r in got)


def test_quality_held_out(spark, labelled):
    docs, labels, known = labelled
    voters = quality_knn.train(docs, labels, "quality", F.col("doc_id") % 3 != 0)
    got = quality_knn.score_quality(docs, voters, keep=["k0"])
    rows = got.collect()
    assert len(rows) == docs.count()
    check(rows, known, 1, 0.3, 0.98)
    assert {r.score for r in rows if r.doc_id in (1000, 1001)} == {0.5}
    assert {r.score for r in quality_knn.score_quality(docs, quality_knn.train(docs, labels.limit(0), "quality", F.lit(True))).collect()} == {0.5}
    assert quality_knn.score_quality(docs.limit(0), voters).collect() == []


def test_votes_are_exact_nearest_neighbours():
    rng = np.random.default_rng(1)
    counts, labels = rng.random((300, quality_knn.TERMS)).astype(np.float32), rng.integers(0, 2, 300)
    v = quality_knn.fit(counts, labels)
    new = rng.random((40, quality_knn.TERMS)).astype(np.float32)
    cos = np.maximum(0, quality_knn.project(new, v.idf, v.axes) @ v.vectors.T)
    for row, score in zip(cos, quality_knn.vote(v, new)):
        row = np.round(row, 5)
        near = np.argsort(-row, kind="stable")[: quality_knn.NEIGHBOURS]
        w = row[near] ** quality_knn.POWER
        assert abs(score - (w * v.labels[near]).sum() / w.sum()) < 1e-5


def test_toxicity_held_out_and_tolerant(spark, labelled):
    docs, labels, known = labelled
    machine = toxicity_ssk.train(docs, labels, "toxic", F.col("doc_id") % 3 != 0)
    more = spark.createDataFrame([(2000, "ka lo blorxgh mi"), (2001, "ka b-l-o-r-g-h ren"), (2002, "ka b l o r g h ren"), (2003, "ka lo mi ren tu")], "doc_id long, text string")
    got = toxicity_ssk.score_toxicity(docs.select("doc_id", "text").unionByName(more), machine).collect()
    check(got, known, 2, 0.7, 0.98)
    score = {r.doc_id: r.score for r in got}
    assert min(score[2000], score[2001], score[2002]) >= 0.7 > score[2003] and score[1000] == score[1001] == 0
    assert {r.score for r in toxicity_ssk.score_toxicity(docs, toxicity_ssk.train(docs, labels.limit(0), "toxic", F.lit(True))).collect()} == {0.0}
    assert toxicity_ssk.score_toxicity(docs.limit(0), machine).collect() == []


def test_subsequence_kernel_against_its_definition():
    words = [b"abcab", b"aaa", b"xyzzy", b"abxcab"]
    phi = []
    for c in toxicity_ssk.coded(words):
        f = Counter()
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, len(c)):
                    f[int(c[i]), int(c[j]), int(c[k])] += toxicity_ssk.DECAY ** (k - i + 1)
        phi.append(f)
    dot = lambda a, b: sum(v * b[k] for k, v in a.items())
    f = toxicity_ssk.features(words)
    k = toxicity_ssk.kernel(f, f)
    for i, a in enumerate(phi):
        for j, b in enumerate(phi):
            assert abs(k[i, j] - dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))) < 1e-6
    for w, a in zip(words, phi):
        assert abs(toxicity_ssk.self_kernel(np.array(toxicity_ssk.coded([w])))[0] - dot(a, a)) < 1e-9


def test_lm_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_logbilinear, "HEAD", 60)
    rng = random.Random(9)
    english, other = [f"en{i}" for i in range(60)], [f"xx{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(english if i % 2 else other, k=30))) for i in range(200)] + [(500, None), (501, ""), (502, "Never seen BEFORE"), (503, "en1 " * 20000), (None, "en1 en2"), (1, "en1")]
    df = spark.createDataFrame([(*r, 1.0, "x", 3) for r in rows], "doc_id long, text string, score double, uid string, n_tokens int")
    got = lm_logbilinear.score_texts(df, F.col("doc_id") % 4 != 0).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(x for i, t in rows if i is not None and i % 4 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))
    want = sorted((repr(i), i is None or i % 4 == 0, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(base(t), 6)) for i, t in rows)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    nothing = lm_logbilinear.score_texts(df, F.lit(False)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in nothing)
    assert lm_logbilinear.score_texts(df.limit(0), F.lit(True)).collect() == []


def test_long_words_count_like_others(spark, monkeypatch):
    monkeypatch.setattr(lm_logbilinear, "HEAD", 3)
    url = "https://example.org/" + "a" * 300
    rows = [(i, f"{url} en{i % 7} {url.upper()}") for i in range(20)]
    got = lm_logbilinear.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") > 3).collect()
    c = Counter(x for i, t in rows if i > 3 for x in [*t.lower().split(), ""])
    n, v = sum(c.values()), len(c)
    for r in got:
        t = [*rows[r.doc_id][1].lower().split(), ""]
        assert r.n_known == len(t) and abs(r.base_score - sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) < 1e-6


def test_quality_voters_are_capped_by_class(spark):
    docs = spark.createDataFrame([(i % 2, f"{'Bad. Bad!' if i % 2 else 'good words here'} {'x' * i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, None), (None, 1)], "doc_id long, quality int")
    voters = quality_knn.train(docs, labels, "quality", F.lit(True), per_class=2)
    assert sorted(voters.labels.tolist()) in ([0.0, 1.0], [0.0, 0.0, 1.0, 1.0], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])


def test_voters_reach_the_driver_small_and_in_order(spark, labelled, monkeypatch):
    docs, labels, marks = labelled
    sent, kind = [], type(docs)
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: sent.extend(rows := real(df)) or rows)
    voters = quality_knn.train(docs, labels, "quality", F.col("doc_id") % 5 != 0)
    assert len(sent) == len(voters.labels) > 300 and sum(len(r["counts"]) for r in sent) < len(sent) * quality_knn.TERMS * 4 / 3
    monkeypatch.undo()
    quality = {i: q for i, q, _ in marks if i is not None and q is not None and i % 5}
    made = sorted({(quality[r.doc_id], quality_knn.term_counts(r.text or "").tobytes()) for r in docs.collect() if r.doc_id in quality})
    again = quality_knn.fit(np.array([np.frombuffer(c, np.float32) for _, c in made]), np.array([q for q, _ in made]))
    assert all(np.array_equal(x, y) for x, y in zip(voters, again))


def test_equally_near_voters_vote_in_order():
    v = quality_knn.Voters(np.ones(2, np.float32), np.eye(2, dtype=np.float32), np.array([[1, 0]] * 20 + [[0, 1]], np.float32), np.array([1.0] * 10 + [0.0] * 11, np.float32))
    assert quality_knn.vote(v, np.array([[1, 0]], np.float32), 10)[0] == 1.0 and abs(quality_knn.vote(v, np.array([[1, 0], [1, 1]], np.float32), 20)[0] - 0.5) < 1e-9


def test_lm_table_is_normalised():
    counts = np.zeros((lm_logbilinear.CLASSES,) * 3)
    counts[1, 2, 3], counts[4, 5, 6] = 50, 70
    table = lm_logbilinear.train(counts, steps=60).log10_table().astype(np.float64)
    assert np.allclose((10**table).sum(axis=2), 1, atol=1e-4) and table[1, 2].argmax() == 3 and table[4, 5].argmax() == 6


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 0.3, (6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(0, 0.05, 8)]) for i in range(700)] + [(1000 + i, [0.5] * 8) for i in range(40)]
    rows += [(2000, None), (2050, [float("nan")] * 8), (2100, [None] * 8), (2150, [0.1, float("inf")]), (2200, []), (2250, [0.1, 0.2]), (50, [0.5] * 8)]
    df = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "vec_id long, embedding array<float>, uid int, rank int, score double")
    ok = [(i, np.floor(256 * np.array(list(np.float32(v)) + [0.0] * (8 - len(v)), np.float64))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(ok):
        if i % 50 == 0:
            near = sorted((-int(q @ x), j) for b, (j, x) in enumerate(ok) if b != a)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(near)]
    got = topk_pivot.top_k(df, F.col("vec_id") % 50 == 0, pivots=7, cell_rows=16, block_queries=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    few = topk_pivot.top_k(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2 and topk_pivot.top_k(df.limit(0), F.lit(True)).collect() == []


def test_toxicity_scores_follow_the_definition(spark):
    """Scores in plain loops: all letter triples of each word, weighted by their span, against the table; the worst word decides."""
    from itertools import combinations
    from math import exp, log, sqrt

    insult = ["zorgle", "blimfutt", "quandrix"]
    clean = ["meadow", "planet", "window", "market", "number", "letter", "garden", "silver", "bridge", "copper"]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample(clean, 5) + ([rng.choice(insult)] if i % 4 == 0 else []) + [f"n{i}"])) for i in range(200)]
    docs = spark.createDataFrame([*rows, (500, ""), (501, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    machine = toxicity_ssk.train(docs, labels, "toxic", F.lit(True))

    def margin(word):
        codes = [toxicity_ssk.OPEN, *(int(toxicity_ssk.CODES[b]) for b in word), toxicity_ssk.CLOSE]
        v = {}
        for a, b, c in combinations(range(len(codes)), 3):
            k = (codes[a] * 64 + codes[b]) * 64 + codes[c]
            v[k] = v.get(k, 0.0) + 0.6 ** (c - a + 1)
        return sum(x * float(machine.table[k]) for k, x in v.items()) / sqrt(sum(x * x for x in v.values())) + machine.bias

    for r in toxicity_ssk.score_toxicity(docs, machine).collect():
        text = dict(rows).get(r.doc_id, "")
        words = toxicity_ssk.words_of(text)
        want = 1 / (1 + exp(-(8 * (max(map(margin, words)) - machine.cut) + log(0.7 / 0.3)))) if words else 0.0
        assert abs(r.score - want) < 1e-4 and (r.score >= 0.7) == any(w in text for w in insult)
    assert toxicity_ssk.signature("a b c d e") == toxicity_ssk.signature("A  b c d\ne") and toxicity_ssk.signature("") == toxicity_ssk.signature(" ")
