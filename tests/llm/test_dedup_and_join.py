import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factgate.llm import ngram_join
from factgate.llm.exact_dedup import _shrink, drop_copies, exact_dedup
from factgate.llm.ngram_join import drop_near_copies

#: Extra columns bear the names that the operators use inside.
DOCS = "doc_id long, text string, id string, digest int, uid int, size int, best int, tkey int, n int, member int, label int, key int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5, 6, 7, 8, 9) for i, t in rows], DOCS)


AWKWARD = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (5, "a "), (2, "a"), (None, "zz"), (6, "É long " * 5000), (7, "É long " * 5000)]


@pytest.mark.parametrize("counters", [1, 2, 2048])
def test_exact_dedup_against_brute_force(spark, counters):
    rows = AWKWARD + [(100 + i, "hot") for i in range(60)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact_dedup(docs(spark, rows), counters=counters).collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by_sha = {sha(t): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.keep_id == max((i for i in ids if i is not None), default=None) and r.group_size == len(ids) and (not r.kept or r.doc_id == r.keep_id)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by_sha.keys())
    left = drop_copies(docs(spark, rows), counters=counters)
    assert left.columns == docs(spark, []).columns and sorted(sha(r.text or "") for r in left.collect()) == sorted(by_sha)


def test_empty_tables(spark):
    assert exact_dedup(docs(spark, [])).collect() == [] and drop_copies(docs(spark, [])).collect() == []
    assert ngram_join.ngram_join(docs(spark, [])).collect() == [] and drop_near_copies(docs(spark, [])).collect() == []


def test_misra_gries_keeps_what_is_frequent():
    items = ["a"] * 40 + [f"x{i}" for i in range(60)] + ["b"] * 30
    held = Counter()
    for i in range(0, len(items), 7):
        held.update(items[i : i + 7])
        held = _shrink(held, 4)
    assert {"a", "b"} <= set(held) and all(held[k] <= items.count(k) and held[k] > items.count(k) - len(items) / 5 for k in "ab")


def sets_of(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute(rows):
    sets, group = sets_of(rows), list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, len(s), least.get(g)) for (i, _), s, g in zip(rows, sets, group)), key=repr)


def near_copies():
    base = [f"w{i * 37 % 101}" for i in range(90)]
    rows = [(i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(0, 60, 3)]
    rows += [(200 + i, " ".join(base[:10] + [f"o{i}x{j}" for j in range(40)])) for i in range(6)]
    rows += [(300, "one two"), (301, "One  TWO"), (302, "one two three"), (303, None), (304, " \t\n"), (305, None), (None, "one two"), (300, "one two"), (306, "É é"), (307, "é é"), (400, "long " * 30000), (401, "long " * 29999 + "end")]
    return rows


@pytest.mark.parametrize("block,short", [(256, 64), (2, 64), (256, 2)])
def test_ngram_join_against_brute_force(spark, monkeypatch, block, short):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 1 if block == 2 else 512)
    rows = near_copies()
    got = ngram_join.ngram_join(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_exhaustive_step_finds_what_neighbours_miss(spark, monkeypatch):
    """Without the first step's links, the second must find every component by itself."""
    real, calls = ngram_join._could_link, []
    monkeypatch.setattr(ngram_join, "_could_link", lambda pairs: calls.append(1) or real(pairs).limit(0))
    rows = near_copies()
    got = ngram_join.ngram_join(docs(spark, rows)).collect()
    assert calls and sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("block", [256, 2])
def test_links_within_a_group_that_meets_no_other(spark, monkeypatch, block):
    """Texts of equal size and prefix, of which the two that link need not follow each other by digest; nothing else has their shingles."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "frequency_sketch", lambda texts: np.zeros(ngram_join.SKETCH, np.uint8))
    rows = []
    for i in range(60):
        w = [f"g{i}w{j}" for j in range(14)]
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w[:12] + [f"g{i}p", f"g{i}q"])), (10 * i + 2, " ".join(w[:13] + [f"g{i}r"]))]
    got = ngram_join.ngram_join(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("block", [256, 2])
def test_links_between_the_members_of_two_groups(spark, monkeypatch, block):
    """Two groups of several members each (equal sizes and prefixes), with links from one to the other only; the first step finds nothing."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SHORT", 3)
    monkeypatch.setattr(ngram_join, "HOT", 2)
    real = ngram_join._could_link
    monkeypatch.setattr(ngram_join, "_could_link", lambda pairs: real(pairs).limit(0))
    order = lambda docs_, logs, percent, f=ngram_join._described: f(docs_, np.zeros(ngram_join.SKETCH, np.uint8), percent)
    monkeypatch.setattr(ngram_join, "_described", order)
    w = [f"w{j}" for j in range(60)]
    rows = [(i, " ".join(w + [f"t{i}x{j}" for j in range(i % 9)])) for i in range(40)] + [(100 + i, " ".join(["head", *w[1:], *(f"u{i}x{j}" for j in range(i % 9))])) for i in range(40)]
    got = ngram_join.ngram_join(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_second_step_labels_anew_only_what_it_connects(spark, monkeypatch):
    real, calls = ngram_join.components, []
    monkeypatch.setattr(ngram_join, "components", lambda links: calls.append(links.count()) or real(links))
    rows = near_copies()
    got = ngram_join.ngram_join(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert len(calls) == 2 and calls[0] > calls[1]


def test_runs_of_equal_keys_over_batches():
    rows = [0, 0, 1, 1, 1, 2, 3, 3, 3, 3, 4]
    for size in (1, 2, 3, 4, 11):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + size]), pa.array(list(range(i, min(11, i + size))))], ["k", "v"]) for i in range(0, 11, size)]
        seen = []
        for t, run in ngram_join._runs(iter(batches), ["k"]):
            k = t.column("k").to_pylist()
            assert [a == b for a, b in zip(k, k[1:])] == [a == b for a, b in zip(run, run[1:])] and not set(seen) & set(k)
            seen += k
        assert seen == rows


def test_near_copies_leave_one_of_each_group(spark):
    rows = [r for r in near_copies() if r[0] not in (None, 300)]
    kept = {r.doc_id for r in drop_near_copies(docs(spark, rows)).collect()}
    empty = {i for (i, _), s in zip(rows, sets_of(rows)) if not s}
    assert kept == {c for _, n, c in brute(rows) if n} | empty


def test_signature_bound_never_exceeds_the_difference():
    for a, b in (("a b c d e f g h", "a b c d e f g x"), ("a " * 50, "b"), (" ".join(map(str, range(300))), " ".join(map(str, range(40, 900))))):
        x, y = ngram_join.shingles(a), ngram_join.shingles(b)
        assert ngram_join.differ(ngram_join.signature(x), ngram_join.signature(y)) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_verified_texts_are_dealt_one_a_row(spark, monkeypatch):
    ngram_join.prepare(spark)
    monkeypatch.setattr(ngram_join, "HOT_SHINGLES", 100)
    name = lambda i: bytes([i])
    pairs = spark.createDataFrame([(bytearray(name(0)), bytearray(name(i))) for i in range(1, 41)], "a binary, b binary")
    active = spark.createDataFrame([(bytearray(name(i)), 40 if i == 0 else 1, 20) for i in range(41)], "member binary, pairs long, n long")
    texts = spark.createDataFrame([(bytearray(name(i)), f"text {i}") for i in range(41)], "member binary, text string")
    rows = ngram_join._texts_dealt(pairs, active, texts)
    assert rows.columns == ["a", "a_copy", "b", "text"]
    dealt = defaultdict(list)
    for r in rows.collect():
        dealt[r.a_copy].append((None if r.b is None else bytes(r.b), r.text))
    assert len(dealt) == 8 and max(map(len, dealt.values())) < 20
    assert all(own[0] == (None, "text 0") and all(b is not None and t == f"text {b[0]}" for b, t in own[1:]) for own in dealt.values())
    assert sorted(b[0] for own in dealt.values() for b, _ in own[1:]) == list(range(1, 41))
    # Phases that filter in Python read written rows, so that no task has two workers.
    members = spark.createDataFrame([(bytearray(name(i)), 1, 20, bytearray(8)) for i in range(5)], "member binary, grp long, n long, sig binary")
    near = ngram_join._next_in_group(members)
    assert "MapInArrow" not in near._jdf.queryExecution().executedPlan().toString()
