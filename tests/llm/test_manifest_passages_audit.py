import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgate.llm import substring_dedup
from factgate.llm.filter_audit import audit, failures, removal_steps, text_filters
from factgate.llm.merkle_manifest import fold, leaf_of, manifest, proof_digest
from factgate.llm.substring_dedup import drop_passages

#: Extra columns bear the names that the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, k int, pos int, digest int, path int, part int, mask int, block int, th int, n int"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6, 7, 8, 9) for r in rows], DOCS)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes):
    """The root, and for each leaf its siblings as (before, after) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[a : a + 16] for a in range(0, len(nodes), 16)]
        for i, pos in enumerate(at):
            run, slot = runs[pos // 16], pos % 16
            paths[i].append((run[:slot], run[slot + 1 :]))
            at[i] = pos // 16
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        parts.append((own, *tree([leaf(*r) for r in own])))
    root, over = tree([p[1] for p in parts])
    out = []
    for (own, sub, paths), up in zip(parts, over):
        for r, p in zip(own, paths):
            said = "".join("".join(b) + "".join(a) for b, a in p + up)
            now = leaf(r[0], "changed", *r[2:])
            for b, a in p + up:
                now = sha("".join(b) + now + "".join(a))
            out.append((r[0], leaf(*r), sub, root, sha(said), now))
    return Counter(out)


@pytest.mark.parametrize("sizes", [{None: 3, "": 1, "é": 33, "Z": 256, "a": 257}, {f"s{i}": 1 + i % 3 for i in range(40)} | {"hot": 700}])
def test_manifest_against_brute_force(spark, sizes):
    rows = [(i * 7 % 1009, f"text {i}", "en", s, i) for s, n in sizes.items() for i in range(n)]
    rows += [(None, None, None, "a", None), (None, "", None, "a", None), (5, "dup", "en", "a", 1), (5, "dup", "en", "a", 1), (5, "long " * 60000, "en", "a", 1)]
    random.Random(1).shuffle(rows)
    got = manifest(docs(spark, rows), also={"now": leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.lit("changed")])})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "digest", "path", "now"]
    assert got.where(fold(F.col("digest"), F.col("path")) != F.col("root")).count() == 0
    said = got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), fold(F.col("now"), F.col("path"))).collect()
    assert Counter(map(tuple, said)) == expected(rows)


def test_manifest_of_one_row_and_of_none(spark):
    one = manifest(docs(spark, [(1, "x", "en", "s", 1)])).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].path == []
    assert manifest(docs(spark, [])).collect() == []


def cleaned(rows):
    """rows (doc_id, text) with distinct ids: what is left of each."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if x]
        gone = set()
        for a in range(len(w) - 19):
            if (k := tuple(w[a : a + 20])) in seen:
                gone |= set(range(a, a + 20))
            seen.add(k)
        out.append((i, len(w), len(gone), " ".join(x for a, x in enumerate(w) if a not in gone), sorted(gone)))
    return out


def passages(seed):
    """Texts that share passages of 15 to 60 words, whole or in part, with repeats inside and copies."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(40))
    shared = [[word() for _ in range(rnd.randrange(15, 60))] for _ in range(6)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rnd.randrange(6)):
            w += [word() for _ in range(rnd.randrange(12))]
            p = rnd.choice(shared)
            a = rnd.randrange(len(p) // 3)
            w += p[a : len(p) - rnd.randrange(len(p) // 3)]
        rows.append((i * 13 % 41, rnd.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    return rows + [(200, "x " * 50), (201, " x" * 30), (202, None), (203, ""), (204, "  \n "), (205, "é ü " * 10), (206, "é ü " * 9 + "ß"), (None, rows[5][1])]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block_bytes,shard", [(1 << 20, 20_000), (900, 3)])
def test_passages_against_brute_force(spark, monkeypatch, seed, block_bytes, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_PHRASES", shard)
    rows = passages(seed)
    got = drop_passages(docs(spark, [(i, t, "en", "s", 1) for i, t in rows]), block_bytes=block_bytes).collect()
    want = {r[0]: r[1:] for r in cleaned(rows)}
    assert len(got) == len(rows)
    for r in got:
        spans = [x for s in r.removed for x in range(s.start, s.stop)]
        assert (r.n_words, r.n_removed, r.kept_text, spans) == want[r.doc_id], r.doc_id
    assert sum(r.n_removed for r in got) > 500


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(25))
    got = drop_passages(docs(spark, [(1, text, "en", "s", 1)] * 3)).collect()
    assert sorted(r.n_removed for r in got) == [0, 25, 25]
    assert drop_passages(docs(spark, [])).collect() == []


def test_blocks_are_read_in_place(spark):
    """Texts are shuffled once, when blocks are made: what the plan exchanges afterwards is anchors, windows and places, twice by shard and twice by block."""
    plan = drop_passages(docs(spark, [(1, "a b", "en", "s", 1)]))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 4 and sum("shard" in x for x in exchanges) == 2


def test_min_plus_steps():
    orders = np.array(list(permutations(range(3))))
    fails = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 1], [1, 1, 1]], bool)
    steps = removal_steps(fails, np.argsort(orders, axis=1))
    for m, f in enumerate(fails):
        for p, o in enumerate(orders):
            assert steps[m, p] == next((s for s, x in enumerate(o) if f[x]), 3)


def audited(rows, labels):
    """rows (doc_id, text, lang): the audit as a dictionary, document by document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = Counter()
    parts = {lang or "" for _, _, lang in rows}
    for i, t, lang in rows:
        t, part = t or "", lang or ""
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        for o in map("".join, permutations("ABCDE")):
            gone = False
            for s, f in enumerate(o, 1):
                at = (part, o, s)
                out[at, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[at, "redundant"] += fails[f] and gone
                if fails[f] and not gone:
                    gone = True
                    out[at, "removed"] += 1
                    out[part, f] += 1
                    out[at, "good_lost"] += i in good
                    out[at, "toxic_lost"] += i in toxic
                out[at, "kept"] += not gone
    return {(p, o, s): (*(out[(p, o, s), n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), out[p, o[s - 1]]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


def test_audit_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(210))
    rows = [(1, long, "en"), (2, long, "de"), (3, long, "en"), (4, long + " $", "en"), (5, "A b", None), (6, "A b", ""), (7, "w " * 300, "en"), (8, "W " * 300, "en"), (9, None, "en"), (10, "", "de"), (None, long, "en"), (None, None, None), (3, long, "en"), (1, long, "en"), (11, "x#", "fr")]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 1, None), (7, 1, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (10, None, 1)]
    d = docs(spark, [(i, t, lang, "s", 1) for i, t, lang in rows])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(failures(d, lab, text_filters()), "ABCDE").collect()
    want = audited(rows, labels)
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert tuple(r)[3:] == want[r.part, r.filter_order, r.step], r
    assert audit(failures(docs(spark, []), lab, text_filters()), "ABCDE").collect() == []
    with pytest.raises(ValueError):
        audit(failures(d, lab, text_filters()), "ABCDEFGH")
