import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from factgate.functions import text as T
from factgate.operators import evaluation, gate, measures, planning, positioning, quality, registry, reports, search
from factgate.plans import queries
from factgate.sources import parse, store
from factgate.streaming import feeds

CLAIMS = "id string, product_id string, source_id string, text string, category string, confidence string, status string"


def claims(spark, *rows):
    return spark.createDataFrame([(i, "P", "s", t, c, k, s) for i, t, c, k, s in rows], CLAIMS)


def test_citation_rules_and_status(spark):
    c = claims(spark, ("A-001", "x", "capability", "high", "verified"), ("A-002", "x", "capability", "low", "verified"), ("A-003", "x", "pricing", "low", "verified"), ("A-004", "x", "metric", "high", "deprecated"), ("A-005", "x", "metric", "high", "needs-review"))
    units = spark.createDataFrame([(1, 0, "A-001"), (2, 0, "A-001"), (2, 1, "A-002"), (3, 0, "A-003"), (3, 1, "A-009"), (4, 0, "A-004"), (4, 1, "A-005")], "item_id int, index int, cited_id string")
    got = {(r.item_id, r["index"]): (r.verdict, r.reason) for r in gate.cited(units, c).collect()}
    assert got[1, 0] == ("pass", None) and got[2, 1] == ("flag", "low-confidence") and got[3, 0] == ("block", "high-risk-low-confidence")
    assert got[3, 1] == ("block", "missing-claim") and got[4, 0] == ("block", "deprecated") and got[4, 1] == ("block", "needs-review")
    assert {r.item_id: r.status for r in gate.report_status(gate.cited(units, c)).collect()} == {1: "approved", 2: "approved", 3: "blocked", 4: "blocked"}  # flags of the gate are low
    confirmed = gate.cited(units, c.withColumn("decision", F.when(F.col("id") == "A-003", "confirmed")))
    assert {(r.verdict, r.reason) for r in confirmed.where("item_id = 3 AND index = 0").collect()} == {("flag", "low-confidence")}


def test_first_block_wins_and_enforcement(spark):
    cites = spark.createDataFrame([(1, 0, 0, "flag", "low"), (1, 0, 1, "block", "b1"), (1, 0, 2, "block", "b2"), (1, 1, 0, "flag", "low"), (1, 2, 0, "pass", None)], "item_id int, index int, pos int, verdict string, reason string")
    m = gate.unit_verdicts(cites, ["item_id", "index"])
    assert {r["index"]: (r.verdict, r.reason) for r in m.collect()} == {0: ("block", "b1"), 1: ("flag", "low"), 2: ("pass", None)}
    units = spark.createDataFrame([(1, i, f"s{i}", v, r) for i, (v, r) in enumerate([("pass", None), ("pass", None), ("block", "overstated"), (None, None)])], "item_id int, index int, text string, r_verdict string, r_reason string")
    assert {r["index"]: (r.verdict, r.reason) for r in gate.enforce(units, m).collect()} == {0: ("block", "b1"), 1: ("flag", "low"), 2: ("block", "overstated"), 3: ("block", "untagged")}


def test_verdicts_are_aligned_by_index_then_by_text(spark):
    units = spark.createDataFrame([(1, 0, "One  is [[AA-001]]."), (1, 1, "Two is."), (1, 2, "Three is.")], "item_id int, index int, text string")
    reviewed = spark.createDataFrame([(1, 0, "Two is.", "pass", "a"), (1, 1, "ONE is.", "flag", "b"), (1, 3, "one is.", "block", "c"), (2, 2, "Three is.", "pass", None)], "item_id int, index int, text string, verdict string, reason string")
    assert {r["index"]: (r.r_verdict, r.r_reason) for r in gate.align_verdicts(units, reviewed).collect()} == {0: ("block", "c"), 1: ("pass", "a"), 2: (None, None)}


def test_marks_clear_uncited_untagged_sentences_only(spark):
    rows = [(1, 0, "We care about homes.", "block", "untagged"), (1, 1, "We care [[AA-001]].", "block", "untagged"), (1, 2, "It lasts.", "block", "overstated"), (1, 3, "Unmarked.", "block", "untagged")]
    units = spark.createDataFrame(rows, "item_id int, index int, text string, r_verdict string, r_reason string")
    none = spark.createDataFrame([], "item_id int, index int, verdict string, reason string")
    marks = spark.createDataFrame([(1, " we care  about homes."), (1, "We care."), (1, "It lasts.")], "item_id int, sentence string")
    assert {r["index"]: r.verdict for r in gate.enforce(units, none, marks).collect()} == {0: "pass", 1: "block", 2: "block", 3: "block"}


def test_reports_combine_gate_pages_checkers_and_overrides(spark):
    drafts = spark.createDataFrame([(i, f"h{i}") for i in range(1, 10)], "item_id int, draft_hash string")
    results = spark.createDataFrame([(i, f"h{i}") for i in range(1, 8)] + [(8, "other")], "item_id int, draft_hash string")
    reviewed = spark.createDataFrame([(i, 0, "x", "pass", None) for i in range(1, 9)], "item_id int, index int, text string, verdict string, reason string")
    verdicts, unchecked = gate.usable_verdicts(drafts, reviewed, results)
    assert {r.item_id for r in unchecked.collect()} == {8, 9} and {r.item_id for r in verdicts.collect()} == set(range(1, 8))
    final = spark.createDataFrame([(1, "pass"), (2, "flag"), (3, "block"), (4, "pass"), (5, "pass"), (6, "block"), (7, "block")], "item_id int, verdict string")
    pages = spark.createDataFrame([(4, "block"), (5, "flag")], "item_id int, verdict string")
    enabled = spark.createDataFrame([(1, "synthetic-buyer"), (2, "style-checker"), (5, "best-practice-auditor"), (5, "synthetic-buyer"), (1, "style-checker")], "item_id int, checker string")
    reports = spark.createDataFrame([(2, "style-checker", "done", None), (5, "best-practice-auditor", "checker-unavailable", None), (5, "synthetic-buyer", "done", "maybe"), (1, "style-checker", "done", None)], "item_id int, checker string, status string, verdict string")
    raised = spark.createDataFrame([(2, "style-checker", "high"), (5, "best-practice-auditor", "low"), (1, "style-checker", "low")], "item_id int, checker string, severity string")
    overrides = spark.createDataFrame([(6, "h6"), (7, "older"), (1, "h1")], "item_id int, draft_hash string")
    got = {r.item_id: (r.block_count, r.high_count, r.low_count, r.missing, r.status) for r in gate.combine(drafts, final, unchecked, pages, gate.checker_flags(enabled, reports, raised), overrides).collect()}
    assert got == {
        1: (0, 0, 1, ["synthetic-buyer"], "approved"), 2: (0, 1, 1, [], "flagged"), 3: (1, 0, 0, [], "blocked"), 4: (1, 0, 0, [], "blocked"), 5: (0, 1, 2, ["best-practice-auditor"], "flagged"),
        6: (1, 0, 0, [], "approved-override"), 7: (1, 0, 0, [], "blocked"), 8: (1, 0, 0, [], "blocked"), 9: (1, 0, 0, [], "blocked"),
    }


def test_affected_and_repairs(spark):
    stale, live = spark.createDataFrame([("A",)], "id string"), spark.createDataFrame([(1, "A"), (1, "B"), (2, "B")], "item_id int, cited_id string")
    conflicts = spark.createDataFrame([("c", ["A", "B"]), ("d", ["B", "C"])], "id string, claim_ids array<string>")
    assert {(r.kind, r.id, tuple(r.claim_ids)) for r in gate.affected(stale, live, conflicts).collect()} == {("content", "1", ("A",)), ("conflict", "c", ("A",))}
    c = claims(spark, ("LM-001", "Lantern stores logs for nine days.", "metric", "high", "verified"))
    rows = [(1, 0, "Lantern stores logs for ninety days. [[LM-001]]", "contradicted", None), (1, 1, "Lantern stores logs for nine days.", "untagged", "LM-001"), (1, 2, "Lantern cooks dinner.", "untagged", "LM-001"), (1, 3, "X [[LM-404]]", "missing-claim", None)]
    fixed = gate.repairs(spark.createDataFrame(rows, "item_id int, index int, text string, reason string, best_id string"), c)
    words = "Lantern stores logs for nine days. [[LM-001]]"
    assert {r["index"]: r.suggested_text for r in fixed.collect()} == {0: words, 1: words, 2: None, 3: None}


def test_sentence_verdicts(spark):
    c = claims(spark, ("LM-001", "Lantern pairs with up to 32 wireless sensors on the pro plan.", "limitation", "medium", "verified"), ("LM-002", "It keeps logs for nine days.", "metric", "high", "deprecated"))
    rows = [
        ("Lantern pairs with up to 32 wireless sensors on the pro plan. [[LM-001]]", "pass", None),
        ("Lantern pairs with up to 64 wireless sensors on the pro plan. [[LM-001]]", "block", "contradicted"),
        ("Lantern always pairs with up to 32 wireless sensors on the pro plan. [[LM-001]]", "block", "overstated"),
        ("Lantern pairs with up to 32 wireless sensors. [[LM-001]]", "block", "overstated"),
        ("Lantern does not pair with up to 32 wireless sensors on the pro plan. [[LM-001]]", "block", "contradicted"),
        ("Lantern pairs with up to 32 wireless sensors on the pro plan and heats kitchens, gardens and garages. [[LM-001]]", "block", "partial"),
        ("Lantern pairs with up to 32 wireless sensors on the pro plan.", "block", "untagged"),
        ("It keeps logs for nine days. [[LM-002]]", "block", "deprecated"),
        ("It keeps logs for nine days. [[LM-404]]", "block", "missing-claim"),
        ("Ready for calmer evenings at home?", "pass", None),
    ]
    s = spark.createDataFrame([(1, i, "P", "sentence", t) for i, (t, _, _) in enumerate(rows)], "item_id int, index int, product_id string, kind string, text string")
    near = gate.registry_overlap(s, c).withColumn("vocabulary", F.array().cast("array<string>"))
    got = {r["index"]: (r.verdict, r.reason, r.suggested_id) for r in gate.verify(near, c).collect()}
    assert got == {i: (v, w, "LM-001" if w == "untagged" else None) for i, (_, v, w) in enumerate(rows)}


def test_known_vocabulary(spark):
    c = claims(spark, *((f"A-{i:03}", f"shared word{i % 4} other{i}", "x", "high", "verified") for i in range(8)))
    assert gate.known_vocabulary(c).first()["vocabulary"] == ["word0", "word1", "word2", "word3"]


def test_reflag_live_and_rounds(spark):
    c = claims(spark, ("A-001", "x", "capability", "high", "verified"), ("A-002", "x", "capability", "high", "deprecated"))
    live = spark.createDataFrame([(1, "A-001"), (1, "A-002"), (2, "A-001"), (3, "A-003")], "item_id int, cited_id string")
    assert {r.item_id: r.claim_ids for r in gate.reflag(live, c).collect()} == {1: ["A-002"], 3: ["A-003"]}
    known = spark.createDataFrame([(1, "A-002")], "item_id int, cited_id string")
    assert [r.item_id for r in gate.reflag(live, c, known).collect()] == [3]
    rounds = spark.createDataFrame([(1, 1, "blocked"), (1, 2, "approved"), (1, 3, "blocked")], "item_id int, round int, status string")
    assert {r.round: r.live_round for r in gate.live_versions(rounds).collect()} == {1: None, 2: 2, 3: 2}


def test_registry_identity(spark):
    row = "source_id string, quote_hash string, text string"
    old = spark.createDataFrame([("P-001", "s", "q1", "a"), ("P-002", "s", "q2", "b"), ("P-003", "s", "q3", "c")], "id string, " + row)
    new = spark.createDataFrame([(0, "s", "q1", "a"), (1, "t", "q2", "b"), (2, "s", "q9", "z")], "pos int, " + row)
    m = registry.match_claims(new, old)
    assert {r.pos: (r.id, r.how) for r in m.collect()} == {0: ("P-001", "exact"), 1: ("P-002", "moved"), 2: (None, "new")}
    gone = registry.absent(old.withColumn("status", F.lit("verified")), m, old.select("source_id").distinct())
    assert [(r.id, r.status) for r in gone.collect()] == [("P-003", "deprecated")]
    more = m.where("id IS NULL").drop("id").withColumn("product_id", F.lit("P"))
    assert registry.allocate_ids(more, old.withColumn("product_id", F.lit("P")), "product_id", "source_id", ["pos"], "P").first()["id"] == "P-004"


def test_rulings_fold_in_order(spark):
    c = spark.createDataFrame([("a", "needs-review", "h"), ("b", "verified", "h"), ("c", "verified", "h"), ("d", "verified", "h")], "id string, status string, quote_hash string")
    t = lambda day: dt.datetime(2024, 1, day)
    r = spark.createDataFrame([("1", "a", "confirmed", "h", t(1)), ("2", "b", "rejected", None, t(2)), ("3", "b", "confirmed", "old", t(3)), ("4", "c", "deprioritized", None, t(1)), ("5", "c", "doc-wrong", None, t(1))], "id string, claim_id string, kind string, quote_hash string, created_at timestamp")
    got = {x.id: (x.status, x.deprioritized, x.n_rulings) for x in registry.apply_rulings(c, r).collect()}
    assert got == {"a": ("verified", False, 1), "b": ("needs-review", False, 2), "c": ("deprecated", True, 2), "d": ("verified", False, 0)}


def test_conflicts_of_all_kinds(spark):
    c = claims(
        spark,
        ("A-001", "Lantern pairs with 32 wireless sensors.", "capability", "high", "verified"), ("A-002", "Lantern pairs with 64 wireless sensors.", "capability", "high", "verified"),
        ("B-001", "Night mode dimming is in beta.", "availability", "high", "verified"), ("B-002", "Night mode dimming is generally available.", "availability", "high", "verified"),
        ("C-001", "No admin can read sealed archive payloads.", "security", "high", "verified"), ("C-002", "Support staff may bypass sealed archive payloads checks.", "security", "high", "verified"),
        ("D-001", "Garage heater sends weekly energy totals.", "capability", "high", "verified"), ("D-002", "Garage heater does not send weekly energy totals.", "capability", "high", "verified"),
        ("E-001", "Garage heater sends weekly energy totals.", "capability", "high", "deprecated"),
    )
    got = {(r.a, r.b): r.rule for r in registry.conflict_pairs(c).collect()}
    assert got == {("A-001", "A-002"): "number", ("B-001", "B-002"): "status", ("C-001", "C-002"): "absolute", ("D-001", "D-002"): "negation"}
    found = spark.createDataFrame([(["a", "b"], "contradiction"), (["c", "d"], "contradiction")], "claim_ids array<string>, kind string")
    old = spark.createDataFrame([("old", ["b", "a"], "contradiction", "resolved"), ("kept", ["x", "y"], "contradiction", "open")], "id string, claim_ids array<string>, kind string, status string")
    merged = {tuple(r.claim_ids): (r.id, r.status) for r in registry.merge_conflicts(found, old).collect()}
    assert merged["a", "b"] == ("old", "resolved") and merged["x", "y"] == ("kept", "open") and merged["c", "d"][1] == "open"


def test_top_matches_against_brute_force(spark):
    rng = random.Random(3)
    words = ["amber", "basil", "cedar", "dune", "ember", "fjord", "grove"]
    q = [(i, " ".join(rng.choices(words, k=4))) for i in range(6)]
    t = [(i, " ".join(rng.choices(words, k=5))) for i in range(30)]
    sets = search.token_arrays(spark.createDataFrame(q, "query_id int, text string"), "query_id", "text"), search.token_arrays(spark.createDataFrame(t, "target_id int, text string"), "target_id", "text")
    got = {(r.query_id, r["rank"]): r.target_id for r in search.best_matches(*sets, 3).collect()}
    for i, x in q:
        a = set(x.split())
        scored = sorted((-round(len(a & set(y.split())) / (len(a) * len(set(y.split()))) ** 0.5, 3), j) for j, y in t if a & set(y.split()))
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in scored[:3]]


@pytest.mark.parametrize("measure,k,broadcast,spread", [("score", 1, 10**6, True), ("score", 4, 0, False), ("shared", 3, 10**6, False), ("shared", 1, 0, True)])
def test_bounded_matches_find_every_best_target(spark, monkeypatch, measure, k, broadcast, spread):
    monkeypatch.setattr(search, "BROADCAST_TOKENS", broadcast)
    rng = random.Random(k)
    words = [f"w{int(rng.paretovariate(0.6)) % 200}" for _ in range(2000)]  # some words are in most texts
    text = lambda n: rng.sample(words, n)
    t = [(p, i, text(rng.randrange(0, 40))) for p in "ab" for i in range(120)]
    q = [(p, f"{p}{i}", x[: rng.randrange(len(x) + 1)] + text(rng.randrange(6))) for p, i, x in t[::3]] + [("a", "none", ["zz"]), ("c", "alone", ["w1"]), ("a", "empty", []), ("a", "twice", ["w1", "w1", "w2"])]
    frames = spark.createDataFrame(q, "p string, query_id string, tokens array<string>"), spark.createDataFrame(t, "p string, target_id int, tokens array<string>")
    got = {(r.p, r.query_id, r["rank"]): (r.target_id, r.shared) for r in search.best_matches(*frames, k, ("p",), measure, spread).collect()}
    want = {}
    for p, i, x in q:
        a = set(x)
        pairs = [(len(a & set(y)), len(set(y)), j) for pp, j, y in t if pp == p and a & set(y)]
        key = (lambda s: (-(s[0] / (len(a) ** 0.5 * s[1] ** 0.5)), s[2])) if measure == "score" else (lambda s: (-s[0], s[2]))
        want |= {(p, i, r + 1): (s[2], s[0]) for r, s in enumerate(sorted(pairs, key=key)[:k])}
    assert got == want


def test_answers_and_links_follow_stems(spark):
    claims = spark.createDataFrame([("c1", "Exports run nightly to storage buckets"), ("c2", "Exports, exporting and exported reports"), ("c3", "Billing is monthly")], "target_id string, text string")
    asks = spark.createDataFrame([(1, "exporting report nightly"), (2, "monthly invoices for partner resellers abroad"), (3, "nothing alike"), (4, "")], "query_id int, text string")
    assert {r.query_id for r in search.unanswered(asks, claims).collect()} == {2, 3, 4}
    assert {(r.query_id, r.target_id) for r in search.proof_links(asks, claims).collect()} == {(1, "c2")}


def test_auc_and_threshold_against_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 6) / 6, rng.randint(0, 1)) for _ in range(60)]
    pos, neg = [s for s, x in rows if x], [s for s, x in rows if not x]
    df = spark.createDataFrame(rows, "score double, label int")
    assert abs(measures.auc(df).first()["auc"] - sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)) < 1e-12
    j = {t: sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg) for t in {s for s, _ in rows}}
    best = min(t for t in j if abs(j[t] - max(j.values())) < 1e-12)
    lower = max((t for t in j if t < best), default=best)
    assert abs(measures.youden_threshold(df).first()["threshold"] - (best + lower) / 2) < 1e-12


def test_chunks_and_percentiles(spark):
    word = lambda n: " ".join(["w"] * n)
    p = spark.createDataFrame([(1, i, word(n)) for i, n in enumerate((100, 90, 50, 40, 10))] + [(2, 0, word(5))], "doc_id int, pos int, text string")
    assert sorted((r.doc_id, r.chunk, r.words) for r in measures.greedy_chunks(p).collect()) == [(1, 0, 190), (1, 1, 100), (2, 0, 5)]
    docs = spark.createDataFrame([("k", "A b c. D e. You go now there! Why? " * 3)], "k string, text string")
    m = measures.measure_text(docs, "k").first()
    lengths = sorted([3, 2, 4, 1] * 3)
    assert (m.sentences, m.words, m.p10, m.p90) == (12, sum(lengths), lengths[int(0.1 * 11)], lengths[int(0.9 * 11)]) and m.question_rate == 0.25


def test_markdown_blocks(spark):
    md = "---\ntitle: T\n---\n# A *x*\n\nOne. Two.\nmore **b** [l](u)\n\n### B\n- x y\n1) z\nbefore\n```\ncode\n```\nafter\n### C\n\n| a | b |\n|---|---|\n| c | d |\n## \n![i](j)\n# D\nend"
    df = spark.createDataFrame([("s", md), ("t", None), ("u", ""), ("v", "root\r\nline\n\nsecond")], "source_id string, body string")
    rows = parse.markdown_blocks(df).orderBy("source_id", "block_pos").collect()
    assert [(b["level"], b["loc"], b["text"]) for b in rows if b["source_id"] == "s"] == [
        (1, "A x", "A x"), (0, "A x ¶1", "One. Two. more b l"), (3, "A x > B", "B"), (0, "A x > B ¶1", "x y"), (0, "A x > B ¶2", "z"), (0, "A x > B ¶3", "before"), (0, "A x > B ¶4", "after"),
        (3, "A x > B > C", "C"), (0, "A x > B > C ¶1", "a | b"), (0, "A x > B > C ¶2", "c | d"), (1, "D", "D"), (0, "D ¶1", "end"),
    ]
    assert [(b["source_id"], b["loc"], b["text"]) for b in rows if b["source_id"] != "s"] == [("v", "¶1", "root line"), ("v", "¶2", "second")]


def test_heading_paths_against_the_rule(spark):
    rng, rows = random.Random(7), []
    for doc in range(30):
        path = []
        for pos in range(12):
            level = rng.choice([0, 1, 2, 3, 4, 5, 6])
            if level:
                path = [*path[: level - 1], f"h{pos}"]
            rows.append((doc, pos, level, f"h{pos}", list(path)))
    df = spark.createDataFrame(rows, "doc int, pos int, level int, title string, want array<string>")
    assert parse.heading_paths(df, "doc").where("path <> want").count() == 0


def test_draft_units(spark):
    md = "# T [[PT-001]]\n<!-- no -->\nOne is\nwrapped. Two is [[PT-001]].\n- item a. B c\n| a | b |\n|---|:-:|\n---\nend"
    units = parse.draft_units(spark.createDataFrame([(1, md), (2, None), (3, "")], "item_id int, md string")).orderBy("item_id", "index").collect()
    assert [(u["index"], u["kind"], u["text"]) for u in units] == [
        (0, "heading", "T [[PT-001]]"), (1, "sentence", "One is wrapped."), (2, "sentence", "Two is [[PT-001]]."), (3, "list-item", "item a."), (4, "list-item", "B c"), (5, "table-cell", "a"), (6, "table-cell", "b"), (7, "sentence", "end"),
    ]
    assert {u["section"] for u in units} == {"T"}


def test_html_scanner_is_linear_and_never_recurses(spark):
    attributes = " ".join(f'a{i}="x>{i}"' for i in range(100_000))
    pages = {
        1: "<p " + "a" * 10_000_000 + ">one</p>",
        2: f"<div {attributes}>two</div><p>more</p>",
        3: "<a 'b>" * 50_000 + "three" + "<a \"b>" * 50_001 + "<p>left</p>",
        4: "<p>" + "<b" * 2_000 + ">four",
        5: "<!-- " * 2_000 + "<p>five</p>",
    }
    rows = parse.html_blocks(spark.createDataFrame(list(pages.items()), "page_id long, html string")).orderBy("page_id", "block_pos").collect()
    texts = {}
    for r in rows:
        texts.setdefault(r.page_id, []).append(r.text)
    assert texts[1] == ["one"] and texts[2] == ["two", "more"] and texts[4] == ["four"] and texts[5][-1] == "five"


def test_scanner_reads_what_the_plain_pattern_reads():
    rng = random.Random(2)
    for _ in range(3000):
        html = "".join(rng.choice(["<", ">", '"', "'", "a", " ", "</", "<!--", "-->", "<script>", "</script>", "/", "="]) for _ in range(rng.randrange(40)))
        assert re.findall(parse.MARKUP.replace(r"\z", r"\Z"), html) == re.findall(parse.SCANNED.replace(r"\z", r"\Z"), html), html


def test_long_runs_of_tags_and_numbers(spark):
    text = "It ends." + " [[AB-001]]" * 30_000 + " Next one has " + "1," * 30_000 + "1 units."
    row = spark.createDataFrame([(text,)], "t string").select(F.size(T.split_sentences(F.col("t"))).alias("n"), F.size(T.numbers(F.col("t"))).alias("m")).first()
    assert (row.n, row.m) == (2, 1)


def test_html_blocks(spark):
    html = (
        "<html><head><title>T &amp; <b>x</b>B</title><script>var a='</p><h1>no</h1>'</script></head><body><nav>n<h1>gone</h1></nav><h1>A<br>after</h1><p>one <b>two</b> &eacute;&#233;&#x20AC;&nbsp;z &lt;b&gt; 5 < 6 &bogus;</p>"
        "<h2>B<p>three<dl><dt>t</dt><dd>d</dd></dl></footer><h3/>plain<div>q</div><!-- <p>no</p> --><h5>deep</h5>x<a title='a>b'>link</a></body><style>p"
    )
    rows = parse.html_blocks(spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>open")], "page_id long, html string")).orderBy("page_id", "block_pos").collect()
    assert [(r["level"], r["loc"], r["text"]) for r in rows if r["page_id"] == 1] == [
        (1, "A", "A"), (0, "A ¶1", "after"), (0, "A ¶2", "one two éé€ z <b> 5 < 6 &bogus;"), (2, "A > B", "B"), (0, "A > B ¶1", "three"), (0, "A > B ¶2", "t"), (0, "A > B ¶3", "d"), (0, "A > B ¶4", "plain"),
        (0, "A > B ¶5", "q"), (5, "A > B > deep", "deep"), (0, "A > B > deep ¶1", "xlink"),
    ]
    assert {r["title"] for r in rows if r["page_id"] == 1} == {"T & xB"} and [(r["loc"], r["text"]) for r in rows if r["page_id"] == 4] == [("¶1", "open")] and {r["page_id"] for r in rows} == {1, 4}


def test_survey_front_matter_routes(spark):
    raw = spark.createDataFrame([("s", '{"responses":[{"id":"1","segment":"x","answers":{"a":"b","c":"d"}}]}'), ("t", "broken")], "source_id string, json string")
    assert {(r["response_id"], r["field"], r["value"]) for r in parse.survey_rows(raw).collect()} == {("1", "a", "b"), ("1", "c", "d")}
    fm = spark.createDataFrame([("---\ntitle: Y\ntitle: 'X' # note\nurl: http://a/#b\n---\nbody",)], "t string").select(parse.front_matter(F.col("t")).alias("m")).first()["m"]
    assert fm == {"title": "X", "url": "http://a/#b"}
    ok, bad = parse.route(spark.createDataFrame([("a.md", "x"), ("b.pdf", "x"), ("c.txt", " ")], "path string, text string"))
    assert [r["format"] for r in ok.collect()] == ["markdown"] and {r["path"]: r["reason"] for r in bad.collect()} == {"b.pdf": "unsupported type", "c.txt": "no text"}


def test_changes_tenancy_and_feed(spark, tmp_path):
    cur = spark.createDataFrame([("a", "1", "active"), ("b", "1", "removed")], "source_id string, sha256 string, status string")
    inc = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "source_id string, sha256 string")
    assert {r.source_id: r.changed for r in registry.detect_changes(inc, cur).collect()} == {"a": False, "b": True, "c": True}
    t = lambda i: dt.datetime(2024, 1, i)
    batch = spark.createDataFrame([("a", "2", t(1)), ("a", "1", t(2)), ("a", "1", t(3)), ("b", "1", t(1))], "source_id string, sha256 string, arrived_at timestamp")
    assert sorted((r.source_id, r.sha256, r.arrived_at.day) for r in feeds.batch_changes(batch, cur).collect()) == [("a", "1", 2), ("a", "2", 1), ("b", "1", 1)]
    docs = spark.createDataFrame([("w1", "p", "x", 1, 1), ("w2", "p", "x", 1, 2), ("w1", "p", "x", 2, 3)], "workspace_id string, product_id string, id string, updated_at int, seq int")
    store.append_versions(docs, str(tmp_path / "t"))
    assert {(r.workspace_id, r.seq) for r in store.current(store.scan(spark, str(tmp_path / "t"), "w1")).collect()} == {("w1", 3)}


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 5 * i), k, 1.0) for h in range(3) for i in range(5) for k in "ab"], "ts timestamp, event_type string, value double")
    e.write.parquet(str(tmp_path / "in"))
    stream = feeds.log_rollup(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    feeds.upserts(stream, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = feeds.latest_upserts(spark.read.parquet(str(tmp_path / "out")), ["window_start", "event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, feeds.log_rollup(e).collect()))


def test_sections_retention_rules(spark):
    briefs = spark.createDataFrame([(1,), (2,)], "brief_id int")
    c = spark.createDataFrame([("a", "P", "One.", "metric", "verified"), ("b", "P", "one. ", "x", "verified"), ("c", "P", "Two.", "x", "verified"), ("d", "P", "Three cheap.", "x", "verified"), ("e", "P", "Four.", "x", "deprecated"), ("f", "P", "Five.", "security", "verified")], "id string, product_id string, text string, category string, status string")
    cand = spark.createDataFrame([(x, s_, i, False, n) for x in (1, 2) for s_ in ("hero", "benefits", "proof", "cta") for n, i in enumerate("abcdef")] + [(1, s_, "f", True, 0) for s_ in ("hero", "benefits", "proof")], "brief_id int, section string, id string, is_proof boolean, rank int")
    avoid = spark.createDataFrame([("P", ["Cheap"])], "product_id string, terms array<string>")
    got = planning.allocate_sections(cand, c, ("hero", "benefits", "proof", "cta"), avoid).collect()
    # The hero takes one and no proof point; benefits take proof first; b says what a says; proof needs its categories.
    assert sorted((r.brief_id, r.section, r.pick, r.id) for r in got) == [(1, "benefits", 1, "f"), (1, "benefits", 2, "c"), (1, "hero", 1, "a"), (2, "benefits", 1, "c"), (2, "benefits", 2, "f"), (2, "hero", 1, "a")]
    rounds = spark.createDataFrame([(1, 1, "blocked", dt.datetime(2020, 1, 1)), (1, 2, "approved", dt.datetime(2020, 1, 2)), (1, 3, "blocked", dt.datetime(2024, 1, 1))], "item_id int, round int, status string, created_at timestamp")
    assert [r["round"] for r in reports.retention_plan(rounds, 30, F.lit("2024-01-10").cast("timestamp")).collect()] == [1]
    bad = reports.violations(briefs, F.col("brief_id"), {"one": F.col("brief_id") == 1, "all": F.lit(True)})
    assert {r.rule: r.n for r in reports.run_rules(bad, reports.duplicate_keys(briefs.union(briefs), "brief_id")).collect()} == {"one": 1, "all": 2, "duplicate-id": 2}


def test_rule_sets(spark):
    found = lambda df: {(r.rule, r.key) for r in df.collect()}
    reports_ = spark.createDataFrame([(1, "approved-override", 1, None), (2, "approved", 2, None), (3, "approved-override", 1, (" ",)), (4, "approved", 0, None)], "item_id int, status string, block_count int, override struct<reason:string>")
    assert found(quality.report_rules(reports_)) == {("override-missing", "1"), ("approved-with-blocks", "2"), ("override-without-reason", "3")}
    assert found(quality.evidence_rules(spark.createDataFrame([("a", 3, 2), ("b", 2, 2)], "id string, count int, total int"))) == {("count-exceeds-total", "a")}
    profile = [("P", "Acme", ["One"], ["ONE", "Acme"], ["calm"], ["CALM"], "active", False, [0.5, 0.4]), ("Q", "Quill", [], [], [], [], "draft", False, []), ("R", "Rill", ["a"], ["b"], ["c"], ["d"], "active", True, [0.5, 0.495])]
    p = spark.createDataFrame(profile, "product_id string, product_name string, allowed array<string>, forbidden array<string>, preferred array<string>, banned array<string>, status string, consistent boolean, weights array<double>")
    assert found(quality.profile_rules(p)) == {(r, "P") for r in ("name-forbidden", "variant-allowed-and-forbidden", "word-preferred-and-banned", "inconsistent-but-active", "weights-do-not-sum-to-one")}
    c = spark.createDataFrame([("PT-001", "q " * 60, "metric", "high", "verified", None, None), ("XX-002", "ok", "metric", "low", "verified", "confirmed", None), ("PT-003", "ok", "market-evidence", "high", "needs-review", None, None), ("PT-003", "ok", "x", "high", "verified", None, None)], "id string, quote string, category string, confidence string, status string, decision string, count int")
    assert found(quality.claim_rules(c, "PT")) == {("quote-too-long", "PT-001"), ("needs-confirmation", "PT-001"), ("id-prefix", "XX-002"), ("evidence-without-count", "PT-003"), ("duplicate-id", "PT-003")}
    rails, known = spark.createDataFrame([("P", "r", "D1"), ("P", "r", "D2")], "product_id string, rule string, decision_id string"), spark.createDataFrame([("D1",)], "id string")
    proofs = spark.createDataFrame([("1", "has-claim", []), ("2", "needs-claim", ["a"]), ("3", "has-claim", ["a"])], "id string, status string, claim_ids array<string>")
    assert found(quality.pack_rules(rails, proofs, known)) == {("unknown-decision", "D2"), ("has-claim-without-ids", "1"), ("needs-claim-with-ids", "2")}
    t = spark.createDataFrame([("a", 1, ["x"]), (None, None, None), ("zz", 9, [])], "s string, n int, l array<string>")
    rules = quality.constraints(["s"], {"s": ("a", "zz")}, {"s": "^a"}, {"n": (2, 8)}, {"s": (1, 1), "l[]": (1, None)})
    assert sorted((r.rule, r.key or "") for r in reports.violations(t, F.coalesce("s", F.lit("-")), rules).collect()) == [("l[]: length", "zz"), ("n: range", "a"), ("n: range", "zz"), ("s: length", "zz"), ("s: pattern", "zz"), ("s: required", "-")]


def test_status_onboarding_and_estimates(spark):
    products = spark.createDataFrame([("P",), ("Q",), ("R",)], "product_id string")
    sources = spark.createDataFrame([("P", "truth", "active", 100), ("P", "style", "active", 10), ("Q", "truth", "removed", 5), ("R", "truth", "active", 1)], "product_id string, type string, status string, words int")
    c = spark.createDataFrame([("P", "1", "verified"), ("P", "2", "needs-review"), ("R", "3", "needs-review")], "product_id string, id string, status string")
    profiles, packs, stale = spark.createDataFrame([("P", "active", 0.7)], "product_id string, status string, threshold double"), spark.createDataFrame([("P",)], "product_id string"), spark.createDataFrame([("P", 1)], "product_id string, source_id int")
    status = reports.kb_status(products, sources, c, profiles, packs, stale)
    got = {r.product_id: (r.state, r.blockers, r.warnings) for r in status.collect()}
    assert got["P"] == ("stale", [], ["no-positioning-sources", "stale"]) and got["Q"][:2] == ("blocked", ["no-truth-sources"]) and got["R"][:2] == ("blocked", ["no-verified-claims"])
    done = {(r.product_id, r.step): r.done for r in reports.onboarding(status, packs).collect()}
    assert done["P", "knowledge base"] and not done["P", "claims reviewed"] and done["P", "style threshold"] and not done["R", "knowledge base"]
    tokens = {(r.product_id, r.kind): r.tokens for r in reports.estimate_tokens(c, sources).collect()}
    assert tokens["P", "eval"] == 49600 and tokens["P", "quick-check"] == 15060 and tokens["P", "ingest"] == 462 and tokens["P", "content"] == 120 + 40000 + (4 * 6060 + 30000) * 3


def test_planning_facts_and_golden(spark):
    c = claims(spark, ("LM-001", "Lantern stores logs for nine days.", "metric", "high", "verified"), ("LM-002", "Lantern pairs with sensors.", "x", "high", "deprecated"))
    briefs = spark.createDataFrame([(1, "P", "Say it only stores logs for nine days. Mention the first moon landing; Be kind.")], "brief_id int, product_id string, notes string")
    assert [(r.pos, r.need) for r in planning.unsupported_asks(briefs, c, 0.5).collect()] == [(1, "Mention the first moon landing;")]
    aids = spark.createDataFrame([(1, "P", "# Lantern stores logs for nine days.\nLantern never stores logs for nine days. Lantern heats your kitchen every evening. Nothing about it here at all.")], "aid_id int, product_id string, text string")
    assert [(r.issue, r.claim_id) for r in planning.fact_check(aids, spark.createDataFrame([("P", "Lantern")], "product_id string, name string"), c).orderBy("pos").collect()] == [("contradicts", "LM-001"), ("not-in-registry", None)]
    personas = spark.createDataFrame([("P", 0, "Ops lead", "runs shifts"), ("P", 1, "Cook", "runs kitchens")], "product_id string, pos int, name string, role string")
    asked = spark.createDataFrame([(1, "P", "cooks of kitchens", None), (2, "P", "nobody", ""), (3, "Q", "readers", None)], "brief_id int, product_id string, audience string, notes string")
    assert {r.brief_id: r.persona for r in planning.pick_persona(asked, personas).collect()} == {1: "Cook", 2: "Ops lead", 3: "readers"}
    golden = spark.createDataFrame([("P", "LANTERN stores  logs for nine days."), ("P", "stores logs for nine"), ("P", "We know: Lantern pairs with sensors. Yes."), ("P", "Lantern"), ("P", "unknown words")], "product_id string, quote string")
    found = {r.quote: r.claim_id for r in planning.golden_matches(golden, c.withColumn("pos", F.substring("id", 6, 1).cast("int"))).collect()}
    assert list(found.values()).count(None) == 1 and found["stores logs for nine"] == "LM-001" and found["We know: Lantern pairs with sensors. Yes."] == "LM-002" and found["Lantern"] == "LM-001" and found["unknown words"] is None
    responses = spark.createDataFrame([("s", 1, "size", "Small "), ("s", 2, "size", "small"), ("s", 2, "team", "x"), ("s", 3, "size", "big")], "source_id string, response_id int, field string, value string")
    evidence = spark.createDataFrame([("s", "size=Small", 2, 3), ("s", "size=small", 3, 3), ("s", "size = big", 1, 2), ("s", "none=x", 0, 3)], "source_id string, query string, count int, total int")
    assert {r["query"] for r in planning.reproducible(evidence, responses).collect()} == {"size=Small", "none=x"}


def test_discovery_slugs_and_positioning(spark):
    rows = [("https://a.org/docs/", '[x](https://b.org/1) [y](/two) [z](three) <loc> https://a.org/s </loc> href="p" href="/docs/p" href="/other" href="https://a.org/docs/q"')]
    b = spark.createDataFrame(rows, "url string, body string")
    found = lambda mode: [r.link for r in parse.discover(b, mode).orderBy("pos").collect()]
    assert found("llms") == ["https://b.org/1", "https://a.org/two"] and found("sitemap") == ["https://a.org/s"] and found("prefix") == ["https://a.org/docs/", "https://a.org/docs/p", "https://a.org/docs/q"]
    assert spark.createDataFrame([("  Élan & Co. 2!",)], "t string").select(parse.slug(F.col("t")).alias("s"), parse.slug(F.lit("!!")).alias("e")).first()[:] == ("lan-co-2", "source")
    md = "# P\n## Personas\n### Ana\nRole: lead; owner\nToo dear => It saves days\n\nproof: Nine days\n\nWarm words"
    blocks = parse.markdown_blocks(spark.createDataFrame([("s", md.replace("owner\n", "owner\n\n"))], "source_id string, body string"))
    assert {(r.section, r.entry, r.kind, r.name, r.value) for r in parse.positioning(blocks).collect()} == {("personas", "Ana", "field", "role", "lead"), ("personas", "Ana", "field", "role", "owner"), ("personas", "Ana", "pair", "Too dear", "It saves days"), ("personas", "Ana", "proof", "proof", "Nine days"), ("personas", "Ana", "text", None, "Warm words")}


def test_stores_extract_only_what_changed_and_export_what_is_live(spark):
    s = spark.createDataFrame([("a", "1", "active"), ("b", "2", "active"), ("c", "3", "removed")], "source_id string, sha256 string, status string")
    done = spark.createDataFrame([("a", "1"), ("b", "1")], "source_id string, sha256 string")
    assert [r.source_id for r in store.pending_extraction(s, done).collect()] == ["b"] and [r.source_id for r in store.current_records(s, done).collect()] == ["a"]
    ok, bad = store.split_parsed(spark.createDataFrame([("u", "x"), ("v", None), ("w", " ")], "url string, text string"))
    assert [r.url for r in ok.collect()] == ["u"] and {r.url: r.error for r in bad.collect()} == {"v": "not fetched", "w": "no text"}
    items = spark.createDataFrame([(1, 2, "approved"), (2, 1, "flagged"), (3, None, None)], "item_id int, live_round int, live_status string")
    texts = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "item_id int, round int, final_text string")
    assert [r.final_text for r in store.export_live(items, texts).collect()] == ["new"]
    types = store.content_types(spark.createDataFrame([("lp", 1), ("mail", 1)], "id string, v int"), spark.createDataFrame([("lp", 2)], "id string, v int"))
    assert {r.id: r.v for r in types.collect()} == {"lp": 2, "mail": 1}
    both = store.registry_input(spark.createDataFrame([("a", "x")], "id string, category string"), spark.createDataFrame([("b", 3)], "id string, count int"))
    assert {(r.id, r.category, r["count"]) for r in both.collect()} == {("a", "x", None), ("b", "market-evidence", 3)}


def test_changes_make_claims_stale_and_touch_content(spark):
    c = spark.createDataFrame([("1", "a", "Old words", "verified"), ("2", "a", "kept", "verified"), ("3", "b", "gone", "verified"), ("4", "a", "Old words", "deprecated"), ("5", "c", "x", "verified")], "id string, source_id string, quote string, status string")
    changes = spark.createDataFrame([("a", "s1", 1, "Old words KEPT"), ("a", "s2", 2, "New words, KEPT"), ("b", "s3", 1, None)], "source_id string, sha256 string, arrived_at int, text string")
    live, conflicts = spark.createDataFrame([(7, "1"), (8, "2")], "item_id int, cited_id string"), spark.createDataFrame([("x", ["3", "5"]), ("y", ["2", "5"])], "id string, claim_ids array<string>")
    seen = []
    feeds.on_change(lambda: c, lambda: live, lambda: conflicts, lambda stale, hit, n: seen.append(({r.id for r in stale.collect()}, {(r.kind, r.id) for r in hit.collect()}, n)))(changes, 4)
    assert seen == [({"1", "3"}, {("content", "7"), ("conflict", "x")}, 4)]


def test_final_copy_only_for_its_own_hash(spark):
    d = spark.createDataFrame([(1, "A fact [[PT-001]].\n\n\n\nB <!-- x -->"), (2, "C")], "item_id int, md string")
    r = d.select("item_id", F.lit("approved").alias("status"), F.when(F.col("item_id") == 1, F.sha2("md", 256)).otherwise(F.lit("other")).alias("draft_hash"))
    assert [(x.item_id, x.final_text) for x in gate.finalize(d, r).collect()] == [(1, "A fact.\n\nB")]
    assert T is not None


def test_greedy_chunks_reads_all_languages(spark, tmp_path):
    paragraphs = {1: ("en", [100, 90, 20]), 2: ("fr", [60, 60, 60, 95]), 3: ("es", [7]), 4: ("de", [200, 89]), 5: (None, [170, 11, 90])}
    rows = [(i, "\n".join(" ".join(["été"] * n) for n in sizes), lang) for i, (lang, sizes) in paragraphs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, (_, sizes) in paragraphs.items():
        chunks, words = [], 0
        for n in sizes:
            words += n
            if words >= 180:
                chunks, words = chunks + [words], 0
        chunks += [words] if words >= 90 or words and not chunks else []
        want += [(i, k, n) for k, n in enumerate(chunks)]
    assert sorted((r.doc_id, r.chunk, r.words) for r in queries.greedy_chunks(spark, str(tmp_path)).collect()) == want


def test_positioning_packs_and_links(spark):
    md = """# Deck

Intro words

## Positioning statement

We move goods

Second line

## Competitive alternatives

Spreadsheets: slow; error-prone

Nothing

## Value themes

loose text without a theme

### Speed

PROOF:  Exports run nightly to storage

Say it is fast

Say more

Proof: Nobody ever claimed this anywhere

### Trust

Proof: Records are encrypted

## Personas

### Ana

Role: lead; owner

Pains: delays ; ; cost

Stage: sure

Stage: product-aware

role: buyer

### Bo

Hello

## Objections

Too dear => It saves days

No answer

## Messaging

Short: a

short: b

Long
"""
    docs = spark.createDataFrame([("s", md), ("t", "# X\n\n## Other\n\nonly text"), ("n", None)], "source_id string, body string")
    pack = {r.source_id: r for r in positioning.packs(parse.markdown_blocks(docs)).collect()}
    s = pack["s"]
    assert set(pack) == {"s", "t"} and s.positioning_statement == "We move goods" and s.category == "" and pack["t"].positioning_statement == "only text"
    assert [tuple(a) for a in s.alternatives] == [("Spreadsheets", "slow; error-prone"), ("Nothing", "")]
    assert [(t.name, t.message, t.proof_points) for t in s.value_themes] == [("Speed", "Say it is fast", ["Exports run nightly to storage", "Nobody ever claimed this anywhere"]), ("Trust", "", ["Records are encrypted"])]
    assert [tuple(p) for p in s.personas] == [("Ana", "buyer", ["delays", "cost"], [], "product-aware"), ("Bo", "", [], [], "problem-aware")]
    assert [tuple(o) for o in s.objections] == [("Too dear", "It saves days"), ("No answer", "")] and s.stages == {} and s.messaging == {"short": "b", "long": ""}
    claims = spark.createDataFrame([("P", "c1", "Exports run nightly to storage buckets", "verified"), ("P", "c2", "Records are encrypted at rest", "deprecated"), ("Q", "c3", "Records are encrypted", "verified")], "product_id string, id string, text string, status string")
    got = positioning.linked(positioning.packs(parse.markdown_blocks(docs)).withColumn("product_id", F.lit("P")), claims).where("source_id = 's'").first()
    assert [[(p.status, p.claim_ids) for p in t.proof_points] for t in got.value_themes] == [[("has-claim", ["c1"]), ("needs-claim", [])], [("needs-claim", [])]]


def test_evaluation_by_pages(spark):
    claims = spark.createDataFrame(
        [("P", i, f"PR-{i:03d}", text, status, "other", "high") for i, (text, status) in enumerate([("Exports run nightly to storage buckets", "verified"), ("Backups are kept for 30 days on the pro plan", "verified"), ("Audit logs are never deleted by operators", "verified"), ("Billing runs monthly for partner resellers", "deprecated")])],
        "product_id string, pos int, id string, text string, status string, category string, confidence string",
    )
    golden = spark.createDataFrame(
        [("P", "g1", "combined-conclusion", "Exports run nightly, so backups give auditors complete recovery for 30 days", ["Exports run nightly to storage buckets", "backups are kept for 30 days on the pro plan"]), ("P", "g2", "true", "Billing runs monthly for partner resellers", ["Billing runs monthly for partner resellers"]),
         ("P", "g3", "false", "Nothing holds this", ["a quote that no claim has"]), ("P", "g4", "partial", "No quote at all", []), ("P", "g5", "positioning", "Start where you are.", []), ("P", "g6", "untagged", "Exports run nightly to storage buckets", ["Exports run nightly to storage buckets"])],
        "product_id string, id string, label string, text string, quotes array<string>",
    )
    seeds, skipped = evaluation.golden_seeds(golden, claims)
    assert {(r.id, r.label, r.text) for r in seeds.collect()} == {
        ("g1", "combined-conclusion", "Exports run nightly, so backups give auditors complete recovery for 30 days. [[PR-000]] [[PR-001]]"), ("g2", "not-citable", "Billing runs monthly for partner resellers. [[PR-003]]"),
        ("g5", "positioning", "Start where you are."), ("g6", "untagged", "Exports run nightly to storage buckets"),
    }
    assert {(r.id, r.why) for r in skipped.collect()} == {("g3", "support quote not found in registry"), ("g4", "no support quote")}

    own = spark.createDataFrame([("P", "t", "true", "Audit logs are never deleted by operators. [[PR-002]]"), ("P", "two", "false", "Audit logs are never deleted by operators. [[PR-002]] Backups are kept for 90 days on the pro plan. [[PR-001]]"), ("P", "e", "positioning", "")], "product_id string, id string, label string, text string")
    conflicts = spark.createDataFrame([("k", "absolute-vs-exception", "open", ["PR-002", "PR-009"]), ("done", "absolute-vs-exception", "resolved", ["PR-000"])], "id string, kind string, status string, claim_ids array<string>")
    run = lambda size, conf: {r.id: r.blocked for r in evaluation.run(own.unionByName(seeds), claims, conf, size).collect()}
    free = run(40, conflicts.where("id = 'done'"))
    assert free == {"t": False, "two": True, "e": False, "g1": True, "g2": True, "g5": False, "g6": True}
    assert run(40, conflicts) == {**free, "t": True}  # the page cites a member of an open collision
    placed = evaluation.paged(own.unionByName(seeds), 2)
    assert sorted(r["count"] for r in placed.groupBy("item_id").count().collect()) == [1, 2, 2, 2]


def test_chunks_by_pointers_equal_a_fold(spark):
    rng = random.Random(8)
    docs = {i: ["w " * rng.choice([0, 1, 3, 50, 120, 400]) for _ in range(n)] for i, n in enumerate([0, 1, 2, 5, 40, 90])}
    want = set()
    for i, paragraphs in docs.items():
        done, words, said = [], 0, []
        for p in paragraphs:
            words, said = words + len(p.split()), [*said, p]
            if words >= 180:
                done, words, said = [*done, (words, said)], 0, []
        if words >= 90 or (not done and words > 0):
            done.append((words, said))
        want |= {(i, c, w, "\n\n".join(t for t in x if t)) for c, (w, x) in enumerate(done)}
    rows = [(i, 10 * at, t) for i, paragraphs in docs.items() for at, t in enumerate(paragraphs)]
    got = measures.greedy_chunks(spark.createDataFrame(rows, "doc_id long, pos int, text string")).collect()
    assert {(r.doc_id, r.chunk, r.words, r.text) for r in got} == want and len(got) == len(want)


def test_keyed_changes_over_restarts_and_replays(spark, tmp_path):
    schema = "source_id string, sha256 string, arrived_at timestamp"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    batches = [[("a", "A", at(1)), ("a", "A", at(2)), ("b", "X", at(1))], [("a", "B", at(3)), ("a", "A", at(4)), ("b", "X", at(2))], [("a", "A", at(5)), ("b", None, at(3)), ("c", None, at(1))], [("b", "X", at(4)), ("a", "C", at(7)), ("a", "B", at(6))]]
    run = lambda: feeds.keyed_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    for rows in batches:  # each run is a restart from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    newest = sorted((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))[-1]
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    newest.unlink()  # the last batch was not committed: it is replayed, from the state before it
    run()
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = sorted(map(repr, feeds.version_changes(every).collect()))
    assert sorted(map(repr, spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())) == want and len(want) == 8


def test_a_merge_that_is_not_committed_is_not_seen(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v int, said string"
    rows = lambda *x: spark.createDataFrame(x, schema)
    view = lambda: {(r.k, r.said) for r in store.compacted(spark, path, schema).collect()}
    assert view() == set()
    store.commit(spark, path, *store.merge(rows(*((i, 1, "old") for i in range(50))), path, ["k"], ["v"], 8))
    before = store._manifest(spark, path)
    assert view() == {(i, "old") for i in range(50)}
    pending = store.merge(rows((3, 2, "new"), (3, 0, "late"), (99, 1, "more")), path, ["k"], ["v"], 8)
    assert view() == {(i, "old") for i in range(50)} and store._manifest(spark, path) == before
    store.commit(spark, path, *pending)
    assert view() == {(i, "old") for i in range(50) if i != 3} | {(3, "new"), (99, "more")}
    assert sum(pending[1][b] != before[1].get(b) for b in pending[1]) <= 2  # other buckets stay as they are


def test_conflict_delta_equals_a_full_run(spark):
    rng = random.Random(6)
    ends = ["supports up to {} seats", "never supports {} seats", "supports up to {} seats except on trial", "is in beta", "is generally available", "is retired"]
    text = lambda: f"The {rng.choice(['amber', 'basil', 'cedar'])} {rng.choice(['export', 'billing', 'audit'])} module {rng.choice(ends).format(rng.randrange(1, 4))}"
    old = [("P", i, f"c{i:03d}", text(), i % 3, "verified", "capability", "high") for i in range(60)]
    new = [(*r[:3], text(), *r[4:]) if r[1] % 7 == 0 else (*r[:5], "deprecated", *r[6:]) if r[1] % 11 == 0 else r for r in old if r[1] % 13] + [("P", 60 + i, f"c{60 + i:03d}", text(), 1, "verified", "capability", "high") for i in range(5)]
    schema = "product_id string, num int, id string, text string, source_id int, status string, category string, confidence string"
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    sources = spark.createDataFrame([(0, "living", "1", "x"), (1, "changelog", "2", "x"), (2, "other", "3", "x")], "source_id int, kind string, updated string, fetched_at string")
    rows = lambda df: sorted(map(tuple, df.select("product_id", "a", "b", "kind", "rule", "interim_default").collect()), key=repr)
    delta = registry.conflict_delta(registry.conflict_features(b, sources), registry.conflict_features(a, sources), registry.conflict_pairs(a, sources))
    assert rows(delta) == rows(registry.conflict_pairs(b, sources)) != rows(registry.conflict_pairs(a, sources))
    before = registry.conflict_features(a, sources)
    by_class = registry.conflict_delta(registry.conflict_features(b, sources), before, registry.conflict_classes(before))
    assert rows(by_class) == rows(delta)


def test_frameworks_and_kinds_of_sources(spark):
    rows = spark.createDataFrame([("unaware", "Release notes 4", None), ("solution-aware", "Guide", " Changelog"), ("most-aware", "Launch brief", "other"), ("odd", "Guide", None), (None, None, None)], "stage string, name string, told string")
    got = rows.select(planning.framework(F.col("stage")), parse.source_kind(F.col("name"), F.col("told"))).collect()
    assert [tuple(r) for r in got] == [("PAS", "changelog"), ("BAB", "changelog"), ("AIDA", "brief"), (None, "living"), (None, "living")]
