"""Copies of a text are worked on once, and get what each of them would get alone."""

import random
import re

import oracle
from pyspark.sql import functions as F

from factgate.operators import gate, planning, registry, search
from factgate.plans import queries
from factgate.plans.oracles import ORACLES
from factgate.sources import driver_tables


def test_copies_are_matched_once(spark, monkeypatch):
    words = [["red", "fox"], ["red", "hen", "egg"], ["blue", "fox", "den"], ["egg"]]
    targets = [("p", i, words[i % 3]) for i in range(30)]
    asked = [("p", 100 + i, words[i % 4]) for i in range(40)]
    of = lambda rows, i: spark.createDataFrame(rows, f"p string, {i} long, tokens array<string>")
    seen, inner = [], search._best_classes

    def watched(q, t, *more):
        seen.append((q.count(), t.count()))
        return inner(q, t, *more)

    monkeypatch.setattr(search, "_best_classes", watched)
    got = {(r.query_id, r["rank"]): (r.target_id, r.shared) for r in search.best_matches(of(asked, "query_id"), of(targets, "target_id"), 12, ("p",)).collect()}
    want = {}
    for _, q, own in asked:
        scored = [(-len(set(own) & set(t)) / len(own) ** 0.5 / len(t) ** 0.5, i, len(set(own) & set(t))) for _, i, t in targets]
        for rank, (_, i, n) in enumerate([x for x in sorted((round(s, 9), i, n) for s, i, n in scored) if x[2]][:12], 1):
            want[q, rank] = (i, n)
    assert got == want and seen == [(4, 3)]


def test_briefs_with_one_ask_are_allocated_once(spark, monkeypatch, tmp_path):
    import duckdb
    import oracle

    c = oracle.connect()
    sizes = []
    inner = planning.allocate_sections
    monkeypatch.setattr(planning, "allocate_sections", lambda rows, *more: sizes.append(rows.select("brief_id").distinct().count()) or inner(rows, *more))
    for t in ("part", "region"):
        c.sql(f"SELECT * FROM {t}").write_parquet(f"{tmp_path}/{t}.parquet")
    c.sql("SELECT * REPLACE ((c_custkey + r.i * 25 * 101)::BIGINT AS c_custkey) FROM customer, range(3) r(i) WHERE c_custkey < 100").write_parquet(f"{tmp_path}/customer.parquet")
    rows = queries.section_alloc(spark, str(tmp_path)).select("brief_id").distinct().count()
    asks = duckdb.sql(f"SELECT count(DISTINCT (c_custkey % 25, c_custkey % 101)) FROM '{tmp_path}/customer.parquet'").fetchall()[0][0]
    assert sizes and sizes[0] <= asks and rows > sizes[0]


def test_conflicts_of_copies_are_judged_once(spark, monkeypatch, tmp_path):
    import duckdb
    import oracle
    from factgate.plans.oracles import ORACLES

    c = oracle.connect()
    for t in ("part", "region"):
        copies = "SELECT * REPLACE ((p_partkey + r.i * 100000)::BIGINT AS p_partkey) FROM part, range(4) r(i)" if t == "part" else "SELECT * FROM region"
        c.sql(copies).write_parquet(f"{tmp_path}/{t}.parquet")
    own = duckdb.connect()
    for t in ("part", "region"):
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    looked, inner = [], registry._candidates
    monkeypatch.setattr(registry, "_candidates", lambda feats, among=None: looked.append((feats.count(), feats.select("product_id", "text", "src", "age").distinct().count())) or inner(feats, among))
    for name in ("conflict_pairs", "conflict_delta"):
        got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), own.sql(ORACLES[name]).df()
        assert len(got) and oracle.rows(got) == oracle.rows(want[list(got.columns)])
    assert looked and all(n == distinct for n, distinct in looked)


def test_matching_is_dealt_and_keeps_to_its_bound(spark):
    target = spark.createDataFrame([("p", i, ["red", f"w{i}"]) for i in range(40)], "p string, target_id long, tokens array<string>")
    asked = [("p", 1, 2, ["w1", "red"], bound, r, token) for r, token, bound in ((1, "w1", 1.0), (2, "red", 0.0))]
    looked = spark.createDataFrame(asked, "p string, query_id long, n int, q array<string>, bound double, r int, token string")
    tight = search._scored(looked.where("bound = 1"), target, ("p",), "score", True)
    assert [(r.target_id, round(r.score, 9)) for r in tight.collect()] == [(1, 1.0)]
    counted = search._scored(looked.where("r = 2").withColumn("bound", F.lit(0.9)), target, ("p",), "score", True, count=True)
    assert counted.count() == 0  # one of two tokens is 0.5
    dealt = search._scored(looked.where("bound = 0"), target, ("p",), "score", True)
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sentences_of_copies_are_judged_once(spark, monkeypatch):
    of = spark.createDataFrame
    claims = of([(f"PT-10{i}", "p", "verified", "Widget supports up to 5 units.") for i in range(9)], "id string, product_id string, status string, text string")
    said = [(i, 0, "p", f"Widget supports up to {5 if i % 3 else 7} units. [[PT-10{i}]]", "sentence") for i in range(9)]
    near = gate.registry_overlap(of(said, "item_id long, index int, product_id string, text string, kind string"), claims)
    sizes, inner = [], gate._cases
    monkeypatch.setattr(gate, "_cases", lambda rows: sizes.append(inner(rows).count()) or inner(rows))
    got = {r.item_id: (r.verdict, r.reason) for r in gate.verify(near, claims, vocabulary=gate.known_vocabulary(claims)).collect()}
    assert got == {i: ("pass", None) if i % 3 else ("block", "contradicted") for i in range(9)} and sizes == [2]


def test_claims_that_say_the_same_are_quoted_once(spark):
    rows = [("p", i, f"C-{i}", "verified" if i > 3 else "deprecated", f"Widget  supports {i % 2} units.") for i in range(8)]
    claims = spark.createDataFrame(rows, "product_id string, pos int, id string, status string, text string")
    golden = spark.createDataFrame([("p", "supports 1 units."), ("p", "SUPPORTS 1  units."), ("p", None), ("q", "supports 1 units.")], "product_id string, quote string")
    assert planning._quotable(claims).count() == 2
    got = [(r.product_id, r.quote, r.claim_id) for r in planning.golden_matches(golden, claims).collect()]
    assert sorted(got, key=str) == sorted([("p", "supports 1 units.", "C-5"), ("p", "SUPPORTS 1  units.", "C-5"), ("p", None, None), ("q", "supports 1 units.", None)], key=str)


def test_parts_are_dealt_before_claims_are_rendered(spark):
    on = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(on, "false")
    try:
        assert driver_tables.claims(spark, oracle.SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(on)


def test_texts_are_cut_into_tokens_once(spark, monkeypatch):
    written, inner = [], search.materialized
    monkeypatch.setattr(search, "materialized", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or inner(df))
    rows = spark.createDataFrame([(1, "A red fox. Don't."), (2, "a RED fox don't"), (3, "blue hens")], "target_id long, text string")
    one, members = search._classes(search.token_arrays(rows, "target_id", "text"), "target_id", ())
    assert {(r.target_id, tuple(sorted(r.tokens))) for r in one.collect()} == {(1, ("don't", "fox", "red")), (3, ("blue", "hens"))}
    assert {(r.target_id, r["__class"]) for r in members.collect()} == {(1, 1), (2, 1), (3, 3)}
    assert [x.count("regexp_extract_all") for x in written] == [1, 0, 0]


def test_texts_of_other_targets_are_not_shuffled_for_stems(spark):
    best = spark.createDataFrame([(1, 7)], "query_id long, target_id long")
    said = spark.createDataFrame([(i, f"red fox {i}") for i in range(50)], "target_id long, text string")
    got = search._stems_covered(best, spark.createDataFrame([(1, "red foxes")], "query_id long, text string"), said, ())
    assert [(r.query_id, r.target_id) for r in got.collect()] == [(1, 7)] and "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_units_and_verdicts_are_shuffled_once(spark):
    units = spark.createDataFrame([(1, 0, "One."), (None, 1, "Two."), (1, None, "Two.")], "item_id int, index int, text string")
    reviewed = spark.createDataFrame([(1, 0, "one.", "pass", "a"), (None, 1, "two.", "flag", "b"), (1, None, "other", "block", "c")], "item_id int, index long, text string, verdict string, reason string")
    got = gate.align_verdicts(units, reviewed)
    assert got.schema["index"].dataType.simpleString() == "int"
    assert sorted(((r.item_id, r["index"], r.r_verdict) for r in got.collect()), key=repr) == sorted([(1, 0, "pass"), (None, 1, None), (1, None, None)], key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_drafts_and_sentences_are_read_once(spark):
    d = "/root/testdata/sf0.001"
    plan = lambda q: q(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan(queries.gate_report) and "split(" not in plan(queries.staleness)


def test_markdown_lines_are_stripped_once(spark):
    from factgate.functions import text as T
    from factgate.sources import parse

    df = spark.createDataFrame([("s", "# A\n\n| x | y |\ntext")], "source_id string, body string")
    plan = parse.markdown_blocks(df)._jdf.queryExecution().optimizedPlan().toString()
    strips = f"^{T.JAVA_SPACE}+|{T.JAVA_SPACE}+$"
    assert plan.count(f"regexp_replace(line#") and sum(strips in x for x in plan.split("regexp_replace(line#")[1:]) <= 2


def test_claims_are_not_broadcast_to_pages(spark, tmp_path):
    c = oracle.connect()
    c.sql("SELECT * REPLACE ((p_partkey + r.i * 100000)::BIGINT AS p_partkey) FROM part, range(20) r(i)").write_parquet(f"{tmp_path}/part.parquet")
    plan = queries.page_claims(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"BroadcastHashJoin \[(.*?)\]", plan)
    assert "SortMergeJoin" in plan and all("token" in k for k in keys)  # looked-up tokens alone, which are bounded


def _classes_of_conflicts(spark):
    """Two products' claims in classes, and conflicts between these, as classes and as pairs of members."""
    rng = random.Random(4)
    members = [(f"P{i % 2}", f"c{i:02}", f"c{i % 12:02}") for i in range(36)]
    found = [(f"P{a % 2}", f"c{a:02}", f"c{b:02}", rng.choice(["absolute-vs-exception", "contradiction"]), "x", rng.choice(["a", "b", None])) for a in range(12) for b in range(a + 2, 12, 2) if rng.random() < 0.6]
    claims = [(p, i, f"It is {'always ' if c[-1] in '134' else ''}so.") for p, i, c in members]
    of = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    return of(found, "product_id a b kind rule held"), of(members, "product_id id class"), of(claims, "product_id id text")


def test_tension_by_class_equals_that_of_all_pairs(spark):
    found, members, claims = _classes_of_conflicts(spark)
    rng = random.Random(5)
    units = [(rng.randrange(9), rng.choice([None, *range(6)]), f"c{rng.randrange(40):02}") for _ in range(90)] + [(None, 1, "c01"), (None, 2, "c03"), (7, 1, None)]
    units = spark.createDataFrame(units, "item_id int, index int, cited_id string")
    pairs = registry.conflict_members(found, members).select(F.concat_ws("~", "a", "b").alias("id"), "kind", F.lit("open").alias("status"), F.array("a", "b").alias("claim_ids"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = gate.class_tension(units, found, members, claims)
    assert rows(got) == rows(gate.page_tension(units, pairs, claims).select(*got.columns)) and got.where("verdict = 'block' AND n_sentences > 1").count()


def test_pairs_of_conflicts_are_not_shuffled(spark):
    found, members, claims = _classes_of_conflicts(spark)
    stale = claims.where("id < 'c07'").select("product_id", "id")
    touched, every = registry.conflict_members(found, members, stale), registry.conflict_members(found, members)
    old = {r.id for r in stale.collect()}
    want = [(r.a, r.b, r.a in old, r.b in old, r.interim_default) for r in every.collect() if {r.a, r.b} & old]
    assert sorted(want, key=repr) == sorted(map(tuple, touched.select("a", "b", "a_asked", "b_asked", "interim_default").collect()), key=repr) and want
    units = spark.createDataFrame([(1, 0, "c01")], "item_id int, index int, cited_id string")
    conflicts = touched.select(F.concat_ws("~", "a", "b").alias("id"), F.array_compact(F.array(F.when(F.col("a_asked"), F.col("a")), F.when(F.col("b_asked"), F.col("b")))).alias("claim_ids"))
    listed = lambda df: sorted((r.kind, r.id, tuple(r.claim_ids)) for r in df.collect())
    all_pairs = every.select(F.concat_ws("~", "a", "b").alias("id"), F.array("a", "b").alias("claim_ids"))
    got = gate.affected(stale, units, conflicts, touched=True)
    assert listed(got) == listed(gate.affected(stale, units, all_pairs))
    before_pairs = lambda df, n: "Exchange" not in "".join(df._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin [product_id")[:n])
    assert before_pairs(touched, 1) and before_pairs(every, 1)  # nothing is shuffled after members have met


def test_sentences_of_a_report_are_not_written(spark, monkeypatch):
    written, inner = [], queries.materialized
    monkeypatch.setattr(queries, "materialized", lambda df: written.append(df.columns) or inner(df))
    oracle.same(queries.gate_report(spark, oracle.SF), ORACLES["gate_report"])
    assert written and not any("text" in columns for columns in written)


def test_aligned_units_keep_their_columns(spark):
    units = spark.createDataFrame([(1, 1, "A  b", "x"), (1, 2, "c", "y"), (None, 3, "c", "z"), (2, None, None, None)], "item_id int, index int, text string, more string")
    reviewed = spark.createDataFrame([(1, 9, "a b", "pass", None, 1), (1, 2, "other", "flag", "r", 2), (1, 8, "c", "block", "s", 3), (None, 3, "c", "pass", None, 4)], "item_id long, index long, text string, verdict string, reason string, seq int")
    got = gate.align_verdicts(units, reviewed)
    assert got.schema[:4] == units.schema[:4] and sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 1, "A  b", "x", "pass", None), (1, 2, "c", "y", "block", "s"), (None, 3, "c", "z", None, None), (2, None, None, None, None, None)], key=repr)
