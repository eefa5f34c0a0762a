from pyspark.sql import functions as F

from factgate.operators import style


def test_guardrails_stay_within_their_words(spark):
    rows = [
        ("D1", "P", "Never use the words 'cheap' or 'simple' in our copy. Lead with safety."),
        ("D2", "P", "Always call it Acme Lantern, never 'Lantern One' or just Acme."),
        ("D3", "P", "Deprioritize the self-hosted deployment in copy. Keep it short."),
        ("D4", "Q", "Do not use the term bargain."),
    ]
    g = style.guardrails(spark.createDataFrame(rows, "id string, product_id string, text string"))
    got = {(r.decision_id, r.pos): (r.type, r.terms) for r in g.collect()}
    assert got["D1", 0] == ("banned-term", ["cheap", "simple"]) and got["D1", 1] == ("emphasis", [])
    assert got["D2", 0][0] == "naming" and got["D2", 0][1][:2] == ["Acme Lantern", "Lantern One"]
    assert got["D3", 0] == ("deprioritize", ["self-hosted"]) and got["D3", 1] == ("other", []) and got["D4", 0] == ("banned-term", ["bargain"])
    lists = style.term_lists(g)
    p = lists.where("product_id = 'P'").first()
    assert p.banned == ["cheap", "simple"] and p.product_name == "Acme Lantern" and "Lantern One" in p.forbidden and p.excluded == ["self-hosted"]
    claims = spark.createDataFrame([("P", "1", "A cheap lamp."), ("P", "2", "A cheaper lamp."), ("Q", "3", "A cheap lamp."), ("R", "4", "x")], "product_id string, id string, text string")
    assert {r.id for r in style.allowed_claims(claims, lists).collect()} == {"2", "3", "4"}
    drafts = spark.createDataFrame([("P", "Buy Lantern One now")], "product_id string, md string")
    assert style.apply_naming(drafts, lists).first()["md"] == "Buy Acme Lantern now"


def test_profile_and_scores(spark):
    text = "Your lantern guides every evening walk. You choose warm light and your garden glows softly. " * 20
    docs = spark.createDataFrame([("P", i, text) for i in range(6)] + [("Q", 9, "Too short.")], "product_id string, doc_id int, text string")
    products = spark.createDataFrame([("P", "Lantern"), ("Q", "Quill")], "product_id string, name string")
    lists = spark.createDataFrame([("P", ["cheap"], ["Lamp"], "Lantern", [])], "product_id string, banned array<string>, forbidden array<string>, product_name string, excluded array<string>")
    profile = style.style_profile(docs, products, lists)
    row = profile.first()
    assert profile.count() == 1 and "lantern" in row.preferred and set(row.avoid) == set(style.HYPE)
    good, bad, banned = text[:200], "A revolutionary, seamless Lamp! Buy! Now! Best!", text[:200] + " So cheap."
    d = spark.createDataFrame([(1, "P", good), (2, "P", bad), (3, "P", banned)], "item_id int, product_id string, md string")
    s = {r.item_id: r for r in style.profile_score(d, profile).collect()}
    assert s[1].score > 0.8 > s[2].score and s[3].score == 0.4 and s[2].forbidden_hits == ["Lamp"] and set(s[2].hype) == {"revolutionary", "seamless"}
    assert row.heading_case == "sentence"
    titled = spark.createDataFrame([(4, "P", "# Every Evening Walk Glows\n" + good), (5, "P", "# every evening walk\n" + good)], "item_id int, product_id string, md string")
    assert {r.item_id: r.scores["formatting"] for r in style.profile_score(titled, profile).collect()} == {4: 0.5, 5: 1.0}
    checked = {r.item_id: (r.passed, {(f.severity, f.issue) for f in r.flags}) for r in style.style_check(style.profile_score(d, profile), spark.createDataFrame([("P", 0.7)], "product_id string, threshold double")).collect()}
    assert checked[1] == (True, set()) and checked[3] == (False, {("high", "banned-term"), ("high", "below-threshold")}) and ("high", "forbidden-name") in checked[2][1]
    chunks = spark.createDataFrame([(1, 0, good)], "doc_id int, chunk int, text string")
    off = style.off_brand(chunks).select(F.monotonically_increasing_id().alias("item_id"), F.lit("P").alias("product_id"), F.col("text").alias("md"))
    on = spark.createDataFrame([(100, "P", good), (101, "P", text[:300])], "item_id long, product_id string, md string")
    scored = style.profile_score(on.unionByName(off), profile).select("score", (F.col("item_id").between(100, 101)).cast("int").alias("label"))
    assert style.calibrate(scored).first()["auc"] >= 0.75


def test_structure_and_readers(spark):
    rows = [(1, "lp", 0, "heading", 1, "Lantern at home"), (1, "lp", 1, "heading", 2, "Benefits"), (1, "lp", 2, "sentence", 0, "Book a demo today."), (2, "lp", 0, "sentence", 0, "It is."), (3, "email", 0, "sentence", 0, "Lantern is here. Book it.")]
    units = spark.createDataFrame(rows, "item_id int, content_type string, index int, kind string, level int, text string")
    types = spark.createDataFrame([("lp", ["hero", "benefits"], 3, 20), ("email", ["hero", "benefits"], 3, 20)], "content_type string, required array<string>, min_words int, max_words int")
    got = {r.item_id: r for r in style.structure_audit(units, types).collect()}
    assert (got[1].structure, got[1].cta, got[1].length, got[1].positioning, got[1].stage, got[1].score) == (1.0, 1.0, 1.0, 0.5, 1.0, 0.9)
    assert got[2].cta == 0.0 and abs(got[2].structure - 0.15) < 1e-9 and got[3].structure == 0.3
    issues = {i: [(f.severity, f.issue, f.detail) for f in r.flags] for i, r in got.items()}
    assert issues[1] == [] and issues[2] == [("high", "no-headline", None), ("low", "missing-sections", "benefits"), ("high", "no-call-to-action", None), ("low", "length", "2")]
    assert {i: r.passed for i, r in got.items()} == {1: True, 2: False, 3: not any(f.severity == "high" for f in got[3].flags)}
    context = spark.createDataFrame([(1, "aware", "Lantern", ["demo booked late"]), (3, "unaware", "Lantern", None)], "item_id int, stage string, product_name string, pains array<string>")
    told = {r.item_id: r for r in style.structure_audit(units, types, context).collect()}
    assert told[1].positioning == 1.0 and told[3].stage == 0.5 and told[2].stage == 1.0
    assert [f.issue for f in told[3].flags if f.issue == "opens-with-product"] == ["opens-with-product"]
    drafts = spark.createDataFrame([(1, "P", "Fast setup and clear pricing for security reviews."), (2, "P", "Hello."), (3, "P", "Fast setup.")], "item_id int, product_id string, text string")
    personas = spark.createDataFrame([("P", ["fast setup", "clear pricing"], ["security reviews"])], "product_id string, priorities array<string>, objections array<string>")
    assert {r.item_id: r.verdict for r in style.reader_coverage(drafts, personas).collect()} == {1: "yes", 2: "no", 3: "maybe"}
    claims = spark.createDataFrame([("P", "c1", "Security reviews run yearly", "verified"), ("P", "c2", "Security audits", "deprecated"), ("Q", "c3", "Security reviews", "verified")], "product_id string, id string, text string, status string")
    more = personas.withColumn("objections", F.array(F.lit("security reviews"), F.lit("hidden onboarding fees")))
    assert {tuple(r) for r in style.open_objections(drafts, more, claims).collect()} == {(1, "hidden onboarding fees", False), (2, "security reviews", True), (2, "hidden onboarding fees", False), (3, "security reviews", True), (3, "hidden onboarding fees", False)}


def test_seeds_are_bounded_and_repeatable(spark):
    c = spark.createDataFrame([(f"PT-{i:03}", "P", f"It supports {i} units on the pro plan.", "metric", "verified" if i % 3 else "deprecated") for i in range(60)], "id string, product_id string, text string, category string, status string")
    a, b = (sorted(map(tuple, style.seed_set(x, 5).collect())) for x in (c, c.repartition(5)))
    kinds = ("true", "untagged", "false", "overstated", "partial", "not-citable")
    assert a == b and {k: sum(r[2] == k for r in a) for k in (*kinds, "positioning")} == {**dict.fromkeys(kinds, 5), "positioning": 6}
    for _, i, label, text in a:
        own = f"It supports {int(i[3:])} units on the pro plan." if i.startswith("PT") else ""
        if label == "partial":
            assert text.startswith(own[:-1] + ", and it also supports ") and text.endswith(f"[[{i}]]")
        elif label == "false":
            assert text == f"It supports {int(i[3:]) * 2 + 1} units on the pro plan. [[{i}]]"
        elif label == "overstated":
            assert text != own + f" [[{i}]]" and (text == f"It supports {int(i[3:])} units. [[{i}]]" or any(f"It {w.removeprefix('the ')} supports" in text for w in ("the only", "always", "every", "the fastest", "guaranteed", "fully")))
        elif label in ("true", "not-citable", "untagged"):
            assert text == own + ("" if label == "untagged" else f" [[{i}]]")


def test_variants_and_heading_case(spark):
    docs = spark.createDataFrame([("P", i, "See Acme Cloud here. The Acme now. See Acme Cloud.") for i in range(2)], "product_id string, doc_id int, text string")
    v = style.name_variants(docs, spark.createDataFrame([("P", "Acme Lantern")], "product_id string, name string")).collect()
    assert [(r.variant, r.n) for r in v] == [("See Acme Cloud", 4)]
    one = lambda t: spark.createDataFrame([(t,)], "t array<string>").select(style.heading_case(F.col("t")).alias("x")).first()["x"]
    assert one(["Why Teams Choose Lantern"]) == "title" and one(["Why teams choose lantern"]) == "sentence" and one([]) == "sentence"


def test_rules_change_profiles(spark):
    schema = "product_id string, product_name string, status string, banned array<string>, preferred array<string>, forbidden array<string>, variants array<string>, derived array<struct<decision_id:string,rule:string>>, issues array<string>"
    profiles = spark.createDataFrame([("P", "Lantern", "active", ["synergy"], ["Robust", "calm", "synergy"], ["Lamp"], ["Lantern App", "Light", "Lamp"], [("d1", "Do not use 'robust' in copy.")], []), ("Q", "Moth", "active", [], ["calm"], [], ["Moth"], [], []), ("R", "Owl", "active", [], [], [], [], [], ["odd"])], schema)
    decisions = spark.createDataFrame([("P", "d1", "Never use the words 'robust', 'agile'."), ("P", "d2", "Always call it Lantern, never Light."), ("Q", "d3", "Always call it Bat, never Moth. Deprioritize the on-prem option.")], "product_id string, id string, text string")
    got = {r.product_id: r for r in style.apply_rules(profiles, style.guardrails(decisions)).collect()}
    p, q = got["P"], got["Q"]
    assert (p.banned, p.preferred, p.forbidden, p.variants, p.status) == (["agile", "robust", "synergy"], ["calm"], ["Lamp", "Light"], ["Lantern App"], "active")
    assert [d.decision_id for d in p.derived] == ["d1", "d1", "d2"] and p.derived[0].rule != p.derived[1].rule
    assert (q.forbidden, q.variants, q.issues, q.status) == (["Moth"], [], ["product-name-forbidden"], "draft") and [d.decision_id for d in q.derived] == ["d3"]
    assert got["R"].status == "draft" and got["R"].derived == []


def test_terms_are_sought_where_the_text_holds_them(spark):
    rows = [("Best-in-class, the BEST. It costs $5 (net)", ["best", "Best-in-Class", "cost", "$5", "net", "a.b", ""]), (None, ["best"]), ("none", None), ("", [""]), ("axb", ["a.b"])]
    df = spark.createDataFrame(rows, "t string, w array<string>")
    got = [r.h for r in df.select(style.hits(F.col("t"), F.col("w")).alias("h")).collect()]
    plain = [r.h for r in df.select(F.filter("w", lambda w: style.has_term(F.col("t"), w)).alias("h")).collect()]
    assert got == plain and got[0][:2] == ["best", "Best-in-Class"] and "contains" in str(style.hits(F.col("t"), F.col("w")))
