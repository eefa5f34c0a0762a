"""The copy gate: citations, sentence verdicts, page checks, draft status and what happens to live content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.shared import large, materialized
from .search import best_matches, token_arrays


CHECKERS = ("style-checker", "best-practice-auditor", "synthetic-buyer")


def cited(units: DataFrame, claims: DataFrame, high_risk: Sequence[str] = L.HIGH_RISK) -> DataFrame:
    """units (…, cited_id) with the cited claim's status and the rule that citing it breaks: (…, claim_status, verdict, reason).

    Claims that do not exist block, as do deprecated and unreviewed ones, and low-confidence ones of a high-risk
    category unless a reviewer confirmed them (claims.decision); other low-confidence claims flag.
    """
    decision = F.col("decision") if "decision" in claims.columns else F.lit(None).cast("string")
    c = claims.select(F.col("id").alias("cited_id"), F.col("status").alias("claim_status"), "category", "confidence", decision.alias("__decision"))
    low = F.col("confidence") == "low"
    reason = (
        F.when(F.col("claim_status").isNull(), "missing-claim")
        .when(F.col("claim_status") == "deprecated", "deprecated")
        .when(F.col("claim_status") != "verified", "needs-review")
        .when(low & F.col("category").isin(*high_risk) & ~F.col("__decision").eqNullSafe("confirmed"), "high-risk-low-confidence")
        .when(low, "low-confidence")
    )
    verdict = F.when(F.col("reason").isNull(), "pass").when(F.col("reason") == "low-confidence", "flag").otherwise("block")
    return units.join(c, "cited_id", "left").withColumn("reason", reason).withColumn("verdict", verdict).drop("category", "confidence", "__decision")


def unit_verdicts(citations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One verdict per unit from its citations in order (pos): the first block wins, else the first flag, else pass."""
    ranked = F.when(F.col("verdict") == "block", 0).when(F.col("verdict") == "flag", 1).otherwise(2)
    first = F.min_by(F.struct("verdict", "reason"), F.struct(ranked, F.col("pos"))).alias("v")
    return citations.groupBy(*keys).agg(first).select(*keys, "v.verdict", "v.reason")


def said(text: Column) -> Column:
    """What two versions of a sentence are compared by: without tags, single spaces, lower case."""
    return F.lower(T.single_spaced(T.strip_tags(text)))


def align_verdicts(units: DataFrame, reviewed: DataFrame, key: str = "item_id") -> DataFrame:
    """units (key, index, text, …) with the verifier's r_verdict, r_reason: that of the index where the texts agree, else that of the text.

    reviewed: (key, index, text, verdict, reason); of several for an index or a text the last by seq (index without it) counts.
    Units and verdicts of a draft are shuffled together, once; null keys, indexes and texts meet nothing.
    """
    seq = F.col("seq") if "seq" in reviewed.columns else F.col("index")
    at = (F.col(key).alias("__key"), F.col("index").alias("__index"), F.col("text").alias("__text"))
    more = [c for c in units.columns if c not in (key, "index", "text")]
    u = units.select(*at, F.struct(F.lit(True).alias("__is"), *more).alias("__unit"))
    both = u.unionByName(reviewed.select(*at, F.struct(seq.alias("seq"), "verdict", "reason").alias("__r")), allowMissingColumns=True).repartition("__key")  # each text once
    v = F.when(F.col("__r").isNotNull(), F.struct("__r.seq", F.col("__index").alias("index"), "__r.verdict", "__r.reason"))
    both = both.withColumns({"__said": said(F.col("__text")), "__v": v}).drop("__r")
    both = both.withColumn("__i", F.max_by(F.when(F.col("__v").isNotNull(), F.struct("__said", "__v")), F.col("__v")).over(Window.partitionBy("__key", "__index")))
    both = both.withColumn("__t", F.max("__v").over(Window.partitionBy("__key", "__said"))).where(F.col("__unit").isNotNull())
    met = F.col("__key").isNotNull()
    v = F.when(met & F.col("__index").isNotNull() & (F.col("__i.__said") == F.col("__said")), F.col("__i.__v")).when(met & F.col("__said").isNotNull(), F.col("__t"))
    own = {key: "__key", "index": "__index", "text": "__text"}
    columns = [F.col(own[c]).cast(units.schema[c].dataType).alias(c) if c in own else F.col(f"__unit.{c}").alias(c) for c in units.columns]
    return both.withColumn("__v", v).select(*columns, F.col("__v.verdict").alias("r_verdict"), F.col("__v.reason").alias("r_reason"))


def enforce(units: DataFrame, mechanical: DataFrame, marks: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """Final verdicts (key, index, text, verdict, reason) of aligned units: the verifier's, made stricter by the rules of citing.

    No verdict blocks as untagged; a mechanical block always wins, a mechanical flag lifts a pass only.  A reviewer's mark
    (key, sentence) clears a sentence that cites nothing and is blocked as untagged.
    """
    m = mechanical.select(key, "index", F.col("verdict").alias("m_verdict"), F.col("reason").alias("m_reason"))
    both = units.join(m, [key, "index"], "left")
    outcome = lambda v, r: F.struct(v.alias("verdict"), r.alias("reason"))
    takes = (
        F.when((F.col("m_verdict") == "block") | ((F.col("m_verdict") == "flag") & (F.col("r_verdict") == "pass")), outcome(F.col("m_verdict"), F.col("m_reason")))
        .when(F.col("r_verdict").isNull(), outcome(F.lit("block"), F.lit("untagged")))
        .otherwise(outcome(F.col("r_verdict"), F.col("r_reason")))
    )
    both = both.withColumn("__t", takes)
    if marks is not None:
        marked = marks.select(key, said(F.col("sentence")).alias("__said")).distinct().withColumn("__marked", F.lit(True))
        may = (F.col("__t.verdict") == "block") & (F.col("__t.reason") == "untagged") & (F.size(T.tags_in(F.col("text"))) == 0)
        both = both.withColumn("__said", F.when(may, said(F.col("text")))).join(marked, [key, "__said"], "left")  # what no mark can clear meets none
        both = both.withColumn("__t", F.when(F.col("__marked"), outcome(F.lit("pass"), F.lit(None).cast("string"))).otherwise(F.col("__t")))
    return both.select(key, "index", "text", "__t.verdict", "__t.reason")


def usable_verdicts(drafts: DataFrame, reviewed: DataFrame, results: DataFrame, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(verdicts of gate results for exactly the draft's hash, drafts without such a result).

    drafts: (key, draft_hash); results: (key, draft_hash), one per draft, a null hash fits every draft.
    """
    of = results.select(key, F.col("draft_hash").alias("__hash"), F.lit(True).alias("__has"))
    with_result = drafts.select(key, "draft_hash").join(of, key, "left")
    fits = F.coalesce(F.col("__has") & (F.col("__hash").isNull() | (F.col("__hash") == F.col("draft_hash"))), F.lit(False))
    return reviewed.join(with_result.where(fits).select(key), key, "left_semi"), with_result.where(~fits).select(key)


def checker_flags(enabled: DataFrame, reports: DataFrame, raised: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, source, severity, missing): what the enabled checkers (key, checker) say about each draft.

    reports: (key, checker, status, verdict); raised: (key, checker, severity).  A missing or unavailable checker counts
    high and as missing, a missing buyer only as missing (null severity); a buyer who does not say yes counts low.
    """
    both = enabled.join(reports.withColumn("__has", F.lit(True)), [key, "checker"], "left")
    buyer, here = F.col("checker") == "synthetic-buyer", F.coalesce(F.col("__has"), F.lit(False))
    away = ~here | (~buyer & F.col("status").eqNullSafe("checker-unavailable"))
    severity = F.when(away, F.when(~buyer, "high")).when(buyer & ~F.col("verdict").eqNullSafe("yes"), "low")
    own = both.select(key, F.col("checker").alias("source"), severity.alias("severity"), away.alias("missing")).where("missing OR severity IS NOT NULL")
    heard = both.where(~away & ~buyer).select(key, "checker").join(raised, [key, "checker"])
    return own.unionByName(heard.select(key, F.col("checker").alias("source"), "severity", F.lit(False).alias("missing")))


def combine(drafts: DataFrame, verdicts: DataFrame, unchecked: DataFrame, page_checks: DataFrame, checkers: DataFrame, overrides: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """One report per draft (key, draft_hash): (key, block_count, high_count, low_count, missing, status).

    Sentence and page blocks block, as does a missing gate result; their flags count low.  Any block makes a draft
    blocked, else any high flag flagged, else it is approved; an override (key, draft_hash) of the same text approves what is not.
    """
    gate = verdicts.unionByName(page_checks, allowMissingColumns=True).where("verdict <> 'pass'").select(key, F.when(F.col("verdict") == "block", "block").otherwise("low").alias("severity"), F.lit(None).cast("string").alias("missing"))
    none = unchecked.select(key, F.lit("block").alias("severity"), F.lit(None).cast("string").alias("missing"))
    heard = checkers.select(key, "severity", F.when(F.col("missing"), F.col("source")).alias("missing"))
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}_count")
    counted = gate.unionByName(none).unionByName(heard).groupBy(key).agg(n("block"), n("high"), n("low"), F.array_sort(F.collect_set("missing")).alias("missing"))
    out = drafts.select(key, "draft_hash").join(counted, key, "left").fillna(0, ["block_count", "high_count", "low_count"])
    status = F.when(F.col("block_count") > 0, "blocked").when(F.col("high_count") > 0, "flagged").otherwise("approved")
    out = out.withColumn("status", status).withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    if overrides is not None:
        same = overrides.select(key, "draft_hash").distinct().withColumn("__over", F.lit(True))
        out = out.join(same, [key, "draft_hash"], "left").withColumn("status", F.when(F.col("__over") & (F.col("status") != "approved"), "approved-override").otherwise(F.col("status"))).drop("__over")
    return out.drop("draft_hash")


def report_status(verdicts: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per draft from its citations alone: sentence counts by verdict and reason; flags of the gate are low, so only blocks stop it."""
    n = lambda cond: F.count_if(cond)
    out = verdicts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_units"),
        n(F.col("verdict") == "block").alias("blocks"),
        n(F.col("verdict") == "flag").alias("flags"),
        n(F.col("reason") == "missing-claim").alias("missing"),
        n(F.col("reason") == "deprecated").alias("deprecated"),
        n(F.col("reason") == "needs-review").alias("unreviewed"),
    )
    return out.withColumn("status", F.when(F.col("blocks") > 0, "blocked").otherwise("approved"))


def can_export(live_status: Column) -> Column:
    """Whether a live version of this status (null: none) may leave the house."""
    return F.coalesce(live_status.isin("approved", "approved-override"), F.lit(False))


def classify(text: Column, kind: Column, reg_n: Column, reg_ratio: Column, tagged: Column | None = None) -> Column:
    """factual, positioning or positioning-hiding-fact, by the first rule that fits; reg_n and reg_ratio: stems shared with the nearest claim; tagged: whether the text had tags, where they are gone."""
    t = F.trim(T.strip_tags(text))
    has_num, tagged = F.size(T.numbers(text)) > 0, F.size(T.tags_in(text)) > 0 if tagged is None else tagged
    absolute, verb, normative = t.rlike(L.SUPERLATIVE), t.rlike(L.FACT_VERB), t.rlike(L.NORMATIVE)
    short = (kind == "heading") | (F.size(F.split(t, r"\s+")) <= 7)
    imagined = t.rlike(r"(?i)^(if|imagine|what if|picture|when)\b") & ~absolute & (reg_ratio < 0.6)
    return (
        F.when((t == "") | t.endswith("?") | (t.rlike(L.CALL_TO_ACTION) & ~has_num), "positioning")
        .when((reg_n >= 3) & (reg_ratio >= 0.6) & ~normative, F.when((kind == "heading") & ~tagged, "positioning-hiding-fact").otherwise("factual"))
        .when(short & (has_num | (absolute & verb) | t.rlike(L.QUANTIFIER)), "positioning-hiding-fact")
        .when(short, F.when(tagged, "factual").otherwise("positioning"))
        .when(has_num | tagged, "factual")
        .when(imagined | normative, "positioning")
        .when((reg_n >= 3) & (reg_ratio >= 0.5), "factual")
        .when((reg_n <= 1) & ~absolute, "positioning")
        .otherwise(F.when(verb, "factual").otherwise("positioning"))
    )


def support(text: Column, claim: Column, n_cited: Column, vocabulary: Column) -> Column:
    """Why cited text does not support a sentence, by the first rule that fails; null where it does."""
    low, c_low = F.lower(text), F.lower(claim)
    has_word = lambda hay, word: F.rlike(hay, F.concat(F.lit(r"\b\Q"), word, F.lit(r"\E\b")))
    new_absolute = F.exists(F.transform(T.found(text, L.SUPERLATIVE), F.lower), lambda w: ~has_word(c_low, w))
    sn, cn = T.numbers(text), T.numbers(claim)
    s_stems, c_stems = T.stems_gate(text), T.stems_gate(claim)
    negation = (text.rlike(L.GATE_NEGATION) != claim.rlike(L.GATE_NEGATION)) & (T.jaccard(s_stems, c_stems) >= 0.6)

    def dropped(cond: Column) -> Column:
        words = F.filter(T.tokens(cond), lambda w: F.length(w) > 2)
        words = F.when(F.size(words) > 0, words).otherwise(F.array(F.trim(F.lower(cond))))
        return F.exists(words, lambda w: ~F.rlike(low, F.concat(F.lit(r"\b\Q"), w, F.lit(r"\E"))))

    own = F.array_except(s_stems, T.strings(L.GENERIC_STEMS))
    extra = F.filter(F.array_except(own, c_stems), lambda w: ~w.rlike(r"^\d+$"))
    much = (F.size(extra) >= 2) & ((F.size(extra) / F.greatest(F.lit(1), F.size(own)) > 0.34) | F.arrays_overlap(extra, vocabulary))
    return (
        F.when(new_absolute, "overstated")
        .when(F.size(F.array_except(sn, cn)) > 0, F.when(F.size(cn) > 0, "contradicted").otherwise("partial"))
        .when(negation, "contradicted")
        .when(F.exists(T.found(claim, L.CONDITION), dropped), "overstated")
        .when((F.size(own) > 0) & (much | (F.size(extra) >= 4)), F.when(n_cited > 1, "combined-conclusion").otherwise("partial"))
    )


def registry_overlap(sentences: DataFrame, claims: DataFrame, keys: Sequence[str] = ("item_id", "index"), product: str = "product_id") -> DataFrame:
    """sentences (keys, product, text, …) with best_id, the nearest claim of the product's registry, and reg_n, reg_ratio: the stems shared with it.

    Equal sentences are matched once.
    """
    text = T.strip_tags(F.col("text"))
    distinct = materialized(sentences.select(product, text.alias("__q")).distinct())
    queries = token_arrays(distinct.select(product, F.col("__q").alias("query_id"), F.col("__q").alias("t")), "query_id", "t", (product,))
    first = claims.groupBy(product, "text").agg(F.min("id").alias("target_id"))  # of claims that say the same, the nearest is the first
    best = best_matches(queries, token_arrays(first, "target_id", "text", (product,)), 1, (product,), spread=True)
    best = best.select(product, F.col("query_id").alias("__q"), F.col("target_id").alias("best_id"))
    best = best.join(first.select(product, F.col("target_id").alias("best_id"), F.col("text").alias("__c")), [product, "best_id"])
    own = F.array_except(T.stems_gate(F.col("__q")), T.strings(L.GENERIC_STEMS))
    shared = F.size(F.array_intersect(own, T.stems_gate(F.col("__c"))))
    best = best.select(product, "__q", "best_id", shared.alias("reg_n"), F.when(F.size(own) > 0, shared / F.size(own)).otherwise(0.0).alias("reg_ratio"))
    out = sentences.withColumn("__q", text).join(best, [product, "__q"], "left").drop("__q")
    return out.withColumns({"reg_n": F.coalesce("reg_n", F.lit(0)), "reg_ratio": F.coalesce("reg_ratio", F.lit(0.0))})


def page_claims(sentences: DataFrame, claims: DataFrame, k: int = 3, product: str = "product_id") -> DataFrame:
    """(item_id, claim_ids): the claims that a page (item_id, product, text) cites, if they exist, and the k verified ones nearest to each of its sentences."""
    said_as = sentences.select("item_id", product, T.strip_tags(F.col("text")).alias("query_id"), T.tags_in(F.col("text")).alias("__ids"))
    distinct = materialized(said_as.select(product, "query_id").distinct()).withColumn("t", F.col("query_id"))
    nth = F.row_number().over(Window.partitionBy(product, "text").orderBy("id"))  # of claims that say the same, the first k are the nearest
    verified = claims.where("status = 'verified'").select(product, F.col("id").alias("target_id"), "text", nth.alias("__nth")).where(F.col("__nth") <= k)
    near = best_matches(token_arrays(distinct, "query_id", "t", (product,)), token_arrays(verified, "target_id", "text", (product,)), k, (product,), spread=True)
    related = said_as.join(large(near), [product, "query_id"]).select("item_id", F.col("target_id").alias("id"))
    named = said_as.select("item_id", F.explode("__ids").alias("id")).join(large(claims.select("id")), "id", "left_semi")
    return related.unionByName(named.select("item_id", "id")).groupBy("item_id").agg(F.array_sort(F.collect_set("id")).alias("claim_ids"))


def known_vocabulary(claims: DataFrame, product: str = "product_id") -> DataFrame:
    """(product, vocabulary): stems that at least two, but not many, of the product's claims have."""
    said = claims.groupBy(product, "text").agg(F.count(F.lit(1)).alias("copies"))
    df = said.select(product, "copies", F.explode(T.stems_gate(F.col("text"))).alias("stem")).groupBy(product, "stem").agg(F.sum("copies").alias("n"))
    size = said.groupBy(product).agg(F.sum("copies").alias("size"))
    kept = df.join(size, product).where((F.col("n") >= 2) & (F.col("n") < F.greatest(F.lit(5.0), F.col("size") * 0.2)))
    return kept.groupBy(product).agg(F.array_sort(F.collect_list("stem")).alias("vocabulary"))


def _cases(rows: DataFrame) -> DataFrame:
    """rows (__case, __on) once per case, __on unpacked."""
    return rows.groupBy("__case").agg(F.first("__on").alias("on")).select("__case", "on.*")


def verify(sentences: DataFrame, claims: DataFrame, keys: Sequence[str] = ("item_id", "index"), vocabulary: DataFrame | None = None, product: str = "product_id") -> DataFrame:
    """(keys, kind, text, reg_n, reg_ratio, vocabulary, best_id) with (classification, verdict, reason, suggested_id): against the claims their tags cite.

    A factual sentence without a tag is blocked, and its nearest claim suggested.  vocabulary: (product, vocabulary) of
    sentences that have none yet; it is joined last, so that no shuffled sentence carries that of its product.  Sentences
    that say the same, of claims that say the same, are judged once.
    """
    s = sentences.withColumn("ids", T.tags_in(F.col("text")))
    c = claims.select(F.col("id").alias("cid"), F.col("status").alias("cstatus"), F.col("text").alias("ctext"))
    exploded = s.select(*keys, F.posexplode("ids").alias("pos", "cid")).join(c, "cid", "left")
    joined = exploded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "ctext", "cstatus"))).alias("c"))
    bare = T.strip_tags(F.col("text"))
    # What a verdict depends on; texts whose tags leave another tag behind stay as they are.
    on = {"said": F.when(T.strip_tags(bare) == bare, bare).otherwise(F.col("text")), "kind": F.col("kind"), "reg_n": F.col("reg_n"), "reg_ratio": F.col("reg_ratio"), "tagged": F.size("ids") > 0, "c": F.col("c")}
    on["within"] = F.col("vocabulary") if vocabulary is None else F.col(product)
    out = s.join(joined, list(keys), "left").withColumn("__on", F.struct(*(v.alias(k) for k, v in on.items())))
    out = materialized(out.withColumn("__case", F.sha2(F.to_json("__on"), 256)).drop("c"))
    cases = _cases(out)
    if vocabulary is None:
        cases = cases.withColumnRenamed("within", "vocabulary")
    else:  # written first, as its true size lets Spark broadcast it: products are few, and would be few tasks
        cases = cases.withColumnRenamed("within", product).join(materialized(vocabulary), product, "left")
    bad = F.filter(F.col("c.cstatus"), lambda x: x != "verified")
    known = F.coalesce("vocabulary", F.array().cast("array<string>"))
    why = (
        F.when(F.col("c").isNull(), "untagged")
        .when(F.exists("c", lambda x: x["cstatus"].isNull()), "missing-claim")
        .when(F.size(bad) > 0, F.when(bad[0] == "deprecated", "deprecated").otherwise("needs-review"))
        .otherwise(support(F.trim(T.strip_tags(F.col("said"))), F.array_join(F.col("c.ctext"), " "), F.size("c"), known))
    )
    cases = cases.withColumn("classification", classify(F.col("said"), F.col("kind"), F.col("reg_n"), F.col("reg_ratio"), F.col("tagged")))
    cases = cases.select("__case", "classification", F.when(F.col("classification") != "positioning", why).alias("reason"))
    out = out.drop("__on").join(cases, "__case").drop("__case")
    suggested = F.when(F.col("reason") == "untagged", F.col("best_id"))
    return out.withColumn("verdict", F.when(F.col("reason").isNull(), "pass").otherwise("block")).withColumn("suggested_id", suggested)


def implied_conclusions(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """Neighbouring cited sentences of which the second passes, concludes, does not cite all that the first does, and says at least two stems more than its claims."""
    w = Window.partitionBy("item_id").orderBy("index")
    pairs = verdicts.select("*", F.lag("index").over(w).alias("before"), F.lag("ids").over(w).alias("ids_before"))
    text = T.strip_tags(F.col("text"))
    pairs = pairs.where(text.rlike(L.CONCLUSION) & (F.col("verdict") == "pass") & (F.size("ids") > 0) & (F.size("ids_before") > 0) & (F.size(F.array_except("ids_before", "ids")) > 0))
    cited_text = pairs.select("item_id", "index", F.explode("ids").alias("id")).join(claims.select("id", F.col("text").alias("ctext")), "id").groupBy("item_id", "index").agg(F.concat_ws(" ", F.collect_list("ctext")).alias("ctext"))
    extra = F.array_except(F.array_except(T.stems_gate(text), T.stems_gate(F.col("ctext"))), T.strings(L.GENERIC_STEMS))
    return pairs.join(cited_text, ["item_id", "index"]).where(F.size(extra) >= 2).select("item_id", "before", "index", F.lit("combined-conclusion").alias("reason"))


def page_tension(units: DataFrame, conflicts: DataFrame, claims: DataFrame) -> DataFrame:
    """(item_id, conflict_id, kind, first_index, n_sentences, indexes, verdict, reason) of drafts that cite a member of an open conflict (id, kind, status, claim_ids).

    An absolute against an exception is a collision, and blocks where a claim that the page cites has a superlative; all else flags as tension.
    """
    members = conflicts.where("status = 'open'").select(F.col("id").alias("conflict_id"), F.col("kind").alias("__kind"), F.explode("claim_ids").alias("cited_id"))
    bold = claims.select(F.col("id").alias("cited_id"), F.col("text").rlike(L.SUPERLATIVE).alias("__bold"))
    found = units.join(members.join(bold, "cited_id", "left"), "cited_id").groupBy("item_id", "conflict_id", "__kind").agg(
        F.min("index").alias("first_index"), F.array_sort(F.collect_set("index")).alias("indexes"), F.coalesce(F.max("__bold"), F.lit(False)).alias("__bold")
    )
    collides = F.col("__kind") == "absolute-vs-exception"
    found = found.withColumn("verdict", F.when(collides & F.col("__bold"), "block").otherwise("flag"))
    kind, reason = F.when(collides, "colliding-absolutes").otherwise("tension"), F.when(F.col("verdict") == "block", "overstated").otherwise("tension")
    return found.select("item_id", "conflict_id", kind.alias("kind"), "first_index", F.size("indexes").cast("long").alias("n_sentences"), "indexes", "verdict", reason.alias("reason"))


def class_tension(units: DataFrame, conflicts: DataFrame, members: DataFrame, claims: DataFrame) -> DataFrame:
    """The rows of page_tension without their indexes, from open conflicts (a, b, kind) between classes of claims, and the members (product_id, id, class) of these.

    Units meet the members that conflict with what they cite where the rows are returned: pairs are not shuffled.  What a
    draft cites of one product lies in one row.
    """
    ends = conflicts.select(F.col("a").alias("class"), F.col("b").alias("with"), "kind").unionByName(conflicts.select(F.col("b").alias("class"), F.col("a").alias("with"), "kind"))
    within = members.join(large(ends.select("class").distinct()), "class", "left_semi")
    bold = lambda own, is_bold: large(claims.select(F.col("id").alias(own), F.col("text").rlike(L.SUPERLATIVE).alias(is_bold)))
    ends = ends.join(bold("class", "bold"), "class", "left").join(bold("with", "other_bold"), "with", "left")
    partners = ends.join(large(within.select(F.col("class").alias("with"), F.col("id").alias("other"))), "with").drop("with")

    cites = units.join(large(within.select(F.col("id").alias("cited_id"), "class", F.hash("product_id").alias("product"))), "cited_id")
    cites = cites.select("item_id", F.struct("cited_id", "class", "product", "index").alias("c")).repartition("item_id").groupBy("item_id").agg(F.collect_list("c").alias("all"))
    at = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.transform(F.filter("all", lambda u: u["cited_id"] == c), lambda u: u["index"]))))
    each = cites.select("item_id", "all", F.explode(F.array_distinct(F.transform("all", lambda u: u.dropFields("index")))).alias("x"))
    near = F.array_distinct(F.transform(F.filter("all", lambda u: (u["product"] == F.col("x.product")) & (u["cited_id"] != F.col("x.cited_id"))), lambda u: u["cited_id"]))
    each = each.withColumn("near", F.when(F.size("all") > 1, near))
    others = F.when(F.size("near") > 0, F.map_from_entries(F.transform("near", lambda c: F.struct(c.alias("key"), at(c).alias("value")))))
    each = each.select("item_id", "x.cited_id", "x.class", at(F.col("x.cited_id")).alias("indexes"), others.alias("others"))

    found = each.join(large(partners), "class").withColumn("theirs", F.col("others")[F.col("other")])
    two = F.col("theirs").isNotNull()  # the draft cites both members: one row for both
    found = found.where(~two | (F.col("cited_id") < F.col("other"))).withColumn("indexes", F.when(two, F.array_sort(F.array_union("indexes", "theirs"))).otherwise(F.col("indexes")))
    collides = F.col("kind") == "absolute-vs-exception"
    block = collides & (F.coalesce("bold", F.lit(False)) | (two & F.coalesce("other_bold", F.lit(False))))
    return found.select(
        "item_id", F.concat_ws("~", F.least("cited_id", "other"), F.greatest("cited_id", "other")).alias("conflict_id"), F.when(collides, "colliding-absolutes").otherwise("tension").alias("kind"), F.get("indexes", F.lit(0)).alias("first_index"),
        F.size("indexes").cast("long").alias("n_sentences"), F.when(block, "block").otherwise("flag").alias("verdict"), F.when(block, "overstated").otherwise("tension").alias("reason"),
    )


def affected(stale: DataFrame, live: DataFrame, conflicts: DataFrame, touched: bool = False) -> DataFrame:
    """(kind, id, claim_ids): live content (item_id, cited_id) and conflicts (id, claim_ids) that stale claims (id) touch.

    touched: conflicts are those alone, one row each and only with their stale claims in order; they are not shuffled.
    """
    s = stale.select(F.col("id").alias("claim_id")).distinct()
    items = live.select(F.col("item_id").alias("id"), F.col("cited_id").alias("claim_id")).join(large(s), "claim_id")
    gathered = lambda df, kind: df.groupBy("id").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids")).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "claim_ids")
    if touched:
        pairs = conflicts.select(F.lit("conflict").alias("kind"), F.col("id").cast("string").alias("id"), "claim_ids")
    else:
        pairs = gathered(conflicts.select("id", F.explode("claim_ids").alias("claim_id")).join(s, "claim_id"), "conflict")
    return gathered(items, "content").unionByName(pairs)


def repairs(flagged: DataFrame, claims: DataFrame, keys: Sequence[str] = ("item_id", "index")) -> DataFrame:
    """flagged (keys, text, reason, best_id) with suggested_text: the words of its one verified claim, or of the nearest claim if that covers 0.8 of the stems of an untagged sentence; null: drop it."""
    s = flagged.withColumn("__ids", T.tags_in(F.col("text")))
    narrow = F.col("reason").isin("overstated", "partial", "contradicted", "combined-conclusion") & (F.size("__ids") == 1)
    s = s.withColumn("__id", F.when(narrow, F.col("__ids")[0]).when(F.col("reason") == "untagged", F.col("best_id")))
    s = s.join(claims.where("status = 'verified'").select(F.col("id").alias("__id"), F.col("text").alias("__c")), "__id", "left")
    own = T.stems_gate(F.col("text"))
    near = F.size(F.array_intersect(own, T.stems_gate(F.col("__c")))) / F.greatest(F.lit(1), F.size(own)) >= 0.8
    words = T.tag(F.col("__c"), F.array("__id"))
    return s.withColumn("suggested_text", F.when(narrow | near, words)).drop("__ids", "__id", "__c")


def reflag(live: DataFrame, claims: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(item_id, claim_ids) of live content (item_id, cited_id) that cites claims no longer verified, without re-flags already known."""
    stale = live.distinct().join(claims.where("status = 'verified'").select(F.col("id").alias("cited_id")), "cited_id", "left_anti")
    if known is not None:
        stale = stale.join(known, ["item_id", "cited_id"], "left_anti")
    return stale.groupBy("item_id").agg(F.array_sort(F.collect_set("cited_id")).alias("claim_ids"))


def live_versions(rounds: DataFrame) -> DataFrame:
    """rounds (item_id, round, status, …) with the last approved round up to each: a failed round never replaces it."""
    w = Window.partitionBy("item_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumn("live_round", F.last(F.when(F.col("status").isin("approved", "approved-override"), F.col("round")), ignorenulls=True).over(w))


def compare_rounds(before: DataFrame, after: DataFrame) -> DataFrame:
    """(item_id, text, change): sentences that are only in the first, only in the second, or in both."""
    b = before.select("item_id", "text", F.lit(True).alias("was")).distinct()
    a = after.select("item_id", "text", F.lit(True).alias("is")).distinct()
    return a.join(b, ["item_id", "text"], "full_outer").select("item_id", "text", F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "fixed").otherwise("still").alias("change"))


def line_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(item_id, line, change) with every occurrence that one side has more often."""
    removed = before.select("item_id", "line").exceptAll(after.select("item_id", "line")).withColumn("change", F.lit("removed"))
    return removed.unionByName(after.select("item_id", "line").exceptAll(before.select("item_id", "line")).withColumn("change", F.lit("added")))


def finalize(drafts: DataFrame, reports: DataFrame) -> DataFrame:
    """(item_id, final_text) of drafts whose approved report is for exactly this text: comments and tags go, blank lines collapse."""
    ok = reports.where(F.col("status").isin("approved", "approved-override")).select("item_id", "draft_hash")
    clean = T.strip_tags(F.regexp_replace("md", r"(?s)<!--.*?-->", ""))
    return drafts.withColumn("draft_hash", F.sha2("md", 256)).join(ok, ["item_id", "draft_hash"], "left_semi").select("item_id", F.trim(F.regexp_replace(clean, r"\n{3,}", "\n\n")).alias("final_text"))


def needs_revision(status: Column, auto_rounds: Column, cap: int = 2) -> Column:
    return status.isin("blocked", "flagged") & (auto_rounds < cap)


def citations_view(units: DataFrame, claims: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(item_id, view): each cited sentence with its claim's text and source, in order; claims of evidence sources (source_id) are left out."""
    c = claims.select(F.col("id").alias("cited_id"), "text", "source_id")
    c = c if evidence is None else c.join(evidence, "source_id", "left_anti")
    line = F.concat_ws(" | ", F.col("index").cast("string"), "cited_id", F.coalesce("text", F.lit("-")), F.coalesce(F.col("source_id").cast("string"), F.lit("-")))
    rows = units.join(c, "cited_id", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("index", "cited_id", line.alias("line")))).alias("l"))
    return rows.select("item_id", F.array_join(F.col("l.line"), "\n").alias("view"))
