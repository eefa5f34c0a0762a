"""Planning pages: which claims a section takes, what a brief asks for that no claim supports, whom it speaks to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.shared import materialized
from .search import best_matches, token_arrays
from .style import has_term

#: Sections that take proof first, categories that count as proof, words of asks that need a claim, and the framework of each stage.
PROOF_SECTIONS = ("benefits", "capabilities", "proof", "value", "details")
PROOF_CATEGORIES = ("metric", "compliance", "security", "customer-reference")
ASKS = r"(?i)\b(certif|customer|logo|fastest|faster|only|first|guarantee|award|\d+%)"
WANTS = {"hero": 1, "headline": 1, "subject": 0, "title": 1, "cta": 0, "ask": 0, "problem": 1, "opening": 1}
WANTS_ELSE = 3
FRAMEWORK = {"unaware": "PAS", "problem-aware": "PAS", "solution-aware": "BAB", "product-aware": "AIDA", "most-aware": "AIDA"}


def framework(stage: Column) -> Column:
    """The framework that copy for a stage follows; null for an unknown stage."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in FRAMEWORK.items() for x in pair)), stage)


def citable(claims: DataFrame) -> DataFrame:
    """Verified claims that no ruling deprioritised."""
    low = F.coalesce("deprioritized", F.lit(False)) if "deprioritized" in claims.columns else F.lit(False)
    return claims.where((F.col("status") == "verified") & ~low)


def wanted(section: Column) -> Column:
    """How many claims a section takes."""
    counts = F.create_map(*(x for k, v in WANTS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.element_at(counts, section), F.lit(WANTS_ELSE))


def allocate_sections(candidates: DataFrame, claims: DataFrame, sections: Sequence[str], avoid: DataFrame | None = None) -> DataFrame:
    """(brief_id, pos, section, id, pick): the claims that each section of each brief takes, in order.

    candidates: (brief_id, section, id, is_proof, rank), proof before the best matches of the section's query, each by
    rank.  A claim is taken once a brief, and no second one with the same text; claims that are not citable, say a term
    of avoid (product_id, terms) or, in the section of proof, are of another category, are passed over.  A loop over the
    few sections, on all briefs at once.
    """
    text = F.lower(T.norm_ws(F.col("text")))
    pool = citable(claims).withColumn("__said", F.md5(text))
    if avoid is not None:
        pool = pool.join(avoid.select("product_id", F.col("terms").alias("__terms")), "product_id", "left")
        pool = pool.where(F.col("__terms").isNull() | ~F.exists("__terms", lambda w: has_term(F.col("text"), w)))
    c = candidates.join(pool.select("id", "category", "__said"), "id")
    taken: DataFrame | None = None
    for pos, section in enumerate(sections):
        want = WANTS.get(section, WANTS_ELSE)
        if not want:
            continue
        own = c.where(F.col("section") == section)
        own = own.where(~F.col("is_proof")) if section not in PROOF_SECTIONS else own
        own = own.where(F.col("category").isin(*PROOF_CATEGORIES)) if section == "proof" else own
        if taken is not None:
            own = own.join(taken.select("brief_id", "__said"), ["brief_id", "__said"], "left_anti")
        order = [F.desc("is_proof"), "rank", "id"]
        own = own.withColumn("__nth", F.row_number().over(Window.partitionBy("brief_id", "__said").orderBy(*order))).where("__nth = 1")
        own = own.withColumn("pick", F.row_number().over(Window.partitionBy("brief_id").orderBy(*order))).where(F.col("pick") <= want)
        own = own.select("brief_id", F.lit(pos).alias("pos"), "section", "id", "pick", "__said")
        taken = own if taken is None else taken.unionByName(own)
    return taken.drop("__said")


def unsupported_asks(briefs: DataFrame, claims: DataFrame, least: float = 0.5) -> DataFrame:
    """(brief_id, pos, need): sentences of briefs (brief_id, product_id, notes) that ask for facts of which the nearest verified claim has less than `least` of the stems."""
    s = briefs.select("brief_id", "product_id", F.posexplode(F.split("notes", r"(?<=[.;])\s+")).alias("pos", "need")).withColumn("need", F.trim("need"))
    s = s.where((F.col("need") != "") & F.col("need").rlike(ASKS))
    asked = materialized(s.select("product_id", "need").distinct())  # equal asks are matched once
    q = token_arrays(asked.select("product_id", F.col("need").alias("query_id"), F.col("need").alias("t")), "query_id", "t", ("product_id",))
    verified = claims.where("status = 'verified'").groupBy("product_id", "text").agg(F.min("id").alias("target_id"))
    best = best_matches(q, token_arrays(verified, "target_id", "text", ("product_id",)), 1, ("product_id",), spread=True)
    best = best.join(verified.select("product_id", "target_id", F.col("text").alias("__c")), ["product_id", "target_id"]).select("product_id", F.col("query_id").alias("need"), "__c")
    own = T.stems_gate(F.col("need"))
    near = F.size(F.array_intersect(own, T.stems_gate(F.coalesce("__c", F.lit(""))))) / F.greatest(F.lit(1), F.size(own))
    lacking = asked.join(best, ["product_id", "need"], "left").where(F.col("__c").isNull() | (near < least)).select("product_id", "need")
    return s.join(lacking, ["product_id", "need"]).select("brief_id", "pos", "need")


def proof_gaps(proofs: DataFrame, objections: DataFrame, asks: DataFrame) -> DataFrame:
    """(kind, need): proof points (text, status) without a claim, objections (text) that nothing answers, asks (need) that nothing supports."""
    rows = [proofs.where("status = 'needs-claim'").select(F.lit("proof").alias("kind"), F.col("text").alias("need")), objections.select(F.lit("objection").alias("kind"), F.col("text").alias("need")), asks.select(F.lit("ask").alias("kind"), "need")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def relink(proofs: DataFrame, claims: DataFrame, keys: Sequence[str] = ("product_id", "theme", "pos")) -> DataFrame:
    """proofs (keys, text, claim_ids) with only their verified claims left, and has-claim or needs-claim as status."""
    ids = proofs.select(*keys, F.posexplode("claim_ids").alias("__i", "id")).join(claims.where("status = 'verified'").select("id"), "id", "left_semi")
    kept = ids.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "id"))), lambda x: x["id"]).alias("__ids"))
    out = proofs.join(kept, list(keys), "left").withColumn("claim_ids", F.coalesce("__ids", F.array().cast("array<string>"))).drop("__ids")
    return out.withColumn("status", F.when(F.size("claim_ids") > 0, "has-claim").otherwise("needs-claim"))


def pick_persona(briefs: DataFrame, personas: DataFrame) -> DataFrame:
    """briefs (brief_id, product_id, audience, notes) with persona: of the product's personas (product_id, pos, name, role) the one that shares most words, the first of equals; without personas the audience itself."""
    own = F.array_distinct(T.tokens(F.concat_ws(" ", "audience", F.coalesce("notes", F.lit("")))))
    p = personas.select("product_id", "pos", "name", F.array_distinct(T.tokens(F.concat_ws(" ", "name", "role"))).alias("__p"))
    shared = F.size(F.array_intersect("__b", "__p"))
    best = briefs.select("brief_id", "product_id", own.alias("__b")).join(p, "product_id").groupBy("brief_id").agg(F.max_by("name", F.struct(shared, -F.col("pos"))).alias("__name"))
    return briefs.join(best, "brief_id", "left").withColumn("persona", F.coalesce("__name", "audience")).drop("__name")


def fact_check(aids: DataFrame, products: DataFrame, claims: DataFrame, least: float = 0.6) -> DataFrame:
    """(aid_id, product_id, pos, sentence, issue, claim_id) of sentences in a product's reference texts (aid_id, product_id, text) that name it (product_id, name) and say what its verified claims lack, or negate."""
    names = products.select("product_id", F.array_union(F.array(F.lower("name")), F.filter(F.split(F.lower("name"), r"\s+"), lambda w: F.length(w) > 3)).alias("__names"))
    texts = aids.select("product_id", "text").distinct()  # equal texts are read, and equal sentences matched, once
    s = texts.join(names, "product_id").select("product_id", "text", "__names", F.posexplode(T.split_sentences(F.regexp_replace("text", "[#*`>-]", " "))).alias("pos", "sentence"))
    s = s.where((F.size(F.split("sentence", r"\s+")) >= 5) & F.exists("__names", lambda n: F.contains(F.lower("sentence"), n))).drop("__names")
    by, s = ("product_id",), materialized(s)
    said = s.select(*by, F.col("sentence").alias("query_id"), F.col("sentence").alias("t")).distinct()
    verified = claims.where("status = 'verified'").groupBy(*by, "text").agg(F.min("id").alias("target_id"))
    best = best_matches(token_arrays(said, "query_id", "t", by), token_arrays(verified, "target_id", "text", by), 1, by, "shared", spread=True)
    best = best.join(verified.select(*by, "target_id", F.col("text").alias("__c")), [*by, "target_id"]).select(*by, F.col("query_id").alias("sentence"), "overlap", F.col("target_id").alias("claim_id"), "__c")
    j = s.join(best, [*by, "sentence"], "left")
    negates = F.col("sentence").rlike(L.REGISTRY_NEGATION) != F.col("__c").rlike(L.REGISTRY_NEGATION)
    issue = F.when(F.coalesce("overlap", F.lit(0.0)) < least, "not-in-registry").when(negates, "contradicts")
    j = j.withColumn("issue", issue).where("issue IS NOT NULL").select(*by, "text", "pos", "sentence", "issue", F.when(F.col("issue") == "contradicts", F.col("claim_id")).alias("claim_id"))
    return aids.join(j, [*by, "text"]).select("aid_id", *by, "pos", "sentence", "issue", "claim_id")


def reproducible(evidence: DataFrame, responses: DataFrame) -> DataFrame:
    """Evidence claims (source_id, query, count, total, …) whose counts come out again: query is field=value, responses (source_id, response_id, field, value)."""
    said = responses.select("source_id", F.trim("field").alias("__f"), F.lower(F.trim("value")).alias("__v"), "response_id").distinct()
    n = said.groupBy("source_id", "__f", "__v").agg(F.count(F.lit(1)).alias("__n"))
    all_ = responses.groupBy("source_id").agg(F.countDistinct("response_id").alias("__all"))
    asked = evidence.withColumns({"__f": F.trim(F.substring_index("query", "=", 1)), "__v": F.lower(F.trim(F.regexp_replace("query", "^[^=]*=?", "")))})
    same = (F.coalesce("__n", F.lit(0)) == F.col("count")) & (F.coalesce("__all", F.lit(0)) == F.col("total"))
    return asked.join(n, ["source_id", "__f", "__v"], "left").join(all_, "source_id", "left").where(same).select(*evidence.columns)


def _quotable(claims: DataFrame) -> DataFrame:
    """(product_id, c, best): of claims that say the same c, the one that is found for a quote: a verified one first, then in order."""
    said = F.lower(T.norm_ws(F.col("text")))
    return claims.groupBy("product_id", said.alias("c")).agg(F.min(F.struct((F.col("status") != "verified").alias("other"), "pos", "id")).alias("best"))


def golden_matches(golden: DataFrame, claims: DataFrame, share: float = 0.6) -> DataFrame:
    """golden (product_id, quote) with claim_id: a claim (product_id, pos, id, text, status) whose text equals the quote, holds it, or is held by it and longer than `share` of it; verified ones first, then in order.

    Candidates share the longest inner word of the shorter text, which stands whole in a text that holds it; texts of up
    to two words have none and are looked for in all texts of the product.  Quotes and claims that say the same meet once.
    """
    norm = lambda c: F.lower(T.norm_ws(F.col(c)))
    words = lambda c: F.array_union(F.array_distinct(F.split(c, " ")), F.array(F.lit("")))

    def longest(c: Column) -> Column:
        w = F.split(c, " ")
        inner = F.when(F.size(w) > 2, F.slice(w, F.lit(2), F.size(w) - 2))
        return F.coalesce(F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("l"), x.alias("w"))))["w"], F.lit(""))

    asked = golden.withColumn("g", F.when(F.col("quote").isNotNull(), norm("quote")))
    g = asked.where("g IS NOT NULL").select("product_id", "g").distinct()
    c = materialized(_quotable(claims))
    by = ["product_id", "w"]
    inside = g.withColumn("w", longest(F.col("g"))).join(c.withColumn("w", F.explode(words(F.col("c")))), by).where(F.contains("c", F.col("g")))
    around = g.withColumn("w", F.explode(words(F.col("g")))).join(c.withColumn("w", longest(F.col("c"))), by).where(F.contains("g", F.col("c")) & (F.length("c") > share * F.length("g")))
    found = inside.select("product_id", "g", "best").unionByName(around.select("product_id", "g", "best"))
    best = found.groupBy("product_id", "g").agg(F.min("best")["id"].alias("claim_id"))
    return asked.join(best, ["product_id", "g"], "left").drop("g")
