"""House style: guardrails from decisions, vocabulary and naming profiles, style and structure scores, reader coverage."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.shared import materialized
from .measures import auc, most_common, youden_threshold
from .search import unanswered

#: Words that overpromise, in profiles and in off-brand samples.
HYPE = ("revolutionary", "game-changing", "cutting-edge", "best-in-class", "world-class", "seamless", "synergy", "leverage", "unparalleled", "disruptive", "next-generation", "robust")
#: Weights of the style criteria.
WEIGHTS = {"voice": 0.25, "cadence": 0.25, "vocabulary": 0.2, "naming": 0.2, "formatting": 0.1}

_QUOTED = r"['\"‘’“”]([^'\"‘’“”]+)['\"‘’“”]"


def _terms(c: Column, otherwise: str) -> Column:
    """Quoted terms, or else the parts between separators."""
    quoted = T.found(c, _QUOTED, 1)
    plain = F.filter(F.transform(F.split(c, otherwise), lambda x: F.trim(F.translate(x, ".", ""))), lambda x: x != "")
    return F.when(F.size(quoted) > 0, quoted).otherwise(plain)


def guardrails(decisions: DataFrame) -> DataFrame:
    """(product_id, decision_id, pos, type, terms, rule) of verbatim decisions (id, product_id, text), one per sentence.

    Recognised: banned words, the name to use and those to avoid (terms: the name first), topics to leave out, and what to
    lead with; any other sentence is a rule that quotes itself.  No rule says more than its sentence.
    """
    s = decisions.select("product_id", F.col("id").alias("decision_id"), F.posexplode(F.filter(F.split(F.trim("text"), r"(?<=[.!])\s+"), lambda x: x != "")).alias("pos", "s"))
    part = lambda pattern, group=1: F.regexp_extract("s", pattern, group)
    banned = part(L.BANNED_DECISION)
    naming = L.NAMING_DECISION
    keep, drop = F.trim(F.translate(part(naming), "'\"", "")), F.transform(_terms(part(naming, 2), r",| or "), lambda x: F.trim(F.regexp_replace(x, r"(?i)^(just|only)\s+", "")))
    topic = F.trim(F.translate(part(L.TOPIC_DECISION), ".", ""))
    listed = lambda terms: F.array_join(F.transform(terms, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    none = F.array().cast("array<string>")
    banned_terms = _terms(banned, r",\s*|\s+or\s+|\s+and\s+")
    sentence = F.concat(F.regexp_replace("s", r"\.+$", ""), F.lit("."))
    row = lambda kind, terms, rule: F.struct(F.lit(kind).alias("type"), terms.alias("terms"), rule.alias("rule"))
    found = (
        F.when(banned != "", row("banned-term", banned_terms, F.concat(F.lit("Do not use "), listed(banned_terms), F.lit(" in copy."))))
        .when(keep != "", row("naming", F.concat(F.array(keep), drop), F.concat(F.lit("Name the product '"), keep, F.lit("'; never "), listed(drop), F.lit("."))))
        .when(topic != "", row("deprioritize", F.array(topic), F.concat(F.lit("Do not feature "), topic, F.lit(" in copy. Claims about other topics are not affected."))))
        .when(F.lower("s").startswith("lead with"), row("emphasis", none, sentence))
        .otherwise(row("other", none, sentence))
    )
    return s.withColumn("g", found).select("product_id", "decision_id", "pos", "g.*")


def term_lists(rules: DataFrame) -> DataFrame:
    """(product_id, banned, forbidden, product_name, excluded) that guardrails add up to, sorted."""
    of = lambda kind, terms="terms": F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("type") == kind, F.expr(terms))))))
    return rules.groupBy("product_id").agg(
        of("banned-term").alias("banned"), of("naming", "slice(terms, 2, greatest(size(terms) - 1, 0))").alias("forbidden"), F.max_by(F.when(F.col("type") == "naming", F.col("terms")[0]), F.when(F.col("type") == "naming", F.struct("decision_id", "pos"))).alias("product_name"),
        of("deprioritize").alias("excluded"),
    )


def apply_rules(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """profiles (product_id, product_name, status, banned, preferred, forbidden, variants, derived, issues) after the guardrails (product_id, decision_id, pos, type, terms, rule).

    Banned words and names to avoid are those of the profile and of the rules, sorted; a preferred word that is banned in any
    case, and a variant that is to be avoided, go.  derived gains each (decision_id, rule) of those types that it lacks, in
    order.  A product name that is to be avoided is an issue, and a profile with issues is a draft.
    """
    mine = rules.where(F.col("type").isin("banned-term", "naming"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("decision_id", "pos", "rule"))), lambda x: F.struct(x["decision_id"].alias("decision_id"), x["rule"].alias("rule")))
    of = lambda kind, terms: F.flatten(F.collect_list(F.when(F.col("type") == kind, F.expr(terms))))
    told = mine.groupBy("product_id").agg(of("banned-term", "terms").alias("__banned"), of("naming", "slice(terms, 2, greatest(size(terms) - 1, 0))").alias("__avoid"), F.array_distinct(listed).alias("__rules"))
    j = profiles.join(told, "product_id", "left")
    none = F.array().cast("array<string>")
    both = lambda own, more: F.array_sort(F.array_union(own, F.coalesce(more, none)))
    j = j.withColumns({"banned": both("banned", F.col("__banned")), "forbidden": both("forbidden", F.col("__avoid")), "derived": F.array_union("derived", F.coalesce("__rules", F.array().cast("array<struct<decision_id:string,rule:string>>")))})
    low = F.transform("banned", lambda b: F.lower(b))
    clash = F.array_contains("forbidden", F.col("product_name"))
    j = j.withColumns({
        "preferred": F.filter("preferred", lambda w: ~F.array_contains(low, F.lower(w))), "variants": F.array_except("variants", "forbidden"),
        "issues": F.when(F.coalesce(clash, F.lit(False)), F.concat("issues", F.array(F.lit("product-name-forbidden")))).otherwise(F.col("issues")),
    })
    return j.withColumn("status", F.when(F.size("issues") > 0, "draft").otherwise(F.col("status"))).select(*profiles.columns)


def has_term(text: Column, term: Column) -> Column:
    return F.rlike(F.lower(text), F.concat(F.lit(r"\b\Q"), F.lower(term), F.lit(r"\E\b")))


def hits(text: Column, terms: Column) -> Column:
    """The terms that occur in the text as words, in any case: patterns are sought only for those that it holds at all, and it is lowered once."""
    of = lambda low: F.filter(terms, lambda w: F.contains(low, F.lower(w)) & F.rlike(low, F.concat(F.lit(r"\b\Q"), F.lower(w), F.lit(r"\E\b"))))
    return F.transform(F.array(F.lower(text)), of)[0]


def allowed_claims(claims: DataFrame, lists: DataFrame) -> DataFrame:
    """Claims without any banned, forbidden or excluded term of their product."""
    every = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("banned", "forbidden", "excluded")))
    joined = claims.join(lists.select("product_id", every.alias("__terms")), "product_id", "left")
    return joined.where(F.col("__terms").isNull() | ~F.exists("__terms", lambda w: has_term(F.col("text"), w))).drop("__terms")


def apply_naming(drafts: DataFrame, lists: DataFrame) -> DataFrame:
    """drafts (product_id, md, …) with forbidden names replaced by the product's, longest first."""
    order = F.array_sort("forbidden", lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    swap = lambda acc, w: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\w-])\Q"), w, F.lit(r"\E(?![\w-])")), F.col("product_name"))
    j = drafts.join(lists.select("product_id", "product_name", order.alias("forbidden")), "product_id", "left")
    return j.withColumn("md", F.when(F.col("product_name").isNull(), F.col("md")).otherwise(F.aggregate("forbidden", F.col("md"), swap))).select(*drafts.columns)


def preferred_vocabulary(docs: DataFrame, by: Sequence[str] = ("product_id",), pos: str = "doc_id", pool: int = 60, least: int = 3, k: int = 20, exclude: DataFrame | None = None) -> DataFrame:
    """(by, word, rank): the k most frequent words of a corpus among its `pool` most frequent, at least `least` times, without excluded ones (by, word)."""
    words = docs.select(*by, pos, F.explode(T.tokens(F.col("text"))).alias("word")).where((F.length("word") > 3) & ~F.col("word").rlike(r"^\d+$"))
    top = most_common(words, by, "word", pos, pool).where(F.col("n") >= least)
    top = top if exclude is None else top.join(exclude, [*by, "word"], "left_anti")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).where(F.col("rank") <= k)


def name_variants(docs: DataFrame, products: DataFrame, least: int = 2, k: int = 5) -> DataFrame:
    """(product_id, variant, n, rank): capitalised phrases around the first word of a product's name, other than the name; products is small and broadcast behind Spark's size check."""
    first = F.regexp_extract("name", r"^(\S+)", 1)
    j = docs.join(products.select("product_id", "name", first.alias("__first")), "product_id")
    pattern = F.concat(F.lit(r"\b(?:[A-Z][\w-]*\s)?\Q"), F.col("__first"), F.lit(r"\E(?:\s[A-Z][\w-]*)?"))
    v = j.select("product_id", "name", "doc_id", F.explode(F.regexp_extract_all("text", pattern, 0)).alias("variant")).where("variant <> name")
    v = v.where(~F.lower("variant").rlike(r"^(the|a|your|our) "))
    return most_common(v, ["product_id"], "variant", "doc_id", k, least)


def headings(md: Column) -> Column:
    """The heading texts of Markdown, without tags."""
    return F.transform(T.found(md, r"(?m)^#{1,6}[ \t]+(.*)$", 1), lambda h: F.trim(F.regexp_replace(h, r"\[\[[^\]]+\]\]", "")))


def _is_title(h: Column) -> Column:
    """Whether most words of over three letters behind the first are capitalised."""
    words = F.filter(T.found(h, r"[A-Za-z][A-Za-z'-]*"), lambda w: F.length(w) > 3)
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    return (F.size(words) >= 2) & (F.size(F.filter(rest, lambda w: w.rlike("^[A-Z]"))) >= F.greatest(F.lit(1.0), (F.size(words) - 1) * 0.6))


def _case(titles: Column, n: Column) -> Column:
    return F.when(n == 0, "sentence").when(titles / F.greatest(n, F.lit(1)) > 0.6, "title").when(titles / F.greatest(n, F.lit(1)) < 0.25, "sentence").otherwise("mixed")


def heading_case(titles: Column) -> Column:
    """title, sentence or mixed, by the share of headings in title case; sentence without headings."""
    return _case(F.size(F.filter(titles, _is_title)), F.size(titles))


def style_profile(docs: DataFrame, products: DataFrame, lists: DataFrame, min_pieces: int = 3, min_words: int = 1500) -> DataFrame:
    """One row per product whose corpus has enough pieces and words: cadence, preferred and avoided words, banned terms, names."""
    s = docs.select("product_id", F.explode(T.split_sentences(F.col("text"))).alias("s")).select("product_id", T.word_count(F.col("s")).alias("w"), F.col("s").rlike(r"(?i)\b(you|your|yours)\b").alias("you"), F.col("s").endswith("!").alias("x"))
    lengths = s.groupBy("product_id", "w").agg(F.count(F.lit(1)).alias("n"), F.count_if("you").alias("you"), F.count_if("x").alias("x"))
    rate = lambda c: F.sum(c) / F.sum("n")
    cadence = lengths.groupBy("product_id").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("avg_sentence_words"), rate("you").alias("second_person_rate"), rate("x").alias("exclamation_rate"), F.sum(F.col("w") * F.col("n")).alias("words"))
    heads = headings(F.col("text"))
    case = _case(F.sum(F.size(F.filter(heads, _is_title))), F.sum(F.size(heads)))
    pieces = docs.groupBy("product_id").agg(F.count(F.lit(1)).alias("pieces"), case.alias("heading_case"))
    preferred = preferred_vocabulary(docs).groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("preferred"))
    used = docs.select("product_id", F.explode(hits(F.col("text"), T.strings(HYPE))).alias("h")).groupBy("product_id").agg(F.collect_set("h").alias("used"))
    none = F.array().cast("array<string>")
    out = products.select("product_id", "name").join(cadence, "product_id").join(pieces, "product_id").where((F.col("pieces") >= min_pieces) & (F.col("words") >= min_words))
    out = out.join(preferred, "product_id", "left").join(used, "product_id", "left").join(lists, "product_id", "left")
    return out.select(
        "product_id", F.coalesce("product_name", "name").alias("product_name"), "avg_sentence_words", "second_person_rate", "exclamation_rate", F.coalesce("preferred", none).alias("preferred"),
        "heading_case", F.array_except(T.strings(HYPE), F.coalesce("used", none)).alias("avoid"), F.coalesce("banned", none).alias("banned"), F.coalesce("forbidden", none).alias("forbidden"),
    )


def profile_score(drafts: DataFrame, profiles: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """drafts (item_id, product_id, md) against their profile: (item_id, product_id, score, scores, hype, banned_hits, forbidden_hits, heading_case).  Banned terms cap the score at 0.4."""
    text = T.strip_tags(F.col("md"))
    sentences = T.split_sentences(F.regexp_replace(text, r"(?m)^#+\s+.*$", ""))
    heads = headings(F.col("md"))
    profiles = materialized(profiles.withColumnRenamed("heading_case", "__case"))  # its true size lets Spark broadcast it: products are few, and would be few tasks
    d = drafts.join(profiles, "product_id").withColumns({"__t": text, "__s": sentences, "__heads": F.size(heads), "heading_case": heading_case(heads)})
    n = F.greatest(F.lit(1), F.size("__s"))
    rate = lambda cond: F.size(F.filter("__s", cond)) / n
    mean = F.aggregate("__s", F.lit(0), lambda a, x: a + T.word_count(x)) / n
    # Scores are used twice, what they need of the text is a column each.
    d = d.withColumns({"__mean": mean, "__you": rate(lambda x: x.rlike(r"(?i)\b(you|your|yours)\b")), "__x": rate(lambda x: x.endswith("!")), "__used": F.size(hits(F.col("__t"), F.col("preferred")))})
    d = d.withColumns({"hype": hits(F.col("__t"), F.col("avoid")), "banned_hits": hits(F.col("__t"), F.col("banned")), "forbidden_hits": F.filter("forbidden", lambda f: F.rlike(F.col("__t"), F.concat(F.lit(r"(?<![\w-])\Q"), f, F.lit(r"\E(?![\w-])(?!\s+[A-Z0-9])"))))})
    base = F.greatest(F.lit(1.0), "avg_sentence_words")
    zero = lambda c: F.greatest(F.lit(0.0), c)
    used = F.col("__used") / F.greatest(F.lit(1), F.least(F.lit(6), F.size("preferred")))
    scores = {
        "cadence": zero(1 - F.abs(F.col("__mean") - F.col("avg_sentence_words")) / base),
        "voice": zero(1 - F.abs(F.col("__you") - F.col("second_person_rate")) * 1.5 - F.col("__x") * 3),
        "vocabulary": zero(F.least(F.lit(1.0), used) - 0.2 * F.size("hype")),
        "naming": F.when(F.size("forbidden_hits") > 0, 0.0).when(F.contains(F.lower("__t"), F.lower("product_name")), 1.0).otherwise(0.6),
        "formatting": F.when((F.col("heading_case") == F.col("__case")) | (F.col("__heads") == 0), 1.0).otherwise(0.5),
    }
    total = sum(w * scores[k] for k, w in weights.items()) / sum(weights.values())
    score = F.when(F.size("banned_hits") > 0, F.least(total, F.lit(0.4))).otherwise(total)
    named = F.create_map(*(x for k, v in scores.items() for x in (F.lit(k), F.round(v, 3))))
    return d.select("item_id", "product_id", F.round(score, 3).alias("score"), named.alias("scores"), "hype", "banned_hits", "forbidden_hits", "heading_case")


def style_check(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """scores of profile_score with passed (null without a threshold) and flags, an array of (severity, issue, detail); thresholds: (product_id, threshold)."""
    flag = lambda severity, issue, detail: F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), detail.cast("string").alias("detail"))
    each = lambda c, severity, issue: F.transform(c, lambda w: flag(severity, issue, w))
    j = scores.join(thresholds.select("product_id", "threshold"), "product_id", "left").withColumn("passed", F.col("score") >= F.col("threshold"))
    judged = F.when(F.col("threshold").isNull(), flag("low", "not-calibrated", F.lit(None))).when(~F.col("passed"), flag("high", "below-threshold", F.col("score")))
    case = F.when(F.element_at("scores", "formatting") < 1, flag("low", "heading-case", F.col("heading_case")))
    flags = F.concat(each("hype", "low", "avoided-word"), each("banned_hits", "high", "banned-term"), each("forbidden_hits", "high", "forbidden-name"), F.array_compact(F.array(case, judged)))
    return j.withColumn("flags", flags)


def structure_audit(units: DataFrame, content_types: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(item_id, scores by criterion, score, flags, passed): structure, call to action, length, positioning and stage of drafts, their mean, and what is wrong.

    flags are (severity, issue, detail) in the order of the criteria; a draft passes without any high one.

    units: (item_id, content_type, index, kind, level, text); level 1 is the headline.  content_types: (content_type, required
    section names, min_words, max_words).  context: (item_id, stage, product_name, pains), pains null without a persona:
    how many stems of the reader's pains the draft has, and whether it opens with the product for a reader who only knows the problem.
    """
    plain = F.trim(T.strip_tags(F.col("text")))
    ask = (F.col("kind") != "heading") & (plain.rlike(L.CALL_TO_ACTION) | (plain.endswith("?") & plain.rlike(r"(?i)\b(walkthrough|demo|call|chat)\b")))
    top = F.col("level") == 1 if "level" in units.columns else F.col("kind") == "heading"
    said = F.array_sort(F.collect_list(F.when(F.col("kind") != "heading", F.struct("index", plain.alias("t")))))
    per = units.groupBy("item_id", "content_type").agg(
        F.count_if(top).alias("headlines"), F.collect_set(F.when(F.col("kind") == "heading", F.lower(plain))).alias("titles"), F.count_if(ask).alias("ctas"), F.countDistinct(F.when(ask, F.lower(plain))).alias("cta_kinds"),
        F.sum(T.word_count(plain)).alias("words"), F.lower(F.array_join(F.slice(F.transform(said, lambda x: x["t"]), 1, 3), " ")).alias("opening"), F.array_distinct(F.flatten(F.collect_list(T.stems_gate(plain)))).alias("stems"),
    )
    j = per.join(content_types, "content_type")
    if context is None:
        context = per.select("item_id", F.lit(None).cast("string").alias("stage"), F.lit("").alias("product_name"), F.lit(None).cast("array<string>").alias("pains"))
    j = j.join(context, "item_id", "left")
    zero = lambda c: F.greatest(F.lit(0.0), c)
    absent = F.filter(F.slice("required", F.lit(2), F.greatest(F.size("required"), F.lit(1))), lambda r: ~F.exists("titles", lambda t: F.contains(t, F.lower(r))))
    missing = F.size(absent)
    email = F.col("content_type") == "email"
    structure = F.when(F.col("headlines") > 0, 1.0).otherwise(0.3) - F.when(email, 0.0).otherwise(0.15 * missing)
    cta = F.when(F.col("ctas") == 0, 0.0).when(F.col("cta_kinds") > 2, 0.7).otherwise(1.0)
    edge = F.when(F.col("words") < F.col("min_words"), F.col("min_words")).otherwise(F.col("max_words"))
    length = F.when(F.col("words").between(F.col("min_words"), F.col("max_words")), 1.0).otherwise(zero(1 - F.abs(F.col("words") - edge) / F.greatest("min_words", F.lit(1))))
    pains = T.stems_gate(F.array_join("pains", " "))
    touched = F.size(F.array_intersect(pains, "stems")) / F.greatest(F.lit(1), F.size(pains))
    positioning = F.when(F.col("pains").isNull(), 0.5).otherwise(F.least(F.lit(1.0), touched * 2))
    early = F.col("stage").isin("unaware", "problem-aware") & (F.col("product_name") != "") & F.contains("opening", F.lower("product_name")) & F.col("pains").isNull()
    stage = F.when(early, 0.5).otherwise(1.0)
    total = (structure + cta + length + positioning + stage) / 5
    flag = lambda cond, severity, issue, detail=None: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))
    flags = F.array_compact(F.array(
        flag((F.col("headlines") == 0) & ~email, "high", "no-headline"), flag((missing > 0) & ~email, "low", "missing-sections", F.array_join(absent, ", ")), flag(F.col("ctas") == 0, "high", "no-call-to-action"),
        flag(F.col("cta_kinds") > 2, "low", "several-calls-to-action"), flag(length < 1, "low", "length", F.col("words")), flag(F.col("pains").isNotNull() & (touched < 0.2), "low", "pains-untouched"), flag(F.coalesce(early, F.lit(False)), "low", "opens-with-product"),
    ))
    out = j.select("item_id", zero(structure).alias("structure"), cta.alias("cta"), length.alias("length"), positioning.alias("positioning"), stage.alias("stage"), zero(F.round(total, 3)).alias("score"), flags.alias("flags"))
    return out.withColumn("passed", ~F.exists("flags", lambda f: f["severity"] == "high"))


def open_objections(drafts: DataFrame, personas: DataFrame, claims: DataFrame) -> DataFrame:
    """(item_id, objection, answerable) of objections that a draft has less than half the stems of: whether the product's best verified claim (product_id, id, text, status) has them."""
    share = F.size(F.array_intersect(T.stems_gate(F.col("objection")), T.stems_gate(F.col("text")))) / F.greatest(F.lit(1), F.size(T.stems_gate(F.col("objection"))))
    rows = drafts.join(personas.select("product_id", F.explode("objections").alias("objection")), "product_id").where(share < 0.5).select("item_id", "product_id", "objection")
    asked = rows.select("product_id", F.col("objection").alias("query_id"), F.col("objection").alias("text")).distinct()
    targets = claims.where("status = 'verified'").select("product_id", F.col("id").alias("target_id"), "text")
    lost = unanswered(asked, targets, by=("product_id",)).select("product_id", F.col("query_id").alias("objection"), F.lit(False).alias("__answerable"))
    return rows.join(lost, ["product_id", "objection"], "left").select("item_id", "objection", F.coalesce("__answerable", F.lit(True)).alias("answerable"))


def reader_coverage(drafts: DataFrame, personas: DataFrame) -> DataFrame:
    """drafts (item_id, product_id, text) against personas (product_id, priorities, objections): yes when all priorities are covered and no objection is open, no when none is covered, else maybe."""
    own = T.stems_gate(F.col("text"))
    share = lambda x: F.size(F.array_intersect(T.stems_gate(x), F.col("__own"))) / F.greatest(F.lit(1), F.size(T.stems_gate(x)))
    j = drafts.withColumn("__own", own).join(personas, "product_id")
    covered, open_ = F.size(F.filter("priorities", lambda p: share(p) >= 0.34)), F.size(F.filter("objections", lambda o: share(o) < 0.5))
    verdict = F.when((F.size("priorities") > 0) & (covered == F.size("priorities")) & (open_ == 0), "yes").when(covered == 0, "no").otherwise("maybe")
    return j.select("item_id", covered.alias("covered"), open_.alias("open_objections"), verdict.alias("verdict"))


def off_brand(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk, variant, text): each chunk as hype, as merged third person, under a wrong name and with a banned word."""
    t = F.col("text")
    third = F.regexp_replace(F.regexp_replace(t, r"(?i)\byour\b", "the user's"), r"(?i)\byou\b", "the user")
    made = {"hype": F.concat(F.lit(f"A {HYPE[0]}, {HYPE[1]} way! "), F.regexp_replace(t, r"\.", "!")), "third-person": F.regexp_replace(third, r"\.\s+", ", and "), "wrong-name": F.concat(F.lit("Productify: "), t), "banned": F.concat(t, F.lit(f" {HYPE[5]} {HYPE[7]}."))}
    return chunks.select("doc_id", "chunk", F.explode(F.create_map(*(x for k, v in made.items() for x in (F.lit(k), v)))).alias("variant", "text"))


def seed_set(claims: DataFrame, per_kind: int = 12, seed: int = 7) -> DataFrame:
    """(product_id, id, label, text): labelled sentences of claims (id, product_id, text, category, status), at most per_kind a product and label, the first by a hash of id, label and seed.

    true and untagged say a verified claim with and without its tag, false another number, overstated drops a condition
    or adds a superlative, partial grafts what the next claim says, not-citable says a claim that is not verified, and
    positioning says nothing that could be checked.
    """
    verified = (F.col("status") == "verified") & (F.col("category") != "market-evidence")
    text, number = F.col("text"), F.regexp_extract("text", r"\b(\d+)(\.\d+)?\b", 1)
    labels = F.array_compact(F.array(
        *(F.when(verified, F.lit(x)) for x in ("true", "untagged", "overstated", "partial")), F.when(verified & (number != ""), F.lit("false")), F.when(F.col("status").isin("needs-review", "deprecated"), F.lit("not-citable"))
    ))
    s = claims.select("product_id", "id", "text", number.alias("number"), F.explode(labels).alias("label"))
    w = Window.partitionBy("product_id", "label").orderBy(F.md5(F.concat_ws("/", "id", "label", F.lit(str(seed)))), "id")
    s = s.select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next"))
    s = s.where(F.col("rn") <= F.when(F.col("label") == "partial", 2 * per_kind).otherwise(per_kind))
    s = s.where((F.col("label") != "partial") | ((F.col("rn") % 2 == 1) & (F.col("rn") < 2 * per_kind) & F.col("next").isNotNull()))

    n = F.col("number").cast("long")
    other = F.when(n < 1000, n * 2 + 1).otherwise(F.floor(n / 2)).cast("string")
    at = F.regexp_instr(text, F.lit(r"\b\d+(\.\d+)?\b"))
    false = F.concat(F.substring(text, F.lit(1), at - 1), other, F.substring(text, at + F.length("number"), F.length(text)))
    bold = F.element_at(T.strings(L.OVERSTATING), (F.pmod(F.col("rn") - 1, F.lit(len(L.OVERSTATING))) + 1).cast("int"))
    verb = F.regexp_extract(text, L.SAMPLE_VERB, 2)
    head, tail = F.regexp_extract(text, L.SAMPLE_VERB, 1), F.regexp_replace(text, L.SAMPLE_VERB, "")
    said = F.when(verb.isin("is", "are"), F.concat_ws(" ", head, verb, bold)).otherwise(F.concat_ws(" ", head, F.regexp_replace(bold, "^the ", ""), verb))
    louder = F.when(verb == "", F.concat(F.lit("Only "), F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))).otherwise(F.concat(said, tail))
    condition = F.regexp_extract(text, L.SAMPLE_CONDITION, 1)
    place = F.instr(text, condition)
    without = F.replace(F.concat(F.substring(text, F.lit(1), place - 1), F.substring(text, place + F.length(condition), F.length(text))), F.lit(" ."), F.lit("."))
    overstated = F.when((condition != "") & (F.col("rn") % 2 == 1), without).otherwise(louder)
    grafted = F.concat(F.regexp_replace(text, r"\.+$", ""), F.lit(", and it also "), F.regexp_replace(F.regexp_replace("next", r"\.+$", ""), L.GRAFTED_VERB, "$1"))
    made = F.when(F.col("label") == "false", false).when(F.col("label") == "overstated", overstated).when(F.col("label") == "partial", grafted).otherwise(text)
    s = s.select("product_id", "id", "label", F.when(F.col("label") == "untagged", text).otherwise(T.tag(made, F.array("id"))).alias("text"))
    idle = claims.select("product_id").distinct().select("product_id", F.posexplode(T.strings(L.POSITIONING_SAMPLES)).alias("i", "text"))
    return s.unionByName(idle.select("product_id", F.concat(F.lit("pos-"), "i").alias("id"), F.lit("positioning").alias("label"), "text"))


def calibrate(samples: DataFrame, least: float = 0.9, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row from (score, label): area, threshold, J, means of both classes, and whether the area meets the target.  A scorer adds the score."""
    samples = samples if scorer is None else scorer(samples)
    means = samples.agg(F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("mean_on"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("mean_off"))
    return auc(samples).crossJoin(youden_threshold(samples)).crossJoin(means).withColumn("meets_target", F.col("auc") >= least)  # one row each

