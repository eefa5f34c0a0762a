"""The claims registry: identity over rebuilds, permanent ids, rulings, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.shared import large, materialized


def extract_claims(blocks: DataFrame, min_words: int = 5, max_quote: int = 59) -> DataFrame:
    """(source_id, block_pos, sent_pos, text, quote, category, confidence) of the sentences of blocks (source_id, block_pos, text) that can be claims.

    Sentences have at least min_words words and a lower-case letter, are no questions and do not open like navigation;
    of equal quotes of a source the first stays.
    """
    s = blocks.select("source_id", "block_pos", F.posexplode(T.split_sentences(F.col("text"))).alias("sent_pos", "text"))
    words = F.split("text", r"\s+")
    s = s.where((T.word_count(F.col("text")) >= min_words) & ~F.col("text").endswith("?") & ~F.col("text").rlike(L.SKIPPED_OPENING) & F.col("text").rlike("[a-z]"))
    s = s.withColumn("quote", F.when(F.size(words) > max_quote, F.array_join(F.slice(words, 1, max_quote), " ")).otherwise(F.col("text")))
    first = Window.partitionBy("source_id", "quote").orderBy("block_pos", "sent_pos")
    s = s.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return s.withColumns({"category": T.category(F.col("text")), "confidence": T.confidence(F.col("text"))})


def match_claims(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (source_id, quote_hash, text, …) with the id they keep and how it was found: exact, moved or new.

    Exact matches go first; then claims that moved to another source take ids that no exact match holds, one to one in
    order of id.  Rows that still have none are new.
    """
    keys = ["source_id", "quote_hash", "text"]
    nth = Window.partitionBy(*keys).orderBy("pos")
    e_nth = Window.partitionBy(*keys).orderBy("id")
    n = new.withColumn("nth", F.row_number().over(nth))
    e = existing.select("id", *keys).withColumn("nth", F.row_number().over(e_nth))
    exact = n.join(e, [*keys, "nth"], "left").drop("nth")
    found = exact.where("id IS NOT NULL").withColumn("how", F.lit("exact"))
    text_keys = ["quote_hash", "text"]
    free = existing.join(found.select("id"), "id", "left_anti").select("id", *text_keys)
    free = free.withColumn("nth", F.row_number().over(Window.partitionBy(*text_keys).orderBy("id")))
    rest = exact.where("id IS NULL").drop("id").withColumn("nth", F.row_number().over(Window.partitionBy(*text_keys).orderBy("source_id", "pos")))
    rest = rest.join(free, [*text_keys, "nth"], "left").drop("nth").withColumn("how", F.when(F.col("id").isNull(), "new").otherwise("moved"))
    return found.unionByName(rest)


def allocate_ids(new: DataFrame, existing: DataFrame, key: str, group: str, order: Sequence[str], prefix: str, ranges: int = 256) -> DataFrame:
    """new with id: numbers go on behind the largest that key ever had, in the given order, and are never used again.

    Rows are numbered within ranges of a group, and ranges offset by running sums of their counts, so that no task sorts
    all rows of a key or group.  Groups are ordered by value; ranges are cut at quantiles of the first column of the
    order where that is a number, the bounds (at most `ranges`) being the only rows that reach the driver.
    """
    top = existing.groupBy(key).agg(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("long")).alias("__top"))
    part = F.lit(0)
    if isinstance(new.schema[order[0]].dataType, NumericType):
        cuts = new.agg(F.percentile_approx(order[0], [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
        if cuts:
            bounds = F.array(*map(F.lit, sorted(set(cuts))))
            part = F.coalesce(F.size(F.filter(bounds, lambda x: x < F.col(order[0]))), F.lit(-1))  # null values come first
    new = new.withColumn("__part", part)
    sums = new.groupBy(key, group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy(group, "__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = new.withColumn("__within", F.row_number().over(Window.partitionBy(key, group, "__part").orderBy(*order))).join(sums, [key, group, "__part"]).join(top, key, "left")
    number = F.coalesce("__top", F.lit(0)) + F.col("__before") + F.col("__within")
    out = rows.withColumn("id", F.concat(F.lit(prefix + "-"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))))
    return out.drop("__top", "__before", "__within", "__part")


def absent(existing: DataFrame, matched: DataFrame, rebuilt_sources: DataFrame) -> DataFrame:
    """Existing claims of a rebuilt source that nothing matched: they become deprecated, and are not deleted."""
    gone = existing.join(matched.where("id IS NOT NULL").select("id"), "id", "left_anti").join(rebuilt_sources, "source_id", "left_semi")
    return gone.withColumns({"status": F.lit("deprecated"), "status_reason": F.lit("absent")})


def apply_rulings(claims: DataFrame, rulings: DataFrame) -> DataFrame:
    """claims (id, status, quote_hash, …) after their rulings (id, claim_id, kind, quote_hash, created_at) in time order.

    confirmed verifies while its quote hash still holds and else asks for review again; rejected and doc-wrong deprecate;
    deprioritized keeps the status.  Ties in time keep the order of ids.
    """
    order = F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("rid"), "kind", F.col("quote_hash").alias("rh"))))
    by_claim = rulings.groupBy(F.col("claim_id").alias("id")).agg(order.alias("r"))
    start = F.struct(F.col("status").alias("status"), F.lit(False).alias("low"))

    def step(acc, r):
        status = (
            F.when(r["kind"] == "confirmed", F.when(r["rh"].isNull() | (r["rh"] == F.col("quote_hash")), "verified").otherwise("needs-review"))
            .when(r["kind"].isin("rejected", "doc-wrong"), "deprecated")
            .otherwise(acc["status"])
        )
        return F.struct(status.alias("status"), (acc["low"] | (r["kind"] == "deprioritized")).alias("low"))

    folded = F.when(F.col("r").isNull(), start).otherwise(F.aggregate("r", start, step))
    out = claims.join(by_claim, "id", "left").withColumn("f", folded)
    return out.select(*[c for c in claims.columns if c != "status"], F.col("f.status").alias("status"), F.col("f.low").alias("deprioritized"), F.coalesce(F.size("r"), F.lit(0)).alias("n_rulings"))


def conflict_fanout(conflicts: DataFrame, rulings: DataFrame) -> DataFrame:
    """(claim_id, conflict_id): members that the last ruling of their conflict does not keep."""
    last = rulings.groupBy("conflict_id").agg(F.max_by("keep_claim_id", F.struct("created_at", "id")).alias("keep"))
    return conflicts.join(last.where("keep IS NOT NULL"), F.col("id") == F.col("conflict_id")).select(F.explode("claim_ids").alias("claim_id"), "conflict_id", "keep").where("claim_id <> keep").drop("keep")


def registry_stats(claims: DataFrame) -> DataFrame:
    return claims.groupBy("product_id").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("verified", "needs-review", "deprecated")))


def doc_freq(tokens: DataFrame, keys: Sequence[str] = ("product_id",), token: str = "stem") -> DataFrame:
    """(keys, token, n): in how many of the distinct (id, token) rows a token occurs."""
    return tokens.select(*keys, "id", token).distinct().groupBy(*keys, token).agg(F.count(F.lit(1)).alias("n"))


def _candidates(feats: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(product_id, a, b): pairs that may satisfy a rule, by prefix filters on stems in order of rarity; with `among` (product_id, id) only those with such a claim.

    Sets whose Jaccard similarity is at least t share one of the first n - ceil(t * n) + 1 stems of each, in any common
    order; those that share three, one of the first n - 2.  Only claims that a rule can apply to look for partners under it.
    """
    ranked = F.col("ranked")
    plain = F.filter(ranked, lambda w: ~w.isin(*L.STATUS_TOKENS))
    first = lambda c, t: F.slice(c, F.lit(1), F.greatest(F.lit(0), F.size(c) - F.ceil(F.size(c) * t - 1e-9).cast("int") + 1))
    three = F.slice(ranked, F.lit(1), F.greatest(F.lit(0), F.size(ranked) - 2))
    some = lambda c: F.size(c) > 0
    subject = some("subj")
    ways = [
        (some("rel"), some("rel"), first(plain, 0.25)), (some("nn") & subject, some("nn") & subject, first(ranked, 0.4)),
        (F.col("abs"), F.col("exc"), three), (F.col("exc"), F.col("abs"), three), (F.col("neg") & subject, ~F.col("neg") & subject, first(ranked, 0.6)), (~F.col("neg") & subject, F.col("neg") & subject, first(ranked, 0.6)),
    ]
    entries = [(F.when(left, F.lit(True)), F.when(right, F.lit(True)), stems) for left, right, stems in ways]
    way = F.explode(F.array(*(F.struct(F.lit(i).alias("way"), lf.alias("left"), rt.alias("right"), F.when(lf | rt, st).alias("stems")) for i, (lf, rt, st) in enumerate(entries)))).alias("w")
    posted = feats.select("product_id", "id", way).where("w.stems IS NOT NULL").select("product_id", "id", "w.way", "w.left", "w.right", F.explode("w.stems").alias("stem"))
    keys = ["product_id", "way", "stem"]
    left, right = posted.where("left").select(*keys, F.col("id").alias("a")), posted.where("right").select(*keys, F.col("id").alias("b"))
    only = lambda side, x: side.join(large(among.withColumnRenamed("id", x)), ["product_id", x], "left_semi")
    pairs = left.join(large(right), keys) if among is None else only(left, "a").join(large(right), keys).select(*keys, "a", "b").unionByName(left.join(large(only(right, "b")), keys).select(*keys, "a", "b"))
    return pairs.where("a < b").select("product_id", "a", "b").distinct()


def conflict_pairs(claims: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(product_id, a, b, kind, rule, interim_default): active claims that contradict each other, by the first rule that fits.

    Stems of more than a fifth of a product's claims (and of at least five) do not count.  sources: (source_id, kind,
    updated, fetched_at); a release status that differs between a living page and a changelog is a kind of its own, and
    the claim of the newest living source, or without one of the newest source, holds for the time being, but for
    absolutes against exceptions.
    """
    return conflict_members(*conflict_classes(conflict_features(claims, sources)))


def conflict_features(claims: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """What the rules of conflict_pairs look at, one row per active claim, written to the shared folder: a build that conflict_delta can start from."""
    active = claims.where("status <> 'deprecated' AND category <> 'market-evidence'")
    stems = active.select("product_id", "id", F.explode(T.stems_registry(F.col("text"))).alias("stem"))
    sizes = active.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_claims"))
    freq = doc_freq(stems).join(sizes, "product_id").withColumn("is_common", F.col("n") > F.greatest(F.lit(4), F.floor(F.col("n_claims") / 5)))
    common = freq.where("is_common")
    per_claim = stems.join(large(freq.where("NOT is_common").select("product_id", "stem", "n")), ["product_id", "stem"]).groupBy("product_id", "id").agg(F.array_sort(F.collect_list(F.struct("n", "stem"))).alias("r"))
    per_claim = per_claim.select("product_id", "id", F.transform("r", lambda x: x["stem"]).alias("ranked"))
    shared_common = common.groupBy("product_id").agg(F.collect_set("stem").alias("common"))
    if sources is None:
        sources = active.select("source_id").distinct().select("source_id", *(F.lit(None).cast("string").alias(c) for c in ("kind", "updated", "fetched_at")))
    source = sources.select("source_id", F.col("kind").alias("src"), F.struct(F.coalesce(F.col("updated").cast("string"), F.lit("")), F.coalesce(F.col("fetched_at").cast("string"), F.lit(""))).alias("age"))
    text = F.col("text")
    return materialized(active.join(large(per_claim), ["product_id", "id"]).join(shared_common, "product_id", "left").join(source, "source_id", "left").select(
        "product_id", "id", "text", F.col("ranked").alias("salient"), "ranked", "src", "age", F.coalesce("common", F.array().cast("array<string>")).alias("common"), T.release_status(text).alias("rel"), T.num_nouns(text).alias("nn"),
        T.subject(text).alias("subj"), T.qualifiers(text).alias("scope"), text.rlike(L.ABSOLUTE).alias("abs"), text.rlike(L.EXCEPTION).alias("exc"), text.rlike(L.REGISTRY_NEGATION).alias("neg"),
    ))


def conflict_delta(feats: DataFrame, before: DataFrame, known: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    """The conflict_pairs of feats, from the pairs known of an earlier build and its features: only claims that changed look for partners.

    A claim has changed if anything that a rule looks at has, the stems that count among it, or if it is new or gone; known
    pairs of changed claims are withdrawn, all others stay.  Known pairs that are kept as conflict_classes are never shuffled.
    """
    seen = F.xxhash64(F.to_json(F.struct("text", F.array_sort("salient"), "src", "age", "rel", "nn", "subj", "scope", "abs", "exc", "neg", F.array_sort(F.array_intersect("nn.noun", "common")))))
    now, then = feats.select("product_id", "id", seen.alias("now")), before.select("product_id", "id", seen.alias("then"))
    changed = materialized(now.join(then, ["product_id", "id"], "full_outer").where(~F.col("now").eqNullSafe(F.col("then"))).select("product_id", "id"))
    fresh = conflict_members(*conflict_classes(feats, changed), changed).drop("a_asked", "b_asked")
    if isinstance(known, DataFrame):
        gone = lambda pairs, x: pairs.join(changed.withColumnRenamed("id", x), ["product_id", x], "left_anti")
        kept = gone(gone(known, "a"), "b").select(*fresh.columns)
    else:
        found, members = known
        kept = conflict_members(found, materialized(members.join(large(changed), ["product_id", "id"], "left_anti")))
    return kept.unionByName(fresh)


def conflict_classes(feats: DataFrame, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The conflicts of feats by class: pairs of classes (product_id, a, b, kind, rule, held) and members (product_id, id, class), with `among` (product_id, id) only pairs with such a claim.

    Claims of a product that say the same with sources of one kind and age are a class: its smallest id alone looks for
    partners and is judged, and what is found holds for all members.
    """
    same = Window.partitionBy("product_id", "text", "src", "age")
    members = materialized(feats.select("product_id", "id", F.min("id").over(same).alias("class")))
    first = feats.join(large(members.where("id = class").select("product_id", "id")), ["product_id", "id"], "left_semi")
    asked = None if among is None else among.join(large(members), ["product_id", "id"]).select("product_id", F.col("class").alias("id")).distinct()
    return materialized(_judged(_candidates(first, asked), first)), members


def conflict_members(found: DataFrame, members: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(product_id, a, b, kind, rule, interim_default): the pairs of members of the conflicts of classes; with `asked` (product_id, id) those with such a claim, and a_asked, b_asked, which of them is one.

    Rows that are shuffled grow with the members; pairs, which grow with their square, are only returned.
    """
    side = lambda m, x, own: large(m.select("product_id", F.col("class").alias(x), F.col("id").alias(own)))
    both = lambda m, other: found.join(side(m, "a", "x"), ["product_id", "a"]).join(side(other, "b", "y"), ["product_id", "b"])
    x_first = F.col("x") < F.col("y")
    held = F.when(F.col("held") == "a", F.col("x")).when(F.col("held") == "b", F.col("y")).otherwise(F.least("x", "y"))
    row = ["product_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind", "rule", F.when(F.col("rule") != "absolute", held).alias("interim_default")]
    if asked is None:
        return both(members, members).select(*row)
    ids = asked.select("product_id", "id").distinct().withColumn("asked", F.lit(True))
    marked = materialized(members.join(large(ids), ["product_id", "id"], "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    of = lambda x_asked, where: both(marked.where("asked" if x_asked else "NOT asked"), marked.where(where)).withColumn("x_asked", F.lit(x_asked))
    flags = lambda y_asked: (F.when(x_first, F.col("x_asked")).otherwise(y_asked).alias("a_asked"), F.when(x_first, y_asked).otherwise(F.col("x_asked")).alias("b_asked"))
    ways = [of(a, "asked" if b else "NOT asked").select(*row, *flags(F.lit(b))) for a, b in ((True, True), (True, False), (False, True))]
    return ways[0].unionByName(ways[1]).unionByName(ways[2])


def _judged(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """Pairs (product_id, a, b) that a rule fits, with kind, rule and held: the side that holds for the time being, null where neither is newer."""
    side = lambda x: feats.select("product_id", *(F.col(c).alias(f"{x}_{c}") for c in feats.columns if c != "product_id")).withColumnRenamed(f"{x}_id", x)
    p = pairs.join(large(side("a")), ["product_id", "a"]).join(large(side("b")), ["product_id", "b"]).where("a_text <> b_text")
    sa, sb = F.col("a_salient"), F.col("b_salient")
    both = F.array_intersect(sa, sb)
    status_words = T.strings(L.STATUS_TOKENS)
    ua, ub = F.array_except(sa, status_words), F.array_except(sb, status_words)
    status_rule = (F.size("a_rel") > 0) & (F.size("b_rel") > 0) & (F.col("a_rel") != F.col("b_rel")) & (F.size(F.array_intersect(ua, ub)) >= 1) & (T.jaccard(ua, ub) >= 0.25)
    nouns = F.array_except(F.array_intersect(F.col("a_nn.noun"), F.col("b_nn.noun")), F.col("a_common"))
    values = lambda x: F.transform(F.filter(F.col(f"{x}_nn"), lambda v: F.array_contains(nouns, v["noun"])), lambda v: v["number"])
    subject = T.same_subject(F.col("a_subj"), F.col("b_subj"))
    other_scope = (F.size("a_scope") > 0) & (F.size("b_scope") > 0) & (F.col("a_scope") != F.col("b_scope"))
    number_rule = (F.size(nouns) > 0) & (F.size(both) >= 2) & subject & (T.jaccard(sa, sb) >= 0.4) & ~other_scope & (F.size(F.array_intersect(values("a"), values("b"))) == 0)
    absolute_rule = (F.size(both) >= 3) & ((F.col("a_abs") & F.col("b_exc") & ~F.col("b_abs")) | (F.col("b_abs") & F.col("a_exc") & ~F.col("a_abs")))
    negation_rule = (T.jaccard(sa, sb) >= 0.6) & subject & (F.col("a_neg") != F.col("b_neg"))
    rule = F.when(status_rule, "status").when(number_rule, "number").when(absolute_rule, "absolute").when(negation_rule, "negation")
    found = p.withColumn("rule", rule).where("rule IS NOT NULL")
    living = lambda x: F.col(f"{x}_src").eqNullSafe("living")
    mixed = (living("a") & F.col("b_src").eqNullSafe("changelog")) | (living("b") & F.col("a_src").eqNullSafe("changelog"))
    kind = F.when(F.col("rule") == "absolute", "absolute-vs-exception").when((F.col("rule") == "status") & mixed, "living-vs-changelog").otherwise("contradiction")
    held = F.when(living("a") & ~living("b"), "a").when(living("b") & ~living("a"), "b").when(F.col("b_age") > F.col("a_age"), "b").when(F.col("a_age") > F.col("b_age"), "a")
    return found.select("product_id", "a", "b", kind.alias("kind"), "rule", held.alias("held"))


def merge_conflicts(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Found conflicts (claim_ids, kind) merged into existing ones (id, claim_ids, kind, status) by their sets of claims: known ones keep their row, new ones open, unseen ones stay."""
    key = F.array_sort("claim_ids").alias("claims")
    f = found.select(key, F.col("kind").alias("f_kind"))
    e = existing.select(key, "id", "kind", "status")
    new_id = F.substring(F.sha2(F.array_join("claims", "~"), 256), 1, 12)
    return f.join(e, "claims", "full_outer").select(F.coalesce("id", new_id).alias("id"), F.col("claims").alias("claim_ids"), F.coalesce("kind", "f_kind").alias("kind"), F.coalesce("status", F.lit("open")).alias("status"))


def guardrail_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules (rule, type) that were added or removed."""
    added = new.select("rule", "type").subtract(old.select("rule", "type")).withColumn("change", F.lit("added"))
    return added.unionByName(old.select("rule", "type").subtract(new.select("rule", "type")).withColumn("change", F.lit("removed")))


def detect_changes(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """incoming (source_id, sha256, …) with changed: no current version, another digest, or one that is not active."""
    c = current.select("source_id", F.col("sha256").alias("__sha"), F.col("status").alias("__status"))
    changed = F.col("__sha").isNull() | (F.col("__sha") != F.col("sha256")) | (F.col("__status") != "active")
    return incoming.join(c, "source_id", "left").withColumn("changed", changed).drop("__sha", "__status")


def latest(versions: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last version of each key, by max_by: rows are pre-aggregated before the shuffle."""
    row = F.struct(*versions.columns)
    return versions.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")
