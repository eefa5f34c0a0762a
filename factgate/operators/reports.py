"""Reports, retention and data-quality rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L


def coverage(claims: DataFrame, topics: DataFrame) -> DataFrame:
    """Claims per topic (category) that are not deprecated, zero rows included; topics is a small dimension."""
    n = claims.where("status <> 'deprecated'").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return topics.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def stale_sources(sources: DataFrame, last_built: DataFrame) -> DataFrame:
    """Sources (source_id, sha256, status) that differ from what was built last, or are gone though it was built from them."""
    b = last_built.select("source_id", F.col("sha256").alias("built"))
    both = sources.where("status = 'active'").select("source_id", "sha256").join(b, "source_id", "full_outer")
    return both.where(~F.col("sha256").eqNullSafe(F.col("built"))).select("source_id", F.when(F.col("sha256").isNull(), "removed").when(F.col("built").isNull(), "added").otherwise("changed").alias("change"))


def kb_status(products: DataFrame, sources: DataFrame, claims: DataFrame, profiles: DataFrame, packs: DataFrame, stale: DataFrame) -> DataFrame:
    """One row per product (product_id): active sources by type, verified, needs_review, n_stale, blockers, warnings and state.

    sources: (product_id, type, status); profiles: (product_id, status, threshold); packs: (product_id); stale: (product_id,
    source_id).  No truth source or no verified claim blocks; a stale source makes an unblocked product stale.
    """
    kind = lambda t: F.count_if((F.col("type") == t) & (F.col("status") == "active")).alias(t)
    by_type = sources.groupBy("product_id").agg(*map(kind, ("truth", "style", "positioning", "evidence")))
    counted = claims.groupBy("product_id").agg(F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "needs-review").alias("needs_review"))
    old = stale.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_stale"))
    profile = profiles.select("product_id", F.col("status").alias("__profile"), "threshold")
    out = products.select("product_id").join(by_type, "product_id", "left").join(counted, "product_id", "left").join(old, "product_id", "left")
    out = out.join(profile, "product_id", "left").join(packs.select("product_id", F.lit(True).alias("__pack")), "product_id", "left").fillna(0, ["truth", "style", "positioning", "evidence", "verified", "needs_review", "n_stale"])
    none = lambda c: F.col(c) == 0
    blockers = F.array_compact(F.array(F.when(none("truth"), "no-truth-sources").when(none("verified"), "no-verified-claims")))
    style = F.when(none("style"), "no-style-sources").when(F.col("__profile").isNull(), "profile-not-built").when(F.col("__profile") != "active", "profile-is-a-draft").when(F.col("threshold").isNull(), "threshold-not-accepted")
    positioning = F.when(none("positioning"), "no-positioning-sources").when(F.col("__pack").isNull(), "pack-not-built")
    warnings = F.array_compact(F.array(style, positioning, F.when(~none("n_stale"), "stale")))
    out = out.withColumns({"blockers": blockers, "warnings": warnings})
    return out.withColumn("state", F.when(F.size("blockers") > 0, "blocked").when(~none("n_stale"), "stale").otherwise("ready")).drop("__profile", "__pack")


def onboarding(status: DataFrame, built: DataFrame) -> DataFrame:
    """(product_id, step, done): the six steps of setting up a product, from kb_status and the products (product_id) built so far."""
    s = status.join(built.select("product_id", F.lit(True).alias("__built")), "product_id", "left")
    steps = {
        "truth sources": F.col("truth") > 0, "style examples": F.col("style") > 0, "positioning material": F.col("positioning") > 0, "knowledge base": F.coalesce("__built", F.lit(False)),
        "claims reviewed": (F.col("verified") > 0) & (F.col("needs_review") == 0), "style threshold": F.col("threshold").isNotNull(),
    }
    return s.select("product_id", F.explode(F.create_map(*(x for k, v in steps.items() for x in (F.lit(k), v)))).alias("step", "done"))


#: Automatic revisions of a draft, claims of a page's slice, and tokens a claim takes; fixed values.
AUTO_ROUNDS, SLICE, PER_CLAIM = 2, 150, 60


def quality_report(items: DataFrame, by: str) -> DataFrame:
    """Per group of content items (by, n_rounds, live_round, live_status): items, approved, override_rate, avg_rounds and those approved within the automatic rounds."""
    live = F.col("live_status").isNotNull()
    over = F.count_if(F.col("live_status") == "approved-override")
    within = (F.col("live_round") <= 1 + AUTO_ROUNDS) & (F.col("live_status") == "approved")
    return items.groupBy(by).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(live).alias("approved"), F.when(F.count_if(live) > 0, F.round(over / F.count_if(live), 3)).alias("override_rate"), F.round(F.avg("n_rounds"), 2).alias("avg_rounds"), F.count_if(within).alias("approved_within_cap")
    )


def blocks_by_reason(flags: DataFrame) -> DataFrame:
    """(reason, n) of blocking flags, the most frequent first; those of pages have no reason of their own."""
    return flags.where("severity = 'block'").groupBy(F.coalesce(F.nullif("reason", F.lit("")), F.lit("page")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def newest(rows: DataFrame, at: str, n: int, tie: str = "id") -> DataFrame:
    """The n newest rows: audit entries, runs, evaluations."""
    return rows.orderBy(F.desc(at), tie).limit(n)


def open_first(conflicts: DataFrame) -> DataFrame:
    """Conflicts as they are listed: open ones first, then by kind and id."""
    return conflicts.orderBy(F.col("status") != "open", "kind", "id")


def auto_rounds_used(rounds: DataFrame) -> DataFrame:
    """(item_id, auto_rounds, exhausted) of rounds (item_id, kind)."""
    return rounds.groupBy("item_id").agg(F.count_if(F.col("kind") == "auto").alias("auto_rounds")).withColumn("exhausted", F.col("auto_rounds") >= AUTO_ROUNDS)


def failed_sources(sources: DataFrame, rejected: DataFrame) -> DataFrame:
    """sources (source_id, status, …) of which an extraction broke a rule (rejected: source_id, rule): failed, with the number of rejections."""
    n = rejected.groupBy("source_id").agg(F.count(F.lit(1)).alias("rejections"))
    return sources.join(n, "source_id").withColumn("status", F.lit("extraction-failed"))


def with_sources(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claims with title, url, kind and age of their sources (source_id, title, url, kind, updated); a missing title is the source's id."""
    s = sources.select("source_id", F.col("title").alias("__t"), "url", F.col("kind").alias("source_kind"), "updated")
    return claims.join(s, "source_id", "left").withColumn("source_title", F.coalesce("__t", F.col("source_id").cast("string"))).drop("__t")


def cost_report(runs: DataFrame, first: str, second: str, cost: str) -> DataFrame:
    """Cost by each of two dimensions and in total, in one pass."""
    g = runs.groupingSets([[F.col(first)], [F.col(second)], []], F.col(first), F.col(second))
    return g.agg(F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def review_queue(claims: DataFrame, high_risk: Sequence[str] = L.HIGH_RISK) -> DataFrame:
    """Claims that need review by product, category and theme (the first heading of their location): how many, the ids in numeric order, and whether they may be ruled on in bulk."""
    theme = F.trim(F.substring_index(F.substring_index("location", ">", 1), "¶", 1))
    waiting = claims.where("status = 'needs-review'").withColumn("theme", F.when(F.coalesce(theme, F.lit("")) == "", "General").otherwise(theme))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("num", "id"))), lambda x: x["id"])
    out = waiting.groupBy("product_id", "category", "theme").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))
    return out.withColumn("bulk_allowed", ~F.col("category").isin(*high_risk))


def gaps(tables: Mapping[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(gap_type, key, detail) rows of several tables; each name maps to a table and its two columns."""
    rows = [t.select(F.lit(name).alias("gap_type"), key.cast("string").alias("key"), detail.cast("string").alias("detail")) for name, (t, key, detail) in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def retention_plan(rounds: DataFrame, days: int, now: Column, runs: DataFrame | None = None) -> DataFrame:
    """(kind, item_id, round, created_at) to purge: rounds older than `days` that are neither the item's live one nor purged before, and runs (id, created_at) as old."""
    w = Window.partitionBy("item_id")
    live = F.max(F.when(F.col("status").isin("approved", "approved-override"), F.col("round"))).over(w)
    cutoff = now - F.make_interval(days=F.lit(days))
    kept = F.coalesce(F.col("round") == F.col("live"), F.lit(False)) | (F.col("purged").isNotNull() if "purged" in rounds.columns else F.lit(False))
    out = rounds.withColumn("live", live).where((F.col("created_at") < cutoff) & ~kept).select(F.lit("round").alias("kind"), "item_id", "round", "created_at")
    if runs is None:
        return out
    return out.unionByName(runs.where(F.col("created_at") < cutoff).select(F.lit("run").alias("kind"), F.col("id").alias("item_id"), F.lit(None).cast("int").alias("round"), "created_at"))


def violations(table: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, key) for each row and rule whose condition holds; one pass over the table."""
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())))
    return table.select(key.cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key")


def duplicate_keys(table: DataFrame, key: str, rule: str = "duplicate-id") -> DataFrame:
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def run_rules(*found: DataFrame) -> DataFrame:
    """Violations counted by rule."""
    return reduce(DataFrame.unionByName, found).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def budget_state(runs: DataFrame, by: str, cost: str, budget: float) -> DataFrame:
    """Per group: runs, what they spent, and whether that reaches the budget."""
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.sum(cost).alias("spent")).withColumn("over_budget", F.col("spent") >= budget)


def correction_notes(claims: DataFrame, rulings: DataFrame) -> DataFrame:
    """(claim_id, created_at, ruling_id, text, source_id) of claims that a ruling found wrong in the documents."""
    wrong = rulings.where("kind = 'doc-wrong'").select(F.col("id").alias("ruling_id"), "claim_id", "created_at")
    return wrong.join(claims.select(F.col("id").alias("claim_id"), "text", "source_id"), "claim_id")


def browse(claims: DataFrame, status: str | None = None, category: str | None = None, contains: str | None = None, limit: int = 100) -> DataFrame:
    """A page of claims in numeric order of their ids."""
    for cond in (status and (F.col("status") == status), category and (F.col("category") == category), contains and (F.contains("text", F.lit(contains)) | F.contains("id", F.lit(contains)))):
        if cond is not None and not isinstance(cond, str):
            claims = claims.where(cond)
    return claims.orderBy(F.regexp_extract("id", r"(\d+)$", 1).cast("long"), "id").limit(limit)


def batches(rows: DataFrame, by: str, order: str, size: int = 40) -> DataFrame:
    """rows with batch: fixed batches per group, in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))


def leaked_names(texts: DataFrame, key: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Keys whose texts hold a name: two or more capitalised words in a row that are not in the allow-list."""
    names = F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]++(?: [A-Z][a-z]++)++"), 0)
    return texts.where(F.exists(names, lambda n: ~n.isin(*allowed) if allowed else F.lit(True))).select(key).distinct()


def estimate_tokens(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(product_id, kind, tokens): what a run of each kind may take, from the product's verified claims and the words of its active sources (product_id, status, words)."""
    verified = claims.groupBy("product_id").agg(F.count_if(F.col("status") == "verified").alias("v"))
    words = sources.where("status = 'active'").groupBy("product_id").agg(F.sum("words").alias("w"))
    slice_ = F.least(F.coalesce("v", F.lit(0)), F.lit(SLICE)) * PER_CLAIM
    kinds = {
        "eval": F.lit(2 * (40 * 120 + 20_000)), "quick-check": 15_000 + slice_, "ingest": F.floor(F.coalesce("w", F.lit(0)) * 1.4 * 3), "content": slice_ * 2 + 40_000 + (4 * (slice_ + 6_000) + 30_000) * (1 + AUTO_ROUNDS),
    }
    out = verified.join(words, "product_id", "full_outer")
    return out.select("product_id", F.explode(F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), v.cast("long"))))).alias("kind", "tokens"))
