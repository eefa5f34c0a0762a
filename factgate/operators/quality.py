"""Data-quality rules: each gives (rule, key) rows for what breaks it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .reports import duplicate_keys, run_rules, violations
from .search import contained

QUOTE_WORDS = 60


def claim_rules(claims: DataFrame, prefix: str, high_risk: Sequence[str] = L.HIGH_RISK) -> DataFrame:
    """claims (id, quote, category, confidence, status, decision, count): quotes under 60 words, the product's prefix, no high-risk or low-confidence claim verified without a person, counts of market evidence."""
    risky = F.col("category").isin(*high_risk) | (F.col("confidence") == "low")
    return violations(claims, F.col("id"), {
        "quote-too-long": T.word_count(F.col("quote")) >= QUOTE_WORDS,
        "id-prefix": ~F.col("id").startswith(prefix + "-"),
        "needs-confirmation": (F.col("status") == "verified") & risky & ~F.coalesce(F.col("decision").isin("confirmed", "deprioritized"), F.lit(False)),
        "evidence-without-count": (F.col("category") == "market-evidence") & F.col("count").isNull(),
    }).unionByName(duplicate_keys(claims, "id"))


def quote_rules(quotes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """quotes (id, source_id, quote) that are too long, or not in the text of their snapshot (source_id, text)."""
    checked = contained(quotes, snapshots, "source_id")
    return violations(checked, F.col("id"), {"quote-too-long": T.word_count(F.col("quote")) >= QUOTE_WORDS, "quote-not-verbatim": ~F.col("verbatim")})


def profile_rules(profiles: DataFrame) -> DataFrame:
    """profiles (product_id, product_name, allowed, forbidden, preferred, banned, status, consistent, weights array<double>)."""
    low = lambda c: F.transform(c, F.lower)
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return violations(profiles, F.col("product_id"), {
        "name-forbidden": F.array_contains("forbidden", F.col("product_name")),
        "variant-allowed-and-forbidden": F.arrays_overlap(low("allowed"), low("forbidden")),
        "word-preferred-and-banned": F.arrays_overlap(low("preferred"), low("banned")),
        "inconsistent-but-active": (F.col("status") == "active") & ~F.col("consistent"),
        "weights-do-not-sum-to-one": (F.size("weights") > 0) & (F.abs(total - 1) > 0.01),
    })


def pack_rules(guardrails: DataFrame, proofs: DataFrame, decisions: DataFrame) -> DataFrame:
    """guardrails (product_id, rule, decision_id) of unknown decisions (id), and proofs (id, status, claim_ids) whose status and claims disagree."""
    unknown = guardrails.join(decisions.select(F.col("id").alias("decision_id")), "decision_id", "left_anti").select(F.lit("unknown-decision").alias("rule"), F.col("decision_id").alias("key"))
    return unknown.unionByName(violations(proofs, F.col("id"), {"has-claim-without-ids": (F.col("status") == "has-claim") & (F.size("claim_ids") == 0), "needs-claim-with-ids": (F.col("status") == "needs-claim") & (F.size("claim_ids") > 0)}))


def plan_rules(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """Sections of plans (brief_id, section, id) that plan around a claim which is not verified."""
    bad = plans.join(claims.where("status = 'verified'").select("id"), "id", "left_anti")
    return bad.select(F.lit("plan-on-unverified-claim").alias("rule"), F.concat_ws("/", "brief_id", "section", "id").alias("key"))


def report_rules(reports: DataFrame) -> DataFrame:
    """reports (item_id, status, block_count, override struct<reason>)."""
    over = F.col("override")
    return violations(reports, F.col("item_id"), {
        "override-missing": (F.col("status") == "approved-override") & over.isNull(),
        "approved-with-blocks": (F.col("status") == "approved") & (F.col("block_count") > 0),
        "override-without-reason": over.isNotNull() & (F.trim(F.coalesce(over["reason"], F.lit(""))) == ""),
    })


def evidence_rules(evidence: DataFrame) -> DataFrame:
    """evidence (id, count, total)."""
    return violations(evidence, F.col("id"), {"count-exceeds-total": F.col("count") > F.col("total")})


def constraints(required: Sequence[str] = (), enums: Mapping[str, Sequence[str]] | None = None, patterns: Mapping[str, str] | None = None, ranges: Mapping[str, tuple] | None = None, lengths: Mapping[str, tuple] | None = None) -> dict[str, Column]:
    """Column constraints as rules for `violations`: required, enum, pattern, least and largest value, and length of strings or size of arrays.

    A null breaks `required` alone; a bound of None is none.  Array columns are named with a [] behind them in lengths.
    """
    holds = lambda c: F.coalesce(c, F.lit(False))

    def outside(x: Column, low, high) -> Column:
        return holds(F.lit(False) if low is None else x < low) | holds(F.lit(False) if high is None else x > high)

    rules = {f"{c}: required": F.col(c).isNull() for c in required}
    rules |= {f"{c}: enum": holds(~F.col(c).isin(*values)) for c, values in (enums or {}).items()}
    rules |= {f"{c}: pattern": holds(~F.col(c).rlike(p)) for c, p in (patterns or {}).items()}
    rules |= {f"{c}: range": outside(F.col(c), *limits) for c, limits in (ranges or {}).items()}
    rules |= {f"{c}: length": outside(F.size(c[:-2]) if c.endswith("[]") else F.length(c), *limits) for c, limits in (lengths or {}).items()}
    return rules


#: The rules of each kind of artifact, by name: functions of that kind's tables.
RULES: dict[str, Callable[..., DataFrame]] = {
    "claims-record": quote_rules, "registry": claim_rules, "style-profile": profile_rules, "positioning-pack": pack_rules, "plan": plan_rules, "verification-report": report_rules, "market-evidence": evidence_rules,
}


def sweep(tables: Mapping[str, Sequence]) -> DataFrame:
    """Violations by rule of all artifacts: tables names a kind of RULES and the arguments of its rules."""
    return run_rules(*(RULES[kind](*args) for kind, args in tables.items()))
