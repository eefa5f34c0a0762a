"""Evaluation of the gate: labelled seeds put into pages, judged as any draft is, and folded back onto the seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.parse import draft_units
from . import gate
from .planning import golden_matches


def golden_seeds(golden: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds (product_id, id, label, text), skipped (product_id, id, why)) of hand-labelled sentences (product_id, id, label, text, quotes).

    Each quote must be found among the claims (product_id, pos, id, text, status); seeds cite what was found.  A true
    sentence whose claims are not all verified is not-citable; untagged and positioning ones cite nothing.
    """
    quotes = golden.select("product_id", F.col("id").alias("g_id"), F.posexplode("quotes").alias("q", "quote")).where("quote <> ''")
    status = claims.select(F.col("id").alias("claim_id"), "status")
    found = golden_matches(quotes, claims).join(status, "claim_id", "left").groupBy("product_id", "g_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("claim_id").isNotNull(), F.struct("q", "claim_id")))), lambda x: x["claim_id"]).alias("ids"),
        F.max(F.col("claim_id").isNull()).alias("lost"), F.max(F.col("status") != "verified").alias("weak"),
    )
    g = golden.withColumnRenamed("id", "g_id").join(found, ["product_id", "g_id"], "left").withColumns({"ids": F.coalesce("ids", F.array().cast("array<string>")), "lost": F.coalesce("lost", F.lit(False)), "weak": F.coalesce("weak", F.lit(False))})
    needs = F.col("label") != "positioning"
    why = F.when(F.col("lost"), "support quote not found in registry").when(needs & (F.size("ids") == 0), "no support quote")
    g = g.withColumn("why", why)
    label = F.when((F.col("label") == "true") & F.col("weak"), "not-citable").otherwise(F.col("label"))
    text = F.when(F.col("label").isin("positioning", "untagged"), F.col("text")).otherwise(T.tag(F.col("text"), F.col("ids")))
    ok = g.where("why IS NULL").select("product_id", F.col("g_id").alias("id"), label.alias("label"), text.alias("text"))
    return ok, g.where("why IS NOT NULL").select("product_id", F.col("g_id").alias("id"), "why")


def paged(seeds: DataFrame, page_size: int = 40) -> DataFrame:
    """seeds (product_id, id, label, text) with item_id, the page they are put on, and pos on it: by a hash of id and label, page_size a page."""
    nth = F.row_number().over(Window.partitionBy("product_id").orderBy(F.md5(F.concat_ws("/", "id", "label")), "id", "label")) - 1
    s = seeds.withColumn("__nth", nth)
    return s.withColumns({"item_id": F.concat_ws("/", "product_id", F.floor(F.col("__nth") / page_size).cast("string")), "pos": (F.col("__nth") % page_size).cast("int")}).drop("__nth")


def page_texts(placed: DataFrame) -> DataFrame:
    """(product_id, item_id, md) of paged seeds: a heading, and a paragraph for each seed."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return placed.groupBy("product_id", "item_id").agg(F.concat(F.lit("# Evaluation page\n\n"), F.array_join(lines, "\n\n"), F.lit("\n")).alias("md"))


def judged(pages: DataFrame, claims: DataFrame, conflicts: DataFrame, high_risk: Sequence[str] = L.HIGH_RISK) -> DataFrame:
    """(item_id, index, text, blocked, reason) of every unit of pages (product_id, item_id, md), against claims and conflicts (id, kind, status, claim_ids).

    The verifier's verdict, made stricter by the rules of citing; units that a blocking page check names are blocked too.
    """
    units = draft_units(pages).join(pages.select("item_id", "product_id"), "item_id")
    v = gate.verify(gate.registry_overlap(units, claims), claims.select("id", "text", "status"), vocabulary=gate.known_vocabulary(claims))
    cites = v.select("item_id", "index", F.posexplode("ids").alias("pos", "cited_id"))
    mechanical = gate.unit_verdicts(gate.cited(cites, claims, high_risk), ["item_id", "index"])
    final = gate.enforce(v.select("item_id", "index", "text", F.col("verdict").alias("r_verdict"), F.col("reason").alias("r_reason")), mechanical)
    implied = gate.implied_conclusions(v, claims).select("item_id", F.explode(F.array("before", "index")).alias("index"))
    tension = gate.page_tension(cites.select("item_id", "index", "cited_id"), conflicts, claims).where("verdict = 'block'").select("item_id", F.explode("indexes").alias("index"))
    checks = implied.unionByName(tension).distinct().withColumn("__page", F.lit(True))
    return final.join(checks, ["item_id", "index"], "left").select("item_id", "index", "text", ((F.col("verdict") == "block") | F.coalesce("__page", F.lit(False))).alias("blocked"), "reason")


def run(seeds: DataFrame, claims: DataFrame, conflicts: DataFrame, page_size: int = 40, high_risk: Sequence[str] = L.HIGH_RISK) -> DataFrame:
    """seeds (product_id, id, label, text) with item_id, blocked and reasons: blocked if any unit of its page that says one of its sentences is.

    Units are told by their words, so seeds that say the same on one page share their fate; seeds without words pass.
    """
    placed = paged(seeds, page_size)
    verdicts = judged(page_texts(placed), claims, conflicts, high_risk).withColumn("__said", gate.said(F.col("text")))
    parts = placed.select("product_id", "item_id", "id", "label", F.explode(T.split_sentences(F.col("text"))).alias("__part")).withColumn("__said", gate.said(F.col("__part")))
    outcome = parts.join(verdicts.drop("text"), ["item_id", "__said"]).groupBy("product_id", "item_id", "id", "label").agg(F.max("blocked").alias("blocked"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    out = placed.drop("pos").join(outcome, ["product_id", "item_id", "id", "label"], "left")
    return out.withColumns({"blocked": F.coalesce("blocked", F.lit(False)), "reasons": F.coalesce("reasons", F.array().cast("array<string>"))})
