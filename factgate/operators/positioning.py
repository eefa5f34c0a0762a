"""Positioning packs: the nested rows that a positioning document says by its headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import proof_links

#: What a persona may know of a product; fixed values.
STAGES = ("unaware", "problem-aware", "solution-aware", "product-aware", "most-aware")


def _before(text: Column, mark: str) -> Column:
    return F.trim(F.substring_index(text, mark, 1))


def _after(text: Column, mark: str) -> Column:
    at = F.instr(text, mark)
    return F.when(at > 0, F.trim(F.substring(text, at + len(mark), F.length(text)))).otherwise("")


def _last_by_key(said: Column) -> Column:
    """A map of `key: value` texts; of equal keys the last counts."""
    entries = F.transform(said, lambda x: F.struct(F.lower(_before(x, ":")).alias("k"), _after(x, ":").alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def packs(blocks: DataFrame, key: str = "source_id") -> DataFrame:
    """One pack per document: (key, positioning_statement, category, alternatives, value_themes, personas, objections, stages, messaging).

    blocks: (key, block_pos, level, path, text).  The second heading of a block's path, in lower case, is its section, the
    third its entry.  Themes have a message (their first text that is no proof) and proof points; personas a role, pains,
    goals (parts between semicolons) and a stage, the last line of each counting; objections are `a => b`.  Without a
    statement of its own the first text of the document is it.  Documents are shuffled once, by key, and are one row each,
    as their texts are; null and empty documents give no pack.
    """
    body = blocks.where("level = 0").select(key, "block_pos", F.lower(F.get("path", F.lit(1))).alias("section"), F.get("path", F.lit(2)).alias("entry"), "text").repartition(key)
    entries = body.groupBy(key, "section", "entry").agg(F.min("block_pos").alias("at"), F.array_sort(F.collect_list(F.struct("block_pos", "text"))).alias("said"))
    doc = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "section", "entry", "said"))).alias("e"))
    texts = lambda said: F.transform(said, lambda x: x["text"])
    of = lambda section: F.filter("e", lambda e: e["section"] == section)
    lines = lambda section: texts(F.array_sort(F.flatten(F.transform(of(section), lambda e: e["said"]))))
    named = lambda section: F.filter(of(section), lambda e: e["entry"].isNotNull())
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    proof = r"(?i)^proof:\s*"

    def theme(e: Column) -> Column:
        points = F.transform(F.filter(texts(e["said"]), lambda t: t.rlike(proof)), lambda t: F.trim(F.regexp_replace(t, proof, "")))
        return F.struct(e["entry"].alias("name"), first(F.filter(texts(e["said"]), lambda t: ~t.rlike(proof))).alias("message"), points.alias("proof_points"))

    def persona(e: Column) -> Column:
        said = lambda k: F.transform(F.filter(texts(e["said"]), lambda t: F.lower(_before(t, ":")) == k), lambda t: _after(t, ":"))
        last = lambda a, other: F.coalesce(F.get(F.reverse(a), F.lit(0)), F.lit(other))
        parts = lambda k: F.filter(F.transform(F.split(last(said(k), ""), ";"), lambda x: F.trim(x)), lambda x: x != "")
        stage = F.filter(said("stage"), lambda v: v.isin(*STAGES))
        return F.struct(e["entry"].alias("name"), last(said("role"), "").alias("role"), parts("pains").alias("pains"), parts("goals").alias("goals"), last(stage, "problem-aware").alias("stage"))

    everything = texts(F.array_sort(F.flatten(F.transform("e", lambda e: e["said"]))))
    statement = first(lines("positioning statement"))
    return doc.select(
        key,
        F.when(statement != "", statement).otherwise(first(everything)).alias("positioning_statement"),
        first(lines("category")).alias("category"),
        F.transform(lines("competitive alternatives"), lambda t: F.struct(_before(t, ":").alias("name"), _after(t, ":").alias("notes"))).alias("alternatives"),
        F.transform(named("value themes"), theme).alias("value_themes"),
        F.transform(named("personas"), persona).alias("personas"),
        F.transform(lines("objections"), lambda t: F.struct(_before(t, "=>").alias("text"), _after(t, "=>").alias("response"))).alias("objections"),
        _last_by_key(lines("awareness stages")).alias("stages"),
        _last_by_key(lines("messaging")).alias("messaging"),
    )


def proof_rows(pack: DataFrame, key: str = "source_id", also: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """(key, also, theme, pos, text) of the proof points of packs."""
    themes = pack.select(key, *also, F.posexplode("value_themes").alias("nth", "t"))
    return themes.select(key, *also, "nth", F.col("t.name").alias("theme"), F.posexplode("t.proof_points").alias("pos", "text"))


def linked(pack: DataFrame, claims: DataFrame, key: str = "source_id") -> DataFrame:
    """pack (key, product_id, …) with value_themes whose proof points are (text, status, claim_ids): of the three best verified claims (product_id, id, text, status) the first that has 0.6 of their stems."""
    at = F.concat_ws("/", F.col(key).cast("string"), F.col("nth").cast("string"), F.col("pos").cast("string"))
    rows = proof_rows(pack, key).withColumn("query_id", at)
    targets = claims.where("status = 'verified'").select("product_id", F.col("id").alias("target_id"), "text")
    found = proof_links(rows.select("product_id", "query_id", "text"), targets, by=("product_id",))
    ids = rows.join(found, ["product_id", "query_id"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "nth", "pos"), "target_id"))).alias("__ids"))

    def theme(t: Column, nth: Column) -> Column:
        def point(text: Column, pos: Column) -> Column:
            own = F.try_element_at(F.col("__ids"), F.concat_ws("/", nth.cast("string"), pos.cast("string")))
            return F.struct(text.alias("text"), F.when(own.isNull(), "needs-claim").otherwise("has-claim").alias("status"), F.array_compact(F.array(own)).alias("claim_ids"))

        return F.struct(t["name"].alias("name"), t["message"].alias("message"), F.transform(t["proof_points"], point).alias("proof_points"))

    return pack.join(ids, key, "left").withColumn("value_themes", F.transform("value_themes", theme)).drop("__ids")
