"""The governance tables, rendered from the star schema: parts are claims, orders drafts, line items their cited sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Endings of rendered claim sentences by part key modulo their number; {n} is the part's size.
TEMPLATES = (
    "supports up to {n} units.",
    "never exceeds {n} units.",
    "is in beta on the pro plan.",
    "is generally available on the pro plan.",
    "supports up to {n} units except on the basic plan.",
    "costs {n} per month.",
    "encrypts stored records with AES keys.",
    "cannot exceed {n} units.",
    "is planned for the roadmap.",
    "works with {n} connectors.",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claim_id(key):
    return F.concat(F.lit("PT-"), F.lpad(key.cast("string"), 8, "0"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, product_id, num, source_id, text, location, category, confidence, status) of every part.

    Rows are dealt first: a million parts are a few MB of file, which a task or two would read and work on.
    """
    part = load(spark, sf_dir, "part").repartition("p_partkey")
    ending = [F.replace(F.lit(t), F.lit("{n}"), F.col("p_size").cast("string")) for t in TEMPLATES]
    which = F.col("p_partkey") % len(TEMPLATES)
    text = F.concat_ws(" ", "p_brand", "p_type", reduce(lambda acc, i: acc.when(which == i, ending[i]), range(1, len(TEMPLATES)), F.when(which == 0, ending[0])))
    status = F.when(F.col("p_partkey") % 7 == 0, "deprecated").when(F.col("p_partkey") % 7 == 1, "needs-review").otherwise("verified")
    rows = part.select(claim_id(F.col("p_partkey")).alias("id"), F.col("p_brand").alias("product_id"), F.col("p_partkey").alias("num"), (F.col("p_partkey") % 5).alias("source_id"), text.alias("text"), status.alias("status"), F.concat("p_type", F.lit(" > Details ¶"), "p_size").alias("location"))
    return rows.withColumns({"category": T.category(F.col("text")), "confidence": T.confidence(F.col("text"))})


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, kind, updated, fetched_at): regions are the sources of claims, changelogs and living pages of different age."""
    kind = F.when(F.col("r_regionkey") % 3 == 0, "changelog").when(F.col("r_regionkey") % 3 == 1, "living").otherwise("other")
    return load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("source_id"), kind.alias("kind"), F.substring("r_name", 1, 1).alias("updated"), F.lit("2026-01-01").alias("fetched_at"))


def product_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, product_id, type, status, words): suppliers are the source documents of products."""
    kinds = F.array(*map(F.lit, ("truth", "style", "positioning", "evidence")))
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        k.alias("source_id"), F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("product_id"), F.get(kinds, (F.floor(k / 25) % 4).cast("int")).alias("type"), F.when(k % 7 == 0, "removed").otherwise("active").alias("status"), (k % 500).alias("words")
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, index, cited_id): one cited sentence per line item; those of every eleventh part cite a claim that does not exist."""
    cited = F.col("l_partkey") + F.when(F.col("l_partkey") % 11 == 0, 90_000_000).otherwise(0)
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("index"), claim_id(cited).alias("cited_id"))


CLAIMS_SQL = (
    "claims AS (SELECT 'PT-' || lpad(p_partkey::VARCHAR, 8, '0') AS id, p_brand AS product_id, p_partkey AS num, p_partkey % 5 AS source_id, "
    "p_brand || ' ' || p_type || ' ' || CASE p_partkey % 10 "
    + " ".join(f"WHEN {i} THEN replace('{t}', '{{n}}', p_size::VARCHAR)" for i, t in enumerate(TEMPLATES))
    + " END AS text, p_type || ' > Details ¶' || p_size AS location, CASE p_partkey % 7 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'needs-review' ELSE 'verified' END AS status FROM part)"
)
SOURCES_SQL = "sources AS (SELECT r_regionkey AS source_id, (['changelog', 'living', 'other'])[r_regionkey % 3 + 1] AS kind, left(r_name, 1) AS updated FROM region)"
PRODUCT_SOURCES_SQL = (
    "psources AS (SELECT s_suppkey AS source_id, 'Brand#' || (s_suppkey % 25 + 1)::VARCHAR AS product_id, (['truth', 'style', 'positioning', 'evidence'])[(s_suppkey // 25) % 4 + 1] AS type, "
    "CASE WHEN s_suppkey % 7 = 0 THEN 'removed' ELSE 'active' END AS status, s_suppkey % 500 AS words FROM supplier)"
)
UNITS_SQL = "units AS (SELECT l_orderkey AS item_id, l_linenumber AS index, 'PT-' || lpad((l_partkey + CASE WHEN l_partkey % 11 = 0 THEN 90000000 ELSE 0 END)::VARCHAR, 8, '0') AS cited_id FROM lineitem)"
