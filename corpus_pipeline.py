"""The corpus pipeline: documents in, a filtered, deduplicated, mixed and encoded training corpus out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgate.llm import quality_knn
from factgate.llm.byte_bpe import decode_ids, encode_texts
from factgate.llm.common import crc_mod, prepare
from factgate.llm.exact_dedup import drop_copies
from factgate.llm.ngram_join import drop_near_copies
from factgate.llm.source_mix import take_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for quality stay; documents that resemble nothing labelled (empty and null ones, say) do, as do all without labels."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    voters = quality_knn.train(docs, labels, "quality", crc_mod("doc_id", 5) != 0)
    others = [c for c in docs.columns if c != "doc_id"]
    name = "quality_score" + "_" * max(map(len, docs.columns))  # longer than any column's name
    return quality_knn.score_quality(docs, voters, keep=others, score_col=name).where(F.col(name) >= 0.3).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays (null ids last); null counts as empty.  An empty table stays empty."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of near-equal shingle sets connect, the one with the smallest id stays (null ids last).

    Documents without words, null texts too, have no sets and all stay; of rows that repeat an id the first by text stays.
    """
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: documents are left out, taken once or taken twice.

    Null sources are a source of their own; documents without words have no size and are left out.  Reruns agree.
    """
    return take_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded_sha256: token ids, and the digest of the bytes that they decode to.

    One row for each row of docs, repeated ones too; null and empty texts have no tokens.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_texts(docs, ranks, public_tokenizers.PATTERN, keep=["lang", "source"])
    decoded = decode_ids(encoded, ranks)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("source_mix", mix),
    ("byte_bpe", encode),
]

#: The classifier and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
