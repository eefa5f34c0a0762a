"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are the shapes of its text (bigrams and trigrams of character classes, runs collapsed) and how often
words repeat.  Latent-semantic vectors come from an SVD of the tf-idf matrix of a bounded sample of labelled documents;
those vectors are broadcast with their labels, every document gets exact cosines to all of them in blocks of matrix
products, and the nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _slices
from .common import hold, prepare, whole

#: Labelled documents of each class that are used at most, terms, latent dimensions, neighbours, and power of the similarity.
PER_CLASS, TERMS, LATENT, NEIGHBOURS, POWER = 2000, 1024, 48, 15, 8
BLOCK = 256


def _classes() -> np.ndarray:
    """Byte -> class: lower, upper, digit, space, line end, other control, beyond ASCII, and each punctuation mark its own."""
    of = np.full(256, 6, np.int64)
    of[:32] = 5
    of[[9, 11, 12, 13, 32]] = 3
    of[10] = 4
    next_class = 7
    for b in range(33, 127):
        c = chr(b)
        if c.islower() or c.isupper() or c.isdigit():
            of[b] = 0 if c.islower() else 1 if c.isupper() else 2
        else:
            of[b], next_class = next_class, next_class + 1
    return of


CLASSES = _classes()


def term_counts(text: str) -> np.ndarray:
    """Root frequencies of the terms; all zero for an empty text."""
    out = np.zeros(TERMS, np.float32)
    data = text.encode()
    if not data:
        return out
    c = CLASSES[np.frombuffer(data, np.uint8)]
    c = c[np.concatenate([[True], c[1:] != c[:-1]])]
    two, three = c[:-1] * 64 + c[1:], (c[:-2] * 64 + c[1:-1]) * 64 + c[2:] + 4096
    grams = np.concatenate([two, three])
    if len(grams):
        out[: TERMS - 2] = np.bincount(grams * 2654435761 % (1 << 32) % (TERMS - 2), minlength=TERMS - 2) / len(grams)
    words = data.split()
    if words:
        out[TERMS - 2] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[TERMS - 1] = 1 - len(set(words)) / len(words) if len(words) > 20 else 0
    return np.sqrt(out)


class Voters(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def project(counts: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    x = (counts * idf) @ axes
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


def fit(counts: np.ndarray, labels: np.ndarray, latent: int = LATENT) -> Voters:
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    values, axes = np.linalg.eigh(((counts * idf).T @ (counts * idf)).astype(np.float64))
    axes = axes[:, np.argsort(-values)[:latent]].astype(np.float32)  # right singular vectors of the tf-idf matrix
    return Voters(idf, axes, project(counts, idf, axes), labels.astype(np.float32))


def vote(v: Voters, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest voters; 0.5 where nothing is similar.

    Cosines are rounded to 5 digits, so that they do not depend on the block; of equally near voters the first ones vote.
    """
    cosines = np.round(np.maximum(0, project(counts, v.idf, v.axes) @ v.vectors.T), 5)
    k = min(k, cosines.shape[1])
    least = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, -k, None]
    above, level = cosines > least, cosines == least
    near = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
    weight = np.where(near, cosines, 0) ** POWER
    total = weight.sum(1)
    return np.where(total > 0, (weight * v.labels).sum(1) / np.maximum(total, 1e-30), 0.5)


def _counts_of(rows: DataFrame, more: str) -> DataFrame:
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality_knn", lambda: None)
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([term_counts(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["label", "counts"])

    return rows.mapInArrow(per_task, f"{more}, counts binary")


def _voters_of(made: DataFrame, per_class: int) -> list[tuple[int, bytes]]:
    """(label, counts) in order, of each class the first per_class by counts: picked on the executors, and sent to the driver in some tenth of their size."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(x) for x in b.column(1).to_pylist()], pa.binary())], ["label", "counts"])

    picked = [made.where(F.col("label") == x).orderBy("counts").limit(per_class) for x in (0, 1)]
    sent = picked[0].unionByName(picked[1]).mapInArrow(per_task, "label int, counts binary").collect()  # at most 2 * per_class rows
    return sorted((r["label"], zlib.decompress(r["counts"])) for r in sent)


def train(docs: DataFrame, labels: DataFrame, label_col: str, use: Column, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Voters | None:
    """Voters from at most per_class different labelled documents of each class, of the first ids by hash; None without any.

    Null labels and ids are left out.  Where ids repeat, all their documents count, up to per_class by their terms.
    """
    prepare(docs.sparkSession)
    known = labels.where(use & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("label"))
    picked = [known.where(F.col("label") == x).orderBy(F.xxhash64("id"), "id").limit(per_class) for x in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows of an id and a label
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).join(sample, "id").select("label", "text")
    made = _counts_of(rows, "label int").distinct().checkpoint()  # ids that repeat may bring more rows than the sample has
    got = _voters_of(made, per_class)
    if not got:
        return None
    counts = np.frombuffer(b"".join(x for _, x in got), np.float32).reshape(len(got), TERMS)
    return fit(counts, np.array([label for label, _ in got]))


def score_quality(docs: DataFrame, voters: Voters | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """(id, *keep, score) of every row's whole text; keep names further columns to carry along, score_col the score's.

    Scores lie in 0..1, higher where label 1 is likelier; equal texts have equal scores, repeated rows and ids stay as they
    are.  Texts of any length are read whole.  Null and empty texts resemble nothing and score 0.5, as does every text when
    there are no labelled documents; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate([id_col, *(keep or [])])]
    rows = docs.select(whole(text_col).alias("text"), *carried)
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate([id_col, *(keep or [])])]
    if voters is None:
        return rows.select(*names, F.lit(0.5).alias(score_col))
    shared = spark.sparkContext.broadcast(voters)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality_knn", lambda: None)
        for b in _slices(batches):
            scores = []
            for at in range(0, b.num_rows, BLOCK):
                scores.append(vote(shared.value, np.array([term_counts(t) for t in b.column(0).slice(at, BLOCK).to_pylist()])))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(scores).astype(np.float64))], [*b.schema.names[1:], "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(per_task, f"{kinds}, score double").select(*names, F.least(F.lit(1.0), "score").alias(score_col))
