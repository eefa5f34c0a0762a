"""Audit of how filters interact: what each removes at each place of every order of applying them.

Documents that fail the same filters behave alike, so they are counted by part and set of failed filters, with map-side
partial sums.  The masks of a part (0 where a filter fails, infinite elsewhere) and the positions that the inverse of each
order gives to the filters are combined as a min-plus product: the least position of a failed filter is the step at which
the order removes the documents.  Weighted scatter counts by that step give all figures.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, prepare, stored, whole

AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

#: At most 7 filters: their orders number 5040.
MOST_FILTERS = 7


def text_filters(text: Column | str = "text") -> dict[str, Column]:
    """The conditions under which a text fails; null counts as empty."""
    t = whole(text)
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.length(t) * 3,
        "D": t.rlike(r"[#$%&*|]"),
    }


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """rows (id, …) with good and toxic, whether any label of the id says 1; ids are not null."""
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(said, "id", "left").fillna(False, ["good", "toxic"])


def failures(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], copies: str | None = "E", part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail (bit i: the i-th; copies last), and how many are labelled good and toxic.

    A document fails `copies` where a smaller id has an identical text, in whatever part; rows that repeat the smallest id
    do not, nor do null ids, which are smaller than none.  Copies of a text are summed before they are shuffled, so that
    a group of any size meets as one row for each part and label.
    """
    prepare(docs.sparkSession)
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    mask = F.lit(0)
    for bit in bits:
        mask = mask + bit
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(whole(text_col), 256)).alias("digest"), part.alias("part"), mask.alias("mask")))
    kept = ["digest", "part", "mask", "good", "toxic"]
    # Rows of an id are together after the join, so counting them needs no further shuffle.
    each = _labelled(rows.where("id IS NOT NULL"), labels, id_col).groupBy("id", *kept).agg(F.count(F.lit(1)).alias("c"))
    alike = each.groupBy(*kept).agg(F.min("id").alias("first"), F.min_by("c", "id").alias("at_first"), F.sum("c").alias("c"))
    if copies is not None:
        originals = F.when(F.col("first") == F.min("first").over(Window.partitionBy("digest")), F.col("at_first")).otherwise(0)
        split = alike.withColumn("o", originals).select(*kept, F.explode(F.array(F.struct(F.lit(0).alias("bit"), F.col("o").alias("c")), F.struct(F.lit(1 << len(bits)).alias("bit"), (F.col("c") - F.col("o")).alias("c")))).alias("x"))
        alike = split.select("part", (F.col("mask") + F.col("x.bit")).alias("mask"), "good", "toxic", F.col("x.c").alias("c"))
    nameless = rows.where("id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("c"))
    n = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    return alike.select("part", "mask", "good", "toxic", "c").unionByName(nameless).groupBy("part", "mask").agg(F.sum("c").alias("n"), n(F.col("good")).alias("good"), n(F.col("toxic")).alias("toxic"))


def removal_steps(fails: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """steps[m, p]: the step at which order p removes mask m, or the number of filters where none does.

    fails[m, f]: whether mask m fails filter f; positions[p, f]: where order p has filter f.
    """
    cost = np.where(fails, 0.0, np.inf)
    steps = np.full((len(fails), len(positions)), np.inf)
    for f in range(fails.shape[1]):  # min-plus product, one filter at a time
        np.minimum(steps, cost[:, f, None] + positions[None, :, f], out=steps)
    return np.where(np.isfinite(steps), steps, fails.shape[1]).astype(np.int64)


def audit_part(part: str, masks: np.ndarray, weights: np.ndarray, names: Sequence[str]) -> pd.DataFrame:
    """The audit of one part: masks of failed filters and weights[m] = (documents, good, toxic)."""
    k = len(names)
    orders = np.array(list(permutations(range(k))))
    positions = np.argsort(orders, axis=1)  # the inverse permutations
    fails = (masks[:, None] >> np.arange(k)) & 1 == 1
    steps = removal_steps(fails, positions)
    taken = np.zeros((len(orders), k + 1, 3), np.int64)  # by order and step; the last one holds what stays
    at = np.arange(len(orders))
    for m in range(len(masks)):
        np.add.at(taken, (at, steps[m]), weights[m])
    taken = taken[:, :k]
    n = weights[:, 0]
    # Of the documents that fail the filter of a step, those that an earlier step has removed.
    failing = np.take_along_axis(np.broadcast_to((fails * n[:, None]).sum(0), (len(orders), k)), orders, axis=1)
    unique = np.array([n[masks == 1 << f].sum() for f in range(k)])
    shapley = np.zeros(k, np.int64)
    np.add.at(shapley, orders, taken[:, :, 0])
    removed = taken[:, :, 0]
    return pd.DataFrame(
        {
            "part": part,
            "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], k),
            "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
            "kept": (n.sum() - removed.cumsum(axis=1)).ravel(),
            "removed": removed.ravel(),
            "redundant": (failing - removed).ravel(),
            "unique_fails": unique[orders].ravel(),
            "good_lost": taken[:, :, 1].ravel(),
            "toxic_lost": taken[:, :, 2].ravel(),
            "shapley": shapley[orders].ravel(),
        }
    )


def audit(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of the named filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    counts is (part, mask, n, good, toxic), at most 2^k rows a part for k filters (7 at most).  Each part gives its k! * k
    rows, zeros included; an empty table gives none.
    """
    names = list(names)
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return audit_part(key[0], rows["mask"].to_numpy(), rows[["n", "good", "toxic"]].to_numpy(np.int64), names)

    return counts.groupBy("part").applyInPandas(one, AUDIT)
