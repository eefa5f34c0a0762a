"""Exact deduplication with a heavy-hitter split.

A Misra-Gries sketch over text digests finds the few digests that can be frequent.  Their exact winners are counted
with map-side partial aggregation, checked, and broadcast, so rows of hot groups never meet in one task.  All other
digests take the ordinary shuffle, where no group can exceed rows / (counters + 1).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed, prepare, whole

#: Counters of the sketch, and so the most rows that are ever broadcast (about 100 bytes each).
COUNTERS = 2048


def _shrink(counts: Counter, counters: int) -> Counter:
    """Misra-Gries reduction to at most `counters` entries: subtract the next largest count from all."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def sketch(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, low) of every digest that can have more than rows / (counters + 1) rows; at most `counters` rows."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            seen = pc.value_counts(b.column(0))
            held.update(dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist())))
            held = _shrink(held, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "low"])

    merged = digests.select("digest").mapInArrow(per_task, "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    top = merged.orderBy(F.desc("low"), "digest").limit(counters + 1).collect()  # bounded by the number of counters
    cut = top[counters]["low"] if len(top) > counters else 0
    rows = [(bytes(r["digest"]), r["low"] - cut) for r in top if r["low"] > cut]
    return digests.sparkSession.createDataFrame(rows, "digest binary, low long")


def _flagged(docs: DataFrame, id_col: str, text_col: str, counters: int) -> DataFrame:
    """(id, uid, digest, size, best) of every row; best is the (id, uid) of the row that stays."""
    spark = prepare(docs.sparkSession)
    text = whole(text_col)
    # One scan of the texts; what later steps read is some 60 bytes a row in the shared folder.
    proof = F.struct(F.length(text).alias("n"), F.xxhash64(text).alias("x"))
    base = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), proof.alias("proof"), F.monotonically_increasing_id().alias("uid")).checkpoint()
    best = F.max(F.struct("id", "uid"))  # nulls order first, so they lose
    grouped = (
        base.join(F.broadcast(sketch(base, counters).select("digest")), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("size"), best.alias("best"), F.min("proof").alias("lo"), F.max("proof").alias("hi"))
    )
    # Verified: really frequent, and all of one text as far as length and a second hash can tell.
    real = (F.col("size") * (counters + 1) > base.count()) & (F.col("lo") == F.col("hi"))
    rows = grouped.where(real).select("digest", "size", "best").collect()  # at most `counters` rows
    winners = F.broadcast(spark.createDataFrame([(bytes(r["digest"]), r["size"], tuple(r["best"])) for r in rows], grouped.select("digest", "size", "best").schema))
    hot = base.join(winners, "digest")
    group = Window.partitionBy("digest")
    cold = base.join(winners.select("digest"), "digest", "left_anti").withColumns({"size": F.count(F.lit(1)).over(group), "best": best.over(group)})
    return hot.unionByName(cold).select("id", "uid", "digest", F.col("size").cast("long").alias("size"), "best")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their whole texts are identical; a null text counts as empty, so null and empty texts form one
    group.  Of a group the row with the largest id stays; null ids rank lowest (keep_id is null where a group has no
    other).  Of rows that repeat both id and text exactly one has kept = true.  Only the two named columns are read, so
    other columns never clash.  An empty table gives an empty result.
    """
    return _flagged(docs, id_col, text_col, counters).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Where rows repeat the winner's id and text, one of them is left: the first by the JSON of the whole row.
    """
    flags = _flagged(docs, id_col, text_col, counters).where(F.col("id").eqNullSafe(F.col("best.id")))
    keys = flags.groupBy(F.col("id").alias("k_id"), F.col("digest").alias("k_digest")).agg((F.count(F.lit(1)) > 1).alias("tied"))
    rows = packed(docs, id=F.col(id_col), digest=F.unhex(F.sha2(whole(text_col), 256)))
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("digest") == F.col("k_digest"))
    if keys.where("tied").isEmpty():
        return rows.join(keys, same, "left_semi").select("row.*")
    tied = rows.join(keys.where("tied"), same).groupBy("k_id", "k_digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return rows.join(keys.where("NOT tied"), same, "left_semi").select("row.*").unionByName(tied)
