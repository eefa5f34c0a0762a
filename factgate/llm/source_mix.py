"""Mixing sources to target weights with a low-discrepancy schedule, with DataFrame functions only.

Each source's documents are laid end to end in hashed order and cut into blocks of equally many words.  Slot i of the
mix takes the point i * golden ratio mod 1, which the cumulative targets map to a source; the r-th slot of a source
gets the r-th block of that source's stream, and the stream starts over when it ends.  Blocks of a source beyond the
slots that the points give it follow behind all slots, so every source fills its target to the word.  Ranks and running sums are made
in two levels (chunk totals, then within the chunk), so no window holds more than about the square root of a source's
rows, and all joins are on fine keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, packed, prepare, whole

#: Weights by position in the sources' order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, and the most of a source, as multiples of the words there are.
SHARE, CAP = 1.5, 2.0
#: A block has 1024 words, or fewer where the mix would have fewer than 65536 blocks.
BLOCK_WORDS, LEAST_SLOTS = 1024, 65536
#: 2**31 / golden ratio, rounded to an odd number: i * GOLDEN mod SPAN is a Weyl sequence.
GOLDEN, SPAN, CELLS = 1327217885, 1 << 31, 1024
#: Slots beyond share / block, so that few blocks of sources which the points serve late come behind all slots.
SPARE = 1.05


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, no, weight, target) from (source, source_size): one row per source in and out.

    Sources are ordered by code point, null last.  Targets are weight * level, but at most cap * source_size, with the
    level at which they add up to share * all sizes; that is where resharing the excess by weight ends.
    """
    no = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1  # one row per source, no documents
    t = totals.select("source", "source_size", no.alias("no")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("no", F.lit(len(weights))) + 1))
    t = t.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
    everything, before = Window.orderBy("ratio", "no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("ratio", "no").rowsBetween(Window.unboundedPreceding, -1)
    free_words = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.lit(cap) * F.sum("source_size").over(before), F.lit(0.0))
    free_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("level", free_words / free_weight)
    # The first source in order of ratio that its level does not fill sets the level of all that follow.
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "no", "level"))).over(everything)["level"]
    target = F.least(F.lit(cap) * F.col("source_size"), F.coalesce(level, F.lit(math.inf)) * F.col("weight"))
    return t.select("source", "source_size", "no", "weight", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target"))


def schedule(goals: DataFrame, slots: int, block: int) -> DataFrame:
    """(no, rank, slot): which source each slot serves, and the how-manieth slot of that source it is, from 0.

    A source's ranks are those of the blocks of its target.  Ranks that no point serves get slots from `slots` on.
    """
    spark = goals.sparkSession
    upto = F.sum("target").over(Window.orderBy("no"))
    all_of = F.sum("target").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    spans = goals.select("no", "target", F.floor((upto - F.col("target")) / all_of * SPAN).alias("lo"), F.floor(upto / all_of * SPAN).alias("hi")).where("hi > lo")
    width = SPAN // CELLS
    spans = spans.select("no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    chunk = max(1, math.isqrt(slots))
    point = (F.pmod("id", F.lit(SPAN)) * F.lit(GOLDEN)) % SPAN
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"), F.floor(F.col("id") / chunk).alias("chunk"), F.floor(point / width).alias("cell"))
    served = points.join(spans, "cell").where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).select("no", "slot", "chunk")
    per_chunk = served.groupBy("no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.select("no", "chunk", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("done"))
    within = F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1
    ranked = served.withColumn("within", within).join(per_chunk.drop("n"), ["no", "chunk"]).select("no", (F.col("done") + F.col("within")).alias("rank"), "slot")
    need = goals.select("no", F.ceil(F.floor("target") / block).alias("need"))
    lacking = need.join(per_chunk.groupBy("no").agg(F.max(F.col("done") + F.col("n")).alias("given")), "no", "left")
    lacking = lacking.select("no", "need", F.coalesce("given", F.lit(0)).alias("given")).where("need > given")
    behind = F.coalesce(F.sum(F.col("need") - F.col("given")).over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    late = lacking.withColumn("behind", behind).select("no", "given", "behind", F.explode(F.sequence(F.col("given"), F.col("need") - 1)).alias("rank"))
    late = late.select("no", "rank", (F.lit(slots) + F.col("behind") + F.col("rank") - F.col("given")).alias("slot"))
    return ranked.join(need, "no").where("rank < need").select("no", "rank", "slot").unionByName(late)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken; see _mixed.

    size counts the words of the whole text (null: 0); taken counts the words that the mix takes of the document, once
    for each time they are taken, and is at most cap * size.  A source takes its target, rounded down
    to whole words.  Sources and ids may be null; rows with null source form one source.  Order, and so
    the result, depends on ids and texts only: rows that repeat both are interchangeable, and each counts.  Only the
    named columns are read.  An empty table, or one without words, takes nothing.
    """
    mixed = _mixed(docs, id_col, source_col, text_col, weights, share, cap, block_words)
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _key(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat_ws(" ", F.col(id_col).cast("string"), whole(text_col)))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: (slot, source, id, first, words), one row for each stretch of a document that a slot takes.

    Slots in order, and within a slot its rows by `at`, are the mix; first is the place of the stretch's first word in its
    document, from 0.  Every slot but a source's last holds one block of words of one source.  Options are those of
    mix_sources.
    """
    placed, pieces = _placed(docs, id_col, source_col, text_col, **options)
    return pieces.join(placed.select("uid", "id", "source"), "uid").select("slot", "source", F.col("id").alias(id_col), "at", "first", "words")


def _mixed(docs: DataFrame, id_col: str, source_col: str, text_col: str, *args, **options) -> DataFrame:
    """(id, key, size, source_size, target, taken) of every row; key stands for the row's id and text."""
    placed, pieces = _placed(docs, id_col, source_col, text_col, *args, **options)
    taken = pieces.groupBy("uid").agg(F.sum("words").alias("taken"))
    return placed.join(taken, "uid", "left").select("id", "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _placed(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Every row's place in its source's stream, and the stretches (uid, slot, at, first, words) that slots take of them."""
    prepare(docs.sparkSession)
    size = F.regexp_count(whole(text_col), F.lit(WORD)).cast("long")
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), _key(id_col, text_col).alias("key"), F.monotonically_increasing_id().alias("uid")
    ).checkpoint()  # some 70 bytes a row: the texts are scanned once
    rows, words = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, min(block_words, int(share * words) // LEAST_SLOTS))
    slots = math.ceil(SPARE * share * words / block)
    buckets = max(1, math.isqrt(rows))
    base = base.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)))

    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap).checkpoint()  # a row per source, read in five places
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    offsets = offsets.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "offset", "source_size", "no", "target")

    before = Window.partitionBy("source", "bucket").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        base.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
        .select("id", "source", "key", "uid", "size", "source_size", "no", "target", (F.col("offset") + F.col("before")).alias("at"))
    )
    # The stream of a source is its documents over and over; its first `target` words can be taken.
    rounds = F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1))
    start = F.col("at") + F.col("round") * F.col("source_size")
    runs = (
        placed.where("size > 0")
        .select("uid", "no", "at", "size", "source_size", F.floor("target").alias("most"), F.explode(rounds).alias("round"))
        .select("uid", "no", start.alias("start"), start.alias("lo"), F.least(start + F.col("size"), F.col("most")).alias("hi"))
        .where("hi > lo")
        .select("uid", "no", "start", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("rank"))
    )
    begins = F.greatest("lo", F.col("rank") * block)
    stretch = [begins.alias("at"), (begins - F.col("start")).alias("first"), (F.least("hi", (F.col("rank") + 1) * block) - begins).alias("words")]
    return placed, runs.join(schedule(goals, slots, block), ["no", "rank"]).select("uid", "slot", *stretch)


def take_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix made of whole documents: each row of docs as often as its taken words, rounded to whole takes, say (0 to ceil(cap) times), with all its columns."""
    taken = _mixed(docs, id_col, source_col, text_col, **options).groupBy("id", "key").agg(F.round(F.avg("taken") / F.greatest(F.max("size"), F.lit(1))).cast("int").alias("takes"))
    taken = taken.where("takes > 0").select(F.col("id").alias("k_id"), F.col("key").alias("k_key"), "takes")
    rows = packed(docs, id=F.col(id_col), key=_key(id_col, text_col))
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("k_key"))
    return rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("takes")))).select("row.*")
