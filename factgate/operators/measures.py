"""Text measurement, style scores, and scores of labelled sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.shared import materialized


def pick(sorted_values: Column, p: float) -> Column:
    """The element at int(p * (n - 1)): a percentile by index, not interpolated."""
    return F.element_at(sorted_values, (F.floor(F.lit(p) * (F.size(sorted_values) - 1)) + 1).cast("int"))


def measure_text(docs: DataFrame, key: str) -> DataFrame:
    """Per key: sentences, words, mean / 10th / 90th percentile of words in a sentence, and rates of questions, exclamations and second person.

    Percentiles come from a histogram of sentence lengths, so no key's sentences meet in one array.
    """
    s = docs.select(key, F.explode(T.split_sentences(F.col("text"))).alias("s"))
    s = s.select(key, T.word_count(F.col("s")).alias("w"), F.col("s").endswith("?").alias("q"), F.col("s").endswith("!").alias("x"), F.col("s").rlike(r"(?i)\b(you|your|yours)\b").alias("you"))
    per_length = s.groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q"), F.count_if("x").alias("x"), F.count_if("you").alias("you"))
    whole = Window.partitionBy(key)
    run = whole.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    per_length = per_length.select("*", F.sum("n").over(run).alias("upto"), F.sum("n").over(whole).alias("total"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1)), F.col("w")))
    rate = lambda c: F.sum(c) / F.sum("n")
    return per_length.groupBy(key).agg(
        F.sum("n").alias("sentences"), F.sum(F.col("w") * F.col("n")).alias("words"), (F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("mean_words"), at(0.1).alias("p10"), at(0.9).alias("p90"),
        rate("q").alias("question_rate"), rate("x").alias("exclaim_rate"), rate("you").alias("second_person_rate"),
    )


def most_common(rows: DataFrame, by: Sequence[str], value: str, first_pos: str, k: int, least: int = 1) -> DataFrame:
    """(by, value, n, rank) of the k most frequent values per group; ties go to the value seen first."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(first_pos).alias("__first")).where(F.col("n") >= least)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "__first", value))).where(F.col("rank") <= k).drop("__first")


def phrases(rows: DataFrame, by: Sequence[str], words: str, id_col: str, ns: Sequence[int] = (3, 4), least: int = 3, k: int = 15, edge: Sequence[str] = ("the", "a", "and", "to", "of")) -> DataFrame:
    """The k most frequent n-grams of word arrays per group that neither start nor end on an edge word."""
    w = F.col(words)

    def grams(n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))

    g = rows.select(*by, id_col, F.explode(F.concat(*map(grams, ns))).alias("g"))
    g = g.where(~F.element_at("g", 1).isin(*edge) & ~F.element_at("g", -1).isin(*edge)).select(*by, id_col, F.array_join("g", " ").alias("phrase"))
    return most_common(g, by, "phrase", id_col, k, least)


def _by_score(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    return samples.groupBy(*by, "score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum(1 - F.col("label").cast("long")).alias("n"))


def auc(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve of (score, label 0/1), ties counting half; null without both classes.

    From one row per distinct score and running sums.
    """
    s = _by_score(samples, by)
    below = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    pos, neg = F.sum("p"), F.sum("n")
    return s.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), wins / (pos * neg)).alias("auc"), pos.alias("n_pos"), neg.alias("n_neg"))


def youden_threshold(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(j, threshold): the cut with the largest true minus false positive rate, the lowest such; halfway to the next lower score."""
    s = _by_score(samples, by)
    w = Window.partitionBy(*by).orderBy("score")
    up, every = w.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*by)
    j = F.sum("p").over(up) / F.greatest(F.sum("p").over(every), F.lit(1)) - F.sum("n").over(up) / F.greatest(F.sum("n").over(every), F.lit(1))
    s = s.select(*by, "score", F.round(j, 12).alias("j"), F.lag("score").over(w).alias("lower"))
    best = F.max_by(F.struct("score", "j", "lower"), F.struct("j", -F.col("score"))).alias("b")
    return s.groupBy(*by).agg(best).select(*by, "b.j", ((F.col("b.score") + F.coalesce("b.lower", "b.score")) / 2).alias("threshold"))


def gate_score(outcomes: DataFrame) -> DataFrame:
    """One row from (label, blocked): catch rate of bad labels, false-block rate of those that should pass, detection of untagged ones."""
    rate = lambda cond: F.avg(F.when(cond, F.col("blocked").cast("int")))
    bad = F.col("label").isin("false", "overstated", "partial", "not-citable", "combined-conclusion")
    return outcomes.agg(rate(bad).alias("catch_rate"), rate(F.col("label").isin("true", "positioning")).alias("false_block_rate"), rate(F.col("label") == "untagged").alias("untagged_rate"), F.count(F.lit(1)).alias("n"))


#: Rates that a release needs; fixed values.
TARGETS = {"catch_rate": (">=", 0.95), "false_block_rate": ("<=", 0.10), "untagged_rate": (">=", 0.95)}
SHOULD_PASS = ("true", "positioning")


def gate_targets(score: DataFrame) -> DataFrame:
    """(metric, value, target, passed) of the one row of gate_score; a rate without samples does not pass."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("target"), F.coalesce((F.col(m) >= t) if op == ">=" else (F.col(m) <= t), F.lit(False)).alias("passed")) for m, (op, t) in TARGETS.items()))
    return score.select(F.explode(rows).alias("r")).select("r.*")


def gate_labels(outcomes: DataFrame) -> DataFrame:
    """(label, n, blocked, misses) per label of (label, blocked): a miss is a sentence that should pass and does not, or the reverse."""
    miss = F.col("label").isin(*SHOULD_PASS) == F.col("blocked")
    return outcomes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked"), F.count_if(miss).alias("misses"))


def greedy_chunks(paragraphs: DataFrame, target: int = 180, tail: int = 90) -> DataFrame:
    """(doc_id, chunk, words, text) packing each document's paragraphs (doc_id, pos, text) until `target` words; a shorter last chunk stays if it has `tail` words or is the only one.

    A running sum with reset: where the chunk that begins at a paragraph ends depends on that paragraph alone, so each one
    points to the begin of the next chunk, and the begins are those that the first one reaches.  Pointers are doubled: after
    k rounds the begins of the first 2^k chunks are known, and a document of any length is never one row.
    """
    words = T.word_count(F.col("text")).cast("long")
    by = Window.partitionBy("doc_id").orderBy("pos")
    p = paragraphs.select("doc_id", "pos", "text", words.alias("w"), F.row_number().over(by).cast("long").alias("i"))
    p = materialized(p.withColumn("sum", F.sum("w").over(by)))
    # The end of a chunk is the first paragraph at which the sum has grown by `target` since before the begin.
    ends = p.select("doc_id", F.col("sum").alias("at"), F.col("i").alias("end"))
    wanted = p.select("doc_id", (F.col("sum") - F.col("w") + target).alias("at"), F.col("i").alias("begin"))
    both = wanted.withColumn("end", F.lit(None).cast("long")).unionByName(ends.withColumn("begin", F.lit(None).cast("long")))
    later = Window.partitionBy("doc_id").orderBy(F.desc("at"), F.col("begin").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = p.groupBy("doc_id").agg(F.max("i").alias("last"))
    jump = both.withColumn("next", F.min("end").over(later) + 1).where("begin IS NOT NULL").join(last, "doc_id")
    jump = materialized(jump.select("doc_id", "begin", F.when(F.col("next") <= F.col("last"), F.col("next")).alias("next")))
    begins = p.where("i = 1").select("doc_id", F.col("i").alias("begin"))
    while True:
        ahead = materialized(begins.join(jump, ["doc_id", "begin"]).where("next IS NOT NULL").select("doc_id", F.col("next").alias("begin")))
        if ahead.isEmpty():
            break
        begins = begins.unionByName(ahead)
        jump = materialized(jump.join(jump.select("doc_id", F.col("begin").alias("next"), F.col("next").alias("far")), ["doc_id", "next"], "left").select("doc_id", "begin", F.col("far").alias("next")))
    marked = p.join(begins.select("doc_id", F.col("begin").alias("i"), F.lit(1).alias("opens")), ["doc_id", "i"], "left")
    chunk = (F.sum(F.coalesce("opens", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("i")) - 1).cast("int")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    chunks = marked.withColumn("chunk", chunk).groupBy("doc_id", "chunk").agg(F.sum("w").cast("int").alias("words"), F.array_join(F.filter(texts, lambda t: t != ""), "\n\n").alias("text"))
    return chunks.where((F.col("words") >= tail) | (F.col("words") >= target) | ((F.col("chunk") == 0) & (F.col("words") > 0)))
