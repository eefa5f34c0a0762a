"""Exact top-k inner products through a pivot-distance index.

One more component, sqrt(M^2 - |x|^2) with M the largest norm, makes all vectors equally long, so that the largest inner
products are the smallest distances.  Every vector is keyed by its nearest pivot and its distance to it; a pivot's
distances are cut into annuli of about equally many rows, and an annulus of too many equal distances is split further.
A query first visits the annuli around its own distance to its nearest pivot.  Its k-th best score there gives a radius,
and by the triangle inequality only annuli that |d(query, pivot) - radius| reaches can hold anything better; those are
visited in a second round, and no others need be.  Queries of one nearest pivot form blocks, which meet the annuli that
any of them visits as matrix products; a vector is copied only to blocks that visit its annulus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare

#: Pivots, the vectors that they are fitted on, distance bins of a pivot, rows of a cell and queries of a block.
PIVOTS, FIT_ROWS, BINS, CELL_ROWS, BLOCK_QUERIES = 64, 4096, 1024, 512, 2048
#: Distances between queries and annuli that are held at once.
HELD_GAPS = 1 << 21


def usable(v: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as float64; shorter vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out, ends = np.zeros((len(column), width)), column.offsets.to_numpy()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(ends)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Centres of a few rounds of k-means from evenly spread rows; any points serve, good ones make thin annuli."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(rounds):
        near = ((sample**2).sum(1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(1)).argmin(1)
        centres = np.array([sample[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return np.unique(centres, axis=0)


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float | None = 256, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """(query_id, rank, id, score): for every row where `queries` holds, the k other rows with the largest inner product.

    With a scale, components become floor(scale * x) and scores are exact integers.  Ties go to the smaller id, null ids
    first.  Vectors that are null or hold null, NaN or infinite components take no part; shorter vectors count as filled
    with zeros.  A row is never its own neighbour, but other rows with its id or vector are.  Each query row has its own
    ranks, also where ids repeat.  Fewer rows than k give all there are; an empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    v = F.col(vector_col)
    part = (lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")) if scale else (lambda x: x.cast("double"))
    base = vectors.where(usable(v)).select(F.col(id_col).alias("id"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.transform(v, part).alias("v"), F.monotonically_increasing_id().alias("uid")).checkpoint()
    kind = base.schema["id"].dataType.simpleString()
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    width, most2 = base.agg(F.max(F.size("v")), F.max(norm2)).first()
    out = f"quid long, query_id {kind}, id {kind}, score double"
    final = [F.col("query_id"), F.col("rank"), F.col("id").alias(id_col), (F.col("score").cast("long") if scale else F.col("score")).alias("score")]
    if not width:
        return spark.createDataFrame([], out + ", rank int").select(*final)

    # Integers up to 2^24 are exact in single precision too, and half as long to shuffle.
    narrow = "float" if scale and most2 < 2.0**48 else "double"

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, most2 - (x**2).sum(1)))[:, None]])

    fitted = base.orderBy(F.xxhash64("uid"), "uid").limit(FIT_ROWS).select("v").toArrow()  # bounded sample, for the pivots alone
    centres = _pivots(lifted(_matrix(fitted.column(0), width)), pivots)
    reach = 2 * float(np.sqrt(most2)) + 1e-9  # no distance between lifted vectors is larger
    bin_width = reach / BINS

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = lifted(_matrix(b.column(2), width))
            d2 = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
            near = d2.argmin(1)
            far = np.sqrt(np.maximum(0, d2[np.arange(len(near)), near]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.list_(pa.float32() if narrow == "float" else pa.float64())), b.column(3), pa.array(near, pa.int32()), pa.array(np.minimum(BINS - 1, far // bin_width), pa.int32())], ["id", "is_query", "v", "uid", "pivot", "bin"])

    index = base.mapInArrow(keyed, f"id {kind}, is_query boolean, v array<{narrow}>, uid long, pivot int, bin int").checkpoint()
    # Bins of a pivot are joined to annuli of about cell_rows rows: at most pivots * BINS rows here.
    upto = F.sum("n").over(Window.partitionBy("pivot").orderBy("bin"))
    bins = index.groupBy("pivot", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("ring", F.floor((upto - F.col("n")) / cell_rows))
    rings = bins.groupBy("pivot", "ring").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("n").alias("n")).withColumn("parts", F.ceil(F.col("n") / cell_rows).cast("int"))
    bins, rings = bins.select("pivot", "bin", "ring").checkpoint(), rings.checkpoint()
    cells = index.join(F.broadcast(bins), ["pivot", "bin"]).join(F.broadcast(rings.select("pivot", "ring", "parts")), ["pivot", "ring"])
    cells = cells.select("id", "uid", "v", "pivot", "ring", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part"))
    # Blocks of queries: those of a pivot together, several small pivots in one, a large one dealt by hash.
    number, blocks, room = F.lit(0), 0, 0
    for r in index.where("is_query").groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).orderBy("pivot").collect():
        if r["n"] > room:
            blocks, room = blocks + max(1, r["n"] // block_queries), block_queries
        parts = max(1, r["n"] // block_queries)
        number = F.when(F.col("pivot") == r["pivot"], blocks - 1 - F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")).otherwise(number)
        room = 0 if parts > 1 else room - r["n"]
    asked = index.where("is_query").select(F.col("id").alias("query_id"), F.col("uid").alias("quid"), "v", number.alias("block"))
    ring_rows = [(r["pivot"], r["ring"], r["lo"] * bin_width, (r["hi"] + 1) * bin_width, r["n"]) for r in rings.orderBy("pivot", "lo").collect()]  # bounded by pivots * BINS
    r_pivot, r_ring = np.array([r[0] for r in ring_rows], np.int32), np.array([r[1] for r in ring_rows], np.int64)
    r_lo, r_hi, r_n = (np.array([r[i] for r in ring_rows], np.float64) for i in (2, 3, 4))

    def visits(first: bool):
        """Which annuli each query visits: the nearest ones that hold over k rows, or all others within its radius."""

        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, HELD_GAPS // max(1, len(r_n)))
            for b in (x.slice(at, step) for x in batches for at in range(0, x.num_rows, step)):
                q = _matrix(b.column(2), width)
                q2 = (q**2).sum(1)
                d = np.sqrt(np.maximum(0, q2[:, None] - 2 * np.hstack([q, np.zeros((len(q), 1))]) @ centres.T + (centres**2).sum(1)))[:, r_pivot]
                gap = np.maximum(0, np.maximum(r_lo - d, d - r_hi))  # no row of the annulus is nearer than this
                order = np.lexsort((np.abs((r_lo + r_hi) / 2 - d), gap), axis=1)
                held = np.cumsum(r_n[order], axis=1)
                early = np.zeros_like(gap, bool)
                np.put_along_axis(early, order, held - r_n[order] <= k, axis=1)
                if first:
                    rows, rings_ = np.nonzero(early)
                else:
                    best = b.column(4).to_numpy(zero_copy_only=False).astype(np.float64)  # NaN: fewer than k found
                    bound = (q2 + most2)[:, None] / 2 - gap**2 / 2 + 1e-6 * (1 + most2)
                    rows, rings_ = np.nonzero(~early & ~(bound < best[:, None]))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(4)), pa.array(r_pivot[rings_]), pa.array(r_ring[rings_])], ["query_id", "quid", "v", "block", "pivot", "ring"])

        return per_task

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block of queries against a cell: the k best of the cell for each query."""
        ids = right.column("id")
        right = right.take(pc.sort_indices(ids, null_placement="at_start"))  # so that ties fall to the smaller id
        m = right.num_rows
        scores = _matrix(left.column("v"), width) @ _matrix(right.column("v"), width).T if m else np.zeros((left.num_rows, 0))
        quid, uid = left.column("quid").to_numpy(), right.column("uid").to_numpy()
        if m:
            of = np.argsort(uid)
            own = of[np.minimum(np.searchsorted(uid, quid, sorter=of), m - 1)]
            scores[np.flatnonzero(uid[own] == quid), own[uid[own] == quid]] = -np.inf
        least = np.partition(scores, m - k, axis=1)[:, m - k, None] if m > k else -np.inf
        query, at = np.nonzero((scores >= least) & (scores > -np.inf))
        value = scores[query, at]
        order = np.lexsort((at, -value, query))
        query, at, value = query[order], at[order], value[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        query, at, value = query[rank < k], at[rank < k], value[rank < k]
        return pa.table([left.column("quid").take(query), left.column("query_id").take(query), right.column("id").take(at), pa.array(value)], ["quid", "query_id", "id", "score"])

    keys = ["pivot", "ring", "part", "block"]

    def met(first: bool, known: DataFrame) -> DataFrame:
        """The k best rows of each visited cell for each query of a block that visits it."""
        goes = known.mapInArrow(visits(first), f"query_id {kind}, quid long, v array<{narrow}>, block int, pivot int, ring long")
        goes = goes.join(F.broadcast(rings.select("pivot", "ring", "parts")), ["pivot", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        visited = goes.select(*(F.col(c).alias(f"to_{c}") for c in keys)).distinct()
        rows = cells.join(visited, [F.col(c) == F.col(f"to_{c}") for c in keys[:3]]).select("id", "uid", "v", *keys[:3], F.col("to_block").alias("block"))
        return goes.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(product, out)

    best_of = Window.partitionBy("quid").orderBy(F.desc("score"), "id")
    near = met(True, asked).withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k).checkpoint()
    radius = near.where(F.col("rank") == k).select("quid", F.col("score").alias("kth"))
    rest = met(False, asked.join(radius, "quid", "left").select("query_id", "quid", "v", "block", "kth"))
    both = near.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k)
    return both.select(*final)
