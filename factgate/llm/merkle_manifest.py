"""Merkle manifest of a dataset by lag and lead windows.

Rows are leaves; runs of 16 consecutive nodes have one parent, up to one root per source, and the roots of the sources
are the leaves of a tree of their own.  Nodes are numbered in order.  A window over a stretch of 256 consecutive nodes
looks at fixed offsets before and after each row, masked by the row's slot in its run and by the run's length: these are
the siblings.  The first child's row hashes the parent, so the next level is in the same rows, at offsets 16 times as far,
and needs no shuffle.  A stretch then becomes one row, and the same step is taken again until one node is left.

On the way down the path of a stretch (its siblings at all higher levels) is joined to the rows of the stretch by the key
that they are already dealt by: a leaf is shuffled once, and paths only once per 256 leaves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, stored

#: Children of a node.
FANOUT = 16

#: Levels that one stretch of nodes spans.
LEVELS = 2
STRETCH = FANOUT**LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _no_path() -> Column:
    return F.array().cast("array<struct<before:binary,after:binary>>")


def hash_of(*hex_or_text: Column) -> Column:
    """sha256 of the inputs, concatenated, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*hex_or_text), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_of(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as byte count, colon and value; null as a dash."""
    said = [c.cast("string") for c in fields]
    return hash_of(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (k, …) with pos, from 0 in the order within k, and n, the rows of k; no task sorts more than a range of the rows.

    Two-level: rank within a range of (k, order), plus the rows of the ranges before it.
    """
    dealt = stored(rows.repartitionByRange("k", *order).withColumn("part", F.spark_partition_id()))
    by_part = Window.partitionBy("k").orderBy("part")
    counts = dealt.groupBy("part", "k").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("part", "k", (F.sum("c").over(by_part) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("k")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("part", "k").orderBy(*order)) - 1
    return dealt.withColumn("rank", rank).join(before, ["part", "k"]).withColumn("pos", F.col("rank") + F.col("before")).drop("part", "rank", "before")


def _nodes_at(level: int) -> Column:
    return F.ceil(F.col("n") / FANOUT**level).cast("long")


def _siblings(level: int) -> tuple[Column, Column]:
    """The digests before and after a node in its run, on the row of the node's first leaf in the stretch."""
    step, at = FANOUT**level, Window.partitionBy("k", "stretch").orderBy("pos")
    node = F.floor(F.col("pos") / step)
    slot = node % FANOUT
    run = F.least(F.lit(FANOUT), _nodes_at(level) - (node - slot))
    digest, empty = f"d{level}", F.lit(b"")
    before = [F.when(slot >= j, F.lag(digest, j * step).over(at)).otherwise(empty) for j in range(FANOUT - 1, 0, -1)]
    after = [F.when(slot + j < run, F.lead(digest, j * step).over(at)).otherwise(empty) for j in range(1, FANOUT)]
    return F.concat(*before), F.concat(*after)


def _climbed(nodes: DataFrame) -> DataFrame:
    """nodes (k, pos, n, digest, …) with stretch, the siblings before{l}, after{l} of each level, and top, the digest of the stretch on its first row."""
    out = nodes.withColumn("stretch", F.floor(F.col("pos") / STRETCH)).withColumn("d0", F.col("digest"))
    for level in range(LEVELS):
        before, after = _siblings(level)
        out = out.withColumns({f"before{level}": before, f"after{level}": after})
        digest, first_child = F.col(f"d{level}"), F.col("pos") % FANOUT ** (level + 1) == 0
        parent = F.when(_nodes_at(level) > 1, hash_of(hex_of(F.concat(digest, F.col(f"after{level}"))))).otherwise(digest)
        out = out.withColumn(f"d{level + 1}", F.when(first_child, parent))
    return out.withColumnRenamed(f"d{LEVELS}", "top")


def _above(nodes: DataFrame) -> DataFrame:
    """One node for each stretch."""
    return _climbed(nodes).where(F.col("pos") % STRETCH == 0).select("k", F.col("stretch").alias("pos"), F.ceil(F.col("n") / STRETCH).cast("long").alias("n"), F.col("top").alias("digest"))


def _layers(nodes: DataFrame) -> list[DataFrame]:
    """nodes, and the nodes over them, up to one for each k; all but the first written to the shared folder."""
    layers = [nodes]
    while (layers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        layers.append(stored(_above(layers[-1])))
    return layers


def _below(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes (k, pos, …) with path, their siblings level by level up to the root, and with what paths (k, stretch, path, …) carry."""
    at = Window.partitionBy("k", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows, steps = _climbed(nodes), []
    for level in range(LEVELS):
        own = F.when(F.col("pos") % FANOUT**level == 0, F.struct(F.col(f"before{level}").alias("before"), F.col(f"after{level}").alias("after")))
        rows = rows.withColumn(f"s{level}", F.last(own, ignorenulls=True).over(at) if level else own)
        steps.append(F.when(_nodes_at(level) > 1, F.array(f"s{level}")).otherwise(_no_path()))
    rows = rows.withColumn("steps", F.concat(*steps)).drop("d0", "d1", "top", *(f"{x}{i}" for i in range(LEVELS) for x in ("before", "after", "s")))
    both = rows.join(paths.withColumnRenamed("path", "up"), ["k", "stretch"])
    return both.withColumn("path", F.concat("steps", "up")).drop("steps", "up", "stretch")


def _descended(layers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """paths (k, path, …) of the single nodes at the top, brought down to the first layer."""
    paths = paths.withColumn("pos", F.lit(0).cast("long"))
    for nodes in reversed(layers[:-1]):
        paths = _below(nodes, paths.withColumnRenamed("pos", "stretch"))
        if nodes is not layers[0]:
            paths = paths.drop("digest", "n")
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root, in lowercase hex, that a leaf's digest and its siblings give."""
    return F.aggregate(path, hex_of(leaf), lambda acc, s: F.sha2(F.concat(hex_of(s["before"]), acc, hex_of(s["after"])), 256))


def proof_digest(path: Column) -> Column:
    """sha256, in lowercase hex, of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: hex_of(F.concat(s["before"], s["after"]))), ""), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, also: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root (lowercase hex), digest (the leaf as bytes) and path.

    path is an array of (before, after), the digests of a node's siblings as bytes, one entry for each level that has more
    than one node, from the leaf to the root; fold(digest, path) gives the root again, for a changed row another one.
    also: further columns, computed from docs beside the leaves.

    Leaves of a group ascend by id, null ids first; rows that repeat an id ascend by their leaf, and equal rows have equal
    leaves.  Null is a group of its own, before all others; groups ascend bytewise.  Any field may be null; text may be
    empty or long.  A table of one row has leaf = subroot = root and an empty path; an empty table gives no rows.  Only the
    named columns are read, so others never clash.
    """
    prepare(docs.sparkSession)
    extra = dict(also or {})
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    row = docs.select(group.alias("k"), F.col(id_col).alias("id"), leaf_of([F.col(f) for f in fields]).alias("digest"), F.struct(F.lit(1).alias("_"), *(c.alias(n) for n, c in extra.items())).alias("also"))
    leaves = _layers(stored(_numbered(stored(row.withColumn("uid", F.monotonically_increasing_id())), ["id", "digest", "uid"])))
    roots = leaves[-1].select(F.col("k").alias("id"), F.col("digest"), F.lit("").alias("k"))
    over = _layers(stored(_numbered(roots, ["id"])))
    top = over[-1].select("k", _no_path().alias("path"), hex_of(F.col("digest")).alias("root"))
    if len(over) > 1:
        groups = _descended(over, top).select(F.col("id").alias("k"), "path", hex_of(F.col("digest")).alias("subroot"), "root")
    else:  # one group: its root is the root
        groups = roots.select(F.col("id").alias("k"), _no_path().alias("path"), hex_of(F.col("digest")).alias("subroot"), hex_of(F.col("digest")).alias("root"))
    placed = _descended(leaves, groups) if len(leaves) > 1 else leaves[0].join(groups, "k")
    return placed.select(F.col("id").alias(id_col), hex_of(F.col("digest")).alias("leaf"), "subroot", "root", "digest", "path", *(F.col(f"also.{n}").alias(n) for n in extra))
