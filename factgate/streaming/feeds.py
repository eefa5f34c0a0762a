"""Structured Streaming: snapshot change feed, staleness on change, log rollup."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.gate import affected
from ..operators.registry import detect_changes, latest
from ..operators.search import contained


def log_rollup(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) counted and summed per window and type; rows later than the watermark are dropped.  Works on batches too."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    g = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def upserts(table: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of an aggregate's changed rows, each micro-batch to a folder of its own that a replay replaces; state behind the watermark is dropped."""

    def on_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return table.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(on_batch)


def latest_upserts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of each key of what `upserts` wrote (with its column batch)."""
    return latest(rows, keys, ["batch"]).drop("batch")


def batch_changes(batch: DataFrame, current: DataFrame) -> DataFrame:
    """The versions (source_id, sha256, arrived_at, …) of a batch that change something, in order of arrival: A to B to A is two changes."""
    w = Window.partitionBy("source_id").orderBy("arrived_at", "sha256")
    rows = batch.withColumn("__before", F.lag("sha256").over(w))
    first = detect_changes(rows.where("__before IS NULL"), current).where("changed").drop("changed", "__before")
    return first.unionByName(rows.where("__before IS NOT NULL AND __before <> sha256").drop("__before"))


def version_changes(versions: DataFrame) -> DataFrame:
    """The versions (source_id, sha256, arrived_at, …) that change something, in order of arrival; a null digest says that the source is gone.

    The first version of a source changes something unless it is gone; equal neighbours change nothing.
    """
    w = Window.partitionBy("source_id").orderBy("arrived_at", F.col("sha256").isNotNull(), "sha256")
    return versions.withColumn("__before", F.lag("sha256").over(w)).where(~F.col("sha256").eqNullSafe(F.col("__before"))).drop("__before")


def keyed_changes(stream: DataFrame) -> DataFrame:
    """version_changes of a stream (source_id, sha256, arrived_at, …), with each source's last digest as keyed state.

    No table is read: the state store holds one digest a source, survives restarts with the checkpoint, and a replayed
    batch starts from the state before it.  Micro-batches arrive in order; rows of one are sorted here.  A source that is
    gone keeps no state.
    """

    def changed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        rows = rows.assign(__here=rows["sha256"].notna()).sort_values(["arrived_at", "__here", "sha256"], kind="stable").drop(columns="__here")
        digests = [None if pd.isna(x) else x for x in rows["sha256"]]
        before = [state.get[0] if state.exists else None, *digests[:-1]]
        if digests[-1] is not None:
            state.update((digests[-1],))
        elif state.exists:
            state.remove()
        yield rows[[a != b for a, b in zip(digests, before)]]

    return stream.groupBy("source_id").applyInPandasWithState(changed, stream.schema, "sha256 string", "append", GroupStateTimeout.NoTimeout)


def change_feed(stream: DataFrame, current: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each micro-batch's changes to `apply` with the batch's number, by which it can make replays idempotent."""

    def on_batch(batch: DataFrame, number: int) -> None:
        apply(batch_changes(batch, current()), number)

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def stale_claims(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """Active claims (id, source_id, quote, status) whose quote a changed source (source_id, text; null: removed) no longer holds."""
    touched = claims.where("status <> 'deprecated'").join(changed.select("source_id").distinct(), "source_id", "left_semi")
    return contained(touched, changed, "source_id").where(~F.col("verbatim")).drop("verbatim")


def on_change(claims: Callable[[], DataFrame], live: Callable[[], DataFrame], conflicts: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for change_feed: of each batch's changes it hands on the claims that are stale now, and the content and conflicts they touch.

    write gets both tables and the batch's number, under which it replaces what an earlier try of the batch wrote.
    """

    def apply(changes: DataFrame, number: int) -> None:
        last = changes.groupBy("source_id").agg(F.max_by("text", F.struct("arrived_at", "sha256")).alias("text"))
        stale = stale_claims(claims(), last)
        write(stale, affected(stale, live(), conflicts()), number)

    return apply
