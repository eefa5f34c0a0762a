"""Helpers that the operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the cluster names no spark.checkpoint.dir (tests, local runs).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Words are maximal runs of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Make Python workers find this package, and see that a checkpoint folder is set."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    known = sc.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_configured(spark))
    return spark


def _configured(spark: SparkSession) -> str:
    """The folder that the cluster names; one of this machine only where Spark runs on this machine alone."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root or LOCAL_CHECKPOINTS


def checkpoint_root(spark: SparkSession) -> str:
    """The context's checkpoint folder, whoever has set it."""
    return prepare(spark).sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors, keeps column pruning.

    The tables stay there as checkpoints do; whoever empties the checkpoint folder after the application removes both.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/factgate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_mod(ident: Column | str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; null ids count as the empty string."""
    c = F.col(ident) if isinstance(ident, str) else ident
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def packed(docs: DataFrame, **named: Column) -> DataFrame:
    """All columns of docs as one struct `row`, beside the named ones, so that no name can clash; select("row.*") unpacks them."""
    return docs.select(F.struct(*docs.columns).alias("row"), *(c.alias(name) for name, c in named.items()))


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    """In a Python worker: this operator's caches stay from task to task, those of other operators go, and so does what Arrow keeps of their batches."""
    others = [x for x in _HELD if x != owner]
    for other in others:
        _HELD.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()
    _HELD[owner] = clear
