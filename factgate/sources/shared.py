"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where Spark runs on this machine alone and nothing else is configured.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, whoever has set it, else spark.checkpoint.dir; a cluster must name one."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if root is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (root or LOCAL_FOLDER).rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: computed once, and safe from lost executors.

    The table stays there as checkpoints do; whoever empties the folder after the application removes both.
    """
    path = f"{shared_folder(df.sparkSession)}/factgate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: never broadcast, though Spark takes the compressed size of its files for its size."""
    return df.hint("merge")
