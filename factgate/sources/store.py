"""Tables: keyed scans with a tenant predicate, upserts, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.gate import can_export
from ..operators.registry import latest


def scan(spark: SparkSession, path: str, workspace_id: str, product_id: str | None = None) -> DataFrame:
    """Rows of one workspace; both predicates prune partitions."""
    df = spark.read.parquet(path).where(F.col("workspace_id") == workspace_id)
    return df if product_id is None else df.where(F.col("product_id") == product_id)


def append_versions(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("workspace_id", "product_id").parquet(path)


def current(versions: DataFrame) -> DataFrame:
    """The last version of each document; replaces insert-or-replace."""
    return latest(versions, ["workspace_id", "id"], ["updated_at", "seq"])


#: Buckets of a compacted table: rows of its manifest, and the unit that a compaction rewrites.
BUCKETS = 64


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The last committed version of a compacted table, and the folder of each bucket that has rows (BUCKETS at most)."""
    try:
        rows = spark.read.schema("version long, bucket int, folder string").parquet(f"{path}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    last = rows.groupBy("version").agg(F.collect_list(F.struct("bucket", "folder")).alias("m")).orderBy(F.desc("version")).first()
    return (last["version"], {x["bucket"]: x["folder"] for x in last["m"]}) if last else (0, {})


def compacted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest version of each key, as of the last commit: one read of one folder a bucket, no aggregate over the history."""
    folders = sorted(set(_manifest(spark, path)[1].values()))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(versions: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> tuple[int, dict[int, str]]:
    """Write the buckets that new versions touch anew, and return what to commit: (version, folders).  Until then readers see the old view."""
    spark = versions.sparkSession
    version, folders = _manifest(spark, path)
    new = versions.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # at most `buckets`
    old = [folders[b] for b in touched if b in folders]
    if old:
        new = new.unionByName(spark.read.schema(versions.schema).parquet(*old).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    folder = f"{path}/data/{uuid.uuid4().hex}"
    latest(new, [*keys, "__bucket"], order).repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
    return version + 1, folders | {b: f"{folder}/__bucket={b}" for b in touched}


def commit(spark: SparkSession, path: str, version: int, folders: dict[int, str]) -> None:
    """Make a merge the current view: one small file, renamed into place."""
    rows = spark.createDataFrame([(version, b, f) for b, f in sorted(folders.items())], "version long, bucket int, folder string")
    rows.coalesce(1).write.parquet(f"{path}/manifest/{version:012d}")


def soft_delete(sources: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("source_id"), F.lit(True).alias("__gone"))
    return sources.join(gone, "source_id", "left").withColumn("status", F.when(F.col("__gone"), "removed").otherwise(F.col("status"))).drop("__gone")


def rebuild_text(blocks: DataFrame, key: str = "source_id") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("block_pos", "text")))
    return blocks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def import_manifest(urls: DataFrame, cap: int = 500) -> DataFrame:
    """(job_id, url, pos) of the first `cap` distinct urls of each job, in first-seen order."""
    first = urls.groupBy("job_id", "url").agg(F.min("pos").alias("pos"))
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("job_id").orderBy("pos"))).where(F.col("rn") <= cap).drop("rn")


def pending_extraction(sources: DataFrame, extracted: DataFrame) -> DataFrame:
    """Active sources (source_id, sha256, status, …) that no extraction (source_id, sha256) has read in this version: only these need one."""
    return sources.where("status = 'active'").join(extracted.select("source_id", "sha256"), ["source_id", "sha256"], "left_anti")


def current_records(sources: DataFrame, extracted: DataFrame) -> DataFrame:
    """Extracted rows of the current version of each active source."""
    return extracted.join(sources.where("status = 'active'").select("source_id", "sha256"), ["source_id", "sha256"], "left_semi")


def split_parsed(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Imported pages (url, text, …) with text, and an error row (url, error) for each without: one bad page stops nothing."""
    bad = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return rows.where(~bad), rows.where(bad).select("url", F.when(F.col(text).isNull(), "not fetched").otherwise("no text").alias("error"))


def registry_input(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Product and market-evidence claims as one input of a registry build; columns that one side lacks are null there."""
    return claims.unionByName(evidence.withColumn("category", F.lit("market-evidence")), allowMissingColumns=True)


def export_live(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, round, final_text) of live versions (item_id, live_round, live_status) that may be exported, from final texts (item_id, round, final_text)."""
    ok = items.where(can_export(F.col("live_status"))).select("item_id", F.col("live_round").alias("round"))
    return texts.join(ok, ["item_id", "round"], "left_semi").select("item_id", "round", "final_text")


def content_types(built_in: DataFrame, own: DataFrame) -> DataFrame:
    """Content types (id, …): a workspace's own ones replace built-in ones of the same id."""
    return own.unionByName(built_in.join(own.select("id"), "id", "left_anti"), allowMissingColumns=True)


def write_audit(log: DataFrame, path: str) -> None:
    """The whole log in order of time, all values quoted; the newest entries alone are reports.newest(log, "created_at", 300)."""
    log.orderBy("created_at", "id").write.mode("overwrite").option("quoteAll", True).option("header", True).csv(path)
