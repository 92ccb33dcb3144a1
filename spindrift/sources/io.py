"""Sources and sinks: typed reads, guarded writes, keyed upserts and scoped deletes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.corpus import latest


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``). Only a local session has one made where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spindrift-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path and low (lower-cased path, the order) of files below ``folder`` by suffix in any case; a missing folder is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return found.where(F.lower("path").endswith(suffix.lower())).select("path", F.lower("path").alias("low"))


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records; a record that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


GOLDEN = "version int, queries array<struct<id:string,text:string,topic:string,topic_filter:string,relevance_groups:array<struct<id:string,grade:int,document_ids:array<string>,rationale:string>>>>"


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, text, topic, topic_filter) and qrels (query_id, group_id, grade, doc_id) of a labelled query set."""
    raw = read_corpus(spark, path, GOLDEN).select(F.explode("queries").alias("q"))
    queries = raw.select(F.trim("q.id").alias("query_id"), F.trim("q.text").alias("text"), F.trim("q.topic").alias("topic"), F.trim("q.topic_filter").alias("topic_filter"))
    groups = raw.select(F.trim("q.id").alias("query_id"), F.explode("q.relevance_groups").alias("g"))
    return queries, groups.select("query_id", F.trim("g.id").alias("group_id"), "g.grade", F.explode("g.document_ids").alias("doc_id"))


def write_preview(df: DataFrame, path: str) -> None:
    if not path.endswith(".preview.json"):
        raise ValueError("a preview's path ends in .preview.json")
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins by ``keys``; both have a ``version``."""
    return latest(existing.unionByName(new), keys, "version")


def scoped_delete(rows: DataFrame, user: int) -> tuple[DataFrame, DataFrame]:
    """The table without a user's rows, as written, and one row: inserted, deleted, remaining (of that user) and completed."""
    own = F.col("user_id").eqNullSafe(F.lit(user))
    path = work_dir(rows.sparkSession, "kept-rows")
    rows.where(~own).write.parquet(path)
    left = rows.sparkSession.read.schema(rows.schema).parquet(path)
    counts = rows.agg(F.count_if(own).alias("inserted")).join(left.agg(F.count_if(own).alias("remaining")))  # one row each
    report = counts.select("inserted", F.greatest(F.lit(0), F.col("inserted") - F.col("remaining")).alias("deleted"), "remaining", (F.col("remaining") == 0).alias("completed"))
    return left, report
