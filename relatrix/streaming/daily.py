"""Daily tables kept up to date by days: only days that a batch touches are written again.

Documents are kept in files by day and batch, so a batch that runs twice writes the same files; what a day holds is
the latest row of each document. A document that moves to another day leaves a row that says so in its old one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DOCS = "doc_id string, corp string, ts timestamp, gone boolean, day date, batch long"
_DAILY = "corp string, mentions long, doc_ids array<string>, day date"


def overwrite_parts(rows: DataFrame, path: str, *by: str) -> None:
    """Write ``rows`` in place of the partitions that they have rows in; all others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def remove_part(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; without any files yet, no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current_documents(spark: SparkSession, docs_path: str) -> DataFrame:
    """The latest row of each document in each day, without those that left the day."""
    last = Window.partitionBy("day", "doc_id").orderBy(F.desc("batch"))
    rows = read_or_empty(spark, docs_path, _DOCS).withColumn("_r", F.row_number().over(last))
    return rows.where("_r = 1 and not gone").drop("_r", "gone", "batch")


def merge_days(batch: DataFrame, batch_id: int, docs_path: str, daily_path: str) -> DataFrame:
    """STR5, STR8, SNK3: add a batch (doc_id, corp, ts) and write the daily counts of its days again; gives the days.

    Rows without a time take no part; of several rows of a document the latest time counts. Late rows change their own day, and a document that comes
    again with another time is taken out of its old day. A batch that failed halfway may be run again, before any later one. Days are a calendar's, so
    the list of those that are left empty is short.
    """
    spark = batch.sparkSession
    new = batch.where("doc_id is not null and ts is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("corp").cast("string").alias("corp"), F.col("ts").cast("timestamp").alias("ts"))
    new = new.groupBy("doc_id").agg(F.max(F.struct("ts", "corp")).alias("r")).select("doc_id", "r.corp", "r.ts", F.lit(False).alias("gone"), F.to_date("r.ts").alias("day"))
    before = read_or_empty(spark, docs_path, _DOCS).where(F.col("batch") < batch_id)
    # all that the new documents have been, told by their ids; texts are not read
    at = before.join(new.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", "day").agg(F.max_by("gone", "batch").alias("was_gone"))
    moved = at.where("not was_gone").join(new.select("doc_id", F.col("day").alias("new_day")), "doc_id").where("day <> new_day")
    moved = moved.select("doc_id", F.lit(None).cast("string").alias("corp"), F.lit(None).cast("timestamp").alias("ts"), F.lit(True).alias("gone"), "day")
    overwrite_parts(new.unionByName(moved).withColumn("batch", F.lit(batch_id).cast("long")), docs_path, "day", "batch")
    # the batch's own files tell its days, also when it runs again
    days = read_or_empty(spark, docs_path, _DOCS).where(F.col("batch") == batch_id).select("day").distinct()
    touched = [r["day"] for r in days.collect()]
    now = current_documents(spark, docs_path).where(F.col("day").isin(touched)) if touched else current_documents(spark, docs_path).where("false")
    fresh = now.groupBy("corp", "day").agg(F.count("*").alias("mentions"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    overwrite_parts(fresh.select("corp", "mentions", "doc_ids", "day"), daily_path, "day")
    left = set(touched) - {r["day"] for r in now.select("day").distinct().collect()}
    for day in left:
        remove_part(spark, f"{daily_path}/day={day}")
    return days


def read_daily(spark: SparkSession, daily_path: str) -> DataFrame:
    return read_or_empty(spark, daily_path, _DAILY)


def stream_days(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str) -> None:
    """STR5 to STR8: drain the new files of ``source`` (doc_id, corp, ts) into the daily counts under ``out``, exactly once."""
    rows = spark.readStream.schema(schema).parquet(source)
    query = rows.writeStream.foreachBatch(lambda batch, n: merge_days(batch, n, f"{out}/docs", f"{out}/daily") and None)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
