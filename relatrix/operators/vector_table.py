"""A table of vectors in buckets of their ids: an upsert reads and writes only the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..streaming.daily import overwrite_parts, read_or_empty, remove_part
from .tables import upsert

POINTS = "point_id string, embedding array<float>, payload map<string,string>, bucket int"
INDEX = "chunk_id string, run_id string, corp string, kind string, year int, embedding_text string, status string, ready_at timestamp, bucket int"


def bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def upsert_buckets(rows: DataFrame, path: str, schema: str, keys: list[str], update: list[str]) -> None:
    """SNK11: merge ``rows`` (with their ``bucket``) into the table at ``path``; other buckets' files are not touched.

    The merged buckets are written beside the table first and then put in place, so a run that dies while it replaces files
    can be repeated from there with the same rows.
    """
    spark = rows.sparkSession
    side, table = f"{path}__next", read_or_empty(spark, path, schema)
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
    if not touched:
        return
    columns = [f.name for f in table.schema]
    merged = upsert(table.where(F.col("bucket").isin(touched)), rows.select(*columns), ["bucket", *keys], update)
    merged.write.mode("overwrite").parquet(side)
    overwrite_parts(spark.read.schema(schema).parquet(side), path, "bucket")
    remove_part(spark, side)


def upsert_chunks(chunks: DataFrame, kind: str, index_path: str, points_path: str, buckets: int = 64) -> None:
    """SNK27: chunks of one source into the chunk index and, those that have a vector, into the vectors.

    ``chunks``: (chunk_id, run_id, corp, year, embedding_text, at, embedding), one row a (chunk, run). A known chunk of the run gets the new text, is ready and
    gets the new time; its other fields stay. A point's id is made from the chunk's and its payload mirrors the row, whole.
    """
    rows = chunks.withColumn("kind", F.lit(kind)).withColumn("status", F.lit("ready")).withColumnRenamed("at", "ready_at")
    index = bucketed(rows, "chunk_id", buckets).select("chunk_id", "run_id", "corp", "kind", F.col("year").cast("int").alias("year"), "embedding_text", "status", "ready_at", "bucket")
    upsert_buckets(index, index_path, INDEX, ["chunk_id", "run_id"], ["embedding_text", "status", "ready_at"])
    fields = [("chunk_id", "chunk_id"), ("chunk_type", "kind"), ("corp_code", "corp"), ("bsns_year", "year"), ("ingest_status", "status"), ("run_id", "run_id")]
    payload = F.create_map(*[x for name, c in fields for x in (F.lit(name), F.col(c).cast("string"))])
    points = rows.where("embedding is not null").select(S.uuid_from_id(F.col("chunk_id")).alias("point_id"), F.col("embedding").cast("array<float>").alias("embedding"), payload.alias("payload"))
    upsert_buckets(bucketed(points, "point_id", buckets), points_path, POINTS, ["point_id"], ["embedding", "payload"])
