"""Daily tables and bucketed vectors: only what a batch touches is written, and a batch may run again."""

import glob
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from relatrix.operators import vector_table as V
from relatrix.streaming import daily as Y

SCHEMA = "doc_id string, corp string, ts timestamp"


def at(day, hour=1):
    return datetime(2024, 1, day, hour)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def daily(spark, path):
    return {(r.corp, r.day.day): r.doc_ids for r in Y.read_daily(spark, path).collect()}


def test_merge_days(spark, tmp_path):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/daily"
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    Y.merge_days(batch(("a", "A", at(1)), ("b", "A", at(1)), ("c", "B", at(2)), ("n", "A", None), (None, "A", at(1))), 0, docs, out)
    assert daily(spark, out) == {("A", 1): ["a", "b"], ("B", 2): ["c"]}
    untouched = files(f"{out}/day=2024-01-02")
    # late and repeated rows; of one document in a batch the latest time counts
    Y.merge_days(batch(("b", "A", at(1)), ("d", "A", at(1, 5)), ("d", "A", at(1, 6)), ("e", "A", at(3))), 1, docs, out)
    assert daily(spark, out) == {("A", 1): ["a", "b", "d"], ("B", 2): ["c"], ("A", 3): ["e"]}
    assert files(f"{out}/day=2024-01-02") == untouched
    # documents move: one day loses a row, another one its last
    move = batch(("a", "C", at(3)), ("c", "B", at(4)))
    for _ in range(2):  # the second time as after a failure
        Y.merge_days(move, 2, docs, out)
        assert daily(spark, out) == {("A", 1): ["b", "d"], ("A", 3): ["e"], ("C", 3): ["a"], ("B", 4): ["c"]}
    # and back, beside another document of the old day
    Y.merge_days(batch(("c", "B", at(2)), ("f", "A", at(1))), 3, docs, out)
    assert daily(spark, out) == {("A", 1): ["b", "d", "f"], ("A", 3): ["e"], ("C", 3): ["a"], ("B", 2): ["c"]}
    Y.merge_days(batch().limit(0) if False else spark.createDataFrame([], SCHEMA), 4, docs, out)
    assert len(daily(spark, out)) == 4


def test_a_batch_that_failed_halfway(spark, tmp_path, monkeypatch):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/daily"
    first, second = (spark.createDataFrame(rows, SCHEMA) for rows in ([("a", "A", at(1))], [("a", "A", at(2)), ("b", "A", at(1))]))
    Y.merge_days(first, 0, docs, out)
    write = Y.overwrite_parts

    def fail(rows, path, *by):
        if path == out:
            raise RuntimeError("lost")
        write(rows, path, *by)

    monkeypatch.setattr(Y, "overwrite_parts", fail)
    with pytest.raises(RuntimeError):
        Y.merge_days(second, 1, docs, out)
    assert daily(spark, out) == {("A", 1): ["a"]}
    monkeypatch.setattr(Y, "overwrite_parts", write)
    Y.merge_days(second, 1, docs, out)
    assert daily(spark, out) == {("A", 1): ["b"], ("A", 2): ["a"]}


def test_stream(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("d"), "id").alias("doc_id"), (F.col("id") % 4).cast("string").alias("corp"), F.timestamp_seconds(F.lit(86400) * (F.col("id") % 3)).alias("ts"))
    rows(0, 20).coalesce(1).write.parquet(src)
    Y.stream_days(spark, src, SCHEMA, out, f"{tmp_path}/cp")
    rows(10, 40).coalesce(1).write.mode("append").parquet(src)
    Y.stream_days(spark, src, SCHEMA, out, f"{tmp_path}/cp")
    want = rows(0, 40).groupBy("corp", F.to_date("ts").alias("day")).agg(F.count("*").alias("mentions")).collect()
    assert {(r.corp, r.day, r.mentions) for r in Y.read_daily(spark, f"{out}/daily").collect()} == {tuple(r) for r in want}


def test_vectors_by_bucket(spark, tmp_path):
    index, points = f"{tmp_path}/index", f"{tmp_path}/points"
    load = lambda rows: V.upsert_chunks(spark.createDataFrame(rows, "chunk_id string, run_id string, corp string, year int, embedding_text string, at timestamp, embedding array<float>"), "krx_ohlcv", index, points, 16)
    load([(f"c{i}", "r", "A", 2024, "old", at(1), [float(i), 0.0] if i % 2 else None) for i in range(40)])
    before = files(tmp_path)
    load([("c1", "r", "B", 2025, "new", at(2), [9.0, 9.0]), ("c1", "q", "B", 2025, "other run", at(2), None)])
    rows = {(r.chunk_id, r.run_id): (r.corp, r.year, r.embedding_text, r.status, r.kind) for r in spark.read.schema(V.INDEX).parquet(index).collect()}
    assert len(rows) == 41 and rows["c1", "r"] == ("A", 2024, "new", "ready", "krx_ohlcv") and rows["c1", "q"][2] == "other run" and rows["c2", "r"][2] == "old"
    held = {r.payload["chunk_id"]: (list(r.embedding), r.payload["corp_code"], r.payload["bsns_year"]) for r in spark.read.schema(V.POINTS).parquet(points).collect()}
    assert len(held) == 20 and held["c1"] == ([9.0, 9.0], "B", "2025") and held["c3"] == ([3.0, 0.0], "A", "2024")
    changed = {f.split("bucket=")[1].split("/")[0] + f.split("/bucket")[0][-6:] for f in set(before) ^ set(files(tmp_path))}
    assert len(changed) == 2  # one bucket of each table
