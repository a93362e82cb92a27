"""Line dedup with levelled sorted runs of line hashes.

Line keys (stripped, A-Z lowered, 128-bit hash, at least 10 code points) are taken in batches of ascending
``doc_id``. Each batch merge-joins the runs in the shared folder: keys already there belong to an earlier
document; the rest (anti-join) become a new sorted run with their smallest document as owner. Once a level
holds ``FANOUT`` runs they are merged into one run of the next level. A key's rows that are not its owner's
are dropped. Runs are tables, so nothing is held by the driver, and a lost executor only repeats its tasks.

Cases: null and empty texts are one empty line, which is too short to drop; repeats within one document
stay (the contract counts documents); a null ``doc_id`` keeps all its lines and owns none; rows of one
repeated id are the same document; an empty table gives an empty result; further columns of any name, those used here too, pass
through untouched inside one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, tidy, utf8

BATCHES, FANOUT, LEAST = 4, 3, 10


def line_key(line: bytes) -> bytes | None:
    """128-bit key of a line that may be dropped; None if it is too short."""
    key = line.strip().lower()
    if len(key) < LEAST or (len(key) < 4 * LEAST and len(key.decode(errors="replace")) < LEAST):
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces(whole)):
        docs, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
            own = {k for line in text.split(b"\n") if (k := line_key(line))}
            docs += [doc] * len(own)
            keys += own
            if len(keys) >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])
                docs, keys = [], []
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])


class Runs:
    """Levelled runs of (key, owner), each sorted by key within its partitions."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        out = None
        for run in (r for level in self.levels for r in level):
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, run: DataFrame, level: int = 0) -> None:
        """Take in a stored run; a full level becomes one run of the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FANOUT:
            merged, self.levels[level] = self.levels[level], []
            out = merged[0]
            for more in merged[1:]:
                out = out.unionByName(more)
            self.add(sorted_run(out.repartition("key"), level + 1), level + 1)


def sorted_run(rows: DataFrame, level: int = 0) -> DataFrame:
    return stored(rows.sortWithinPartitions("key"), f"run{level}")


def dropped_keys(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, key) of lines that are not in the smallest document holding them."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(tidy(_keys), "doc_id long, key binary")
    cuts = docs.where("doc_id is not null").select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.01)
    step = F.lit(0)
    for c in sorted(set(cuts)):
        step = step + F.when(F.col("doc_id") > int(c), 1).otherwise(0)
    keys = stored(keys.withColumn("batch", step), "line-keys")
    runs, out = Runs(), []
    for i in range(len(set(cuts)) + 1):
        batch = keys.where(F.col("batch") == i).select("doc_id", "key")
        own = batch.groupBy("key").agg(F.min("doc_id").alias("owner"))
        if (old := runs.all()) is not None:
            out.append(batch.join(old.hint("merge"), "key", "left_semi"))
            own = own.join(old.hint("merge"), "key", "left_anti")
        fresh = sorted_run(own)
        runs.add(fresh)
        # lines first seen in this batch: all but the owner's go
        out.append(batch.join(fresh.hint("merge"), "key").where("doc_id > owner").select("key", "doc_id"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("doc_id", "key")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces(whole)):
        lines, dropped, kept = [], [], []
        for text, gone in zip(utf8(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
            own = text.split(b"\n")
            lines.append(len(own))
            if gone:
                gone = set(gone)
                own = [x for x in own if line_key(x) not in gone]
            dropped.append(lines[-1] - len(own))
            kept.append(b"\n".join(own).decode())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every document; with ``keep`` also ``row``, a struct of those columns, whatever their names, and ``absent`` (the text was null)."""
    gone = dropped_keys(docs).groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    row = F.struct(F.col("doc_id"), F.col("text").isNull().alias("absent"), F.struct(*(F.col(f"`{c}`") for c in keep or ["doc_id"])).alias("kept"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text").join(gone, "doc_id", "left").select("row", "text", "gone")
    out = rows.mapInArrow(tidy(_rebuild), f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string")
    more = [F.col("row.kept").alias("row"), F.col("row.absent").alias("absent")] if keep else []
    return out.select(F.col("row.doc_id").alias("doc_id"), *more, "n_lines", "n_dropped", "kept_text")
