"""Upserts and other table changes as pure frame transformations (a write is the caller's overwrite).

Without a row-level table format a merge is a full outer join of target and source on the key; the caller
writes the result to a new version or the touched partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """SNK1, SNK11, SNK27: insert new keys; of known ones only ``update`` columns change. NULL keys match NULL."""
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    on = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    j = t.join(s, on, "full_outer")
    new = F.col("_t").isNull()
    out = []
    for c in target.columns:
        if c not in source.columns:
            out.append(F.col(f"t.{c}").alias(c))
        elif c in keys:
            out.append(F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            change = new | F.col("_s") if c in update else new
            out.append(F.when(F.coalesce(change, F.lit(False)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return j.select(*out)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """SNK2, JON2, JON6: source rows with unknown keys are added."""
    return target.unionByName(source.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))


def merge_nodes(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """SNK4 to SNK6: first_run once, last_run always, name only if missing, aliases united (sorted)."""
    j = target.alias("t").join(source.alias("s"), key, "full_outer")
    empty = F.array().cast("array<string>")
    return j.select(
        key,
        F.coalesce("t.name", "s.name").alias("name"),
        F.array_sort(F.array_union(F.coalesce("t.aliases", empty), F.coalesce("s.aliases", empty))).alias("aliases"),
        F.coalesce("t.first_run", "s.run").alias("first_run"),
        F.coalesce("s.run", "t.last_run").alias("last_run"),
    )


def merge_edges(target: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """SNK7: documents accumulate as a set, the count is its size, evidence stays the first one's.

    ``target``: keys, doc_ids, evidence; ``facts``: keys, doc_id, evidence, seq.
    """
    new = facts.groupBy(*keys).agg(F.collect_set("doc_id").alias("new_ids"), F.min_by("evidence", "seq").alias("new_evidence"))
    j = target.join(new, keys, "full_outer")
    ids = F.array_sort(F.array_union(F.coalesce("doc_ids", F.array().cast("array<bigint>")), F.coalesce("new_ids", F.array().cast("array<bigint>"))))
    return j.select(*keys, ids.alias("doc_ids"), F.coalesce("evidence", "new_evidence").alias("evidence")).withColumn("evidence_count", F.size("doc_ids").cast("long"))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """SNK9: edges whose both ends exist."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def stub_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """SNK8, SNK21: nodes that edges name and the node table lacks."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti")


def soft_delete(chunks: DataFrame, patterns: list[str], kinds: list[str], least: int = 50) -> DataFrame:
    """SNK13, FIL7: ready short rows of the kinds whose text is like a pattern go back to pending."""
    like = reduce(lambda a, b: a | b, [F.col("text").like(p) for p in patterns])
    return chunks.withColumn("status", F.when(like & F.col("kind").isin(kinds) & (F.col("n_tokens") < least) & (F.col("status") == "ready"), "pending").otherwise(F.col("status")))


def promote(manifest: DataFrame) -> DataFrame:
    """SNK14: swap of active and standby in a one-row manifest; any status but ready_to_promote raises."""
    row = manifest.first()
    if row is None or row["standby_status"] != "ready_to_promote":
        raise ValueError(f"not ready to promote: {row and row['standby_status']}")
    return manifest.select(F.col("standby_run").alias("active_run"), F.col("active_run").alias("standby_run"), F.lit("cleanup_pending").alias("standby_status"))


def acquire(manifest: DataFrame, run: str) -> DataFrame:
    """SNK15: an ingesting standby run is resumed, else a new one is issued."""
    busy = F.col("standby_status") == "ingesting"
    return manifest.select("active_run", F.when(busy, F.col("standby_run")).otherwise(F.lit(run)).alias("standby_run"), F.lit("ingesting").alias("standby_status"))


def keep_one(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """SNK22, A15: one row of each key, the least by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def checks(rows: list[tuple[str, Column, str]]) -> Callable[[DataFrame], DataFrame]:
    """DIA16: named verdicts over one aggregate row, stacked."""

    def run(sums: DataFrame) -> DataFrame:
        parts = [F.struct(F.lit(n).alias("name"), F.when(ok, "PASS").otherwise(bad).alias("status")) for n, ok, bad in rows]
        return sums.select(F.explode(F.array(*parts)).alias("c")).select("c.*")

    return run
