"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree is a list of regions, a region a list of racks, a rack a mapping shard -> weight. At each level the
children draw -ln(u) / weight, u in (0, 1) a hash of the document id and the child's path, and the least draw
wins; a subtree's weight is the sum of its shards'. A draw depends on nothing but its own child's weight, so
a change of weights moves rows only into or out of the subtrees whose weights change. ``grow`` adds a shard
as a region of its own: no other draw changes, and rows move into the new shard only.

Law: ``key`` - the id and the tree decide the shard. Slots are gapless in each shard without gathering it in
one task: rows are numbered in ``buckets`` hash buckets of a shard, and each bucket starts where the ones
before it end.

Cases: a null id draws as the text "null"; repeated ids share a shard and get slots of their own; null text
has size 1 and checksum 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tree = list[list[dict[int, float]]]


def even_tree(shards: int = 16, racks: int = 2, per_rack: int = 4) -> Tree:
    """Regions of ``racks`` racks of ``per_rack`` shards of weight 1."""
    ids = list(range(shards))
    rows = [{s: 1.0 for s in ids[i : i + per_rack]} for i in range(0, shards, per_rack)]
    return [rows[i : i + racks] for i in range(0, len(rows), racks)]


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, the next number, in a region of its own."""
    return [*tree, [{1 + max(s for region in tree for rack in region for s in rack): weight}]]


def _draw(key: Column, path: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{path}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def _least(key: Column, children: list[tuple[int, str, float]]) -> Column:
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.array_min(F.array(*[F.struct(_draw(key, path, w).alias("d"), F.lit(i).alias("i")) for i, path, w in children])).getField("i")


def _choose(picked: Column, options: list[Column]) -> Column:
    out = F.when(picked == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(picked == i, option)
    return out


def assign(rows: DataFrame, tree: Tree, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """The rows with their shard; one projection for each level, so no draw is computed twice."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    total = lambda region: sum(w for rack in region for w in rack.values())
    rows = rows.withColumn("_region", _least(k, [(i, str(i), total(r)) for i, r in enumerate(tree)]))
    racks = [_least(k, [(j, f"{i}.{j}", sum(rack.values())) for j, rack in enumerate(region)]) for i, region in enumerate(tree)]
    rows = rows.withColumn("_rack", _choose(F.col("_region"), racks))
    leaves = [_choose(F.col("_rack"), [_least(k, [(s, f"{i}.{j}.{s}", w) for s, w in rack.items()]) for j, rack in enumerate(region)]) for i, region in enumerate(tree)]
    return rows.withColumn(into, _choose(F.col("_region"), leaves).cast("int")).drop("_region", "_rack")


def shard_documents(docs: DataFrame, tree: Tree | None = None, buckets: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    tree = tree or even_tree()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign(assign(rows, tree), grow(tree), into="grown_shard").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("own", F.row_number().over(order) - 1)
    # at most shards x buckets rows, whatever the input
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = counts.select("shard", "bucket", before.alias("before"))
    rows = rows.join(F.broadcast(starts), ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), "grown_shard")
