"""Approximate nearest neighbours: a forest of random-projection trees, one shared queue, exact reranking.

Split directions are random; split points are medians of a sample (``SAMPLE`` vectors of least id hash, or one in
``SHARE`` if that is more, at most ``MOST`` vectors and ``MOST_BYTES``), so the trees are small and broadcast; their depth grows with the
sample, to leaves of ``LEAF`` vectors. Every vector is indexed: a task walks its vectors down all trees at once.
A query pops nodes of all trees from one queue, nearest margin first, until the leaves it has reached hold
as many vectors as the table needs: for ``PROBES`` of the queries the exact nearest are found in one pass over the
table, and the budget is what reaches ``TARGET`` of them, a quarter of ``rows`` a tree at least. Equal vectors of a leaf count once. The way is the same at every
size: in a small table the queue just comes to its end. With ``exact`` one tree is read whole instead. Leaves are joined with the queries that want them, in parts of
``PART`` vectors where many equal vectors share a leaf; each part returns its 10 nearest by
exact double-precision distance, without those farther than the 10th nearest of one in ``SHARE`` of the vectors
(they cannot be among the best), and the best 10 of all parts are the answer.

Cases: vectors that are null, zero, hold null or non-finite components, or have another length than most
take no part; repeated ids count once, by their smallest distance; ties go to the smaller id; a table whose trees hold no
more than the budget together is searched whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, SAMPLE, LEAF, ROWS, PART = 12, 20_000, 128, 12_000, 4096
SHARE, MOST, MOST_BYTES = 16, 1 << 18, 128 << 20
PROBES, TARGET = 128, 0.95
USABLE = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


class Forest:
    """Complete trees of one depth; node i has children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.depth, dim = depth, sample.shape[1]
        inner = (1 << depth) - 1
        self.normal = rng.standard_normal((trees, depth, dim)).astype(np.float64)
        self.normal /= np.linalg.norm(self.normal, axis=2, keepdims=True)
        self.split = np.zeros((trees, inner))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                shadow = sample @ self.normal[t, level]
                by = np.lexsort((shadow, node))
                owner = node[by]
                ids, first, n = np.unique(owner, return_index=True, return_counts=True)
                self.split[t, ids] = shadow[by][first + (n - 1) // 2]
                node = 2 * node + 1 + (shadow > self.split[t, node])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """(trees x vectors) leaf numbers from 0."""
        out = np.zeros((len(self.normal), len(vectors)), np.int64)
        for t, normals in enumerate(self.normal):
            shadow = vectors @ normals.T
            for level in range(self.depth):
                out[t] = 2 * out[t] + 1 + (shadow[:, level] > self.split[t, out[t]])
        return out - self.split.shape[1]

    def needed(self, vector: np.ndarray, leaves: np.ndarray, held: np.ndarray) -> list[int]:
        """For each column of ``leaves``, how many vectors a search holds when it first reaches one of these leaves."""
        inner = self.split.shape[1]
        shadow = self.normal @ vector
        margin = np.zeros((len(shadow), 1))
        for level in range(self.depth):
            gap = shadow[:, level : level + 1] - self.split[:, (1 << level) - 1 : (2 << level) - 1]
            both = np.maximum(margin[:, :, None], np.abs(gap)[:, :, None] * np.stack([gap > 0, gap <= 0], axis=2))
            margin = both.reshape(len(shadow), -1)
        order = np.argsort(margin, axis=None, kind="stable")
        reached = np.zeros(margin.size, np.int64)
        reached[order] = np.cumsum(held.reshape(-1)[order])
        return reached.reshape(-1, inner + 1)[np.arange(len(shadow))[:, None], leaves].min(axis=0).tolist()

    def search(self, vector: np.ndarray, held: np.ndarray, rows: int, reach: int | None = None) -> list[tuple[int, int]]:
        """(tree, leaf) pairs by a shared queue until they hold ``reach`` vectors, or as many as hold about ``rows`` distinct ones; held[t, leaf] counts them."""
        inner = self.split.shape[1]
        shadow = self.normal @ vector
        queue = [(0.0, t, 0, 0) for t in range(len(shadow))]
        found, total, limit = [], 0, max(rows, rows * len(shadow) // 4) if reach is None else reach
        while queue and total < limit:
            margin, t, node, level = heapq.heappop(queue)
            while node < inner:
                gap = shadow[t, level] - self.split[t, node]
                near = 2 * node + 1 + int(gap > 0)
                heapq.heappush(queue, (max(margin, abs(gap)), t, 4 * node + 3 - near, level + 1))
                node, level = near, level + 1
            if n := int(held[t, node - inner]):
                found.append((t, node - inner))
                total += n
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = shared.value.leaves(_matrix(batch.column("embedding")))
                for t, leaf in enumerate(leaves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf.astype(np.int32)), batch.column("vec_id"), batch.column("embedding")], names=["tree", "leaf", "vec_id", "embedding"])

    return run


def _wanted(shared, counts, reach: int, some, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple[int, int, int, int]] = []
            names, rows = some.value
            bounds = []
            for i, (q, vector) in enumerate(zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("embedding")), strict=True)):
                # a vector farther than the near-th of some other rows is not among the nearest
                square = ((rows @ vector) * -2 + (rows * rows).sum(axis=1) + vector @ vector)[names != q]
                bounds.append(math.sqrt(max(0.0, np.partition(square, near - 1)[near - 1]) + 1e-9 * (vector @ vector + np.abs(square).max())) if len(square) >= near else math.inf)
                for t, leaf in shared.value.search(vector, counts.value[1], 0, reach):
                    got += [(t, leaf, part, i) for part in range(-(-int(counts.value[0][t, leaf]) // PART))]
            t, leaf, part, i = (np.array(x, np.int32) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int32),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(leaf), pa.array(part), batch.column("vec_id").take(pa.array(i)), batch.column("embedding").take(pa.array(i)), pa.array(bounds, pa.float64()).take(pa.array(i))], names=["tree", "leaf", "part", "query_id", "query", "bound"])

    return run


def _rank(near: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            ids, vectors = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding").combine_chunks())
            for q, v, bound in zip(queries.column("query_id").to_pylist(), _matrix(queries.column("query").combine_chunks()), queries.column("bound").to_pylist(), strict=True):
                distance = np.sqrt(((vectors - v) ** 2).sum(axis=1))
                ok = np.flatnonzero((ids != q) & (distance <= bound))
                best = ok[np.lexsort((ids[ok], distance[ok]))[:near]]
                out[0] += [q] * len(best)
                out[1] += ids[best].tolist()
                out[2] += distance[best].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _nearest(shared, near: int):
    """The nearest rows of each task to every probe; a row of an id that came before, in the same place, counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probes = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, probes.shape[1]))) for _ in names]
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"))
            for i, (q, v) in enumerate(zip(names, probes, strict=True)):
                distance = np.sqrt(((vectors - v) ** 2).sum(axis=1))
                ok = np.flatnonzero(ids != q)
                if len(ok) > 4 * near:
                    ok = ok[distance[ok] <= np.partition(distance[ok], near - 1)[near - 1]]
                all_ids, all_far, all_rows = (np.concatenate(x) for x in zip(held[i], (ids[ok], distance[ok], vectors[ok]), strict=True))
                best = np.lexsort((all_ids, all_far))
                once = np.sort(np.unique(all_ids[best], return_index=True)[1])[:near]
                held[i] = all_ids[best[once]], all_far[best[once]], all_rows[best[once]]
        for q, (ids, far, rows) in zip(names, held, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, dtype=np.int64)), pa.array(ids, pa.int64()), pa.array(far, pa.float64()), pa.array(list(rows), pa.list_(pa.float64()))], names=["query_id", "vec_id", "score", "embedding"])

    return run


def some_of(rows: DataFrame, wanted: int, total: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, those of least id hash: told row by row, so tasks send no more than these."""
    return rows if wanted >= total else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(math.ceil(wanted / total * (1 << 40)))).limit(2 * wanted)


def budget(usable: DataFrame, queries: DataFrame, forest: Forest, held: np.ndarray, near: int, probes: int = PROBES, target: float = TARGET) -> int:
    """Vectors that searches have to reach for ``target`` of the exact nearest of some queries."""
    asked = some_of(queries, probes, queries.count()).collect()
    if not asked:
        return 0
    own = {r["vec_id"]: np.array(r["embedding"]) for r in asked}
    shared = usable.sparkSession.sparkContext.broadcast((list(own), np.array(list(own.values()))))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    exact = usable.mapInArrow(_nearest(shared, near), "query_id long, vec_id long, score double, embedding array<double>")
    exact = exact.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy("score"))).where("r = 1")
    needed: list[int] = []
    wanted: dict[int, list] = {}
    for r in exact.withColumn("r", F.row_number().over(order)).where(F.col("r") <= near).collect():
        wanted.setdefault(r["query_id"], []).append(r["embedding"])
    for q, vectors in wanted.items():
        needed += forest.needed(own[q], forest.leaves(np.array(vectors)), held)
    needed.sort()
    return needed[max(0, math.ceil(target * len(needed)) - 1)] if needed else 0


def _held(usable: DataFrame, forest: Forest) -> np.ndarray:
    """(2 x trees x leaves): the vectors of each leaf, and the distinct ones."""
    shared = usable.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared.value.leaves(_matrix(batch.column("embedding"))).T.astype(np.int32)
            ends = np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("same"), pa.ListArray.from_arrays(pa.array(ends), pa.array(leaves.ravel()))], names=["same", "leaves"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, len(shared.value.normal), 1 << shared.value.depth), np.int64)
        for batch in batches:
            for t, leaf in enumerate(_matrix(batch.column("leaves")).astype(np.int64).T if batch.num_rows else ()):
                np.add.at(seen[0, t], leaf, batch.column("n").to_numpy())
                np.add.at(seen[1, t], leaf, 1)
        t, leaf = np.nonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(seen[0][t, leaf]), pa.array(seen[1][t, leaf])], names=["tree", "leaf", "n", "d"])

    out = np.zeros((2, len(forest.normal), 1 << forest.depth), np.int64)
    # equal vectors lie in the same leaves, so a hash tells them apart well enough and vectors are not shuffled
    distinct = usable.select(F.xxhash64("embedding").alias("same"), "embedding").mapInArrow(place, "same long, leaves array<int>").groupBy("same", "leaves").agg(F.count("*").alias("n"))
    sums = distinct.mapInArrow(run, "tree int, leaf int, n long, d long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).toArrow()
    t, leaf = sums.column("tree").to_numpy(), sums.column("leaf").to_numpy()
    out[0, t, leaf], out[1, t, leaf] = sums.column("n").to_numpy(), sums.column("d").to_numpy()
    return out


def search_all(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", near: int = 10, trees: int = TREES, rows: int = ROWS, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row where ``is_query`` holds; with ``exact``, the nearest."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    usable = vectors.where(USABLE).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    usable = usable.where(F.size("embedding") == sizes["d"])
    total = sizes["count"]
    queries = usable.where(is_query).dropDuplicates(["vec_id"])
    most = max(1, min(MOST, MOST_BYTES // (8 * sizes["d"])))
    first = some_of(usable, min(most, max(sample, total // SHARE)), total).select("vec_id", "embedding").toArrow()
    seed, names = _matrix(first.column("embedding").combine_chunks()), first.column("vec_id").to_numpy()
    once = np.sort(np.unique(names, return_index=True)[1])[: max(10 * near, min(most, total // SHARE))]
    some = spark.sparkContext.broadcast((names[once], seed[once]))
    depth = max(0, min(math.ceil(math.log2(max(1, total / LEAF))), int(math.log2(max(1, len(seed) / 8)))))
    trees = 1 if exact else trees  # one tree holds every vector once
    forest = Forest(seed, depth, trees)
    held = _held(usable, forest)
    reach = total if exact else max(rows * trees // 4, budget(usable, queries, forest, held[1], near))
    shared = spark.sparkContext.broadcast(forest)
    counts = spark.sparkContext.broadcast(held)
    indexed = usable.mapInArrow(_index(shared), "tree int, leaf int, vec_id long, embedding array<double>")
    held = held[0]
    per_leaf = spark.createDataFrame([(t, x, -(-int(held[t, x]) // PART)) for t in range(trees) for x in range(1 << depth) if held[t, x] > PART], "tree int, leaf int, parts int")
    indexed = indexed.join(F.broadcast(per_leaf), ["tree", "leaf"], "left")
    indexed = indexed.withColumn("part", F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    wanted = queries.mapInArrow(_wanted(shared, counts, reach, some, near), "tree int, leaf int, part int, query_id long, query array<double>, bound double")
    found = indexed.groupBy("tree", "leaf", "part").cogroup(wanted.groupBy("tree", "leaf", "part")).applyInArrow(_rank(near), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= near).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
