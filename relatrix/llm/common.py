"""Shared pieces of the training-data operators: scratch tables, hashing of whole texts, components.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; on UTF-8 bytes that is exactly
``text.lower().split()``, so every operator here works on bytes.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Text bytes hashed at once inside a task; bounds the numpy temporaries, not the text.
CHUNK_BYTES = 1 << 20
#: Fixed random constants of the rolling hash (odd multiplier and byte table from a fixed seed).
_RNG = np.random.default_rng(20240229)
BASE = np.uint64(int(_RNG.integers(1 << 62, 1 << 63)) | 1)
BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``); a private one only where none is set and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="relatrix-")
        spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/relatrix/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() of a small table that is rebuilt in each round of a loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * CHUNK_BYTES)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]), dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] times inverse power i the rolling hash of data[i:j]."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by content and length."""
    _, down = POWERS.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of whole texts holding about ``limit`` bytes each; a longer text stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def tidy(run: Callable) -> Callable:
    """``run`` over batches, returning freed memory to the system at the end: a Python worker serves tasks of all kinds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def pieces(batch: pa.RecordBatch, limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows that hold about ``limit`` bytes of text each, so that a task's copies of texts stay small."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64))
    part = (np.cumsum(sizes) // limit).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(edges, edges[1:]):  # noqa: B905
        yield batch.slice(a, b - a)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of the bytes; the data must end with white space."""
    gap = np.concatenate([[True], SPACE[data]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


#: Odd multipliers that make a shingle's hash depend on the order of its words.
ORDER = _RNG.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word shingles (all words as one, if fewer; none without words)."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        blob = b"\n".join(texts[a:b]).lower() + b"\n"
        data = np.frombuffer(blob, dtype=np.uint8)
        start, end = word_spans(data)
        word = span_hash(prefix_hash(data), start, end)
        sizes = np.fromiter((len(t) + 1 for t in texts[a:b]), dtype=np.int64, count=b - a)
        bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
        n = max(0, len(word) - size + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            rolled += word[j : j + n] * ORDER[j]
        rolled = mix(rolled)
        for i in range(b - a):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= size:
                out.append(np.unique(rolled[lo : hi - size + 1]))
            elif hi > lo:
                few = (word[lo:hi] * ORDER[: hi - lo]).sum(dtype=np.uint64)
                out.append(mix(np.array([few + np.uint64(int(hi - lo))], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each batch of links: the same components with at most one link a node."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        kids = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(kids, pa.int64()), pa.array([find(x) for x in kids], pa.int64())], names=["u", "v"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): smallest id reachable, for every node in ``links(u, v)``.

    Union-find inside tasks shrinks the links; alternating large-star and small-star rounds join the
    forests, each round cut by checkpoint(). Nothing but a count and a hash sum reaches the driver.
    """
    links = cut(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_forest, "u long, v long").distinct())
    seen = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        links = cut(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    kids = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return kids.unionByName(kids.select(F.col("component").alias("node"), "component").distinct())
