"""Quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators: lower-cased words, pairs of words, and one to three shapes in a row. A word's shape keeps its
punctuation and folds runs of small letters, capitals and digits ("EDTH!!" is "A!!", "Thre***" is "Aa***"); a word equal to its
predecessor has the shape "=". Indicators are hashed to 2**BITS places. Each is scaled by the log-count ratio of its place (how
often documents of quality 1 hold it against those of quality 0, add-one smoothed) and rows get length 1. A linear hinge-loss
model is then fitted by dual coordinate descent.

All labelled training rows take part in both. Counts are sums over tasks. For the fit, every task goes through its rows in blocks of BLOCK_ROWS:
a block's dual problem, with the weights so far as its centre, is descended EPOCHS times, and its solution is the centre of
the next. The tasks' weights are averaged by their rows, and this is done ROUNDS times. A logistic curve over the margins of all training rows turns
margins into probabilities. What the driver gets is of fixed size: counts, weights and a histogram of margins.

Cases: null and empty texts have one indicator of their own, so they score as labelled empty texts do; contradictory labels of one id count as 0; rows
of one id with different texts are rows of their own; a null id is scored and cannot be a training row; without training rows of both classes every score is the
share of 1 among them (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, new_path, pieces, tidy

BITS, SMOOTH = 18, 1.0
#: Penalty of a row's hinge loss, descents of a block, rows of a block, and passes over all rows.
PENALTY, EPOCHS, BLOCK_ROWS, ROUNDS = 1.0, 3, 4096, 2
#: Labels up to this many are broadcast (about 100 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 300_000
#: Words that a task remembers, and bins of a histogram of margins in [-LIMIT, LIMIT].
REMEMBERED, BINS, LIMIT = 200_000, 2000, 4.0
_RUNS = re.compile(r"(.)\1+", re.DOTALL)
_CLASS = re.compile(r"[^\W\d_]+|\d+")
_ORDER = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def shape(word: str) -> str:
    """The word with runs of letters and digits folded and other runs cut to three."""

    def fold(m: re.Match) -> str:
        x = m.group()
        return "0" if x[0].isdigit() else "A" if x.isupper() and len(x) > 1 else "Aa" if x[0].isupper() else "a"

    return _RUNS.sub(lambda m: m.group()[:3], _CLASS.sub(fold, word))


class Words(dict):
    """Word -> its number; the numbers' hashes of lower-cased words and of shapes are kept beside."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = array("Q"), array("Q")

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        self.hashes[0].append(xxhash.xxh3_64_intdigest(word.lower()))
        self.hashes[1].append(xxhash.xxh3_64_intdigest(shape(word), 1))
        return out

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the text's words and of their shapes."""
        if len(self) >= REMEMBERED:
            self.clear()
            self.hashes = array("Q"), array("Q")
        split = text.split()
        at = np.fromiter(map(self.__getitem__, split), dtype=np.int64, count=len(split))
        return np.frombuffer(self.hashes[0], dtype=np.uint64)[at], np.frombuffer(self.hashes[1], dtype=np.uint64)[at]


SAME, EMPTY = np.uint64(xxhash.xxh3_64_intdigest("=", 1)), 0


def grams(words: Words, text: str | None) -> np.ndarray:
    """The sorted distinct places of a text's n-grams."""
    if not text or text.isspace():
        return np.array([EMPTY], dtype=np.uint32)
    word, form = words.read(text)
    form[1:][word[1:] == word[:-1]] = SAME
    rows = [word, word[:-1] * _ORDER[0] + word[1:] * _ORDER[1], form]
    rows += [sum(form[j : len(form) - n + 1 + j] * _ORDER[j] for j in range(n)) + np.uint64(n) for n in (2, 3) if len(form) >= n]
    return np.unique(mix(np.concatenate(rows)) >> np.uint64(64 - BITS)).astype(np.uint32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in (part for whole in batches for part in pieces(whole)):
        held = [grams(words, t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(held, pa.binary())], names=["quality", "places"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, places) of the labelled rows that may teach; ``places`` packs 32-bit numbers."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    small = labels.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labels) if small else labels, "doc_id")
    return rows.select("quality", "text").mapInArrow(tidy(_featured), "quality int, places binary")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for y, x in zip(batch.column("quality").to_pylist(), batch.column("places").to_pylist(), strict=True):
        yield y, np.frombuffer(x, dtype=np.uint32)


def _sparse(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(place, one value for each column), where any is not 0."""
    place = np.flatnonzero(np.any([c != 0 for c in columns], axis=0))
    for at in np.array_split(place, max(1, len(place) // 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(c[at], pa.float64()) for c in columns)], names=["place", *(f"v{i}" for i in range(len(columns)))])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a place; the last place counts documents."""
    seen = np.zeros((2, (1 << BITS) + 1))
    for batch in batches:
        for y, x in _rows(batch):
            seen[y, x] += 1
            seen[y, -1] += 1
    yield from _sparse([seen[0], seen[1]])


def descend(weights: np.ndarray, ratio: np.ndarray, rows: list[tuple[int, np.ndarray]], rng: np.random.Generator) -> None:
    """Dual coordinate descent on one block: min |w - centre|^2 / 2 + PENALTY * sum of hinge losses; ``weights`` is the centre, then the solution."""
    values = [ratio[x] for _, x in rows]
    values = [v / norm if (norm := math.sqrt(v @ v)) else v for v in values]
    dual = np.zeros(len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, x = rows[i]
            y = 2 * y - 1
            new = min(PENALTY, max(0.0, dual[i] - (y * (weights[x] @ values[i]) - 1)))  # a row's own product is 1
            if new != dual[i]:
                weights[x] += (new - dual[i]) * y * values[i]
                dual[i] = new


def _fit(shared):
    """The task's weights times its rows; the last place counts rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, ratio = shared.value
        weights, rng, held, n = weights.copy(), np.random.default_rng(0), [], 0
        for batch in batches:
            for row in _rows(batch):
                held.append(row)
                if len(held) == BLOCK_ROWS:
                    descend(weights, ratio, held, rng)
                    n, held = n + len(held), []
        if held:
            descend(weights, ratio, held, rng)
        n += len(held)
        yield from _sparse([np.append(weights * n, n)])

    return run


def _margins(shared):
    """Training rows of each class for each bin of the margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, seen = Margin(*shared.value), np.zeros((2, BINS))
        for batch in batches:
            for y, x in _rows(batch):
                seen[y, min(BINS - 1, max(0, int((margin(x) + LIMIT) / (2 * LIMIT) * BINS)))] += 1
        yield from _sparse([seen[0], seen[1]])

    return run


class Margin:
    def __init__(self, weights: np.ndarray, ratio: np.ndarray) -> None:
        self.scaled, self.squares = weights * ratio, ratio * ratio

    def __call__(self, places: np.ndarray) -> float:
        norm = self.squares[places].sum()
        return float(self.scaled[places].sum() / math.sqrt(norm)) if norm else 0.0


def _gather(rows: DataFrame, run: Callable, columns: int, size: int) -> np.ndarray:
    """Sums of the tasks' (place, values) rows, as a table of fixed size."""
    names = [f"v{i}" for i in range(columns)]
    sums = rows.mapInArrow(tidy(run), "place int, " + ", ".join(f"{c} double" for c in names)).groupBy("place").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((columns, size))
    for i, c in enumerate(names):
        out[i, sums.column("place").to_numpy()] = sums.column(c).to_numpy()
    return out


def curve(seen: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over a histogram of margins, fitted by Newton steps on smoothed targets."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 * LIMIT - LIMIT
    n0, n1 = seen.sum(axis=1)
    low, high = 1 / (n0 + 2), (n1 + 1) / (n1 + 2)
    a, b, total = 1.0, math.log((n1 + 1) / (n0 + 1)), seen.sum(axis=0)
    aim = seen[1] * high + seen[0] * low
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        gap, bend = aim - total * p, total * p * (1 - p)
        h = np.array([[bend @ (x * x) + 1e-6, bend @ x], [bend @ x, bend.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [gap @ x, gap.sum()])
        step = min(1.0, 5 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return max(0.0, float(a)), float(b)


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Model: weights, ratio, slope and offset."""
    spark, schema = docs.sparkSession, "quality int, places binary"
    training_rows(docs, labels).write.option("compression", "zstd").parquet(path := new_path(spark, "quality"))
    train = spark.read.schema(schema).parquet(path)
    counts = _gather(train, _counts, 2, (1 << BITS) + 1)
    n0, n1 = counts[:, -1]
    weights, slope, offset = np.zeros(1 << BITS), 0.0, math.log((n1 + 0.5) / (n0 + 0.5))
    p, q = counts[1, :-1] + SMOOTH, counts[0, :-1] + SMOOTH
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(counts[:, :-1].sum(axis=0) == 0)] = 0.0  # unseen places tell nothing
    if n0 and n1:
        for _ in range(ROUNDS):
            shared = spark.sparkContext.broadcast((weights, ratio))
            sums = _gather(train, _fit(shared), 1, (1 << BITS) + 1)[0]
            weights = sums[:-1] / sums[-1]
        slope, offset = curve(_gather(train, _margins(spark.sparkContext.broadcast((weights, ratio))), 2, BINS))
    discard(spark, path)
    return {"weights": weights.astype(np.float32), "ratio": ratio.astype(np.float32), "slope": slope, "offset": offset}


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value, Words()
        margin = Margin(model["weights"].astype(float), model["ratio"].astype(float))
        for batch in (part for whole in batches for part in pieces(whole)):
            margins = [margin(grams(words, t)) for t in batch.column("text").to_pylist()]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, model["slope"] * m + model["offset"])))) for m in margins]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], names=["doc_id", "held_out", "score", "margin"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, margin of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(tidy(_score(model)), "doc_id long, held_out boolean, score double, margin double")
