"""LM scoring with a hidden Markov model of word classes.

A word's class is itself for the most frequent training tokens (all with a count no lower than the least that leaves
``TOP`` of them or fewer), else one of ``TAILS`` classes by its
last two characters; the end token always has a class of its own. Hidden states emit classes; a tail class emits its words by absolute discounting of
the training counts, the discount going to the one unknown type, so probabilities of all tokens (V known
types and the unknown one, the same events as the base score's) sum to one:

    P(tokens) = P(classes) by the scaled forward recursion  *  product of P(word | tail class)

Baum-Welch: every pass runs over all training documents, from seeded starting values in which states are
slow to change, so whole documents choose among them; each task adds up expected counts, Spark sums them
by cell, and the driver gets (STATES + 1) x (STATES + classes) numbers, whatever the corpus size. Token counts, V and N cover all
training documents and never leave Spark: rare words meet their counts in a join.

Cases: null and empty texts are one end token; a null ``doc_id`` is hashed as the text "" and never held
out unless crc32("") mod 10 is 0 (it is: such rows are held out); rows of a repeated id are scored row by row;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, tidy, utf8

TOP, TAILS, STATES = 8192, 512, 8
PASSES, STICK = 4, 0.98
END_CLASS = TOP  # between the top tokens and the tails
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAIL = f"{TOP + 1} + crc32(cast(right(word, 2) as binary)) % {TAILS}"


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) of the texts' words, the end token as a line feed; a word comes again whenever ``_HELD`` distinct ones are held."""

    def rows() -> Iterator[pa.RecordBatch]:
        words = pa.array(list(held), pa.binary()).cast(pa.string())
        counts = pa.array(held.values(), pa.int64(), size=len(held))
        for i in range(0, len(held), 20_000):
            yield pa.RecordBatch.from_arrays([words.slice(i, 20_000), counts.slice(i, 20_000)], names=["word", "c"])

    held: Counter[bytes] = Counter()
    for batch in (part for whole in batches for part in pieces(whole, 1 << 20)):
        for text in utf8(batch.column("text")):
            held.update(text.lower().split())
        held[b"\n"] += batch.num_rows
        if len(held) >= _HELD:
            yield from rows()
            held.clear()
    yield from rows()


def training_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all training documents, the end token as a line feed."""
    counted = docs.where(~held_out()).select("text").mapInArrow(tidy(_count), "word string, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


#: Distinct words that a task counts at once.
_HELD = 200_000
#: Ids whose shares are added up at once.
_SLICE = 1 << 16
#: Counts in steps that grow with them, some 15,000 at most, in the order of the counts.
_STEP = "if(c < 4096, c, 4096 + cast(floor(log2(c) * 256) as bigint))"


def top_tokens(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frequent, rare) words of the counts: ``TOP`` or fewer that are the most frequent, ties together, and the others."""
    counts = counts.where("word <> '\n'").withColumn("step", F.expr(_STEP))
    least, held = None, 0
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > TOP:
            break
        least = r["step"]
    if least is None:
        return counts.where("false"), counts
    return counts.where(F.col("step") >= least), counts.where(F.col("step") < least)


def _tail(word: bytes) -> int:
    return TOP + 1 + zlib.crc32(word[-2:] if word.isascii() else word.decode()[-2:].encode()) % TAILS


class Classes(dict):
    """Word -> class: the top words, and the first ``_HELD`` others that are met; classes of the rest are made each time."""

    def __missing__(self, word: bytes) -> int:
        out = _tail(word)
        if len(self) < TOP + _HELD:
            self[word] = out
        return out


def _encode(top: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(top)
        row_id = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in pieces(whole)):
            ids, known, tail_words, tail_counts, ends = [], [], [], [], [0]
            for text in utf8(batch.column("text")):
                words = text.lower().split()
                row = np.empty(len(words) + 1, dtype=np.uint16)
                row[:-1] = list(map(classes.__getitem__, words))
                row[-1] = END_CLASS
                counts = Counter(map(words.__getitem__, np.flatnonzero(row > END_CLASS).tolist()))
                tail_words += counts
                tail_counts += counts.values()
                ends.append(len(tail_words))
                ids.append(row.tobytes())
                known.append(len(row))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(tail_words, pa.binary()).cast(pa.string()), pa.array(tail_counts, pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row_id, row_id + batch.num_rows), pa.int64()), batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(known, pa.int64()), pa.array(ids, pa.binary()), *lists],
                names=["row", "doc_id", "held_out", "n_tokens", "ids", "tail_words", "tail_counts"],
            )
            row_id += batch.num_rows

    return run


def groups(sequences: list[np.ndarray], limit: int = 400_000, cells: int = 2_000_000) -> Iterator[tuple[list[int], np.ndarray]]:
    """Sequences of like length together, longest first: indexes, and the ids by time step (time-major).

    A group has at most ``limit`` ids and its grid (longest x sequences) at most ``cells`` places, or is one sequence.
    """
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest, take, held = len(sequences[order[at]]), [], 0
        while at < len(order) and len(take) < 16384 and (not take or (held + len(sequences[order[at]]) <= limit and longest * (len(take) + 1) <= cells)):
            held += len(sequences[order[at]])
            take.append(order[at])
            at += 1
        grid = np.full((longest, len(take)), -1, dtype=np.int16)  # classes are below 2**15
        for j, i in enumerate(take):
            grid[: len(sequences[i]), j] = sequences[i]
        yield take, grid


def forward(start: np.ndarray, move: np.ndarray, emit: np.ndarray, grid: np.ndarray, keep: bool = False):
    """Scaled forward recursion: natural-log likelihood of each column; with keep also the scaled values.

    emit is (classes x states). Columns are sorted by falling length, so the live ones are a prefix.
    The scaled values of all steps lie one after another in one array.
    """
    steps, cols = grid.shape
    live = np.count_nonzero(grid >= 0, axis=1)
    loglik = np.zeros(cols)
    ends, scales = np.cumsum(live), []
    alphas = np.empty((int(ends[-1]), len(start)), dtype=emit.dtype) if keep else None
    a, ones = np.empty((0, len(start)), dtype=emit.dtype), np.ones(len(start), dtype=emit.dtype)
    for t in range(steps):
        n = live[t]
        a = (start if t == 0 else a[:n] @ move) * emit[grid[t, :n]]
        c = a @ ones
        a /= c[:, None]
        loglik[:n] += np.log(c)
        if keep:
            alphas[ends[t] - n : ends[t]] = a
            scales.append(c)
    return (loglik, alphas, scales, live) if keep else loglik


def expected_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch E step over whole sequences: counts of first states, moves and emissions.

    Steps are in single precision, sums over them in double; scores are computed apart, in double precision.
    A state's share of a step takes the place of its forward value, so a group is held once (32 bytes an id).
    """
    k = len(start)
    start, move, emit = (x.astype(np.float32) for x in (start, move, emit))
    first, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((len(emit), k)), 0.0
    for _, grid in groups(sequences):
        loglik, alphas, scales, live = forward(start, move, emit, grid, keep=True)
        total += float(loglik.sum())
        beta, end = np.ones((0, k), dtype=np.float32), len(alphas)
        for t in range(len(live) - 1, -1, -1):
            n, after = live[t], len(beta)
            alpha, end = alphas[end - n : end], end - n
            b = np.ones((n, k), dtype=np.float32)
            if after:
                ahead = beta * emit[grid[t + 1, :after]] / scales[t + 1][:, None]
                b[:after] = ahead @ move.T
                moves += alpha[:after].T @ ahead
            alpha *= b
            beta = b
        first += alphas[: live[0]].sum(axis=0, dtype=np.float64)
        ids = grid[grid >= 0]
        for at in range(0, len(ids), _SLICE):
            cells = ids[at : at + _SLICE, None] * np.int64(k) + np.arange(k)
            emits += np.bincount(cells.ravel(), weights=alphas[at : at + _SLICE].ravel(), minlength=emits.size).reshape(-1, k)
    return first, moves * move.astype(np.float64), emits, total


def m_step(first: np.ndarray, moves: np.ndarray, emits: np.ndarray, unigram: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed maximisation; the unigram class probabilities are the prior of each state's emissions."""
    start = (first + 0.1) / (first + 0.1).sum()
    move = (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True)
    pseudo = prior * len(unigram) ** 0.5
    emit = (emits + pseudo * unigram[:, None]) / (emits.sum(axis=0) + pseudo)
    return start, move, emit


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in batch.column("ids")]


def _e_step(model: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None
        for batch in (part for whole in batches for part in pieces(whole, 16 << 20, "ids")):
            first, moves, emits, total = expected_counts(*model, _sequences(batch))
            one = np.concatenate([[total], first, moves.ravel(), emits.ravel()])
            cells = one if cells is None else cells + one
        if cells is not None:
            at = np.flatnonzero(cells)
            for i in range(0, len(at), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 10_000], pa.int32()), pa.array(cells[at[i : i + 10_000]])], names=["cell", "x"])

    return run


def _score(model: tuple[np.ndarray, np.ndarray, np.ndarray], base: np.ndarray, has: np.ndarray):
    """base: log10 base probability of each top token; has: 1 where the class is a known top token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 16 << 20, "ids")):
            seqs = _sequences(batch)
            score = np.zeros(len(seqs))
            for take, grid in groups(seqs, 4_000_000):
                score[take] = forward(*model, grid) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), pa.array([int(has[s].sum()) for s in seqs], pa.int64()), pa.array([float(base[s].sum()) for s in seqs]), pa.array(score)],
                names=["row", "doc_id", "held_out", "n_tokens", "top_known", "top_base", "class_score"],
            )

    return run


def _starting_model(unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeded values: each state prefers some classes, and mostly stays."""
    emit = unigram[:, None] * (np.random.default_rng(11).exponential(1.0, (len(unigram), STATES)) ** 2 + 0.05)
    move = np.full((STATES, STATES), (1 - STICK) / (STATES - 1))
    np.fill_diagonal(move, STICK)
    return np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0)


def score_documents(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = stored(training_counts(docs), "lm-counts")
    sums = counts.agg(F.sum("c"), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1)), F.sum(F.when(F.col("word") == "\n", F.col("c")))).first()
    n, v, once, twice, ends = (int(x or 0) for x in sums)
    discount = once / (once + 2 * twice) if once else 0.5
    below = n + 0.1 * (v + 1)
    frequent, rare = top_tokens(counts)
    top_rows = frequent.select("word", "c").collect()  # TOP at most
    top_rows.sort(key=lambda r: (-r["c"], r["word"]))
    top = {r["word"].encode(): i for i, r in enumerate(top_rows)}
    classes = TOP + 1 + TAILS
    unigram, base, has = np.full(classes, 1e-3), np.zeros(classes), np.zeros(classes, dtype=np.int64)
    for i, c in [*enumerate(r["c"] for r in top_rows), (END_CLASS, ends)]:
        unigram[i] += c
        base[i], has[i] = math.log10((c + 0.1) / below), int(c > 0)
    tails = stored(rare.select("word", "c", F.expr(_TAIL).cast("int").alias("tail")), "lm-tails")
    per_tail = tails.groupBy("tail").agg(F.sum("c").alias("tail_n"), F.count("*").alias("tail_v"))
    for r in per_tail.collect():  # at most TAILS rows
        unigram[r["tail"]] += r["tail_n"]
    unigram /= unigram.sum()

    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(top)
    encoded = docs.select("doc_id", "text", held_out().alias("held_out"))
    encoded = stored(encoded.mapInArrow(tidy(lambda it: _encode(shipped.value)(it)), "row long, doc_id long, held_out boolean, n_tokens long, ids binary, tail_words array<string>, tail_counts array<int>"), "lm-ids")
    train = encoded.where("not held_out").select("ids")
    model = _starting_model(unigram)
    for _ in range(passes if n else 0):
        held = spark.sparkContext.broadcast(model)
        cells = np.zeros(1 + STATES + STATES * STATES + classes * STATES)
        for r in train.mapInArrow(tidy(lambda it, held=held: _e_step(held.value)(it)), "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow().to_batches():
            cells[r.column("cell").to_numpy()] = r.column("x").to_numpy()
        k = STATES
        model = m_step(cells[1 : 1 + k], cells[1 + k : 1 + k + k * k].reshape(k, k), cells[1 + k + k * k :].reshape(-1, k), unigram)
    final = spark.sparkContext.broadcast((model, base, has))
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "ids").mapInArrow(tidy(lambda it: _score(*final.value)(it)), "row long, doc_id long, held_out boolean, n_tokens long, top_known long, top_base double, class_score double")

    used = encoded.select("row", F.explode(F.arrays_zip("tail_words", "tail_counts")).alias("w")).select("row", F.col("w.tail_words").alias("word"), F.col("w.tail_counts").alias("k"))
    used = used.join(tails.select("word", "c"), "word", "left").withColumn("tail", F.expr(_TAIL).cast("int"))
    used = used.join(F.broadcast(per_tail), "tail", "left")  # at most TAILS rows
    share = F.when(F.col("c").isNotNull(), (F.col("c") - discount) / F.col("tail_n")).when(F.col("tail_n").isNotNull(), discount * F.col("tail_v") / F.col("tail_n")).otherwise(1.0)
    used = used.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(float(below)))).alias("tail_base"),
        F.sum(F.col("k") * F.log10(share)).alias("tail_score"),
    )
    out = scored.join(used, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.col("class_score") + zero("tail_score")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("top_known") + zero("tail_known")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("top_base") + zero("tail_base")).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
