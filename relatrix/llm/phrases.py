"""Phrase collocations from an FM-index per shard over word ids.

Tasks cut the documents into shards of about SHARD_BYTES of text and turn each into a row of local word ids, 0 between
pieces. Word counts are summed over the shards; words under the least count cannot be part of a candidate and become breaks.
Every shard then gets an FM-index of its remaining words: the Burrows-Wheeler transforms of its id sequence and of the reversed
sequence, sorted to the depth of the longest phrase. A phrase is an interval in both. All live phrases of one length are
extended together, by each word to the left (an interval of the first transform) and by each word to the right (an interval of
the second); what both reach is a phrase one word longer whose two parts are live. Its count in the shard is the interval's width.
Counts are summed across shards, phrases that reach the least count get a number, and the shards that hold them go on
from there. So no shard drops a phrase by its own count, and the work of a length is bounded by the phrases alive.

Numbers of a length run from 0 without gaps, so a phrase is one code of its two parts. A shard deals its codes to parts, SHARDS_A_PART
shards' worth each, by the sum of both numbers, so that a very common word is spread over all parts; it sends a part its sorted codes as
differences with their counts, compressed, in one row. A task adds up the codes of a part and gives a row for each that reaches the least count.

Frequent words and phrases of a length go to the shards' tasks by broadcast as long as they are BROADCAST_ROWS at most; then nothing but
counts is shuffled: a task goes through the lengths again from the pairs that its index was stored with, and keeps the phrases that it finds among the broadcast
ones. Beyond that bound the frequent ones are joined with the shards' own rows and dealt back to the shards by shuffling.

A phrase is told by the numbers of its first and last parts (all but the last, all but the first word), so rows are a few numbers whatever
the words. Scores are exact: products in 38 digits, divided to whole numbers. A candidate is dropped if a longer
candidate around it is as frequent; then so is one longer by a word, which is what is compared.

Bounds: a task holds one shard and its index (about 60 bytes a word). Shards are cut between pieces; a piece without any of the marks is
never cut, whatever its length.

Cases: null and empty texts have no words; a null lang is "und"; ids are not read, so null and repeated ids are documents
like others, and equal documents count as often as they occur; langs without candidates have no rows; empty tables give an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, new_path, pieces, tidy, utf8

SHARD_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20
#: Frequent words or phrases of one length up to this many are broadcast (about 100 bytes a word, 24 bytes a phrase).
BROADCAST_ROWS = 300_000
SALTS = 64
#: As many shards' codes are added up by one task; codes that a task holds before it adds them up.
SHARDS_A_PART, HELD = 5, 1 << 21
#: Marks that end a piece become a full stop, tabs a space, A-Z lower case.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
_SHARD = "shard long, ids binary, langs array<struct<lang: string, ids: binary, words: binary>>"
_WORDS = "lang string, word string, n long"
_COUNTS, _PARTS = "pre long, suf long, n long", "part int, data binary"
_FOUND = "shard long, l array<int>, r array<int>, n array<int>, pre array<long>, suf array<long>"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.astype(np.int32).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=np.int32)


class Book:
    """Words of a shard as numbers from 1; 0 is a break between pieces."""

    def __init__(self) -> None:
        self.count = itertools.count(1)
        self.by_lang: dict[str, Numbers] = {}
        self.ids: list[np.ndarray] = []
        self.bytes = 0

    def add(self, lang: str, text: bytes) -> None:
        """``text`` is whole pieces, already mapped by the byte table."""
        numbers = self.by_lang.setdefault(lang, Numbers(self.count))
        split = text.replace(b".", b" . ").split()
        split.append(b".")
        self.ids.append(np.fromiter(map(numbers.__getitem__, split), dtype=np.int32, count=len(split)))
        self.bytes += len(text)

    def row(self, shard: int) -> pa.RecordBatch:
        langs = []
        for lang, numbers in self.by_lang.items():
            del numbers[b"."]
            if not numbers:
                continue
            langs.append({"lang": lang, "ids": _pack(np.fromiter(numbers.values(), dtype=np.int32, count=len(numbers))), "words": zstandard.compress(b" ".join(numbers), 1)})
        kind = pa.list_(pa.struct([("lang", pa.string()), ("ids", pa.binary()), ("words", pa.binary())]))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([_pack(np.concatenate(self.ids))], pa.binary()), pa.array([langs], kind)], names=["shard", "ids", "langs"])


class Numbers(dict):
    """Word -> number within a shard, for one lang; a break is 0."""

    def __init__(self, count: Iterator[int]) -> None:
        super().__init__({b".": 0})
        self.count = count

    def __missing__(self, word: bytes) -> int:
        out = self[word] = next(self.count)
        return out


def _langs(value: pa.Scalar) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(lang, numbers, words) of a shard."""
    for x in value:
        yield x["lang"].as_py(), _unpack(x["ids"].as_py()), zstandard.decompress(x["words"].as_py()).split(b" ")


def _words(placed: bool):
    """(lang, word, n) of the shards' words, or their (shard, id, lang, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = None if placed else np.bincount(_unpack(batch.column("ids")[i].as_py()))
                for lang, ids, words in _langs(batch.column("langs")[i]):
                    own = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(ids), dtype=np.int8)))
                    text = pa.array(words, pa.binary()).cast(pa.string())
                    if placed:
                        shard = pa.array(np.full(len(ids), batch.column("shard")[i].as_py(), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([shard, pa.array(ids), own, text], names=["shard", "id", "lang", "word"])
                    else:
                        yield pa.RecordBatch.from_arrays([own, text, pa.array(counts[ids].astype(np.int64))], names=["lang", "word", "n"])

    return run


def whole_pieces(text: bytes, limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Slices of about ``limit`` bytes that end where a piece ends."""
    a = 0
    while a < len(text):
        b = text.find(b".", a + limit)
        b = len(text) if b < 0 else b + 1
        yield text[a:b]
        a = b


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, done, task = Book(), 0, TaskContext.get().partitionId()
        for batch in (part for whole in batches for part in pieces(whole)):
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                for part in whole_pieces(text.translate(_BYTES)):
                    book.add(lang, part)
                    if book.bytes >= limit:
                        yield book.row((task << 24) + done)
                        book, done = Book(), done + 1
        if book.ids:
            yield book.row((task << 24) + done)

    return run


def _sorted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of (a, b, place), and where a new pair begins. Pairs with their places are sorted as one number, where 63 bits hold them."""
    low, place = int(b.max()).bit_length(), (len(a) - 1).bit_length()
    if int(a.max()).bit_length() + low + place < 64:
        packed = np.sort((a.astype(np.int64) << (low + place)) | (b.astype(np.int64) << place) | np.arange(len(a)))
        at, key = packed & ((1 << place) - 1), packed >> place
    else:
        key = a.astype(np.int64) << low | b
        at = np.argsort(key, kind="stable")
        key = key[at]
    return at, np.concatenate([[True], key[1:] != key[:-1]])


def order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all rotations of ``text``, sorted by their first ``depth`` ids (by doubling ranks)."""
    rank, known = text, 1
    at = np.argsort(text, kind="stable") if depth == 1 else text
    while known < depth:
        step = min(known, depth - known)
        at, new = _sorted(rank, np.roll(rank, -step))
        known += step
        if known < depth:
            rank = np.empty(len(text), dtype=np.int32)
            rank[at] = np.cumsum(new, dtype=np.int32) - 1
    return at


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """The Burrows-Wheeler transform: what stands before each rotation, in their order."""
    return text[order(text, depth) - 1]


def _last_to_first(bwt: np.ndarray) -> np.ndarray:
    out = np.empty(len(bwt), dtype=np.int64)
    out[np.argsort(bwt.astype(np.uint16) if bwt.max() < 1 << 16 else bwt, kind="stable")] = np.arange(len(bwt))
    return out


def _extend(bwt: np.ndarray, to_first: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each interval by each word before it: (interval, row in the new interval's transform, offset in the other transform, width)."""
    which = np.repeat(np.arange(len(start), dtype=np.int32), width)
    begins = np.cumsum(width) - width
    rows = (start - begins)[which] + np.arange(len(which))
    at, new = _sorted(which, bwt[rows])  # by interval, word and row
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(which)))
    row = rows[at[first]]
    keep = bwt[row] > 0
    first, n, row = first[keep], n[keep], row[keep]
    which = which[at[first]].astype(np.int64)
    return which, to_first[row], first - begins[which], n


def extend(left: np.ndarray, right: np.ndarray, l: np.ndarray, r: np.ndarray, n: np.ndarray, gid: np.ndarray, firsts: tuple | None = None) -> tuple[np.ndarray, ...]:  # noqa: E741
    """Live phrases (intervals in both transforms, width, number) -> phrases one word longer whose two parts are live (l, r, n, pre, suf)."""
    firsts = firsts or (_last_to_first(left), _last_to_first(right))
    by, row, other, wide = _extend(left, firsts[0], l, n)  # a word before: the phrase is the longer one's last part
    by_r, row_r, other_r, _ = _extend(right, firsts[1], r, n)  # a word after: the phrase is its first part
    at = np.full(len(left) + 1, -1, dtype=np.int32)
    at[row] = np.arange(len(row), dtype=np.int32)
    a = at[l[by_r] + other_r]
    b = np.flatnonzero(a >= 0)
    a = a[b]
    return row[a], row_r[b], wide[a], gid[by_r[b]], gid[by[a]]


def _lists(shard: int, columns: tuple[np.ndarray, ...]) -> list[pa.Array]:
    ends = pa.array([0, len(columns[0])], pa.int32())
    return [pa.array([shard], pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(c, t)) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))]


def build(ids: np.ndarray, local: np.ndarray, gid: np.ndarray, depth: int) -> tuple | None:
    """Both transforms of a shard's frequent words, and the intervals of its pairs."""
    sort = np.argsort(gid)
    local, gid = local[sort], gid[sort]
    number = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    number[local] = np.arange(1, len(local) + 1)
    text = number[ids]
    text = np.concatenate([[0], text[(text != 0) | (np.concatenate([[0], text[:-1]]) != 0)]]).astype(np.int32)
    text = text[:-1] if text[-1] == 0 and len(text) > 1 else text  # rotations close the circle
    n = np.bincount(text, minlength=len(local) + 1)
    start = (np.cumsum(n) - n)[1:]
    left, right = transform(text, depth), transform(text[::-1], depth)
    return left, right, extend(left, right, start, start, n[1:], gid)


def _build(depth: int, shared=None):
    """Index rows of shards; the numbers of their frequent words come with the row (``known``) or from a broadcast dictionary."""

    def numbers(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        if shared is None:
            known = batch.column("known").slice(i, 1).flatten()
            return tuple(known.field(c).to_numpy(zero_copy_only=False) for c in ("id", "gid"))
        local, gid = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for lang, ids, words in _langs(batch.column("langs")[i]):
            numbers = shared.value.get(lang, {})
            found = np.fromiter((numbers.get(w, -1) for w in words), dtype=np.int64, count=len(words))
            local.append(ids[found >= 0])
            gid.append(found[found >= 0])
        return np.concatenate(local), np.concatenate(gid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                local, gid = numbers(batch, i)
                if not len(local):
                    continue
                left, right, found = build(_unpack(batch.column("ids")[i].as_py()), local, gid, depth)
                shard = batch.column("shard")[i].as_py()
                yield pa.RecordBatch.from_arrays([*_lists(shard, found), pa.array([_pack(left)], pa.binary()), pa.array([_pack(right)], pa.binary())], names=["shard", "l", "r", "n", "pre", "suf", "left", "right"])

    return run


class Survivors:
    """The frequent phrases of one length, looked up by their parts."""

    def __init__(self, pre: np.ndarray, suf: np.ndarray, gid: np.ndarray) -> None:
        self.parts = [np.unique(x) for x in (pre, suf)]
        code = self._code(pre, suf)[0]
        sort = np.argsort(code)
        self.code, self.gid = code[sort], gid[sort]

    def _code(self, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, known = np.zeros(len(columns[0]), dtype=np.int64), np.ones(len(columns[0]), dtype=bool)
        for x, values in zip(columns, self.parts, strict=True):
            at = np.minimum(np.searchsorted(values, x), len(values) - 1)
            known &= values[at] == x
            code = code * len(values) + at
        return code, known

    def find(self, pre: np.ndarray, suf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are frequent, their numbers)."""
        code, known = self._code(pre, suf)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        known &= self.code[at] == code
        return known, self.gid[at[known]]


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of one length, the bytes of equal weight together, compressed."""
    wide = [8 if int(x.max()) >> 32 else 4 for x in columns]
    data = b"".join([np.ascontiguousarray(x.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T).tobytes() for x, w in zip(columns, wide, strict=True)])
    return bytes(wide) + zstandard.compress(data, 1)


def _columns(data: bytes) -> list[np.ndarray]:
    wide, body = data[:2], np.frombuffer(zstandard.decompress(data[2:]), dtype=np.uint8)
    out, at, n = [], 0, len(body) // sum(wide)
    for w in wide:
        out.append(np.ascontiguousarray(body[at : at + n * w].reshape(w, n).T).view(f"<u{w}").ravel().astype(np.int64))
        at += n * w
    return out


class Codes:
    """A phrase as one code of its parts' numbers (both below ``numbers``); a code's part is the sum of both numbers modulo ``parts``."""

    def __init__(self, numbers: int, parts: int) -> None:
        self.parts = parts
        self.base = numbers + (1 - numbers) % parts  # 1 modulo parts

    def deal(self, pre: np.ndarray, suf: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(part, codes and counts) of a shard's phrases."""
        code = pre.astype(np.int64) * self.base + suf
        part = (code % self.parts).astype(np.int32)
        sort = np.lexsort((code, part))
        code, part, n = code[sort] // self.parts, part[sort], n[sort]
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
        for a, b in itertools.pairwise(edges):
            yield int(part[a]), _planes(np.diff(code[a:b], prepend=0), n[a:b])

    def open(self, part: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        steps, n = _columns(data)
        return np.cumsum(steps) * self.parts + part, n

    def batch(self, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Rows (part, data) of shards' (pre, suf, n)."""
        rows = [x for columns in found for x in self.deal(*columns)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=["part", "data"])


def _added(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and the sums of their counts."""
    sort = np.argsort(code, kind="stable")  # merges what is in order already
    code, n = code[sort], n[sort]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first)


def _sums(codes: Codes, least: int):
    """(pre, suf, n) of the phrases of whole parts that reach the least count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, limit = 0, HELD
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                held.append(codes.open(part, data.as_py()))
                size += len(held[-1][0])
                if size >= limit:
                    held = [_added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    limit = size + HELD
        if held:
            code, n = _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            code, n = code[n >= least], n[n >= least]
            for i in range(0, len(code), 100_000):
                own = code[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own // codes.base, own % codes.base, n[i : i + 100_000])], names=["pre", "suf", "n"])

    return run


def _dealt(codes: Codes):
    """The counts of the shards' phrases, from rows that hold them, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield codes.batch([tuple(batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("pre", "suf", "n"))])

    return run


def _phrases(batch: pa.RecordBatch, tables: list) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(shard, phrases) of the next length, from the shard's pairs through the broadcast frequent phrases of each length."""
    for i in range(batch.num_rows):
        found = tuple(batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("l", "r", "n", "pre", "suf"))
        left, right = (_unpack(batch.column(c)[i].as_py()) for c in ("left", "right"))
        firsts = _last_to_first(left), _last_to_first(right)
        for table in tables:
            live, gid = table.value.find(found[3], found[4])
            if not live.any():
                found = tuple(x[:0] for x in found)
                break
            found = extend(left, right, *(x[live] for x in found[:3]), gid, firsts)
        yield batch.column("shard")[i].as_py(), found


def _walk(tables: list, codes: Codes):
    """The counts of the shards' phrases of the next length, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, (_, _, n, pre, suf) in _phrases(batch, tables):
                yield codes.batch([(pre, suf, n)])

    return run


def _found(tables: list):
    """The shards' phrases of the next length with their intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, found in _phrases(batch, tables):
                yield pa.RecordBatch.from_arrays(_lists(shard, found), names=["shard", "l", "r", "n", "pre", "suf"])

    return run


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            live = batch.column("live").slice(i, 1).flatten()
            l, r, n, gid = (live.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("l", "r", "n", "gid"))  # noqa: E741
            left, right = (_unpack(batch.column(c)[i].as_py()) for c in ("left", "right"))
            yield pa.RecordBatch.from_arrays(_lists(batch.column("shard")[i].as_py(), extend(left, right, l, r, n, gid)), names=["shard", "l", "r", "n", "pre", "suf"])


def _kept(df: DataFrame, tag: str, files: int | None = None) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path; ``files``: at most so many rows a file."""
    path, write = new_path(df.sparkSession, tag), df.write.option("compression", "zstd")
    (write.option("maxRecordsPerFile", files) if files else write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _numbered(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """``df`` written and read back with numbers from 0 without gaps in ``gid``, and their count; a count for each task that wrote rows comes to the driver."""
    kept, _ = _kept(df.withColumn("at", F.monotonically_increasing_id()), tag)
    first, total = [], 0
    for task, n in sorted(kept.groupBy(F.shiftright("at", 33)).count().collect()):
        first += [0] * (task - len(first)) + [total]
        total += n
    first = F.expr(f"array({', '.join(f'{x}L' for x in first or [0])})")
    gid = F.get(first, F.shiftright("at", 33).cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.select(gid.alias("gid"), *(c for c in kept.columns if c != "at")), total


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, shard_bytes: int = SHARD_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """One table for each length from 1 to ``longest`` (gid, lang, words, pre, suf, n, heads, tails) of the phrases found ``least`` times or more, and (lang, n).

    ``heads`` and ``tails`` are the counts of a phrase's first and last 1, 2, ... words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    shards, at = _kept(texts.mapInArrow(tidy(_shards(shard_bytes)), _SHARD), "shards", 2)
    words = shards.mapInArrow(tidy(_words(False)), _WORDS)
    sums, own = _kept(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "sums")
    totals, _ = _kept(sums.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    level = sums.where(F.col("n") >= least)
    level, total = _numbered(level.select("lang", F.array("word").alias("words"), F.lit(None).cast("long").alias("pre"), F.lit(None).cast("long").alias("suf"), "n", F.array("n").alias("heads"), F.array("n").alias("tails")), "words")
    discard(spark, own)
    levels = [level]
    parts = max(12, shards.count() // SHARDS_A_PART)
    if small := total <= BROADCAST_ROWS:
        found = level.select("lang", F.col("words")[0].alias("word"), "gid").toArrow()
        numbers: dict[str, dict[bytes, int]] = {}
        for lang, word, gid in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "gid")), strict=True):
            numbers.setdefault(lang, {})[word.encode()] = gid
        shared = spark.sparkContext.broadcast(numbers)
        built = shards.mapInArrow(tidy(_build(longest, shared)), f"{_FOUND}, left binary, right binary")
    else:
        known = shards.mapInArrow(tidy(_words(True)), "shard long, id int, lang string, word string").join(level.select("lang", F.col("words")[0].alias("word"), "gid"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("id", "gid")).alias("known"))
        built = shards.select("shard", "ids").join(known, "shard").mapInArrow(tidy(_build(longest)), f"{_FOUND}, left binary, right binary")
    built, index = _kept(built, "index", 2)
    discard(spark, at)
    flat = lambda df: df.select("shard", F.inline(F.arrays_zip("l", "r", "n", "pre", "suf")))
    paths, found, tables = [index], built, []
    for size in range(2, longest + 1):
        codes = Codes(total, parts)
        # frequent phrases of all lengths so far are broadcast, or the shards' phrases of this length are rows
        counts = built.mapInArrow(tidy(_walk(tables, codes)), _PARTS) if small and tables else found.select("pre", "suf", "n").mapInArrow(tidy(_dealt(codes)), _PARTS)
        sums = counts.repartitionById(parts, "part").mapInArrow(tidy(_sums(codes, least)), _COUNTS)
        a = level.select(F.col("gid").alias("pre"), "lang", "words", F.col("heads").alias("h"))
        b = level.select(F.col("gid").alias("suf"), F.element_at("words", -1).alias("last"), F.col("tails").alias("t"))
        now = sums.join(a, "pre").join(b, "suf")
        own = F.array("n")
        level, total = _numbered(now.select("lang", F.concat("words", F.array("last")).alias("words"), "pre", "suf", "n", F.concat("h", own).alias("heads"), F.concat("t", own).alias("tails")), f"phrases{size}")
        levels.append(level)
        if size == longest or not total:
            break
        if small and total > BROADCAST_ROWS:  # from here on by shuffling: the shards' phrases so far become rows
            small = False
            if tables:
                found, path = _kept(built.mapInArrow(tidy(_found(tables)), _FOUND), "found", 2)
                paths.append(path)
        if small:
            table = level.select("pre", "suf", "gid").toArrow()
            tables.append(spark.sparkContext.broadcast(Survivors(*(table.column(c).to_numpy() for c in ("pre", "suf", "gid")))))
            continue
        live = flat(found).join(level.select("pre", "suf", "gid"), ["pre", "suf"]).groupBy("shard").agg(F.collect_list(F.struct("l", "r", "n", "gid")).alias("live"))
        found, path = _kept(built.select("shard", "left", "right").join(live, "shard").mapInArrow(tidy(_step), _FOUND), "found", 2)
        paths.append(path)
    for path in paths:
        discard(spark, path)
    return levels, totals


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's ``top`` collocations by their weakest cut."""
    levels, totals = frequent_phrases(docs, least, longest, shard_bytes)
    found = reduce(DataFrame.unionByName, levels[1:])
    around = found.select(F.col("pre").alias("gid"), F.size("words").alias("size"), "n").unionByName(found.select(F.col("suf").alias("gid"), F.size("words").alias("size"), "n"))
    around = around.groupBy("gid", (F.col("size") - 1).alias("size")).agg(F.max("n").alias("most"))
    rows = found.withColumn("size", F.size("words")).join(around, ["gid", "size"], "left").where("most is null or most < n")
    rows = rows.withColumnRenamed("n", "a").join(totals, "lang")
    wide = lambda c, digits: f"cast({c} as decimal({digits}, 0))"
    score = f"cast(({wide('1000', 4)} * {wide('a', 17)} * {wide('n', 17)}) div ({wide('heads[j - 1]', 19)} * {wide('tails[size - j - 1]', 19)}) as bigint)"
    cut = F.expr(f"array_min(transform(sequence(1, size - 1), j -> struct({score} as score, j as j, heads[j - 1] as l, tails[size - j - 1] as r)))")
    rows = rows.withColumn("cut", cut).select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    best = (F.desc("score"), F.desc("a"), "phrase")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
