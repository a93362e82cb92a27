"""Ranked lexical search: an Aho-Corasick automaton of all items' terms reads the documents, without an index of them.

Terms are the maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. In bytes, every other
character becomes one space, and a pattern is a term between two spaces: the guards keep a term from matching inside
a longer one, and since the automaton reports overlapping matches, neighbours may share a guard. The automaton is built from a
broadcast list of terms; its outputs are term numbers, which a sparse table maps to the items that hold them.

One scan writes each document's length and its (term, tf) hits. Document frequencies, N and L are sums over those hits;
then tasks score slices of documents against all items of the block by numpy, in 64-bit integers, and keep the best ``top``
for each item before anything is shuffled.

Bounds: items are dealt to blocks by a hash of their id, as many blocks as keep each within BLOCK_BYTES of distinct (item, term) rows
(a single item may be longer); a block's terms are what the driver gathers and broadcasts, and each block scans the documents once.

Cases: null and empty texts have no terms and are not among the N documents; rows without doc_id count in N, L and df but are not
ranked; rows of one doc_id are documents of their own; rows without item_id are left out and rows of one item_id are one
item with all their terms; items without terms, or whose terms no document holds, have no rows; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, new_path, pieces, tidy, utf8

#: Bytes of one block's (item, term) rows, 16 of overhead counted for each.
BLOCK_BYTES = 16 << 20
#: Cells of the (documents x items) table of scores that a task holds at once, and hits spread over items at once.
CELLS, SPREAD = 1 << 21, 1 << 21
_TERM = "[^\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]+"
#: Byte table: ASCII letters lower-cased, digits and bytes of non-ASCII characters as they are, all else a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_HITS = "doc_id long, n long, terms array<int>, tfs array<int>"
_BUILT: dict[str, ahocorasick.Automaton] = {}


class Block(NamedTuple):
    """A block of items: terms, and for each term (by first and next place) the items that hold it."""

    key: str
    terms: list[bytes]
    first: np.ndarray
    holders: np.ndarray
    items: np.ndarray


def automaton(block: Block) -> ahocorasick.Automaton:
    """The block's automaton, built once for each Python worker."""
    if block.key not in _BUILT:
        _BUILT.clear()
        own = ahocorasick.Automaton()
        for i, term in enumerate(block.terms):
            own.add_word(f" {term.decode('latin-1')} ", i)
        own.make_automaton()
        _BUILT[block.key] = own
    return _BUILT[block.key]


def _scan(shared):
    """Hits of each document that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, value = automaton(shared.value), itemgetter(1)
        for batch in (part for whole in batches for part in pieces(whole)):
            keep, n, sizes, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(utf8(batch.column("text"))):
                spaced = text.translate(_BYTES)
                if not (length := len(spaced.split())):
                    continue
                found = Counter(map(value, own.iter(f" {spaced.decode('latin-1')} ")))
                keep.append(i)
                n.append(length)
                terms += found.keys()
                tfs += found.values()
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


class Best:
    """The ``top`` best (score, doc_id) of each item so far."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.floor = top, np.ones(items, dtype=np.int64)
        self.item = self.doc = self.score = np.zeros(0, dtype=np.int64)

    def add(self, table: np.ndarray, docs: np.ndarray) -> None:
        low = self.floor
        if len(table) > self.top:
            low = np.maximum(low, np.partition(table, len(table) - self.top, axis=0)[len(table) - self.top])
        d, i = np.nonzero(table >= low)
        item, doc, score = np.concatenate([self.item, i]), np.concatenate([self.doc, docs[d]]), np.concatenate([self.score, table[d, i]])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.top - 1
        self.floor[item[last]] = score[last]
        keep = place < self.top
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]


def _rank(shared, weights: np.ndarray, docs: int, length: int, top: int):
    """Each task's best documents for every item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        items, many = len(block.items), np.diff(block.first)
        best = Best(items, top)
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in batch.column("terms")])]).astype(np.int64)
            term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
            ids, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "n"))
            m = 10 + (90 * n * docs) // length
            part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(ends))))
            spread = np.concatenate([[0], np.cumsum(many[term])])[ends]  # of the rows before each document
            a = 0
            while a < len(ids):
                b = max(a + 1, min(a + max(1, CELLS // items), int(np.searchsorted(spread, spread[a] + SPREAD, "right")) - 1))
                t, times = term[ends[a] : ends[b]], many[term[ends[a] : ends[b]]]
                held = block.holders[np.repeat(block.first[t], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                row = np.repeat(np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), times)
                table = np.zeros((b - a) * items, dtype=np.int64)
                np.add.at(table, row * items + held, np.repeat(part[ends[a] : ends[b]], times))
                best.add(table.reshape(b - a, items), ids[a:b])
                a = b
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block.items[best.item], best.doc, best.score)], names=["item_id", "doc_id", "score"])

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    found = F.expr(f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}', 0)")
    return items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term")).distinct()


def blocks(rows: DataFrame, limit: int) -> Iterator[Block]:
    """The items' terms in blocks of at most ``limit`` bytes each, or of one item."""
    size = F.sum(F.octet_length("term") + 16)
    total, count = rows.agg(size).first()[0] or 0, 1
    while total:
        count = max(count, -(-total // limit))
        at = F.expr(f"pmod(xxhash64(item_id), {count})").alias("block")
        worst = rows.groupBy(at).agg(size.alias("bytes"), F.count_distinct("item_id").alias("items")).where("items > 1").agg(F.max("bytes")).first()[0]
        if (worst or 0) <= limit:
            break
        count *= 2
    for b in range(count if total else 0):
        held = [(r["term"].encode(), r["item_id"]) for r in rows.where(at == b).toLocalIterator()]
        if held:
            terms, items = sorted({t for t, _ in held}), sorted({i for _, i in held})
            number = {t: i for i, t in enumerate(terms)}
            term, item = np.array([number[t] for t, _ in held]), np.searchsorted(items, [i for _, i in held])
            yield Block(new_path(rows.sparkSession, "block"), terms, np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))]), item[np.argsort(term, kind="stable")], np.array(items, dtype=np.int64))


def search(docs: DataFrame, items: DataFrame, top: int = 10, limit: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score above 0."""
    spark, found = docs.sparkSession, []
    terms = item_terms(items)
    terms.write.parquet(path := new_path(spark, "terms"))
    for block in blocks(spark.read.schema(terms.schema).parquet(path), limit):
        shared = spark.sparkContext.broadcast(block)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        texts.mapInArrow(tidy(_scan(shared)), _HITS).write.option("compression", "zstd").parquet(hits := new_path(spark, "hits"))
        seen = spark.read.schema(_HITS).parquet(hits)
        n, length = seen.agg(F.count("*"), F.sum("n")).first()
        if not n:
            continue
        weights = np.zeros(len(block.terms), dtype=np.int64)
        for r in seen.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # at most the block's terms
            weights[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["count"] + 1)))
        best = seen.where("doc_id is not null and size(terms) > 0").mapInArrow(tidy(_rank(shared, weights, n, length, top)), "item_id long, doc_id long, score long")
        best.write.parquet(own := new_path(spark, "best"))
        discard(spark, hits)
        found.append(spark.read.schema("item_id long, doc_id long, score long").parquet(own))
    discard(spark, path)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
