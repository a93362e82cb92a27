"""Token-ID output in a Re-Pair grammar file, and random-access reading.

Documents are range-partitioned by ``doc_id`` and sorted; each task cuts its run into blocks of about
``BLOCK_IDS`` ids. Within a block, rounds of Re-Pair replace every pair of symbols that occurs ``LEAST`` times or
more by a nonterminal, until no pair does (pairs never span documents). A block is one row of the table in
the shared folder:

    part, block, doc_ids, no_id (documents whose id is null), offsets (symbols before each document, and
    all), n_ids of each document, terms (the distinct ids), symbols, rules (pairs of symbols), spans (ids
    each rule expands to)

all little-endian. Symbol s is the id terms[s], or rule s - len(terms); symbols and rules take two bytes each
where a block has no more than 65536 symbols, else four. A document is read by expanding only its own
symbols; ``slice_ids`` uses the spans to skip whole nonterminals before the wanted offset.

Cases: null and empty texts are the end id alone; rows of a repeated id are written in any order among
themselves; null ids come first; an empty table gives an empty file and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, pieces, tidy
from .tokens import default_tokenizer, encoder

BLOCK_IDS, LEAST = 1 << 20, 8
FILE = "part int, block int, block_ids long, doc_ids binary, no_id binary, offsets binary, n_ids binary, terms binary, symbols binary, rules binary, spans binary"


def _repeated(sym: np.ndarray, at: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, ...] | None:
    """(places of repeated pairs, their pair numbers, left and right symbol of each pair); None if no pair is left.

    ``at``: the places whose pairs may be repeated. Pairs are counted by sorting (pair, place) packed in 64 bits.
    """
    code = sym[at] * np.int64(symbols) + sym[at + 1]
    if len(at) > 1 << 16:  # a small table of hashed counts first drops pairs that cannot be frequent
        slot = ((code * 0x9E3779B1) >> 7) & 0xFFFFF
        kept = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= least)
        code, at = code[kept], at[kept]
    if not len(at):
        return None
    bits = int(len(sym)).bit_length()
    if bits + 2 * int(symbols).bit_length() < 64:
        packed = np.sort((code << bits) | at)
        code, at = packed >> bits, packed & ((1 << bits) - 1)
    else:
        by = np.argsort(code, kind="stable")
        code, at = code[by], at[by]
    edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    n = np.diff(np.concatenate([edge, [len(code)]]))
    many = n >= least
    if not many.any():
        return None
    pair = code[edge[many]]
    at = at[np.repeat(many, n)]
    number = np.full(len(sym), -1, np.int64)
    number[at] = np.repeat(np.arange(len(pair)), n[many])
    at = np.flatnonzero(number >= 0)
    return at, number[at], pair // symbols, pair % symbols


def repair(ids: np.ndarray, docs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their documents, terms, rules, spans) of one block."""
    terms = np.flatnonzero(np.bincount(ids, minlength=1))  # ids are numbers of a vocabulary
    place = np.zeros(int(terms[-1]) + 1 if len(terms) else 0, np.int64)
    place[terms] = np.arange(len(terms))
    sym, length = place[ids], np.ones(len(terms), np.int64)
    rules = np.zeros((0, 2), np.int64)
    live = np.ones(len(sym), dtype=bool)  # a pair that is too rare stays so; only pairs with a new symbol are looked at again
    while len(sym) > 1:
        live[:-1] &= docs[1:] == docs[:-1]
        live[-1] = False
        found = _repeated(sym, np.flatnonzero(live), len(length), least)
        if found is None:
            break
        at, which, left, right = found
        live[:] = False
        live[at] = True
        # of overlapping hits in a run, every other one is taken, from the left
        nth = np.arange(len(at))
        nth -= np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(at) != 1]), nth, 0))
        at, which = at[nth % 2 == 0], which[nth % 2 == 0]
        # a pair whose places mostly went to its neighbours is left for a later round
        used = np.bincount(which, minlength=len(left)) >= max(2, least // 2)
        if not used.any():
            break
        at, which = at[used[which]], (np.cumsum(used) - 1)[which[used[which]]]
        left, right = left[used], right[used]
        sym[at] = len(length) + which
        live[at] = live[np.maximum(at - 1, 0)] = True
        rules = np.concatenate([rules, np.stack([left, right], axis=1)])
        length = np.concatenate([length, length[left] + length[right]])
        stay = np.ones(len(sym), dtype=bool)
        stay[at + 1] = False
        sym, docs, live = sym[stay], docs[stay], live[stay]
    kind = "<u2" if len(length) <= 1 << 16 else "<u4"
    return sym.astype(kind), docs, terms.astype("<u4"), rules.astype(kind), length[len(terms) :].astype("<u4")


def expansions(terms: np.ndarray, rules: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all symbols one after another, where each symbol's begin); rules only use earlier symbols."""
    n = len(terms)
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.ones(n, np.int64), spans.astype(np.int64)]))])
    flat = np.empty(int(begin[-1]), dtype="<u4")
    flat[:n] = terms
    left, right = rules[:, 0].astype(np.int64), rules[:, 1].astype(np.int64)
    level = np.zeros(n + len(rules), np.int64)  # rounds of rules: each level only needs the ones before
    ready, made = n, n
    while made < len(level):
        # rules are stored in order, so the ones whose parts are below ``ready`` are a prefix of the rest
        late = np.flatnonzero(np.maximum(left[made - n :], right[made - n :]) >= ready)
        stop = made + (int(late[0]) if len(late) else len(level) - made)
        for part, shift in ((left[made - n : stop - n], None), (right[made - n : stop - n], left[made - n : stop - n])):
            size = begin[part + 1] - begin[part]
            first = begin[made:stop] + (0 if shift is None else begin[shift + 1] - begin[shift])
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            flat[np.repeat(first, size) + inner] = flat[np.repeat(begin[part], size) + inner]
        ready = made = stop
    return flat, begin


def expand(symbols: np.ndarray, terms: np.ndarray, rules: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Ids that the symbols stand for."""
    flat, begin = expansions(terms, rules, spans)
    sym = symbols.astype(np.int64)
    size = begin[sym + 1] - begin[sym]
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return flat[np.repeat(begin[sym], size) + inner]


def slice_ids(symbols: np.ndarray, terms: np.ndarray, rules: np.ndarray, spans: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a document without expanding the symbols before and after them."""
    width = np.concatenate([np.ones(len(terms), np.int64), spans.astype(np.int64)])[symbols]
    ends = np.cumsum(width)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    before = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], terms, rules, spans)[start - before : stop - before]


def _write(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, block = encoder(path), TaskContext.get().partitionId(), 0
        tail = np.array([end], dtype="<u4").tobytes()
        held, docs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs, size, block
            lengths = np.array([len(x) // 4 for x in held], dtype="<i8")
            sym, owner, terms, rules, spans = repair(np.frombuffer(b"".join(held), dtype="<u4"), np.repeat(np.arange(len(held)), lengths))
            offsets = np.searchsorted(owner, np.arange(len(held) + 1)).astype("<i8")
            keys = np.array([d or 0 for d in docs], dtype="<i8")
            row = [part, block, int(lengths.sum()), *(x.tobytes() for x in (keys, np.array([d is None for d in docs], "u1"), offsets, lengths, terms, sym, rules, spans))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 8]
            held, docs, size, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in FILE.split(", ")])

        for batch in (part for whole in batches for part in pieces(whole)):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = enc.ids(text) + tail
                held.append(ids)
                docs.append(doc)
                size += len(ids) // 4
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, end: int = 2, tokenizer: str | None = None) -> None:
    """Write the ids of all documents in ascending ``doc_id`` order as grammar blocks under ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(tidy(_write(tokenizer or default_tokenizer(), end)), FILE).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name, kind, i=i, batch=batch: np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind)
            offsets, n_ids, keys, none = get("offsets", "<i8"), get("n_ids", "<i8"), get("doc_ids", "<i8"), get("no_id", "u1")
            terms, spans = get("terms", "<u4"), get("spans", "<u4")
            kind = "<u2" if len(terms) + len(spans) <= 1 << 16 else "<u4"
            data = expand(get("symbols", kind), terms, get("rules", kind).reshape(-1, 2), spans).tobytes()
            ends = np.cumsum(n_ids)
            crc = [zlib.crc32(memoryview(data)[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), n_ids.tolist(), strict=True)]
            size = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, mask=none == 1), pa.array(np.full(size, batch.column("part")[i].as_py(), np.int32)), pa.array(np.full(size, batch.column("block")[i].as_py(), np.int32)),
                    pa.array(ends - n_ids), pa.array(n_ids), pa.array(crc, pa.int64()), pa.array(np.diff(offsets)),
                ],
                names=["doc_id", "part", "block", "within", "n_tokens", "ids_crc32", "n_symbols"],
            )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, n_symbols (stored symbols)."""
    blocks = spark.read.schema(FILE).parquet(path)
    sums = blocks.select("part", "block", "block_ids")
    # ids before a part: one row for each task that wrote; ids before a block: within its part
    parts = sums.groupBy("part").agg(F.sum("block_ids").alias("ids"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before_part"))
    firsts = sums.select(F.col("part").alias("p"), F.col("block").alias("b"), (F.sum("block_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("block_ids")).alias("before_block"))
    firsts = firsts.join(parts, "p")
    rows = blocks.mapInArrow(tidy(_read), "doc_id long, part int, block int, within long, n_tokens long, ids_crc32 long, n_symbols long")
    rows = rows.join(firsts, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
    return rows.select("doc_id", (F.col("before_part") + F.col("before_block") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "n_symbols")


def round_trip(docs: DataFrame, end: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Write the grammar files to the shared folder and read every document back from them."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, end, tokenizer)
    return read_ids(docs.sparkSession, path)
