"""Packing by the online sum-of-squares rule.

Each task packs the documents it reads. A level array N counts the open windows by fill level; a document
of length n goes to the level h (0: a new window) for which moving one window from h to h + n leaves the
smallest sum of squared counts. Documents longer than a window first fill whole windows, and their rest is
placed like any document. When a task ends, its open windows are closed: the emptier ones are poured, cut
where needed, into the fuller ones, and the one left over is cut at powers of two, which need no padding.
Work needs no shuffle; a task keeps its open windows' piece lists only, never token ids.

Cases: null and empty texts are one end token; repeated rows and ids are packed once per row; a null
``doc_id`` is packed like any other; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidy
from .tokens import default_tokenizer, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Sum-of-squares placing of (document, length) into windows of ``size`` tokens."""

    def __init__(self, size: int = 2048) -> None:
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)  # count[h]: open windows at fill level h
        self.open: dict[int, list[list]] = {}
        self.done: list[list] = []  # windows as lists of (key, start, length)

    def place(self, key: int, start: int, length: int) -> None:
        while length >= self.size:
            self.done.append([(key, start, self.size)])
            start, length = start + self.size, length - self.size
        if not length:
            return
        top = self.size - length
        # change of the sum of squares when one window moves from level h to h + length; level 0 is unlimited
        gain = self.count[length : self.size + 1] * 2 + 1
        gain[1:] += 1 - 2 * self.count[1 : top + 1]
        gain[top] = 1 - 2 * self.count[top] if top else 0  # full windows leave the array
        gain[1:][self.count[1 : top + 1] == 0] = 1 << 60
        at = int(np.flatnonzero(gain == gain.min())[-1])
        window = self._take(at) if at else []
        window.append((key, start, length))
        self._put(at + length, window)

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        return self.open[level].pop()

    def _put(self, level: int, window: list) -> None:
        if level == self.size:
            self.done.append(window)
        else:
            self.count[level] += 1
            self.open.setdefault(level, []).append(window)

    def close(self) -> list[list]:
        """All windows; of the open ones, the emptier fill up the fuller."""
        rest = [w for level in sorted(self.open) for w in self.open[level]]
        fill = [sum(p[2] for p in w) for w in rest]
        low, high = 0, len(rest) - 1
        while low < high:
            room = self.size - fill[high]
            while room and low < high:
                key, start, length = rest[low].pop()
                take = min(room, length)
                if take < length:
                    rest[low].append((key, start, length - take))
                rest[high].append((key, start + length - take, take))
                room, fill[low] = room - take, fill[low] - take
                if not fill[low]:
                    low += 1
            if room:
                break
            self.done.append(rest[high])
            high -= 1
        if low <= high and low < len(rest):
            last, window = [], rest[high] if low == high else []
            for key, start, length in window:
                last.append((key, start, length))
            self.done += self._powers(last)
        self.open.clear()
        self.count[:] = 0
        return self.done

    @staticmethod
    def _powers(pieces: list) -> list[list]:
        left, out = sum(p[2] for p in pieces), []
        pieces = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            out.append([])
            while room:
                key, start, length = pieces.pop()
                take = min(room, length)
                out[-1].append((key, start, take))
                if take < length:
                    pieces.append((key, start + take, length - take))
                room -= take
        return out


def _pack(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, task, made = encoder(path), Packer(size), TaskContext.get().partitionId(), 0
        ids: dict[int, tuple] = {}  # row -> (doc_id, ids); dropped once all its tokens are in closed windows
        owed: dict[int, int] = {}
        tail = np.array([end], dtype="<u4").tobytes()

        def flush(windows: list) -> pa.RecordBatch:
            nonlocal made
            rows = []
            for w in windows:
                offset = 0
                for key, start, length in w:
                    doc, data = ids[key]
                    rows.append((doc, start, length, zlib.crc32(memoryview(data)[4 * start : 4 * (start + length)]), len(data) // 4, (task << 36) + made, offset))
                    offset += length
                    owed[key] -= length
                    if not owed[key]:
                        del ids[key], owed[key]
                made += 1
            windows.clear()
            cols = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])

        row = 0
        for batch in (part for whole in batches for part in pieces(whole)):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = enc.ids(text) + tail
                ids[row], owed[row] = (doc, data), len(data) // 4
                packer.place(row, 0, len(data) // 4)
                row += 1
                if len(packer.done) >= 4096:
                    yield flush(packer.done)
        yield flush(packer.close())

    return run


def pack_documents(docs: DataFrame, size: int = 2048, end: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens; ``tokenizer`` is a vocabulary file every executor has."""
    path = tokenizer or default_tokenizer()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_pack(path, size, end)), PIECES)
