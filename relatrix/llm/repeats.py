"""Exact repeats of at least MIN bytes: winnowed anchors bring equal strings together, a BWT finds them.

1. Every window of MIN bytes is owned by its anchor, the K-byte string of least hash in it. Equal windows
   have equal anchors at equal places, so each run of windows with one anchor (a segment, up to 2 MIN - K
   bytes) only has to meet segments of the same anchor hash.
2. Of equal segments (same anchor, same bytes by a second 64-bit hash) all but the earliest are repeats whole.
   Each task settles its own first, COMBINE segments at a time, so an anchor or a passage that many documents share leaves a
   task once, not once a document; then all segments are dealt by anchor, sorted and read once.
3. The distinct segments of an anchor meet in a block. There a Burrows-Wheeler transform (sorted to 128
   bytes) is searched breadth-first: intervals of strings of length 0, 1, 2, ... are extended backwards,
   each setting the common-prefix values equal to its length, so values come by increasing size and the
   search stops at MIN. Places left unset share MIN bytes or more with their neighbour. In every such class
   all windows but the earliest are repeats.
4. An anchor with more distinct segments than a block holds is dealt over several blocks; the earliest
   window of each class then meets those of the other blocks by a 128-bit hash.

A document is a ``doc_id`` and a text: rows of one id with different texts are documents of their own (of these the one with
the smaller text hash is the earlier), equal rows of one id are one document, whose result each of them gets.

Cases: null and empty texts have no windows; texts under MIN bytes lose nothing; rows with a null ``doc_id``
lose nothing and count as no earlier place; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, pieces, prefix_hash, span_hash, stored, tidy, utf8

MIN, K, DEPTH = 100, 25, 128
BLOCK_SEGMENTS, COMBINE = 8192, 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
#: A segment (place: its first window * 128 + its number of windows), or with no windows a repeat from place / 128 to ``content``.
SEGMENT = "anchor long, content long, doc_id long, version long, place long"
#: A repeat (anchor is null), or a segment that other segments of its anchor differ from.
MEETING = "doc_id long, version long, lo int, hi int, anchor long, block int, several boolean"


def leftmost_least(gram: np.ndarray, span: int, slice_bits: int = 25) -> np.ndarray:
    """For each run of ``span`` hashes the place of its least one, the leftmost of equal ones; hashes are compared by their upper 38 bits.

    Keys of 64 bits hold hash and place, so the places are counted within slices, whatever the length of the text.
    """
    low, out = np.uint64(26), []
    for a in range(0, len(gram) - span + 1, 1 << slice_bits):
        part = gram[a : a + (1 << slice_bits) + span - 1]
        key = ((part >> low) << low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        out.append((key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64) + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def anchored_segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text index, anchor hash, content hash, first window, number of windows) of all segments of the texts."""
    span = MIN - K + 1
    found = []
    for a, b in chunks(texts):
        sizes = np.fromiter(map(len, texts[a:b]), dtype=np.int64, count=b - a)
        blob = np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)
        if len(blob) < MIN:
            continue
        offset = np.cumsum(sizes) - sizes
        prefix = prefix_hash(blob)
        at = np.arange(len(blob) - K + 1)
        gram = span_hash(prefix, at, at + K)
        least = leftmost_least(gram, span)  # for each window start
        doc = np.repeat(np.arange(b - a), np.maximum(sizes - MIN + 1, 0))
        own = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(sizes - MIN + 1, 0)) - np.maximum(sizes - MIN + 1, 0), np.maximum(sizes - MIN + 1, 0))
        start = offset[doc] + own
        anchor = least[start]
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([cut, [len(doc)]]))
        s = start[cut]
        content = mix(span_hash(prefix, s, s + count - 1 + MIN) + (anchor[cut] - s).astype(np.uint64) * ODD)
        found.append((doc[cut] + a, gram[anchor[cut]], content, own[cut], count))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])


def combine(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, version: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """The earliest of each kind of equal segments, and the others as repeated ranges, joined where they meet."""
    by = np.lexsort((content, anchor))
    same = (anchor[by[1:]] == anchor[by[:-1]]) & (content[by[1:]] == content[by[:-1]])
    group = np.cumsum(np.concatenate([[0], ~same])) if len(by) else np.zeros(0, np.int64)
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(by) else np.zeros(0, bool)
    at, group = by[shared], group[shared]
    order = np.lexsort((place[at], version[at], doc[at], group))
    at, group = at[order], group[order]
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(at) else np.zeros(0, bool)
    head = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))] if len(at) else at
    late = at[(doc[at] != doc[head]) | (version[at] != version[head]) | (place[at] != place[head])]
    stay = np.ones(len(anchor), bool)
    stay[at[~first]] = False  # rows at the same place as the first are the same segment
    late = late[np.lexsort((place[late], version[late], doc[late]))]
    lo = place[late] >> 7
    hi = lo + (place[late] & 127) - 1 + MIN
    d, v = doc[late], version[late]
    begin = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (lo[1:] > hi[:-1])])) if len(late) else np.zeros(0, np.int64)
    end = np.concatenate([begin[1:], [len(late)]])[: len(begin)] - 1
    spread = mix(d[begin].astype(np.uint64) + lo[begin].astype(np.uint64) * ODD).view(np.int64)  # any task may take a repeat
    columns = ((anchor[stay], spread), (content[stay], hi[end]), (doc[stay], d[begin]), (version[stay], v[begin]), (place[stay], lo[begin] << 7))
    return _batch(SEGMENT, *(np.concatenate(c).astype(np.int64) for c in columns))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for part in pieces(batch):
            row, anchor, content, first, count = anchored_segments(utf8(part.column("text")))
            row, (ids, versions) = row.astype(np.int64), (part.column(c).to_numpy() for c in ("doc_id", "version"))
            held.append((anchor.astype(np.uint64).view(np.int64), content.astype(np.uint64).view(np.int64), ids[row], versions[row], (first.astype(np.int64) << 7) | count.astype(np.int64)))
            size += len(row)
            if size >= COMBINE:
                yield combine(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield combine(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by all columns: repeats leave as they are found, and segments of anchors that have others.

    Of the last anchor at most a block of segments is held back.
    """
    last: np.ndarray | None = None  # the earliest row of the kind that the previous batch ended with
    held = np.zeros((5, 0), np.int64)
    blocks = 0  # whole blocks of the held anchor that have left

    def meeting(rows: np.ndarray, block: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
        lo = rows[4] >> 7
        return _batch(MEETING, rows[2], rows[3], lo.astype(np.int32), (lo + (rows[4] & 127) - 1 + MIN).astype(np.int32), rows[0], block.astype(np.int32), several)

    def leave(rows: np.ndarray, ended: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, blocks
        edge = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        size = np.diff(np.concatenate([edge, [rows.shape[1]]]))
        stop = rows.shape[1] if ended else int(edge[-1])
        owner = np.repeat(np.arange(len(edge)), size)
        before = np.zeros(len(edge), np.int64)
        before[0] = blocks
        nth = before[owner] * BLOCK_SEGMENTS + np.arange(rows.shape[1]) - edge[owner]
        total = size + before * BLOCK_SEGMENTS
        if not ended:  # of the anchor that may go on, whole blocks leave once there are more
            more = max(0, int(size[-1]) - 1) // BLOCK_SEGMENTS
            stop += more * BLOCK_SEGMENTS
        go = np.flatnonzero((total > 1)[owner[:stop]])
        if len(go):
            yield meeting(rows[:, go], nth[go] // BLOCK_SEGMENTS, (total > BLOCK_SEGMENTS)[owner[go]])
        if not ended:
            blocks = more + (blocks if len(edge) == 1 else 0)
            held = rows[:, stop:]

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in range(5)])
        whole = (rows[4] & 127) == 0
        if whole.any():
            r = rows[:, whole]
            none = pa.nulls(r.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r[2]), pa.array(r[3]), pa.array((r[4] >> 7).astype(np.int32)), pa.array(r[1].astype(np.int32)), none, none.cast(pa.int32()), none.cast(pa.bool_())], names=[f.split()[0] for f in MEETING.split(", ")])
            rows = rows[:, ~whole]
        if not rows.shape[1]:
            continue
        new = np.concatenate([[last is None or (rows[:2, 0] != last[:2]).any()], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
        origin = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        head = rows[:, np.maximum(origin, 0)]
        if last is not None:
            head[:, origin < 0] = last[:, None]
        again = ~new & (rows[2:] != head[2:]).any(axis=0)
        if again.any():
            r = rows[:, again]
            lo, none = r[4] >> 7, pa.nulls(r.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r[2]), pa.array(r[3]), pa.array(lo.astype(np.int32)), pa.array((lo + (r[4] & 127) - 1 + MIN).astype(np.int32)), none, none.cast(pa.int32()), none.cast(pa.bool_())], names=[f.split()[0] for f in MEETING.split(", ")])
        last = head[:, -1].copy()
        held = np.concatenate([held, rows[:, new]], axis=1)
        if held.shape[1]:
            yield from leave(held, False)
    if held.shape[1]:
        yield from leave(held, True)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the text sorted by their next DEPTH symbols (prefix doubling), ties by place."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | np.minimum(padded[j : j + n], np.uint64(255))
    width = 8
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if width >= DEPTH or rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + later
        width *= 2


def common_prefix_bounds(text: np.ndarray, order: np.ndarray, least: int = MIN) -> np.ndarray:
    """True where a place of the sorted order shares fewer than ``least`` symbols with the one before it.

    Breadth-first interval expansion on the Burrows-Wheeler transform: an interval [l, r) holds the places
    where a string w starts; its symbols' places map (LF) to the intervals of c + w. A right end not yet
    set gets the value |w|; the interval is expanded further only then.
    """
    n = len(text)
    bwt = text[order - 1]  # the text is taken as a circle; separators keep strings inside segments
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    low = np.zeros(n + 1, bool)
    low[0] = low[n] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(least):
        size = right - left
        place = np.repeat(left - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner = np.repeat(np.arange(len(left)), size)
        image = lf[place]
        by = np.argsort(image, kind="stable")
        image, owner, sym = image[by], owner[by], bwt[place[by]]
        edge = np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1] + 1) | (owner[1:] != owner[:-1]) | (sym[1:] != sym[:-1])]))
        left = image[edge]
        right = left + np.diff(np.concatenate([edge, [len(image)]]))
        fresh = ~low[right]
        low[right] = True
        left, right = left[fresh], right[fresh]
        if not len(left):
            break
    return low[:n]


def repeated_windows(segments: list[bytes], docs: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, window) of each window that starts earlier elsewhere in the block, and the others' mask.

    Returns arrays over all windows of the block: segment index, window number, repeated or not.
    """
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    text = np.frombuffer(b"".join([s + b"\0" for s in segments]), dtype=np.uint8).astype(np.int64) + 1
    offset = np.cumsum(sizes + 1) - sizes - 1
    text[offset + sizes] = 0
    order = suffix_order(text)
    group = np.cumsum(common_prefix_bounds(text, order)) - 1
    segment = np.repeat(np.arange(len(segments)), sizes + 1)
    inside = np.arange(len(text)) - offset[segment]
    window = inside + MIN <= sizes[segment]
    # earliest place: by document, then by start
    rank = np.empty(len(text), np.int64)
    rank[np.lexsort((firsts[segment] + inside, docs[segment]))] = np.arange(len(text))
    best = np.full(int(group[-1]) + 1, len(text), np.int64)
    ok = window[order]
    np.minimum.at(best, group[ok], rank[order[ok]])
    again = np.zeros(len(text), bool)
    again[order[ok]] = rank[order[ok]] > best[group[ok]]
    at = np.flatnonzero(window)
    return segment[at], inside[at], again[at]


def _runs(flag: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True within equal keys."""
    on = np.flatnonzero(flag)
    if not len(on):
        return on, on
    cut = np.concatenate([[True], (np.diff(on) != 1) | (key[on[1:]] != key[on[:-1]])])
    return on[cut], on[np.concatenate([cut[1:], [True]])]


SPAN = "doc_id long, version long, lo int, hi int, hash binary"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, block, place): whole groups are taken together up to BLOCK_SEGMENTS segments."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        doc, version, firsts = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
        by = np.lexsort((version, doc))
        rank = np.empty(len(rows), np.int64)
        rank[by] = np.cumsum(np.concatenate([[0], (doc[by[1:]] != doc[by[:-1]]) | (version[by[1:]] != version[by[:-1]])]))
        seg, win, again = repeated_windows([r[5] for r in rows], rank, firsts)
        a, b = _runs(again, seg)
        heads = np.flatnonzero(~again & np.array([r[6] for r in rows])[seg])
        of = np.concatenate([seg[a], seg[heads]])
        lo = firsts[of] + np.concatenate([win[a], win[heads]])
        hi = np.concatenate([firsts[seg[b]] + win[b], firsts[seg[heads]] + win[heads]]) + MIN
        hashes = [None] * len(a) + [xxhash.xxh3_128_digest(rows[seg[i]][5][win[i] : win[i] + MIN]) for i in heads]
        return pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(version[of]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(hashes, pa.binary())], names=["doc_id", "version", "lo", "hi", "hash"])

    held: list[tuple] = []
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "block", "doc_id", "version", "first", "bytes", "several")), strict=True):
            if group and group[-1][:5] == row[:5]:  # equal rows of the table
                continue
            if group and group[-1][:2] != row[:2]:
                held += group
                group = []
                if len(held) >= BLOCK_SEGMENTS:
                    yield solve(held)
                    held = []
            group.append(row)
    if held or group:
        yield solve(held + group)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            out: list[list] = [[], [], [], [], [], [], []]
            for doc, version, text, wanted in zip(part.column("doc_id").to_pylist(), part.column("version").to_pylist(), utf8(part.column("text")), part.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    row = (w["anchor"], w["block"], w["several"], doc, version, w["lo"], text[w["lo"] : w["hi"]])
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["anchor", "block", "several", "doc_id", "version", "first", "bytes"])


def _versions(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, version, lo, hi): byte ranges covered by repeats; ranges of one document may overlap."""
    docs = docs.where("doc_id is not null")
    segments = docs.mapInArrow(tidy(_segments), SEGMENT)
    met = stored(segments.repartition("anchor").sortWithinPartitions("anchor", "content", "doc_id", "version", "place").mapInArrow(tidy(_meet), MEETING), "meetings")
    wanted = met.where("anchor is not null").groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "block", "several", "lo", "hi")).alias("wanted"))
    fetched = docs.join(wanted, ["doc_id", "version"]).mapInArrow(tidy(_fetch), "anchor long, block int, several boolean, doc_id long, version long, first int, bytes binary")
    found = stored(fetched.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "doc_id", "version", "first").mapInArrow(tidy(_search), SPAN), "spans")
    heads = found.where("hash is not null")
    best = heads.groupBy("hash").agg(F.min(F.struct("doc_id", "version", "lo")).alias("at"))
    across = heads.join(best, "hash").where("doc_id <> at.doc_id or version <> at.version or lo <> at.lo")
    parts = [met.where("anchor is null"), found.where("hash is null"), across]
    return reduce(DataFrame.unionByName, [p.select("doc_id", "version", "lo", "hi") for p in parts])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces(whole)):
        spans_out, removed, size, sha, kept = [], [], [], [], []
        for text, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            runs: list[list[int]] = []
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            parts, at = [], 0
            for lo, hi in runs:
                parts.append(text[at:lo])
                at = hi
            rest = b"".join([*parts, text[at:]])
            size.append(len(text))
            removed.append(len(text) - len(rest))
            spans_out.append([{"lo": lo, "hi": hi} for lo, hi in runs])
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_out, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed ranges), kept_sha256 and kept (bytes) of every document."""
    docs = _versions(docs)
    spans = repeated_spans(docs).groupBy("doc_id", "version").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = docs.join(spans, ["doc_id", "version"], "left")
    return rows.mapInArrow(tidy(_cut), "doc_id long, n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>, kept_sha256 string, kept binary")
