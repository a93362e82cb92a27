"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find groups.

Each element of a set walks a random permutation of the signature's places; the value it offers at its
k-th place is k plus a fraction in [0, 1). After k steps every place below k + 1 is final, so a set stops
as soon as its largest value is (early stopping); large sets stop after one or two steps.

Cases: null or wordless texts have an empty set, link with nothing and keep their own id; fewer words
than a shingle give one shingle; equal sets are one node from the start; rows with a null ``doc_id`` take
no part in linking and come back with a null component; repeated ids come back as often as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ORDER, chunks, components, cut, mix, pieces, shingles, stored, tidy, utf8

PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
_STEPS = np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: 1024 random permutations of the places; an element's walk is one of them, rotated by the element.
_WALKS = np.argsort(np.random.default_rng(7).random((1024, PLACES)), axis=1).astype(np.int64)


def superminhash(element: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """Signatures (sets x PLACES): step number in the top 8 bits, fraction below."""
    sig = np.full(sets * PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    walk, turn = (element & np.uint64(1023)).astype(np.int64), ((element >> np.uint64(40)) % np.uint64(PLACES)).astype(np.int64)
    for k in range(PLACES):
        place = (_WALKS[walk, k] + turn) % PLACES
        value = (np.uint64(k) << np.uint64(56)) | (mix(element + _STEPS[k]) >> np.uint64(8))
        np.minimum.at(sig, owner * PLACES + place, value)
        open_ = sig.reshape(sets, PLACES).max(axis=1) >= np.uint64(k + 1) << np.uint64(56)
        if k + 1 == PLACES or not (left := open_[owner]).any():
            break
        if not left.all():
            element, owner, walk, turn = element[left], owner[left], walk[left], turn[left]
    return sig.reshape(sets, PLACES)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    return mix((parts * ORDER[:ROWS]).sum(axis=2, dtype=np.uint64) + ORDER[8] * np.arange(1, BANDS + 1, dtype=np.uint64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces(whole)):
        texts, ids = utf8(batch.column("text")), batch.column("doc_id")
        for a, b in chunks(texts, 1 << 21):
            sets = shingles(texts[a:b])
            sizes = np.fromiter(map(len, sets), dtype=np.int64, count=b - a)
            full = np.flatnonzero(sizes)
            keys = np.zeros((0, BANDS), dtype=np.uint64)
            if len(full):
                sig = superminhash(np.concatenate([sets[i] for i in full]), np.repeat(np.arange(len(full)), sizes[full]), len(full))
                keys = band_keys(sig)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a).cast(pa.int64()),
                    pa.array(sizes),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces(whole)):
        texts = utf8(batch.column("text"))
        for a, b in chunks(texts, 1 << 22):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array([s.tobytes() for s in shingles(texts[a:b])], pa.binary())], names=["doc_id", "shingle_set"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _link_apart(percent: int):
    """Links between the components of one bucket (or two blocks of it), from the full sets of its members.

    A member meets all later ones at once: the elements of the others are looked up in its own. Rows of the
    largest component come last, so they are never compared among themselves; a link joins two components
    at once, and what is one component is not compared further.
    """

    def run(rows: pa.Table) -> pa.Table:
        comp = rows["comp"].to_numpy()
        _, which, count = np.unique(comp, return_inverse=True, return_counts=True)
        order = np.lexsort((comp, count[which]))
        comp, held = comp[order].copy(), rows["shingle_set"].to_pylist()
        sets = [np.frombuffer(held[i], dtype=np.uint64) for i in order]
        n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        at = np.concatenate([[0], np.cumsum(n)])
        elements, flat = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.zeros(len(elements), dtype=bool)
        u, v = [], []
        for i in range(len(sets) - 1):
            near = np.flatnonzero((comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))) + i + 1
            if not len(near):
                continue
            lo, hi = near[0], near[-1] + 1
            mine = flat[at[i] : at[i + 1]]
            own[mine] = True
            shared = np.add.reduceat(own[flat[at[lo] : at[hi]]], at[lo:hi] - at[lo], dtype=np.int64)[near - lo]
            own[mine] = False
            for c in np.unique(comp[near[100 * shared >= percent * (n[i] + n[near] - shared)]]):
                u.append(int(comp[i]))
                v.append(int(c))
                comp[comp == c] = comp[i]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _blocks(rows: DataFrame, members: int, elements: int) -> DataFrame:
    """``rows`` with a ``block``: a bucket within both bounds is one block, of a larger one every two parts are."""
    load = rows.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("e"))
    parts = F.ceil(F.greatest(F.col("c") / members, F.col("e") / elements)).cast("int")
    rows = rows.join(load.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), "parts").cast("int"))
    pair = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part")), lambda p: F.least(p, F.col("part")) * F.col("parts") + F.greatest(p, F.col("part")))
    return rows.select("key", "rep", "comp", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(pair)).alias("block"))


def near_duplicates(docs: DataFrame, percent: int = 75, members: int = 512, elements: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Buckets of equal band keys are never expanded into pairs of rows. In the star turn every member tries
    the smallest leader of its buckets; the link is confirmed on the full sets, components are formed, and
    buckets that are one component are done. The members of the others meet inside tasks, a bucket at a
    time, and only the links between components leave them; a bucket of more than ``members`` rows or
    ``elements`` shingles is dealt in parts, of which every two meet in a task, so tasks are bounded and no
    link between texts that share a band is lost. A pair at the threshold shares no band with probability
    (1 - 0.75**4)**32 = 5e-6.
    """
    docs = docs.select("doc_id", "text")
    signed = stored(docs.mapInArrow(tidy(_sign), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signed")
    with_set = signed.where("set_key is not null and doc_id is not null")
    first = with_set.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    member = with_set.join(first, "set_key")
    banded = member.where("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    crowd = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key")
    bucket = stored(banded.join(crowd, "key").distinct(), "buckets")
    comps = None
    if not bucket.isEmpty():
        near = docs.join(bucket.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        sets = stored(near.mapInArrow(tidy(_sets), "doc_id long, shingle_set binary").dropDuplicates(["doc_id"]), "sets")
        lead = bucket.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lead"))
        tries = bucket.join(lead, "key").where(f"rep <> lead.rep and 100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)")
        pairs = tries.groupBy(F.col("rep").alias("a")).agg(F.min("lead.rep").alias("b"))
        pairs = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingle_set").alias("set_a")), "a")
        pairs = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingle_set").alias("set_b")), "b")
        comps = components(cut(pairs.mapInArrow(tidy(_confirm(percent)), "u long, v long")))  # one Python worker a task
        moved = bucket.join(comps, bucket.rep == comps.node, "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        several = moved.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        apart = _blocks(cut(moved.join(several, "key", "left_semi")), members, elements)
        apart = apart.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("key", "block", "comp", "shingle_set")
        found = cut(apart.groupBy("key", "block").applyInArrow(_link_apart(percent), "u long, v long"))
        if not found.isEmpty():
            later = components(found).select(F.col("node").alias("component"), F.col("component").alias("final"))
            alone = later.join(comps, later.component == comps.node, "left_anti").select(F.col("component").alias("node"), F.col("final").alias("component"))
            comps = comps.join(later, "component", "left").select("node", F.coalesce("final", "component").alias("component")).unionByName(alone)
    reps = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    if comps is not None:
        reps = reps.join(comps, reps.rep == comps.node, "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    else:
        reps = reps.select("doc_id", F.col("rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(reps, "doc_id", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), (F.col("doc_id") == comp).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without the near copies: of each group the smallest id stays; rows without id stay."""
    drop = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
