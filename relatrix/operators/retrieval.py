"""Retrieval: dense top-k, BM25, reciprocal-rank fusion, quotas, dictionary matches and entity linking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))


#: Queries and vectors that meet at once: each table of scores takes 8 MB.
QUERIES_AT_ONCE, VECTORS_AT_ONCE = 128, 8192


def _best(k: int, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((ids, -np.round(score, 9)), axis=1)[:, :k]
    return np.take_along_axis(ids, by, 1), np.take_along_axis(score, by, 1)


def _nearest(k: int, on: str | None = None):
    """The k best of a slice of unit vectors for each query of a block; with ``on``, all rows have one value of that column."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if rows.num_rows and queries.num_rows:
            ids, asked = rows["vec_id"].to_numpy(), queries["qid"].to_numpy()
            near, own = _matrix(rows["unit"]).T, _matrix(queries["unit"])
            found = []
            for at in range(0, len(own), QUERIES_AT_ONCE):
                parts = []
                for start in range(0, len(ids), VECTORS_AT_ONCE):
                    score = own[at : at + QUERIES_AT_ONCE] @ near[:, start : start + VECTORS_AT_ONCE]
                    parts.append(_best(k, np.broadcast_to(ids[start : start + VECTORS_AT_ONCE], score.shape), score))
                best, score = _best(k, *(np.concatenate(x, axis=1) for x in zip(*parts, strict=True)))
                found.append((np.repeat(asked[at : at + QUERIES_AT_ONCE], best.shape[1]), best.ravel(), score.ravel()))
            out = [np.concatenate(x) for x in zip(*found, strict=True)]
        columns = [pa.array(x) for x in out]
        if on:
            kind = rows.schema.field(on).type
            columns.insert(0, pa.array([rows[on][0].as_py() if len(out[0]) else None] * len(out[0]), kind))
        return pa.table(columns, names=[*([on] if on else []), "qid", "vec_id", "score"])

    return run


def payload_filter(must: dict[str, object]) -> Column | None:
    """FIL20: all of the conditions hold: a field equals a value, or is one of a list; None and empty lists ask for nothing."""
    out = None
    for field, wanted in must.items():
        if wanted is None or wanted == [] or wanted == ():
            continue
        one = F.col(field).isin(*wanted) if isinstance(wanted, (list, tuple)) else F.col(field) == F.lit(wanted)
        out = one if out is None else out & one
    return out


#: Each block of queries takes a copy of all vectors, and each slice of vectors a copy of all queries. So there are as few as give this many meetings, but none larger than this.
MEETINGS, LARGEST_BLOCK, LARGEST_SLICE = 64, 16_384, 65_536


def meetings(asked: int, rows: int, block: int, slice_rows: int) -> tuple[int, int]:
    """Blocks of queries and slices of vectors: of ``block`` and ``slice_rows`` rows while that makes few meetings, then larger ones."""
    slices = max(1, min(-(-rows // slice_rows), max(MEETINGS, -(-rows // max(slice_rows, LARGEST_SLICE)))))
    return max(1, -(-asked // max(block, LARGEST_BLOCK)), min(-(-asked // block), -(-MEETINGS // slices))), slices


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None, block: int = 2048, slice_rows: int = 8192, on: str | None = None) -> DataFrame:
    """RET1, TOP7, FIL20: nearest vectors of each query by cosine after the payload filter; zero and missing vectors take no part.

    Vectors are normalised once. ``queries`` (qid, query) are a stated set; blocks of them meet slices of the vectors, both
    of bounded size, and only k rows a query leave each meeting, so nothing is broadcast and no pairs are written. With ``on``, both
    frames have that column, a query may have several rows, and each row only meets the vectors of its own value; the column is returned.
    """
    rows = vectors.where(where) if where is not None else vectors
    own = [on] if on else []
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / S.norm(F.col(c)))
    rows = rows.where(S.norm(F.col("embedding")) > 0).select(*own, F.col("vec_id").cast("long").alias("vec_id"), unit("embedding").alias("unit"))
    asked = queries.where(S.norm(F.col("query")) > 0).select(*own, F.col("qid").cast("long").alias("qid"), unit("query").alias("unit"))
    blocks, slices = meetings(asked.count(), rows.count(), block, slice_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")).select("*", every(blocks).alias("block"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).select("*", every(slices).alias("slice"))
    at = [*own, "block", "slice"]
    kind = f"{vectors.schema[on].dataType.simpleString()} " if on else ""
    part = rows.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(_nearest(k, on), f"{f'`{on}` {kind}, ' if on else ''}qid long, vec_id long, score double")
    order = Window.partitionBy("qid", *own).orderBy(F.desc(F.round("score", 9)), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*own, "qid", "vec_id", "score", "rank")


def company_search(queries: DataFrame, vectors: DataFrame, k: int, pool: int, where: Column | None = None) -> DataFrame:
    """RET5: (qid, rank, corp, vec_id, score): a question about several companies, asked once for each of them.

    ``queries``: (qid, query, corps, balanced); ``vectors``: (vec_id, corp, embedding, payload columns). Every company is searched by itself for
    ``pool`` vectors. Balanced questions take max(1, k div companies) of each company first, in the order in which they were named; if these are fewer
    than k, the rest follow by score until ``pool`` are held. Others take the ``pool`` best of all. A company named twice is one; one without vectors gives none.
    """
    named = queries.withColumn("corps", F.array_distinct(F.coalesce("corps", F.array().cast("array<string>"))))
    asked = named.select("qid", "query", F.size("corps").alias("n"), "balanced", F.posexplode("corps").alias("place", "corp")).where("corp is not null")
    found = dense_top_k(asked, vectors, pool, where, on="corp").join(asked.select("qid", "corp", "n", "place", "balanced"), ["qid", "corp"])
    first = F.col("balanced") & (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("n"))))
    held = Window.partitionBy("qid")
    rows = found.withColumn("first", first).withColumn("_held", F.count_if("first").over(held))
    key = (F.desc("first"), F.when(F.col("first"), F.col("place")), F.when(F.col("first"), F.col("rank")), F.desc(F.round("score", 9)), "place", "vec_id")
    rows = rows.withColumn("_at", F.row_number().over(held.orderBy(*key)))
    kept = F.when(F.col("balanced"), F.col("first") | ((F.col("_held") < k) & (F.col("_at") <= pool))).otherwise(F.col("_at") <= pool)
    return rows.where(kept).select("qid", F.col("_at").alias("rank"), "corp", "vec_id", "score")


#: Asked terms up to this many are broadcast; more are joined by shuffling.
BROADCAST_TERMS = 200_000


#: Documents in a part that is scored by itself: the number of parts grows with the documents, so that no task's memory does.
PART_DOCS = 1024


def dealt(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, ...) in parts of bounded size: what is grouped by document afterwards is not shuffled again."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // PART_DOCS))
    return docs.repartition(parts, "doc_id")


def few(rows: DataFrame) -> DataFrame:
    """Asked terms, broadcast while they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_TERMS else rows


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """RET2: BM25 (Okapi) over the whole corpus; negative idf is floored at eps times the mean idf.

    ``queries`` (qid, text) and ``docs`` (doc_id, text). Statistics cover all documents; a query term repeated in
    the query counts as often. Only terms that are asked for leave the documents as rows, and these are counted and scored in
    the documents' own parts, of which only the k best of a query are shuffled.
    """
    words = docs.select("doc_id", S.tokens(F.col("text")).alias("w"))
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    totals = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = df.crossJoin(F.broadcast(totals)).withColumn("raw", raw)
    floor = idf.agg((F.avg("raw") * eps).alias("floor"))
    asked = queries.select("qid", F.explode(S.tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    terms = asked.select("term").distinct()
    small = F.broadcast if terms.count() <= BROADCAST_TERMS else (lambda x: x)
    weight = F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))
    idf = idf.join(small(terms), "term", "left_semi").crossJoin(F.broadcast(floor)).select("term", "avgdl", weight.alias("idf"))
    own = dealt(docs.select("doc_id", "text")).select("doc_id", S.tokens(F.col("text")).alias("w"))
    tf = own.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(small(terms), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    hits = tf.join(small(idf), "term").join(few(asked), "term")  # a term may be asked for by many
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("times")
    scored = hits.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(left: DataFrame, right: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """RET3, SET5: reciprocal-rank fusion of two rankings (qid, item, rank); ties by item."""
    a, b = left.select("qid", "item", F.col("rank").alias("ra")), right.select("qid", "item", F.col("rank").alias("rb"))
    share = lambda r: F.coalesce(1 / (F.lit(float(c)) + F.col(r)), F.lit(0.0))
    both = a.join(b, ["qid", "item"], "full_outer").withColumn("score", share("ra") + share("rb"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "item")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "item", "score", "rank")


def balanced(ranked: DataFrame, part: str, k: int) -> DataFrame:
    """RET5: max(1, k div parts) rows of each part first, then by score up to k."""
    n = ranked.groupBy("qid").agg(F.count_distinct(part).alias("parts"))
    own = F.row_number().over(Window.partitionBy("qid", part).orderBy(F.desc("score"), "vec_id"))
    rows = ranked.join(n, "qid").withColumn("own", own).withColumn("reserved", F.col("own") <= F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("parts"))))
    order = Window.partitionBy("qid").orderBy(F.desc("reserved"), F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", part, "vec_id", "score", "rank")


def dictionary_scan(chunks: DataFrame, surfaces: list[tuple[str, str]]) -> DataFrame:
    """TXT1, JON23, WIN14: hits (doc_id, etype, surface, start) of a dictionary of fixed size in whole texts.

    One Aho-Corasick pass a text; a hit is suppressed if a longer hit of the same type covers it; of one
    surface in several types the later entry wins. The dictionary is a parameter and travels with the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for etype, surface in surfaces:
            if surface:
                machine.add_word(surface, (etype, surface))
        if len(machine):
            machine.make_automaton()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hits = [(etype, end - len(s) + 1, end + 1, s) for end, (etype, s) in machine.iter(text or "")] if len(machine) else []
                reach: dict[str, int] = {}
                for etype, start, end, s in sorted(hits, key=lambda h: (h[1], -h[2])):
                    if end > reach.get(etype, -1):
                        out.append((doc, etype, s, start))
                        reach[etype] = end
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=["doc_id", "etype", "surface", "start"])

    return chunks.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, etype string, surface string, start int")


def near_entities(mentions: DataFrame, names: DataFrame, k: int = 3, where: Column | None = None) -> DataFrame:
    """JON24: (surface, entity, name, score, rank): the nearest entities of each surface by their vectors.

    ``mentions``: (qid, surface, query); ``names``: (vec_id, entity, name, embedding).
    """
    found = dense_top_k(mentions.select("qid", "query"), names, k, where)
    return found.join(mentions.select("qid", "surface"), "qid").join(names.select("vec_id", "entity", "name"), "vec_id").select("surface", "entity", "name", "score", "rank")


def link(mentions: DataFrame, aliases: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """ENT1 to ENT4, AGG29: canonical alias, raw alias, strict then loose vector match, else synthetic code.

    ``mentions`` (surface, and kind if vectors are looked up for organisations only), ``aliases`` (surface, entity, ambiguous), ``near`` (surface, entity, name, score, rank) with
    ranks 1, 2. Strict: a score of 0.75 and 0.05 over the next; loose: equal canonical names from 0.55 on, whatever follows, else 0.70 and 0.03.
    """
    usable = aliases.where("not ambiguous").groupBy("surface").agg(F.max("entity").alias("entity"))
    canon = usable.select(S.canonical_name(F.col("surface")).alias("c"), "entity").groupBy("c").agg(F.max("entity").alias("by_canon"))
    rows = mentions.withColumn("c", S.canonical_name(F.col("surface"))).join(canon, "c", "left").join(usable.withColumnRenamed("entity", "by_raw"), "surface", "left")
    stage = F.when(F.col("by_canon").isNotNull(), "alias_canonical").when(F.col("by_raw").isNotNull(), "alias_raw")
    entity = F.coalesce("by_canon", "by_raw")
    if near is not None:
        first = near.where("rank = 1").select("surface", F.col("entity").alias("ve"), F.col("score").alias("vs"), (F.col("name") if "name" in near.columns else F.lit(None).cast("string")).alias("vn"))
        second = near.where("rank = 2").select("surface", F.col("score").alias("vs2"))
        rows = rows.join(first, "surface", "left").join(second, "surface", "left")
        fits = (F.col("kind") == "Organization") if "kind" in mentions.columns else F.lit(True)
        margin = lambda m: F.col("vs2").isNull() | (F.col("vs") - F.col("vs2") >= m)
        strict, loose = fits & (F.col("vs") >= 0.75) & margin(0.05), fits & (F.col("vs") >= 0.70) & margin(0.03)
        same = fits & (F.col("c") != "") & (F.col("c") == S.canonical_name(F.col("vn"))) & (F.col("vs") >= 0.55)
        stage, entity = stage.when(strict, "vector_strict").when(same | loose, "vector_loose"), F.coalesce(entity, F.when(strict | same | loose, F.col("ve")))
    return rows.select("surface", F.coalesce(entity, S.synthetic_code(F.col("c"))).alias("entity"), stage.otherwise("unlinked").alias("stage"))
