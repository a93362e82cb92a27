"""The registered queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, grammar, language_model, lexical, line_dedup, near_dedup, neighbours, packing, phrases, quality, repeats, sharding, toxicity
from .common import table


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "similarity", "start_word", "n_words")  # the fingerprints' distance has no SQL


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.round_trip(table(spark, sf_dir, "documents"))


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search_all(table(spark, sf_dir, "embeddings"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_hmm_score, op2_superminhash, op3_decontaminate, op4_repeats, op5_line_dedup, op6_repair_ids, op7_hash_tree, op8_toxicity, op9_neighbours, op10_pack, op11_lexical, op12_quality, op13_phrases)
}

_LINES = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), o AS (
  SELECT key, min(doc_id) AS owner, count(DISTINCT doc_id) AS docs FROM k WHERE length(key) >= 10 GROUP BY key
), d AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(o.docs >= 2 AND k.doc_id <> o.owner, false) AS gone FROM k LEFT JOIN o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

#: Windows of every item length that end with a shingle the item holds, or begin the document; items of five words or more.
_WINDOWS = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS iw FROM benchmark
), igs AS (
  SELECT item_id, n, array_to_string(iw[o + 1 : o + 5], ' ') AS g FROM (SELECT item_id, len(iw) AS n, unnest(range(len(iw) - 4)) AS o, iw FROM i WHERE len(iw) >= 5)
), ik AS (
  SELECT item_id, n, g, count(*) AS k FROM igs GROUP BY ALL
), dgs AS (
  SELECT doc_id, m, p, array_to_string(w[p + 1 : p + 5], ' ') AS g FROM (SELECT doc_id, len(w) AS m, unnest(range(len(w) - 4)) AS p, w FROM w WHERE len(w) >= 5)
), met AS (
  SELECT doc_id, m, item_id, n, p, g, k FROM dgs JOIN ik USING (g)
), c AS (
  SELECT DISTINCT doc_id, m, item_id, n, greatest(0, p + 5 - n) AS start FROM met
), wg AS (
  SELECT c.doc_id, c.m, c.item_id, c.n, c.start, met.g, least(count(*), any_value(met.k)) AS k FROM c JOIN met ON met.doc_id = c.doc_id AND met.item_id = c.item_id AND met.p >= c.start AND met.p <= c.start + c.n - 5 GROUP BY ALL
), s AS (
  SELECT doc_id, item_id, start, least(n, m) AS n_words, n, sum(k) AS shared FROM wg GROUP BY ALL
), t AS (
  SELECT doc_id, item_id, start, n_words, CAST(shared AS DOUBLE) AS shared, CAST((n_words - 4) + (n - 4) - shared AS DOUBLE) AS either FROM s
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / either DESC, start) AS rn FROM t WHERE 100 * shared >= 75 * either
)
SELECT doc_id, item_id, shared / either AS similarity, CAST(start AS INT) AS start_word, CAST(n_words AS INT) AS n_words FROM r WHERE rn = 1
"""

_RANKED = r"""
WITH x AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), s AS (
  SELECT count(*) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM x WHERE len(t) > 0
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM x) WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, big_n
), c AS (
  SELECT tf.r, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * len(x.t) * s.big_n) // s.big_l))) AS part FROM tf JOIN w USING (term) JOIN x ON x.r = tf.r, s
), g AS (
  SELECT i.item_id, c.r, CAST(sum(c.part) AS BIGINT) AS score FROM i JOIN c USING (term) GROUP BY ALL
), k AS (
  SELECT g.item_id, x.doc_id, g.score, CAST(row_number() OVER (PARTITION BY g.item_id ORDER BY g.score DESC, x.doc_id) AS INT) AS rank
  FROM g JOIN x ON x.r = g.r WHERE g.score > 0 AND x.doc_id IS NOT NULL
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

_PHRASES = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, size, array_to_string(w[o + 1 : o + size], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(len(w) - size + 1)) AS o FROM w, range(1, 6) AS t(size) WHERE len(w) >= size)
), f AS (
  SELECT lang, CAST(size AS INT) AS size, phrase, count(*) AS a FROM g GROUP BY ALL
), t AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE size >= 2 AND a >= 100
), e AS (
  SELECT lang, part, size - 1 AS size, max(a) AS most FROM (
    SELECT lang, size, a, unnest([array_to_string(string_split(phrase, ' ')[: size - 1], ' '), array_to_string(string_split(phrase, ' ')[2 :], ' ')]) AS part FROM c
  ) GROUP BY ALL
), o AS (
  SELECT c.* FROM c LEFT JOIN e ON e.lang = c.lang AND e.size = c.size AND e.part = c.phrase WHERE e.most IS NULL OR e.most < c.a
), k AS (
  SELECT lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[: j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS j FROM o)
), s AS (
  SELECT k.lang, k.phrase, k.a, k.j, x.a AS l, y.a AS r, t.n, CAST((1000::HUGEINT * k.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.tail JOIN t ON t.lang = k.lang
), b AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS rn FROM s
), z AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b WHERE rn = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op3_decontaminate": _WINDOWS, "op5_line_dedup": _LINES, "op11_lexical": _RANKED, "op13_phrases": _PHRASES}
