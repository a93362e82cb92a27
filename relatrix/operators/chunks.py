"""Chunks of sections and of table rows: content, the text that is embedded, the text that a model reads, and their fields."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.lexicon import apply_lexicon, blake16, table_chunk_key, text_chunk_key

#: Where a long text may be cut, best first, and what joins the parts of one pack again.
CUTS = ((r"\n{2,}", "\n\n"), (r"\n", "\n"), (r"(?<=[.!?])[ \t]+", " "), (r"\s+", " "))


def words(text: str) -> int:
    return len(text.split())


def pack(parts: list[str], most: int, size: Callable[[str], int], glue: str) -> Iterator[str]:
    """Parts in order, as many together as ``most`` allows; one that is larger alone."""
    held, total = [], 0
    for part in parts:
        n = size(part)
        if held and total + n > most:
            yield glue.join(held)
            held, total = [], 0
        held.append(part)
        total += n
    if held:
        yield glue.join(held)


def split_text(text: str, most: int, size: Callable[[str], int] = words, level: int = 0) -> list[str]:
    """A text in parts of at most ``most``: cut at the best place that it has, packed, and packs still too large cut at the next best.

    Parts of different packs never join again. What has no more places to cut stays whole.
    """
    if size(text) <= most or level == len(CUTS):
        return [text]
    cut, glue = CUTS[level]
    parts = [p for p in re.split(cut, text) if p.strip()]
    return [x for p in pack(parts, most, size, glue) for x in split_text(p, most, size, level + 1)]


#: Texts whose parts are held at once; a batch of Spark's has 10,000.
TEXTS_AT_ONCE = 64


def _split(most: int, size: Callable[[str], int]):
    """Adds ``tokens`` of the whole text and its ``parts``: (content, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            texts = batch.column("text").to_pylist()
            parts = [[(p, size(p)) for p in split_text(t, most, size)] for t in (x or "" for x in texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([size(t or "") for t in texts], pa.int32()), pa.array(parts, pa.list_(pa.struct([("content", pa.string()), ("tokens", pa.int32())])))],
                names=[*batch.schema.names, "_tokens", "_parts"],
            )

    return run


def section_chunks(rows: DataFrame, micro: int = 1500, macro: int = 3000, part: int = 2800, size: Callable[[str], int] = words) -> tuple[DataFrame, DataFrame]:
    """TXT6: chunks of sections, and (row, parent_tokens, parent_summary, split_count) of the sections that were split.

    ``rows``: one row a section, any columns beside ``text`` and the document's ``summary``. A section of at most ``macro`` tokens is one
    chunk; a longer one is cut into parts of at most ``part``. Every row is cut by itself, so no two sections meet. A chunk is
    "text_micro" up to ``micro`` tokens of its own, else "text_macro". Parts carry the summary, or the section's first 200 characters.
    ``size`` counts tokens; the default counts words. NULL and empty texts give one empty chunk.
    """
    kept = [c for c in rows.columns if c not in ("text", "summary")]
    fields = rows.select(*kept, F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema), "_tokens int, _parts array<struct<content: string, tokens: int>>"])
    cut = fields.mapInArrow(_split(part, size), schema).withColumn("is_split", F.col("_tokens") > macro)
    summary = F.trim(F.when(F.col("summary") != "", F.col("summary")).otherwise(F.substring("text", 1, 200)), F.lit(" \t\n\r"))
    whole = F.array(F.struct(F.col("text").alias("content"), F.col("_tokens").alias("tokens")))
    parents = cut.where("is_split").select(*kept, F.col("_tokens").alias("parent_tokens"), summary.alias("parent_summary"), F.size("_parts").alias("split_count"))
    out = cut.select(*kept, "is_split", F.when(F.col("is_split"), summary).alias("parent_summary"), F.posexplode(F.when(F.col("is_split"), F.col("_parts")).otherwise(whole)).alias("split_idx", "_p"))
    return out.select(*kept, "split_idx", "is_split", F.when(F.col("_p.tokens") <= micro, "text_micro").otherwise("text_macro").alias("kind"), F.col("_p.tokens").alias("tokens"), F.col("_p.content").alias("content"), "parent_summary"), parents


def section_texts(chunks: DataFrame) -> DataFrame:
    """TXT6: id and the two texts of section chunks (corp, corp_name, rcept_no, doc_type, path, headings, offset, split_idx, is_split, parent_summary, content)."""
    content = apply_lexicon(F.col("content"))
    rows = chunks.withColumn("content", content)
    path = F.concat(F.array_join("path", "-"), F.when(F.col("is_split"), F.concat(F.lit("#"), F.col("split_idx").cast("string"))).otherwise(""))
    rows = rows.withColumn("chunk_id", blake16(text_chunk_key(F.col("corp"), F.col("rcept_no"), F.concat("path", F.array(F.col("split_idx").cast("string"))), F.col("offset"), F.col("content"))))
    kind = F.coalesce("doc_type", F.lit(""))
    prefix = F.concat(F.lit("["), F.col("corp_name"), F.lit("("), F.col("corp"), F.lit(") · "), kind, F.lit(" · "), path, F.lit("]"))
    anchor = F.concat(F.lit("anchor={section_path: '"), F.array_join("path", "/"), F.lit("', offset: "), F.col("offset").cast("string"), F.lit(", split_idx: "), F.col("split_idx").cast("string"), F.lit("}"))
    suffix = F.concat(F.lit("(rcept_no="), F.col("rcept_no"), F.lit(", chunk_id="), F.col("chunk_id"), F.lit(", "), anchor, F.lit(", source=DART_body.html)"))
    parent = F.when(F.col("is_split") & (F.col("parent_summary") != ""), F.concat(F.lit("[부모 섹션 요약: "), F.col("parent_summary"), F.lit("]")))
    heading = F.when(F.size("headings") > 0, F.array_join("headings", " > ")).otherwise(path)
    embedding = F.concat(F.trim(F.concat_ws(" ", F.col("corp_name"), kind, heading)), F.lit("\n\n"), F.col("content"))
    return rows.withColumn("embedding_text", embedding).withColumn("llm_context_text", F.concat_ws("\n", prefix, parent, F.col("content"), suffix))


def table_chunks(items: DataFrame, index: DataFrame) -> DataFrame:
    """TXT5: chunks of sentences of table rows, with year and report filled from the document index.

    ``items``: (corp, corp_name, rcept_no, endpoint, row_offset, variant, content, section_path, bsns_year, stlm_dt, reprt_code, fs_div); ``index``:
    (rcept_no, doc_type), of one receipt the least kind. The year is the row's own, else the document's, else NULL; so is the report; the statement kind is
    the row's or NULL. Contents under 30 meaningful characters are dropped. ``texts`` holds content, embedding text and model text.
    """
    kinds = index.where("rcept_no is not null").groupBy("rcept_no").agg(F.min("doc_type").alias("_kind"))
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    own = R.safe_year(F.col("bsns_year"), F.col("stlm_dt"), F.col("rcept_no"))
    period = R.document_period(F.col("_kind"))
    rows = items.join(kinds, "rcept_no", "left").withColumn("year", F.coalesce(F.when(own > 0, own), period["year"]))
    rows = rows.withColumn("report", F.coalesce(filled("reprt_code"), period["report"])).withColumn("fs", filled("fs_div"))
    rows = rows.withColumn("content", apply_lexicon(F.regexp_replace("content", r"(?U)\bNone\b", R.UNDISCLOSED)))
    said = F.trim(F.regexp_replace(F.replace(F.col("content"), F.lit(R.UNDISCLOSED), F.lit("")), "[,.]", ""))
    rows = rows.where(F.length(said) >= 30)
    receipt = F.coalesce("rcept_no", F.lit(""))
    rows = rows.withColumn("chunk_id", blake16(table_chunk_key(F.col("corp"), receipt, F.col("endpoint"), F.col("variant"), F.col("row_offset"), F.col("content"))))
    label, place = F.coalesce(F.col("year").cast("string"), F.lit("공시일자")), F.concat_ws("/", "endpoint", "variant")
    prefix = F.concat(F.lit("["), F.col("corp_name"), F.lit("("), F.col("corp"), F.lit(") · "), label, F.lit(" · "), place, F.lit("]"))
    anchor = F.concat(F.lit("anchor={section_path: '"), F.array_join("section_path", "/"), F.lit("', endpoint: '"), F.col("endpoint"), F.lit("', row_offset: "), F.col("row_offset").cast("string"), F.lit(", variant: '"), F.col("variant"), F.lit("'}"))
    suffix = F.concat(F.lit("(rcept_no="), receipt, F.lit(", chunk_id="), F.col("chunk_id"), F.lit(", "), anchor, F.lit(", source=DART_"), F.col("endpoint"), F.lit(")"))
    embedding = F.concat(F.concat_ws(" ", F.col("corp_name"), label, place), F.lit("\n\n"), F.col("content"))
    texts = F.struct(F.col("content"), embedding.alias("embedding_text"), F.concat_ws("\n", prefix, F.col("content"), suffix).alias("llm_context_text"))
    return rows.select("chunk_id", "corp", "rcept_no", "endpoint", "variant", "row_offset", "year", "report", "fs", texts.alias("texts"))
