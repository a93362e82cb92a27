"""Readers of collected files: yearly price files, statistics responses, catalogues, feeds, dictionaries, vectors and filtered scans."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.records import published


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: (corp, year, basDd, open, high, low, close, volume) of files ``<corp>/daily_ohlcv_<year>.json``; files without a year or rows give none."""
    row = "basDd:string, open:double, high:double, low:double, close:double, volume:bigint"
    docs = spark.read.schema(f"year string, rows array<struct<{row}>>").option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "daily_ohlcv_*.json").option("recursiveFileLookup", True).json(path)
    return docs.where("coalesce(year, '') <> ''").select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("corp"), "year", F.explode("rows").alias("r")).select("corp", "year", "r.*").where("length(trim(coalesce(basDd, ''))) >= 6")


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: (code, item1, item2, item3, time, value) of statistics responses; an unnamed first item is the whole."""
    fields = ("STAT_CODE", "ITEM_NAME1", "ITEM_NAME2", "ITEM_NAME3", "TIME", "DATA_VALUE")
    docs = spark.read.schema(f"StatisticSearch struct<row:array<struct<{', '.join(f'{f}:string' for f in fields)}>>>").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    r = docs.select(F.explode("StatisticSearch.row").alias("r")).select("r.*")
    text = lambda c, other="": F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(F.col(c))
    return r.select(F.coalesce("STAT_CODE", F.lit("")).alias("code"), text("ITEM_NAME1", "전체").alias("item1"), text("ITEM_NAME2").alias("item2"), text("ITEM_NAME3").alias("item3"), F.col("TIME").alias("time"), F.col("DATA_VALUE").try_cast("double").alias("value"))


def read_catalogue(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """SRC8: (category, list_id, title, view) of files ``list_<category>.json``, each a JSON list; entries without id or title are left out."""
    rows = spark.read.schema("LIST_ID string, LIST_NM string, VW_NM string").option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "list_*.json").json(path)
    code = F.regexp_extract(F.input_file_name(), r"list_([^/]*)\.json$", 1)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    trim = lambda c: F.trim(F.coalesce(c, F.lit("")))
    out = rows.select(code.alias("code"), trim("LIST_ID").alias("list_id"), trim("LIST_NM").alias("title"), trim("VW_NM").alias("view")).where("list_id <> '' and title <> ''")
    return out.select(F.coalesce(F.try_element_at(table, F.col("code")), "code").alias("category"), "list_id", "title", "view")


#: Named entities that feeds use without declaring them.
FEED_ENTITIES = {
    "nbsp": " ", "copy": "(c)", "reg": "(R)", "trade": "(TM)",
    "hellip": "...", "ndash": "-", "mdash": "--",
    "lsquo": "'", "rsquo": "'", "ldquo": '"', "rdquo": '"',
    "laquo": "<<", "raquo": ">>", "times": "x", "divide": "/",
    "deg": "deg", "euro": "EUR", "pound": "GBP", "yen": "JPY", "cent": "c",
    "middot": "*", "bull": "*",
}


def clean_feed(text: Column) -> Column:
    """SRC12: a feed's XML with undeclared entities replaced and bare ampersands escaped."""
    for name, char in FEED_ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(text, r"&(?!amp;|lt;|gt;|quot;|apos;|#\d+;|#x[0-9a-fA-F]+;)", "&amp;")


def feed_items(feeds: DataFrame, since: Column, most: int) -> DataFrame:
    """SRC12: (feed, pos, title, link, published) of feed texts (feed, xml): items on or after the day, undated ones too, the first ``most`` of a feed."""
    xml = clean_feed(F.col("xml"))
    items = feeds.select("feed", F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("pos", "item"))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    tag = lambda t: F.trim(plain(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{t}\b[^>]*>(.*?)</{t}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")))
    rows = items.select("feed", "pos", tag("title").alias("title"), tag("link").alias("link"), published(tag("pubDate")).alias("published"))
    return rows.where((F.col("link") != "") & (F.col("published").isNull() | (F.col("published").cast("date") >= since))).where(F.col("pos") < most)


def scan_run(rows: DataFrame, run: str, status: str | None = "ready") -> DataFrame:
    """SRC16: rows of a run, of one status if it is given."""
    rows = rows.where(F.col("run") == run)
    return rows if status is None else rows.where(F.col("status") == status)


def scan_label(nodes: DataFrame, *labels: str) -> DataFrame:
    """SRC17: nodes that bear all the labels."""
    for label in labels:
        nodes = nodes.where(F.array_contains("labels", label))
    return nodes


_KEY, _LIST = re.compile(r"^(\S[^:]*):\s*$"), re.compile(r"^\s+(\w+):\s*(.*)$")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """SRC19: (key, name, aliases, tickers, domain) of alias dictionaries: a key at the margin, fields below it, lists in brackets or as dashes."""

    def parse(text: str) -> list[dict]:
        out, field = [], None
        for line in text.split("\n"):
            bare = line.split(" #")[0].rstrip()
            if not bare or bare.lstrip().startswith("#"):
                continue
            if m := _KEY.match(bare):
                out.append({"key": m[1].strip("'\""), "aliases": [], "ticker": []})
                field = None
            elif out and bare.lstrip().startswith("- ") and field:
                out[-1].setdefault(field, []).append(bare.lstrip()[2:].strip().strip("'\""))
            elif out and (m := _LIST.match(bare)):
                field, value = m[1], m[2].strip()
                if value.startswith("["):
                    out[-1][field] = [x.strip().strip("'\"") for x in value.strip("[]").split(",") if x.strip()]
                elif value:
                    out[-1][field] = value.strip("'\"")
                else:
                    out[-1][field] = []
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for t in batch.column("value").to_pylist() for r in parse(t or "")]
            get = lambda r: next((r[k] for k in ("name", "canonical", "kor_name") if isinstance(r.get(k), str)), r["key"])
            many = lambda r, k: r[k] if isinstance(r.get(k), list) else [r[k]] if r.get(k) else []
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            cols = [[r["key"] for r in rows], [get(r) for r in rows], [many(r, "aliases") for r in rows], [many(r, "ticker") for r in rows], [r["domain"] if isinstance(r.get("domain"), str) else None for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "name", "aliases", "tickers", "domain"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "key string, name string, aliases array<string>, tickers array<string>, domain string")


_GOLD = "id string, query string, category string, no_answer boolean, chunks array<string>, corps array<string>, note string"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """SRC20: questions of gold files: entries that begin with '- id:', fields two spaces in, texts in JSON, lists in brackets.

    Lines before the first entry and unknown fields are skipped; a field that an entry has not is NULL.
    """
    quoted, listed = {"query": "query", "note": "note"}, {"expected_chunk_ids": "chunks", "expected_corp_codes": "corps"}

    def parse(text: str) -> list[dict]:
        out: list[dict] = []
        for line in text.splitlines():
            if line.startswith("- id:"):
                out.append({"id": line[5:].strip()})
            elif out and (m := re.match(r"  (\w+):(.*)", line)):
                field, value = m[1], m[2].strip()
                if field in quoted:
                    out[-1][quoted[field]] = json.loads(value)
                elif field in listed:
                    out[-1][listed[field]] = [x.strip() for x in value.strip("[]").split(",") if x.strip()]
                elif field == "category":
                    out[-1]["category"] = value
                elif field == "no_answer":
                    out[-1]["no_answer"] = value == "true"
        return out

    kinds = {"id": pa.string(), "query": pa.string(), "category": pa.string(), "no_answer": pa.bool_(), "chunks": pa.list_(pa.string()), "corps": pa.list_(pa.string()), "note": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for t in batch.column("value").to_pylist() for r in parse(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    return spark.read.text(path, wholetext=True).mapInArrow(run, _GOLD)


def page_lookup(pages: DataFrame, texts: DataFrame, head: int = 80, least: int = 20) -> DataFrame:
    """SRC21: (text_id, page): the first page (1-based) of the document whose text holds the first characters of a text, spaces squeezed; NULL if none does.

    ``pages``: (doc, page, content); ``texts``: (doc, text_id, content). Texts of fewer than ``least`` characters are on no page.
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), "^ | $", "")
    t = texts.select("doc", "text_id", F.substring(bare("content"), 1, head).alias("head"))
    p = pages.select("doc", "page", bare("content").alias("body"))
    hits = t.where(F.length("head") >= least).join(p, "doc").where(F.contains("body", "head")).groupBy("doc", "text_id").agg(F.min("page").alias("page"))
    return t.join(hits, ["doc", "text_id"], "left").select("doc", "text_id", "page")


def read_vectors(spark: SparkSession, vectors: str, ids: str, size: int) -> DataFrame:
    """SRC22: (id, embedding) of raw little-endian float matrices of ``size`` columns (``.npy`` header allowed) and a text file of ids, line by line.

    Both are numbered by their place; the rows of several matrix files go on in the order of their names. A matrix file is read by
    one task, so large matrices belong in several files; the ids are one small file beside them.
    """
    files = spark.read.format("binaryFile").load(vectors)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = 10 + int.from_bytes(data[8:10], "little") if data[:6] == b"\x93NUMPY" else 0
                m = np.frombuffer(data, dtype="<f4", offset=at).reshape(-1, size)
                for i in range(0, len(m), 10_000):
                    part = m[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(range(i, i + len(part)), pa.int64()), pa.array(part.tolist(), pa.list_(pa.float32()))], names=["path", "at", "embedding"])

    found = files.select("path", "content").mapInArrow(rows, "path string, at long, embedding array<float>")
    counts = found.groupBy("path").agg(F.count("*").alias("n"))  # a row for each file
    before = counts.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("before"))
    names = spark.read.text(ids, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("place", "id"))
    placed = found.join(before, "path").withColumn("place", F.col("before") + F.col("at"))
    return placed.join(names, "place").select("id", "embedding")
