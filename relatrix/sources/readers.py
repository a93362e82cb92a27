"""Readers of raw collections: JSON responses, JSONL, XML pages, file-name dispatch, HTML pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_responses(spark: SparkSession, path: str, item: str) -> DataFrame:
    """SRC1, SRC2: one row per element of data.list of every response with status ok; bad files are skipped.

    ``item`` is the DDL of an element; all values are text in the sources.
    """
    schema = f"endpoint string, status string, params map<string,string>, data struct<list:array<struct<{item}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.where("status = 'ok'").select("endpoint", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("corp"), F.explode("data.list").alias("r")).where("r is not null").select("endpoint", "corp", "r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC3: bad lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def xml_rows(pages: DataFrame, column: str, row_tag: str, fields: list[str]) -> DataFrame:
    """SRC4: rows of XML pages, one per row tag, each read by itself so that a missing field (NULL) moves no other."""
    rest = [c for c in pages.columns if c != column]
    items = pages.select(*rest, F.explode(F.regexp_extract_all(column, F.lit(rf"(?s)<{row_tag}(?:\s[^>]*)?>(.*?)</{row_tag}>"), F.lit(1))).alias("_item"))
    items = items.withColumn("_item", F.concat(F.lit("<r>"), "_item", F.lit("</r>")))
    return items.select(*rest, *(F.nullif(F.xpath_string("_item", F.lit(f"/r/{f}/text()")), F.lit("")).alias(f) for f in fields))


def dispatch(name: Column, patterns: list[tuple[str, str]]) -> Column:
    """SRC5: (endpoint, year, group) by the first file-name pattern that matches; groups 1 and 2 are year and group."""
    out = None
    for endpoint, pattern in patterns:
        got = F.struct(F.lit(endpoint).alias("endpoint"), F.substring(F.regexp_extract(name, pattern, 1), 1, 4).alias("year"), F.regexp_extract(name, pattern, 2).alias("grp"))
        out = F.when(name.rlike(pattern), got) if out is None else out.when(name.rlike(pattern), got)
    return out


#: Response codes and what they mean.
STATUS = {
    "000": "ok", "013": "no_data",
    "010": "key_error", "011": "key_error",
    "020": "rate_limit", "100": "bad_param", "101": "bad_param",
    "800": "maintenance", "900": "unknown_error",
}


def classify(code: Column, binary: Column) -> Column:
    """SRC32: status of a response; a code is a number, "http_404" or "parse_error"; "key_error" stands for a run that must stop."""
    table = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    known = F.coalesce(F.try_element_at(table, code), F.lit("unknown_error"))
    return F.when(binary, "ok").when(code.startswith("http_"), "http_error").when(code == "parse_error", "parse_error").otherwise(known)


#: Properties of meta tags that are read, and kinds of linked data that are articles.
META = {"og:title": "og_title", "og:description": "og_desc", "article:published_time": "published", "og:site_name": "site"}
ARTICLE_KINDS = ("NewsArticle", "Article")


class _Body(HTMLParser):
    """Visible text of a page: tables, scripts, styles and navigation are skipped by depth; metadata and linked data are kept apart."""

    SKIP = frozenset(("script", "style", "table", "nav", "noscript"))
    BREAK = frozenset(("p", "br", "div", "li", "h1", "h2", "h3", "tr", "section", "article"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0
        self.in_title = False
        self.title = ""
        self.meta: dict[str, str | None] = {}
        self.linked: list[str] = []
        self.in_linked = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if tag == "meta" and own.get("property") in META:
            self.meta.setdefault(META[own["property"]], own.get("content"))
        if tag == "script" and own.get("type") == "application/ld+json":
            self.in_linked = True
            self.linked.append("")
        self.depth += tag in self.SKIP
        self.in_title |= tag == "title"
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.SKIP and self.depth > 0
        self.in_linked &= tag != "script"
        if tag == "title":
            self.in_title = False
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_linked:
            self.linked[-1] += data
        elif self.in_title:
            self.title += data
        elif not self.depth:
            self.parts.append(data)


def _read(html: str | None) -> _Body:
    body = _Body()
    body.feed(html or "")
    body.close()
    return body


def _text(body: _Body) -> tuple[str, str]:
    lines = (" ".join(x.split()) for x in "".join(body.parts).split("\n"))
    return " ".join(body.title.split()), "\n".join(x for x in lines if x)


def html_body(html: str | None) -> tuple[str, str]:
    """(title, text) of a page; lines are squeezed and blank ones dropped."""
    return _text(_read(html))


def _metadata(body: _Body, url: str | None) -> dict[str, str | None]:
    """Values of meta tags (the first of each), of linked articles (the first that is set), and the day from the address where no time is told."""
    out: dict[str, str | None] = dict.fromkeys(("og_title", "og_desc", "published", "site", "ld_headline", "ld_published")) | body.meta
    for text in body.linked:
        try:
            data = json.loads(text)
        except ValueError:
            continue
        for item in data if isinstance(data, list) else [data]:
            if isinstance(item, dict) and item.get("@type") in ARTICLE_KINDS:
                for name, field in (("ld_headline", "headline"), ("ld_published", "datePublished")):
                    value = item.get(field)
                    out[name] = out[name] or (value if isinstance(value, str) else None)
    if not out["published"] and (day := re.search(r"/(20\d{2})(\d{2})(\d{2})\d+", url or "")):
        out["published"] = "-".join(day.groups())
    return out


#: Pages whose texts are held at once; a batch of Spark's has 10,000.
PAGES_AT_ONCE = 64


def articles(pages: DataFrame, least: int = 100) -> DataFrame:
    """SRC14: pages with at least ``least`` characters of text: page_id, url, title, body and their metadata, NULL where a page has none.

    og_title, og_desc, site and published are meta tags (published else the day in the address); ld_headline and ld_published are linked data, of which broken parts are skipped.
    """
    names = ("og_title", "og_desc", "published", "site", "ld_headline", "ld_published")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(at, PAGES_AT_ONCE)
                rows = []
                for html, url in zip(some.column("html").to_pylist(), some.column("url").to_pylist(), strict=True):
                    page = _read(html)  # one page's tree at a time
                    meta = _metadata(page, url)
                    rows.append((*_text(page), *(meta[n] for n in names)))
                columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), *columns], names=["page_id", "url", "title", "body", *names])

    schema = "page_id long, url string, title string, body string, " + ", ".join(f"{n} string" for n in names)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema).where(F.length("body") >= least)
