"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with the SQL each is held against.

Query names start with the inventory rows they exercise. Bindings give the supplied tables the shapes the
operators work on (documents with a company and a time, price series, edges with evidence, ...); they are SQL
that both engines read, with tables as ``{name}``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BINDINGS = {
    # dated documents of a company (user), with a label and JSON metadata
    "docs": "SELECT event_id AS doc_id, user_id AS corp, ts, CAST(ts AS DATE) AS day, event_type AS label, props AS metadata, value FROM {events}",
    # company (nation) to supplier edges, one row per evidence document (order)
    "facts": """SELECT concat('N', CAST(c_nationkey AS STRING)) AS src, concat('S', CAST(l_suppkey AS STRING)) AS dst,
        CASE l_returnflag WHEN 'R' THEN 'COMPETES_WITH' WHEN 'A' THEN 'SUPPLIES' ELSE 'INVESTS_IN' END AS type,
        CASE WHEN l_linestatus = 'F' THEN 'extractor' END AS extracted_by, o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS day, l_discount * 100 - 1 AS stake
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey""",
    # account values of a company by year, report and statement kind
    "metrics": """SELECT concat('C', CAST(o_custkey % 40 AS STRING)) AS corp, o_orderpriority AS account, CAST(extract(year FROM o_orderdate) AS INT) AS year,
        CASE CAST(extract(quarter FROM o_orderdate) AS INT) WHEN 1 THEN '11013' WHEN 2 THEN '11012' WHEN 3 THEN '11014' ELSE '11011' END AS report,
        CASE WHEN o_orderstatus = 'F' THEN 'CFS' ELSE 'OFS' END AS fs, CAST(floor(o_totalprice) AS BIGINT) AS value, o_orderkey AS seq FROM {orders}""",
    # stakes in a company, names with repeats
    "stakes": """SELECT concat('N', CAST(s_nationkey AS STRING)) AS corp, concat(CASE WHEN s_suppkey % 3 = 0 THEN ' (Co) ' ELSE '' END, 'Holder ', CAST(s_suppkey % 7 AS STRING)) AS holder,
        CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_acctbal / 100 END AS stake, s_suppkey AS seq FROM {supplier}""",
    # daily prices of a company
    "prices": "SELECT user_id AS corp, CAST(ts AS DATE) AS day, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS close, event_id AS seq FROM {events}",
    # text chunks with their lines' company
    "chunks": "SELECT doc_id, coalesce(text, '') AS text, lang, source FROM {documents}",
    "vectors": "SELECT vec_id, embedding, label FROM {embeddings}",
}
BINDINGS["edges"] = f"SELECT src, dst, type, extracted_by, count(DISTINCT doc_id) AS evidence_count, min(day) AS first_day, max(day) AS last_day, max(stake) AS stake FROM ({BINDINGS['facts']}) GROUP BY src, dst, type, extracted_by"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAMES = re.compile(r"\{(\w+)\}")


#: Line items in a part of the facts and edges: their number grows with the table, so that no task's memory does.
PART_ROWS = 250_000


def _facts(table: Callable[[str], DataFrame], parts: int) -> DataFrame:
    """The binding ``facts``, joined in parts of orders, so that all rows of a document lie in one part."""
    o = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "o_orderdate")
    li = table("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    rows = li.repartition(parts, "l_orderkey").join(o.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "COMPETES_WITH").when(F.col("l_returnflag") == "A", "SUPPLIES").otherwise("INVESTS_IN")
    node = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    return rows.select(
        node("N", "c_nationkey").alias("src"), node("S", "l_suppkey").alias("dst"), kind.alias("type"), F.when(F.col("l_linestatus") == "F", "extractor").alias("extracted_by"),
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("day"), (F.col("l_discount") * 100 - 1).alias("stake"),
    )


def _edges(facts: DataFrame, parts: int) -> DataFrame:
    """The binding ``edges``: the rows of a document meet in its part, so only one row a document and edge is shuffled, and documents are counted without a distinct."""
    at = ["src", "dst", "type", "extracted_by"]
    docs = facts.groupBy(*at, "doc_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max("stake").alias("stake"))
    ends = (F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.max("stake").alias("stake"))
    return docs.repartition(parts, *at).groupBy(*at).agg(F.count("doc_id").alias("evidence_count"), *ends)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, or a binding over supplied tables."""
    ship(spark)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("facts", "edges"):
        table = lambda t: read(spark, sf_dir, t)
        parts = max(spark.sparkContext.defaultParallelism, -(-table("lineitem").count() // PART_ROWS))
        facts = _facts(table, parts)
        return facts if name == "facts" else _edges(facts, parts)
    text = BINDINGS[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_NAMES.findall(text))})


def oracle(text: str) -> str:
    """SQL over supplied tables and bindings; bindings used in it are added as common table expressions."""
    used = [b for b in BINDINGS if re.search(rf"\b{b}\b", text)]
    with_ = [f"{b} AS ({_NAMES.sub(lambda m: m[1], BINDINGS[b])})" for b in used]
    body = text.strip()
    if not with_:
        return body
    if m := re.match(r"WITH (RECURSIVE )?", body):
        return f"{m[0]}{', '.join(with_)}, {body[m.end() :]}"
    return f"WITH {', '.join(with_)} {body}"


def query(sql: str | None = None):
    """Register a function (read) -> DataFrame under its own name; ``read(name)`` gives a table or binding."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: read(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def by_case(key: str, values: list) -> Column:
    """The value at place ``key`` mod (number of values): raw forms of a field, spread over a table's rows."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def sql_case(key: str, values: list) -> str:
    """The same in SQL, for the values that are expected."""
    shown = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values]
    return f"CAST([{', '.join(shown)}][{key} % {len(values)} + 1] AS {'VARCHAR' if any(isinstance(v, str) for v in values) else 'BOOLEAN' if any(isinstance(v, bool) for v in values) else 'BIGINT' if any(isinstance(v, int) for v in values) else 'DOUBLE'})"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["gra1_ego_graph"](spark, sf_dir)


from . import chunk_plans, diagnostic_plans, document_plans, extraction_plans, gold_plans, graph_plans, lookup_plans, metric_plans, pending_plans, profile_plans, record_plans, scalar_plans, section_plans, semantic_plans, sentence_plans, store_plans, table_plans, text_plans  # noqa: E402, F401
