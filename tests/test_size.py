"""Steps whose work or memory must not grow faster than their input."""

import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from relatrix.functions import lexicon as X
from relatrix.operators import chunks as C
from relatrix.operators import profiles as P
from relatrix.operators import retrieval as R
from relatrix.operators import sections
from relatrix.plans import registry, semantic_plans
from relatrix.sources import readers


def test_texts_full_of_acronyms(spark):
    """One text with 4000 acronyms and 4000 amounts: 88 s while the text was cut anew for every one of them."""
    rows = spark.createDataFrame([("HBM 10000원, " * 4000,)], "text string")
    began = time.time()
    got = rows.select(X.apply_lexicon(F.col("text")).alias("t")).first()["t"]
    assert got == "HBM(고대역폭메모리) 10000원 (약 1.0만원), " * 4000
    assert time.time() - began < 30


def test_edges_count_documents_in_their_own_parts(spark):
    """A document's rows meet in the part where they were joined: no distinct count, whose maps held 2020 MB in one task at 36 million line items."""
    edges = registry.read(spark, "/root/testdata/sf0.01", "edges")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan
    assert plan.count("Exchange hashpartitioning(doc_id") == 0
    want = spark.sql(f"SELECT src, dst, type, extracted_by, count(DISTINCT doc_id) AS evidence_count, min(day) AS first_day, max(day) AS last_day, max(stake) AS stake FROM ({registry.BINDINGS['facts']}) GROUP BY ALL", **{t: registry.read(spark, "/root/testdata/sf0.01", t) for t in ("lineitem", "orders", "customer")})
    assert edges.select(want.columns).exceptAll(want).count() == 0 == want.exceptAll(edges.select(want.columns)).count()
    assert edges.schema.simpleString() == edges.select(want.columns).schema.simpleString()


def test_few_texts_and_pages_are_held_at_once(spark):
    texts = pa.RecordBatch.from_pydict({"text": [f"one {i}. two three. four" for i in range(1000)]})
    out = list(C._split(2, C.words)(iter([texts])))
    assert max(b.num_rows for b in out) <= 64 and sum(b.num_rows for b in out) == 1000
    assert out[-1].column("_parts")[-1].as_py() == [{"content": "one 999.", "tokens": 2}, {"content": "two three.", "tokens": 2}, {"content": "four", "tokens": 1}]

    class Frame:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def select(self, *_):
            return self

        where = select

    pages = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "url": [f"u{i}" for i in range(1000)], "html": [None, *(f"<title>t{i}</title><p>x {i}" for i in range(1, 1000))]})
    out = list(readers.articles(Frame()).run(iter([pages])))
    assert max(b.num_rows for b in out) <= 64 and sum(b.num_rows for b in out) == 1000
    assert [x for b in out for x in b.column("body").to_pylist()] == ["", *(f"x {i}" for i in range(1, 1000))]


def test_scores_of_a_slice_are_bounded():
    rng = np.random.default_rng(7)
    unit = lambda n: pa.array(list(rng.normal(size=(n, 4))), pa.list_(pa.float64()))
    rows, asked = pa.table({"vec_id": np.arange(8192), "unit": unit(8192)}), pa.table({"qid": np.arange(1000), "unit": unit(1000)})
    tracemalloc.start()
    got = R._nearest(3)(rows, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # 8192 x 1000 scores alone are 65 MB
    own = lambda t: np.array(t["unit"].to_pylist())
    want = np.argsort(-np.round(own(asked) @ own(rows).T, 9), axis=1, kind="stable")[:, :3]
    assert got["vec_id"].to_numpy().reshape(1000, 3).tolist() == want.tolist()


def test_triggers_read_their_text_once(spark):
    rows = spark.createDataFrame([("A 인수 B",), (None,)], "text string").select(sections.triggers(F.lower("text")).alias("t"))
    assert rows._jdf.queryExecution().analyzed().toString().count("lower(text") == 1
    assert [[x["category"] for x in r["t"]] for r in rows.collect()] == [["events"], []]


def test_documents_are_scored_in_their_own_parts(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b1 a a"), (2, "c b2")], "qid long, text string")
    plan = R.bm25(asked, docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(qid#\d+L?, doc_id", plan) and "WindowGroupLimit" in plan


def test_details_read_their_facts_once(spark):
    """The facts were joined and their documents gathered anew for every part of the detail: 96 s at 3.6 million line items."""
    plan = registry.QUERIES["gra3_node_details"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "collect_set" not in plan


def test_details_from_lists_or_rows_of_documents(spark):
    """Node b has the fragments b and f; the two latest of their three documents are kept, and so for the other end."""
    rows = [("a", "b", "SUPPLIES", None, 1), ("a", "f", "SUPPLIES", "x", 2), ("f", "a", "SUPPLIES", None, 3), ("a", "f", "UNKNOWN", None, 4), ("a", "a", "SUPPLIES", None, 4)]
    facts = spark.createDataFrame(rows, "src string, dst string, type string, extracted_by string, doc_id long")
    at = ["src", "dst", "type", "extracted_by"]
    edges = facts.groupBy(*at).agg(F.count("*").alias("evidence_count"), F.lit(None).cast("double").alias("stake"), F.collect_set("doc_id").alias("doc_ids"))
    docs = spark.createDataFrame([(i, f"2020-01-0{5 - i}") for i in range(1, 5)], "doc_id long, ts string").select("doc_id", F.to_timestamp("ts").alias("ts"), *(F.lit("t").alias(c) for c in ("title", "url", "body", "metadata")))
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "a")], "centre string, node string")
    fragments, names = spark.createDataFrame([("b", "f")], "node string, fragment string"), spark.createDataFrame([("f", "F", "code")], "node string, name string, corp_code string")
    got = [P.node_details(pairs, e, docs, fragments, names, 2, m).collect() for e, m in ((edges, None), (edges.drop("doc_ids"), facts))]
    for out in got:
        said = {(r.centre, r.node): ([(x.predicate, x.evidence, x.source) for x in r.relations], [x.doc_id for x in r.evidence], r.company) for r in out}
        assert said == {("a", "b"): ([("SUPPLIES", 1, "news")], [1, 2], "f"), ("b", "a"): ([("SUPPLIES", 1, "filing")], [1], None), ("a", "a"): ([("SUPPLIES", 1, "filing")], [4], None)}


def test_scenarios_make_only_their_chunks_records(spark):
    """All records were linked, tiered and shuffled for the few chunks that are best hits, and these were searched anew for each frame: 5052 MB at 14 million line items."""
    sf = "/root/testdata/sf0.001"
    plan = registry.QUERIES["ret8_scenarios"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "embedding" not in plan
    chunks = spark.createDataFrame([("0",), ("7",), ("7",), ("150",), (None,), ("none",)], "chunk string")
    read = lambda name: registry.read(spark, sf, name)
    own, every = semantic_plans._frames(read, chunks), semantic_plans._frames(read)
    for name in ("linked", "unlinked", "evidence", "statements", "relations", "events"):
        got, want = getattr(own, name), getattr(every, name).join(chunks, "chunk", "left_semi").select(getattr(own, name).columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert own.linked.count() > 3


def test_copies_of_vectors_and_queries_are_few(spark):
    """A block of 2048 queries took a copy of all vectors, a slice of 8192 vectors one of all queries: with queries in proportion, disk grew with the square."""
    copied = lambda n: sum(x * y for x, y in zip(R.meetings(n // 50, n, 2048, 8192), (n, n // 50), strict=True))
    assert [R.meetings(n // 50, n, 2048, 8192) for n in (0, 2_000, 51_282, 102_564)] == [(1, 1), (1, 1), (1, 7), (2, 13)]
    assert copied(615_384) < 2.4 * 615_384 and copied(1_200_000) < 3.4 * 1_200_000  # 8.5 and 15 times before


def test_vectors_of_a_large_slice_meet_in_turns():
    rng = np.random.default_rng(8)
    unit = lambda n: pa.array(list(rng.normal(size=(n, 4))), pa.list_(pa.float64()))
    rows, asked = pa.table({"vec_id": np.arange(40_000), "unit": unit(40_000)}), pa.table({"qid": np.arange(200), "unit": unit(200)})
    tracemalloc.start()
    got = R._nearest(3)(rows, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # 40000 x 128 scores alone are 41 MB, and are copied to be sorted
    own = lambda t: np.array(t["unit"].to_pylist())
    want = np.argsort(-np.round(own(asked) @ own(rows).T, 9), axis=1, kind="stable")[:, :3]
    assert got["vec_id"].to_numpy().reshape(200, 3).tolist() == want.tolist()
