"""Chunks, keys and numbers of texts against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from relatrix.functions import lexicon as X
from relatrix.functions import scalars as S
from relatrix.operators import chunks as C
from relatrix.operators import sections as N


def test_blake2b(spark):
    texts = ["", "a", "한글 | x", "é" * 5000, None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.blake16(F.col("t")).alias("h")).collect()
    assert {r.i: r.h for r in got} == {i: None if t is None else hashlib.blake2b(t.encode(), digest_size=8).hexdigest() for i, t in enumerate(texts)}


def test_acronyms_are_not_expanded_again(spark):
    names = {"AB": "AB C", "C": "AB", "A-B": "x"}
    cases = {"AB C": "AB(AB C) C(AB)", "A-B AB(": "A-B(x) AB(", "ABC CAB": "ABC CAB", "C": "C(AB)", "": "", None: None, "AB": "AB(AB C)"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.expand_acronyms(F.col("t"), names).alias("y")).collect()
    assert {r.t: r.y for r in rows} == cases


@pytest.mark.parametrize("seed", range(4))
def test_splits(seed):
    """No word is lost or moved, no part is larger than the bound, and parts are as few as one pass can make them where one kind of cut is enough."""
    rng = random.Random(seed)
    for _ in range(200):
        words = [f"w{i}" + rng.choice(["", "", ".", "!"]) for i in range(rng.randrange(0, 200))]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\n\n", "\n\n\n", "\t"]) for w in words)
        most = rng.randrange(1, 40)
        parts = C.split_text(text, most)
        assert " ".join(parts).split() == words
        assert all(C.words(p) <= most for p in parts)
    assert C.split_text("a\n\nb\n\nc d", 2) == ["a\n\nb", "c d"]
    assert C.split_text("one two three. four five. six", 3) == ["one two three.", "four five. six"]
    assert C.split_text("x" * 50, 10, len) == ["x" * 50]  # no place to cut


def test_sections_do_not_meet(spark):
    rows = [(1, ["II"], "s1", " ".join(f"a{i}" for i in range(90))), (1, ["IV"], None, " ".join(f"b{i}" for i in range(90))), (2, ["II"], None, None), (3, ["II"], None, "short")]
    df = spark.createDataFrame(rows, "doc int, path array<string>, summary string, text string").repartition(1)
    chunks, parents = C.section_chunks(df, 10, 50, 40)
    got = chunks.collect()
    assert all(len({w[0] for w in r.content.split()}) <= 1 for r in got)
    assert [(r.split_idx, r.tokens, r.kind, r.is_split) for r in sorted(got, key=lambda r: (r.doc, r.path, r.split_idx)) if r.doc == 1] == [(0, 40, "text_macro", True), (1, 40, "text_macro", True), (2, 10, "text_micro", True)] * 2
    assert {(r.doc, r.content, r.kind) for r in got if r.doc > 1} == {(2, "", "text_micro"), (3, "short", "text_micro")}
    assert {(r.doc, r.path[0], r.parent_tokens, r.split_count) for r in parents.collect()} == {(1, "II", 90, 3), (1, "IV", 90, 3)}
    assert {r.parent_summary for r in parents.collect()} == {"s1", " ".join(f"b{i}" for i in range(90))[:200].strip()}


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_numbered_is_gapless(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
        rows = N.numbered(docs, "doc_id").select("doc_id", "row_no").orderBy("doc_id").collect()
        assert [r.row_no for r in rows] == list(range(docs.count())) == list(range(10_000))
        assert N.batches(docs).agg(F.sum(F.size("docs"))).first()[0] == 10_000
        odd = spark.createDataFrame([("b",), (None,), ("a",), ("b",), ("",)], "k string")
        assert sorted((r.row_no, r.k or "") for r in N.numbered(odd, "k").collect()) == [(0, ""), (1, ""), (2, "a"), (3, "b"), (4, "b")]
        assert N.numbered(odd.limit(0), "k").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_packs_close(spark):
    rows = [(1, [0, 0, 5, 0, 9, 1]), (2, []), (3, None), (4, [7, 1, 1])]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, s array<bigint>").select("i", N.packed(F.col("s"), 5).alias("p")).collect()}
    assert got == {1: [0, 0, 0, 0, 1, 2], 2: [], 3: None, 4: [0, 1, 1]}


def test_amount_forms(spark):
    cases = {"2024-01-01": None, "1-2": None, "12(3": None, "▲5": None, "△1,234": -1234, "(12.9)": -12, "-": None, " 7 ": 7, "1e3": 1000, "nan": None, None: None, "12f": None}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", S.parse_amount(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases


def test_noise(spark):
    """FIL10 against plain Python."""
    import re

    texts = ["a", "ab", "가나", "12", "--", "x" * 41, "ababab", "aaa", "abab", "가가가", "a1a1a1", "", "한 글", "abcabcabc", "삼성전자"]
    plain = lambda t: len(t) < 2 or len(t) > 40 or not any(x.isalpha() for x in t) or bool(re.search(r"(.{1,10})\1{2,}", t))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.noisy_surface(F.col("t")).alias("y")).collect()
    assert {r.t: r.y for r in got} == {t: plain(t) for t in texts}
