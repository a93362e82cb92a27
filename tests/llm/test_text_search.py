"""Ranked search, quality and phrases against plain versions, on odd rows and on the smallest tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relatrix.llm import lexical, phrases, quality, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, terms int, score double, n string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(terms(t))
    out = set()
    for i, own in wanted.items():
        rows = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0 and d is not None:
                rows.append((-score, d))
        out |= {(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(rows)[:top])}
    return out


ODD = [
    (1, "The CAT; the cat-the dog", "en"), (2, "cat", "en"), (2, "cat dog É", "en"), (3, None, None), (4, "", "en"), (None, "cat É bird", "de"), (5, "é É straße\x7fcat 日本 cat9", None),
    (6, "cats concat", "en"), (7, " \n\t.", "en"), (8, "dog " * 30000 + "bird", "en"), (9, "cat dog É", "en"), (10, "\x00cat\x00\x00dog\x01", "en"), (11, "DOG,dog.dog", "fr"),
]


def test_search_on_odd_rows(spark):
    items = [(1, "cat the"), (2, "DOG É bird"), (2, "straße"), (3, None), (4, "..."), (None, "cat"), (5, "absent"), (6, "日本 cat9 concat")]
    docs = spark.createDataFrame([(d, t, x, 1, 0.5, "x") for d, t, x in ODD], DOCS).repartition(3)
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, term int")
    want = ranked([(d, t) for d, t, _ in ODD], items)
    for limit in (lexical.BLOCK_BYTES, 40):  # one block, and about one an item
        assert {tuple(r) for r in lexical.search(docs, bench, limit=limit).collect()} == want
    assert lexical.search(docs.limit(0), bench).collect() == [] == lexical.search(docs, bench.limit(0)).collect()


def test_search_in_small_slices(spark, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    assert {tuple(r) for r in queries.op11_lexical(spark, SF).collect()} == ranked(docs, items)
    # slices of few documents give what one table gives
    names = sorted({t for _, c in held for t in c})[:400]
    item = np.arange(len(names)) % 7
    block = lexical.Block("x", [t.encode() for t in names], np.arange(len(names) + 1), item, np.arange(7))
    rows = [(d, sum(c.values()), [i for i, t in enumerate(names) if t in c], [c[t] for t in names if t in c]) for d, c in held]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
        names=["doc_id", "n", "terms", "tfs"],
    )
    shared = type("Shared", (), {"value": block})
    run = lambda: {tuple(x.values()) for b in lexical._rank(shared, np.arange(1, len(names) + 1), 10, 5000, 4)(iter([batch])) for x in b.to_pylist()}
    want = run()
    monkeypatch.setattr(lexical, "CELLS", 21)
    monkeypatch.setattr(lexical, "SPREAD", 10)
    assert run() == want


def mined(rows, least, longest=5, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = set()
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        good = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        gone = {k[i:j] for k, v in good.items() for i in range(len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) and v >= good[k[i:j]]}
        found = []
        for k, a in good.items():
            if k not in gone:
                s, _, x, y = min((1000 * a * n // (c[k[:j]] * c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k)))
                found.append((-s, -a, " ".join(k).encode(), a, x, y, n, s))
        out |= {(lang, i + 1, p.decode(), a, x, y, n, s) for i, (_, _, p, a, x, y, n, s) in enumerate(sorted(found)[:top])}
    return out


PHRASE_ROWS = [
    *[("the red Fox. jumps over the red fox, THE red", "en")] * 5, ("a a a a a a", "en"), ("x\ty  z x y z\nx y z", None), (None, None), ("", "en"), (" . ;\n", "de"), ("b a\x00 b a\x00 b a\x00", ""),
    ("the red\vthe red\fthe red", "en"), ("é è é è. " * 40, "fr"), ("日本 語 日本 語", "ja"), ("k l m n o p q " * 20000, "long"), ("k l m", "en"),
]


@pytest.mark.parametrize("shard", [phrases.SHARD_BYTES, 30])
def test_phrases_on_odd_rows(spark, shard):
    docs = spark.createDataFrame([(None if i % 3 else i, t, x, 1, 0.5, "n") for i, (t, x) in enumerate(PHRASE_ROWS)], DOCS).repartition(4)
    for least, longest, top in ((2, 5, 2000), (3, 3, 2), (1, 2, 2000)):
        assert {tuple(r) for r in phrases.mine_phrases(docs, least, longest, top, shard).collect()} == mined(PHRASE_ROWS, least, longest, top)
    assert phrases.mine_phrases(docs.limit(0)).collect() == [] == phrases.mine_phrases(docs, 10**6).collect()


def test_phrases_broadcast_and_shuffled(spark, monkeypatch):
    """The bound is passed never, by the triples (from then on by shuffling), by the pairs, or by the words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = mined([(r["text"], r["lang"]) for r in docs.collect()], 5)
    levels, _ = phrases.frequent_phrases(docs, 5)
    words, pairs, triples = (x.count() for x in levels[:3])
    assert len(want) > 100 and triples < words and triples < pairs
    for bound in (10**6, 0):
        monkeypatch.setattr(phrases, "BROADCAST_ROWS", bound)
        assert {tuple(r) for r in phrases.mine_phrases(docs, 5, shard_bytes=50_000).collect()} == want


def test_phrases_pass_the_bound_later(spark, monkeypatch):
    """Few words, ever more phrases of them: the shards go on by shuffling from the length that passes the bound."""
    rng = np.random.default_rng(0)
    rows = [(" ".join(rng.choice(list("abcde"), 60)), "en") for _ in range(40)]
    want = mined(rows, 3)
    docs = spark.createDataFrame([(i, t, x, 1, 0.5, "n") for i, (t, x) in enumerate(rows)], DOCS).repartition(3)
    for bound in (5, 30, 200):  # words 5, pairs 25, triples 125, then more
        monkeypatch.setattr(phrases, "BROADCAST_ROWS", bound)
        assert {tuple(r) for r in phrases.mine_phrases(docs, 3, shard_bytes=1000).collect()} == want


def test_counts_meet_in_packed_parts(monkeypatch):
    """A shard sends one row a part, however many phrases it has; the parts' sums are exact, and a common word is spread over all parts."""
    rng = np.random.default_rng(5)
    numbers, parts = 3_000_000, 7
    codes, want, rows = phrases.Codes(numbers, parts), Counter(), []
    for _ in range(6):
        pre, suf = np.unique(np.stack([rng.choice([0, 5, numbers - 1], 4000), rng.integers(0, 3000, 4000) * 999]), axis=1)
        n = rng.integers(1, 60, len(pre)).astype(np.int32)
        n = np.where(suf == 0, 1 << 40, n) if len(rows) < parts else n
        want.update({(int(a), int(b)): int(c) for a, b, c in zip(pre, suf, n, strict=True)})
        batch = codes.batch([(pre, suf, n)])
        assert batch.num_rows == parts == len(set(batch.column("part").to_pylist()))
        sizes = [len(codes.open(x["part"], x["data"])[0]) for x in batch.to_pylist()]
        assert max(sizes) < 1.5 * len(pre) / parts
        rows += batch.to_pylist()
    for held in (phrases.HELD, 500):
        monkeypatch.setattr(phrases, "HELD", held)
        got: Counter = Counter()
        for part in range(parts):
            own = pa.RecordBatch.from_pylist([x for x in rows if x["part"] == part], codes.batch([]).schema)
            for out in phrases._sums(codes, 100)(iter([own])):
                for x in out.to_pylist():
                    assert (x["pre"], x["suf"]) not in got
                    got[x["pre"], x["suf"]] = x["n"]
        assert got == {k: v for k, v in want.items() if v >= 100}


def test_interval_extension():
    rng = np.random.default_rng(3)
    text = np.concatenate([[0], rng.integers(0, 4, 300)])
    left, right = phrases.transform(text, 5), phrases.transform(text[::-1], 5)
    n = np.bincount(text)
    start = (np.cumsum(n) - n)[1:]
    names = {i: (i + 1,) for i in range(3)}
    live = (start, start, n[1:], np.arange(3))
    twice = np.concatenate([text, text[:5]])
    for k in range(2, 6):
        l, r, wide, pre, suf = phrases.extend(left, right, *live)  # noqa: E741
        now = {i: (*names[pre[i]], names[suf[i]][-1]) for i in range(len(l))}
        count = Counter(tuple(twice[i : i + k]) for i in range(len(text)) if all(twice[i : i + k]))
        assert {now[i]: w for i, w in enumerate(wide)} == count
        names, live = now, (l, r, wide, np.arange(len(l)))


def test_quality_shapes():
    assert [quality.shape(w) for w in ("EDTH!!", "Thre***", "word,", "a1b22", "|", "-----", "É", "")] == ["A!!", "Aa***", "a,", "a0a0", "|", "---", "Aa", ""]


def test_descent_solves_the_dual():
    """The solution of one block meets the conditions of the optimum: a row's dual value is 0, between, or the penalty as its margin is over, at, or under 1."""
    rng = np.random.default_rng(1)
    ratio = rng.normal(size=40)
    rows = [(int(i % 2), np.unique(rng.integers(0 if i % 2 else 10, 30 if i % 2 else 40, 8)).astype(np.uint32)) for i in range(60)]
    weights, epochs = np.zeros(40), quality.EPOCHS
    try:
        quality.EPOCHS = 3000
        quality.descend(weights, ratio, rows, rng)
    finally:
        quality.EPOCHS = epochs
    unit = [ratio[x] / np.linalg.norm(ratio[x]) for _, x in rows]
    loss = lambda w: w @ w / 2 + quality.PENALTY * sum(max(0.0, 1 - (2 * y - 1) * (w[x] @ v)) for (y, x), v in zip(rows, unit, strict=True))
    best = loss(weights)
    assert all(loss(weights + rng.normal(size=40) * s) >= best - 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_quality_counts_and_ratio(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    own = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    seen, words = np.zeros((2, 1 << quality.BITS)), quality.Words()
    for r in docs.collect():
        if r["doc_id"] in own:
            seen[own[r["doc_id"]], quality.grams(words, r["text"])] += 1
    p, q = seen[1] + 1, seen[0] + 1
    want = np.where(seen.sum(axis=0) > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0)
    assert np.allclose(model["ratio"], want, atol=1e-5)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op12_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    assert sum(right) / len(right) > 0.95
    assert all(r["predicted"] == 1 for r in rows if r["quality"] == 1)


def test_quality_on_odd_rows(spark):
    docs = [(None, "fine words here", "en"), (1, None, "en"), (2, "", "en"), (3, " \n", "en"), (4, "x" * 2_000_000, "en"), (4, "A!! B!! " * 200_000, "en"), (5, "fine words here", "en"), (5, "fine words here", "en")]
    docs += [(10 + i, "Some plain words here, and more." if i % 2 else "AB!! CD!! EF!!", "en") for i in range(60)]
    labels = [(10 + i, i % 2, 0) for i in range(60)] + [(11, 0, 0), (None, 1, 0), (4, None, 1), (12, 7, 0)]
    d = spark.createDataFrame([(i, t, x, 1, 0.5, "n") for i, t, x in docs], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.score_quality(d, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["score"] >= 0.3) == bool(r["doc_id"] % 2) for r in rows if r["doc_id"] is not None and r["doc_id"] >= 10)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in rows)
    # held-out labels teach nothing
    turned = lab.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(r["score"] for r in quality.score_quality(d, turned).collect()) == sorted(r["score"] for r in rows)
    assert {r["score"] for r in quality.score_quality(d, lab.limit(0)).collect()} == {0.5}
    assert quality.score_quality(d.limit(0), lab).collect() == []


def test_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    for name in ("op11_lexical", "op13_phrases"):
        df, r = queries.QUERIES[name](spark, "/root/testdata/sf0.01"), duck.execute(queries.ORACLES[name])
        assert [x[0] for x in r.description] == df.columns
        assert Counter(map(tuple, df.collect())) == Counter(r.fetchall())
