"""The training-data operators against plain versions, on the smallest tables and on odd rows."""

import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relatrix.llm import decontaminate, grammar, language_model, line_dedup, near_dedup, neighbours, packing, repeats, sharding, tokens, toxicity
from relatrix.llm.common import components, table
from relatrix.llm.tokens import default_tokenizer, encoder

from . import brute

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"word{i}" for i in range(40))
ODD = [
    (1, None), (2, ""), (3, "one"), (4, "one"), (5, PASSAGE), (6, PASSAGE + " tail"), (7, "x " * 3000), (8, f"Head.\n{PASSAGE}\nfoot line of ten\n\n"),
    (9, f"  FOOT line of ten\t\n{PASSAGE}"), (10, "é ü 한국어 <|endoftext|> a  b"), (11, "a b c d e"), (12, "You are not an idiot. He said idiot!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7, "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, key int, shard string")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def both(docs, odd):
    return [docs, odd, odd.where("false")]


def test_language_model(docs, odd):
    for df in both(docs, odd):
        want = brute.base_scores(rows_of(df))
        got = language_model.score_documents(df, passes=1).collect()
        assert len(got) == len(want)
        for r in got:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
            assert r.base_score == pytest.approx(want[r.doc_id][4]) and r.score < 0
    held = language_model.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_language_model_of_odd_tables(spark):
    """More frequent words than the end token by far, rows of one id with different texts, null ids."""
    many = " ".join(f"w{i}" for i in range(9000))
    rows = [(3, many + " " + many), (4, many + " " + many), (5, "w1 w2 never1"), (5, "w3 " * 7), (5, None), (None, "w1 new"), (6, "zz " * 200_000)]
    want = Counter()
    for d, t, ref in brute.base_scores_by_row(rows):
        want[d, ref[0], ref[1], ref[2], ref[3], round(ref[4], 4)] += 1
    got = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), passes=1).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_groups_are_bounded():
    """A text of 200,000 words beside thousands of short ones: no grid is larger than its bound, or than one sequence."""
    rng = np.random.default_rng(2)
    seqs = [np.zeros(200_000, np.uint16), np.zeros(20_000, np.uint16), *(np.zeros(n, np.uint16) for n in rng.integers(1, 400, 9000))]
    seen = []
    for take, grid in language_model.groups(seqs, 4_000_000):
        assert grid.size <= 8_000_000 and (grid >= 0).sum() == sum(len(seqs[i]) for i in take) <= 4_000_000
        seen += take
    assert sorted(seen) == list(range(len(seqs)))


def test_expected_counts_hold_a_group_once():
    """Two million ids: 175 MB at once while forward values, shares and their concatenation lay beside each other."""
    rng = np.random.default_rng(4)
    classes = language_model.TOP + 1 + language_model.TAILS
    seqs = [rng.integers(0, classes, n).astype(np.uint16) for n in rng.integers(200, 500, 6000)]
    model = language_model._starting_model(np.full(classes, 1 / classes))
    tracemalloc.start()
    first, moves, emits, _ = language_model.expected_counts(*model, seqs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    ids = np.concatenate(seqs)
    assert first.sum() == pytest.approx(len(seqs)) and moves.sum() == pytest.approx(len(ids) - len(seqs), rel=1e-5)
    assert emits.sum(axis=1) == pytest.approx(np.bincount(ids, minlength=classes), rel=1e-4)


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T
    seqs = [np.array(x) for x in ([0, 1, 2, 3], [4], [2, 2])]
    for take, grid in language_model.groups(seqs):
        for i, got in zip(take, language_model.forward(start, move, emit, grid), strict=True):
            total = 0.0
            for path in np.ndindex(*[3] * len(seqs[i])):
                p = start[path[0]] * emit[seqs[i][0], path[0]]
                for t in range(1, len(path)):
                    p *= move[path[t - 1], path[t]] * emit[seqs[i][t], path[t]]
                total += p
            assert got == pytest.approx(np.log(total))


def test_near_duplicates(docs, odd):
    for df in both(docs, odd):
        want = brute.near_groups(rows_of(df))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
        assert got == want


def test_near_duplicates_of_a_loose_family(spark):
    """Copies that are alike to one text, to a few or to none, in buckets that are dealt in parts."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            words[at] = f"new{i}_{at}"
        rows.append((i, " ".join(words)))
    want = brute.near_groups(rows)
    assert 1 < len({c for _, c in want.values()}) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for members, elements in ((512, 1_000_000), (16, 1_000_000), (512, 3000)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, members=members, elements=elements).collect()}
        assert got == want


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(1, 1 << 63, 100, dtype=np.uint64)])
    sig = near_dedup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 400), 2)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_decontaminate(spark, docs, odd):
    items = table(spark, SF, "benchmark")
    planted = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "one"), (4, ""), (5, "a b c d e")], "item_id long, text string")
    for df, bench in ((docs, items), (odd, planted), (odd, planted.where("false"))):
        want = brute.contaminated(rows_of(df), [(r.item_id, r.text) for r in bench.collect()])
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want
    assert decontaminate.keep_clean(odd, planted).columns == odd.columns


def test_decontaminate_tries_every_start(spark, docs):
    edited, plain = [], []
    for i, (n, first, last, middle) in enumerate(((200, 10, 10, 20), (100, 4, 4, 8), (50, 1, 1, 2))):
        own = [f"w{i}x{j}" for j in range(n)]
        new = [f"new{i}x{j}" for j in range(n)]
        text = [*new[:first], *own[first : n // 2], *new[first : first + middle], *own[n // 2 : n - last], *new[-last:]]
        edited.append((i, " ".join(["before"] * 30 + text + ["after"] * 30)))
        plain.append((i, " ".join(own)))
    odd = [(10, "x y " * 60), (11, "p " * 40 + "x y " * 9), (12, "y x y x y x y"), (13, "a b"), (14, None), (15, "\x0b\x0cx y x y\x0cb f\x0b x0b É\r"), (16, " \t\x0c ")]
    plain += [(20, "x y " * 10), (21, "x y x y x y"), (22, "a b c d e f"), (23, "p"), (24, ""), (25, "X Y x y b F x0b É"), (26, "f"), (27, "b f x0b é")]
    want = brute.contaminated_anywhere([*edited, *odd], plain)
    assert {(0, 0), (1, 1), (2, 2)} <= set(want)
    frames = [spark.createDataFrame(x, f"{c} long, text string") for x, c in ((edited + odd, "doc_id"), (plain, "item_id"))]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.contaminated(*frames).collect()}
    assert got == want
    items = table(spark, SF, "benchmark")
    want = brute.contaminated_anywhere(rows_of(docs), [(r.item_id, r.text) for r in items.collect()])
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.contaminated(docs, items).collect()} == want


def test_decontaminate_with_repeated_words(spark):
    """Items whose end is replaced by one word or pair of words many times, all just over the limit."""
    import random

    rng = random.Random(5)
    edited, plain = [], []
    for i in range(150):
        n, keep, end = ((100, 87, "foo"), (200, 174, "-"), (200, 174, "the of"))[i % 3]
        own = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        tail = (end.split() * n)[: n - keep]
        edited.append((i, " ".join([*own[:keep], *tail] if i % 2 else [*tail, *own[-keep:]])))
        plain.append((i, " ".join(own)))
        if i % 5 == 0:  # and items that repeat a word themselves
            plain[-1] = (i, " ".join([*own[: n - 30], *["rep"] * 30]))
            edited[-1] = (i, " ".join([*own[: n - 30], *["rep"] * 18, *["other"] * 12]))
    want = {(d, d) for d, t in edited if brute.contaminated_anywhere([(d, t)], [plain[d]])}
    frames = [spark.createDataFrame(x, f"{c} long, text string") for x, c in ((edited, "doc_id"), (plain, "item_id"))]
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(*frames).collect()} == want and len(want) >= 120
    assert {r.doc_id for r in decontaminate.keep_clean(*frames).collect()} == {d for d, _ in edited} - {d for d, _ in want}


def test_anchors_do_not_depend_on_slices():
    gram = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64)
    gram[1000:1300] = gram[1000]
    whole = repeats.leftmost_least(gram, 76)
    assert (whole == repeats.leftmost_least(gram, 76, 6)).all() and len(whole) == 4925
    top = gram >> np.uint64(26)
    assert all(w == i + int(np.argmin(top[i : i + 76])) for i, w in enumerate(whole))
    assert len(repeats.leftmost_least(gram[:75], 76)) == 0


def test_repeats(docs, odd):
    for df in both(docs, odd):
        want = brute.repeats(rows_of(df))
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
        assert got == want


def test_repeats_of_repeated_ids(spark):
    """Rows of one id with different texts are documents of their own; equal rows share one result."""
    rng = np.random.default_rng(6)
    word = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(n))
    p, q = word(40), word(40)
    rows = [(1, p), (2, p), (2, q), (3, q + p), (3, q + p), (None, p), (None, q), (4, word(3) + p[:120]), (5, None), (5, p[20:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    version = {(r.doc_id, r.text): r.v for r in df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) v").collect()}
    once = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], version[r]))
    plain = brute.repeats([(i, t) for i, (_, t) in enumerate(once)])
    want = Counter((d, *plain[once.index((d, t))]) if d is not None else (d, len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.remove_repeats(df).collect()) == want


def test_meetings_of_an_anchor_that_fills_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "BLOCK_SEGMENTS", 4)
    kinds = [(a, c) for a, n in ((1, 1), (2, 3), (3, 11), (4, 4), (5, 5)) for c in range(n)]
    rows = sorted((a, c, d, 0, (5 << 7) | 3) for a, c in kinds for d in ((1, 2) if c % 2 else (1,)))
    for size in (1, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + size], strict=True)], names=list("abcde")) for i in range(0, len(rows), size)]
        out = [r for b in repeats._meet(iter(batches)) for r in b.to_pylist()]
        assert sum(r["anchor"] is None for r in out) == sum(c % 2 for _, c in kinds)
        met = Counter((r["anchor"], r["several"]) for r in out if r["anchor"] is not None)
        assert met == {(2, False): 3, (3, True): 11, (4, False): 4, (5, True): 5}
        assert max(Counter((r["anchor"], r["block"]) for r in out if r["anchor"] is not None).values()) <= 4


def test_common_prefix_bounds():
    text = np.frombuffer(b"abracadabra" * 30 + b"xyz", dtype=np.uint8).astype(np.int64) + 1
    order = repeats.suffix_order(text)
    low = repeats.common_prefix_bounds(text, order, 20)
    raw = text.tolist()
    for i in range(1, len(order)):
        a, b = raw[order[i - 1] :][:20], raw[order[i] :][:20]
        if len(a) == 20 and len(b) == 20:
            assert low[i] == (a != b)


def test_line_dedup(docs, odd):
    import hashlib

    for df in both(docs, odd):
        want = brute.lines(rows_of(df))
        got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in line_dedup.dedup_lines(df).collect()}
        assert got == want


def test_word_classes_and_counts_in_slices(monkeypatch):
    """Words beyond the memory's bound have their class all the same; expected emissions add up to a row an id, whatever the slices."""
    monkeypatch.setattr(language_model, "_HELD", 3 - language_model.TOP)
    words = [b"top", b"rare", b"x", "caf\u00e9".encode(), "\u65e5\u672c\u8a9e".encode(), b"once", b"more"]
    classes = language_model.Classes({b"top": 0})
    want = [0, *(language_model.TOP + 1 + zlib.crc32(w.decode()[-2:].encode()) % language_model.TAILS for w in words[1:])]
    assert [classes[w] for w in words * 2] == want * 2 and len(classes) == 3
    rng = np.random.default_rng(2)
    model = language_model._starting_model(np.full(20, 0.05))
    seqs = [rng.integers(0, 20, n).astype(np.uint16) for n in (40, 1, 7, 40, 300)]
    whole = language_model.expected_counts(*model, seqs)
    monkeypatch.setattr(language_model, "_SLICE", 13)
    parts = language_model.expected_counts(*model, seqs)
    assert np.allclose(whole[2], parts[2]) and np.allclose(whole[2].sum(axis=1), np.bincount(np.concatenate(seqs), minlength=20), rtol=1e-4)


def test_encoder_remembers_pieces_met_late(monkeypatch):
    """A piece that comes after 600,000 others is remembered, and the memory stays within its bound."""
    enc = tokens.Encoder(default_tokenizer())
    made = []
    monkeypatch.setattr(enc, "_plain", lambda spelled: made.append(1) or spelled.encode())
    for i in range(600_000):
        enc[f"{i:06x}".translate({48 + d: 113 + d for d in range(10)})]
    late = [f"{i:06x}".translate({48 + d: 113 + d for d in range(10)}) for i in range(590_000, 600_000)]
    n = len(made)
    assert n == 600_000 and [enc[x] for x in late] == [("\u0120" + x).encode() for x in late] and len(made) == n
    monkeypatch.setattr(enc, "LIMIT", 600_010)
    for i in range(30):
        enc["z" * 10 + chr(97 + i % 26) * (1 + i // 26)]
    assert len(enc) == 600_010


def test_encoder_equals_library():
    e = encoder(default_tokenizer())
    texts = [t for _, t in ODD if t] + ["a  b", " x ", "a\n b", "don't stop it's", "a\tb c", "x\x1cy z", "1 23a b4.,", "a\r\nb c", "日本 語。"]
    for t in texts:
        assert np.frombuffer(e.ids(t), dtype="<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_grammar_round_trip(docs, odd):
    e = encoder(default_tokenizer())
    for df in both(docs, odd):
        start = 0
        got = {r.doc_id: r for r in grammar.round_trip(df).collect()}
        for d, t in sorted(rows_of(df)):
            ids = np.append(np.frombuffer(e.ids(t), dtype="<u4"), np.array([2], "<u4"))
            r = got.pop(d)
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
        assert not got


def test_grammar_random_access():
    rng = np.random.default_rng(2)
    ids = np.tile(rng.integers(0, 50, 40), 60).astype("<u4")
    sym, docs, terms, rules, spans = grammar.repair(ids, np.zeros(len(ids), int))
    assert len(sym) < len(ids) / 4
    assert (grammar.expand(sym, terms, rules, spans) == ids).all()
    for a, b in ((0, 5), (17, 1203), (2399, 2400)):
        assert (grammar.slice_ids(sym, terms, rules, spans, a, b) == ids[a:b]).all()


def test_grammar_looks_only_at_changed_places(monkeypatch):
    """Ten rounds read every place of the block anew; now a round reads what the last one changed or left frequent."""
    rng, seen, repeated = np.random.default_rng(3), [], grammar._repeated
    ids = np.concatenate([np.tile(rng.integers(0, 50, 64), 40), rng.integers(100, 60_000, 50_000)])
    monkeypatch.setattr(grammar, "_repeated", lambda sym, at, *more: seen.append(len(at)) or repeated(sym, at, *more))
    sym, docs, terms, rules, spans = grammar.repair(ids, np.zeros(len(ids), int))
    assert (grammar.expand(sym, terms, rules, spans) == ids).all()
    assert len(seen) > 3 and max(seen[1:]) < 6000


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(9)
    ids, owner = (rng.zipf(1.3, 30_000) % 300).astype("<u4"), np.sort(rng.integers(0, 40, 30_000))
    sym, docs, terms, rules, spans = grammar.repair(ids, owner)
    assert (grammar.expand(sym, terms, rules, spans) == ids).all()
    pairs, last = Counter(), {}
    for i in range(len(sym) - 1):  # occurrences that do not overlap
        p = (int(sym[i]), int(sym[i + 1]))
        if docs[i] == docs[i + 1] and last.get(p) != i - 1:
            pairs[p] += 1
            last[p] = i
    assert max(pairs.values()) < 2 * grammar.LEAST
    for r, (a, b) in enumerate(rules.tolist()):
        assert max(a, b) < len(terms) + r
        assert spans[r] == sum(1 if x < len(terms) else spans[x - len(terms)] for x in (a, b))


def test_packing(docs, odd):
    e = encoder(default_tokenizer())
    for df in both(docs, odd):
        texts, fill, at = dict(rows_of(df)), {}, {}
        for r in sorted(packing.pack_documents(df).collect(), key=lambda r: (r.doc_id, r.start)):
            ids = np.append(np.frombuffer(e.ids(texts[r.doc_id]), dtype="<u4"), np.array([1], "<u4"))
            assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at[r.doc_id] = r.start + r.length
            fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert set(at) == set(texts)
        for pieces in fill.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end == 2048 or end & (end - 1) == 0


def test_sharding(docs, odd):
    for df in both(docs, odd):
        got = sharding.shard_documents(df).collect()
        assert len(got) == df.count()
        shards = {}
        for r in got:
            assert r.grown_shard in (r.shard, 16)
            shards.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_toxicity(spark, docs, odd):
    labels = table(spark, SF, "labels")
    assert toxicity.score_toxicity(odd, labels).count() == len(ODD)
    assert toxicity.score_toxicity(odd, labels.where("false")).select("score").distinct().count() == 1
    texts = [f"the quick {'idiot' if i % 3 == 0 else 'fox'} number{i} of plain{i} words{i}" for i in range(300)]
    train = spark.createDataFrame([(t, int(i % 3 == 0)) for i, t in enumerate(texts)], "text string, toxic int")
    model = toxicity.learn(train)
    assert any(f.startswith("idi") for f in model["lexicon"])
    said = dict(toxicity.Reader({"idiot$": 5.0}).clauses("You are not an idiot. He said: idiot!"))
    assert said == {"aimed negated insult": pytest.approx(3.0), "aimed reported insult": pytest.approx(3.0)}


def test_toxicity_reads_whole_clauses():
    reader = toxicity.Reader({"idiot$": 4.0, "moron$": 6.0, toxicity.THREAT_KEY: 5.0}, {"aimed insult": 1.5})
    far = "word " * 500
    assert reader.clauses(f"you {far} idiot") == [("aimed insult", 6.0)]
    assert reader.clauses(f"he said {far} idiot") == [("aimed reported insult", pytest.approx(4 * 0.5 * 1.2))]
    assert reader.clauses("not an idiot but a moron") == [("insult", 6.0)]  # the strongest hit, with its own reading
    assert reader.clauses("he is not a moron") == [("aimed negated insult", pytest.approx(6 * 0.5 * 1.2))]
    assert reader.clauses("I will hurt you. We hurt. I will not kill it") == [("aimed threat", pytest.approx(6.0)), ("negated threat", pytest.approx(2.5))]
    assert reader.clauses("said not a real idiot") == [("reported negated insult", pytest.approx(1.0))]
    assert reader.clauses("") == reader.clauses(". .\n") == []
    for kind, want in (("aimed reported negated insult", 0.3), ("threat", 1.0), ("negated insult", 0.5)):
        assert toxicity.prior(kind) == pytest.approx(want)


def test_toxicity_contract(spark):
    rows = [(i, f"the {'idiot' if i % 8 == 0 else 'fox'} number{i} of plain{i} words{i}") for i in range(400)] + [(8, "a fox again"), (None, "idiot"), (None, None), (900, None), (901, " ")]
    docs = spark.createDataFrame([(d, t, 0.5, "x") for d, t in rows], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 1
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((d, held(d)) for d, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.score >= 0.7} == {*range(0, 400, 8), None}
    kept = toxicity.keep_civil(docs, labels)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.score < 0.7)
    # labels of held-out rows teach nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert Counter((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, flipped).collect()) == Counter((r.doc_id, r.score) for r in got)


def test_neighbours(spark):
    vectors = table(spark, SF, "embeddings")
    want = brute.nearest([(r.vec_id, r.embedding) for r in vectors.collect()], lambda i: i % 100 == 0)
    got = {}
    for r in neighbours.search_all(vectors).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for i, _ in v}) for q, v in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, [1.0])]
    small = neighbours.search_all(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(small, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 5)]
    assert neighbours.search_all(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_budget_grows(spark):
    rng = np.random.default_rng(8)
    for n, rows in ((8000, 500), (11000, neighbours.ROWS)):
        data = rng.standard_normal((n, 64))
        data[1000:4000] = data[1000]  # a hot group
        data = [(i, v) for i, v in enumerate(data.tolist())]
        want = brute.nearest(data, lambda i: i % 100 == 0)
        frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        got = {q: [] for q in want}
        for r in neighbours.search_all(frame, rows=rows).collect():
            got[r.query_id].append(r.vec_id)
        hits = sum(len(set(got[q]) & {i for i, _ in v}) for q, v in want.items() if not 1000 <= q < 4000)
        all_ = sum(len(v) for q, v in want.items() if not 1000 <= q < 4000)
        assert hits >= 0.9 * all_
        if n > rows:
            rows_of_all = neighbours.search_all(frame, exact=True).collect()
            assert {(r.query_id, r["rank"], r.vec_id) for r in rows_of_all} == {(q, i + 1, v) for q, found in want.items() for i, (v, _) in enumerate(found)}


def test_forest_recall():
    rng = np.random.default_rng(4)
    data = rng.standard_normal((3000, 8))
    forest = neighbours.Forest(data, 5)
    leaves = forest.leaves(data)
    held = np.array([np.bincount(x, minlength=32) for x in leaves])
    found = forest.search(data[0], held, 600)
    near = np.argsort(((data - data[0]) ** 2).sum(axis=1))[:10]
    seen = {i for t, leaf in found for i in np.flatnonzero(leaves[t] == leaf)}
    assert len(seen & set(near.tolist())) >= 9
