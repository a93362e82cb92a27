"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as symbols: insult (with a learned weight), violence, will, target, negation, report, other. Five small weighted
transducers (insult, threat, target, negation, reported speech) are composed into one: the output of each is the
input of the next and arc weights multiply, so a clause's words come out as hits such as "insult", "negated
insult" or "reported threat", and the final state says whether they are aimed at someone. A clause (all words
between stop marks) counts by its strongest hit; a document's logit is the best clause, a quarter of each further
one, and the base rate of documents without any match.

Learned from labelled training rows only: insult words and word beginnings (log-odds, kept if their
excess in toxic documents is significant against the number tried), a factor for each kind of hit (the final weights) and the base rate. A
feature needs a support of SUPPORT of the toxic training documents, so the lexicon has at most
(features a document) / SUPPORT entries, whatever the corpus. Training rows with the same set of word
shingles count once, lest one copied document teach its words; rows without words count one by one.

Cases: null and empty texts get the base rate; a null id scores like any other row and cannot be a
training row; contradictory labels of one id, or of equal texts, count as toxic; without any toxic training row every score is
the base rate; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, shingles, stored, tidy, utf8

SUPPORT, LEAST, PREFIXES = 0.002, 3, range(3, 8)
#: Labels up to this many are broadcast (about 100 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 300_000
#: Words, and counted features, that a task remembers.
REMEMBERED = 100_000
#: Least log-odds of an insult, and the logit below which the base rate is not believed.
STRONG, LOWEST = 3.0, -6.0
THREAT_KEY = "\0threat"
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
STOPS = frozenset(".!?;\n")

#: Fixed word lists of the grammar in four languages.
TARGET = frozenset("you your u he she they him her them his their tu vous ton votre toi il elle ils du dich dein ihr euch sie er usted ustedes vosotros ella ellos".split())
NEGATION = frozenset("not no never don doesn isn aren wasn ne pas jamais aucun nicht kein keine nie nunca ni jamas".split())
REPORT = frozenset("said says say wrote writes claimed called reported quoted dit disait selon sagte sagt behauptet laut dijo dice segun".split())
WILL = frozenset("will gonna going shall should must vais va allons werde wird werden voy vas vamos".split())
VIOLENCE = frozenset("kill hurt beat shoot stab burn destroy tuer frapper toten schlagen matar golpear".split())

class Transducer(NamedTuple):
    """arcs: (state, symbol) -> (state, symbol, weight), "*" for any other symbol; a missing arc passes the symbol on. final: state -> (name, weight)."""

    step: Callable
    start: object
    final: Callable


def transducer(arcs: dict, final: dict | None = None) -> Transducer:
    def step(state: int, symbol: str) -> tuple[int, str, float]:
        to, out, weight = arcs.get((state, symbol)) or arcs.get((state, "*")) or (state, symbol, 1.0)
        return to, symbol if out == "*" else out, weight

    return Transducer(step, 0, lambda state: (final or {}).get(state, ("", 1.0)))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """``second`` reads what ``first`` writes; arcs of the product are built as they are used."""

    @lru_cache(maxsize=None)
    def step(states: tuple, symbol: str) -> tuple[tuple, str, float]:
        a, middle, w = first.step(states[0], symbol)
        b, out, v = second.step(states[1], middle)
        return (a, b), out, w * v

    def final(states: tuple) -> tuple[str, float]:
        (name, w), (other, v) = first.final(states[0]), second.final(states[1])
        return " ".join(x for x in (name, other) if x), w * v

    return Transducer(step, (first.start, second.start), final)


HITS = ("insult", "threat")
INSULTS = transducer({(0, "insult"): (0, "insult", 1.0)})
#: A word of violence after one of intent is a threat; any other is no hit.
THREATS = transducer({(0, "will"): (1, "*", 1.0), (0, "violence"): (0, "other", 1.0), (1, "violence"): (1, "threat", 1.0)})
AIMED = transducer({(0, "target"): (1, "*", 1.0)}, {1: ("aimed", 1.2)})
#: A negation reaches the three next words.
NEGATED = transducer(
    {(n, "negation"): (3, "*", 1.0) for n in range(4)} | {(n, "*"): (n - 1, "*", 1.0) for n in (1, 2, 3)} | {(n, h): (0, f"negated {h}", 0.5) for n in (1, 2, 3) for h in HITS}
)
REPORTED = transducer({(0, "report"): (1, "*", 1.0)} | {(1, x + h): (1, f"reported {x}{h}", 0.5) for x in ("", "negated ") for h in HITS})
GRAMMAR = reduce(compose, (INSULTS, THREATS, AIMED, NEGATED, REPORTED))
#: How many documents the grammar's own weights are worth against those seen.
PRIOR = 4.0


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _fixed(word: str) -> str:
    for name, words in (("target", TARGET), ("negation", NEGATION), ("report", REPORT), ("will", WILL), ("violence", VIOLENCE)):
        if word in words:
            return name
    return "other"


def features(word: str) -> list[str]:
    """The word itself (closed by "$") and its beginnings."""
    return [word + "$", *(word[:n] for n in PREFIXES if n <= len(word))]


class Reader(dict):
    """Word -> (symbol, weight) under a learned lexicon; remembers words."""

    def __init__(self, lexicon: dict[str, float], factors: dict[str, float] | None = None) -> None:
        super().__init__()
        self.lexicon, self.factors = lexicon, factors or {}
        self.plain = {name: (name, 1.0) for name in ("target", "negation", "report", "will", "violence", "other")}

    def __missing__(self, word: str) -> tuple[str, float]:
        weight = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
        out = ("insult", weight) if weight else self.plain[_fixed(word)]
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """(kind of the strongest hit, its weight) of each clause with a hit: lexicon weight times arcs, then the kind's factor."""
        words = TOKEN.findall(text.lower())
        hits = [i for i, w in enumerate(words) if w not in STOPS and self[w][0] in ("insult", "violence")]
        out, done, stop = [], -1, -1
        for i in hits:
            if i <= done:
                continue
            first = i
            while first > stop + 1 and words[first - 1] not in STOPS:
                first -= 1
            done = i
            while done + 1 < len(words) and words[done + 1] not in STOPS:
                done += 1
            stop = done + 1
            state, found = GRAMMAR.start, []
            for w in words[first : done + 1]:
                symbol, own = self[w]
                state, said, weight = GRAMMAR.step(state, symbol)
                if said.endswith(HITS):
                    found.append((weight * (own if symbol == "insult" else self.lexicon.get(THREAT_KEY, 0.0)), weight, said))
            if found:
                name, last = GRAMMAR.final(state)
                best, arcs, said = max(found)
                kind = f"{name} {said}".strip()
                # a factor that was learned stands for the arcs' weights
                out.append((kind, best / arcs * self.factors[kind] if kind in self.factors else best * last))
        return out


def _count(wanted: frozenset | None, toxic_only: bool):
    """Documents holding each feature, by label; all features or the wanted ones."""

    def rows(toxic: int, counts: Counter) -> Iterator[pa.RecordBatch]:
        held = list(counts.items())
        for i in range(0, len(held), 10_000):
            f, n = zip(*held[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array([toxic] * len(f), pa.int32()), pa.array(n, pa.int64())], names=["feature", "toxic", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        kept: dict[str, tuple] = {}
        for batch in (part for whole in batches for part in pieces(whole)):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own: set[str] = {""}
                for word in set(TOKEN.findall((text or "").lower())) - STOPS:
                    if (f := kept.get(word)) is None:
                        f = tuple(features(word)) if wanted is None else tuple(x for x in features(word) if x in wanted)
                        if len(kept) >= REMEMBERED:
                            kept.clear()
                        kept[word] = f
                    own.update(f)
                seen[toxic].update(own)
                if len(seen[toxic]) > 2 * REMEMBERED:  # counts so far, to be summed by Spark
                    yield from rows(toxic, seen[toxic])
                    seen[toxic].clear()
        for toxic in (1,) if toxic_only else (0, 1):
            yield from rows(toxic, seen[toxic])

    return run


def _readings(lexicon):
    """Documents by label and their only kind of hit ("" without a match, "mixed" with several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(lexicon.value), Counter()
        for batch in (part for whole in batches for part in pieces(whole)):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                kinds = {k for k, _ in reader.clauses(text or "")}
                seen[(kinds.pop() if len(kinds) == 1 else "mixed" if kinds else "", toxic)] += 1
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], pa.string()), pa.array([t for (_, t), _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["feature", "toxic", "docs"])

    return run


def prior(kind: str) -> float:
    """The weight that the grammar's own arcs and final states give a kind of hit."""
    out = 1.2 if kind.startswith("aimed ") else 1.0
    return out * 0.5 ** (("negated" in kind) + ("reported" in kind))


def _tail(t: int, n: int, p: float) -> float:
    """Log of the chance of at least t successes of n (largest term of the tail times its length)."""
    if t <= n * p:
        return 0.0
    top = math.lgamma(n + 1) - math.lgamma(t + 1) - math.lgamma(n - t + 1) + t * math.log(p) + (n - t) * math.log1p(-p)
    return min(0.0, top + math.log(min(n - t + 1, 1 + n * p)))


def learn(train: DataFrame) -> dict:
    """Model from rows (text, toxic): lexicon, reading factors and base logit."""
    spark, schema = train.sparkSession, "feature string, toxic int, docs long"
    model = {"lexicon": {}, "factors": {}, "base": math.log(0.01 / 0.99)}
    toxic = train.where("toxic = 1").mapInArrow(tidy(_count(None, True)), schema).groupBy("feature").agg(F.sum("docs").alias("t"))
    total = toxic.where("feature = ''").first()
    if total is None or not total["t"]:
        return model
    big_t = total["t"]
    often = {r["feature"]: r["t"] for r in toxic.where((F.col("t") >= max(LEAST, SUPPORT * big_t)) & (F.col("feature") != "")).collect()}
    shared = spark.sparkContext.broadcast(frozenset(often))
    clean = train.where("toxic = 0").mapInArrow(tidy(lambda it: _count(shared.value, False)(it)), schema).where("toxic = 0").groupBy("feature").agg(F.sum("docs").alias("n"))
    counts = {r["feature"]: r["n"] for r in clean.collect()}
    big_n = counts.get("", 0)
    rate = big_t / (big_t + big_n) if big_n else 0.5
    lexicon = {}
    for f, t in often.items():
        n = counts.get(f, 0)
        weight = math.log((t + 0.5) / (big_t + 1)) - math.log((n + 0.5) / (big_n + 1))
        if t >= 9 * n and weight > STRONG and _tail(t, t + n, rate) + math.log(len(often)) < math.log(0.01):
            lexicon[f] = weight
    # a beginning that is seen almost only in one longer feature is that feature
    longest: dict[str, int] = {}
    for f in lexicon:
        for n in PREFIXES:
            if n < len(f):
                longest[f[:n]] = max(longest.get(f[:n], 0), often[f])
    lexicon = {f: w for f, w in lexicon.items() if longest.get(f, 0) < 0.9 * often[f]}
    # a beginning at least as strong makes the longer feature idle
    model["lexicon"] = {f: w for f, w in lexicon.items() if not any(lexicon.get(f[:n], 0.0) >= w for n in PREFIXES if n < len(f))}
    if model["lexicon"]:
        model["lexicon"][THREAT_KEY] = sorted(model["lexicon"].values())[len(model["lexicon"]) // 2]
    held = spark.sparkContext.broadcast(model["lexicon"])
    seen = Counter()
    for r in train.mapInArrow(tidy(_readings(held)), schema).groupBy("feature", "toxic").agg(F.sum("docs").alias("docs")).collect():
        seen[r["feature"], r["toxic"]] += r["docs"]
    logit = lambda k: math.log((seen[k, 1] + 0.5) / (seen[k, 0] + 0.5))
    model["base"] = max(LOWEST, min(logit(""), -0.5))
    for reading in {k for k, _ in seen} - {"", "mixed", "insult"}:
        n = seen[reading, 0] + seen[reading, 1]
        plain = max(0.5, logit("insult") - model["base"])
        own = max(0.0, min(1.5, (logit(reading) - model["base"]) / plain))
        if n and seen[reading, 1] / n >= 0.9:
            own = max(own, 1.0)  # as toxic as can be told from so many documents
        model["factors"][reading] = (own * n + prior(reading) * PRIOR) / (n + PRIOR)
    return model


def _scores(model: dict) -> Callable[[list], tuple[list, list]]:
    reader = Reader(model["lexicon"], model["factors"])

    def scores(texts: list) -> tuple[list, list]:
        out, clauses = [], []
        for text in texts:
            found = sorted((w for _, w in reader.clauses(text or "")), reverse=True)
            logit = model["base"] + (found[0] + 0.25 * sum(found[1:]) if found else 0.0)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
            clauses.append(len(found))
        return out, clauses

    return scores


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(shared.value)
        for batch in (part for whole in batches for part in pieces(whole)):
            out, clauses = scores(batch.column("text").to_pylist())
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.float64()), pa.array(clauses, pa.int32())], names=[*names, "score", "n_clauses"])

    return run


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the 128-bit hash of their shingle set; without words, a hash of the row's id."""
    for batch in (part for whole in batches for part in pieces(whole)):
        ids = batch.column("doc_id").to_pylist()
        keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else str(i).encode() for x, i in zip(shingles(utf8(batch.column("text"))), ids, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(keys, pa.binary()), batch.column("text")], names=["doc_id", "toxic", "family", "text"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled training rows, one for each set of shingles; a written table."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    small = labels.count() <= BROADCAST_ROWS
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.join(F.broadcast(labels) if small else labels, "doc_id")
    rows = stored(rows.mapInArrow(tidy(_family), "doc_id long, toxic int, family binary, text string"), "labelled")
    firsts = rows.groupBy("family").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("label"))
    firsts = rows.join(F.broadcast(firsts) if small else firsts, ["family", "doc_id"])
    return stored(firsts.select("text", F.col("label").alias("toxic")), "training")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, n_clauses of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(training_rows(docs, labels)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(tidy(_score(model)), "doc_id long, held_out boolean, score double, n_clauses int")


def keep_civil(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The documents that score below ``limit``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(training_rows(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(model.value)
        for batch in (part for whole in batches for part in pieces(whole)):
            yield batch.filter(pa.array([s < limit for s in scores(batch.column("text").to_pylist())[0]], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
