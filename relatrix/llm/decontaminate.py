"""Benchmark decontamination (DataFrame functions only).

A window as long as a benchmark item slides over every document. Of all its places those are read that end
with a shingle of five words which the item holds too, or that begin the document: a window that ends with
another shingle loses nothing when it moves left, so the first of the best windows is always among them. A
window with fewer such shingles than the wanted similarity takes is left out. Similarity is the weighted Jaccard
similarity of the shingles, a shingle's weight being how often it occurs: sum of the smaller over sum of the larger weights. With
the occurrences of a shingle numbered (first, second, ...), that is the plain similarity of two sets, whatever repeats.

Windows and items get PRINTS independent 64-bit SimHash fingerprints of these sets. Fingerprints are cut into BLOCKS blocks; two within RADIUS bits agree in
some block up to RADIUS // BLOCKS bits, so an index of all such variants of the items' blocks finds every
item within the radius. Each one found is confirmed on the full sets.

Sets at similarity 0.75 share at least 6/7 of their members, so they are at most 31 degrees apart and a bit differs with a chance of
0.172 at most: 11 of 64 bits are expected, and more than 20 in 0.18 % of the pairs at that very limit. A pair is lost if it is beyond the radius in all
three fingerprints, less than once in 10**8 pairs at the limit; closer pairs are safer still.

Cases: null, empty and wordless texts and items match nothing; items under five words have one shingle,
the whole item; documents shorter than an item are one window; of equally similar windows the first is
reported; rows of a repeated id count as one document; null ids are not reported; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, RADIUS, BLOCKS, PRINTS = 5, 20, 7, 3
#: Items' shingles up to this many are broadcast (16 bytes each); more are joined by shuffling.
BROADCAST_SHINGLES = 500_000
_LOWER = "if(octet_length(text) = length(text), lower(text), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"  # of ASCII, lower() is the same and faster
_SPACE = "' \\t\\n\\u000b\\u000c\\r'"
#: Words of the column ``text``; between the ends no piece is empty.
_WORDS = f"case when trim(both {_SPACE} from text) <> '' then split(trim(both {_SPACE} from {_LOWER}), '[\\\\x20\\\\x09-\\\\x0D]+') else cast(array() as array<string>) end"


def _grams(words: str, k: int) -> str:
    """Hashes of all k-word shingles of an array column with at least k words; each word is hashed once."""
    own = f"transform({words}, w -> xxhash64(w))"
    if k == 1:
        return own
    return f"transform(array({own}), h -> transform(sequence(0, size(h) - {k}), i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(k))})))[0]"


def numbered(grams: str) -> str:
    """Hashes of an array's members with their number among equal ones, so that all differ."""
    return f"transform(array(array_sort({grams})), s -> transform(s, (x, i) -> xxhash64(x, i - array_position(s, x))))[0]"


def simhash(members: str, seed: int = 0) -> str:
    """64-bit SimHash of an array of hashes: each bit by the majority of the members' hashes under the seed."""
    hashes = f"transform({members}, x -> xxhash64(x, {seed}))"
    ones = "aggregate(h, 0, (n, x) -> n + if((shiftright(x, b) & 1) = 1, 1, -1))"
    return f"aggregate(transform(array({hashes}), h -> transform(sequence(0, 63), b -> if({ones} > 0, shiftleft(1L, b), 0L)))[0], 0L, (a, x) -> a | x)"


def _prints(members: str) -> str:
    return f"array({', '.join(simhash(members, seed) for seed in range(PRINTS))})"


def _blocks() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    base, more = divmod(64, BLOCKS)
    sizes = [base + (i < more) for i in range(BLOCKS)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def _block_values(near: int) -> str:
    """SQL array of (block, value) of the column ``print``, with every value up to ``near`` bits away."""
    out = []
    for i, (first, bits) in enumerate(_blocks()):
        masks = [sum(1 << b for b in flips) for n in range(near + 1) for flips in combinations(range(bits), n)]
        value = f"(shiftrightunsigned(print, {first}) & {(1 << bits) - 1}L)"
        out.append(f"transform(array({', '.join(f'{m}L' for m in masks)}), m -> struct({i} as block, {value} ^ m as value))")
    return f"flatten(array({', '.join(out)}))"


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, distance): the best window for each pair that reaches ``percent``."""
    items = items.select("item_id", F.expr(_WORDS).alias("iw")).where("item_id is not null and size(iw) > 0")
    items = items.withColumn("k", F.least(F.lit(SIZE), F.size("iw"))).withColumn("n", F.size("iw"))
    sizes = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()]  # 1 to SIZE
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start_word int, n_words int, distance int")
    words = docs.select("doc_id", F.expr(_WORDS).alias("w")).where("doc_id is not null")

    def met(k: int) -> DataFrame:
        own = items.where(F.col("k") == k).select("item_id", "n", F.explode(F.array_distinct(F.expr(_grams("iw", k)))).alias("h"))
        if own.count() <= BROADCAST_SHINGLES:
            own = F.broadcast(own)
        seen = words.where(F.size("w") >= k).select("doc_id", F.size("w").alias("m"), F.posexplode(F.expr(_grams("w", k))).alias("p", "h"))
        at = seen.join(own, "h").groupBy("doc_id", "m", "item_id", "n").agg(F.array_sort(F.collect_set("p")).alias("at"))
        # shared / (own + item's - shared) >= percent / 100 needs this many shared shingles
        at = at.withColumn("least", F.expr(f"cast(greatest(1, ceil({percent} * (n + least(m, n) - {2 * k - 2}) / {100 + percent}D - 1e-6)) as int)"))
        ends = f"filter(sequence(0, size(at) - 1), i -> i + 1 >= least and at[i] - at[greatest(0, i + 1 - least)] <= n - {k})"
        starts = F.expr(f"array_distinct(transform({ends}, i -> greatest(0, at[i] - n + {k})))")
        return at.select("doc_id", F.lit(k).alias("k"), "n", F.explode(starts).alias("start"))

    windows = reduce(DataFrame.unionByName, [met(k) for k in sizes]).distinct()
    whole = docs.select("doc_id", "text").join(windows.groupBy("doc_id").agg(F.collect_set(F.struct("k", "n", "start")).alias("places")), "doc_id")
    whole = whole.select("doc_id", F.expr(_WORDS).alias("w"), "places").select("doc_id", "w", F.explode("places").alias("at"))
    pick = lambda c: "case " + " ".join(f"when k = {k} and size({c}) >= {k} then {_grams(c, k)}" for k in sizes) + " else cast(array() as array<bigint>) end"
    whole = whole.select("doc_id", "at.*", F.expr("slice(w, at.start + 1, at.n)").alias("window"))
    whole = whole.select("doc_id", "k", "n", "start", F.size("window").alias("n_words"), F.expr(numbered(pick("window"))).alias("a"))
    whole = whole.select("*", F.posexplode(F.expr(_prints("a"))).alias("seed", "print"))

    near = RADIUS // BLOCKS
    index = items.select("item_id", "n", "k", F.expr(numbered(pick("iw"))).alias("b"))
    index = index.select("*", F.posexplode(F.expr(_prints("b"))).alias("seed", "print")).withColumn("item_print", F.col("print"))
    index = index.select("item_id", "n", "k", "b", "seed", "item_print", F.explode(F.expr(_block_values(near))).alias("v")).select("item_id", "n", "k", "b", "seed", "item_print", "v.*")
    keyed = whole.select("*", F.explode(F.expr(_block_values(0))).alias("v")).select("doc_id", "k", "n", "start", "n_words", "a", "seed", "print", "v.*")
    close = keyed.join(index, ["n", "k", "seed", "block", "value"]).withColumn("distance", F.expr("bit_count(print ^ item_print)")).where(F.col("distance") <= RADIUS)
    close = close.groupBy("doc_id", "item_id", "k", "start").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("n_words").alias("n_words"), F.min("distance").alias("distance"))
    close = close.withColumn("shared", F.size(F.array_intersect("a", "b"))).withColumn("either", F.expr("size(a) + size(b) - shared"))
    good = close.where(f"100 * shared >= {percent} * either").withColumn("similarity", F.col("shared") / F.col("either"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start"), "n_words", "distance")).alias("best")
    good = good.groupBy("doc_id", "item_id").agg(best)
    return good.select("doc_id", "item_id", (-F.col("best.s")).alias("similarity"), F.col("best.start").alias("start_word"), F.col("best.n_words").alias("n_words"), F.col("best.distance").cast("int").alias("distance"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no window like a benchmark item; rows without id stay."""
    return docs.join(contaminated(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
