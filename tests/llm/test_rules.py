"""The placing rule of packing and the draws of the hash tree against plain versions."""

import hashlib
import math
import random

import pytest

from relatrix.llm import packing, sharding


@pytest.mark.parametrize("seed", range(5))
def test_sum_of_squares(seed):
    """Each piece goes where the sum of squared counts of the fill levels is least afterwards, the fullest of equal ones."""
    rng, size = random.Random(seed), 24
    packer, counts = packing.Packer(size), {}
    for key in range(400):
        length = rng.randrange(1, 2 * size)
        packer.place(key, 0, length)
        length %= size
        if not length:
            continue
        best = None
        for level in [0, *sorted(h for h, n in counts.items() if n and h + length <= size)]:
            after = dict(counts)
            if level:
                after[level] -= 1
            if level + length < size:
                after[level + length] = after.get(level + length, 0) + 1
            total = sum(n * n for n in after.values())
            if best is None or total <= best[0]:
                best = (total, after)
        counts = {h: n for h, n in best[1].items() if n}
        assert {h: int(n) for h, n in enumerate(packer.count) if n} == counts
    assert sum(p[2] for w in packer.close() for p in w) > 0


TREE = [[{0: 1.0, 1: 3.0}, {2: 0.5}], [{3: 2.0, 4: 1.0, 5: 1.0}], [{6: 4.0}, {7: 1.0, 8: 1.0}]]


def drawn(key, tree):
    def least(options):
        return min((-math.log((int(hashlib.md5(f"{key}/{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w, i) for i, path, w in options)[1]

    i = least([(i, str(i), sum(w for rack in r for w in rack.values())) for i, r in enumerate(tree)])
    j = least([(j, f"{i}.{j}", sum(rack.values())) for j, rack in enumerate(tree[i])])
    return i, j, least([(s, f"{i}.{j}.{s}", w) for s, w in tree[i][j].items()])


def test_draws(spark):
    ids = [None, *range(3000), 5, 5]
    df = spark.createDataFrame([(i, "x", 7) for i in ids], "doc_id long, shard_note string, key int")
    got = sharding.assign(df, TREE).collect()
    want = {i: drawn("null" if i is None else i, TREE) for i in ids}
    assert len(got) == len(ids) and all(r.shard == want[r.doc_id][2] for r in got)
    total = sum(w for region in TREE for rack in region for w in rack.values())
    for shard, weight in ((w for region in TREE for rack in region for w in rack.items())):
        share = sum(r.shard == shard for r in got) / len(got)
        assert abs(share - weight / total) < 0.03
    # one weight changes: rows move into the subtrees that hold it only
    more = [[dict(rack) for rack in region] for region in TREE]
    more[1][0][4] = 3.0
    moved = {i: (want[i], drawn(i, more)) for i in range(3000) if want[i] != drawn(i, more)}
    assert moved and all(new[0] == 1 for _, new in moved.values()) and all(new[2] == 4 for old, new in moved.values() if old[0] == 1)
    changed = {r.doc_id: r.shard for r in sharding.assign(df, more).collect()}
    assert all(changed[i] == drawn(i, more)[2] for i in range(3000))


def test_odd_shard_rows(spark):
    rows = [(None, None), (None, "é" * 3), (4, ""), (4, ""), (4, "x" * 2_000_000)]
    got = sharding.shard_documents(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, slot int")).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == [(-1, 1), (-1, 7), (4, 1), (4, 1), (4, 2_000_001)]
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(16))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
