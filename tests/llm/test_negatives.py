"""Hard negatives against brute force, the curve, and what the zone maps spare."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from kmerloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row int, score string, `a.b` int"
SMALL = {"block_rows": 8, "unit_rows": 64, "units": 3, "slice_rows": 3, "tile_blocks": 5}


def plain(rows, anchors=100, positives=5, negatives=5):
    def fine(r):
        return r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    own = []
    for r in rows:
        if fine(r):
            label = math.fmod(r[2] + 1, 10) if r[0] is not None and r[0] % 7 == 0 else r[2]
            own.append((r[0], label, [math.floor(256 * float(np.float32(x))) for x in r[1]]))
    sizes = Counter(len(v) for _, _, v in own)
    dims = max(sizes, key=lambda s: (sizes[s], s)) if sizes else 0
    own = [x for x in own if len(x[2]) == dims]
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = Counter()
    for i, (name, label, v) in enumerate(own):
        if name is None or name % anchors:
            continue
        scores = [(j, other, lab == label, sum(a * b for a, b in zip(v, w))) for j, (other, lab, w) in enumerate(own)]
        for p, ps in sorted([(o, s) for j, o, same, s in scores if same and j != i], key=order)[:positives]:
            hard = sorted([(o, s) for _, o, same, s in scores if not same and 80 * ps <= 100 * s <= 100 * ps], key=order)[:negatives]
            out.update((name, p, rank + 1, n, ps, s) for rank, (n, s) in enumerate(hard))
    return out


def vectors(seed, n, dims, spread=0.4):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, spread) for _ in range(dims)], r.choice([0, 1, 1, 1, 9, None]), 1, "x", 2) for i in range(n)]
    same = [0.5] * dims
    rows += [(n + i, same, i % 2, 1, "x", 2) for i in range(40)] + [rows[0], rows[100], (100, same, 1, 1, "x", 2)]
    return rows + [(200, None, 1, 1, "x", 2), (300, [None] * dims, 1, 1, "x", 2), (400, [float("nan")] * dims, 1, 1, "x", 2), (None, same, 0, 1, "x", 2), (None, same, 1, 1, "x", 2), (500, [1.0], 1, 1, "x", 2), (-700, same, 3, 1, "x", 2)]


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_curve(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = negatives.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_bounds():
    r = np.random.default_rng(1)
    x, v = r.integers(-99, 99, (40, 7)).astype(float), r.integers(-99, 99, (20, 7)).astype(float)
    least, most = negatives._bounds(v, x.min(0)[None, :], x.max(0)[None, :])
    score = v @ x.T
    assert (least <= score.min(1)[:, None]).all() and (score.max(1)[:, None] <= most).all()


@pytest.mark.parametrize("dims, layout", [(4, SMALL), (20, SMALL), (4, {})])
def test_mine(spark, dims, layout):
    rows = vectors(dims, 330, dims)
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), **layout)
    assert Counter(tuple(x) for x in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain(rows)


def test_large_components(spark):
    """Scores beyond what floats hold exactly."""
    r = random.Random(2)
    rows = [(i, [float(r.randrange(200000, 260000)) for _ in range(4)], i % 3, 1, "x", 2) for i in range(130)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), **SMALL)
    assert Counter(tuple(x) for x in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain(rows)


def test_blocks_are_spared(spark):
    """Clustered vectors: an anchor reads the blocks near it."""
    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(24)]
    rows = [(i, [c + r.gauss(0, 0.02) for c in centres[i % 24]], i // 24 % 2, 1, "x", 2) for i in range(2400)]
    held = []
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), found=held, block_rows=16, unit_rows=256, units=4)
    assert Counter(tuple(x) for x in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain(rows)
    # two searches, each of which may read at most its half of the blocks by label
    assert held[0].visited < 0.35 * 24 * held[0].blocks


def test_odd(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(100, None, 1, 1, "x", 2)], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(100, [1.0], 1, 1, "x", 2)], SCHEMA)).count() == 0
    # a pair without negatives, and a negative positive, whose window is empty
    few = [(100, [1.0, 0.0], 1), (101, [-0.5, 0.0], 1), (103, [-0.45, 0.0], 2)]
    assert negatives.mine(spark.createDataFrame(few, "vec_id long, embedding array<double>, label int")).count() == 0
