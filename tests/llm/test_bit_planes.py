import random

import numpy as np
from pyspark.sql import functions as F

from quantspan.llm import bit_planes

SCHEMA = "vec_id bigint, embedding array<float>, label int, block string, score double, `odd.name` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "clash", 1.0, "x") for i, v, k in rows], SCHEMA)


def brute(rows, every, positives=5, negatives=5):
    """Anchor by anchor over plain Python integers."""
    known = []
    for i, v, k in rows:
        if i is None or v is None or k is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        known.append((i, k, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = set()
    anchors = {}
    for i, k, v in known:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (k, v)), (k, v))
    for i, (k, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in known if j != i)
        for minus, p, _ in [x for x in scored if x[2] == k][:positives]:
            ps = -minus
            fits = [x for x in scored if x[2] != k and 80 * ps <= -100 * x[0] <= 100 * ps]
            out |= {(i, p, r, n, ps, -m) for r, (m, n, _) in enumerate(fits[:negatives], 1)}
    return out


def got(spark, rows, every, s=bit_planes.Settings()):
    return bit_planes.mine(frame(spark, rows), F.col("id") % every == 0, s=s)


def random_rows(n, dims, seed, spread=0.3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dims)], rng.randrange(3)) for i in range(n)]


def test_lookups_equal_inner_products():
    rng = np.random.default_rng(1)
    for dims, low, high in ((1, 0, 1), (7, -1, 0), (64, -512, 511), (20, -(2**28), 2**28), (9, 0, 1)):
        a = bit_planes.integers(list(rng.integers(low, high, (11, dims), endpoint=True)), 1.0)
        c = bit_planes.integers(list(rng.integers(low, high, (23, dims), endpoint=True)), 1.0)
        packed = bit_planes.planes(c)
        assert (bit_planes.scores(bit_planes.subset_sums(a, len(packed)), packed) == c @ a.T).all()


def test_equal_to_plain_integers(spark):
    rows = random_rows(150, 10, 2)
    small = bit_planes.Settings(rows=16, anchors=3, blocks=2)
    want = brute(rows, 10)
    assert len(want) > 50
    for s in (bit_planes.Settings(), small):
        assert {tuple(r) for r in got(spark, rows, 10, s).collect()} == want


def test_ties_copies_and_odd_rows(spark):
    rng = random.Random(3)
    base = [(i, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)], rng.randrange(2)) for i in range(60)]
    hot = [(i, [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(100, 160)]
    odd = [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 0), (203, [float("inf"), 0.0, 0.0, 0.0], 0)]
    odd += [(204, [1.0] * 4, None), (None, [1.0] * 4, 1), (205, [], 1), (206, [2.0], 0), (207, [0.25] * 9, 1)]
    rows = base + hot + odd
    result = got(spark, rows, 20, bit_planes.Settings(rows=16, anchors=2, blocks=1))
    assert {tuple(r) for r in result.collect()} == brute(rows, 20)
    repeated = rows + rows[:40]  # whole rows again: each a row of its own, no anchor twice
    again = got(spark, repeated, 20)
    assert {r["anchor_id"] for r in again.collect()} <= {r["anchor_id"] for r in result.collect()}
    assert all(r["negative_id"] != r["anchor_id"] != r["positive_id"] for r in again.collect())


def test_nothing_to_find(spark):
    assert got(spark, [], 10).count() == 0
    assert got(spark, [(1, [1.0], 1)], 10).count() == 0
    assert got(spark, [(0, [1.0], 1), (1, [1.0], 2)], 10).count() == 0
    assert got(spark, [(0, [], 1), (1, [], 1), (2, [], 2)], 10).columns[0] == "anchor_id"
