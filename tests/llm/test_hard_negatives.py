import math

import numpy as np
import pytest

from riskweave.llm import hard_negatives as H


def brute(rows, every=10, positives=5, negatives=10, window=(30, 90)):
    m = {i: [math.floor(256 * float(np.float64(x))) for x in v] for i, v, _ in rows}
    label = {i: x for i, _, x in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(m[a], m[b], strict=True))
    out = []
    for a in m:
        if a % every:
            continue
        scores = sorted((-dot(a, b), b) for b in m if b != a)
        for s, p in [x for x in scores if label[x[1]] == label[a]][:positives]:
            inside = [(t, b) for t, b in scores if label[b] != label[a] and window[0] * -s <= 100 * -t <= window[1] * -s]
            out += [(a, p, r + 1, b, -s, -t) for r, (t, b) in enumerate(inside[:negatives])]
    return sorted(out)


def clouds(n, dim, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    v = centres[rng.integers(0, 7, n)] + rng.normal(size=(n, dim)) * spread
    v[20:60] = v[20]  # ties
    v *= rng.choice([0.2, 1, 3], size=(n, 1))
    return [(i, v[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_eliminated_leaves_hold_nothing(seed):
    rng = np.random.default_rng(seed)
    v = np.array([v for _, v, _ in clouds(1500, 4, seed)])
    if seed < 2:  # vectors of one length, as embeddings mostly are
        v /= np.sqrt((v**2).sum(axis=1))[:, None]
    q = np.floor(v * 256).astype(np.int64)
    most = float((q.astype(float) ** 2).sum(axis=1).max())
    tree = H.fit_tree(q[:600], len(q), most, fanout=5, leaf=40)
    ranges = {}
    leaf = H.place_rows(tree, q, ranges)
    for node in tree.nodes:
        node.low, node.high = ranges[node.number]
    score = H.products(q[:200], q)
    ranked = np.sort(score, axis=1)
    at = np.where(rng.random(200) < 0.5, rng.integers(1450, 1490, 200), rng.integers(0, 1490, 200))
    low, high = ranked[np.arange(200), at], ranked[np.arange(200), at + 8]
    search, reached = H.reached_leaves(tree, q[:200], low, high)
    pairs = set(zip(search.tolist(), reached.tolist(), strict=True))
    inside = (score >= low[:, None]) & (score <= high[:, None])
    assert {(int(s), int(leaf[r])) for s, r in zip(*np.nonzero(inside), strict=True)} <= pairs
    assert len(pairs) < (0.5 if seed < 2 else 1) * 200 * tree.leaves  # and many are eliminated


def test_products_beyond_doubles():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 27), 1 << 27, (5, 3)), rng.integers(-(1 << 27), 1 << 27, (4, 3))
    assert H.products(a, b).tolist() == [[int(sum(int(x) * int(y) for x, y in zip(r, s))) for s in b] for r in a]


@pytest.mark.parametrize("sizes", [{}, {"fanout": 4, "leaf": 30, "block": 25, "sample": 100}])
def test_against_brute_force(spark, sizes):
    rows = clouds(500, 8, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    index = H.build_index(H.quantized(df, "vec_id", "embedding", "label"), **sizes)
    got = H.mine(df, "id % 10 = 0", index=index, chunk=20 if sizes else H.CHUNK)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute(rows)
    assert index.tree.leaves > 10 if sizes else index.tree.leaves == 1


def test_one_common_vector(spark):
    rows = [(i, [1.0, 0.5, 0.25], i % 2) for i in range(300)] + [(i, [0.5, 0.25, i / 1000], i % 3) for i in range(300, 360)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    index = H.build_index(H.quantized(df, "vec_id", "embedding", "label"), fanout=4, leaf=20, block=30, sample=90)
    assert sorted(map(tuple, H.mine(df, "id % 10 = 0", index=index).collect()))[:1]
    cols = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    assert sorted(map(tuple, H.mine(df, "id % 10 = 0", index=index).select(*cols).collect())) == brute(rows)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 1.0], 1, "a"), (0, [1.0, 1.0], 1, "a"), (1, [0.5, 1.0], 1, "b"), (2, [0.25, 0.5], 2, "c"), (3, [0.5, 0.25], 3, "c"),
        (4, None, 2, "d"), (5, [0.5, 0.5], None, "e"), (6, [math.nan, 1.0], 2, "f"), (7, [None, 0.5], 2, "g"), (8, [0.5], 2, "h"),
        (9, [math.inf, 0.1], 2, "i"), (None, [0.5, 0.5], 2, "j"), (11, [], 2, "k"), (20, [-1.0, -1.0], 4, "l"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank string").withColumn("id", df_clash())
    cols = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    got = sorted(map(tuple, H.mine(df, "id % 10 = 0").select(*cols).collect()))
    good = [r[:3] for r in rows if r[0] in (0, 1, 2, 3, 20)][1:]
    assert got == brute(good) and {r[0] for r in got} == {0}
    assert H.mine(df.limit(0), "id % 10 = 0").count() == 0


def df_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")
