import math

import numpy as np

from riskweave.llm.vector_search import top_k


def brute(vectors, k=5):
    m = {i: np.floor(np.array(v) * 256).astype(np.int64) for i, v in vectors}
    out = []
    for q in m:
        if q % 50 == 0:
            scores = sorted((-int(m[q] @ v), i) for i, v in m.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 12)) * np.linspace(2, 0.1, 12)
    base[50:80] = base[50]  # ties
    base *= rng.choice([0.1, 1, 4], size=(400, 1))
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, "id % 50 = 0").collect())) == brute(vectors)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.5], "a"), (0, [1.0, 0.5], "a"), (50, None, "b"), (1, [math.nan, 1.0], "c"), (2, [math.inf, 1.0], "d"),
        (3, [None, 1.0], "e"), (4, [0.25, 0.25], "f"), (5, [1.0], "g"), (6, [], "h"), (None, [1.0, 1.0], "i"), (100, [-0.001, 0.0], "j"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = sorted(map(tuple, top_k(df, "id % 50 = 0").collect()))
    # floor(256 x): (256, 128), (64, 64), (-1, 0)
    assert got == [(0, 1, 4, 256 * 64 + 128 * 64), (0, 2, 100, -256), (100, 1, 4, -64), (100, 2, 0, -256)]
    assert top_k(df.limit(0), "id % 50 = 0").count() == 0
