import numpy as np
import pytest

from riskweave.llm import mixing as M


def brute(cells, source, lang, topic, rounds=500):
    w = {k: t / sum(cells.values()) for k, t in cells.items()}
    for _ in range(rounds):
        for axis, goal in enumerate((source, lang, topic)):
            sums = {}
            for k, v in w.items():
                sums[k[axis]] = sums.get(k[axis], 0) + v
            w = {k: v * goal[k[axis]] / sums[k[axis]] for k, v in w.items()}
    return w


def test_rake_against_brute_force(spark):
    rng = np.random.default_rng(0)
    cells = {(s, g, t): int(rng.integers(1, 500)) for s in ("a", "b", None, "c") for g in ("en", None) for t in (0, 1, 2)}
    source, lang, topic = {"a": 0.1, "b": 0.2, None: 0.3, "c": 0.4}, {"en": 0.7, None: 0.3}, {0: 0.2, 1: 0.3, 2: 0.5}
    table = spark.createDataFrame([(*k, v, 1) for k, v in cells.items()], "source string, lang string, topic int, tokens long, n long")
    goal = spark.createDataFrame(list(source.items()), "source string, share double")
    raked, rounds, off = M.rake(table, goal, lang, topic)
    assert off <= M.TOLERANCE and rounds < M.ROUNDS
    expected = brute(cells, source, lang, topic)
    for r in raked.collect():
        assert r.weight == pytest.approx(expected[r.source, r.lang, r.topic], rel=1e-2)


def test_probabilities_meet_the_budget(spark):
    cells = spark.createDataFrame([("a", 1000, 0.5), ("b", 50, 0.4), ("c", 4000, 0.1)], "source string, tokens long, weight double")
    rows = M.probabilities(cells, 0.2).collect()
    assert sum(r.p * r.tokens for r in rows) == pytest.approx(0.2 * 5050, rel=0.02) and all(0 <= r.p <= 1 for r in rows)


def test_odd_rows(odd, none):
    rows = M.calibrate(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.p == 0 and not r.kept for r in rows if r.tokens == 0)
    assert all(0 <= r.p <= 1 for r in rows)
    kept = M.mix(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert M.calibrate(none).count() == 0 and M.mix(none).count() == 0
