import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import periodic_runs as R
from riskweave.llm.queries import digested_runs, planted_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, min_words=24, min_periods=3):
    """All maximal stretches of every period; one whose smallest period is smaller is left out."""
    n, out = len(words), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_words, min_periods * q):
                stretch = words[i : i + length]
                if not any(all(stretch[t] == stretch[t + d] for t in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words, *limits):
    names = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if len(words) else np.zeros(0, np.int64)
    return list(zip(*(x.tolist() for x in R.find_runs(names, np.array([0, len(words)]), *limits)), strict=True))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=70))
def test_two_words(words):
    assert found(words, 3, 3) == brute_runs(words, 3, 3)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=14), st.integers(1, 9), st.integers(0, 5)), max_size=6),
    st.sampled_from([(24, 3), (5, 3), (10, 4)]),
)
def test_repeated_stretches(parts, limits):
    words = [w for part, times, more in parts for w in part * times + part[:more]]
    assert found(words, *limits) == brute_runs(words, *limits)


def test_rows_do_not_touch():
    names = np.zeros(60, np.int64)
    start, length, period = R.find_runs(names, np.array([0, 30, 30, 53, 60]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [30], [1])  # 23 words are too few
    with pytest.raises(ValueError):
        R.find_runs(names, np.array([0, 60]), 24, 2)


def test_names_tell_met_hashes_apart():
    import pyarrow as pa

    words = R.split_words(pa.array(["one two one six"]))
    words.hash[:] = 7
    assert R.word_names(words).tolist() == [0, 1, 0, 2]


def brute_digest(doc, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc, len(runs), *top, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows_of(df):
    c = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    return sorted((tuple(r) for r in digested_runs(df).select(*c).collect()), key=str)


def test_odd_rows(odd, none):
    short = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 7]
    assert rows_of(odd.filter("doc_id is null or doc_id != 7")) == sorted((brute_digest(*r) for r in short), key=str)
    assert digested_runs(none).count() == 0
    assert odd.filter("doc_id = 7").transform(R.periodic_runs).first().n_words == 40_000


def test_planted_and_hot(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 150))]
        if i % 3 == 0:
            part = [f"r{x}" for x in rng.integers(0, 3, rng.integers(1, 12))]
            words[len(words) // 2 : len(words) // 2] = part * int(rng.integers(2, 20))
        if i % 10 == 1:  # equal exponents: ties
            words = ["a", "b"] * 12 + ["x"] + ["c", "d"] * 12 + ["e"] * 24
        rows.append((i, "\n".join(words)))
    assert sum(planted_order(i, 100) is not None for i in range(300)) > 10
    assert rows_of(spark.createDataFrame(rows, "doc_id long, text string")) == sorted((brute_digest(*r) for r in rows), key=str)


def test_very_long_run(spark):
    text = "la di da " * 200_000 + "end"
    row = digested_runs(spark.createDataFrame([(3, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 600_000, 3, 200_000_000)
    assert row.collapsed_sha256 == hashlib.sha256(b"la di da end").hexdigest()
