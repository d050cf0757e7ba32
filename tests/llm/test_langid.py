import itertools
import math

import numpy as np
import pytest

from riskweave.llm import langid as L

VOCABULARY = ["▁a", "▁b", "a", "b", "ab", "ba", "▁ab", "aba"]


def brute(word, p):
    """Sum over all segmentations."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, part = [], word[0]
        for c, ch in zip(cuts, word[1:], strict=True):
            if c:
                parts.append(part)
                part = ch
            else:
                part += ch
        parts.append(part)
        value = 1.0
        for x in parts:
            value *= p[x] if x in p else (L.UNKNOWN if len(x) == 1 else 0.0)
        total += value
    return total


def test_forward_sums_all_segmentations():
    words = ["▁abab", "▁a", "▁baab", "▁aba", "▁axb", "ab"]
    model = L.fit({"one": {"▁abab": 5, "▁aba": 2}, "two": {"▁baab": 3}}, VOCABULARY)
    lattice, order = L.Lattice.of(VOCABULARY)
    got = L.forward(lattice, words, model.p)
    for k in range(2):
        p = {VOCABULARY[order[i]]: model.p[k, i] for i in range(len(VOCABULARY))}
        assert np.allclose(got[:, k], [math.log(brute(w, p)) for w in words])
    assert np.allclose(model.p.sum(axis=1), 1)


def test_odd_rows(odd, none):
    vocabulary = L.load_vocabulary(_vocabulary())
    model = L.train(odd, vocabulary)
    rows = L.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5, 10))
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2)} == {"en"}
    assert L.predict(none, model).count() == 0
    nothing = L.train(none, vocabulary)
    assert {r.lang_pred for r in L.predict(odd, nothing).collect()} == {"und"}


def _vocabulary():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_held_out_accuracy(spark):
    from riskweave.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_language_id"](spark, sf_dir).join(truth, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
