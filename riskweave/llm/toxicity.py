"""Toxicity by a classifier chain (operator 3).

Categories are predicted one after another, each by a linear model (logistic regression) on words; the model of a
category also sees the probabilities of the categories before it. While training, those probabilities are out of
fold: every labelled document gets them from models that haven't seen it, so later models learn how far earlier ones
can be trusted. When scoring, they come from the models fitted on all folds.

* Words are lower-cased runs of letters, digits and non-ASCII characters; a feature is a word's presence, so a long
  text isn't thinned out and repeats don't count.
* Feature choice: of the words in ``MIN_DOCS`` or more training documents, the ``FEATURES`` words that tell most about
  any category by the G statistic, if it is ``least_g`` or more: with as many words as were counted, chance alone passes
  one in twenty times, and never more than one word in two million. Words beyond that would only add noise to long texts.
* The cut of each category is the one with the best F1 of the out-of-fold probabilities among those where at least
  ``LEAST_PRECISION`` of the rejected documents are right. If there is none, the category rejects nothing.
* Training takes a bounded sample of the labelled rows: the ``SAMPLE`` with the smallest hash of (seed, doc_id); ties
  and repeats don't matter. Spark counts the words of these whole texts by category and chooses the features; the
  driver gets only the chosen features of each text. Training and scoring read whole texts.

Scoring is one scan without a shuffle. Defined results: a null or empty text gets the probabilities of a text without
known words; without labels of both values, or without telling words, a category has its base rate as probability (0
without any label) and rejects nothing; repeated rows are scored one by one; labels with a null id or value aren't used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.tables import pieces
from riskweave.llm.words import MARKS, split_words
from riskweave.session import reliable_checkpoint

SAMPLE = 8_000
MIN_DOCS = 5
FEATURES = 1_000
MOST_G = 25.0
BY_CHANCE = 0.05
LEAST_PRECISION = 0.5
FOLDS = 4
L2 = 3.0
STEPS = 30
SEED = 11


@dataclass
class Chain:
    """Known words (sorted hashes) and, per category, weights (words, earlier categories, constant) and cut."""

    words: np.ndarray
    categories: list[str]
    weights: list[np.ndarray]
    cuts: list[float]

    def probabilities(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """n x categories from the (row, feature) pairs of known words."""
        out = np.zeros((n, len(self.categories)))
        for c, w in enumerate(self.weights):
            k = len(self.words)
            score = np.bincount(rows, w[features], minlength=n) + out[:, :c] @ w[k : k + c] + w[-1]
            out[:, c] = 1 / (1 + np.exp(-score))
        return out


def distinct_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash) of every distinct word of every text."""
    words = split_words(pc.utf8_lower(text), MARKS)
    row = words.row_of_word()
    order = np.lexsort((words.hash, row))
    row, hashes = row[order], words.hash[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def known_words(known: np.ndarray, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every distinct known word of every text."""
    words = split_words(pc.utf8_lower(text), MARKS)
    if not len(known) or not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    found = np.flatnonzero(known[at] == words.hash)
    pairs = np.unique(words.row_of_word()[found] * len(known) + at[found])
    return pairs // len(known), pairs % len(known)


def _fit(rows: np.ndarray, features: np.ndarray, extra: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """L2-regularised logistic regression by Newton steps with conjugate gradients; the constant isn't penalised."""
    n, e = len(y), extra.shape[1]
    rate = y.mean()
    w = np.zeros(k + e + 1)
    if rate in (0.0, 1.0):
        w[-1] = np.log(np.clip(rate, 1e-6, 1 - 1e-6) / np.clip(1 - rate, 1e-6, 1))
        return w
    penalty = np.full(k + e + 1, L2)
    penalty[k:] = 1e-3

    def times(v):
        return np.bincount(rows, v[features], minlength=n) + extra @ v[k : k + e] + v[-1]

    def back(u):
        return np.concatenate([np.bincount(features, u[rows], minlength=k), extra.T @ u, [u.sum()]])

    w[-1] = np.log(rate / (1 - rate))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-times(w)))
        gradient = back(p - y) + penalty * w
        if np.abs(gradient).max() < 1e-4 * n:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -gradient
        d, rr = r.copy(), r @ r
        for _ in range(40):
            hd = back(curve * times(d)) + penalty * d
            a = rr / (d @ hd)
            step += a * d
            r = r - a * hd
            new = r @ r
            if new < 1e-8 * (gradient @ gradient):
                break
            d, rr = r + new / rr * d, new
        w = w + step
    return w


def _tell(present: np.ndarray, positive: np.ndarray, n: int, n_positive: int) -> np.ndarray:
    """G statistic of word presence against a category."""

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9)), 0)

    rate = n_positive / n
    rest, rest_positive = n - present, n_positive - positive
    return 2 * (
        part(positive, present * rate) + part(present - positive, present * (1 - rate))
        + part(rest_positive, rest * rate) + part(rest - rest_positive, rest * (1 - rate))
    )


def least_g(words: int) -> float:
    """The G statistic that one of so many words reaches by chance with probability ``BY_CHANCE``, ``MOST_G`` at most
    (tail of the chi-squared distribution with one degree of freedom)."""
    log = np.log(max(1, words) / BY_CHANCE)
    return float(min(MOST_G, 2 * log - np.log(np.pi * log)))


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 (the highest of equals) that rejects rightly often enough; above 1 if there is none."""
    if not y.any() or p.min() == p.max():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = np.where(hits >= LEAST_PRECISION * taken, 2 * hits / (taken + y.sum()), 0)
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal probabilities are cut together
    best = np.flatnonzero(last)[np.argmax(f1[last])]
    if f1[best] == 0:
        return 2.0
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def fit_chain(hashes: list[np.ndarray], labels: np.ndarray, categories: Sequence[str]) -> Chain:
    """Chain from the distinct word hashes and the 0/1 labels (rows x categories) of the training documents."""
    n = len(hashes)
    if not n:
        return fit_known(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), labels, categories)
    rows = np.repeat(np.arange(n), [len(h) for h in hashes])
    vocabulary, column = np.unique(np.concatenate(hashes), return_inverse=True)
    present = np.bincount(column, minlength=len(vocabulary))
    score = np.zeros(len(vocabulary))
    for c in range(len(categories)):
        positive = np.bincount(column, labels[rows, c], minlength=len(vocabulary))
        score = np.maximum(score, _tell(present, positive, n, int(labels[:, c].sum())))
    score[present < MIN_DOCS] = 0
    chosen = np.sort(np.argsort(-score, kind="stable")[:FEATURES])
    chosen = chosen[score[chosen] >= least_g(int((present >= MIN_DOCS).sum()))]
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[column] >= 0
    return fit_known(vocabulary[chosen], rows[keep], place[column[keep]], labels, categories)


def fit_known(
    words: np.ndarray, rows: np.ndarray, features: np.ndarray, labels: np.ndarray, categories: Sequence[str]
) -> Chain:
    """Chain from the chosen words (sorted hashes) and the (row, feature) pairs of the training documents."""
    n, k = len(labels), len(words)
    if not n:
        never = [np.array([0.0] * c + [-14.0]) for c in range(len(categories))]
        return Chain(words, list(categories), never, [2.0] * len(categories))
    fold = np.random.default_rng(SEED).permutation(n) % FOLDS
    outside = np.zeros((n, len(categories)))  # out-of-fold probabilities
    weights, cuts = [], []
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        for f in range(FOLDS):
            train, test = fold != f, fold == f
            if not train.any() or not test.any():
                continue
            at = np.cumsum(train) - 1
            mine = train[rows]
            w = _fit(at[rows[mine]], features[mine], outside[train, :c], y[train], k)
            other = test[rows]
            s = np.bincount(rows[other], w[features[other]], minlength=n) + outside[:, :c] @ w[k : k + c] + w[-1]
            outside[test, c] = 1 / (1 + np.exp(-s[test]))
        weights.append(_fit(rows, features, outside[:, :c], y, k))
        cuts.append(best_cut(outside[:, c], y > 0) if k else 2.0)
    return Chain(words, list(categories), weights, cuts)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> Chain:
    """Chain for ``categories`` (name: SQL condition over ``labels``, in chain order)."""
    # Smallest hashes among the ids that docs has; the sample is the same for any partitioning.
    wanted = labels.select(
        F.col("doc_id").cast("long").alias("_id"),
        *[F.expr(c).cast("int").alias(f"_y{i}") for i, c in enumerate(categories.values())],
    ).dropna()
    wanted = wanted.groupBy("_id").agg(*[F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(categories))])
    ids = docs.select(F.col(doc_id).cast("long").alias("_id")).dropna().distinct()
    sample = wanted.join(ids, "_id", "left_semi").orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(SAMPLE).collect()
    y = {r["_id"]: [r[f"_y{i}"] for i in range(len(categories))] for r in sample}
    ids, truth = np.array(sorted(y), dtype=np.int64), np.array([y[i] for i in sorted(y)], dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((ids, truth))  # at most SAMPLE rows

    def words(batches):
        ids, truth = shared.value
        for batch in batches:
            mine = np.isin(np.asarray(pc.fill_null(batch.column(0), -1)), ids) & np.asarray(pc.is_valid(batch.column(0)))
            for piece in pieces(iter([batch.filter(pa.array(mine))])):
                row, hashes = distinct_words(piece.column("text"))
                bounds = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
                keys = [hashlib.blake2b(hashes[i:j].tobytes(), digest_size=16).digest() for i, j in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "_id": piece.column("_id"),
                        "key": pa.array(keys, pa.binary()),
                        "y": pa.array(list(truth[np.searchsorted(ids, np.asarray(piece.column("_id")))]), pa.list_(pa.int32())),
                        "words": pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64))),
                    }
                )

    source = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"))
    read = reliable_checkpoint(source.mapInArrow(words, "_id long, key binary, y array<int>, words array<long>"))
    # One row an id, and one of all texts with the same words: copies of a text would make its words look telling.
    one = read.groupBy("_id").agg(F.min("key").alias("key")).groupBy("key").agg(F.min("_id").alias("_id"))
    texts = read.join(one, ["_id", "key"], "left_semi").dropDuplicates(["_id"])
    picked = sorted(r["_id"] for r in one.select("_id").collect())  # at most SAMPLE
    labels = np.array([y[i] for i in picked], dtype=int).reshape(len(picked), len(categories))
    known = _telling(texts, labels)
    told = docs.sparkSession.sparkContext.broadcast(known)

    def chosen(batches):
        for batch in batches:
            for i, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                have = np.isin(told.value, np.asarray(found.values).view(np.uint64))
                packed = pa.array([np.flatnonzero(have).astype(np.int32).tobytes()], pa.binary())
                yield pa.RecordBatch.from_pydict({"_id": pa.array([i], pa.int64()), "features": packed})

    got = texts.select("_id", "words").mapInArrow(chosen, "_id long, features binary").toPandas().sort_values("_id")
    features = [np.frombuffer(f, np.int32) for f in got["features"]]
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    return fit_known(known, rows, np.concatenate([*features, np.zeros(0, np.int32)]), labels, list(categories))


def _telling(texts: DataFrame, labels: np.ndarray) -> np.ndarray:
    """Sorted hashes of the chosen words; ``texts``: y (0/1 per category) and the distinct words of each whole text."""
    n, categories = labels.shape
    if not n:
        return np.zeros(0, np.uint64)
    counts = texts.select("y", F.explode_outer("words").alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("present"), *[F.sum(F.col("y")[c]).alias(f"p{c}") for c in range(categories)]
    ).filter(f"w is not null and present >= {MIN_DOCS}")

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    def tell(c: int):
        rate, present, positive = float(labels[:, c].sum() / n), F.col("present"), F.col(f"p{c}")
        rest, rest_positive = n - present, int(labels[:, c].sum()) - positive
        return 2 * (
            part(positive, present * rate) + part(present - positive, present * (1 - rate))
            + part(rest_positive, rest * rate) + part(rest - rest_positive, rest * (1 - rate))
        )

    counts = reliable_checkpoint(counts)
    score = F.greatest(F.lit(0.0), *[tell(c) for c in range(categories)])
    best = counts.select("w", score.alias("g")).filter(F.col("g") >= least_g(counts.count()))
    rows = best.orderBy(F.col("g").desc(), F.col("w") < 0, "w").limit(FEATURES).collect()
    return np.sort(np.array([r["w"] for r in rows], dtype=np.int64).view(np.uint64))


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_<category> and <category> (decision) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.categories
    schema = "doc_id long, " + ", ".join([f"p_{c} double" for c in names] + [f"{c} boolean" for c in names])

    def scored(batches):
        model = shared.value
        for piece in pieces(batches):
            p = model.probabilities(*known_words(model.words, piece.column("text")), piece.num_rows)
            out = {"doc_id": piece.column("doc_id")}
            out |= {f"p_{c}": pa.array(p[:, i]) for i, c in enumerate(names)}
            out |= {c: pa.array(p[:, i] >= model.cuts[i]) for i, c in enumerate(names)}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scored, schema)


def drop_category(docs: DataFrame, chain: Chain, category: str, text: str = "text") -> DataFrame:
    """The rows, unchanged, that the chain doesn't put into ``category``; decided inside the scan."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = chain.categories.index(category)

    def kept(batches):
        model = shared.value
        for piece in pieces(batches, text):
            p = model.probabilities(*known_words(model.words, piece.column(text)), piece.num_rows)
            yield piece.filter(pa.array(p[:, at] < model.cuts[at]))

    return docs.mapInArrow(kept, docs.schema)
