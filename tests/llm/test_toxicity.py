import numpy as np
import pyarrow as pa

from riskweave.llm import toxicity as T

CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 1), (None, 0, 1), (7, None, 1), (8, 0, None), (9, 0, 0), (999, 0, 1)], "doc_id long, quality int, toxic int"
    )
    for docs, truth in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        chain = T.train(docs, truth, CATEGORIES)
        rows = T.score(docs, chain).collect()
        assert len(rows) == docs.count() and all(0 <= r.p_toxic <= 1 for r in rows)
        assert T.drop_category(docs, chain, "toxic").columns == docs.columns


def test_chain_learns_and_feeds_forward():
    rng = np.random.default_rng(1)
    texts, y = [], []
    for i in range(600):
        bad, junk = i % 5 == 0, i % 3 == 0
        words = [f"w{rng.integers(300)}" for _ in range(40)] + ["awful"] * bad + ["zzz", "qqq"] * junk
        texts.append(" ".join(words))
        y.append([junk, bad])
    row, hashes = T.distinct_words(pa.array(texts))
    chain = T.fit_chain(np.split(hashes, np.searchsorted(row, np.arange(1, 600))), np.array(y, int), list(CATEGORIES))
    p = chain.probabilities(*T.known_words(chain.words, pa.array(texts)), 600)
    decided = p >= np.array(chain.cuts)
    assert (decided == np.array(y, bool)).mean() > 0.99
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1  # the second model sees the first probability
    # a very long text isn't thinned out
    long = pa.array([" ".join([*["w1 w2 w3"] * 30_000, "awful"])])
    assert chain.probabilities(*T.known_words(chain.words, long), 1)[0, 1] >= chain.cuts[1]


def test_cut():
    assert T.best_cut(np.array([0.9, 0.8, 0.3, 0.3]), np.array([True, True, False, False])) == 0.55
    assert T.best_cut(np.array([0.1]), np.array([False])) > 1


def test_held_out(spark):
    from riskweave.llm.tables import read_table

    docs, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    chain = T.train(docs, labels.filter("doc_id % 3 <> 0"), CATEGORIES)
    held = T.score(docs.filter("doc_id % 3 = 0"), chain).join(labels.select("doc_id", "toxic").withColumnRenamed("toxic", "y"), "doc_id")
    n = {(r.toxic, r.y): r["count"] for r in held.groupBy("toxic", "y").count().collect()}
    assert n.get((True, 1), 0) / (n.get((True, 1), 0) + n.get((False, 1), 0)) > 0.75  # some labels are wrong on purpose
    assert n.get((True, 0), 0) / (n.get((True, 0), 0) + n[False, 0]) < 0.02


def test_training_reads_whole_texts(spark):
    """An abusive word of a text with thousands of distinct words, most with smaller hashes, is a feature, as it is of the whole texts at once."""
    from riskweave.llm.tables import share_package

    share_package(spark)
    rng = np.random.default_rng(2)
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 9_000, 6_000)), *["bad18"] * (i % 3 == 0)]) for i in range(90)]
    docs = spark.createDataFrame([*enumerate(texts), (200, texts[0])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in [*range(90), 200]], "doc_id long, quality int, toxic int")
    chain = T.train(docs, labels, CATEGORIES)
    row, hashes = T.distinct_words(pa.array(texts))
    y = np.array([[0, i % 3 == 0] for i in range(90)], int)
    whole = T.fit_chain(np.split(hashes, np.searchsorted(row, np.arange(1, 90))), y, list(CATEGORIES))
    assert T.distinct_words(pa.array(["bad18"]))[1][0] in chain.words and chain.words.tolist() == whole.words.tolist()
    assert all(np.allclose(a, b) for a, b in zip(chain.weights, whole.weights))
    assert [r.doc_id % 3 == 0 for r in T.score(docs.limit(90), chain).orderBy("doc_id").collect()] == [r.toxic for r in T.score(docs.limit(90), chain).orderBy("doc_id").collect()]


def test_cut_is_the_best_of_all():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(2, 30))
        p, y = rng.integers(0, 6, n) / 7, rng.random(n) < rng.random()

        def value(cut, p=p, y=y):
            taken = p >= cut
            right = (taken & y).sum()
            return 2 * right / (taken.sum() + y.sum()) if taken.any() and right >= T.LEAST_PRECISION * taken.sum() else 0

        best = max([value(c) for c in p]) if p.min() < p.max() else 0
        cut = T.best_cut(p, y)
        assert (value(cut) == best) if best else cut > 1


def test_least_g_follows_the_number_of_words():
    import math

    for words in (10, 1000, 30_000):
        g = T.least_g(words)
        assert 0.6 < math.erfc(math.sqrt(g / 2)) * words / T.BY_CHANCE < 1.7 or g == T.MOST_G


def test_few_labels_reject_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i} plain text of a clean kind {i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i == 7)) for i in range(40)], "doc_id long, quality int, toxic int")
    chain = T.train(docs, labels, {"low_quality": "quality = 0", "toxic": "toxic = 1"})
    assert T.drop_category(docs, chain, "toxic").count() == 60
