import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskweave.llm import mixing as M


def plain_topics(texts, start):
    row, column, value, _ = M.word_vectors(pa.array(texts))
    rarity = np.log1p(len(texts) / np.maximum(1, np.bincount(column, minlength=M.WIDTH)))
    value, label = value * rarity[column], np.array(start)
    for _ in range(M.STEPS):
        centres = np.bincount(label[row] * M.WIDTH + column, np.rint(value * M.UNIT), minlength=M.TOPICS * M.WIDTH).reshape(M.TOPICS, -1)
        centres /= np.maximum(np.sqrt((centres**2).sum(axis=1, keepdims=True)), 1e-12)
        new = M._nearest(row, column, value, centres, len(texts))
        if (new == label).all():
            break
        label = new
    return centres * rarity[None, :]


def test_topics_are_fitted_on_all_texts(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(40 * (i % 9), 40 * (i % 9) + 60, 30)) for i in range(4_500)]  # more than the sample had
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "doc_id long, text string")
    counted = M.counted_words(docs)
    start = counted.filter("doc_id < 4500").orderBy("doc_id").select(F.pmod(F.xxhash64(F.lit(M.SEED), "_columns", "_counts"), F.lit(M.TOPICS)).alias("s"))
    centres = M.fit_topics(counted)
    assert np.allclose(centres, plain_topics(texts, [r.s for r in start.collect()]))
    assert (centres == M.fit_topics(M.counted_words(docs.repartition(5)))).all()
