"""Mixing sources to target weights (operator 7).

1. A topic for every text: spherical k-means on hashed words over all documents, then the nearest of ``TOPICS`` centres.
   Texts are read once; their word counts are written, and each of at most ``STEPS`` steps is one partial aggregation of
   them to topics x ``WIDTH`` sums. Sums are of whole numbers, so centres are the same however rows are dealt.
2. Tokens (words) per cell of source x language x topic, by one partial aggregation.
3. Iterative proportional fitting: the cells' weights are raked to the source, then the language, then the topic
   targets, until no marginal is off by more than ``TOLERANCE`` or ``ROUNDS`` is reached (targets that contradict each
   other have no solution). Sources may be very many: their cells stay a Spark table, one row per source, and a
   source's factor follows from the factors of languages and topics inside that row. So a round is one partial
   aggregation to languages x topics sums; only that small table (at most ``MOST_PAIRS``) and its factors reach the
   driver, where languages and topics are raked in turn before the next round.
4. Every document of a cell gets the probability budget * weight / tokens, at most 1; what the limit cuts off is given
   to the other cells in proportion (``fill``, a fixed number of rounds of partial sums). A document stays if a hash of
   (seed, doc_id, text) as a number in [0, 1) is below its probability: the same draw on any cluster, after any retry.

Targets, if none are given: shares of tokens to the power ``TEMPERATURE``, made to sum to 1, for sources and
languages; for topics the same inside each language. Values without a target get weight 0 and leave.

Defined results: null sources and languages are a value of their own; a null or empty text has no tokens, no weight
and leaves; an empty table gives an empty table; repeated rows share one draw.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, ShortType, StructField, StructType

from riskweave.llm.tables import pieces
from riskweave.llm.words import split_words
from riskweave.session import reliable_checkpoint

TOPICS = 8
WIDTH = 4_096
STEPS = 12
ROWS = 1_000  # texts whose vectors are held at a time
UNIT = 2.0**20  # vectors are summed in whole numbers of 1 / UNIT
ROUNDS = 30
INNER = 50
MOST_PAIRS = 100_000
TOLERANCE = 1e-4
TEMPERATURE = 0.7
BUDGET = 0.6
FILLS = 6
SEED = 5
AXES = ("source", "lang", "topic")


def word_counts(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, column, count) of hashed words, and the words of each row."""
    words = split_words(text, lower=True)
    column = (words.hash % np.uint64(WIDTH)).astype(np.int64)
    code, count = np.unique(words.row_of_word() * WIDTH + column, return_counts=True)
    return code // WIDTH, code % WIDTH, count, np.diff(words.bounds)


def unit_vectors(row: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Values of sparse rows of unit length from log word counts."""
    value = np.log1p(count)
    length = np.sqrt(np.bincount(row, value**2, minlength=n))
    return value / length[row] if len(row) else value


def word_vectors(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, column, value) of unit length from log word counts, and the words of each row."""
    row, column, count, tokens = word_counts(text)
    return row, column, unit_vectors(row, count, len(tokens)), tokens


def counted_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``_columns`` and ``_counts`` (hashed words) and ``_tokens`` in place of the text; written once."""

    def counted(batches):
        for piece in pieces(batches, text):
            row, column, count, tokens = word_counts(piece.column(text))
            bounds = pa.array(np.searchsorted(row, np.arange(len(tokens) + 1)).astype(np.int32))
            rest = piece.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [
                    *rest.columns, pa.ListArray.from_arrays(bounds, pa.array(column.astype(np.int16))),
                    pa.ListArray.from_arrays(bounds, pa.array(count.astype(np.int32))), pa.array(tokens, pa.int64()),
                ],
                names=[*rest.schema.names, "_columns", "_counts", "_tokens"],
            )

    more = [StructField("_columns", ArrayType(ShortType())), StructField("_counts", ArrayType(IntegerType())), StructField("_tokens", LongType())]
    return reliable_checkpoint(docs.mapInArrow(counted, StructType([*[f for f in docs.schema.fields if f.name != text], *more])))


def _vectors(batches):
    """(part, row, column, value) of counted texts, some at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(part.column("_columns"))))
            column = np.asarray(part.column("_columns").flatten()).astype(np.int64)
            yield part, row, column, unit_vectors(row, np.asarray(part.column("_counts").flatten()), part.num_rows)


def _nearest(row: np.ndarray, column: np.ndarray, value: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, value * c[column], minlength=n) for c in centres], axis=1).argmax(axis=1)


def _summed(rows: DataFrame, size: int, numbers) -> np.ndarray:
    """Sums of whole numbers by place: ``numbers`` gives places and numbers of one part; partial sums per task."""

    def sums(batches):
        total = np.zeros(size, np.int64)
        for part, row, column, value in _vectors(batches):
            place, number = numbers(part, row, column, value)
            total += np.bincount(place, number, minlength=size).astype(np.int64)  # exact: below 2**53
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int32()), "v": pa.array(total[place])})

    found = rows.mapInArrow(sums, "place int, v long").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[np.asarray(found.column("place"))] = np.asarray(found.column("v"))
    return out


def fit_topics(counted: DataFrame, k: int = TOPICS) -> np.ndarray:
    """Centres (k x ``WIDTH``) over all counted texts that have words; words that all share are weighed down."""
    start = F.pmod(F.xxhash64(F.lit(SEED), "_columns", "_counts"), F.lit(k)).cast("int").alias("start")
    rows = counted.filter(F.size("_columns") > 0).select("_columns", "_counts", start)
    centres, n = np.zeros((k, WIDTH)), rows.count()
    if not n:
        return centres
    rarity = np.log1p(n / np.maximum(1, _summed(rows, WIDTH, lambda part, row, column, value: (column, np.ones(len(column))))))

    def step(near: np.ndarray | None) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast((rarity, near))

        def numbers(part, row, column, value):
            rarity, near = shared.value
            value = value * rarity[column]
            label = np.asarray(part.column("start")) if near is None else _nearest(row, column, value, near, part.num_rows)
            return label[row] * WIDTH + column, np.rint(value * UNIT)

        sums = _summed(rows, k * WIDTH, numbers).reshape(k, WIDTH)
        return sums / np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-12)

    centres = step(None)
    for _ in range(STEPS - 1):
        new = step(centres)
        if (new == centres).all():
            break
        centres = new
    return centres * rarity[None, :]


def with_topics(docs: DataFrame, centres: np.ndarray, text: str = "text") -> DataFrame:
    """docs with ``_topic`` (int) and ``_tokens`` (words, long); other columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(centres)

    def assigned(batches):
        for piece in pieces(batches, text):
            row, column, value, tokens = word_vectors(piece.column(text))
            topic = _nearest(row, column, value, shared.value, piece.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(topic, pa.int32()), pa.array(tokens, pa.int64())],
                names=[*piece.schema.names, "_topic", "_tokens"],
            )

    schema = StructType([*docs.schema.fields, StructField("_topic", IntegerType()), StructField("_tokens", LongType())])
    return docs.mapInArrow(assigned, schema)


def cells_of(rows: DataFrame) -> DataFrame:
    """source, lang, topic, tokens, n: one row per cell that has tokens."""
    return rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).filter("tokens > 0")


def source_shares(cells: DataFrame, power: float = TEMPERATURE) -> DataFrame:
    """source, share: token shares to a power, made to sum to 1."""
    sums = cells.groupBy("source").agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))
    total = sums.agg(F.sum("share")).first()[0]
    return sums.select("source", (F.col("share") / F.lit(total or 1.0)).alias("share"))


def _small_table(cells: DataFrame) -> tuple[list, list, np.ndarray]:
    """Languages, topics and the tokens of each pair; refuses more pairs than the driver should hold."""
    rows = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of language and topic: map languages to fewer values first")
    langs = sorted({r.lang for r in rows}, key=lambda v: (v is not None, v))
    topics = sorted({r.topic for r in rows})
    table = np.zeros((len(langs), len(topics)))
    for r in rows:
        table[langs.index(r.lang), topics.index(r.topic)] = r.tokens
    return langs, topics, table


def small_shares(table: np.ndarray, power: float = TEMPERATURE) -> tuple[np.ndarray, np.ndarray]:
    """Language shares to a power; topic shares to a power inside each language, so that the two can both be met."""
    lang = table.sum(axis=1) ** power
    lang /= lang.sum()
    inside = table**power
    return lang, lang @ (inside / inside.sum(axis=1, keepdims=True))


def _exponents(table: np.ndarray, lang: np.ndarray, topic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors that rake a languages x topics table to its two targets in turn."""
    b, c = np.ones(len(lang)), np.ones(len(topic))
    for _ in range(INNER):
        rows = (table * b[:, None] * c[None, :]).sum(axis=1)
        b *= np.divide(lang, rows, out=np.zeros_like(rows), where=rows > 0)
        columns = (table * b[:, None] * c[None, :]).sum(axis=0)
        c *= np.divide(topic, columns, out=np.zeros_like(columns), where=columns > 0)
    return b, c


def rake(
    cells: DataFrame, source: DataFrame | None = None, lang: dict | None = None, topic: dict | None = None
) -> tuple[DataFrame, int, float]:
    """cells with ``weight`` (sums to about 1 on every axis), the rounds used and the largest deviation left.

    source: a table of (source, share); lang, topic: shares by value. Left out: the tempered ones.
    """
    langs, topics, table = _small_table(cells)
    if not langs:
        return cells.withColumn("weight", F.lit(0.0)), 0, 0.0
    goal_lang, goal_topic = small_shares(table)
    goal_lang = goal_lang if lang is None else np.array([lang.get(v, 0.0) for v in langs])
    goal_topic = goal_topic if topic is None else np.array([topic.get(v, 0.0) for v in topics])
    shares = (source_shares(cells) if source is None else source).select(F.col("source").alias("_value"), "share")
    # One row per source: its cells (at most languages x topics) and its target.
    rows = cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "tokens", "n")).alias("cells"))
    rows = rows.join(shares, F.col("source").eqNullSafe(F.col("_value")), "left").select(
        "source", "cells", F.coalesce("share", F.lit(0.0)).alias("share")
    )
    rows = reliable_checkpoint(rows)
    place = {v: i for i, v in enumerate(langs)}
    column = {v: i for i, v in enumerate(topics)}
    b, c = np.ones(len(langs)), np.ones(len(topics))
    rounds, off = 0, float("inf")
    while rounds < ROUNDS:
        sums = _raked_table(rows, place, column, b, c)
        off = max(np.abs(sums.sum(axis=1) - goal_lang).max(), np.abs(sums.sum(axis=0) - goal_topic).max())
        rounds += 1
        if off <= TOLERANCE:
            break
        more_b, more_c = _exponents(sums, goal_lang, goal_topic)
        b, c = b * more_b, c * more_c
    return _weighted(rows, place, column, b, c), rounds, float(off)


def _source_factor(cells: list[dict], share: float, place, column, b, c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of a source's cells in the small table and their weights, raked to the source's target."""
    i, j = np.array([place[x["lang"]] for x in cells]), np.array([column[x["topic"]] for x in cells])
    weight = np.array([x["tokens"] for x in cells], float) * b[i] * c[j]
    total = weight.sum()
    return i, j, weight * (share / total if total > 0 else 0.0)


def _raked_table(rows: DataFrame, place, column, b, c) -> np.ndarray:
    """languages x topics sums of the weights after the source step: partial sums per task, one number per pair."""
    shape = (len(place), len(column))

    def sums(batches):
        total = np.zeros(shape)
        for batch in batches:
            for cells, share in zip(batch.column("cells").to_pylist(), batch.column("share").to_pylist(), strict=True):
                i, j, weight = _source_factor(cells, share, place, column, b, c)
                np.add.at(total, (i, j), weight)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(total.size), pa.int32()), "v": pa.array(total.ravel())})

    out = np.zeros(shape[0] * shape[1])
    for r in rows.select("cells", "share").mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out.reshape(shape)


def _weighted(rows: DataFrame, place, column, b, c) -> DataFrame:
    def weigh(batches):
        for batch in batches:
            out = []
            for cells, share in zip(batch.column("cells").to_pylist(), batch.column("share").to_pylist(), strict=True):
                out.append(_source_factor(cells, share, place, column, b, c)[2].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("source"), batch.column("cells"), pa.array(out, pa.list_(pa.float64()))],
                names=["source", "cells", "weight"],
            )

    fields = [rows.schema["source"], rows.schema["cells"], StructField("weight", ArrayType(DoubleType()))]
    weighed = rows.mapInArrow(weigh, StructType(fields))
    return weighed.select("source", F.explode(F.arrays_zip("cells", "weight")).alias("x")).select(
        "source", "x.cells.*", "x.weight"
    )


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """cells with ``p``: expected tokens are ``budget`` of all, in proportion to the weights, no p above 1."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale = 1.0
    want = F.col("weight") * F.lit(budget * total)
    for _ in range(FILLS):  # water-filling: one number a round
        got = cells.agg(F.sum(F.least(want * F.lit(scale), F.col("tokens")))).first()[0]
        if not got:
            break
        scale *= budget * total / got
    return cells.withColumn("p", F.least(F.lit(1.0), want * F.lit(scale) / F.col("tokens")))


def draw(*columns: str) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(SEED), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _calibrated(narrow: DataFrame, budget: float, targets: dict) -> DataFrame:
    """_s, _l, _t, _weight, _p: the calibrated cells of a narrow table of source, lang, topic and tokens."""
    raked, _, _ = rake(reliable_checkpoint(cells_of(narrow)), **targets)
    return probabilities(reliable_checkpoint(raked), budget).select(
        F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"),
        F.col("weight").alias("_weight"), F.col("p").alias("_p"),
    )


def _joined(rows: DataFrame, cells: DataFrame, topic: str) -> DataFrame:
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")) & (F.col(topic) == F.col("_t"))
    return rows.join(cells, same, "left")


def _narrow(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """One narrow row per document, written once, and the centres; texts are read in one scan and don't travel."""
    counted = counted_words(docs.select("doc_id", "source", "lang", draw("doc_id", "text").alias("u"), "text"))
    centres = fit_topics(counted)
    shared = docs.sparkSession.sparkContext.broadcast(centres)

    def assigned(batches):
        for part, row, column, value in _vectors(batches):
            topic = _nearest(row, column, value, shared.value, part.num_rows)
            rest = [part.column(c) for c in ("doc_id", "source", "lang", "u")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(topic, pa.int32()), part.column("_tokens")], names=["doc_id", "source", "lang", "u", "topic", "tokens"]
            )

    kept = [f for f in counted.schema.fields if not f.name.startswith("_")]
    schema = StructType([*kept, StructField("topic", IntegerType()), StructField("tokens", LongType())])
    return reliable_checkpoint(counted.mapInArrow(assigned, schema)), centres


def calibrate(docs: DataFrame, budget: float = BUDGET, **targets) -> DataFrame:
    """One row per document: source, lang, topic, tokens, weight of its cell, p and whether it is ``kept``."""
    narrow, _ = _narrow(docs)
    p = F.coalesce("_p", F.lit(0.0))
    return _joined(narrow, _calibrated(narrow, budget, targets), "topic").select(
        "doc_id", "source", "lang", "topic", "tokens", F.coalesce("_weight", F.lit(0.0)).alias("weight"), p.alias("p"),
        (F.col("u") < p).alias("kept"),
    )


def mix(docs: DataFrame, budget: float = BUDGET, **targets) -> DataFrame:
    """The rows of docs, unchanged, that the calibrated draw keeps."""
    narrow, centres = _narrow(docs)
    cells = _calibrated(narrow, budget, targets)
    kept = _joined(with_topics(docs, centres), cells, "_topic").filter(draw("doc_id", "text") < F.col("_p"))
    return kept.select(docs.columns)
