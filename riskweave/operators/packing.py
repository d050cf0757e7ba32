"""Markup, token ids and packed training rows as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import markup
from riskweave.functions.hashing import below, digest, uniform
from riskweave.functions.spans import let


def _meta(df: DataFrame) -> Column:
    return F.col("meta") if "meta" in df.columns else F.lit(None).cast("map<string,string>")


def serialize_dsl(df: DataFrame, out: str = "markup") -> DataFrame:
    """Adds struct<text, body_start, body_end, spans>."""
    parts = [F.col(c) for c in ("channel", "user", "recipients", "thread", "subject", "body", "attachments", "links")]
    spans = F.col("spans") if "spans" in df.columns else None
    return df.withColumn(out, markup.serialize(*parts, _meta(df), spans))


def pack_examples(df: DataFrame, labels: str = "labels", max_length: int = 1024, vocabulary: str = "training") -> DataFrame:
    """Adds ``packed`` from spans and labels: one row a message, cut to its first ``max_length`` characters.

    ``pack_windows`` keeps the whole markup.
    """
    marked = df if "markup" in df.columns else serialize_dsl(df)
    return marked.withColumn("packed", markup.pack(F.col("markup"), F.col(labels), max_length, vocabulary))


def pack_windows(
    df: DataFrame, keep: Sequence[str] = ("msg_id",), labels: str = "labels", max_length: int = 1024,
    vocabulary: str = "training",
) -> DataFrame:
    """The kept columns, window_no and ``packed``: one row per window of the whole markup, the last one padded."""
    marked = df if "markup" in df.columns else serialize_dsl(df)
    rows = marked.select(*keep, F.col(labels).alias("_l"), F.explode_outer(markup.windows(F.col("markup"), max_length)).alias("_w"))
    start = F.col("_w.window_no") * max_length
    packed = markup.pack_window(F.col("_w.text"), start, F.col("_w.spans"), F.col("_l"), max_length, vocabulary)
    return rows.select(*keep, "_w.window_no", packed.alias("packed"))


def encode_windows(df: DataFrame, text: str, max_length: int) -> DataFrame:
    """One row per window of ``max_length`` ids of the whole text (begin id first, end id last), the last one padded."""
    encoded = df.withColumn("_ids", markup.encode_chars(F.col(text)))
    last = F.floor((F.size("_ids") - 1) / max_length).cast("int")
    windows = encoded.withColumn("window_no", F.explode_outer(F.sequence(F.lit(0), last)))
    ids = F.slice("_ids", F.col("window_no") * max_length + 1, F.lit(max_length))
    missing = F.lit(max_length) - F.size(ids)
    return windows.withColumn("ids", F.concat(ids, F.array_repeat(F.lit(markup.PAD), missing))).drop("_ids")


def mask_tokens(
    df: DataFrame, ids: str, mask_id: int, key: str = "msg_id", p: float = 0.15, seed: int = 42, first: int = 5
) -> DataFrame:
    """Adds masked_ids, mask_flags and keeps the originals; the first tokens are never masked."""
    keys = F.concat_ws("|", F.lit(str(seed)), F.lit("mask"), F.col(key).cast("string"), F.lit(""))  # joined once a row
    drawn = lambda k, i: F.md5(F.concat(k, i.cast("string")))  # noqa: E731  # digest(seed, "mask", key, i)
    flags = let(keys, lambda k: F.transform(F.col(ids), lambda t, i: (i >= first) & below(p, drawn(k, i))))
    return df.withColumn("mask_flags", flags).withColumn(
        "masked_ids", F.zip_with(ids, "mask_flags", lambda t, m: F.when(m, F.lit(mask_id)).otherwise(t))
    )


def shuffle_sections(
    df: DataFrame, ids: str, key: str = "msg_id", p: float = 0.10, segment: int = 64, seed: int = 42
) -> DataFrame:
    """For a share of rows, whole segments in another order (the rest after the last whole segment stays); label 1."""
    tokens = F.col(ids)
    whole = F.floor(F.size(tokens) / segment).cast("int")
    chosen = (uniform(seed, "section", F.col(key)) < p) & (whole > 1)
    segments = F.transform(
        F.sequence(F.lit(0), whole - 1),
        lambda i: F.struct(digest(seed, "order", F.col(key), i).alias("k"), F.slice(tokens, i * segment + 1, F.lit(segment)).alias("s")),
    )
    moved = F.flatten(F.transform(F.array_sort(segments), lambda x: x["s"]))
    rest = F.slice(tokens, whole * segment + 1, F.size(tokens))
    return df.withColumn("shuffle_label", chosen.cast("int")).withColumn(
        "shuffled_ids", F.when(chosen, F.concat(moved, rest)).otherwise(tokens)
    )


def dsl_corpus(df: DataFrame) -> DataFrame:
    """Markup text of every message, one row each, ready for ``write.text``."""
    return serialize_dsl(df.drop("spans") if "spans" in df.columns else df).select(F.col("markup.text").alias("value"))
