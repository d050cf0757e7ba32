"""Span detection and obfuscation jobs. All work is per row: no shuffle, whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import obfuscation
from riskweave.functions import spans as S
from riskweave.functions.text import col_of


def detect_spans(
    df: DataFrame,
    text: str = "body",
    ruleset: str | Sequence[S.SpanRule] = "full",
    overlap: str | None = None,
    out: str = "spans",
) -> DataFrame:
    """Adds the spans of a text column by a named or own rule set."""
    return df.withColumn(out, S.detect(text, ruleset, overlap))


def resolve_overlaps(df: DataFrame, rule: str, spans: str = "spans") -> DataFrame:
    """Applies an overlap rule ('confidence', 'longest', 'distinct') to an existing span column."""
    return df.withColumn(spans, S.resolve(spans, rule))


def spans_table(df: DataFrame, keys: Sequence[str] = ("msg_id",), spans: str = "spans") -> DataFrame:
    """One row per span.

    The outer form: the inner one makes Catalyst repeat the whole detection in a filter below the projection.
    """
    return df.select(*keys, F.inline_outer(spans)).filter("type is not null")


def overlap_pairs(df: DataFrame, keys: Sequence[str] = ("msg_id",), spans: str = "spans") -> DataFrame:
    """One row per overlapping pair of spans of a message."""
    return df.select(*keys, F.inline_outer(S.overlap_pairs(spans))).filter("first_type is not null")


def overlap_counts(df: DataFrame, keys: Sequence[str] = ("msg_id",), spans: str = "spans") -> DataFrame:
    """One row per span: how many spans of its message overlap it, and the first of them. Linear in the spans, so use it
    in place of ``overlap_pairs`` where many spans may lie over each other."""
    return df.select(*keys, F.inline_outer(S.rivals(spans))).filter("type is not null")


def validate_span_bounds(
    df: DataFrame, text: Column | str = "body", offset: Column | int = 0, spans: str = "spans", out: str = "valid_spans"
) -> DataFrame:
    """Spans that lie inside the text, moved by the offset of the text in a larger one."""
    return df.withColumn(out, S.valid_bounds(F.col(spans), col_of(text), offset))


def span_boundary_check(df: DataFrame, text: Column | str, spans: str = "spans") -> DataFrame:
    """One row: messages, spans, and spans that do not cover the text they carry."""
    return df.select(
        F.size(spans).alias("n"), S.boundary_violations(F.col(spans), col_of(text)).alias("bad")
    ).agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("spans"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("violations"),
    )


def bio_char_tags(df: DataFrame, text: str = "body", spans: str = "spans", out: str = "tags") -> DataFrame:
    return df.withColumn(out, S.char_tags(spans, text))


def bio_token_tags(
    df: DataFrame, tokens: str = "tokens", spans: str = "spans", vocabulary: str = "training", out: str = "tag_ids"
) -> DataFrame:
    """Tag ids of tokens given as struct<start, end> character ranges."""
    return df.withColumn(out, S.token_tag_ids(F.col(tokens), F.col(spans), vocabulary))


def detect_obfuscation(df: DataFrame, text: Column | str = "body") -> DataFrame:
    """Adds the seven obfuscation flags."""
    flags = obfuscation.obfuscation_flags(col_of(text))
    return df.withColumns(flags)


def obfuscation_techniques(df: DataFrame, text: Column | str = "body", out: str = "techniques") -> DataFrame:
    return df.withColumn(out, obfuscation.techniques(col_of(text)))


def mask_spans(df: DataFrame, text: str = "body", out: str = "masked") -> DataFrame:
    return df.withColumn(out, obfuscation.mask(F.col(text)))
