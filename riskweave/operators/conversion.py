"""Normalisation and conversion of raw messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.fixed import corpus
from riskweave.functions import labels as L
from riskweave.functions import obfuscation
from riskweave.functions import recipients as R
from riskweave.functions import spans as S
from riskweave.functions.markup import link_texts
from riskweave.functions.spans import let
from riskweave.functions.text import clean_artifacts, contains_any, guess_mime, named_flags, stable_id, synth_subject
from riskweave.schema import ATTACHMENT, SPAN, THREAD

_TEXTS = "array<string>"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def text_list(value: Column) -> Column:
    """A variant as a list of strings: list items without nulls, an object as its JSON, a scalar as its text."""
    items = F.transform(
        F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda v: v.isNotNull() & (_kind(v) != "VOID")),
        lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)),
    )
    kind = _kind(value)
    return (
        F.when(kind == "VOID", F.array().cast(_TEXTS))
        .when(kind.startswith("ARRAY"), items)
        .when(kind.startswith("OBJECT"), F.array(F.to_json(value)))
        .otherwise(F.array(F.try_variant_get(value, "$", "string")))
    )


def normalize_records(df: DataFrame, line: str = "line") -> DataFrame:
    """Raw JSON lines to typed records. Rows that are not JSON objects are dropped, as are blank lines.

    Every field is coerced: lists to lists of strings, objects where objects are due, else empty or null.
    """
    parsed = df.filter(F.trim(line) != "").withColumn("_v", F.try_parse_json(line))
    field = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    as_object = lambda name, kind: F.when(
        _kind(field(name)).startswith("OBJECT"), F.try_variant_get("_v", f"$.{name}", kind)
    )
    texts = "map<string,string>"
    return parsed.filter(_kind(F.col("_v")).startswith("OBJECT")).select(
        *[c for c in df.columns if c != line],
        F.coalesce(F.try_variant_get("_v", "$.channel", "string"), F.lit("email")).alias("channel"),
        F.coalesce(as_object("user", texts), F.create_map().cast(texts)).alias("user"),
        text_list(field("recipients")).alias("recipients"),
        F.coalesce(F.try_variant_get("_v", "$.subject", "string"), F.lit("")).alias("subject"),
        F.coalesce(F.try_variant_get("_v", "$.body", "string"), F.lit("")).alias("body"),
        text_list(field("attachments")).alias("attachments"),
        text_list(field("links")).alias("links"),
        as_object("thread", THREAD).alias("thread"),
        as_object("labels", "map<string,double>").alias("labels"),
        F.try_variant_get("_v", "$.spans", f"array<{SPAN}>").alias("spans"),
        F.coalesce(as_object("_metadata", texts), F.create_map().cast(texts)).alias("_metadata"),
    )


MOST_KEYS = 5_000


def key_rows(df: DataFrame, column: str) -> DataFrame:
    """key and the number of rows that have it, one row per key found anywhere in a map column."""
    return df.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def unify_keys(df: DataFrame, column: str) -> DataFrame:
    """Every map gets all keys found anywhere, missing ones as ''.

    Keys are found as rows. That every row then carries all of them is the operator's meaning, so it is for schemas: with
    over ``MOST_KEYS`` keys (ids as keys, say) it raises an error, and ``long_keys`` is the form to use.
    """
    keys = sorted(r["key"] for r in key_rows(df, column).select("key").limit(MOST_KEYS + 1).collect())
    if len(keys) > MOST_KEYS:
        raise ValueError(f"over {MOST_KEYS} different keys in {column}: use long_keys")
    all_keys = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    pair = lambda k: F.struct(k.alias("key"), F.coalesce(F.element_at(F.col(column), k), F.lit("")).alias("value"))
    return df.withColumn(column, F.map_from_entries(F.transform(all_keys, pair)))


def long_keys(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """The same as rows: ``keys``, key, value, and in how many rows the key is found. Any number of keys; a row has only
    its own, and a key that it lacks reads as ''."""
    pairs = df.select(*keys, F.explode(column).alias("key", "value"))
    return pairs.join(key_rows(df, column), "key")


def _attachment(name: Column, size: Column, mime: Column, summary: Column, indicators: Column) -> Column:
    return F.struct(
        name.alias("name"), size.cast("bigint").alias("size"), mime.alias("mime"), summary.alias("content_summary"),
        indicators.alias("sensitivity_indicators"),
    ).cast(ATTACHMENT)


def attachment_structs(attachments: Column) -> Column:
    """A variant list of attachments: a string gives name and guessed mime, an object is kept (size may be text),
    anything else becomes its text."""
    nothing = F.array().cast(_TEXTS)

    def one(v: Column) -> Column:
        get = lambda name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
        text = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
        from_object = _attachment(
            get("name"),
            F.coalesce(get("size").try_cast("bigint"), F.lit(0)),
            F.coalesce(get("mime"), get("mime_type"), guess_mime(get("name"))),
            F.coalesce(get("content_summary"), F.lit("")),
            F.coalesce(get("sensitivity_indicators", _TEXTS), nothing),
        )
        from_text = _attachment(text, F.lit(0), guess_mime(text), F.lit(""), nothing)
        return F.when(_kind(v).startswith("OBJECT"), from_object).otherwise(from_text)

    items = F.filter(F.try_variant_get(attachments, "$", "array<variant>"), lambda v: _kind(v) != "VOID")
    alone = F.when(_kind(attachments) == "STRING", F.array(one(attachments)))
    return F.coalesce(F.transform(items, one), alone, F.array().cast(f"array<{ATTACHMENT}>"))


def normalize_attachments(df: DataFrame, attachments: str = "attachments") -> DataFrame:
    """Attachment column as variant (or JSON text) to the message form."""
    column = F.col(attachments)
    if dict(df.dtypes)[attachments] == "string":
        column = F.try_parse_json(column)
    return df.withColumn(attachments, attachment_structs(column))


def normalize_links(df: DataFrame, links: str = "links") -> DataFrame:
    column = F.col(links)
    if dict(df.dtypes)[links] == "string":
        column = F.try_parse_json(column)
    return df.withColumn(links, link_texts(column))


def enrich_attachment(name: Column, domain: Column, risk: Column) -> Column:
    """Attachment summary and indicators from the primary domain of the message and the file name."""
    lower = F.lower(name)
    mime = None
    for extension, value in corpus.ENRICH_MIME.items():
        mime = (F if mime is None else mime).when(lower.endswith(extension), F.lit(value))
    summary = indicators = None
    for kind, profiles in corpus.ATTACHMENT_PROFILES.items():
        for words, text, marks in profiles:
            hit = (domain == kind) & (contains_any(lower, words) if words else F.lit(True))
            summary = (F if summary is None else summary).when(hit, F.lit(text))
            indicators = (F if indicators is None else indicators).when(hit, F.array(*[F.lit(m) for m in marks]))
    exported = (lower.endswith(".xlsx") | lower.endswith(".csv")) & contains_any(lower, ["data", "export"])
    general = named_flags({"data_export": exported, "confidential": contains_any(lower, ["confidential", "sensitive"])})
    marks = indicators.otherwise(general)
    return _attachment(
        name,
        F.lit(0),
        mime.otherwise(F.lit(corpus.DEFAULT_MIME)),
        summary.otherwise(F.lit(corpus.GENERAL_ATTACHMENT_SUMMARY)),
        F.when(risk == "high", F.array_union(marks, F.array(F.lit(corpus.HIGH_EXPOSURE_INDICATOR)))).otherwise(marks),
    )


def enrich_attachments(df: DataFrame, names: str = "file_names", out: str = "attachments") -> DataFrame:
    """Attachments given as file names to full attachments, by business domain and recipient risk."""
    context = F.struct(
        R.primary_domain(F.concat_ws(" ", "subject", "body"))["domain"].alias("domain"),
        R.recipient_risk(F.col("recipients")).alias("risk"),
    )
    return df.withColumn(
        out, let(context, lambda c: F.transform(names, lambda n: enrich_attachment(n, c["domain"], c["risk"])))
    )


def convert_messages(df: DataFrame, names: str = "file_names") -> DataFrame:
    """Messages with neither body nor subject are rejected; the rest get spans, attachments, labels, thread, meta."""
    kept = df.filter((F.coalesce(F.length("body"), F.lit(0)) > 0) | (F.coalesce(F.length("subject"), F.lit(0)) > 0))
    detected = enrich_attachments(kept, names).withColumn("spans", S.detect("body", "converter"))
    fallback_id = stable_id(F.col("msg_id"), F.col("subject"))
    return detected.withColumns(
        {
            "labels": L.converter_labels(
                F.col("user"), F.col("body"), F.col("recipients"), F.col("attachments"), F.col("spans")
            ),
            "thread": F.struct(
                F.coalesce("thread.id_hash", fallback_id).alias("id_hash"),
                F.coalesce("thread.age_days", F.lit(0)).alias("age_days"),
                F.coalesce("thread.prior_msgs", F.lit(0)).alias("prior_msgs"),
            ),
            "meta": F.create_map(
                F.lit("agent"), F.coalesce("agent", F.lit("unknown")), F.lit("converter_version"), F.lit("1.0"),
                F.lit("base64"), F.lower("body").contains("base64").cast("string"),
                F.lit("homoglyph"), obfuscation.non_ascii(F.col("body")).cast("string"),
            ),
        }
    )


def conversion_report(raw: DataFrame, line: str = "line") -> DataFrame:
    """One row over raw JSON lines: non-objects, empty messages, convertible ones and the success rate in percent."""
    parsed = raw.filter(F.trim(line) != "").select(F.try_parse_json(line).alias("v"))
    is_object = _kind(F.col("v")).startswith("OBJECT")
    filled = (F.coalesce(F.try_variant_get("v", "$.body", "string"), F.lit("")) != "") | (
        F.coalesce(F.try_variant_get("v", "$.subject", "string"), F.lit("")) != ""
    )
    return parsed.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(~is_object).alias("non_dict"),
        F.count_if(is_object & ~filled).alias("empty_content"),
        F.count_if(is_object & filled).alias("converted"),
    ).withColumn(
        "success_rate",
        F.when(F.col("total_processed") > 0, F.col("converted") / F.col("total_processed") * 100).otherwise(0.0),
    )


# -- conversations ----------------------------------------------------------------------------------------------


def parse_conversation(df: DataFrame, response: str = "response", thread_id: str = "thread_id") -> DataFrame:
    """A response of several JSON lines to one row per valid line; prior_msgs is the line number."""
    lines = F.split(F.trim(response), "\n")
    numbered = df.select("*", F.posexplode_outer(lines).alias("prior_msgs", "_line"))
    line = F.trim("_line")
    valid = numbered.filter(line.startswith("{") & line.endswith("}")).withColumn("_v", F.try_parse_json(line))
    get = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    return valid.filter("_v is not null").select(
        *[c for c in df.columns if c != response],
        "prior_msgs",
        F.coalesce(get("channel"), F.lit("email")).alias("channel"),
        F.coalesce(get("subject"), F.lit("")).alias("subject"),
        F.coalesce(get("body"), F.lit("")).alias("body"),
        text_list(F.try_variant_get("_v", "$.recipients", "variant")).alias("recipients"),
    )


def turns_to_messages(turns: DataFrame) -> DataFrame:
    """Conversation turns to messages of a thread: the turn number is the count of prior messages.

    Threads stay rows: a thread of any length is never gathered into one task.
    """
    return turns.select(
        F.col("conv_id"),
        F.struct(
            F.substring(F.md5(F.concat(F.lit("conv_"), F.col("conv_id"))), 1, 16).alias("id_hash"),
            F.lit(0).alias("age_days"),
            F.col("turn").cast("int").alias("prior_msgs"),
        ).alias("thread"),
        F.col("role").alias("sender_role"),
        synth_subject(clean_artifacts(F.col("text"))).alias("subject"),
        clean_artifacts(F.col("text")).alias("body"),
    )
