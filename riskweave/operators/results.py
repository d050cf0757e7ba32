"""Prompts for a labeler, and its responses back to rows. The call itself is outside; see ``labeling.score_with``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.fixed.labels import HEADS
from riskweave.functions.text import clean_artifacts, synth_subject
from riskweave.operators.conversion import text_list

_ENVELOPE = "custom_id string, error string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"
_ENVELOPE_ALT = "custom_id string, result struct<type:string,message:struct<content:array<struct<type:string,text:string>>>>"


# -- prompts ----------------------------------------------------------------------------------------------------


def _shortened(text: Column, most: int | None) -> Column:
    return text if most is None else F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def label_prompt(most_body: int | None = None, most_files: int | None = None) -> Column:
    """Task, the message as JSON (the body and the attachments cut only if a size is given) and the answer's form."""
    body = _shortened(F.col("body"), most_body)
    files = F.transform(
        "attachments" if most_files is None else F.slice("attachments", 1, most_files), lambda a: F.struct(a["name"].alias("name"), a["size"].alias("size"), a["mime"].alias("type"))
    )
    shown = F.to_json(
        F.struct(
            F.coalesce("user.role", F.lit("UNKNOWN")).alias("user_role"), F.coalesce("user.dept", F.lit("UNKNOWN")).alias("user_dept"),
            F.col("recipients"), F.col("subject"), body.alias("body"), files.alias("attachments"),
        )
    )
    return F.concat(
        F.lit("Rate how fitting this message is for its sender, recipients and content.\n\nMESSAGE:\n"), shown,
        F.lit('\n\nAnswer with one JSON object: numbers from 0 to 1 for "' + '", "'.join(HEADS) + '", and "reasoning" with a short text for each.'),
    )


def build_label_prompts(
    df: DataFrame, out: str = "prompt", most_body: int | None = None, most_files: int | None = None
) -> DataFrame:
    return df.withColumn(out, label_prompt(most_body, most_files))


# -- label responses --------------------------------------------------------------------------------------------


def parse_label_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Adds labels (null unless all four numbers are there, clipped to [0, 1]), reasoning and success.

    The object is the text from the first '{' to the last '}'.
    """
    found = F.regexp_extract(F.coalesce(response, F.lit("")), r"(?s)\{.*\}", 0)
    parsed = df.withColumn("_v", F.try_parse_json(F.when(found != "", found)))
    kind = lambda h: F.schema_of_variant(F.try_variant_get("_v", f"$.{h}", "variant"))
    numeric = lambda h: F.coalesce(kind(h).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    value = lambda h: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_variant_get("_v", f"$.{h}", "double")))
    complete = numeric(HEADS[0]) & numeric(HEADS[1]) & numeric(HEADS[2]) & numeric(HEADS[3])
    return parsed.withColumns(
        {
            "labels": F.when(complete, F.struct(*[value(h).alias(h) for h in HEADS])),
            "reasoning": F.try_variant_get("_v", "$.reasoning", "map<string,string>"),
        }
    ).withColumn("success", F.col("labels").isNotNull()).drop("_v")


def attach_label_results(messages: DataFrame, results: DataFrame, provider: str, model: str, key: str = "msg_id") -> DataFrame:
    """Successful results add labels, reasoning and metadata; other messages stay as they are."""
    good = results.filter("success").select(
        key, F.col("labels").alias("other_labels"), F.col("reasoning"),
        F.struct(
            F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.col("cost"), F.col("response_time")
        ).alias("labeling_metadata"),
    )
    return messages.join(good, key, "left")


# -- generated messages -----------------------------------------------------------------------------------------

_FENCED = r"(?s)```json\s*(\{.*?\})\s*```"
_NESTED = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def unfence(text: Column) -> Column:
    """The inside of a leading code fence, else the text, trimmed."""
    trimmed = F.trim(text)
    inside = F.regexp_extract(trimmed, r"(?s)^```(?:json)?(.*)```", 1)
    return F.when(trimmed.startswith("```") & (inside != ""), F.trim(inside)).otherwise(trimmed)


def _message_fields(v: Column, raw: Column, most: int | None) -> dict[str, Column]:
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    short = _shortened(raw, most)
    return {
        "channel": F.coalesce(get("channel"), F.lit("email")),
        "user": F.coalesce(F.try_variant_get(v, "$.user", "map<string,string>"), F.create_map(F.lit("role"), F.lit("batch_recovered"))),
        "recipients": text_list(F.try_variant_get(v, "$.recipients", "variant")),
        "subject": F.coalesce(get("subject"), F.lit("")),
        "body": F.coalesce(get("body"), short),
        "original_length": F.length(raw),
        "parsing_failed": F.lit(False),
    }


def parse_generated_json(df: DataFrame, text: str = "text", most_body: int | None = None) -> DataFrame:
    """One message per response: a fenced object, else the first object with one level of nesting, else the text
    itself (cut only if ``most_body`` is given) marked ``parsing_failed``. An object that is found but broken drops the row."""
    raw = F.col(text)
    fenced = F.regexp_extract(raw, _FENCED, 1)
    candidate = F.when(fenced != "", fenced).otherwise(F.regexp_extract(raw, _NESTED, 0))
    staged = df.withColumn("_c", candidate).withColumn("_v", F.try_parse_json(F.when(F.col("_c") != "", F.col("_c"))))
    nothing = F.col("_c") == ""
    fields = _message_fields(F.col("_v"), raw, most_body)
    fallback = {
        "channel": F.lit("email"),
        "user": F.create_map(F.lit("role"), F.lit("batch_recovered_fallback")),
        "recipients": F.array(F.lit("recipient@example.com")),
        "subject": F.lit("Recovered Batch Result"),
        "body": fields["body"],
        "original_length": F.length(raw),
        "parsing_failed": F.lit(True),
    }
    keep = staged.filter(nothing | F.col("_v").isNotNull())
    return keep.select(*df.columns, *[F.when(nothing, fallback[n]).otherwise(fields[n]).alias(n) for n in fields])


def parse_many_json(df: DataFrame, text: str = "text") -> DataFrame:
    """All objects of a response, one row each: valid lines; if none, objects found by pattern; if none, an array."""
    lines = F.filter(F.transform(F.split(F.trim(text), "\n"), F.trim), lambda x: x.startswith("{") & x.endswith("}"))
    parsed = lambda values: F.filter(F.transform(values, F.try_parse_json), lambda v: v.isNotNull())
    by_line = parsed(lines)
    by_pattern = parsed(F.regexp_extract_all(text, F.lit(_NESTED), F.lit(0)))
    whole = F.try_variant_get(F.try_parse_json(F.trim(text)), "$", "array<variant>")
    staged = df.withColumn("_l", by_line).withColumn("_p", F.when(F.size("_l") == 0, by_pattern))
    chosen = F.when(F.size("_l") > 0, F.col("_l")).when(F.size("_p") > 0, F.col("_p")).otherwise(F.coalesce(whole, F.array()))
    return staged.select(*df.columns, F.posexplode_outer(chosen).alias("object_no", "object")).filter("object is not null")


def convert_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Placeholders ('BATCH_...') drop out; JSON is parsed; other text becomes a message with a subject from its first
    sentence and default labels. Adds channel, subject, body, default_labels."""
    text = F.col(response)
    is_json = F.trim(text).startswith("{")
    staged = df.filter(~text.startswith("BATCH_")).withColumn("_v", F.when(is_json, F.try_parse_json(text)))
    get = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    clean = clean_artifacts(text)
    default = F.create_map(F.lit("sensitivity"), F.lit(0), F.lit("exposure"), F.lit(0), F.lit("context"), F.lit(1))
    return staged.filter(~is_json | F.col("_v").isNotNull()).select(
        *df.columns,
        F.when(is_json, F.coalesce(get("channel"), F.lit("email"))).otherwise("email").alias("channel"),
        F.when(is_json, F.coalesce(get("subject"), F.lit(""))).otherwise(synth_subject(clean)).alias("subject"),
        F.when(is_json, F.coalesce(get("body"), F.lit(""))).otherwise(clean).alias("body"),
        F.when(~is_json, default).alias("default_labels"),
    )


def stamp(df: DataFrame, split: str, provider: str, model: str, batch_num: str = "batch_num", index: str = "request_index") -> DataFrame:
    """Metadata of a converted response."""
    number = F.lpad(F.col(batch_num).cast("string"), 3, "0")
    return df.withColumn(
        "_metadata",
        F.struct(
            F.lit(split).alias("split"), F.col(batch_num).alias("batch_num"), F.col(index).alias("request_index"),
            F.coalesce("agent_type", F.lit("unknown")).alias("agent_type"), F.lit(provider).alias("provider"), F.lit(model).alias("model"),
            F.concat(F.lit(f"{split}_batch_"), number, F.lit(f"_{provider}_{model}")).alias("batch_id"),
        ),
    )


# -- envelopes --------------------------------------------------------------------------------------------------


def unwrap_first(lines: DataFrame, line: str = "line") -> DataFrame:
    """custom_id and content of ``response.body.choices[0].message.content``; lines without it drop out."""
    parsed = lines.withColumn("_e", F.from_json(line, _ENVELOPE))
    content = F.get(F.col("_e.response.body.choices"), F.lit(0))["message"]["content"]
    rest = [c for c in lines.columns if c != line]
    return parsed.select(*rest, F.col("_e.custom_id").alias("custom_id"), content.alias("content")).filter("content is not null")


def unwrap_second(lines: DataFrame, line: str = "line") -> DataFrame:
    """custom_id and first content text of succeeded results."""
    parsed = lines.withColumn("_e", F.from_json(line, _ENVELOPE_ALT))
    content = F.when(F.col("_e.result.type") == "succeeded", F.get(F.col("_e.result.message.content"), F.lit(0))["text"])
    rest = [c for c in lines.columns if c != line]
    return parsed.select(*rest, F.col("_e.custom_id").alias("custom_id"), content.alias("content")).filter("content is not null")


def map_results_to_requests(requests: DataFrame, results: DataFrame, index: str = "request_index", ordered: bool = True) -> DataFrame:
    """Every request with the content of 'request-<index>', null if missing; of repeated ids the greatest content. Rows come
    in the order of the requests (a sort by range, left out with ``ordered=False``)."""
    number = F.regexp_extract("custom_id", r"^request-(\d+)", 1)
    by_index = results.filter(number != "").groupBy(number.cast("bigint").alias(index)).agg(F.max("content").alias("content"))
    mapped = requests.join(by_index, index, "left")
    return mapped.orderBy(index) if ordered else mapped


def join_requests(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results with their request by custom_id."""
    return results.join(requests, "custom_id")
