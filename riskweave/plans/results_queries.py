"""Prompts, responses, envelopes, normalisation and batch forms of the streaming jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import conversion as C
from riskweave.operators import results as Rs
from riskweave.plans.corpus_queries import _CLEANED_TURN
from riskweave.plans.message_view import messages, scan, sql_subject, sql_text, with_messages
from riskweave.plans.registry import query
from riskweave.plans.statistics_queries import batch_log
from riskweave.sources import sinks
from riskweave.streaming.jobs import stream_throughput


@query("build_label_prompts")
def build_label_prompts(spark, sf_dir):
    return Rs.build_label_prompts(messages(spark, sf_dir)).select("msg_id", F.length("prompt").alias("prompt_length"), F.md5("prompt").alias("prompt_md5"))


def _responses(spark, sf_dir):
    """A labeler's answer per labelled document, in several shapes, from its labels."""
    l = scan(spark, sf_dir, "labels", spread=False)  # noqa: E741
    number = lambda c: c.cast("string")
    full = F.concat(
        F.lit('Sure: {"sensitivity": '), number(F.col("quality") * 1.5), F.lit(', "exposure": '), number(F.col("toxic")),
        F.lit(', "context": 0.25, "obfuscation": -1, "reasoning": {"context": "r"}} done'),
    )
    shape = F.col("doc_id") % 4
    text = F.when(shape == 0, full).when(shape == 1, F.replace(full, F.lit('"exposure"'), F.lit('"other"'))).when(shape == 2, "no answer").otherwise(F.replace(full, F.lit("0.25"), F.lit('"x"')))
    return l.select(F.col("doc_id").alias("msg_id"), text.alias("response"), F.lit(0.001).alias("cost"), F.lit(1.5).alias("response_time"))


@query(
    "parse_label_responses",
    "SELECT doc_id AS msg_id, doc_id % 4 = 0 AS success, CASE WHEN doc_id % 4 = 0 THEN CAST(quality AS DOUBLE) END AS sensitivity, CASE WHEN doc_id % 4 = 0 THEN CAST(toxic AS DOUBLE) END AS exposure, "
    "CASE WHEN doc_id % 4 = 0 THEN CAST(0.25 AS DOUBLE) END AS context, CASE WHEN doc_id % 4 = 0 THEN CAST(0 AS DOUBLE) END AS obfuscation FROM labels",
)
def parse_label_responses(spark, sf_dir):
    return Rs.parse_label_responses(_responses(spark, sf_dir)).select("msg_id", "success", "labels.*")


@query(
    "attach_label_results",
    "SELECT source, count(*) AS n, count(l.doc_id) FILTER (l.doc_id % 4 = 0) AS labelled, CAST(coalesce(sum(least(quality, 1)) FILTER (l.doc_id % 4 = 0), 0) AS DOUBLE) AS sensitivity_sum FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source",
)
def attach_label_results(spark, sf_dir):
    m = scan(spark, sf_dir, "documents", spread=False).select(F.col("doc_id").alias("msg_id"), "source")
    done = Rs.attach_label_results(m, Rs.parse_label_responses(_responses(spark, sf_dir)), "p", "m")
    return done.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("other_labels").alias("labelled"), F.coalesce(F.sum("other_labels.sensitivity"), F.lit(0.0)).alias("sensitivity_sum")
    )


def _generated(spark, sf_dir):
    d = scan(spark, sf_dir, "documents").select("doc_id", "text", "source")
    as_json = F.to_json(F.struct(F.col("source").alias("channel"), F.struct(F.lit("HR").alias("role")).alias("user"), F.lit("s").alias("subject"), F.col("text").alias("body")))
    shape = F.col("doc_id") % 4
    text = (
        F.when(shape == 0, F.concat(F.lit("Here:\n```json\n"), as_json, F.lit("\n```")))
        .when(shape == 1, F.concat(F.lit("ok "), as_json, F.lit(" bye")))
        .when(shape == 2, F.regexp_replace("text", "[{}]", ""))
        .otherwise("{broken: [}")
    )
    return d.select("doc_id", text.alias("text"))


_JSON_SQL = "CAST(json_object('channel', source, 'user', json_object('role', 'HR'), 'subject', 's', 'body', text) AS VARCHAR)"


_FENCED_SQL = sql_text(r"(?s)\A(\{.*?\})\s*```")
_NESTED_SQL = sql_text(Rs._NESTED)


@query(
    "parse_generated_json",
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'email' ELSE json_extract_string(c, '$.channel') END AS channel, doc_id % 4 = 2 AS parsing_failed,
  CASE WHEN doc_id % 4 = 2 THEN plain ELSE json_extract_string(c, '$.body') END AS body
FROM (SELECT doc_id, plain, CASE doc_id % 4 WHEN 0 THEN regexp_extract(j, {_FENCED_SQL}, 1) WHEN 1 THEN regexp_extract(j, {_NESTED_SQL}) ELSE '' END AS c
  FROM (SELECT doc_id, regexp_replace(text, '[{{}}]', '', 'g') AS plain, {_JSON_SQL} || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '```' ELSE '' END AS j FROM documents))
WHERE doc_id % 4 = 2 OR (doc_id % 4 < 2 AND json_valid(c))""",
)
def parse_generated_json(spark, sf_dir):
    return Rs.parse_generated_json(_generated(spark, sf_dir)).select("doc_id", "channel", "parsing_failed", "body")


@query(
    "parse_many_json",
    "SELECT conv_id, turn, role FROM conversations",
)
def parse_many_json(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", spread=False)
    shape = F.col("conv_id") % 3
    one = F.to_json(F.struct("turn", "role"))
    text = F.when(shape == 0, F.concat(one, F.lit("\n"))).when(shape == 1, F.concat(F.lit("see "), one, F.lit(" end"))).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    many = Rs.parse_many_json(c.select("conv_id", text.alias("text")))
    return many.select("conv_id", F.try_variant_get("object", "$.turn", "bigint").alias("turn"), F.try_variant_get("object", "$.role", "string").alias("role"))


@query(
    "convert_response",
    f"""SELECT conv_id, turn, 'email' AS channel, CASE WHEN conv_id % 3 = 1 THEN '' ELSE {sql_subject('cleaned')} END AS subject, md5(CASE WHEN conv_id % 3 = 1 THEN text ELSE cleaned END) AS body_md5
FROM (SELECT *, {_CLEANED_TURN} AS cleaned FROM conversations) WHERE conv_id % 3 > 0""",
)
def convert_response(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", spread=False)
    shape = F.col("conv_id") % 3
    text = F.when(shape == 0, F.concat(F.lit("BATCH_"), F.col("conv_id").cast("string"))).when(shape == 1, F.to_json(F.struct(F.col("text").alias("body")))).otherwise(F.col("text"))
    return Rs.convert_response(c.select("conv_id", "turn", text.alias("response"))).select("conv_id", "turn", "channel", "subject", F.md5("body").alias("body_md5"))


def _lines(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", spread=False)
    key = (F.col("conv_id") * 10 + F.col("turn")).cast("string")
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    first = F.to_json(F.struct(F.concat(F.lit("request-"), key).alias("custom_id"), F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response")))
    second = F.to_json(
        F.struct(
            F.concat(F.lit("request-"), key).alias("custom_id"),
            F.struct(
                F.when(F.col("turn") % 5 == 4, "errored").otherwise("succeeded").alias("type"),
                F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message"),
            ).alias("result"),
        )
    )
    return c.select(F.when(F.col("turn") % 4 == 3, "{not json").otherwise(first).alias("line")), c.select(second.alias("line"))


@query("unwrap_results", "SELECT 'request-' || (conv_id * 10 + turn) AS custom_id, md5(text) AS content_md5 FROM conversations WHERE turn % 4 <> 3")
def unwrap_results(spark, sf_dir):
    return Rs.unwrap_first(_lines(spark, sf_dir)[0]).select("custom_id", F.md5("content").alias("content_md5"))


@query("unwrap_results_alt", "SELECT 'request-' || (conv_id * 10 + turn) AS custom_id, md5(text) AS content_md5 FROM conversations WHERE turn % 5 <> 4")
def unwrap_results_alt(spark, sf_dir):
    return Rs.unwrap_second(_lines(spark, sf_dir)[1]).select("custom_id", F.md5("content").alias("content_md5"))


@query(
    "map_results_to_requests",
    "SELECT conv_id * 10 + turn AS request_index, CASE WHEN turn % 4 <> 3 THEN md5(text) END AS content_md5 FROM conversations",
)
def map_results_to_requests(spark, sf_dir):
    requests = scan(spark, sf_dir, "conversations", spread=False).select((F.col("conv_id") * 10 + F.col("turn")).alias("request_index"))
    done = Rs.map_results_to_requests(requests, Rs.unwrap_first(_lines(spark, sf_dir)[0]))
    return done.select("request_index", F.md5("content").alias("content_md5"))


# -- normalisation ----------------------------------------------------------------------------------------------


def _raw_lines(spark, sf_dir):
    m = messages(spark, sf_dir)
    shape = F.col("msg_id") % 4
    attachments = F.when(shape == 0, F.to_json("attachments")).when(shape == 1, '"single.pdf"').when(shape == 2, "null").otherwise('["a.txt", {"name": "b.pdf", "size": "2048"}]')
    text = F.concat(
        F.lit('{"channel": '), F.to_json(F.array("channel")).substr(F.lit(2), F.length(F.to_json(F.array("channel"))) - 2),
        F.lit(', "user": '), F.when(shape == 3, '"none"').otherwise(F.to_json("user")),
        F.lit(', "recipients": '), F.to_json("recipients"), F.lit(', "subject": "s", "body": "b", "attachments": '), attachments,
        F.lit(', "links": {"home": "https://example.org"}}'),
    )
    line = F.when(F.col("msg_id") % 10 == 0, "[1, 2]").when(F.col("msg_id") % 10 == 1, "{oops").when(F.col("msg_id") % 10 == 2, "  ").otherwise(text)
    return m.select("msg_id", line.alias("line"))


@query(
    "normalize_records",
    with_messages(
        "SELECT msg_id, channel, msg_id % 4 <> 3 AS has_user, len(recipients) AS n_recipients, CASE msg_id % 4 WHEN 0 THEN len(attachments) WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS n_attachments, 1 AS n_links FROM msg WHERE msg_id % 10 > 2"
    ),
)
def normalize_records(spark, sf_dir):
    done = C.normalize_records(_raw_lines(spark, sf_dir))
    return done.select(
        "msg_id", "channel", (F.size("user") > 0).alias("has_user"), F.size("recipients").alias("n_recipients"),
        F.size("attachments").alias("n_attachments"), F.size("links").alias("n_links"),
    )


@query(
    "conversion_report",
    "SELECT count(*) FILTER (doc_id % 10 <> 2) AS total_processed, count(*) FILTER (doc_id % 10 < 2) AS non_dict, 0 AS empty_content, count(*) FILTER (doc_id % 10 > 2) AS converted, "
    "round(count(*) FILTER (doc_id % 10 > 2) / count(*) FILTER (doc_id % 10 <> 2) * 100, 6) AS success_rate FROM documents",
)
def conversion_report(spark, sf_dir):
    done = C.conversion_report(_raw_lines(spark, sf_dir))
    return done.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "normalize_attachments",
    with_messages(
        "SELECT msg_id, CASE msg_id % 4 WHEN 0 THEN coalesce(array_to_string(list_transform(attachments, lambda a: a.name || ':' || a.size || ':' || a.mime), ','), '') WHEN 1 THEN 'single.pdf:0:application/pdf' WHEN 2 THEN '' "
        "ELSE 'a.txt:0:text/plain,b.pdf:2048:application/pdf' END AS files FROM msg WHERE msg_id % 10 > 2"
    ),
)
def normalize_attachments(spark, sf_dir):
    raw = _raw_lines(spark, sf_dir).withColumn("attachments", F.try_variant_get(F.try_parse_json("line"), "$.attachments", "variant"))
    done = C.normalize_attachments(raw.filter("msg_id % 10 > 2"))
    return done.select("msg_id", F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["name"], a["size"].cast("string"), a["mime"])), ",").alias("files"))


@query(
    "unify_keys",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k=' || CAST(json_extract(props, '$.k') AS VARCHAR) || ';t=' || event_type ELSE 'k=' || CAST(json_extract(props, '$.k') AS VARCHAR) || ';t=' END AS pairs FROM events",
)
def unify_keys(spark, sf_dir):
    e = scan(spark, sf_dir, "events", spread=False)
    k = F.get_json_object("props", "$.k")
    maps = e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), k, F.lit("t"), F.col("event_type"))).otherwise(F.create_map(F.lit("k"), k)).alias("m"))
    done = C.unify_keys(maps, "m")
    return done.select("event_id", F.array_join(F.transform(F.map_entries("m"), lambda p: F.concat_ws("=", p["key"], p["value"])), ";").alias("pairs"))


@query(
    "long_keys",
    "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, (SELECT count(*) FROM events) AS n FROM events "
    "UNION ALL SELECT event_id, 'user_' || user_id, event_type, count(*) OVER (PARTITION BY user_id) FROM events",
)
def long_keys(spark, sf_dir):
    """Ids as keys: as many keys as users."""
    e = scan(spark, sf_dir, "events", spread=False)
    maps = e.select("event_id", F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.concat(F.lit("user_"), "user_id"), F.col("event_type")).alias("m"))
    return C.long_keys(maps, "m", ["event_id"])


@query(
    "write_jsonl",
    with_messages("SELECT msg_id, true AS same FROM msg"),
)
def write_jsonl(spark, sf_dir):
    """The JSON text of every message, read back, equals the message."""
    m = messages(spark, sf_dir).drop("meta")
    lines = m.select("msg_id", "subject", "recipients", F.to_json(F.struct("channel", "user", "recipients", "thread", "subject", "body", "attachments", "links")).alias("value"))
    back = F.from_json("value", "subject string, recipients array<string>")
    return lines.select("msg_id", ((back["subject"] == F.col("subject")) & (back["recipients"] == F.col("recipients"))).alias("same"))


@query(
    "split_metadata",
    with_messages(
        "SELECT m.split, m.total_examples, m.provider, m.model, m.batch_count, a.v AS agent_distribution FROM (SELECT split, count(*) AS total_examples, arg_min(provider, msg_id) AS provider, arg_min(model, msg_id) AS model, "
        "count(DISTINCT msg_id // 100) AS batch_count FROM msg GROUP BY split) m JOIN (SELECT split, string_agg(k || '=' || n, ',' ORDER BY k) AS v FROM (SELECT split, coalesce(agent, 'unknown') AS k, count(*) AS n FROM msg GROUP BY 1, 2) GROUP BY split) a USING (split)"
    ),
)
def split_metadata(spark, sf_dir):
    m = messages(spark, sf_dir, spread=False).withColumn("batch_id", F.floor(F.col("msg_id") / 100))
    done = sinks.split_metadata(m)
    pairs = F.transform(F.array_sort(F.map_entries("agent_distribution")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return done.withColumn("agent_distribution", F.array_join(pairs, ","))


# -- batch forms of the streams ---------------------------------------------------------------------------------


@query(
    "throughput",
    "SELECT epoch_us(date_trunc('hour', ts)) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'view') AS active, count(*) FILTER (event_type = 'purchase') AS completed FROM events GROUP BY 1",
)
def throughput(spark, sf_dir):
    log = batch_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream_throughput(log).withColumn("window_start", F.unix_micros("window_start"))


@query(
    "dedup_results",
    "SELECT user_id AS batch_id, event_type AS status, min(event_id) AS event_id FROM events GROUP BY user_id, event_type",
)
def dedup_results(spark, sf_dir):
    e = scan(spark, sf_dir, "events", spread=False)
    return e.groupBy(F.col("user_id").alias("batch_id"), F.col("event_type").alias("status")).agg(F.min("event_id").alias("event_id"))
