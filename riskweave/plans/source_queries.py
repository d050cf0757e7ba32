"""Readers and writers over whole tables: each query writes files below the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import results as Rs
from riskweave.operators import statistics as S
from riskweave.operators.labeling import score_with
from riskweave.plans.generation_queries import _whole_grid
from riskweave.plans.message_view import messages, scan, with_messages
from riskweave.plans.registry import query
from riskweave.plans.statistics_queries import BATCH_STATUS
from riskweave.session import scratch_folder
from riskweave.sources import files, sinks

_KEYS = ("msg_id", "channel", "user", "recipients", "thread", "subject", "body", "attachments", "links")
_MESSAGE_SQL = "SELECT msg_id, channel, role, len(recipients) AS n_recipients, len(attachments) AS n_attachments, md5(subject) AS subject_md5, md5(body) AS body_md5"


def _shown(m):
    return [
        "msg_id", "channel", F.col("user.role").alias("role"), F.size("recipients").alias("n_recipients"),
        F.size("attachments").alias("n_attachments"), F.md5("subject").alias("subject_md5"), F.md5("body").alias("body_md5"),
    ]


def _lines(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", "split", F.to_json(F.struct(*_KEYS)).alias("value"))


@query("read_messages", with_messages(f"{_MESSAGE_SQL} FROM msg WHERE msg_id % 10 <> 9"))
def read_messages(spark, sf_dir):
    """Every tenth line is broken."""
    folder = scratch_folder(spark, "read-messages")
    _lines(spark, sf_dir).select(F.when(F.col("msg_id") % 10 == 9, F.concat(F.lit("{"), "value")).otherwise(F.col("value"))).write.text(folder)
    return files.read_messages(spark, folder).select(*_shown("m"))


@query(
    "read_report",
    with_messages("SELECT count(*) FILTER (msg_id % 10 <> 9) AS read, count(*) FILTER (msg_id % 10 = 9) AS skipped FROM msg"),
)
def read_report(spark, sf_dir):
    folder = scratch_folder(spark, "read-report")
    broken = F.concat(F.lit("["), "value", F.lit("]"))
    _lines(spark, sf_dir).select(F.when(F.col("msg_id") % 10 == 9, broken).otherwise(F.col("value"))).write.text(folder)
    return files.read_report(files.read_messages(spark, folder, keep_bad=True))


@query("read_split_dir", with_messages(f"{_MESSAGE_SQL}, split FROM msg"))
def read_split_dir(spark, sf_dir):
    folder = scratch_folder(spark, "read-split-dir")
    _lines(spark, sf_dir).select("value", F.concat("split", F.lit("_examples")).alias("part")).write.partitionBy("part").text(folder)
    return files.read_split_dir(spark, f"{folder}/*", "part-*").select(*_shown("m"), "split")


@query("write_split_files", with_messages(f"{_MESSAGE_SQL}, split FROM msg"))
def write_split_files(spark, sf_dir):
    folder = scratch_folder(spark, "write-split-files")
    sinks.write_split_files(messages(spark, sf_dir).withColumn("_hidden", F.lit(1)), folder)
    schema = "msg_id bigint, channel string, user struct<role:string>, recipients array<string>, attachments array<struct<name:string>>, subject string, body string, split string"
    return spark.read.schema(schema).json(f"{folder}/examples").select(*_shown("m"), "split")


@query(
    "write_split_metadata",
    with_messages(
        "SELECT split, count(*) AS total_examples, arg_min(provider, msg_id) AS provider, arg_min(model, msg_id) AS model, "
        "count(DISTINCT msg_id // 100) AS batch_count, count(agent) + count(*) FILTER (agent IS NULL) AS agents FROM msg GROUP BY split"
    ),
)
def write_split_metadata(spark, sf_dir):
    folder = scratch_folder(spark, "write-split-metadata")
    sinks.write_split_files(messages(spark, sf_dir).withColumn("batch_id", F.floor(F.col("msg_id") / 100)), folder)
    rows = spark.read.schema(
        "split string, total_examples bigint, provider string, model string, batch_count bigint, agent_distribution map<string,bigint>"
    ).json(f"{folder}/metadata")
    agents = F.aggregate(F.map_values("agent_distribution"), F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.select("split", "total_examples", "provider", "model", "batch_count", agents.alias("agents"))


@query("jsonl_round_trip", with_messages(f"{_MESSAGE_SQL} FROM msg"))
def jsonl_round_trip(spark, sf_dir):
    folder = scratch_folder(spark, "jsonl")
    # the writer gives the message's own keys; its number is found again by the thread, subject and body
    m = messages(spark, sf_dir).drop("meta").withColumn("meta", F.create_map(F.lit("id"), F.col("msg_id").cast("string")))
    sinks.write_jsonl(m, folder)
    back = files.read_messages(spark, folder)
    return back.withColumn("msg_id", F.col("meta")["id"].cast("long")).select(*_shown("m"))


# -- responses --------------------------------------------------------------------------------------------------


def _responses(spark, sf_dir):
    """A line per turn: every fourth is broken, every fifth holds no object."""
    c = scan(spark, sf_dir, "conversations", spread=False)
    name = F.concat_ws("-", "conv_id", "turn")
    content = F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(F.to_json(F.struct("role", F.col("text").alias("body"))))
    message = F.struct(F.struct(content.alias("content")).alias("message"))
    line = F.to_json(F.struct(F.concat(F.lit("request-"), name).alias("custom_id"), F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response")))
    return c.select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "{broken").otherwise(line).alias("value"))


@query(
    "read_batch_results",
    """SELECT 'request-' || conv_id || '-' || turn AS custom_id, CASE WHEN conv_id % 3 = 0 THEN 'train' WHEN conv_id % 3 = 1 THEN 'val' ELSE 'test' END AS split,
  line AS line_number, role, md5(text) AS body_md5
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id % 3, conv_id // 100 ORDER BY conv_id, turn) AS line FROM conversations)
WHERE turn % 4 <> 3 AND (turn % 5 <> 4 OR starts_with(ltrim(text), '{'))""",
)
def read_batch_results(spark, sf_dir):
    """One file per hundred conversations and split, as a provider's batches are."""
    folder = scratch_folder(spark, "batch-results")
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("conv_id") % 3 + 1).cast("int"))
    named = _responses(spark, sf_dir).withColumn("batch", F.concat_ws("_", split, F.floor(F.col("conv_id") / 100)))
    named.repartition("batch").sortWithinPartitions("batch", "conv_id", "turn").select("value", "batch").write.partitionBy("batch").text(folder)
    rows = files.read_batch_results(spark, f"{folder}/*")
    get = lambda name: F.try_variant_get("example", f"$.{name}", "string")
    return rows.select("custom_id", "split", "line_number", get("role").alias("role"), F.md5(get("body")).alias("body_md5"))


@query(
    "join_requests",
    """SELECT 'request-' || conv_id || '-' || turn AS custom_id, conv_id, turn, md5(text) AS prompt_md5, role FROM conversations
WHERE turn % 4 <> 3 AND (turn % 5 <> 4 OR starts_with(ltrim(text), '{'))""",
)
def join_requests(spark, sf_dir):
    """Responses beside their requests, by the pair (conversation, turn)."""
    folder = scratch_folder(spark, "join-requests")
    _responses(spark, sf_dir).select("value").write.text(folder)
    c = scan(spark, sf_dir, "conversations", spread=False)
    requests = c.select(F.concat(F.lit("request-"), F.concat_ws("-", "conv_id", "turn")).alias("custom_id"), "conv_id", "turn", F.md5("text").alias("prompt_md5"))
    done = Rs.join_requests(files.read_batch_results(spark, folder, "all"), requests)
    return done.select("custom_id", "conv_id", "turn", "prompt_md5", F.try_variant_get("example", "$.role", "string").alias("role"))


@query(
    "align_by_position",
    with_messages(
        """SELECT head, position, rule_value, other_value FROM (SELECT 'sensitivity' AS head, row_number() OVER (ORDER BY msg_id) AS position, len(recipients) AS rule_value FROM msg)
JOIN (SELECT row_number() OVER (ORDER BY msg_id) AS position, len(attachments) AS other_value FROM msg WHERE msg_id % 3 <> 0) USING (position)"""
    ),
)
def align_by_position(spark, sf_dir):
    """Two lists of unequal length side by side."""
    m = messages(spark, sf_dir, spread=False).withColumn("head", F.lit("sensitivity"))
    left = m.select("msg_id", "head", F.size("recipients").alias("value"))
    right = m.filter("msg_id % 3 <> 0").select("msg_id", "head", F.size("attachments").alias("value"))
    return S.align_by_position(left, right).select("head", "position", "rule_value", "other_value")


@query("score_with", with_messages("SELECT msg_id, least(len(body) / 1000.0, 1.0)::DOUBLE AS sensitivity, (len(recipients) / 4.0)::DOUBLE AS exposure FROM msg"))
def score_with_scorer(spark, sf_dir):
    """A caller's scorer over Arrow batches."""
    import pandas as pd

    def scores(body, n):
        return pd.DataFrame({"sensitivity": (body.str.len() / 1000).clip(upper=1.0), "exposure": n / 4})

    scorer = F.pandas_udf(scores, "struct<sensitivity:double,exposure:double>", F.PandasUDFType.SCALAR)
    return score_with(messages(spark, sf_dir), scorer(F.col("body"), F.size("recipients"))).select("msg_id", "scores.*")


# -- logs and puzzles -------------------------------------------------------------------------------------------


def _documents(df, key, spark, name):
    """One file per key value."""
    folder = scratch_folder(spark, name)
    df.repartition(key).write.partitionBy(key).text(folder)
    return folder


@query(
    "read_sessions",
    "SELECT 's' || (user_id % 50) AS session_id, CAST(min(event_id) AS DOUBLE) AS start_time, arg_max(event_type, event_id) AS status FROM events GROUP BY 1",
)
def read_sessions(spark, sf_dir):
    e = scan(spark, sf_dir, "events", spread=False).withColumn("session_id", F.concat(F.lit("s"), F.col("user_id") % 50))
    one = e.groupBy("session_id").agg(F.min("event_id").cast("double").alias("start_time"), F.max_by("event_type", "event_id").alias("status"))
    folder = _documents(one.select(F.to_json(F.struct("session_id", "start_time", "status")).alias("value"), F.col("session_id").alias("run")), "run", spark, "sessions")
    return files.read_sessions(spark, folder, "part-*").select("session_id", "start_time", "status")


_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BATCH_STATUS.items()) + " END"


@query(
    "read_batch_log",
    f"SELECT 'b' || user_id AS batch_id, arg_max({_STATUS_SQL}, event_id) AS status, CAST(count(*) AS INT) AS request_count FROM events GROUP BY 1",
)
def read_batch_log(spark, sf_dir):
    """A document per session with its active and its completed batches."""
    e = scan(spark, sf_dir, "events", spread=False)
    status = F.create_map(*[F.lit(x) for kv in BATCH_STATUS.items() for x in kv])[F.max_by("event_type", "event_id")]
    batches = e.groupBy("user_id").agg(status.alias("status"), F.count(F.lit(1)).cast("int").alias("request_count"))
    entry = F.struct(F.concat(F.lit("b"), "user_id").alias("key"), F.struct("status", "request_count").alias("value"))
    ended = F.col("status").isin("completed", "failed")
    logs = batches.groupBy((F.col("user_id") % 20).alias("session")).agg(
        F.map_from_entries(F.collect_list(F.when(~ended, entry))).alias("active_batches"),
        F.map_from_entries(F.collect_list(F.when(ended, entry))).alias("completed_batches"),
    )
    folder = _documents(logs.select(F.to_json(F.struct("active_batches", "completed_batches")).alias("value"), "session"), "session", spark, "batch-log")
    return files.read_batch_log(spark, f"{folder}/*", "part-*").select("batch_id", "status", "request_count")


_DIGITS_SQL = "list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * {n}) % 10 AS INT))"


@query(
    "read_puzzle_json",
    f"""SELECT 'p' || vec_id AS puzzle_id, 2 AS n_examples, array_to_string({_DIGITS_SQL.format(n=10)}, '') AS first_input, array_to_string({_DIGITS_SQL.format(n=1000)}, '') AS last_output FROM embeddings""",
)
def read_puzzle_json(spark, sf_dir):
    """A file per puzzle: a training and a test example of 8 x 8 grids."""
    e = scan(spark, sf_dir, "embeddings", spread=False)
    pair = lambda a, b: F.array(F.struct(F.expr(_whole_grid(a)).alias("input"), F.expr(_whole_grid(b)).alias("output")))
    name = F.concat(F.lit("p"), "vec_id")
    text = F.to_json(F.struct(name.alias("name"), pair(1, 2).alias("train"), pair(2, 3).alias("test")))
    folder = _documents(e.select(text.alias("value"), name.alias("puzzle")), "puzzle", spark, "puzzles")
    flat = lambda g: F.array_join(F.flatten(g), "")
    return files.read_puzzle_json(spark, folder, "part-*").select(
        "puzzle_id", F.size("examples").alias("n_examples"), flat(F.col("examples")[0]["input"]).alias("first_input"),
        flat(F.col("examples")[1]["output"]).alias("last_output"),
    )


@query(
    "read_puzzle_csv",
    "SELECT 'v' || vec_id AS source, rating, array_to_string(list_transform(range(81), lambda p: CASE WHEN (p + vec_id) % 3 = 0 THEN (p + vec_id) % 9 + 1 ELSE 0 END), '') AS q, "
    "array_to_string(list_transform(range(81), lambda p: (p + vec_id) % 9 + 1), '') AS a FROM (SELECT vec_id, CAST(vec_id % 7 AS INT) AS rating FROM embeddings) WHERE rating >= 3",
)
def read_puzzle_csv(spark, sf_dir):
    digit = "cast((p + vec_id) % 9 + 1 as string)"
    boards = scan(spark, sf_dir, "embeddings", spread=False).select(
        F.concat(F.lit("v"), "vec_id").alias("source"),
        F.expr(f"array_join(transform(sequence(0, 80), p -> if((p + vec_id) % 3 = 0, {digit}, '.')), '')").alias("q"),
        F.expr(f"array_join(transform(sequence(0, 80), p -> {digit}), '')").alias("a"), (F.col("vec_id") % 7).cast("int").alias("rating"),
    )
    folder = scratch_folder(spark, "boards")
    boards.write.option("header", True).csv(folder)
    done = files.read_puzzle_csv(spark, folder, min_difficulty=3)
    return done.select("source", "rating", F.array_join("q", "").alias("q"), F.array_join("a", "").alias("a"))


def _grid_examples(spark, sf_dir):
    """Puzzles of one to four examples in groups by label; every fifth vector goes to test, odd ones to the second set."""
    e = scan(spark, sf_dir, "embeddings", spread=False)
    return e.select(
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"), F.when(F.col("vec_id") % 2 == 1, "concept").otherwise("all").alias("set"),
        F.col("label").cast("int").alias("group_id"), F.col("vec_id").alias("puzzle_id"), (F.col("vec_id") + 1).alias("identifier"),
        F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int"))).alias("example_no"),
        F.flatten(F.expr(_whole_grid(1))).alias("inputs"), F.flatten(F.expr(_whole_grid(2))).alias("labels"),
    )


_PUZZLE_SQL = """puzzle AS (SELECT CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN vec_id % 2 = 1 THEN 'concept' ELSE 'all' END AS "set",
  CAST(label AS INT) AS group_id, vec_id AS puzzle_id, vec_id + 1 AS identifier, 1 + vec_id % 4 AS n, embedding FROM embeddings)"""


@query(
    "write_grid_dataset",
    f"""WITH {_PUZZLE_SQL}
SELECT split, "set", row_number() OVER w - 1 AS puzzle_no, puzzle_id, identifier, CAST(sum(n) OVER w - n AS BIGINT) AS example_start, CAST(sum(n) OVER w AS BIGINT) AS example_end,
  n AS n_examples, array_to_string({_DIGITS_SQL.format(n=10)}, '') AS inputs
FROM puzzle WINDOW w AS (PARTITION BY split, "set" ORDER BY group_id, puzzle_id ROWS UNBOUNDED PRECEDING)""",
)
def write_grid_dataset(spark, sf_dir):
    folder = scratch_folder(spark, "grid-dataset")
    sinks.write_grid_dataset(_grid_examples(spark, sf_dir), folder)
    examples = spark.read.parquet(f"{folder}/examples").groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n_examples"), F.first("inputs").alias("inputs"))
    puzzles = spark.read.parquet(f"{folder}/puzzles").join(examples, "puzzle_id")
    return puzzles.select("split", "set", "puzzle_no", "puzzle_id", "identifier", "example_start", "example_end", "n_examples", F.array_join("inputs", "").alias("inputs"))


@query(
    "write_grid_groups",
    f"""WITH {_PUZZLE_SQL}, g AS (SELECT split, "set", group_id, count(*) AS n FROM puzzle GROUP BY ALL),
total AS (SELECT split, count(*) AS total_puzzles, CAST(sum(n) AS BIGINT) AS total_examples, round(sum(n) / count(*), 6) AS mean_puzzle_examples FROM puzzle GROUP BY split)
SELECT split, "set", row_number() OVER w - 1 AS group_no, group_id, CAST(sum(n) OVER w - n AS BIGINT) AS puzzle_start, CAST(sum(n) OVER w AS BIGINT) AS puzzle_end, total_puzzles, total_examples, mean_puzzle_examples
FROM g JOIN total USING (split) WINDOW w AS (PARTITION BY split, "set" ORDER BY group_id ROWS UNBOUNDED PRECEDING)""",
)
def write_grid_groups(spark, sf_dir):
    folder = scratch_folder(spark, "grid-groups")
    sinks.write_grid_dataset(_grid_examples(spark, sf_dir), folder)
    meta = spark.read.json(f"{folder}/metadata").select("split", "total_puzzles", "total_examples", F.round("mean_puzzle_examples", 6).alias("mean_puzzle_examples"))
    return spark.read.parquet(f"{folder}/groups").join(meta, "split").select(
        "split", "set", "group_no", "group_id", "puzzle_start", "puzzle_end", "total_puzzles", "total_examples", "mean_puzzle_examples"
    )
