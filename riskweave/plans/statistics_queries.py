"""Statistics, label comparison and batch logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.fixed import labels as fixed
from riskweave.functions.spans import luhn_valid
from riskweave.operators import batches as Bt
from riskweave.operators import labeling as B
from riskweave.operators import statistics as S
from riskweave.plans.label_queries import (
    CONTEXTUAL_SQL,
    LABELLED_CTES,
    MEAN_SQL,
    PATTERN_SQL,
    dbl,
    round_sql,
    rounded,
)
from riskweave.plans.message_view import (
    messages,
    scan,
    sql_contains_any,
    sql_count_contained,
    sql_lookup,
    sql_text,
    with_messages,
)
from riskweave.plans.registry import query
from riskweave.plans.sql_spans import sql_luhn

HEADS = fixed.HEADS


def round_all(df, names, digits: int = 6):
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


@query(
    "processing_stats",
    with_messages(
        "SELECT channel, count(*) AS processed, CAST(sum(len(spans)) AS BIGINT) AS total_spans, "
        + ", ".join(f"CAST(sum({h}) AS BIGINT) AS {h}_positive" for h in HEADS)
        + " FROM labelled GROUP BY channel",
        *LABELLED_CTES,
    ),
)
def processing_stats(spark, sf_dir):
    return S.processing_stats(B.label_spans(messages(spark, sf_dir)))


@query(
    "processing_spans_by_type",
    with_messages("SELECT channel, s.type AS span_type, count(*) AS n FROM (SELECT channel, unnest(spans) AS s FROM labelled) GROUP BY ALL", *LABELLED_CTES),
)
def processing_spans_by_type(spark, sf_dir):
    return S.spans_by_type(B.label_spans(messages(spark, sf_dir)))


def _map_sql(rows: str) -> str:
    return f"(SELECT split, string_agg(k || '=' || n, ',' ORDER BY k) AS v FROM (SELECT split, k, count(*) AS n FROM ({rows}) GROUP BY split, k) GROUP BY split)"


@query(
    "split_statistics",
    with_messages(
        f"""
SELECT b.*, t.v AS span_distribution, a.v AS agent_distribution, c.v AS channel_distribution FROM (
  SELECT l.split, count(*) AS total_examples, {round_sql('avg(len(m.body))', 'avg_body_length', 4)}, count(*) FILTER (m.prior_msgs > 0) AS multi_turn,
    count(*) FILTER (m.prior_msgs = 0) AS single_turn, {', '.join(f'CAST(sum(l.{h}) AS BIGINT) AS {h}' for h in HEADS)}
  FROM labelled l JOIN msg m USING (msg_id) GROUP BY l.split) b
JOIN {_map_sql('SELECT split, unnest(list_transform(spans, lambda s: s.type)) AS k FROM labelled')} t USING (split)
JOIN {_map_sql("SELECT split, coalesce(agent, 'unknown') AS k FROM msg")} a USING (split)
JOIN {_map_sql('SELECT split, channel AS k FROM msg')} c USING (split)
""",
        *LABELLED_CTES,
    ),
)
def split_statistics(spark, sf_dir):
    done = S.split_statistics(B.label_spans(messages(spark, sf_dir)))
    as_text = lambda c: F.array_join(
        F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )
    maps = ("span_distribution", "agent_distribution", "channel_distribution")
    return round_all(done.withColumns({c: as_text(c) for c in maps}), ["avg_body_length"], 4)


# -- label statistics -------------------------------------------------------------------------------------------


def pattern_values(spark, sf_dir, keys=("msg_id", "split")):
    labelled = B.label_pattern(messages(spark, sf_dir))
    return S.long_labels(labelled, "labels", keys).withColumn("value", F.round("value", 6))


def _long_sql(cte: str, name: str) -> str:
    rows = " UNION ALL ".join(f"SELECT msg_id, split, {sql_text(h)} AS head, round({h}, 6) AS value FROM {cte}" for h in HEADS)
    return f"{name} AS ({rows})"


_STATS = (
    "count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, "
    "count(DISTINCT value) AS unique_values, round(max(value) - min(value), 6) AS value_range"
)
_STAT_NAMES = ["mean", "std", "min", "max", "value_range"]


@query("label_stats", with_messages(f"SELECT split, head, {_STATS} FROM long GROUP BY split, head", PATTERN_SQL, _long_sql("pattern", "long")))
def label_stats(spark, sf_dir):
    return round_all(S.label_stats(pattern_values(spark, sf_dir), ["split"]), _STAT_NAMES)


@query(
    "truth_label_stats",
    "SELECT head, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(DISTINCT value) AS unique_values "
    "FROM (SELECT 'quality' AS head, quality AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY head",
)
def truth_label_stats(spark, sf_dir):
    values = scan(spark, sf_dir, "labels", spread=False).unpivot(["doc_id"], ["quality", "toxic"], "head", "value")
    return round_all(S.label_stats(values), ["mean", "std"]).select("head", "n", "mean", "std", "unique_values")


@query(
    "label_quality_flags",
    with_messages(
        f"SELECT split, head, CASE WHEN value_range < 1e-6 THEN 'identical' WHEN value_range < 0.1 THEN 'limited' END AS range_flag, "
        f"CASE WHEN unique_values <= 2 THEN 'binary' WHEN unique_values > 20 THEN 'many' END AS value_flag FROM (SELECT split, head, {_STATS} FROM long GROUP BY split, head)",
        PATTERN_SQL,
        _long_sql("pattern", "long"),
    ),
)
def label_quality_flags(spark, sf_dir):
    return S.label_quality_flags(S.label_stats(pattern_values(spark, sf_dir), ["split"]))


@query(
    "label_coverage",
    "SELECT total, labelled, total - labelled AS unlabelled, round((total - labelled) * 100.0 / total, 6) AS unlabelled_percent, "
    "'context,obfuscation' AS missing_heads, 'toxicity' AS extra_heads, non_numeric FROM (SELECT count(*) AS total, count(l.doc_id) AS labelled, "
    "count(*) FILTER (l.doc_id % 7 = 0) AS non_numeric FROM documents d LEFT JOIN labels l USING (doc_id))",
)
def label_coverage(spark, sf_dir):
    documents = scan(spark, sf_dir, "documents", spread=False).select("doc_id")
    truth = scan(spark, sf_dir, "labels", spread=False)
    labelled = documents.join(truth, "doc_id", "left").withColumn(
        "label_map",
        F.when(
            F.col("quality").isNotNull(),
            F.create_map(
                F.lit("sensitivity"), F.col("quality").cast("string"), F.lit("exposure"), F.col("toxic").cast("string"),
                F.lit("toxicity"), F.when(F.col("doc_id") % 7 == 0, "n/a").otherwise("1"),
            ),
        ),
    )
    done = round_all(S.label_coverage(labelled, "label_map"), ["unlabelled_percent"])
    return done.withColumns({c: F.array_join(c, ",") for c in ("missing_heads", "extra_heads")}).drop("n_extra_heads")


@query(
    "compare_splits",
    with_messages(
        f"SELECT head, round(max(mean) - min(mean), 5) AS mean_difference, round(max(std) - min(std), 5) AS std_difference, max(mean) - min(mean) > 0.2 AS large_mean_difference, "
        f"max(std) - min(std) > 0.1 AS large_std_difference FROM (SELECT split, head, {_STATS} FROM long GROUP BY split, head) GROUP BY head",
        PATTERN_SQL,
        _long_sql("pattern", "long"),
    ),
)
def compare_splits(spark, sf_dir):
    stats = round_all(S.label_stats(pattern_values(spark, sf_dir), ["split"]), ["mean", "std"])
    return round_all(S.compare_splits(stats), ["mean_difference", "std_difference"], 5)


@query(
    "risk_indicators",
    with_messages(
        f"SELECT msg_id, len(list_filter(recipients, lambda r: {sql_contains_any('r', fixed.RISK_RECIPIENT_MARKERS)})) + len(list_filter(attachments, lambda a: a.size > 1000000)) "
        f"+ {sql_count_contained('lower(body)', fixed.RISK_KEYWORDS)} AS risk_indicators FROM msg"
    ),
)
def risk_indicators(spark, sf_dir):
    return S.risk_indicators(messages(spark, sf_dir)).select("msg_id", "risk_indicators")


@query(
    "discrimination",
    with_messages(
        "SELECT round(r, 6) AS overall_range, round(s, 6) AS overall_std, CASE WHEN r > 0.5 AND s > 0.15 THEN 'EXCELLENT' WHEN r > 0.3 AND s > 0.1 THEN 'GOOD' "
        "WHEN r > 0.1 THEN 'MODERATE' ELSE 'LIMITED' END AS verdict FROM (SELECT max(value) - min(value) AS r, stddev_pop(value) AS s FROM long)",
        PATTERN_SQL,
        _long_sql("pattern", "long"),
    ),
)
def discrimination(spark, sf_dir):
    return round_all(S.discrimination(pattern_values(spark, sf_dir)), ["overall_range", "overall_std"])


# -- two labelers -----------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    """Both label sets come from one pass over the texts, so no join is needed to align them."""
    both = B.label_contextual(B.label_pattern(messages(spark, sf_dir)), overwrite=False).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(h).alias("head"),
                        F.round(f"labels.{h}", 6).alias("rule_value"),
                        F.round(f"contextual_labels.{h}", 6).alias("other_value"),
                    )
                    for h in HEADS
                ]
            )
        ).alias("p")
    )
    return both.select("p.*")


_PAIRS_SQL = "pairs AS (SELECT a.msg_id, a.head, a.value AS a, b.value AS b FROM long a JOIN other b USING (msg_id, head))"
_PAIR_CTES = [PATTERN_SQL, CONTEXTUAL_SQL, _long_sql("pattern", "long"), _long_sql("contextual", "other"), _PAIRS_SQL]
_COMPARED = """
SELECT head, count(*) AS n, CASE WHEN max(a) > min(a) AND max(b) > min(b) THEN corr(a, b) ELSE 0 END AS correlation, avg(b) - avg(a) AS mean_difference,
  stddev_pop(b) - stddev_pop(a) AS std_difference, (max(b) - min(b)) - (max(a) - min(a)) AS range_difference,
  max(a) - min(a) AS rule_range, max(b) - min(b) AS other_range FROM pairs GROUP BY head
"""
_COMPARED_NAMES = ["correlation", "mean_difference", "std_difference", "range_difference"]


@query(
    "compare_labelers",
    with_messages("SELECT head, n, " + ", ".join(round_sql(c, c) for c in _COMPARED_NAMES) + f" FROM ({_COMPARED})", *_PAIR_CTES),
)
def compare_labelers(spark, sf_dir):
    return round_all(S.compare_labelers(_pairs(spark, sf_dir)), _COMPARED_NAMES).select("head", "n", *_COMPARED_NAMES)


@query(
    "comparison_verdict",
    with_messages(
        "SELECT round(avg(correlation), 6) AS avg_correlation, round(avg(rule_range), 6) AS avg_rule_range, round(avg(other_range), 6) AS avg_other_range, "
        "CASE WHEN avg(correlation) < 0.3 THEN 'LOW' WHEN avg(correlation) < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS verdict, avg(other_range) > avg(rule_range) AS other_is_wider "
        f"FROM ({_COMPARED})",
        *_PAIR_CTES,
    ),
)
def comparison_verdict(spark, sf_dir):
    done = S.comparison_verdict(S.compare_labelers(_pairs(spark, sf_dir)))
    return round_all(done, ["avg_correlation", "avg_rule_range", "avg_other_range"])


@query("labeling_differences", with_messages("SELECT head, round(avg(abs(a - b)), 6) AS mean_abs_difference FROM pairs GROUP BY head", *_PAIR_CTES))
def labeling_differences(spark, sf_dir):
    return round_all(S.labeling_differences(_pairs(spark, sf_dir)), ["mean_abs_difference"])


@query(
    "disagreements",
    with_messages(
        f"""
SELECT msg_id, round(abs(p - c), 6) AS risk_difference, array_to_string(
  (CASE WHEN {sql_contains_any('content', ['board', 'meeting', 'review', 'preparation'])} THEN ['Business context present'] ELSE [] END) ||
  (CASE WHEN role IN ('CFO', 'CEO', 'DIRECTOR') AND len(list_filter(recipients, lambda r: contains(r, '@company.com'))) > 0 THEN ['Senior role + internal recipients']
    WHEN role IN ('INTERN', 'TEMP') AND len(list_filter(recipients, lambda r: contains(r, '@gmail') OR contains(r, '@yahoo'))) > 0 THEN ['Junior role + external recipients'] ELSE [] END) ||
  (CASE WHEN {sql_contains_any('content', ['urgent', 'immediately', 'secret', 'confidential'])} THEN ['Pressure/confidentiality language'] ELSE [] END), ';') AS factors
FROM (SELECT m.msg_id, m.role, m.recipients, lower(m.subject || ' ' || m.body) AS content, x.r AS p, y.r AS c FROM msg m
  JOIN (SELECT msg_id, {MEAN_SQL} AS r FROM pattern) x USING (msg_id) JOIN (SELECT msg_id, {MEAN_SQL} AS r FROM contextual) y USING (msg_id))
WHERE abs(p - c) > 0.2
""",
        PATTERN_SQL,
        CONTEXTUAL_SQL,
    ),
)
def disagreements(spark, sf_dir):
    both = B.label_contextual(B.label_pattern(messages(spark, sf_dir)), out="other_labels", overwrite=False)
    found = S.disagreements(both)
    return found.select("msg_id", rounded(F.col("risk_difference")).alias("risk_difference"), F.array_join("factors", ";").alias("factors"))


@query(
    "top_disagreements",
    with_messages(
        f"SELECT msg_id, round(d, 6) AS risk_difference FROM (SELECT msg_id, abs(x.r - y.r) AS d FROM (SELECT msg_id, {MEAN_SQL} AS r FROM pattern) x "
        f"JOIN (SELECT msg_id, {MEAN_SQL} AS r FROM contextual) y USING (msg_id)) WHERE d > 0.2 ORDER BY round(d, 9) DESC, msg_id LIMIT 5",
        PATTERN_SQL,
        CONTEXTUAL_SQL,
    ),
)
def top_disagreements(spark, sf_dir):
    both = B.label_contextual(B.label_pattern(messages(spark, sf_dir)), out="other_labels", overwrite=False)
    return S.top_disagreements(S.disagreements(both)).select("msg_id", rounded(F.col("risk_difference")).alias("risk_difference"))


@query(
    "paired_discrimination",
    with_messages(
        f"SELECT msg_id // 2 AS pair_id, round(abs(max(x) FILTER (msg_id % 2 = 1) - max(x) FILTER (msg_id % 2 = 0)), 6) AS labels_difference, "
        f"round(abs(max(y) FILTER (msg_id % 2 = 1) - max(y) FILTER (msg_id % 2 = 0)), 6) AS contextual_labels_difference "
        f"FROM (SELECT msg_id, {MEAN_SQL} AS x FROM pattern) JOIN (SELECT msg_id, {MEAN_SQL} AS y FROM contextual) USING (msg_id) GROUP BY 1",
        PATTERN_SQL,
        CONTEXTUAL_SQL,
    ),
)
def paired_discrimination(spark, sf_dir):
    both = B.label_contextual(B.label_pattern(messages(spark, sf_dir)), overwrite=False).withColumns(
        {"pair_id": F.floor(F.col("msg_id") / 2), "appropriate": F.col("msg_id") % 2 == 0}
    )
    done = S.paired_discrimination(both, "pair_id", "appropriate", ["labels", "contextual_labels"])
    return round_all(done, ["labels_difference", "contextual_labels_difference"])


# -- shares -----------------------------------------------------------------------------------------------------


@query("agent_distribution", with_messages("SELECT coalesce(agent, 'unknown') AS agent, count(*) AS n FROM msg GROUP BY 1"))
def agent_distribution(spark, sf_dir):
    return S.agent_distribution(messages(spark, sf_dir, spread=False))


@query("model_usage", with_messages("SELECT provider, model, split, count(*) AS n FROM msg GROUP BY ROLLUP (provider, model, split)"))
def model_usage(spark, sf_dir):
    return S.model_usage(messages(spark, sf_dir, spread=False))


@query(
    "label_balance",
    with_messages(
        " UNION ALL ".join(f"SELECT {sql_text(h)} AS head, round(avg({h}), 6) AS share, avg({h}) BETWEEN 0.45 AND 0.55 AS balanced FROM labelled" for h in HEADS),
        *LABELLED_CTES,
    ),
)
def label_balance(spark, sf_dir):
    return round_all(S.label_balance(B.label_spans(messages(spark, sf_dir))), ["share"])


_PAN_LIKE = r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"


@query(
    "pan_balance",
    with_messages(
        f"SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid, round(count(*) FILTER (ok) / nullif(count(*) FILTER (NOT ok), 0), 6) AS ratio FROM ("
        f"SELECT {sql_luhn('d')} AS ok FROM (SELECT regexp_replace(t, '[^0-9]', '', 'g') AS d FROM (SELECT unnest(regexp_extract_all(body, {sql_text(_PAN_LIKE)})) AS t FROM msg)))"
    ),
)
def pan_balance(spark, sf_dir):
    candidates = F.regexp_extract_all("body", F.lit(_PAN_LIKE), F.lit(0))
    return round_all(S.pan_balance(messages(spark, sf_dir), candidates, luhn_valid("t")), ["ratio"])


@query(
    "pipeline_funnel",
    with_messages(
        """
SELECT split, round(conversion_rate, 6) AS conversion_rate, round(quality_pass_rate, 6) AS quality_pass_rate, round(augmentation_ratio, 6) AS augmentation_ratio
FROM (SELECT * FROM rates UNION ALL SELECT 'mean', avg(conversion_rate), avg(quality_pass_rate), avg(augmentation_ratio) FROM rates)
""",
        "rates AS (SELECT split, converted / augmented AS conversion_rate, passed / converted AS quality_pass_rate, augmented / generated AS augmentation_ratio FROM ("
        "SELECT split, count(*) AS generated, count(*) + sum(msg_id % 4) AS augmented, count(*) FILTER (len(body) > 300) AS converted, "
        "count(*) FILTER (len(body) BETWEEN 301 AND 2000 AND len(recipients) > 0) AS passed FROM msg GROUP BY split))",
    ),
)
def pipeline_funnel(spark, sf_dir):
    converted = F.length("body") > 300
    stages = messages(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("generated"),
        (F.count(F.lit(1)) + F.sum(F.col("msg_id") % 4)).alias("augmented"),
        F.count_if(converted).alias("converted"),
        F.count_if(converted & (F.length("body") <= 2000) & (F.size("recipients") > 0)).alias("passed"),
    )
    names = ["conversion_rate", "quality_pass_rate", "augmentation_ratio"]
    return round_all(S.pipeline_funnel(stages), names)


@query("indicator_set", with_messages("SELECT indicator, count(*) AS n FROM (SELECT unnest(flatten(list_transform(attachments, lambda a: a.sensitivity_indicators))) AS indicator FROM msg) GROUP BY 1"))
def indicator_set(spark, sf_dir):
    return S.indicator_set(messages(spark, sf_dir, spread=False))


# -- batch logs -------------------------------------------------------------------------------------------------

BATCH_STATUS = {"signup": "created", "view": "in_progress", "click": "validating", "purchase": "completed", "error": "failed"}
_SESSION_STATUS = {"signup": "active", "view": "active", "click": "interrupted", "purchase": "completed", "error": "failed"}
NOW = "2024-02-01 00:00:00"


def batch_log(spark, sf_dir):
    e = scan(spark, sf_dir, "events", spread=False)
    return e.select(
        "event_id", "ts", F.col("user_id").alias("batch_id"), (F.col("user_id") % 10).alias("session_id"),
        F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("user_id") % 3 + 1).cast("int")).alias("split"),
        F.concat(F.lit("model-"), (F.col("user_id") % 6).cast("string")).alias("model"),
        F.element_at(F.create_map(*[F.lit(x) for kv in BATCH_STATUS.items() for x in kv]), F.col("event_type")).alias("status"),
        F.get_json_object("props", "$.k").cast("int").alias("request_count"),
    )


LOG_SQL = f"""
log AS (SELECT event_id, ts, user_id AS batch_id, user_id % 10 AS session_id, (['train', 'val', 'test'])[user_id % 3 + 1] AS split, 'model-' || (user_id % 6) AS model,
  {sql_lookup('event_type', BATCH_STATUS, 'NULL')} AS status, CAST(json_extract(props, '$.k') AS INT) AS request_count FROM events),
batch AS (SELECT batch_id, any_value(session_id) AS session_id, any_value(split) AS split, any_value(model) AS model, arg_max(status, (ts, event_id)) AS status,
  arg_max(request_count, (ts, event_id)) AS request_count, min(ts) AS created_at, max(ts) AS updated_at FROM log GROUP BY batch_id)
"""


@query(
    "batch_stats",
    f"""WITH {LOG_SQL.strip()}
SELECT session_id, split, model, count(*) AS total_batches, count(*) FILTER (active) AS active, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(request_count) FILTER (active), 0) AS BIGINT) AS pending_requests,
  coalesce(max(age) FILTER (active), 0) AS oldest_active_age, round(count(*) FILTER (status = 'completed') / count(*), 3) AS success_rate,
  round(1 - count(*) FILTER (status = 'completed') / count(*), 3) AS failure_rate
FROM (SELECT *, status NOT IN ('completed', 'failed') AS active, CAST(floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(created_at)) AS BIGINT) AS age FROM batch)
GROUP BY session_id, split, model""",
)
def batch_stats(spark, sf_dir):
    return Bt.batch_stats(Bt.latest_batches(batch_log(spark, sf_dir)), F.lit(NOW).cast("timestamp"))


@query(
    "batch_state",
    f"""WITH {LOG_SQL.strip()}
SELECT batch_id, status, age AS age_seconds, CASE WHEN status IN ('completed', 'failed') THEN status WHEN age > 86400 THEN 'expired' WHEN age > 3600 THEN 'stuck' ELSE status END AS state
FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:30:00')) - floor(epoch(created_at)) AS BIGINT) AS age,
  CAST(floor(epoch(TIMESTAMP '2024-01-31 00:30:00')) - floor(epoch(updated_at)) AS BIGINT) AS idle FROM batch)""",
)
def batch_state(spark, sf_dir):
    now = F.lit("2024-01-31 00:30:00").cast("timestamp")
    return Bt.batch_state(Bt.latest_batches(batch_log(spark, sf_dir)), now).select("batch_id", "status", "age_seconds", "state")


@query(
    "session_stats",
    f"""SELECT count(*) AS total, count(*) FILTER (s = 'active') AS active, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed,
  count(*) FILTER (s = 'interrupted') AS interrupted, epoch_us(min(started)) AS oldest, epoch_us(max(started)) AS newest
FROM (SELECT user_id % 50 AS session_id, {sql_lookup('arg_max(event_type, (ts, event_id))', _SESSION_STATUS, 'NULL')} AS s, min(ts) AS started FROM events GROUP BY 1)""",
)
def session_stats(spark, sf_dir):
    e = scan(spark, sf_dir, "events", spread=False)
    latest = F.max_by("event_type", F.struct("ts", "event_id"))
    status = F.element_at(F.create_map(*[F.lit(x) for kv in _SESSION_STATUS.items() for x in kv]), latest)
    sessions = e.groupBy((F.col("user_id") % 50).alias("session_id")).agg(status.alias("status"), F.min("ts").alias("start_time"))
    done = Bt.session_stats(sessions)
    return done.withColumns({"oldest": F.unix_micros(F.col("oldest").cast("timestamp")), "newest": F.unix_micros(F.col("newest").cast("timestamp"))})


@query(
    "labeling_cost",
    with_messages(
        f"""SELECT model, count(*) AS total_requests, count(*) FILTER (ok) AS successful, round(sum(cost), 6) AS total_cost, round(avg(cost), 8) AS mean_cost,
  round(count(*) FILTER (ok) / count(*) * 100, 6) AS success_rate, round(count(*) * {sql_lookup('model', fixed.EXPECTED_COST, dbl(fixed.DEFAULT_EXPECTED_COST))}, 6) AS expected_cost
FROM (SELECT model, ok, (p * {sql_lookup('model', {m: v[0] for m, v in fixed.MODEL_PRICES.items()}, dbl(0.001))} + c * {sql_lookup('model', {m: v[1] for m, v in fixed.MODEL_PRICES.items()}, dbl(0.001))}) / 1000 AS cost
  FROM (SELECT model, msg_id % 3 <> 0 AS ok, CAST(len(body) // 4 AS DOUBLE) AS p, CAST(100 + msg_id % 50 AS DOUBLE) AS c FROM msg)) GROUP BY model"""
    ),
)
def labeling_cost(spark, sf_dir):
    requests = messages(spark, sf_dir).select(
        "model", (F.col("msg_id") % 3 != 0).alias("success"), F.floor(F.length("body") / 4).alias("prompt_tokens"),
        (F.col("msg_id") % 50 + 100).alias("completion_tokens"),
    )
    done = round_all(Bt.labeling_cost(requests), ["total_cost", "success_rate", "expected_cost"])
    return round_all(done, ["mean_cost"], 8)


