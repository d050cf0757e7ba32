"""Streaming runs over whole tables: files arrive in parts, the job stops and starts again, and its output is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.plans.label_queries import LABELLED_CTES
from riskweave.plans.message_view import messages, scan, sql_lookup, with_messages
from riskweave.plans.registry import query
from riskweave.plans.statistics_queries import BATCH_STATUS
from riskweave.schema import FINAL_BATCH_STATES
from riskweave.session import scratch_folder
from riskweave.streaming import batch_states, jobs

EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def _events(spark, sf_dir):
    """The event table as a stream of its file."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


_FINAL = ", ".join(f"'{s}'" for s in FINAL_BATCH_STATES)
_HOUR, _DAY, _WIDTH = batch_states.HOUR_MS, batch_states.DAY_MS, batch_states.WINDOW_MS


@query(
    "stream_batch_state",
    f"""WITH log AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS batch_id, {sql_lookup('event_type', BATCH_STATUS, 'NULL')} AS status, epoch_us(ts) // 1000 AS ms FROM events),
seen AS (SELECT *, min(ms) OVER (PARTITION BY batch_id) AS created FROM log, (SELECT max(ms) - {_HOUR} AS mark FROM log) WHERE (ms // {_WIDTH} + 1) * {_WIDTH} <= mark),
one AS (SELECT batch_id, any_value(created) AS created, any_value(mark) AS mark,
  arg_min({{'s': status, 'ms': ms}}, {{'ms': ms, 's': status}}) FILTER (status IN ({_FINAL}) AND ms <= created + {_DAY}) AS final,
  arg_max({{'s': status, 'ms': ms}}, {{'ms': ms, 's': status}}) FILTER (ms <= created + {_DAY}) AS latest FROM seen GROUP BY batch_id)
SELECT batch_id, CASE WHEN final IS NOT NULL THEN final.s WHEN mark >= created + {_DAY + _WIDTH} THEN 'expired' WHEN mark >= created + {_HOUR + _WIDTH} THEN 'stuck' ELSE latest.s END AS status,
  CASE WHEN final IS NOT NULL THEN final.ms WHEN mark >= created + {_DAY + _WIDTH} THEN created + {_DAY} WHEN mark >= created + {_HOUR + _WIDTH} THEN created + {_HOUR} ELSE latest.ms END AS at_ms
FROM one""",
)
def stream_batch_state(spark, sf_dir):
    """A batch is what one user did on one day."""
    statuses = F.create_map(*[F.lit(x) for kv in BATCH_STATUS.items() for x in kv])
    day = F.date_format("ts", "yyyy-MM-dd")
    log = _events(spark, sf_dir).select(F.concat_ws("-", "user_id", day).alias("batch_id"), statuses[F.col("event_type")].alias("status"), "ts")
    folder = scratch_folder(spark, "stream-batch-state")
    jobs.run_available(batch_states.stream_batch_state(log, keep_ms=400 * _DAY), f"{folder}/changes", f"{folder}/checkpoint")
    return batch_states.current_states(spark.read.schema(batch_states.CHANGES).parquet(f"{folder}/changes"))


@query(
    "stream_results_once",
    f"""WITH first AS (SELECT max(epoch_us(ts) // 1000) - {_DAY} AS mark FROM events WHERE event_id % 2 = 0)
SELECT event_id AS custom_id, event_type AS status FROM events, first WHERE event_id % 2 = 0 OR epoch_us(ts) // 1000 > mark""",
)
def stream_results_once(spark, sf_dir):
    """Results of even number arrive first; then, after a restart, all of them: those that were taken don't come twice, and
    those that are older than the watermark are too late."""
    e = scan(spark, sf_dir, "events", spread=False).select("ts", F.col("event_id").alias("custom_id"), F.col("event_type").alias("status"))
    folder = scratch_folder(spark, "stream-results-once")

    def run():
        arrived = spark.readStream.schema("ts timestamp, custom_id long, status string").parquet(f"{folder}/in/*")
        jobs.run_available(jobs.stream_dedup_results(arrived), f"{folder}/out", f"{folder}/checkpoint")

    e.filter("custom_id % 2 = 0").write.parquet(f"{folder}/in/first")
    run()
    e.write.parquet(f"{folder}/in/second")
    run()
    return spark.read.schema("ts timestamp, custom_id long, status string").parquet(f"{folder}/out").select("custom_id", "status")


@query(
    "stream_label",
    with_messages(
        "SELECT msg_id, m.channel, len(spans) AS n_spans, sensitivity, exposure, context, obfuscation FROM labelled JOIN msg m USING (msg_id)", *LABELLED_CTES
    ),
)
def stream_label(spark, sf_dir):
    """Messages arrive as JSON lines in two parts, with a broken line among them and a restart between."""
    m = messages(spark, sf_dir)
    lines = m.select("msg_id", F.to_json(F.struct("msg_id", "channel", "user", "recipients", "thread", "subject", "body", "attachments", "links")).alias("value"))
    folder = scratch_folder(spark, "stream-label")

    def run():
        jobs.stream_label(jobs.stream_messages(spark, f"{folder}/in/*"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()

    lines.filter("msg_id % 2 = 0").select("value").write.text(f"{folder}/in/first")
    run()
    rest = lines.filter("msg_id % 2 <> 0").select("value")
    rest.unionByName(spark.range(1).select(F.lit("{broken").alias("value"))).write.text(f"{folder}/in/second")
    run()
    run()  # nothing has come: nothing is labelled again
    done = spark.read.parquet(f"{folder}/out")
    return done.select("msg_id", "channel", F.size("spans").alias("n_spans"), "labels.*")
