"""Batch logs, sessions and labelling cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.fixed import labels as fixed
from riskweave.functions.text import lookup
from riskweave.schema import FINAL_BATCH_STATES

DAY, HOUR = 24 * 3600, 3600


def latest_batches(log: DataFrame, keys=("session_id", "split", "model")) -> DataFrame:
    """One row per batch from its status records: latest status, first and last time, latest request count.

    max_by is merged in partial aggregates, so a batch with very many records is not gathered anywhere.
    """
    order = F.struct("ts", "event_id")
    return log.groupBy("batch_id").agg(
        *[F.max_by(k, order).alias(k) for k in keys],
        F.max_by("status", order).alias("status"),
        F.max_by("request_count", order).alias("request_count"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def batch_state(batches: DataFrame, now: Column, timeout: int = DAY, stuck: int = HOUR) -> DataFrame:
    """Adds state: final states stay; older than the timeout is expired; older than an hour is stuck."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    return batches.withColumns(
        {
            "age_seconds": age,
            "state": F.when(F.col("status").isin(*FINAL_BATCH_STATES), F.col("status"))
            .when(age > timeout, "expired")
            .when(age > stuck, "stuck")
            .otherwise(F.col("status")),
        }
    )


def batch_stats(batches: DataFrame, now: Column, keys=("session_id", "split", "model")) -> DataFrame:
    """Per key: active, completed and failed batches, pending requests, oldest active age, success and failure rate."""
    completed, failed = F.col("status") == "completed", F.col("status") == "failed"
    active = ~(completed | failed)
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    return (
        batches.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_batches"),
            F.count_if(active).alias("active"),
            F.count_if(completed).alias("completed"),
            F.count_if(failed).alias("failed"),
            F.coalesce(F.sum(F.when(active, F.col("request_count"))), F.lit(0)).alias("pending_requests"),
            F.coalesce(F.max(F.when(active, age)), F.lit(0)).alias("oldest_active_age"),
        )
        .withColumn("success_rate", F.round(F.col("completed") / F.col("total_batches"), 3))
        .withColumn("failure_rate", F.round(1 - F.col("completed") / F.col("total_batches"), 3))
    )


def session_stats(sessions: DataFrame) -> DataFrame:
    """One row: sessions by status, oldest and newest start."""
    by_status = {s: F.count_if(F.col("status") == s).alias(s) for s in ("active", "completed", "failed", "interrupted")}
    return sessions.agg(
        F.count(F.lit(1)).alias("total"), *by_status.values(),
        F.min("start_time").alias("oldest"), F.max("start_time").alias("newest"),
    )


def request_cost(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    prompt = lookup(model, {m: p[0] for m, p in fixed.MODEL_PRICES.items()}, fixed.DEFAULT_PRICE[0])
    completion = lookup(model, {m: p[1] for m, p in fixed.MODEL_PRICES.items()}, fixed.DEFAULT_PRICE[1])
    return (prompt_tokens * prompt + completion_tokens * completion) / 1000


def labeling_cost(requests: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Per model: requests, successes, success rate in percent, total and mean cost, expected cost.

    ``requests``: model, prompt_tokens, completion_tokens, success. ``prices`` (model, input_1k, output_1k) replaces
    the known prices; it is joined, and Spark picks the join by its size.
    """
    tokens = (F.col("prompt_tokens"), F.col("completion_tokens"))
    if prices is None:
        priced = requests.withColumn("cost", request_cost(F.col("model"), *tokens))
    else:
        joined = requests.join(prices, "model", "left")
        rate = lambda c, i: F.coalesce(F.col(c), F.lit(fixed.DEFAULT_PRICE[i]))
        priced = joined.withColumn("cost", (tokens[0] * rate("input_1k", 0) + tokens[1] * rate("output_1k", 1)) / 1000)
    totals = priced.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("success").alias("successful"),
        F.sum("cost").alias("total_cost"),
        F.avg("cost").alias("mean_cost"),
    )
    expected = lookup(F.col("model"), fixed.EXPECTED_COST, fixed.DEFAULT_EXPECTED_COST)
    return totals.withColumn("success_rate", F.col("successful") / F.col("total_requests") * 100).withColumn(
        "expected_cost", F.col("total_requests") * expected
    )
