"""Splits, samples and request plans. Positions come from ordered_index, never from a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.fixed import corpus
from riskweave.functions.hashing import digest, pick, pick_weighted, shuffled, string_array, uniform, uniform_int
from riskweave.operators.positions import grouped_running, ordered_index


def _with_position(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Only the key and the sort columns go through the global sort; rows are joined back by key."""
    columns = {f"_o{i}": c for i, c in enumerate(order)}
    narrow = df.select(key, *[c.alias(n) for n, c in columns.items()])
    ordering = [F.col(n) for n in columns] + [F.col(key)]
    index = ordered_index(narrow, ordering, "_idx", carry_total="_n").select(key, "_idx", "_n")
    return df.join(index, key)


def split_by_ratio(df: DataFrame, key: str = "msg_id", train: float = 0.7, val: float = 0.15, order: Sequence[Column] = ()) -> DataFrame:
    """First int(n x train) rows train, next int(n x val) rows val, rest test, in key order (or ``order`` first)."""
    placed = _with_position(df.drop("split"), key, order)
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    name = F.when(F.col("_idx") < a, "train").when(F.col("_idx") < a + b, "val").otherwise("test")
    return placed.withColumn("split", name).drop("_idx", "_n")


def split_by_size(df: DataFrame, sizes: dict[str, int], key: str = "msg_id", shuffle_seed: int | None = None) -> DataFrame:
    """Consecutive blocks of given sizes; rows beyond them get no split (null)."""
    order = [digest(shuffle_seed, F.col(key))] if shuffle_seed is not None else []
    placed = _with_position(df.drop("split"), key, order)
    edge, name = 0, None
    for split, size in sizes.items():
        edge += size
        name = (F if name is None else name).when(F.col("_idx") < edge, F.lit(split))
    return placed.withColumn("split", name).drop("_idx", "_n")


def split_sizes(total: int, caps: dict[str, int] | None = None) -> dict[str, int]:
    """70 / 15 / 15 % with the rest in test, so every row has a split; with ``caps`` (``corpus.SPLIT_CAPS``) at most
    so many rows each, and the others get none."""
    sizes = {"train": int(total * 0.7), "val": int(total * 0.15)}
    sizes["test"] = int(total * 0.15) if caps else total - sizes["train"] - sizes["val"]
    return {s: min(n, caps[s]) for s, n in sizes.items()} if caps else sizes


def split_stratified(df: DataFrame, strata: Sequence[str], domain: str, seed: int = 42, key: str = "msg_id") -> DataFrame:
    """Whole domains go to one split by their hash; inside a stratum rows keep a shuffled ``stratum_rank``.

    Domains are disjoint over splits by construction; the rank lets a caller take even shares of each stratum, however
    large it is.
    """
    draw = uniform(seed, "domain", F.col(domain))
    train, val = corpus.SPLIT_RATIOS["train"], corpus.SPLIT_RATIOS["val"]
    split = F.when(draw < train, "train").when(draw < train + val, "val").otherwise("test")
    keyed = df.withColumns({"split": split, "_k": digest(seed, "row", F.col(key))})
    ranked = grouped_running(
        keyed.select(key, "split", "_k", *strata), ["split", *strata], [F.col("_k"), F.col(key)], rank="stratum_rank"
    )
    return keyed.drop("_k").join(ranked.select(key, "stratum_rank"), key)


def domain_leakage(df: DataFrame, domain: str, split: str = "split") -> DataFrame:
    """Domains found in more than one split, with the splits."""
    found = df.groupBy(domain).agg(F.array_sort(F.collect_set(split)).alias("splits"))  # at most one entry per split
    return found.filter(F.size("splits") > 1)


def evenly_spaced_sample(df: DataFrame, k: int, key: str = "msg_id") -> DataFrame:
    """Rows at positions linspace(0, n-1, k): i-th position is floor(i (n-1) / (k-1))."""
    placed = _with_position(df, key, [])
    size = F.least(F.lit(k), F.col("_n"))
    step = F.when(size > 1, (F.col("_n") - 1) / (size - 1)).otherwise(0.0)
    # The sample index whose position could be this row: the smallest i with i x step >= idx.
    i = F.when(step > 0, F.ceil(F.col("_idx") / step)).otherwise(0)
    hit = F.exists(F.array(i - 1, i, i + 1), lambda j: (j >= 0) & (j < size) & (F.floor(j * step) == F.col("_idx")))
    return placed.filter(hit).withColumnRenamed("_idx", "position").drop("_n")


def low_mid_high_sample(df: DataFrame, risk: str, key: str = "msg_id") -> DataFrame:
    """First, middle and last row by risk."""
    placed = _with_position(df, key, [F.col(risk)])
    level = (
        F.when(F.col("_idx") == 0, "LOW").when(F.col("_idx") == F.floor(F.col("_n") / 2), "MEDIUM").when(F.col("_idx") == F.col("_n") - 1, "HIGH")
    )
    return placed.withColumn("level", level).filter("level is not null").drop("_idx", "_n")


def topk_spans(df: DataFrame, tags: str = "tags", confidences: str = "confidences", k: int = 20, sure: float = 0.8, out: str = "top_spans") -> DataFrame:
    """First k positions whose tag is not O or whose confidence exceeds a limit."""
    zipped = F.zip_with(tags, confidences, lambda t, c: F.struct(t.alias("tag"), c.alias("confidence")))
    numbered = F.transform(zipped, lambda z, i: F.struct(i.alias("position"), z["tag"].alias("tag"), z["confidence"].alias("confidence")))
    return df.withColumn(out, F.slice(F.filter(numbered, lambda z: (z["tag"] != "O") | (z["confidence"] > sure)), 1, k))


# -- plans ------------------------------------------------------------------------------------------------------


def weighted_plan(
    ids: DataFrame, key: str, seed: int = 42, agents: dict[str, float] | None = None, risks: dict[str, float] | None = None,
    thread_probability: float = corpus.THREAD_PROBABILITY, scenarios: DataFrame | None = None,
) -> DataFrame:
    """A request per id: agent and risk by weight, up to two target spans, 2-4 turns with some probability.

    ``scenarios`` (agent_type, risk_level, scenarios array) adds a scenario text; Spark picks the join by its size.
    """
    k = F.col(key)
    planned = ids.select(
        key,
        pick_weighted(agents or corpus.AGENT_WEIGHTS, seed, "agent", k).alias("agent_type"),
        pick_weighted(risks or corpus.RISK_LEVEL_WEIGHTS, seed, "risk", k).alias("risk_level"),
        F.when(uniform(seed, "thread", k) < thread_probability, uniform_int(2, 4, seed, "turns", k)).otherwise(1).alias("conversation_turns"),
    )
    options = None
    for agent, spans in corpus.AGENT_TARGET_SPANS.items():
        options = (F if options is None else options).when(F.col("agent_type") == agent, string_array(spans))
    planned = planned.withColumn("target_spans", F.slice(shuffled(options, seed, "spans", k), 1, 2))
    if scenarios is not None:
        joined = planned.join(scenarios, ["agent_type", "risk_level"], "left")
        planned = joined.withColumn("scenario_context", pick(F.col("scenarios"), seed, "scenario", k)).drop("scenarios")
    return planned


def plan_batches(requests: DataFrame, key: str, split: str | None = None, limit: int = corpus.MAX_BATCH_REQUESTS) -> DataFrame:
    """Batch number, request index inside the batch and batch id; per split if given."""
    if split:
        ranked = grouped_running(requests.select(key, split), [split], [F.col(key)], rank="_r").withColumn("_idx", F.col("_r") - 1)
        placed = requests.join(ranked.select(key, "_idx"), key)
        prefix = F.col(split)
    else:
        placed = _with_position(requests, key, []).drop("_n")
        prefix = F.lit("all")
    number = F.floor(F.col("_idx") / limit) + 1
    return placed.withColumns(
        {
            "batch_num": number,
            "request_index": F.col("_idx") % limit,
            "batch_id": F.concat(prefix, F.lit("_batch_"), F.lpad(number.cast("string"), 3, "0")),
        }
    ).drop("_idx")


def pending_requests(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Requests without a stored result."""
    return requests.join(results.select(key), key, "left_anti")


def subsample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement: those with the smallest digests (a sampling operator, so n is the feature).

    By position rather than by limit, so a large n stays spread over tasks.
    """
    placed = _with_position(df, key, [digest(seed, "subsample", F.col(key))])
    return placed.filter(F.col("_idx") < n).drop("_idx", "_n")
