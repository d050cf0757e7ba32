"""Counts and statistics of a corpus. Every aggregate is partial before its shuffle, so a hot key costs one row per task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.fixed import labels as fixed
from riskweave.fixed.labels import HEADS
from riskweave.functions.text import contains_any, count_contained, safe_corr


def _map_of(df: DataFrame, keys: Sequence[str], name: str, count: str, out: str) -> DataFrame:
    """(keys, name, count) rows to one map per key; names are types, agents, channels: a small set."""
    entry = F.struct(F.col(name), F.col(count))
    return df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(out))


def processing_stats(df: DataFrame, source: str = "channel", spans: str = "spans", labels: str = "labels") -> DataFrame:
    """Per input: processed messages, spans, positives of each head."""
    positives = [F.sum((F.col(f"{labels}.{h}") == 1).cast("long")).alias(f"{h}_positive") for h in HEADS]
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("processed"), F.sum(F.size(spans).cast("long")).alias("total_spans"), *positives
    )


def spans_by_type(df: DataFrame, source: str = "channel", spans: str = "spans") -> DataFrame:
    """Per input and span type: count. Rows rather than a map, ready to join or pivot."""
    flat = df.select(source, F.inline_outer(spans)).filter("type is not null")
    return flat.groupBy(source, F.col("type").alias("span_type")).agg(F.count(F.lit(1)).alias("n"))


def split_statistics(df: DataFrame, split: str = "split") -> DataFrame:
    """Per split: size, mean body length, turns, positives, and span / agent / channel distributions as maps.

    One pass: a message gives a row with its measures and a row per name it counts for; added up by name, few rows are left.
    """
    turns = F.col("thread.prior_msgs")
    measures = F.struct(
        F.length("body").cast("long").alias("length"), (turns > 0).alias("multi"), (turns == 0).alias("single"),
        *[F.col(f"labels.{h}").cast("long").alias(h) for h in HEADS],
    )
    narrow = df.select(
        F.col(split), measures.alias("_m"), F.coalesce("agent", F.lit("unknown")).alias("_agent"), F.col("channel").alias("_channel"),
        F.filter(F.transform("spans", lambda s: s["type"]), lambda t: t.isNotNull()).alias("_types"),
    )
    nothing = F.lit(None).cast(narrow.schema["_m"].dataType)

    def entry(kind: str, name: Column, n: Column = F.lit(1), m: Column = nothing) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"), m.alias("m"))

    own = F.array(entry("message", F.lit(None).cast("string"), m=F.col("_m")), entry("agent", F.col("_agent")), entry("channel", F.col("_channel")))
    types = F.transform(F.array_distinct("_types"), lambda t: entry("span", t, F.size(F.filter("_types", lambda x: x == t))))
    rows = narrow.select(split, F.inline_outer(F.concat(own, F.coalesce(types, F.filter(own, lambda x: F.lit(False))))))
    added = rows.groupBy(split, "kind", "name").agg(
        F.sum("n").alias("n"), F.sum("m.length").alias("length"), F.count("m.length").alias("n_length"), F.count_if("m.multi").alias("multi"),
        F.count_if("m.single").alias("single"), *[F.sum(f"m.{h}").alias(h) for h in HEADS],
    )

    def map_of(kind: str) -> Column:
        entries = F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "n")))
        return F.when(F.col(split).isNotNull() & (F.size(entries) > 0), F.map_from_entries(F.array_sort(entries)))

    return added.groupBy(split).agg(
        F.sum(F.when(F.col("kind") == "message", F.col("n"))).alias("total_examples"),
        F.when(F.sum("n_length") > 0, F.sum("length") / F.sum("n_length")).alias("avg_body_length"),
        F.sum("multi").alias("multi_turn"),
        F.sum("single").alias("single_turn"),
        *[F.sum(h).alias(h) for h in HEADS],
        *[map_of(k).alias(f"{k}_distribution") for k in ("span", "agent", "channel")],
    )


def long_labels(df: DataFrame, labels: str = "labels", keys: Sequence[str] = ("msg_id",), value: str = "value") -> DataFrame:
    """(keys, head, value) rows of a label struct; heads without a value drop out."""
    wide = df.select(*keys, *[F.col(f"{labels}.{h}").cast("double").alias(h) for h in HEADS])
    return wide.unpivot(list(keys), HEADS, "head", value).filter(F.col(value).isNotNull())


def label_stats(values: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Per head (and key): count, mean, population deviation, min, max, distinct values, range."""
    v = F.col(value)
    return values.groupBy(*keys, "head").agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_distinct(v).alias("unique_values"),
        (F.max(v) - F.min(v)).alias("value_range"),
    )


def label_quality_flags(stats: DataFrame) -> DataFrame:
    return stats.select(
        *[c for c in stats.columns if c in ("split", "head")],
        F.when(F.col("value_range") < 1e-6, "identical").when(F.col("value_range") < 0.1, "limited").alias("range_flag"),
        F.when(F.col("unique_values") <= 2, "binary").when(F.col("unique_values") > 20, "many").alias("value_flag"),
    )


MOST_HEADS = 1_000  # names of unexpected heads that the one row lists


def head_counts(df: DataFrame, label_map: str) -> DataFrame:
    """head, n and whether it is expected, of every head that a label map names."""
    heads = df.select(F.explode(F.map_keys(label_map)).alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    return heads.withColumn("expected", F.col("head").isin(*HEADS))


def label_coverage(df: DataFrame, label_map: str) -> DataFrame:
    """One row: labelled and unlabelled counts, unlabelled percent, missing and extra heads, non-numeric values.

    ``label_map`` is a map head -> text. Heads are counted as rows; ``extra_heads`` lists the first ``MOST_HEADS`` by name
    (a limit of the report; ``n_extra_heads`` counts all, ``head_counts`` gives them).
    """
    numbers = F.map_values(label_map)
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(label_map).alias("labelled"),
        F.coalesce(
            F.sum(F.size(F.filter(numbers, lambda x: x.isNotNull() & x.try_cast("double").isNull()))), F.lit(0)
        ).alias("non_numeric"),
    )
    heads = head_counts(df, label_map)
    known = heads.filter("expected").agg(F.collect_list("head")).scalar()  # at most the four
    first = heads.filter("not expected").orderBy("head").limit(MOST_HEADS).agg(F.array_sort(F.collect_list("head"))).scalar()
    extra = heads.filter("not expected").agg(F.count(F.lit(1))).scalar()
    return counts.select("*", known.alias("_known"), first.alias("extra_heads"), extra.alias("n_extra_heads")).select(
        "total",
        "labelled",
        (F.col("total") - F.col("labelled")).alias("unlabelled"),
        ((F.col("total") - F.col("labelled")) / F.col("total") * 100).alias("unlabelled_percent"),
        F.array_sort(F.array_except(F.array(*[F.lit(h) for h in HEADS]), "_known")).alias("missing_heads"),
        "extra_heads",
        "n_extra_heads",
        "non_numeric",
    )


def compare_splits(stats: DataFrame, split: str = "split") -> DataFrame:
    """Spread of mean and deviation over splits for heads every split has; large above .2 and .1."""
    n_splits = stats.select(split).distinct().agg(F.count(F.lit(1)).alias("_n"))
    spread = stats.groupBy("head").agg(
        F.count_distinct(split).alias("_splits"),
        (F.max("mean") - F.min("mean")).alias("mean_difference"),
        (F.max("std") - F.min("std")).alias("std_difference"),
    )
    return (
        spread.filter(F.col("_splits") == n_splits.scalar())
        .select(
            "head", "mean_difference", "std_difference",
            (F.col("mean_difference") > 0.2).alias("large_mean_difference"),
            (F.col("std_difference") > 0.1).alias("large_std_difference"),
        )
    )


def risk_indicators(df: DataFrame, out: str = "risk_indicators") -> DataFrame:
    """External recipients + attachments above 1 MB + sensitive keywords in the body."""
    external = F.size(F.filter("recipients", lambda r: contains_any(r, fixed.RISK_RECIPIENT_MARKERS)))
    large = F.size(F.filter("attachments", lambda a: a["size"] > fixed.LARGE_ATTACHMENT))
    return df.withColumn(out, external + large + count_contained(F.lower("body"), fixed.RISK_KEYWORDS))


def discrimination(values: DataFrame, value: str = "value") -> DataFrame:
    """Range and deviation of all heads together and the verdict."""
    pooled = values.agg((F.max(value) - F.min(value)).alias("overall_range"), F.stddev_pop(value).alias("overall_std"))
    r, s = F.col("overall_range"), F.col("overall_std")
    return pooled.withColumn(
        "verdict",
        F.when((r > 0.5) & (s > 0.15), "EXCELLENT")
        .when((r > 0.3) & (s > 0.10), "GOOD")
        .when(r > 0.1, "MODERATE")
        .otherwise("LIMITED"),
    )


# -- two labelers -----------------------------------------------------------------------------------------------


def align_labels(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("msg_id", "head")) -> DataFrame:
    """(keys, rule_value, other_value) of rows both labelers have."""
    a = left.select(*keys, F.col("value").alias("rule_value"))
    return a.join(right.select(*keys, F.col("value").alias("other_value")), list(keys))


def align_by_position(left: DataFrame, right: DataFrame, order: str = "msg_id") -> DataFrame:
    """The n-th row of one list beside the n-th of the other, per head, cut at the shorter list."""
    from riskweave.operators.positions import grouped_running

    a = grouped_running(left.select("head", order, F.col("value").alias("rule_value")), ["head"], [F.col(order)], rank="position")
    b = grouped_running(right.select("head", order, F.col("value").alias("other_value")), ["head"], [F.col(order)], rank="position")
    return a.drop(order).join(b.drop(order), ["head", "position"])


def compare_labelers(pairs: DataFrame) -> DataFrame:
    """Per head: Pearson r (0 if undefined) and differences other - rule of mean, deviation and range."""
    a, b = F.col("rule_value"), F.col("other_value")
    stats = pairs.groupBy("head").agg(
        F.count(F.lit(1)).alias("n"),
        safe_corr(a, b).alias("_r"),
        F.avg(a).alias("rule_mean"), F.stddev_pop(a).alias("rule_std"), (F.max(a) - F.min(a)).alias("rule_range"),
        F.avg(b).alias("other_mean"), F.stddev_pop(b).alias("other_std"), (F.max(b) - F.min(b)).alias("other_range"),
    )
    return stats.select(
        "head", "n",
        F.coalesce("_r", F.lit(0.0)).alias("correlation"),
        (F.col("other_mean") - F.col("rule_mean")).alias("mean_difference"),
        (F.col("other_std") - F.col("rule_std")).alias("std_difference"),
        (F.col("other_range") - F.col("rule_range")).alias("range_difference"),
        "rule_mean", "rule_std", "rule_range", "other_mean", "other_std", "other_range",
    )


def comparison_verdict(comparison: DataFrame) -> DataFrame:
    """Mean correlation and its reading, and which labeler has the wider range."""
    out = comparison.agg(
        F.avg("correlation").alias("avg_correlation"),
        F.avg("rule_range").alias("avg_rule_range"),
        F.avg("other_range").alias("avg_other_range"),
    )
    r = F.col("avg_correlation")
    return out.withColumns(
        {
            "verdict": F.when(r < 0.3, "LOW").when(r < 0.6, "MEDIUM").otherwise("HIGH"),
            "other_is_wider": F.col("avg_other_range") > F.col("avg_rule_range"),
        }
    )


def disagreements(df: DataFrame, rule: str = "labels", other: str = "other_labels", limit: float = fixed.DISAGREEMENT_LIMIT) -> DataFrame:
    """Messages whose mean risks differ by more than the limit, with the reasons that may explain it."""
    mean = lambda c: sum(F.col(f"{c}.{h}") for h in HEADS) / len(HEADS)
    content = F.lower(F.concat_ws(" ", "subject", "body"))
    inside = F.exists("recipients", lambda r: r.contains("@company.com"))
    provider = F.exists("recipients", lambda r: contains_any(r, ["@gmail", "@yahoo"]))
    role = F.col("user.role")
    factors = F.array_compact(
        F.array(
            F.when(contains_any(content, ["board", "meeting", "review", "preparation"]), "Business context present"),
            F.when(role.isin("CFO", "CEO", "DIRECTOR") & inside, "Senior role + internal recipients").when(
                role.isin("INTERN", "TEMP") & provider, "Junior role + external recipients"
            ),
            F.when(
                contains_any(content, ["urgent", "immediately", "secret", "confidential"]),
                "Pressure/confidentiality language",
            ),
        )
    )
    scored = df.withColumns({"rule_risk": mean(rule), "other_risk": mean(other)})
    return scored.select(
        "msg_id", "rule_risk", "other_risk", F.abs(F.col("rule_risk") - F.col("other_risk")).alias("risk_difference"),
        factors.alias("factors"),
    ).filter(F.col("risk_difference") > limit)


def top_disagreements(found: DataFrame, k: int = 5) -> DataFrame:
    return found.orderBy(F.desc(F.round("risk_difference", 9)), "msg_id").limit(k)


def labeling_differences(pairs: DataFrame) -> DataFrame:
    """Mean absolute difference per head."""
    return pairs.groupBy("head").agg(F.avg(F.abs(F.col("rule_value") - F.col("other_value"))).alias("mean_abs_difference"))


def paired_discrimination(df: DataFrame, pair: str, appropriate: str, labelers: Sequence[str]) -> DataFrame:
    """Per pair: |mean risk of the inappropriate case - of the appropriate one| for each labeler."""
    mean = lambda c: sum(F.col(f"{c}.{h}") for h in HEADS) / len(HEADS)
    sides = {n: mean(n) for n in labelers}
    return df.groupBy(pair).agg(
        *[
            F.abs(F.max(F.when(~F.col(appropriate), r)) - F.max(F.when(F.col(appropriate), r))).alias(f"{n}_difference")
            for n, r in sides.items()
        ]
    )


# -- shares and funnels -----------------------------------------------------------------------------------------


def agent_distribution(df: DataFrame, agent: str = "agent") -> DataFrame:
    return df.groupBy(F.coalesce(agent, F.lit("unknown")).alias("agent")).agg(F.count(F.lit(1)).alias("n"))


def model_usage(df: DataFrame, keys: Sequence[str] = ("provider", "model", "split")) -> DataFrame:
    """Counts by provider, model and split with totals (rollup; null is a total)."""
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("n"))


def label_balance(df: DataFrame, labels: str = "labels", low: float = 0.45, high: float = 0.55) -> DataFrame:
    """Positive share per head and whether it lies in the target band."""
    share = long_labels(df, labels, keys=()).groupBy("head").agg(F.avg((F.col("value") == 1).cast("double")).alias("share"))
    return share.withColumn("balanced", F.col("share").between(low, high))


def pan_balance(df: DataFrame, candidates: Column, valid) -> DataFrame:
    """Valid and invalid card numbers among candidates and their ratio."""
    flat = df.select(F.explode_outer(candidates).alias("t")).filter("t is not null").select(valid.alias("ok"))
    counts = flat.agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))
    return counts.withColumn("ratio", F.when(F.col("invalid") > 0, F.col("valid") / F.col("invalid")))


def pipeline_funnel(stages: DataFrame, split: str = "split") -> DataFrame:
    """Per split from (generated, augmented, converted, passed) counts: rates; plus one row 'mean' over splits."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rates = stages.select(
        split,
        ratio("converted", "augmented").alias("conversion_rate"),
        ratio("passed", "converted").alias("quality_pass_rate"),
        ratio("augmented", "generated").alias("augmentation_ratio"),
    )
    names = rates.columns[1:]
    return rates.unionByName(rates.agg(*[F.avg(n).alias(n) for n in names]).withColumn(split, F.lit("mean")))


def profile_structure(df: DataFrame, column: str, depth: int = 1) -> DataFrame:
    """Per field of a JSON text column: presence, kinds of value, a sample, and whether its name speaks of a label, score
    or risk. With ``depth`` above 1, fields of nested objects too, as 'outer.inner'.

    Fields are rows, counted by (field, kind) before anything is put together: a kind is the name of a type without what
    it holds, so there are few per field, and however many fields there are, they are spread over the tasks.
    """
    entries = lambda v: F.explode(F.try_variant_get(v, "$", "map<string,variant>")).alias("name", "v")
    level = df.select(entries(F.try_parse_json(column))).select(F.col("name").alias("key"), "v")
    levels = [level]
    for _ in range(depth - 1):
        inner = levels[-1].filter(F.schema_of_variant("v").startswith("OBJECT")).select("key", entries(F.col("v")))
        levels.append(inner.select(F.concat_ws(".", "key", "name").alias("key"), "v"))
    flat = reduce(DataFrame.unionByName, levels)
    kind = F.substring_index(F.schema_of_variant("v"), "<", 1)
    counted = flat.groupBy("key", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.try_variant_get("v", "$", "string")).alias("least")
    )
    named = F.lower("key")
    return (
        counted.groupBy("key")
        .agg(F.sum("n").alias("present"), F.array_sort(F.collect_list("kind")).alias("kinds"), F.min("least").alias("sample"))
        .withColumn("label_candidate", contains_any(named, ["label", "score", "risk"]))
    )


def indicator_set(df: DataFrame, attachments: str = "attachments") -> DataFrame:
    """Distinct attachment indicators with counts."""
    flat = df.select(F.explode(F.flatten(F.transform(attachments, lambda a: a["sensitivity_indicators"]))).alias("indicator"))
    return flat.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))
