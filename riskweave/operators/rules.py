"""Joins with tables of patterns. A user's own rules are rows; the same rules given as literals are in ``functions``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RULES = 10_000

RULES = "priority int, kind string, pattern string"


def rule_table(spark: SparkSession, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """(priority, kind, pattern) of named pattern lists, in their order: the first kind that matches wins."""
    return spark.createDataFrame([(i, kind, p) for i, (kind, ps) in enumerate(patterns.items()) for p in ps], RULES)


def match_rules(df: DataFrame, value: str, rules: DataFrame, out: str = "kind", default: str | None = None) -> DataFrame:
    """Adds the kind of the first rule (smallest priority, then kind) whose pattern matches the lower-cased value from its
    start; ``default`` where none does or the value is null.

    No key can serve such a join, so values and rules are compared one by one. That is done for *distinct* values only,
    with the rules broadcast (at most ``MOST_RULES``, which is checked; the patterns of a kind become one alternation), and
    the kinds are joined back by value, where a frequent value is an ordinary skewed key.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules: use the literal form for fixed rules, or cut the table by a key")
    kinds = rules.groupBy("priority", "kind").agg(
        F.concat(F.lit("^(?:"), F.array_join(F.array_sort(F.collect_list("pattern")), "|"), F.lit(")")).alias("_pattern")
    )
    values = df.select(F.col(value).alias("_value")).filter("_value is not null").distinct()
    hits = values.join(F.broadcast(kinds), F.expr("lower(_value) rlike _pattern"))
    found = hits.groupBy("_value").agg(F.min(F.struct("priority", "kind")).alias("_rule"))
    joined = df.join(found, F.col(value) == F.col("_value"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_rule")["kind"], F.lit(default))).drop("_value", "_rule")
