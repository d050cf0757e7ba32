"""Global positions and running totals without a single-task window.

``row_number()`` over an unpartitioned window, or over a partition key that holds a third of all rows, runs in
one task. Here rows are range-sorted (many tasks), written once, and each row's position is its place inside its
partition plus the number of rows before that partition. Only per-partition counts are broadcast: at most one row
per partition for a global order, and at most two per partition for groups, because a sorted group that spans
several partitions is the only kind that needs an offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import reliable_checkpoint

_PART_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def _sorted_with_place(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    placed = (
        df.orderBy(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", _PART_BITS).cast("int"))
        .withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << _PART_BITS) - 1)))
        .drop("_place")
    )
    return reliable_checkpoint(placed)


def ordered_index(df: DataFrame, order: Sequence[Column], name: str = "idx", carry_total: str | None = None) -> DataFrame:
    """Adds a dense 0-based position in the order of ``order`` (make it unique: end with the row id)."""
    placed = _sorted_with_place(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_row") + F.col("_offset"))
    if carry_total:
        out = out.withColumn(carry_total, F.col("_total"))
    return out.drop("_part", "_row", "_offset", "_total")


def grouped_running(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, str] | None = None,
    rank: str | None = None,
) -> DataFrame:
    """Per group, in the given order: running totals (``sums``: output name -> input column) and a 1-based rank.

    A group of any size is spread over many tasks; see the module text.
    """
    sums = sums or {}
    placed = _sorted_with_place(df, [*[F.col(g) for g in groups], *order])
    local = Window.partitionBy("_part", *groups).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = placed
    for name, column in sums.items():
        out = out.withColumn(name, F.sum(column).over(local))
    if rank:
        out = out.withColumn(rank, F.row_number().over(local))

    # A sorted group that crosses a partition edge is the last group of one partition and the first of the next.
    # ends: one row per partition; crossing groups: at most one per partition edge.
    key = F.struct(*[F.col(g) for g in groups])
    ends = placed.groupBy("_part").agg(
        F.min_by(key, "_row").alias("_first"), F.max_by(key, "_row").alias("_last")
    )
    edge_groups = (
        ends.select(F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_g"), "_part")
        .groupBy("_g")
        .agg(F.count(F.lit(1)).alias("_parts"))
        .filter("_parts > 1")
        .select(*[F.col("_g")[g].alias(g) for g in groups])
    )
    totals = placed.join(F.broadcast(edge_groups), list(groups), "left_semi").groupBy("_part", *groups).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()]
    )
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        *groups,
        F.sum("_n").over(before).alias("_before_n"),
        *[F.sum(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in sums],
    )
    out = out.join(F.broadcast(offsets), ["_part", *groups], "left")
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.coalesce(F.col(f"_before_{name}"), F.lit(0)))
    if rank:
        out = out.withColumn(rank, (F.col(rank) + F.coalesce(F.col("_before_n"), F.lit(0))).cast("long"))
    return out.drop("_part", "_row", "_before_n", *[f"_before_{n}" for n in sums])
