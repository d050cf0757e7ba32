"""Writers. Output is partitioned by split, so a reader of one split reads only its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave import schema
from riskweave.functions import grids as G
from riskweave.operators import packing, statistics
from riskweave.operators.positions import grouped_running


def split_metadata(df: DataFrame) -> DataFrame:
    """Per split: size, provider and model of the lowest message id, batches, agent distribution."""
    first = lambda c: F.min_by(F.coalesce(c, F.lit("unknown")), "msg_id")
    base = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("total_examples"), first("provider").alias("provider"), first("model").alias("model"),
        F.count_distinct("batch_id").alias("batch_count"),
    )
    agents = df.groupBy("split", F.coalesce("agent", F.lit("unknown")).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return base.join(statistics._map_of(agents, ["split"], "a", "n", "agent_distribution"), "split", "left")


def write_split_files(df: DataFrame, folder: str) -> None:
    """JSON lines per split without keys that begin with '_', and the metadata rows beside them, taken from what was
    written: the job that makes ``df`` runs once."""
    df.drop(*[c for c in df.columns if c.startswith("_")]).write.mode("overwrite").partitionBy("split").json(f"{folder}/examples")
    wanted = ["msg_id", "provider", "model", "batch_id", "agent"]
    narrow = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted], "split").schema
    split_metadata(df.sparkSession.read.schema(narrow).json(f"{folder}/examples")).write.mode("overwrite").json(f"{folder}/metadata")


def jsonl(df: DataFrame) -> DataFrame:
    """One JSON text per message, keys in fixed order."""
    present = [c for c in schema.MESSAGE_KEYS if c in df.columns]
    return df.select(F.to_json(F.struct(*present), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, folder: str) -> None:
    jsonl(df).write.mode("overwrite").text(folder)


def write_grid_dataset(examples: DataFrame, folder: str) -> None:
    """A grid dataset as Parquet: examples (split, set, group_id, puzzle_id, example_no, identifier, inputs, labels), sorted
    inside each split and set, and beside them

    * puzzles: puzzle_no (from 0 inside split and set), identifier and the range [example_start, example_end) of examples,
    * groups: group_no and the range [puzzle_start, puzzle_end) of puzzles,
    * identifiers: identifier and puzzle_id, with 0 as '<blank>',
    * metadata: per split the totals, the mean and the sets.

    The examples are written first, in one pass; everything else comes from the narrow columns of the written copy.
    Ranges are running sums per split and set that are spread over tasks, however large a set is.
    """
    place = ["split", "set", "group_id", "puzzle_id", "example_no"]
    sorted_rows = examples.repartitionByRange(*place).sortWithinPartitions(*place)
    sorted_rows.write.mode("overwrite").partitionBy("split", "set").parquet(f"{folder}/examples")
    spark = examples.sparkSession
    written = spark.read.schema(examples.schema).parquet(f"{folder}/examples")
    each = written.groupBy("split", "set", "group_id", "puzzle_id").agg(F.count(F.lit(1)).alias("n"), F.min("identifier").alias("identifier"))
    running = grouped_running(each, ["split", "set"], [F.col("group_id"), F.col("puzzle_id")], {"example_end": "n"}, "rank")
    puzzles = running.select(
        "split", "set", (F.col("rank") - 1).alias("puzzle_no"), "group_id", "puzzle_id", "identifier",
        (F.col("example_end") - F.col("n")).alias("example_start"), "example_end",
    )
    puzzles.write.mode("overwrite").parquet(f"{folder}/puzzles")
    puzzles = spark.read.parquet(f"{folder}/puzzles")
    members = puzzles.groupBy("split", "set", "group_id").agg(F.count(F.lit(1)).alias("n"))
    ranged = grouped_running(members, ["split", "set"], [F.col("group_id")], {"puzzle_end": "n"}, "rank")
    groups = ranged.select("split", "set", (F.col("rank") - 1).alias("group_no"), "group_id", (F.col("puzzle_end") - F.col("n")).alias("puzzle_start"), "puzzle_end")
    groups.write.mode("overwrite").parquet(f"{folder}/groups")
    blank = spark.createDataFrame([(0, "<blank>")], "identifier int, puzzle_id string")
    names = puzzles.select(F.col("identifier").cast("int").alias("identifier"), F.col("puzzle_id").cast("string").alias("puzzle_id")).distinct()
    blank.unionByName(names.filter("identifier <> 0")).write.mode("overwrite").parquet(f"{folder}/identifiers")
    of_sets = spark.read.parquet(f"{folder}/groups").groupBy("split", "set").agg(F.count(F.lit(1)).alias("groups"))
    totals = puzzles.groupBy("split", "set").agg(F.count(F.lit(1)).alias("puzzles"), F.sum(F.col("example_end") - F.col("example_start")).alias("examples"))
    totals.join(of_sets, ["split", "set"]).groupBy("split").agg(
        F.sum("groups").alias("total_groups"), F.sum("puzzles").alias("total_puzzles"), F.sum("examples").alias("total_examples"),
        (F.sum("examples") / F.sum("puzzles")).alias("mean_puzzle_examples"), F.array_sort(F.collect_set("set")).alias("sets"),
        F.lit(G.COLOURS + G.FIRST_COLOUR).alias("vocab_size"), F.lit(G.SIDE * G.SIDE).alias("seq_len"),
    ).write.mode("overwrite").json(f"{folder}/metadata")


def write_dsl_corpus(df: DataFrame, folder: str) -> None:
    packing.dsl_corpus(df).write.mode("overwrite").text(folder)
