"""Readers for message files, result files, logs and puzzles. All are plain Spark scans with a fixed schema."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave import schema
from riskweave.functions.markup import characters
from riskweave.session import reliable_checkpoint

_CORRUPT = "_corrupt_record"


MOST_BLOCKS = 1_000_000  # that are broadcast


def split_of_file(name: Column, folder: Column | None = None) -> Column:
    """train / val / test from a file name, or from its folder's (where the files are parts); else the name itself."""
    found = F.when(name.contains("train"), "train").when(name.contains("val"), "val").when(name.contains("test"), "test")
    return found.otherwise(name) if folder is None else F.coalesce(found, split_of_file(folder), name)


def _folder() -> Column:
    """The name of the folder that a file lies in, if it speaks of a split."""
    parent = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return F.when(parent.rlike("train|val|test"), parent)


def _parsed(lines: DataFrame, struct, keep_bad: bool) -> DataFrame:
    """Text rows as typed rows. Text that is blank is dropped; text that is malformed or no object is dropped, or kept
    with the text in _corrupt_record."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    rest = [c for c in lines.columns if c != "value"]
    typed = lines.filter(F.trim("value") != "").select(
        *rest, F.from_json("value", struct, options).alias("_row"), F.ltrim("value").startswith("{").alias("_object"), "value"
    )
    bad = ~F.col("_object") | F.col(f"_row.{_CORRUPT}").isNotNull()
    names = [f.name for f in struct.fields if f.name != _CORRUPT]
    if keep_bad:
        return typed.select(*rest, *[F.col(f"_row.{n}").alias(n) for n in names], F.when(bad, F.col("value")).alias(_CORRUPT))
    return typed.filter(~bad).select(*rest, *[F.col(f"_row.{n}").alias(n) for n in names])


def parse_messages(lines: DataFrame, keep_bad: bool = False) -> DataFrame:
    """Text lines (batch or stream) as messages."""
    return _parsed(lines, schema.message_schema(_CORRUPT), keep_bad)


def read_messages(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """JSON lines as messages. Malformed lines and lines that are not objects are dropped, or kept for counting with
    their text in _corrupt_record."""
    return parse_messages(spark.read.text(path), keep_bad)


def read_report(df: DataFrame) -> DataFrame:
    """One row: good and skipped lines of a ``keep_bad`` read."""
    return df.agg(F.count_if(F.col(_CORRUPT).isNull()).alias("read"), F.count(_CORRUPT).alias("skipped"))


def read_split_dir(spark: SparkSession, folder: str, pattern: str = "*_examples_augmented.jsonl") -> DataFrame:
    """Messages of all matching files with their split and file name."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).select(
        "value", F.col("_metadata.file_name").alias("file_name"), _folder().alias("_folder")
    )
    return parse_messages(lines).withColumn("split", split_of_file(F.col("file_name"), F.col("_folder"))).drop("_folder")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the name and path of their file, the start of their block, and the name of a folder that tells a split."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_name").alias("batch_file"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        _folder().alias("folder"),
    )


def _numbered_in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers lines from 1 inside each block; a scan gives the lines of a block one after another."""
    file, block, count = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = [np.asarray(batch.column(c).dictionary_encode().indices) for c in ("file_path", "block")]
        new = np.flatnonzero((np.diff(runs[0]) != 0) | (np.diff(runs[1]) != 0)) + 1
        heads = np.append(0, new)
        number = np.arange(batch.num_rows) - np.repeat(heads, np.diff(np.append(heads, batch.num_rows))) + 1
        if (batch.column("file_path")[0].as_py(), batch.column("block")[0].as_py()) == (file, block):
            number[: new[0] if len(new) else batch.num_rows] += count
        file, block, count = batch.column("file_path")[-1].as_py(), batch.column("block")[-1].as_py(), int(number[-1])
        yield batch.append_column("line_number", pa.array(number, pa.int64()))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Line numbers from 1 inside each file; blank lines count. Lines are numbered in their block where they are read and
    not moved. Only the counts of blocks go through a shuffle; a block that isn't its file's first adds those before it.
    """
    key = ["file_path", "block"]
    numbered = lines.mapInArrow(_numbered_in_block, lines.select("*", F.lit(0).cast("long").alias("line_number")).schema)
    counts = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    late = counts.join(counts.filter("block > 0").select("file_path").distinct(), "file_path", "left_semi")
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = late.withColumn("_before", F.sum("_n").over(before)).filter("block > 0").select(*key, "_before")
    offsets = reliable_checkpoint(offsets)  # one row per block after a file's first: few files have any
    small = offsets.count() <= MOST_BLOCKS
    placed = numbered.join(F.broadcast(offsets) if small else offsets, key, "left")
    lost = (F.col("block") > 0) & F.col("_before").isNull()
    number = F.when(lost, F.raise_error(F.lit("the blocks of a file changed while it was read"))).otherwise(
        F.col("line_number") + F.coalesce("_before", F.lit(0))
    )
    return placed.select("line", "batch_file", "folder", number.cast("long").alias("line_number"))


def read_batch_results(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """First provider's result files: custom_id, content, ``example`` (the content's JSON object, a variant), split (given, or
    from the file's or folder's name), file and line number. Lines without content, and content that is no object, drop out."""
    from riskweave.operators.results import unwrap_first

    found = unwrap_first(numbered_lines(read_lines(spark, path)))
    parsed = found.withColumn("example", F.try_parse_json(F.when(F.ltrim("content").startswith("{"), F.col("content"))))
    name = F.lit(split) if split else split_of_file(F.col("batch_file"), F.col("folder"))
    return parsed.filter("example is not null").withColumn("split", name).drop("folder")


def read_batch_results_alt(spark: SparkSession, path: str) -> DataFrame:
    """Second provider's result files: first content block of succeeded results."""
    from riskweave.operators.results import unwrap_second

    return unwrap_second(read_lines(spark, path).select("line", "batch_file"))


def _documents(spark: SparkSession, folder: str, pattern: str, ddl: str) -> DataFrame:
    """One JSON document per file; broken files are skipped."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    return _parsed(whole, with_corrupt_column(ddl), keep_bad=False)


def read_sessions(spark: SparkSession, folder: str, pattern: str = "session.json") -> DataFrame:
    """One session per run folder, newest first."""
    return _documents(spark, folder, pattern, schema.SESSION_DDL).filter("session_id is not null").orderBy(F.desc("start_time"))


def read_batch_log(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """One document per session holding maps batch id -> record; one row per batch."""
    record = "struct<" + ",".join(f"{n}:{t}" for n, t in _fields(schema.BATCH_DDL) if n != "batch_id") + ">"
    batches = f"map<string,{record}>"
    rows = _documents(spark, folder, pattern, f"active_batches {batches}, completed_batches {batches}")
    nothing = F.create_map().cast(batches)
    both = F.map_concat(F.coalesce("active_batches", nothing), F.coalesce("completed_batches", nothing))
    return rows.select(F.explode(both).alias("batch_id", "b")).select("batch_id", "b.*")


def read_puzzle_json(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Puzzle files, one row each, examples in one array; the name is the file stem unless the file gives one."""
    rows = (
        spark.read.schema(schema.PUZZLE_FILE_DDL).option("multiLine", True).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).json(folder)
    )
    kinds = lambda column, kind: F.transform(
        F.coalesce(column, F.array()), lambda e: F.struct(F.lit(kind).alias("kind"), e["input"].alias("input"), e["output"].alias("output"))
    )
    stem = F.regexp_replace("_metadata.file_name", r"\.json$", "")
    parent = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return rows.select(
        F.coalesce("name", stem).alias("puzzle_id"), parent.alias("subset"), F.concat(kinds(F.col("train"), "train"), kinds(F.col("test"), "test")).alias("examples")
    )


def read_puzzle_csv(spark: SparkSession, path: str, min_difficulty: int | None = None, cells: int = 81) -> DataFrame:
    """Boards of a CSV with header (source, q, a, rating): cells as digits, '.' as 0; a wrong length fails the job."""
    rows = spark.read.schema(schema.BOARD_DDL).option("header", True).csv(path)
    if min_difficulty is not None:
        rows = rows.filter(F.col("rating") >= min_difficulty)
    digits = lambda c: F.transform(characters(F.replace(c, F.lit("."), F.lit("0"))), lambda d: d.cast("int"))
    right = (F.length("q") == cells) & (F.length("a") == cells)
    checked = F.when(right, F.col("q")).otherwise(F.raise_error(F.concat(F.lit("board without 81 cells: "), F.col("q"))))
    return rows.withColumn("q", checked).withColumns({"q": digits(F.col("q")), "a": digits(F.col("a"))})


def _fields(ddl: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ddl).fields]


def with_corrupt_column(ddl: str):
    from pyspark.sql.types import StringType, StructType

    return StructType.fromDDL(ddl).add(_CORRUPT, StringType())
