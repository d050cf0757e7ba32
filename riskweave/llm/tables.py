"""Reading the given tables and passing whole Arrow rows through tasks in small pieces."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20  # text that one vectorised step works on; a single longer text makes a piece of its own


_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def share_package(spark: SparkSession) -> None:
    """Workers started elsewhere than in the repository find the package too (a cluster installs it as usual)."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _HOME not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, _HOME) if x)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a given table (all, if none is named)."""
    share_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_sample(docs: DataFrame, n: int, seed: int, text: str = "text") -> DataFrame:
    """The n distinct texts with the smallest hash: only hashes are sorted, and no more than n texts leave a scan."""
    hashed = docs.select(F.col(text).alias("text")).filter("text is not null").withColumn("_h", F.xxhash64(F.lit(seed), "text"))
    last = hashed.select("_h").distinct().orderBy("_h").limit(n).agg(F.max("_h")).first()[0]
    return hashed.filter(F.col("_h") <= F.lit(last)).dropDuplicates(["_h"]).select("text")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def pieces(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in pieces of about ``size`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets of the rows; a null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
