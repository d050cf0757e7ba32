"""Token counts through a digest cache (operator 13).

The count of a text depends only on its content and on the tokenizer, so counts are stored under both digests:

* content: SHA-256 of the normal form of the text. Two texts have one normal form only if the tokenizer can't tell them
  apart: a null is the empty text, and where a sentencepiece model writes blanks as U+2581, that character is a blank.
* tokenizer: SHA-256 of kind, library version and file. It names the folder of the cache, so counts of another
  tokenizer, version or file are never read.

One run:

1. One scan makes the narrow table (id, bytes, content digest), which is written once. Texts stay where they are.
2. Distinct digests are looked up in the cache. What isn't found is a miss.
3. Each distinct miss is encoded once: the texts of misses (only they) lose their repeats inside a task, meet by digest
   and are encoded where they meet. Few misses are broadcast to filter texts before the shuffle (``FEW`` digests at
   most), else both sides are joined by digest.
4. The new counts are appended. A row of the cache is a fact, so an append that ends half-way or two at once do no harm;
   readers take one row a digest.
5. The narrow table is joined to the cache. Digests that hold over 1 / ``HOT`` of all rows (so fewer than ``HOT``) go by
   broadcast, the others by a join on the digest: no task gets more than 1 / ``HOT`` of the rows for one key.

Defined results: one row per row of the table, whatever its id (null and repeated ids too); null and empty texts have
0 bytes and the tokenizer's count of the empty text; an empty table gives no rows and writes nothing. Texts are
encoded whole, however long. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.tables import pieces, share_package
from riskweave.session import reliable_checkpoint

FEW = 100_000  # digests: 3.2 MB
HOT = 10_000
CACHE_SCHEMA = "digest binary, n_tokens long"
_BLANK = "▁"  # the visible blank of sentencepiece


@dataclass(frozen=True)
class Tokenizer:
    """A public tokenizer file: its bytes travel with the job, so that counts belong to the digest on every machine."""

    kind: str
    data: bytes
    digest: str
    blank: bool

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, "rb") as file:
            data = file.read()
        if path.endswith(".model"):
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2

            model = sentencepiece_model_pb2.ModelProto()
            model.ParseFromString(data)
            spec = model.normalizer_spec
            kind, version = "sentencepiece", sentencepiece.__version__
            blank = spec.name == "identity" and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        elif path.endswith(".json"):
            import tokenizers

            kind, version, blank = "tokenizers", tokenizers.__version__, False
        else:
            raise ValueError(f"neither a .model nor a .json file: {path}")
        digest = hashlib.sha256(f"{kind} {version}\n".encode() + data).hexdigest()
        return cls(kind, data, digest, blank)

    def normal_form(self, text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        return F.translate(text, _BLANK, " ") if self.blank else text

    def counter(self) -> Callable[[Sequence[str]], list[int]]:
        """Counts of texts as the library gives them: no added tokens, no truncation, no padding."""
        if self.kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(ids) for ids in model.encode(list(texts), num_threads=1)]
        import tokenizers

        model = tokenizers.Tokenizer.from_str(self.data.decode())
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(e.ids) for e in model.encode_batch(list(texts), add_special_tokens=False)]


_COUNTERS: dict[str, Callable] = {}  # one a worker


def _counter(tokenizer: Tokenizer) -> Callable:
    if tokenizer.digest not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[tokenizer.digest] = tokenizer.counter()
    return _COUNTERS[tokenizer.digest]


def cache_folder(cache: str, tokenizer: Tokenizer) -> str:
    return f"{cache}/tokenizer={tokenizer.digest}"


def read_cache(spark: SparkSession, cache: str, tokenizer: Tokenizer) -> DataFrame:
    """digest, n_tokens of this tokenizer: one row a digest."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_folder(cache, tokenizer))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _new_digests(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """Rows whose digest is not in ``seen``, which learns them."""
    keep = np.zeros(batch.num_rows, bool)
    for i, digest in enumerate(batch.column("digest").to_pylist()):
        if digest not in seen:
            seen.add(digest)
            keep[i] = True
    return batch.filter(pa.array(keep))


def _first_of_task(batches):
    seen = set()
    for batch in batches:
        yield _new_digests(batch, seen)


def encode_misses(texts: DataFrame, misses: DataFrame, n: int, tokenizer: Tokenizer) -> DataFrame:
    """digest, n_tokens of the ``n`` missing digests, each encoded once. texts: digest, text."""
    if n <= FEW:
        found = texts.join(F.broadcast(misses), "digest", "left_semi").select("digest", "text")
        once = found.mapInArrow(_first_of_task, found.schema).repartition("digest")
    else:
        # merge: a broadcast chosen after the shuffle would read by map task, and digests wouldn't meet
        once = texts.mapInArrow(_first_of_task, texts.schema).join(misses.hint("merge"), "digest", "left_semi")
    shared = texts.sparkSession.sparkContext.broadcast(tokenizer)

    def encoded(batches):
        count, seen = _counter(shared.value), set()
        for piece in pieces(batches):
            piece = _new_digests(piece, seen)
            if piece.num_rows:
                counts = count(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"digest": piece.column("digest").cast(pa.binary()), "n_tokens": pa.array(counts, pa.int64())})

    return once.select("digest", "text").mapInArrow(encoded, CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row. ``cache``: a folder that all executors share; it grows by the misses."""
    spark = docs.sparkSession
    share_package(spark)
    tokenizer = Tokenizer.load(tokenizer_path)
    normal = tokenizer.normal_form(F.col(text))
    digest = F.unhex(F.sha2(normal, 256)).alias("digest")
    rows = reliable_checkpoint(
        docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), digest)
    )
    contents = reliable_checkpoint(
        rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).join(read_cache(spark, cache, tokenizer), "digest", "left")
    )
    size = contents.agg(F.sum("copies").alias("rows"), F.count_if(F.col("n_tokens").isNull()).alias("misses")).first()
    if size.misses:
        missing = contents.filter("n_tokens is null").select("digest")
        counts = encode_misses(docs.select(digest, normal.alias("text")), missing, size.misses, tokenizer)
        counts.write.mode("append").parquet(cache_folder(cache, tokenizer))
    stored = read_cache(spark, cache, tokenizer)
    hot = contents.filter(F.col("copies") * HOT > F.lit(size.rows or 0)).select("digest").join(stored, "digest")
    placed = rows.join(F.broadcast(hot), "digest", "left")
    rest = placed.filter("n_tokens is null").drop("n_tokens").join(stored, "digest")
    return placed.filter("n_tokens is not null").unionByName(rest).select("doc_id", "n_bytes", "n_tokens")
