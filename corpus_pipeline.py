"""Documents to training token files: the stages of a corpus pipeline, each an operator of ``riskweave.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next; all
but the last return the columns of ``docs``. Rows keep their text: stages only decide which rows go on.

1. toxicity: documents that the classifier chain finds toxic go.
2. near_duplicates: one document of each group of exact and near copies stays (five-word shingles, similarity .8).
3. decontamination: documents that hold a benchmark item go.
4. mixing: documents are sampled by probabilities raked to source, language and topic targets.
5. token_files: the rest is encoded and written as wavelet matrices; returns what the files hold per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.decontamination import drop_contaminated
from riskweave.llm.mixing import mix
from riskweave.llm.near_copies import one_of_each
from riskweave.llm.queries import CATEGORIES, tokenizer_path
from riskweave.llm.tables import read_table, share_package
from riskweave.llm.token_files import round_trip, scratch_folder
from riskweave.llm.toxicity import drop_category, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on the labels of these documents, doesn't find toxic."""
    labels = read_table(spark, sf_dir, "labels")
    return drop_category(docs, train(docs, labels, CATEGORIES), "toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, the one with the smallest id."""
    share_package(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities calibrated to source, language and topic targets."""
    share_package(spark)
    return mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the written token files."""
    share_package(spark)
    return round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]
ORACLE_SQL = None  # learned, iterative and whole-text steps that SQL can't say


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; what each stage returns is written below the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
