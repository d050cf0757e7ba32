"""Labelling jobs: each adds label columns to a message table. All per row; no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import labels as L
from riskweave.functions import obfuscation
from riskweave.functions import recipients as R
from riskweave.functions import spans as S


def combined_text() -> Column:
    """Subject, body and attachment names in one text."""
    names = F.array_join(F.transform("attachments", lambda a: a["name"]), ", ")
    attached = F.when(F.size("attachments") > 0, F.concat(F.lit("\n\nAttachments: "), names)).otherwise("")
    return F.concat("subject", F.lit("\n\n"), "body", attached)


def label_pattern(df: DataFrame, noise: float = 0.0, seed: int = 42, out: str = "labels") -> DataFrame:
    return df.withColumn(
        out,
        L.pattern_labels(
            F.col("subject"), F.col("body"), F.col("recipients"), F.col("attachments"), noise, seed, F.col("msg_id")
        ),
    )


def label_contextual(
    df: DataFrame, noise: float = 0.0, seed: int = 42, out: str = "contextual_labels", overwrite: bool = True
) -> DataFrame:
    """Adds the contextual labels, and the same ones as ``labels``; ``overwrite=False`` leaves labels that are there."""
    scores = L.contextual_labels(
        F.col("user"), F.col("subject"), F.col("body"), F.col("recipients"), F.col("attachments"), noise, seed,
        F.col("msg_id"),
    )
    labelled = df.withColumn(out, scores)
    return labelled if "labels" in df.columns and not overwrite else labelled.withColumn("labels", F.col(out))


def label_spans(df: DataFrame, agent: str | None = None) -> DataFrame:
    """Post-processing form: role, sender domain, spans of the combined text, sharing analysis and binary heads."""
    agent_column = F.col(agent) if agent else None
    prepared = df.withColumns(
        {
            "combined": combined_text(),
            "inferred_role": R.infer_user_role(F.col("subject"), F.col("body"), agent_column),
            "sender_domain": R.infer_sender_domain(F.col("recipients"), F.col("body")),
        }
    )
    detected = prepared.withColumn("spans", S.detect("combined", "full"))
    analysed = detected.withColumn(
        "sharing",
        L.sharing_analysis(
            F.col("spans"), F.col("inferred_role"), F.col("recipients"), F.col("body"), F.col("sender_domain")
        ),
    )
    labels = L.heads(
        L.span_sensitivity(F.col("spans"), F.col("inferred_role")),
        F.col("sharing.exposure"),
        F.col("sharing.context"),
        obfuscation.is_obfuscated(F.col("combined")),
        "int",
    )
    return analysed.withColumn("labels", labels)


def label_converter(df: DataFrame) -> DataFrame:
    """Binary heads in the converter form; needs ``spans`` (converter rule set on the body)."""
    return df.withColumn(
        "labels",
        L.converter_labels(F.col("user"), F.col("body"), F.col("recipients"), F.col("attachments"), F.col("spans")),
    )


def label_generator(df: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Binary heads with a scenario override; needs ``spans`` (generator rule set on the body)."""
    return df.withColumn(
        "labels",
        L.generator_labels(F.col("user"), F.col("body"), F.col("recipients"), F.col("spans"), F.col(scenario)),
    )


def label_synth(df: DataFrame, obfuscated: str = "obfuscated") -> DataFrame:
    """Binary heads of synthetic messages; needs ``spans`` (synth rule set on the body)."""
    return df.withColumn(
        "labels", L.synth_labels(F.col("user.role"), F.col("recipients"), F.col("spans"), F.col(obfuscated))
    )


def label_simple(df: DataFrame) -> DataFrame:
    """Sensitivity from four span types, exposure and context from personal recipients; needs ``spans``."""
    return df.withColumn("labels", L.simple_labels(F.col("recipients"), F.col("body"), F.col("spans")))


def quality_score(df: DataFrame, variant: str = "full", out: str = "quality") -> DataFrame:
    """Quality in [0, 1] by variant: full, manager, helper, recovery. All but helper read ``n_spans``."""
    subject, body, recipients = F.col("subject"), F.col("body"), F.col("recipients")
    if variant == "full":
        score = L.quality_full(subject, body, recipients, F.col("user"), F.col("n_spans"))
    elif variant == "manager":
        score = L.quality_manager(subject, body, recipients, F.col("n_spans"))
    elif variant == "helper":
        score = L.quality_helper(subject, body, recipients)
    elif variant == "recovery":
        score = L.quality_recovery(subject, body, recipients, F.col("n_spans"))
    else:
        raise ValueError(f"unknown quality variant {variant!r}")
    return df.withColumn(out, score)


QUALITY_MINIMUM = {"full": 0.7, "manager": 0.7, "helper": 0.7, "recovery": 0.3}


def filter_quality(df: DataFrame, variant: str = "full", minimum: float | None = None) -> DataFrame:
    limit = QUALITY_MINIMUM[variant] if minimum is None else minimum
    return quality_score(df, variant).filter(F.round("quality", 9) >= limit)


def decide(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Adds decision, risk_level, primary_concern, confidence, early_decision and risk."""
    column = F.col(scores)
    return df.withColumn("_d", L.decide(column)).select(
        *df.columns, "_d.*", L.decide_early(column).alias("early_decision"), L.risk_score(column).alias("risk")
    )


def score_with(df: DataFrame, scorer: Callable[[DataFrame], DataFrame] | Column, out: str = "scores") -> DataFrame:
    """Scores from a caller's function: a pandas UDF column giving the four heads, or a DataFrame transform
    (``mapInPandas``). Stands where a model or a remote labeler would be called."""
    return df.withColumn(out, scorer) if isinstance(scorer, Column) else df.transform(scorer)
