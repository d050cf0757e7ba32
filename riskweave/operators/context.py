"""Recipient and context analysis as DataFrame jobs. Lookups are literals, so each job is one pass without shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.fixed import recipients as fixed
from riskweave.functions import labels as L
from riskweave.functions import recipients as R


def infer_sender_domain(df: DataFrame, out: str = "sender_domain") -> DataFrame:
    return df.withColumn(out, R.infer_sender_domain(F.col("recipients"), F.col("body")))


def categorize_recipients(df: DataFrame, sender_domain: str = "sender_domain") -> DataFrame:
    """Adds kinds (per recipient), four counts and risk factors."""
    with_kinds = df.withColumn("recipient_kinds", R.recipient_kinds(F.col("recipients"), F.col(sender_domain)))
    kinds = F.col("recipient_kinds")
    return with_kinds.withColumns(
        {
            "internal_count": R.kind_count(kinds, "internal"),
            "external_business_count": R.kind_count(kinds, "external_business"),
            "external_personal_count": R.kind_count(kinds, "external_personal"),
            "high_risk_count": R.kind_count(kinds, "high_risk"),
            "risk_factors": R.recipient_risk_factors(kinds),
        }
    )


def classify_domains(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Adds domain_kind and domain_type."""
    return df.withColumns(
        {"domain_kind": R.domain_kind(F.col(domain)), "domain_type": R.domain_type(F.col(domain))}
    )


def authorized_sharing(df: DataFrame, relationships=None, out: str = "authorized") -> DataFrame:
    """Needs spans; ``relationships`` (dicts as in the fixed table) replaces or extends the known ones."""
    content = F.concat_ws(" ", "subject", "body")
    return df.withColumn(
        out,
        R.authorized_sharing(
            F.col("spans"), F.col("user.role"), R.plain_domains(F.col("recipients")), content, relationships
        ),
    )


def sharing_labels(df: DataFrame, sender_domain: str = "sender_domain", out: str = "sharing") -> DataFrame:
    content = F.concat_ws(" ", "subject", "body")
    return df.withColumn(
        out,
        R.sharing_labels(F.col("spans"), F.col("user.role"), F.col("recipients"), content, F.col(sender_domain)),
    )


def content_indicators(df: DataFrame, text: str = "body") -> DataFrame:
    """Adds one count per legitimate category, their names and the suspicious count."""
    categories = list(fixed.LEGITIMATE_PATTERNS)
    columns = {**{f"legit_{k}": F.col("_counts")[k] for k in categories}, "suspicious": F.col("_counts.suspicious")}
    counted = df.withColumn("_counts", R.content_counts(F.col(text))).withColumns(columns).drop("_counts")
    names = F.array_compact(F.array(*[F.when(F.col(f"legit_{k}") > 0, F.lit(k)) for k in categories]))
    return counted.withColumn("legit_categories", names)


def role_indicators(df: DataFrame, role: str = "role", out: str = "evidence") -> DataFrame:
    return df.withColumn(out, R.role_evidence(F.col(role), F.col("body"), F.col("spans")))


def sharing_analysis(df: DataFrame, role: str = "role", sender_domain: str = "sender_domain") -> DataFrame:
    """Adds counts, exposure and context scores and labels; needs spans."""
    return df.withColumn(
        "sharing",
        L.sharing_analysis(F.col("spans"), F.col(role), F.col("recipients"), F.col("body"), F.col(sender_domain)),
    )


def primary_domain(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "primary_domain": R.primary_domain(F.concat_ws(" ", "subject", "body")),
            "recipient_risk": R.recipient_risk(F.col("recipients")),
        }
    )


def infer_risk_level(df: DataFrame, out: str = "current_risk") -> DataFrame:
    return df.withColumn(out, R.infer_risk_level(F.col("recipients"), F.col("body")))


def infer_user_role(df: DataFrame, agent: str | None = None, out: str = "inferred_role") -> DataFrame:
    return df.withColumn(
        out, R.infer_user_role(F.col("subject"), F.col("body"), F.col(agent) if agent else None)
    )


def infer_agent_from_content(df: DataFrame, out: str = "inferred_agent") -> DataFrame:
    return df.withColumn(out, R.infer_agent(F.col("subject"), F.col("body")))
