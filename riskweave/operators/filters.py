"""Validity filters of the corpus jobs. Conditions are boolean columns; each job is one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.fixed import corpus
from riskweave.functions import obfuscation
from riskweave.functions.text import (
    all_of,
    any_of,
    array_contains_any,
    contains_any,
    is_in,
    lookup,
    matches,
    named_flags,
)


def _present(column: str) -> Column:
    return F.coalesce(F.length(column) > 0, F.lit(False))


def example_issues(n_spans: Column | None = None) -> Column:
    """Names of what is wrong with a converted message (``spans`` or a span count)."""
    count = F.size("spans") if n_spans is None else n_spans
    return named_flags(
        {
            "Body too short or empty": F.coalesce(F.length("body"), F.lit(0)) < 10,
            "No recipients": F.coalesce(F.size("recipients"), F.lit(0)) <= 0,
            "Too many spans (>20)": count > 20,
            "Contains placeholder text": F.coalesce(F.lower("body").contains("lorem ipsum"), F.lit(False)),
        }
    )


def check_examples(df: DataFrame) -> DataFrame:
    """Adds ``issues``; a valid message has none."""
    return df.withColumn("issues", example_issues())


def filter_valid_examples(df: DataFrame) -> DataFrame:
    return df.filter(F.size(example_issues()) == 0)


def is_valid_generated(min_length: int = 50, max_length: int = 2000) -> Column:
    lower = F.lower("body")
    return all_of(
        [
            _present("body"),
            _present("subject"),
            F.coalesce(F.col("user").isNotNull(), F.lit(False)),
            F.coalesce(F.size("recipients") > 0, F.lit(False)),
            F.length("body").between(min_length, max_length),
            ~contains_any(lower, ["lorem ipsum", "placeholder"]),
        ]
    )


def filter_valid_generated(df: DataFrame, min_length: int = 50, max_length: int = 2000) -> DataFrame:
    return df.filter(is_valid_generated(min_length, max_length))


def has_span_count(low: int, high: int) -> Column:
    return F.size("spans").between(low, high)


def follows_agent_rules(agent: str = "agent", rules=None) -> Column:
    """An agent without rules passes; otherwise a required term in the body and a role of the list."""
    lower, role = F.lower("body"), F.col("user.role")
    result = None
    for name, (terms, roles) in (rules or corpus.AGENT_RULES).items():
        result = (F if result is None else result).when(
            F.col(agent) == name, contains_any(lower, terms) & is_in(role, roles)
        )
    return result.otherwise(F.lit(True))


def filter_agent_rules(df: DataFrame, agent: str = "agent", rules=None) -> DataFrame:
    return df.filter(follows_agent_rules(agent, rules))


def valid_attachments(attachments: str = "attachments") -> Column:
    """Every attachment has name, positive size, mime, summary and at least one indicator; no attachment passes."""
    complete = lambda a: all_of(
        [
            F.coalesce(F.length(a["name"]) > 0, F.lit(False)),
            F.coalesce(a["size"] > 0, F.lit(False)),
            F.coalesce(F.length(a["mime"]) > 0, F.lit(False)),
            F.coalesce(F.length(a["content_summary"]) > 0, F.lit(False)),
            F.coalesce(F.size(a["sensitivity_indicators"]) > 0, F.lit(False)),
        ]
    )
    return F.forall(F.coalesce(F.col(attachments), F.array()), complete)


def follows_domain_rules(domain: str, rules=None) -> Column:
    """Term, role, complete attachments, and in each attachment an indicator of the domain."""
    terms, roles, indicators = (rules or corpus.DOMAIN_RULES)[domain]
    fitting = F.forall("attachments", lambda a: array_contains_any(a["sensitivity_indicators"], indicators))
    return (
        contains_any(F.lower("body"), terms) & is_in(F.col("user.role"), roles) & valid_attachments() & fitting
    )


def filter_domain_examples(df: DataFrame, domain: str, rules=None) -> DataFrame:
    return df.filter(follows_domain_rules(domain, rules))


def is_casual() -> Column:
    lower = F.lower("body")
    return contains_any(lower, corpus.CASUAL_TERMS) & ~contains_any(lower, corpus.FORMAL_TERMS)


def is_clean() -> Column:
    lower = F.lower("body")
    sensitive = any_of([matches(F.col("body"), p) for p in corpus.CLEAN_FORBIDDEN_PATTERNS])
    return contains_any(lower, corpus.CLEAN_TERMS) & ~contains_any(lower, corpus.CLEAN_FORBIDDEN_WORDS) & ~sensitive


def sophistication(risk_level: str = "risk_level") -> Column:
    return lookup(F.col(risk_level), corpus.RISK_SOPHISTICATION, corpus.DEFAULT_SOPHISTICATION)


def is_obfuscated_enough(risk_level: str = "risk_level") -> Column:
    """At least two techniques for high sophistication, else one."""
    return F.size(obfuscation.techniques(F.col("body"))) >= F.when(sophistication(risk_level) == "high", 2).otherwise(1)


def filter_casual(df: DataFrame) -> DataFrame:
    return df.filter(is_casual())


def filter_clean(df: DataFrame) -> DataFrame:
    return df.filter(is_clean())


def filter_obfuscated(df: DataFrame, risk_level: str = "risk_level") -> DataFrame:
    return df.filter(is_obfuscated_enough(risk_level))
