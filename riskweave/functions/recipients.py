"""Recipient and content analysis of one message. Lookups are literals in the expression, so no join or shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.fixed import recipients as fixed
from riskweave.functions.spans import count_types, has_type, let
from riskweave.functions.text import (
    address_domains,
    all_of,
    any_of,
    array_contains_any,
    contains_any,
    count_contained,
    email_domain,
    flagged,
    is_in,
    let_counts,
    lookup,
    matches,
    total,
)


def _known_outside(domain: Column) -> Column:
    return is_in(domain, fixed.PERSONAL_DOMAINS + fixed.HIGH_RISK_DOMAINS)


def infer_sender_domain(recipients: Column, body: Column) -> Column:
    """Most frequent recipient domain that is neither personal nor high risk (ties: first seen); else the first such
    domain in the body; else a fixed default."""

    def most_frequent(domains: Column) -> Column:
        counted = F.transform(
            F.array_distinct(domains),
            lambda d, i: F.struct(F.size(F.filter(domains, lambda x: x == d)).alias("n"), (-i).alias("early"), d.alias("d")),
        )
        return F.array_max(counted)["d"]

    from_recipients = let(F.filter(address_domains(recipients), lambda d: ~_known_outside(d)), most_frequent)
    mentioned = F.transform(
        F.regexp_extract_all(body, F.lit(flagged(fixed.BODY_DOMAIN_PATTERN)), F.lit(1)), F.lower
    )
    from_body = F.when(body.contains("@"), F.get(F.filter(mentioned, lambda d: ~_known_outside(d)), F.lit(0)))
    return F.coalesce(from_recipients, from_body, F.lit(fixed.FALLBACK_SENDER_DOMAIN))


def recipient_kinds(recipients: Column, sender_domain: Column) -> Column:
    """(recipient, domain, kind) for every recipient with an '@'."""

    def kind(domain: Column) -> Column:
        return (
            F.when((sender_domain != "") & (domain == F.lower(sender_domain)), "internal")
            .when(is_in(domain, fixed.PERSONAL_DOMAINS), "external_personal")
            .when(is_in(domain, fixed.HIGH_RISK_DOMAINS), "high_risk")
            .otherwise("external_business")
        )

    return F.transform(
        F.filter(recipients, lambda r: r.contains("@")),
        lambda r: F.struct(r.alias("recipient"), email_domain(r).alias("domain"), kind(email_domain(r)).alias("kind")),
    )


def kind_count(kinds: Column, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k["kind"] == kind))


def recipient_risk_factors(kinds: Column) -> Column:
    risky = F.filter(kinds, lambda k: k["kind"].isin("external_personal", "high_risk"))
    return F.transform(
        risky,
        lambda k: F.concat(
            F.when(k["kind"] == "high_risk", "High-risk domain: ").otherwise("Personal email domain: "), k["domain"]
        ),
    )


def domain_kind(domain: Column) -> Column:
    """personal / high_risk / government / education / business. The business patterns are anchored at the start and
    come before the suffix tests."""
    d = F.lower(domain)
    business = any_of([d.rlike("^(?:" + p + ")") for p in fixed.BUSINESS_DOMAIN_PATTERNS])
    return (
        F.when(is_in(d, fixed.PERSONAL_DOMAINS), "personal")
        .when(is_in(d, fixed.HIGH_RISK_DOMAINS), "high_risk")
        .when(business, "business")
        .when(d.endswith(".gov"), "government")
        .when(d.endswith(".edu"), "education")
        .otherwise("business")
    )


def domain_type(domain: Column) -> Column:
    """First type with a matching pattern, else 'unknown'. The patterns of a type are one alternation."""
    d = F.lower(domain)
    result = None
    for kind, patterns in fixed.DOMAIN_TYPE_PATTERNS.items():
        hit = d.rlike("^(?:" + "|".join(patterns) + ")")
        result = (F if result is None else result).when(hit, F.lit(kind))
    return result.otherwise(F.lit("unknown"))


# -- authorised sharing -----------------------------------------------------------------------------------------


def authorized_sharing(spans: Column, role: Column, domains: Column, content: Column, relationships=None) -> Column:
    """True if some relationship allows the role, keyword, span types and a recipient domain type together."""
    lower = F.lower(content)
    types = F.transform(domains, domain_type)
    return any_of(
        [
            all_of(
                [
                    is_in(role, r["roles"]),
                    contains_any(lower, r["keywords"]),
                    has_type(spans, r["data_types"]),
                    array_contains_any(types, r["domain_types"]),
                ]
            )
            for r in (relationships or fixed.RELATIONSHIPS)
        ]
    )


def plain_domains(recipients: Column) -> Column:
    """Text after the last '@' of every address, case kept."""
    return F.transform(F.filter(recipients, lambda r: r.contains("@")), lambda r: F.substring_index(r, "@", -1))


def sharing_labels(spans: Column, role: Column, recipients: Column, content: Column, sender_domain: Column) -> Column:
    """struct<personal, authorized, internal_only, exposure, context>."""
    domains = plain_domains(recipients)
    personal = F.exists(domains, lambda d: domain_type(d) == "personal")
    authorized = authorized_sharing(spans, role, domains, content)
    internal_only = (sender_domain != "") & F.forall(domains, lambda d: d == sender_domain)
    base = F.struct(personal.alias("p"), authorized.alias("a"), F.coalesce(internal_only, F.lit(False)).alias("i"))
    return let(
        base,
        lambda b: F.struct(
            b["p"].alias("personal"),
            b["a"].alias("authorized"),
            b["i"].alias("internal_only"),
            (b["p"] | ((F.size(domains) > 0) & ~b["a"] & ~b["i"])).cast("int").alias("exposure"),
            (b["a"] | b["i"]).cast("int").alias("context"),
        ),
    )


# -- content indicators -----------------------------------------------------------------------------------------


def content_counts(body: Column) -> Column:
    """struct of the matches per legitimate category, and of the suspicious patterns (``suspicious``), from one pass for words."""
    groups = {**fixed.LEGITIMATE_PATTERNS, "suspicious": fixed.SUSPICIOUS_PATTERNS}
    patterns = [p for group in groups.values() for p in group]
    return let_counts(body, patterns, lambda count: F.struct(*[total([count[p] for p in group]).alias(k) for k, group in groups.items()]))


def role_evidence(role: Column, body: Column, spans: Column) -> Column:
    """How many pieces of evidence support the sender's role."""
    upper = F.upper(role)
    result = None
    for name, evidence in fixed.ROLE_EVIDENCE.items():
        hits = total(
            [
                (matches(body, pattern, True) if pattern else has_type(spans, types)).cast("int")
                for pattern, types in evidence
            ]
        )
        result = (F if result is None else result).when(upper == name, hits)
    return result.otherwise(F.lit(0))


def exposure_score(personal: Column, high_risk: Column, business: Column, spans: Column, suspicious: Column) -> Column:
    return (
        F.when(personal > 0, 3).otherwise(0)
        + F.when(high_risk > 0, 4).otherwise(0)
        + F.when(business > 0, 1).otherwise(0)
        + 2 * count_types(spans, fixed.HIGH_SENSITIVITY_TYPES)
        + suspicious
    )


def context_score(
    indicators: Column, role_fits: Column, internal: Column, business: Column, personal: Column, high_risk: Column,
    suspicious: Column,
) -> Column:
    return (
        indicators
        + F.when(role_fits, 2).otherwise(0)
        + F.when(internal > 0, 1).otherwise(0)
        + F.when((business > 0) & (personal == 0), 1).otherwise(0)
        - 2 * suspicious
        - 2 * personal
        - 3 * high_risk
    )


# -- domain, risk and role from content -------------------------------------------------------------------------


def primary_domain(content: Column) -> Column:
    """struct<domain, hits>: keyword list with most hits (ties: list order); 'general' without any hit."""
    lower = F.lower(content)
    scored = F.array(
        *[
            F.struct(count_contained(lower, words).alias("hits"), F.lit(-i).alias("early"), F.lit(name).alias("domain"))
            for i, (name, words) in enumerate(fixed.PRIMARY_DOMAIN_KEYWORDS.items())
        ]
    )
    return let(
        F.array_max(scored),
        lambda best: F.struct(
            F.when(best["hits"] > 0, best["domain"]).otherwise("general").alias("domain"), best["hits"].alias("hits")
        ),
    )


def recipient_risk(recipients: Column) -> Column:
    """high (personal provider), medium (competitor-like or outside address), else low."""
    personal = F.exists(recipients, lambda r: contains_any(F.lower(r), fixed.CONVERTER_PERSONAL_DOMAINS))
    competitor = F.exists(recipients, lambda r: contains_any(F.lower(r), fixed.COMPETITOR_WORDS))
    outside = F.exists(recipients, lambda r: r.contains("@") & ~r.endswith(".internal") & ~r.startswith("#"))
    return F.when(personal, "high").when(competitor | outside, "medium").otherwise("low")


def infer_risk_level(recipients: Column, body: Column) -> Column:
    lower = F.lower(body)
    personal = F.exists(recipients, lambda r: contains_any(r, fixed.RISK_PERSONAL_DOMAINS))
    business = contains_any(lower, fixed.RISK_BUSINESS_WORDS)
    casual = contains_any(lower, fixed.RISK_CASUAL_WORDS)
    return (
        F.when(personal & ~business, "high_risk")
        .when(casual, "medium_risk")
        .when(business, "low_risk")
        .otherwise("medium_risk")
    )


def infer_user_role(subject: Column, body: Column, agent: Column | None = None) -> Column:
    """Role of a known agent (null for an unknown one); without an agent, the first keyword list with a hit."""
    content = F.lower(F.concat_ws(" ", subject, body))
    ladder = None
    for role, words in fixed.ROLE_WORDS.items():
        ladder = (F if ladder is None else ladder).when(contains_any(content, words), F.lit(role))
    ladder = ladder.otherwise(F.lit(fixed.DEFAULT_ROLE))
    if agent is None:
        return ladder
    return F.when(agent.isNull(), ladder).otherwise(lookup(agent, fixed.AGENT_ROLE, None))


def infer_agent(subject: Column, body: Column) -> Column:
    subject, body = F.lower(subject), F.lower(body)
    return (
        F.when(subject.contains("legal") | body.contains("contract"), "legal_agent")
        .when(subject.contains("finance") | body.contains("payment"), "finance_agent")
        .when(subject.contains("hr") | body.contains("employee"), "hr_agent")
        .otherwise("clean_business")
    )
