"""Label expressions: every labeler returns a struct of the four heads."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.fixed import labels as fixed
from riskweave.fixed import recipients as recipients_fixed
from riskweave.functions import obfuscation
from riskweave.functions.hashing import uniform
from riskweave.functions.recipients import (
    content_counts,
    context_score,
    exposure_score,
    kind_count,
    recipient_kinds,
    role_evidence,
)
from riskweave.functions.spans import count_types, has_type
from riskweave.functions.text import (
    any_of,
    array_contains_any,
    contains_any,
    count_contained,
    email_domain,
    gated_count,
    is_in,
    let,
    let_counts,
    let_gates,
    lookup,
    total,
)


def heads(sensitivity: Column, exposure: Column, context: Column, obfuscated: Column, kind: str = "double") -> Column:
    values = zip(fixed.HEADS, (sensitivity, exposure, context, obfuscated))
    return F.struct(*[v.cast(kind).alias(h) for h, v in values])


def _sum_over(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))


def _clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


# -- graded pattern labels --------------------------------------------------------------------------------------


def pattern_scores(text: Column, names: Sequence[str]) -> Column:
    """struct of the named heads: per head the sum over patterns of weight x min(0.3 x matches, 1), capped at 1.

    Of most patterns only those are counted whose words begin somewhere in the text.
    """
    groups = {h: [(weight, p) for weight, group in fixed.PATTERN_GROUPS[h].values() for p in group] for h in names}

    def scored(count: dict[str, Column]) -> Column:
        def score(head: str) -> Column:
            parts = [F.lit(w) * F.least(count[p] * F.lit(fixed.MATCH_STEP), F.lit(1.0)) for w, p in groups[head]]
            return F.least(total(parts), F.lit(1.0))

        return F.struct(*[score(h).alias(h) for h in names])

    patterns = [p for h in names for _, p in groups[h]]
    return let(F.lower(text), lambda lower: let_counts(lower, patterns, scored))


def pattern_score(text: Column, head: str) -> Column:
    """Score of one head."""
    return pattern_scores(text, [head])[head]


# -- the same on texts with a few characters cut off ----------------------------------------------------------------

EDGE = 512  # characters at an end in which a cut can change what matches
_LONGEST = 40  # a match of the patterns counted by edges is shorter: EDGE holds twelve of them, one behind another


def _short(pattern: str) -> bool:
    """Whether matches have a bounded length and depend on nothing behind them."""
    return not re.search(r"[*+]|,\}|\(\?", pattern)


def pattern_scores_after_cuts(text: Column, cuts: Sequence[int]) -> Column:
    """array<struct> of the four heads' pattern scores: of the text, then of each cut (-k: without its first k characters,
    k: without its last k), all from one pass over the text and its two edges.

    A pattern whose matches are short is counted in the whole text once; a cut changes its count as it changes the count in
    the edge, for both scans meet again at the first gap between matches. If there is none in the whole edge, it holds more
    matches than count either way (a pattern counts at most ``1 / MATCH_STEP``). Patterns of unbounded length, or that look
    ahead, are counted in each text. Either way only those are counted whose words begin in the text or, cut, at its start.
    """
    groups = [(h, w, p) for h in fixed.HEADS for w, patterns in fixed.PATTERN_GROUPS[h].values() for p in patterns]
    short, long = [g for g in groups if _short(g[2])], [g for g in groups if not _short(g[2])]
    assert EDGE >= 2 * _LONGEST * (1 / fixed.MATCH_STEP + 2)
    cut = lambda t, k: F.substring(t, -k + 1, 2**31 - 1) if k < 0 else F.left(t, F.greatest(F.length(t) - k, F.lit(0)))
    short_patterns, long_patterns = [p for _, _, p in short], [p for _, _, p in long]
    count_all = lambda t, patterns, gates: F.array(*[gated_count(t, p, gates[p]) for p in patterns])

    def scored(low: Column) -> Column:
        edges = F.struct(F.left(low, F.lit(EDGE)).alias("first"), F.right(low, F.lit(EDGE)).alias("last"))

        def from_edges(e: Column) -> Column:
            windows = F.array(e["first"], e["last"], *[cut(e["first"] if k < 0 else e["last"], k) for k in cuts])
            texts = F.array(low, *[cut(low, k) for k in cuts])
            # a cut at the start can make a word begin that didn't; else all that a cut text holds is in the whole one
            fronts = [F.left(cut(e["first"], k), F.lit(_LONGEST)) for k in cuts if k < 0]
            whole = let_gates(
                F.concat_ws("\n", low, *fronts),
                short_patterns + long_patterns,
                lambda gates: F.struct(
                    count_all(low, short_patterns, gates).alias("s"), F.transform(texts, lambda t: count_all(t, long_patterns, gates)).alias("l")
                ),
            )
            at_edges = let_gates(
                F.concat_ws("\n", e["first"], *fronts, e["last"]),
                short_patterns,
                lambda gates: F.transform(windows, lambda t: count_all(t, short_patterns, gates)),
            )
            return let(F.struct(whole.alias("whole"), at_edges.alias("edges")), assembled)

        return let(edges, from_edges)

    def assembled(c: Column) -> Column:
        def heads_of(i: int) -> Column:
            parts: dict[str, list[Column]] = {h: [] for h in fixed.HEADS}
            for n, (head, weight, _) in enumerate(short):
                count = c["whole"]["s"][n]
                if i:
                    count = count - c["edges"][0 if cuts[i - 1] < 0 else 1][n] + c["edges"][1 + i][n]
                parts[head].append(F.lit(weight) * F.least(count * F.lit(fixed.MATCH_STEP), F.lit(1.0)))
            for n, (head, weight, _) in enumerate(long):
                parts[head].append(F.lit(weight) * F.least(c["whole"]["l"][i][n] * F.lit(fixed.MATCH_STEP), F.lit(1.0)))
            return heads(*[F.least(total(parts[h]), F.lit(1.0)) for h in fixed.HEADS])

        return F.array(*[heads_of(i) for i in range(len(cuts) + 1)])

    return let(F.lower(text), scored)


def attachment_scores(attachments: Column) -> tuple[Column, Column]:
    """(sensitivity, context) of all attachments, each capped at 1."""
    weight = lambda i: lookup(i, fixed.INDICATOR_WEIGHTS, 0.0)

    def sensitivity(a: Column) -> Column:
        text = F.concat_ws(" ", F.coalesce(a["name"], F.lit("")), F.coalesce(a["content_summary"], F.lit("")))
        return _sum_over(a["sensitivity_indicators"], weight) + fixed.ATTACHMENT_TEXT_SHARE * pattern_score(
            text, "sensitivity"
        )

    def context(a: Column) -> Column:
        size = F.coalesce(a["size"], F.lit(0))
        by_size = (
            F.when(size > fixed.HUGE_ATTACHMENT, fixed.HUGE_ATTACHMENT_RISK)
            .when(size > fixed.LARGE_ATTACHMENT, fixed.LARGE_ATTACHMENT_RISK)
            .otherwise(0.0)
        )
        telling = F.filter(a["sensitivity_indicators"], lambda i: is_in(i, fixed.CONTEXT_INDICATORS))
        return by_size + _sum_over(telling, lambda i: weight(i) * fixed.INDICATOR_CONTEXT_SHARE)

    return (
        F.least(_sum_over(attachments, sensitivity), F.lit(1.0)),
        F.least(_sum_over(attachments, context), F.lit(1.0)),
    )


def _noisy(value: Column, noise: float, *keys) -> Column:
    return value if noise == 0 else value + (uniform(*keys) * 2 - 1) * noise


def pattern_labels(
    subject: Column, body: Column, recipients: Column, attachments: Column,
    noise: float = 0.0, seed: int = 42, msg_id: Column | None = None,
) -> Column:
    attached_sensitivity, attached_context = attachment_scores(attachments)

    def labelled(text: Column) -> Column:
        scores = {
            "sensitivity": F.least(
                text["sensitivity"] + attached_sensitivity * fixed.ATTACHMENT_SENSITIVITY_SHARE, F.lit(1.0)
            ),
            "exposure": pattern_score(F.array_join(recipients, " "), "exposure"),
            "context": F.least(text["context"] + attached_context * fixed.ATTACHMENT_CONTEXT_SHARE, F.lit(1.0)),
            "obfuscation": text["obfuscation"],
        }
        return heads(*[_clip01(_noisy(scores[h], noise, seed, "pattern", h, msg_id)) for h in fixed.HEADS])

    return let(pattern_scores(F.concat_ws(" ", subject, body), ["sensitivity", "context", "obfuscation"]), labelled)


# -- contextual labels ------------------------------------------------------------------------------------------


def user_context_risk(user: Column, content: Column) -> Column:
    role = F.upper(F.coalesce(user["role"], F.lit("EMPLOYEE")))
    dept = F.upper(F.coalesce(user["dept"], F.lit("GENERAL")))
    trust = lookup(role, {k: v[1] for k, v in fixed.ROLE_TRUST.items()}, fixed.DEFAULT_ROLE_TRUST[1])
    dept_weight = lookup(dept, fixed.DEPT_SENSITIVITY, fixed.DEFAULT_DEPT_SENSITIVITY)
    lower = F.lower(content)
    risk = (
        F.when((trust < 0.4) & lower.contains("confidential"), 0.6).otherwise(0.0)
        + F.when(lower.contains("financial") & ~is_in(dept, fixed.FINANCE_READER_DEPTS), 0.4).otherwise(0.0)
        + F.when(is_in(role, fixed.LOW_ACCESS_ROLES) & (dept_weight > 0.7), 0.5).otherwise(0.0)
    )
    return F.least(risk, F.lit(1.0))


def relationship_risk(user: Column, recipients: Column) -> Column:
    role = F.upper(F.coalesce(user["role"], F.lit("EMPLOYEE")))
    dept = F.upper(F.coalesce(user["dept"], F.lit("GENERAL")))
    outside = F.filter(recipients, lambda r: ~contains_any(F.lower(r), fixed.INTERNAL_MARKERS))
    personal = F.size(F.filter(outside, lambda r: contains_any(F.lower(r), fixed.PERSONAL_MARKERS)))
    risk = (
        F.when((F.size(outside) > 0) & is_in(dept, fixed.OUTWARD_SENSITIVE_DEPTS), 0.4).otherwise(0.0)
        + personal * 0.3
        + F.when(F.size(outside) > 3, 0.3).otherwise(0.0)
        + F.when(is_in(role, fixed.JUNIOR_ROLES) & (F.size(recipients) > 5), 0.2).otherwise(0.0)
    )
    return F.least(risk, F.lit(1.0))


def business_context_risk(content: Column) -> Column:
    lower = F.lower(content)
    risk = (
        F.when(contains_any(lower, fixed.LEGITIMATE_SHARING), -0.2).otherwise(0.0)
        + count_contained(lower, fixed.SUSPICIOUS_CONTEXTS) * 0.3
        + F.when(contains_any(lower, fixed.ACCIDENT_WORDS), 0.3).otherwise(0.0)
    )
    return F.least(risk, F.lit(1.0))


def intent_risk(content: Column) -> Column:
    lower = F.lower(content)
    risk = (
        F.least(count_contained(lower, fixed.PRESSURE_WORDS) * 0.2, F.lit(0.4))
        + F.least(count_contained(lower, fixed.FINANCIAL_MOTIVES) * 0.3, F.lit(0.6))
        + F.when(contains_any(lower, fixed.SELLING_WORDS), 0.5).otherwise(0.0)
    )
    return F.least(risk, F.lit(1.0))


def data_sensitivity(content: Column, attachments: Column) -> Column:
    many = F.size(attachments) > 3

    def of_attachment(a: Column) -> Column:
        size = F.coalesce(a["size"], F.lit(0))
        named = contains_any(F.lower(F.coalesce(a["name"], F.lit(""))), fixed.SENSITIVE_FILE_WORDS)
        return (
            F.when(named, 0.3).otherwise(0.0)
            + F.when(size > fixed.BULK_ATTACHMENT, 0.2).otherwise(0.0)
            + F.when((size > fixed.HUGE_ATTACHMENT) & many, 0.3).otherwise(0.0)
        )

    terms = F.least(count_contained(F.lower(content), fixed.BUSINESS_SENSITIVE_TERMS) * 0.2, F.lit(0.6))
    return F.least(terms + _sum_over(attachments, of_attachment), F.lit(1.0))


def contextual_labels(
    user: Column, subject: Column, body: Column, recipients: Column, attachments: Column,
    noise: float = 0.0, seed: int = 42, msg_id: Column | None = None,
) -> Column:
    content = F.concat_ws(" ", subject, body)
    scores = {
        "sensitivity": data_sensitivity(content, attachments),
        "exposure": relationship_risk(user, recipients),
        "context": user_context_risk(user, content) + business_context_risk(content) * 0.5,
        "obfuscation": intent_risk(content),
    }
    return heads(*[_clip01(_noisy(scores[h], noise, seed, "contextual", h, msg_id)) for h in fixed.HEADS])


# -- binary labels ----------------------------------------------------------------------------------------------


def span_sensitivity(spans: Column, role: Column) -> Column:
    legal = F.coalesce(role == "LEGAL", F.lit(False)) & has_type(spans, ["NDA", "MATTER"])
    risky = has_type(spans, recipients_fixed.HIGH_SENSITIVITY_TYPES)
    several = count_types(spans, recipients_fixed.MEDIUM_SENSITIVITY_TYPES) >= 2
    return risky | several | legal


def sharing_analysis(spans: Column, role: Column, recipients: Column, body: Column, sender_domain: Column) -> Column:
    """struct of recipient counts, content counts, exposure and context scores and the two labels."""
    legit = list(recipients_fixed.LEGITIMATE_PATTERNS)
    facts = F.struct(
        recipient_kinds(recipients, sender_domain).alias("kinds"),
        content_counts(body).alias("content"),
        role_evidence(role, body, spans).alias("evidence"),
    )

    def counted(f: Column) -> Column:
        return F.struct(
            kind_count(f["kinds"], "internal").alias("internal"),
            kind_count(f["kinds"], "external_business").alias("business"),
            kind_count(f["kinds"], "external_personal").alias("personal"),
            kind_count(f["kinds"], "high_risk").alias("high_risk"),
            (total([f["content"][k] for k in legit]) + f["evidence"]).alias("indicators"),
            (
                any_of([(role == r) & (f["content"][c] > 0) for r, c in recipients_fixed.ROLE_CATEGORY.items()])
                | (f["content"]["business_ops"] > 0)
            ).alias("role_fits"),
            f["content"]["suspicious"].alias("suspicious"),
        )

    def scored(c: Column) -> Column:
        exposure = exposure_score(c["personal"], c["high_risk"], c["business"], spans, c["suspicious"])
        context = context_score(
            c["indicators"], F.coalesce(c["role_fits"], F.lit(False)), c["internal"], c["business"], c["personal"],
            c["high_risk"], c["suspicious"],
        )
        return F.struct(
            *[c[n].alias(n) for n in ("internal", "business", "personal", "high_risk", "indicators", "suspicious")],
            exposure.alias("exposure_score"),
            context.alias("context_score"),
            (exposure >= 3).cast("int").alias("exposure"),
            (context >= 2).cast("int").alias("context"),
        )

    return let(let(facts, counted), scored)


def _any_recipient_contains(recipients: Column, domains, lower: bool) -> Column:
    return F.exists(recipients, lambda r: contains_any(F.lower(r) if lower else r, domains))


def converter_labels(user: Column, body: Column, recipients: Column, attachments: Column, spans: Column) -> Column:
    lower = F.lower(body)
    marked = F.exists(
        attachments, lambda a: array_contains_any(a["sensitivity_indicators"], fixed.CONVERTER_ATTACHMENT_INDICATORS)
    )
    sensitive = (
        has_type(spans, fixed.CONVERTER_HIGH_TYPES)
        | marked
        | (count_types(spans, recipients_fixed.MEDIUM_SENSITIVITY_TYPES) >= 2)
    )
    providers = recipients_fixed.CONVERTER_PERSONAL_DOMAINS
    personal = _any_recipient_contains(recipients, providers, True)
    own = F.when(F.coalesce(user["email"], F.lit("")).contains("@"), email_domain(user["email"])).otherwise("")
    business = F.exists(
        recipients,
        lambda r: (email_domain(r) != own) & (email_domain(r) != "") & ~contains_any(F.lower(r), providers),
    )
    legal_files = F.exists(
        attachments,
        lambda a: contains_any(F.lower(F.coalesce(a["content_summary"], F.lit(""))), fixed.CONVERTER_LEGAL_SUMMARY_WORDS),
    )
    legal = (has_type(spans, ["NDA", "MATTER"]) & is_in(user["role"], fixed.CONVERTER_LEGAL_ROLES)) | legal_files
    finance = (
        is_in(user["role"], fixed.CONVERTER_FINANCE_ROLES)
        & contains_any(lower, fixed.CONVERTER_FINANCE_WORDS)
        & ~personal
    )
    base = F.struct(
        sensitive.alias("s"), (personal | (business & sensitive)).alias("e"), (legal | finance).alias("c"),
        obfuscation.regex_flag(body).alias("o"),
    )
    return let(base, lambda b: heads(b["s"], b["e"], b["c"], b["o"], "int"))


def generator_labels(user: Column, body: Column, recipients: Column, spans: Column, scenario: Column) -> Column:
    scenario = F.coalesce(scenario, F.lit(""))
    sensitive = has_type(spans, recipients_fixed.HIGH_SENSITIVITY_TYPES) | (
        count_types(spans, recipients_fixed.MEDIUM_SENSITIVITY_TYPES) >= 2
    )
    exposed = (scenario == "data_leak") | _any_recipient_contains(recipients, fixed.GENERATOR_PERSONAL_DOMAINS, False)
    legal = has_type(spans, ["NDA", "MATTER"]) & F.coalesce(user["role"] == "LEGAL", F.lit(False))
    hidden = (scenario == "obfuscated_content") | contains_any(F.lower(body), ["base64", "encoded"])
    return heads(sensitive, exposed, (scenario == "legal_legitimate") | legal, hidden, "int")


def synth_labels(role: Column, recipients: Column, spans: Column, obfuscated: Column) -> Column:
    personal = _any_recipient_contains(recipients, fixed.SYNTH_PERSONAL_DOMAINS, False)
    nda, matter = has_type(spans, ["NDA"]), has_type(spans, ["MATTER"])
    sensitive = has_type(spans, recipients_fixed.HIGH_SENSITIVITY_TYPES) | (count_types(spans, ["NAME", "EMAIL"]) > 1)
    legal = (role == "LEGAL") & (nda | matter)
    return heads(sensitive, personal, legal | (nda & ~personal), obfuscated, "int")


def simple_labels(recipients: Column, body: Column, spans: Column) -> Column:
    exposed = _any_recipient_contains(recipients, fixed.SIMPLE_PERSONAL_DOMAINS, False)
    hidden = F.size(obfuscation.techniques(body)) > 0
    return heads(has_type(spans, recipients_fixed.HIGH_SENSITIVITY_TYPES), exposed, ~exposed, hidden, "int")


# -- quality ----------------------------------------------------------------------------------------------------


def _addresses_complete(recipients: Column) -> Column:
    return (F.size(recipients) > 0) & F.forall(recipients, lambda r: r.contains("@"))


def quality_full(subject: Column, body: Column, recipients: Column, user: Column, n_spans: Column) -> Column:
    lower = F.lower(body)
    realistic = ~contains_any(lower, fixed.QUALITY_PLACEHOLDERS) & contains_any(lower, fixed.QUALITY_BUSINESS_TERMS)
    checks = (
        (F.length(subject) > 5).cast("int")
        + _addresses_complete(recipients).cast("int")
        + F.coalesce(user["role"].isNotNull(), F.lit(False)).cast("int")
    )
    span_part = let(n_spans, lambda n: F.when(n == 0, 0.3).when(n <= 5, 1.0).otherwise(0.7))
    score = (
        F.when(F.length(body).between(50, 2000), 0.2).otherwise(0.0)
        + F.when((body != "") & realistic, 0.2).otherwise(0.0)
        + F.when(checks >= 2, 0.3).otherwise(0.0)
        + span_part * 0.3
    )
    return F.least(score, F.lit(1.0))


def quality_manager(subject: Column, body: Column, recipients: Column, n_spans: Column) -> Column:
    score = (
        F.when(F.length(body).between(50, 2000), 0.2).otherwise(0.0)
        + F.when(~contains_any(F.lower(body), fixed.SHORT_PLACEHOLDERS), 0.2).otherwise(0.0)
        + F.when(n_spans.between(1, 5), 0.3).otherwise(0.0)
        + F.when(F.length(subject) > 5, 0.1).otherwise(0.0)
        + F.when(_addresses_complete(recipients), 0.2).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def quality_helper(subject: Column, body: Column, recipients: Column) -> Column:
    lower = F.lower(body)
    score = (
        F.lit(0.5)
        + F.when(F.length(body).between(50, 2000), 0.2).otherwise(0.0)
        + F.when((body != "") & ~contains_any(lower, fixed.SHORT_PLACEHOLDERS), 0.1).otherwise(0.0)
        + F.when(contains_any(lower, fixed.HELPER_BUSINESS_WORDS), 0.1).otherwise(0.0)
        + F.when(F.length(subject) > 5, 0.1).otherwise(0.0)
        + F.when(_addresses_complete(recipients), 0.1).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def quality_recovery(subject: Column, body: Column, recipients: Column, n_spans: Column) -> Column:
    score = (
        F.lit(0.5)
        + F.when(F.length(body) > 20, 0.2).otherwise(0.0)
        + F.when(F.length(subject) > 5, 0.1).otherwise(0.0)
        + F.when(F.size(recipients) > 0, 0.1).otherwise(0.0)
        + F.when(n_spans > 0, 0.1).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


# -- decisions --------------------------------------------------------------------------------------------------


def risk_score(scores: Column) -> Column:
    return total([scores[h] * F.lit(w) for h, w in fixed.RISK_WEIGHTS.items()])


def mean_risk(scores: Column) -> Column:
    return total([scores[h] for h in fixed.HEADS]) / len(fixed.HEADS)


def decide(scores: Column) -> Column:
    """struct<decision, risk_level, primary_concern, confidence>."""
    s, e = scores["sensitivity"], scores["exposure"]
    best = F.greatest(*[scores[h] for h in fixed.HEADS])
    concern = None
    for h in fixed.HEADS:
        concern = (F if concern is None else concern).when(scores[h] == best, F.lit(fixed.CONCERN_NAMES[h]))
    ladder = [((s > 0.9) & (e > 0.7), "BLOCK", "HIGH"), ((s > 0.7) | (e > 0.5), "WARN", "MEDIUM"),
              ((s > 0.2) | (e > 0.2), "ALLOW_WITH_MONITORING", "LOW")]
    decision = level = None
    for condition, name, risk in ladder:
        decision = (F if decision is None else decision).when(condition, name)
        level = (F if level is None else level).when(condition, risk)
    return F.struct(
        decision.otherwise("ALLOW").alias("decision"),
        level.otherwise("MINIMAL").alias("risk_level"),
        concern.alias("primary_concern"),
        best.alias("confidence"),
    )


def decide_early(scores: Column) -> Column:
    """Decision after the first segment, or null when the rest of the text must be read."""
    s, e, o = scores["sensitivity"], scores["exposure"], scores["obfuscation"]
    return F.when((s < 0.2) & (e < 0.2), "ALLOW").when((s > 0.9) & ((e > 0.7) | (o > 0.6)), "BLOCK")
