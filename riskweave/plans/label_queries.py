"""Labelling, quality and decisions over the messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.fixed import labels as fixed
from riskweave.fixed import recipients as recipients_fixed
from riskweave.fixed import span_patterns as spans_fixed
from riskweave.operators import detection as D
from riskweave.operators import labeling as B
from riskweave.plans.context_queries import (
    ANALYSIS_SQL,
    CONTENT_SQL,
    KINDS_SQL,
    ROLE_SQL,
    SENDER_SQL,
    type_count_sql,
)
from riskweave.plans.detection_queries import _COMBINED_SQL, _TECHNIQUE_SQL, _sql_flags
from riskweave.plans.message_view import (
    messages,
    sql_contains_any,
    sql_count,
    sql_count_contained,
    sql_folded,
    sql_in,
    sql_lookup,
    sql_matches,
    sql_text,
    with_messages,
)
from riskweave.plans.registry import query
from riskweave.plans.sql_spans import spans_ctes

HEADS = fixed.HEADS
DIGITS = 6


def dbl(value) -> str:
    return f"CAST({value} AS DOUBLE)"


def rounded(column, digits: int = DIGITS):
    return F.round(column, digits)


def round_sql(expression: str, name: str, digits: int = DIGITS) -> str:
    return f"round({expression}, {digits}) AS {name}"


def head_columns(source: str, kind: str = "round"):
    return [(rounded(F.col(f"{source}.{h}")) if kind == "round" else F.col(f"{source}.{h}")).alias(h) for h in HEADS]


# -- graded labels in SQL ---------------------------------------------------------------------------------------


def _pattern_score_sql(folded: str, head: str, raw: str = "") -> str:
    parts = []
    for weight, patterns in fixed.PATTERN_GROUPS[head].values():
        for p in patterns:
            if "(?!" in p:  # no address counts if the whole ends in a common suffix; otherwise each '@' does
                count = f"CASE WHEN regexp_matches({folded}, '\\.(com|org|edu|gov)$') THEN 0 ELSE len({folded}) - len(replace({folded}, '@', '')) END"
            else:
                count = sql_count(folded, p, True)
            parts.append(f"{dbl(weight)} * least(({count}) * {dbl(fixed.MATCH_STEP)}, {dbl(1)})")
    return "least(" + " + ".join(parts) + f", {dbl(1)})"


_WEIGHT_SQL = "CASE i " + " ".join(f"WHEN {sql_text(k)} THEN {dbl(v)}" for k, v in fixed.INDICATOR_WEIGHTS.items()) + f" ELSE {dbl(0)} END"
_ATTACHMENT_TEXT_SQL = sql_folded("lower(a.name || ' ' || a.content_summary)")
PATTERN_SQL = f"""
pattern AS (SELECT msg_id, split,
  least(text_sensitivity + least(att_sensitivity, 1) * {dbl(0.6)}, {dbl(1)}) AS sensitivity, exposure,
  least(text_context + least(att_context, 1) * {dbl(0.4)}, {dbl(1)}) AS context, obfuscation
FROM (SELECT msg_id, split,
    {_pattern_score_sql('folded', 'sensitivity')} AS text_sensitivity,
    CASE WHEN len(recipients) = 0 THEN {dbl(0)} ELSE {_pattern_score_sql("array_to_string(recipients, ' ')", 'exposure')} END AS exposure,
    {_pattern_score_sql('folded', 'context')} AS text_context,
    {_pattern_score_sql('folded', 'obfuscation')} AS obfuscation,
    coalesce(list_sum(list_transform(attachments, lambda a: coalesce(list_sum(list_transform(a.sensitivity_indicators, lambda i: {_WEIGHT_SQL})), 0)
      + {dbl(0.3)} * {_pattern_score_sql(_ATTACHMENT_TEXT_SQL, 'sensitivity')})), 0) AS att_sensitivity,
    coalesce(list_sum(list_transform(attachments, lambda a: CASE WHEN a.size > 10000000 THEN {dbl(0.3)} WHEN a.size > 1000000 THEN {dbl(0.2)} ELSE {dbl(0)} END
      + coalesce(list_sum(list_transform(list_filter(a.sensitivity_indicators, lambda i: {sql_in('i', fixed.CONTEXT_INDICATORS)}), lambda i: ({_WEIGHT_SQL}) * {dbl(0.5)})), 0))), 0) AS att_context
  FROM (SELECT *, {sql_folded("lower(subject || ' ' || body)")} AS folded FROM msg)))
"""

_TRUST_SQL = sql_lookup("role", {k: v[1] for k, v in fixed.ROLE_TRUST.items()}, str(fixed.DEFAULT_ROLE_TRUST[1]))
_DEPT_SQL = sql_lookup("dept", fixed.DEPT_SENSITIVITY, str(fixed.DEFAULT_DEPT_SENSITIVITY))
CONTEXTUAL_SQL = f"""
contextual AS (SELECT msg_id, split, sensitivity, exposure,
  greatest({dbl(0)}, least({dbl(1)}, least(user_risk, {dbl(1)}) + least(business_risk, {dbl(1)}) * {dbl(0.5)})) AS context, obfuscation
FROM (SELECT msg_id, split,
    least(least({sql_count_contained('lower', fixed.BUSINESS_SENSITIVE_TERMS)} * {dbl(0.2)}, {dbl(0.6)})
      + coalesce(list_sum(list_transform(attachments, lambda a: CASE WHEN {sql_contains_any('lower(a.name)', fixed.SENSITIVE_FILE_WORDS)} THEN {dbl(0.3)} ELSE {dbl(0)} END
        + CASE WHEN a.size > 50000000 THEN {dbl(0.2)} ELSE {dbl(0)} END + CASE WHEN a.size > 10000000 AND len(attachments) > 3 THEN {dbl(0.3)} ELSE {dbl(0)} END)), 0), {dbl(1)}) AS sensitivity,
    least(CASE WHEN len(outside) > 0 AND {sql_in('dept', fixed.OUTWARD_SENSITIVE_DEPTS)} THEN {dbl(0.4)} ELSE {dbl(0)} END
      + len(list_filter(outside, lambda r: {sql_contains_any('lower(r)', fixed.PERSONAL_MARKERS)})) * {dbl(0.3)}
      + CASE WHEN len(outside) > 3 THEN {dbl(0.3)} ELSE {dbl(0)} END
      + CASE WHEN {sql_in('role', fixed.JUNIOR_ROLES)} AND len(recipients) > 5 THEN {dbl(0.2)} ELSE {dbl(0)} END, {dbl(1)}) AS exposure,
    CASE WHEN {_TRUST_SQL} < 0.4 AND contains(lower, 'confidential') THEN {dbl(0.6)} ELSE {dbl(0)} END
      + CASE WHEN contains(lower, 'financial') AND NOT {sql_in('dept', fixed.FINANCE_READER_DEPTS)} THEN {dbl(0.4)} ELSE {dbl(0)} END
      + CASE WHEN {sql_in('role', fixed.LOW_ACCESS_ROLES)} AND {_DEPT_SQL} > 0.7 THEN {dbl(0.5)} ELSE {dbl(0)} END AS user_risk,
    CASE WHEN {sql_contains_any('lower', fixed.LEGITIMATE_SHARING)} THEN {dbl(-0.2)} ELSE {dbl(0)} END
      + {sql_count_contained('lower', fixed.SUSPICIOUS_CONTEXTS)} * {dbl(0.3)}
      + CASE WHEN {sql_contains_any('lower', fixed.ACCIDENT_WORDS)} THEN {dbl(0.3)} ELSE {dbl(0)} END AS business_risk,
    least(least({sql_count_contained('lower', fixed.PRESSURE_WORDS)} * {dbl(0.2)}, {dbl(0.4)})
      + least({sql_count_contained('lower', fixed.FINANCIAL_MOTIVES)} * {dbl(0.3)}, {dbl(0.6)})
      + CASE WHEN {sql_contains_any('lower', fixed.SELLING_WORDS)} THEN {dbl(0.5)} ELSE {dbl(0)} END, {dbl(1)}) AS obfuscation
  FROM (SELECT *, lower(subject || ' ' || body) AS lower,
    list_filter(recipients, lambda r: NOT {sql_contains_any('lower(r)', fixed.INTERNAL_MARKERS)}) AS outside FROM msg)))
"""
_ROUNDED_HEADS = ", ".join(round_sql(h, h) for h in HEADS)


@query("label_pattern", with_messages(f"SELECT msg_id, {_ROUNDED_HEADS} FROM pattern", PATTERN_SQL))
def label_pattern(spark, sf_dir):
    return B.label_pattern(messages(spark, sf_dir)).select("msg_id", *head_columns("labels"))


@query("label_contextual", with_messages(f"SELECT msg_id, {_ROUNDED_HEADS} FROM contextual", CONTEXTUAL_SQL))
def label_contextual(spark, sf_dir):
    return B.label_contextual(messages(spark, sf_dir)).select("msg_id", *head_columns("labels"))


# -- binary labels ----------------------------------------------------------------------------------------------

HIGH, MEDIUM = recipients_fixed.HIGH_SENSITIVITY_TYPES, recipients_fixed.MEDIUM_SENSITIVITY_TYPES
LABELLED_SQL = f"""
labelled AS (SELECT m.msg_id, m.channel, m.split, p.spans, a.inferred_role,
  CAST({type_count_sql('p.spans', HIGH)} > 0 OR {type_count_sql('p.spans', MEDIUM)} >= 2
    OR (a.inferred_role = 'LEGAL' AND {type_count_sql('p.spans', ['NDA', 'MATTER'])} > 0) AS INT) AS sensitivity,
  a.exposure, a.context, CAST({' OR '.join(f'({c})' for c in _sql_flags('m.combined').values())} AS INT) AS obfuscation
FROM (SELECT *, {_COMBINED_SQL} AS combined FROM msg) m JOIN spans p USING (msg_id) JOIN analysis a USING (msg_id))
"""
LABELLED_CTES = [
    *spans_ctes("full", "confidence", text=_COMBINED_SQL), SENDER_SQL, KINDS_SQL, ROLE_SQL, CONTENT_SQL, ANALYSIS_SQL, LABELLED_SQL,
]


@query(
    "label_spans",
    with_messages(
        "SELECT msg_id, inferred_role, len(spans) AS n_spans, sensitivity, exposure, context, obfuscation FROM labelled", *LABELLED_CTES
    ),
)
def label_spans(spark, sf_dir):
    done = B.label_spans(messages(spark, sf_dir))
    return done.select("msg_id", "inferred_role", F.size("spans").alias("n_spans"), "labels.*")


_ANY = lambda domains, r="r": f"len(list_filter(m.recipients, lambda r: {sql_contains_any(r, domains)})) > 0"
_PROVIDERS = recipients_fixed.CONVERTER_PERSONAL_DOMAINS
_LAST = "lower(list_extract(string_split(r, '@'), -1))"
CONVERTER_SQL = f"""
converted AS (SELECT msg_id, CAST(s AS INT) AS sensitivity, CAST(personal OR (business AND s) AS INT) AS exposure,
  CAST(legal OR (finance AND NOT personal) AS INT) AS context, CAST(o AS INT) AS obfuscation
FROM (SELECT m.msg_id,
    {type_count_sql('p.spans', fixed.CONVERTER_HIGH_TYPES)} > 0 OR {type_count_sql('p.spans', MEDIUM)} >= 2
      OR len(list_filter(m.attachments, lambda a: len(list_filter(a.sensitivity_indicators, lambda i: {sql_in('i', fixed.CONVERTER_ATTACHMENT_INDICATORS)})) > 0)) > 0 AS s,
    {_ANY(_PROVIDERS, 'lower(r)')} AS personal,
    len(list_filter(m.recipients, lambda r: {_LAST} NOT IN ('company.com', '') AND NOT {sql_contains_any('lower(r)', _PROVIDERS)})) > 0 AS business,
    ({type_count_sql('p.spans', ['NDA', 'MATTER'])} > 0 AND {sql_in('m.role', fixed.CONVERTER_LEGAL_ROLES)})
      OR len(list_filter(m.attachments, lambda a: {sql_contains_any('lower(a.content_summary)', fixed.CONVERTER_LEGAL_SUMMARY_WORDS)})) > 0 AS legal,
    {sql_in('m.role', fixed.CONVERTER_FINANCE_ROLES)} AND {sql_contains_any('lower(m.body)', fixed.CONVERTER_FINANCE_WORDS)} AS finance,
    {' OR '.join(sql_matches('m.body', p, True) for p in spans_fixed.CONVERTER_OBFUSCATION)} AS o
  FROM msg m JOIN spans p USING (msg_id)))
"""


@query("label_converter", with_messages("SELECT * FROM converted", *spans_ctes("converter", "longest"), CONVERTER_SQL))
def label_converter(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir), "body", "converter")
    return B.label_converter(found).select("msg_id", "labels.*")


@query(
    "label_generator",
    with_messages(
        f"""
SELECT m.msg_id, CAST({type_count_sql('p.spans', HIGH)} > 0 OR {type_count_sql('p.spans', MEDIUM)} >= 2 AS INT) AS sensitivity,
  CAST(m.scenario = 'data_leak' OR {_ANY(fixed.GENERATOR_PERSONAL_DOMAINS)} AS INT) AS exposure,
  CAST(m.scenario = 'legal_legitimate' OR ({type_count_sql('p.spans', ['NDA', 'MATTER'])} > 0 AND m.role = 'LEGAL') AS INT) AS context,
  CAST(m.scenario = 'obfuscated_content' OR contains(lower(m.body), 'base64') OR contains(lower(m.body), 'encoded') AS INT) AS obfuscation
FROM msg m JOIN spans p USING (msg_id)
""",
        *spans_ctes("generator", "distinct"),
    ),
)
def label_generator(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir), "body", "generator")
    return B.label_generator(found).select("msg_id", "labels.*")


@query(
    "label_synth",
    with_messages(
        f"""
SELECT m.msg_id, CAST({type_count_sql('p.spans', HIGH)} > 0 OR {type_count_sql('p.spans', ['NAME', 'EMAIL'])} > 1 AS INT) AS sensitivity,
  CAST({_ANY(fixed.SYNTH_PERSONAL_DOMAINS)} AS INT) AS exposure,
  CAST((m.role = 'LEGAL' AND {type_count_sql('p.spans', ['NDA', 'MATTER'])} > 0)
    OR ({type_count_sql('p.spans', ['NDA'])} > 0 AND NOT {_ANY(fixed.SYNTH_PERSONAL_DOMAINS)}) AS INT) AS context,
  CAST(m.msg_id % 7 = 0 AS INT) AS obfuscation
FROM msg m JOIN spans p USING (msg_id)
""",
        *spans_ctes("synth", "none"),
    ),
)
def label_synth(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir), "body", "synth").withColumn("obfuscated", F.col("msg_id") % 7 == 0)
    return B.label_synth(found).select("msg_id", "labels.*")


@query(
    "label_simple",
    with_messages(
        f"""
SELECT m.msg_id, CAST({type_count_sql('p.spans', HIGH)} > 0 AS INT) AS sensitivity, CAST({_ANY(fixed.SIMPLE_PERSONAL_DOMAINS)} AS INT) AS exposure,
  CAST(NOT {_ANY(fixed.SIMPLE_PERSONAL_DOMAINS)} AS INT) AS context, CAST(len({_TECHNIQUE_SQL}) > 0 AS INT) AS obfuscation
FROM msg m JOIN spans p USING (msg_id)
""",
        *spans_ctes("semantic", "none"),
    ),
)
def label_simple(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir), "body", "semantic")
    return B.label_simple(found).select("msg_id", "labels.*")


# -- quality ----------------------------------------------------------------------------------------------------

_ADDRESSED = "(len(recipients) > 0 AND len(list_filter(recipients, lambda r: NOT contains(r, '@'))) = 0)"
_IF = lambda condition, value: f"CASE WHEN {condition} THEN {dbl(value)} ELSE {dbl(0)} END"
_MIDDLE = "len(body) BETWEEN 50 AND 2000"
QUALITY_SQL = {
    "full": f"least({_IF(_MIDDLE, 0.2)} + "
    + _IF(f"NOT {sql_contains_any('lower(body)', fixed.QUALITY_PLACEHOLDERS)} AND {sql_contains_any('lower(body)', fixed.QUALITY_BUSINESS_TERMS)}", 0.2)
    + " + "
    + _IF(f"CAST(len(subject) > 5 AS INT) + CAST({_ADDRESSED} AS INT) + CAST(role IS NOT NULL AS INT) >= 2", 0.3)
    + f" + CASE WHEN n_spans = 0 THEN {dbl(0.3)} WHEN n_spans <= 5 THEN {dbl(1)} ELSE {dbl(0.7)} END * {dbl(0.3)}, 1)",
    "manager": f"least({_IF(_MIDDLE, 0.2)} + {_IF('NOT ' + sql_contains_any('lower(body)', fixed.SHORT_PLACEHOLDERS), 0.2)} + "
    f"{_IF('n_spans BETWEEN 1 AND 5', 0.3)} + {_IF('len(subject) > 5', 0.1)} + {_IF(_ADDRESSED, 0.2)}, 1)",
    "helper": f"least({dbl(0.5)} + {_IF(_MIDDLE, 0.2)} + {_IF('NOT ' + sql_contains_any('lower(body)', fixed.SHORT_PLACEHOLDERS), 0.1)} + "
    f"{_IF(sql_contains_any('lower(body)', fixed.HELPER_BUSINESS_WORDS), 0.1)} + {_IF('len(subject) > 5', 0.1)} + {_IF(_ADDRESSED, 0.1)}, 1)",
    "recovery": f"least({dbl(0.5)} + {_IF('len(body) > 20', 0.2)} + {_IF('len(subject) > 5', 0.1)} + {_IF('len(recipients) > 0', 0.1)} + {_IF('n_spans > 0', 0.1)}, 1)",
}


@query(
    "quality_scores",
    with_messages(
        "SELECT msg_id, " + ", ".join(round_sql(q, f"quality_{v}") for v, q in QUALITY_SQL.items()) + " FROM msg JOIN (SELECT msg_id, len(spans) AS n_spans FROM spans) USING (msg_id)",
        *spans_ctes("semantic", "none"),
    ),
)
def quality_scores(spark, sf_dir):
    df = D.detect_spans(messages(spark, sf_dir), "body", "semantic").withColumn("n_spans", F.size("spans"))
    for variant in QUALITY_SQL:
        df = B.quality_score(df, variant, f"quality_{variant}")
    return df.select("msg_id", *[rounded(F.col(f"quality_{v}")).alias(f"quality_{v}") for v in QUALITY_SQL])


@query(
    "filter_quality",
    with_messages(
        f"SELECT channel, count(*) AS n_kept FROM (SELECT channel, {QUALITY_SQL['full']} AS q FROM msg JOIN (SELECT msg_id, len(spans) AS n_spans FROM spans) "
        "USING (msg_id)) WHERE round(q, 9) >= 0.7 GROUP BY channel",
        *spans_ctes("semantic", "none"),
    ),
)
def filter_quality(spark, sf_dir):
    df = D.detect_spans(messages(spark, sf_dir), "body", "semantic").withColumn("n_spans", F.size("spans"))
    return B.filter_quality(df, "full").groupBy("channel").agg(F.count(F.lit(1)).alias("n_kept"))


# -- decisions --------------------------------------------------------------------------------------------------


def decision_sql(p: str = "") -> str:
    return (
        f"CASE WHEN {p}sensitivity > 0.9 AND {p}exposure > 0.7 THEN 'BLOCK' WHEN {p}sensitivity > 0.7 OR {p}exposure > 0.5 THEN 'WARN' "
        f"WHEN {p}sensitivity > 0.2 OR {p}exposure > 0.2 THEN 'ALLOW_WITH_MONITORING' ELSE 'ALLOW' END"
    )


RISK_SQL = " + ".join(f"{h} * {dbl(w)}" for h, w in fixed.RISK_WEIGHTS.items())
MEAN_SQL = "(" + " + ".join(HEADS) + ") / 4"
_BEST = f"greatest({', '.join(HEADS)})"


def scored(spark, sf_dir):
    """Pattern labels as scores, one struct per message."""
    return B.label_pattern(messages(spark, sf_dir), out="scores").select("msg_id", "split", "scores")


@query(
    "decide",
    with_messages(
        f"""
SELECT msg_id, {decision_sql()} AS decision,
  CASE {decision_sql()} WHEN 'BLOCK' THEN 'HIGH' WHEN 'WARN' THEN 'MEDIUM' WHEN 'ALLOW_WITH_MONITORING' THEN 'LOW' ELSE 'MINIMAL' END AS risk_level,
  CASE {_BEST} {' '.join(f'WHEN {h} THEN {sql_text(fixed.CONCERN_NAMES[h])}' for h in HEADS)} END AS primary_concern,
  {round_sql(_BEST, 'confidence')}, {round_sql(RISK_SQL, 'risk')},
  CASE WHEN sensitivity < 0.2 AND exposure < 0.2 THEN 'ALLOW' WHEN sensitivity > 0.9 AND (exposure > 0.7 OR obfuscation > 0.6) THEN 'BLOCK' END AS early_decision
FROM pattern
""",
        PATTERN_SQL,
    ),
)
def decide(spark, sf_dir):
    done = B.decide(scored(spark, sf_dir))
    return done.select(
        "msg_id", "decision", "risk_level", "primary_concern", rounded(F.col("confidence")).alias("confidence"),
        rounded(F.col("risk")).alias("risk"), "early_decision",
    )
