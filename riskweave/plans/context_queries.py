"""Recipient and context analysis over the messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.fixed import recipients as fixed
from riskweave.operators import context as C
from riskweave.operators import detection as D
from riskweave.operators.rules import match_rules, rule_table
from riskweave.plans.message_view import (
    messages,
    scan,
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

OUTSIDE = fixed.PERSONAL_DOMAINS + fixed.HIGH_RISK_DOMAINS

# Reusable CTEs: sender(msg_id, sender_domain), kinds(msg_id, four counts, risk_factors), role(msg_id, inferred_role),
# content(msg_id, legit_*, suspicious).
SENDER_SQL = f"""
addressed AS (SELECT msg_id, pos, recipient, lower(list_extract(string_split(recipient, '@'), -1)) AS domain FROM (
  SELECT msg_id, unnest(recipients) AS recipient, unnest(range(len(recipients))) AS pos FROM msg) WHERE contains(recipient, '@')),
ranked AS (SELECT msg_id, domain, count(*) * 1000 - min(pos) AS score FROM addressed
  WHERE NOT {sql_in('domain', OUTSIDE)} GROUP BY msg_id, domain),
sender AS (SELECT m.msg_id, coalesce(r.domain,
    list_filter(list_transform(regexp_extract_all(m.body, {sql_text(fixed.BODY_DOMAIN_PATTERN)}, 1), lambda d: lower(d)),
      lambda d: NOT {sql_in('d', OUTSIDE)})[1], {sql_text(fixed.FALLBACK_SENDER_DOMAIN)}) AS sender_domain
  FROM msg m LEFT JOIN (SELECT msg_id, arg_max(domain, score) AS domain FROM ranked GROUP BY msg_id) r USING (msg_id))
"""
_KIND_SQL = (
    f"CASE WHEN a.domain = lower(s.sender_domain) THEN 'internal' WHEN {sql_in('a.domain', fixed.PERSONAL_DOMAINS)} THEN 'external_personal' "
    f"WHEN {sql_in('a.domain', fixed.HIGH_RISK_DOMAINS)} THEN 'high_risk' ELSE 'external_business' END"
)
KINDS_SQL = f"""
kinds AS (SELECT m.msg_id,
    count(*) FILTER (kind = 'internal') AS internal_count,
    count(*) FILTER (kind = 'external_business') AS external_business_count,
    count(*) FILTER (kind = 'external_personal') AS external_personal_count,
    count(*) FILTER (kind = 'high_risk') AS high_risk_count,
    coalesce(string_agg(CASE kind WHEN 'external_personal' THEN 'Personal email domain: ' || domain
      WHEN 'high_risk' THEN 'High-risk domain: ' || domain END, ';' ORDER BY pos), '') AS risk_factors
  FROM msg m LEFT JOIN (SELECT a.msg_id, a.domain, a.pos, {_KIND_SQL} AS kind FROM addressed a JOIN sender s USING (msg_id)) k USING (msg_id)
  GROUP BY m.msg_id)
"""


def role_sql(agent: str | None = None) -> str:
    content = "lower(subject || ' ' || body)"
    ladder = " ".join(f"WHEN {sql_contains_any(content, words)} THEN {sql_text(r)}" for r, words in fixed.ROLE_WORDS.items())
    ladder = f"CASE {ladder} ELSE {sql_text(fixed.DEFAULT_ROLE)} END"
    return f"CASE WHEN {agent} IS NULL THEN {ladder} ELSE {sql_lookup(agent, fixed.AGENT_ROLE, 'NULL')} END" if agent else ladder


ROLE_SQL = f"role AS (SELECT msg_id, {role_sql()} AS inferred_role FROM msg)"
CONTENT_SQL = (
    "content AS (SELECT msg_id, "
    + ", ".join(
        " + ".join(sql_count("folded", p, True) for p in patterns) + f" AS legit_{c}"
        for c, patterns in fixed.LEGITIMATE_PATTERNS.items()
    )
    + ", "
    + " + ".join(sql_count("folded", p, True) for p in fixed.SUSPICIOUS_PATTERNS)
    + f" AS suspicious FROM (SELECT msg_id, {sql_folded('body')} AS folded FROM msg))"
)


def evidence_sql(role: str, folded: str, spans: str) -> str:
    cases = []
    for name, evidence in fixed.ROLE_EVIDENCE.items():
        hits = " + ".join(
            f"CAST({sql_matches(folded, pattern, True)} AS INT)"
            if pattern
            else f"CAST(len(list_filter({spans}, lambda s: {sql_in('s.type', types)})) > 0 AS INT)"
            for pattern, types in evidence
        )
        cases.append(f"WHEN {sql_text(name)} THEN {hits}")
    return f"CASE upper({role}) {' '.join(cases)} ELSE 0 END"


def type_count_sql(spans: str, types) -> str:
    return f"len(list_filter({spans}, lambda s: {sql_in('s.type', types)}))"


# analysis(msg_id, counts, scores, labels) over a spans(msg_id, spans) CTE.
ANALYSIS_SQL = f"""
facts AS (SELECT m.msg_id, r.inferred_role, k.internal_count, k.external_business_count, k.external_personal_count, k.high_risk_count,
    c.suspicious, {' + '.join(f'c.legit_{k}' for k in fixed.LEGITIMATE_PATTERNS)}
      + {evidence_sql('r.inferred_role', sql_folded('m.body'), 'p.spans')} AS indicators,
    (r.inferred_role = 'LEGAL' AND c.legit_legal > 0) OR (r.inferred_role = 'HR' AND c.legit_hr > 0)
      OR (r.inferred_role = 'FINANCE' AND c.legit_finance > 0) OR c.legit_business_ops > 0 AS role_fits,
    {type_count_sql('p.spans', fixed.HIGH_SENSITIVITY_TYPES)} AS sensitive
  FROM msg m JOIN role r USING (msg_id) JOIN kinds k USING (msg_id) JOIN content c USING (msg_id) JOIN spans p USING (msg_id)),
analysis AS (SELECT *, CAST(exposure_score >= 3 AS INT) AS exposure, CAST(context_score >= 2 AS INT) AS context FROM (
  SELECT *,
    CASE WHEN external_personal_count > 0 THEN 3 ELSE 0 END + CASE WHEN high_risk_count > 0 THEN 4 ELSE 0 END
      + CASE WHEN external_business_count > 0 THEN 1 ELSE 0 END + 2 * sensitive + suspicious AS exposure_score,
    indicators + CASE WHEN role_fits THEN 2 ELSE 0 END + CASE WHEN internal_count > 0 THEN 1 ELSE 0 END
      + CASE WHEN external_business_count > 0 AND external_personal_count = 0 THEN 1 ELSE 0 END
      - 2 * suspicious - 2 * external_personal_count - 3 * high_risk_count AS context_score
  FROM facts))
"""


@query("infer_sender_domain", with_messages("SELECT msg_id, sender_domain FROM sender", SENDER_SQL))
def infer_sender_domain(spark, sf_dir):
    return C.infer_sender_domain(messages(spark, sf_dir)).select("msg_id", "sender_domain")


@query("categorize_recipients", with_messages("SELECT * FROM kinds", SENDER_SQL, KINDS_SQL))
def categorize_recipients(spark, sf_dir):
    done = C.categorize_recipients(C.infer_sender_domain(messages(spark, sf_dir)))
    return done.select(
        "msg_id", "internal_count", "external_business_count", "external_personal_count", "high_risk_count",
        F.array_join("risk_factors", ";").alias("risk_factors"),
    )


def _type_sql(domain: str) -> str:
    cases = " ".join(
        f"WHEN {sql_matches(domain, '^(?:' + '|'.join(patterns) + ')')} THEN {sql_text(kind)}"
        for kind, patterns in fixed.DOMAIN_TYPE_PATTERNS.items()
    )
    return f"CASE {cases} ELSE 'unknown' END"


_BUSINESS_SQL = " OR ".join(sql_matches("domain", "^(?:" + p + ")") for p in fixed.BUSINESS_DOMAIN_PATTERNS)


@query(
    "match_domain_rules",
    with_messages(
        f"""
SELECT {_type_sql('domain')} AS kind, count(*) AS n, count(DISTINCT domain) AS n_domains FROM (
  SELECT lower(list_extract(string_split(r, '@'), -1)) AS domain FROM (SELECT unnest(recipients) AS r FROM msg) WHERE contains(r, '@')
  UNION ALL SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) FROM pages) GROUP BY 1
"""
    ),
)
def match_domain_rules(spark, sf_dir):
    """The domain types as a table of rules, joined to every recipient and page."""
    from riskweave.functions.text import address_domains

    sent = messages(spark, sf_dir, spread=False).select(F.explode(address_domains(F.col("recipients"))).alias("domain"))
    seen = scan(spark, sf_dir, "pages", spread=False).select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("domain"))
    rules = rule_table(spark, fixed.DOMAIN_TYPE_PATTERNS)
    found = match_rules(sent.unionByName(seen), "domain", rules, default="unknown")
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("n_domains"))


@query(
    "classify_domains",
    with_messages(
        f"""
SELECT domain, n, CASE WHEN {sql_in('domain', fixed.PERSONAL_DOMAINS)} THEN 'personal' WHEN {sql_in('domain', fixed.HIGH_RISK_DOMAINS)} THEN 'high_risk'
  WHEN {_BUSINESS_SQL} THEN 'business' WHEN ends_with(domain, '.gov') THEN 'government' WHEN ends_with(domain, '.edu') THEN 'education'
  ELSE 'business' END AS domain_kind, {_type_sql('domain')} AS domain_type
FROM (SELECT domain, count(*) AS n FROM (
  SELECT lower(list_extract(string_split(r, '@'), -1)) AS domain FROM (SELECT unnest(recipients) AS r FROM msg) WHERE contains(r, '@')
  UNION ALL SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) FROM pages) GROUP BY domain)
"""
    ),
)
def classify_domains(spark, sf_dir):
    from riskweave.functions.text import address_domains

    mail = messages(spark, sf_dir).select(F.explode_outer(address_domains(F.col("recipients"))).alias("domain"))
    web = scan(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("domain"))
    # Classify each distinct domain once, after the counts.
    counted = mail.filter("domain is not null").unionAll(web).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return C.classify_domains(counted)


def _authorized_sql() -> str:
    content = "lower(subject || ' ' || body)"
    rules = []
    for r in fixed.RELATIONSHIPS:
        rules.append(
            f"({sql_in('m.role', r['roles'])} AND {sql_contains_any(content, r['keywords'])} "
            f"AND {type_count_sql('p.spans', r['data_types'])} > 0 "
            f"AND len(list_filter(domains, lambda d: {_type_sql('lower(d)')} = {sql_text(r['domain_types'][0])})) > 0)"
        )
    return " OR ".join(rules)


@query(
    "sharing_labels",
    with_messages(
        f"""
SELECT msg_id, personal, authorized, internal_only,
  CAST(personal OR (len(domains) > 0 AND NOT authorized AND NOT internal_only) AS INT) AS exposure,
  CAST(authorized OR internal_only AS INT) AS context
FROM (SELECT m.msg_id, domains, len(list_filter(domains, lambda d: {_type_sql('lower(d)')} = 'personal')) > 0 AS personal,
    {_authorized_sql()} AS authorized, len(list_filter(domains, lambda d: d <> 'company.com')) = 0 AS internal_only
  FROM (SELECT *, list_transform(list_filter(recipients, lambda r: contains(r, '@')), lambda r: list_extract(string_split(r, '@'), -1)) AS domains
    FROM msg) m JOIN spans p USING (msg_id))
""",
        *spans_ctes("full", "confidence"),
    ),
)
def sharing_labels(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir), "body", "full").withColumn("sender_domain", F.lit("company.com"))
    return C.sharing_labels(found).select("msg_id", "sharing.*")


@query(
    "authorized_sharing",
    with_messages(
        f"""
SELECT role, count(*) AS n_messages, count(*) FILTER (authorized) AS n_authorized
FROM (SELECT m.role, {_authorized_sql()} AS authorized
  FROM (SELECT *, list_transform(list_filter(recipients, lambda r: contains(r, '@')), lambda r: list_extract(string_split(r, '@'), -1)) AS domains
    FROM msg) m JOIN spans p USING (msg_id)) GROUP BY role
""",
        *spans_ctes("full", "confidence"),
    ),
)
def authorized_sharing(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir), "body", "full")
    return (
        C.authorized_sharing(found)
        .groupBy(F.col("user.role").alias("role"))
        .agg(F.count(F.lit(1)).alias("n_messages"), F.count_if("authorized").alias("n_authorized"))
    )


@query("content_indicators", with_messages("SELECT * FROM content", CONTENT_SQL))
def content_indicators(spark, sf_dir):
    return C.content_indicators(messages(spark, sf_dir).select("msg_id", "body")).drop("body", "legit_categories")


@query(
    "role_indicators",
    with_messages(
        f"SELECT m.msg_id, m.role, {evidence_sql('m.role', sql_folded('m.body'), 'p.spans')} AS evidence FROM msg m JOIN spans p USING (msg_id)",
        *spans_ctes("full", "confidence"),
    ),
)
def role_indicators(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir).select("msg_id", "body", "user.role"), "body", "full")
    return C.role_indicators(found).select("msg_id", "role", "evidence")


@query(
    "sharing_analysis",
    with_messages(
        "SELECT msg_id, internal_count AS internal, external_business_count AS business, external_personal_count AS personal, "
        "high_risk_count AS high_risk, indicators, suspicious, exposure_score, context_score, exposure, context FROM analysis",
        *spans_ctes("full", "confidence"), SENDER_SQL, KINDS_SQL, ROLE_SQL, CONTENT_SQL, ANALYSIS_SQL,
    ),
)
def sharing_analysis(spark, sf_dir):
    prepared = C.infer_sender_domain(C.infer_user_role(messages(spark, sf_dir)))
    found = D.detect_spans(prepared, "body", "full")
    return C.sharing_analysis(found, "inferred_role").select("msg_id", "sharing.*")


def primary_domain_sql() -> tuple[str, str]:
    content = "lower(subject || ' ' || body)"
    hits = {d: sql_count_contained(content, words) for d, words in fixed.PRIMARY_DOMAIN_KEYWORDS.items()}
    best = "greatest(" + ", ".join(hits.values()) + ")"
    cases = " ".join(f"WHEN {h} = {best} THEN {sql_text(d)}" for d, h in hits.items())
    return f"CASE WHEN {best} = 0 THEN 'general' {cases} END", best


RECIPIENT_RISK_SQL = (
    "CASE WHEN len(list_filter(recipients, lambda r: "
    + sql_contains_any("lower(r)", fixed.CONVERTER_PERSONAL_DOMAINS)
    + ")) > 0 THEN 'high' WHEN len(list_filter(recipients, lambda r: "
    + sql_contains_any("lower(r)", fixed.COMPETITOR_WORDS)
    + " OR (contains(r, '@') AND NOT ends_with(r, '.internal') AND NOT starts_with(r, '#')))) > 0 THEN 'medium' ELSE 'low' END"
)
_DOMAIN_SQL, _HITS_SQL = primary_domain_sql()


@query(
    "primary_domain",
    with_messages(f"SELECT msg_id, {_DOMAIN_SQL} AS domain, {_HITS_SQL} AS hits, {RECIPIENT_RISK_SQL} AS recipient_risk FROM msg"),
)
def primary_domain(spark, sf_dir):
    return C.primary_domain(messages(spark, sf_dir)).select("msg_id", "primary_domain.*", "recipient_risk")


RISK_LEVEL_SQL = (
    "CASE WHEN len(list_filter(recipients, lambda r: "
    + sql_contains_any("r", fixed.RISK_PERSONAL_DOMAINS)
    + ")) > 0 AND NOT "
    + sql_contains_any("lower(body)", fixed.RISK_BUSINESS_WORDS)
    + " THEN 'high_risk' WHEN "
    + sql_contains_any("lower(body)", fixed.RISK_CASUAL_WORDS)
    + " THEN 'medium_risk' WHEN "
    + sql_contains_any("lower(body)", fixed.RISK_BUSINESS_WORDS)
    + " THEN 'low_risk' ELSE 'medium_risk' END"
)


@query("infer_risk_level", with_messages(f"SELECT msg_id, {RISK_LEVEL_SQL} AS current_risk FROM msg"))
def infer_risk_level(spark, sf_dir):
    return C.infer_risk_level(messages(spark, sf_dir)).select("msg_id", "current_risk")


@query(
    "infer_user_role",
    with_messages(f"SELECT msg_id, {role_sql()} AS from_content, {role_sql('agent')} AS from_agent FROM msg"),
)
def infer_user_role(spark, sf_dir):
    by_content = C.infer_user_role(messages(spark, sf_dir), out="from_content")
    return C.infer_user_role(by_content, "agent", "from_agent").select("msg_id", "from_content", "from_agent")


@query(
    "infer_agent_from_content",
    with_messages(
        "SELECT inferred_agent, count(*) AS n FROM (SELECT CASE WHEN contains(lower(subject), 'legal') OR contains(lower(body), 'contract') THEN 'legal_agent' "
        "WHEN contains(lower(subject), 'finance') OR contains(lower(body), 'payment') THEN 'finance_agent' "
        "WHEN contains(lower(subject), 'hr') OR contains(lower(body), 'employee') THEN 'hr_agent' ELSE 'clean_business' END AS inferred_agent FROM msg) GROUP BY 1"
    ),
)
def infer_agent_from_content(spark, sf_dir):
    return C.infer_agent_from_content(messages(spark, sf_dir)).groupBy("inferred_agent").agg(F.count(F.lit(1)).alias("n"))
