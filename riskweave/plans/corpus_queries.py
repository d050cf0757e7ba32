"""Normalisation, filters and conversion over the messages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.fixed import corpus
from riskweave.functions.text import clean_artifacts, clean_text, guess_mime, stable_id, synth_subject, truncate_words, valid_email
from riskweave.functions import text as T
from riskweave.operators import conversion as C
from riskweave.operators import detection as D
from riskweave.operators import filters as K
from riskweave.plans.context_queries import RECIPIENT_RISK_SQL, primary_domain_sql
from riskweave.plans.detection_queries import _TECHNIQUE_SQL
from riskweave.plans.label_queries import CONVERTER_SQL
from riskweave.plans.message_view import (
    messages,
    scan,
    sql_contains_any,
    sql_in,
    sql_list,
    sql_matches,
    sql_mime,
    sql_subject,
    sql_text,
    with_messages,
)
from riskweave.plans.registry import query
from riskweave.plans.sql_spans import spans_ctes


def _by_channel(df):
    return df.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("msg_id").alias("id_sum"))


_BY_CHANNEL = "SELECT channel, count(*) AS n, CAST(sum(msg_id) AS BIGINT) AS id_sum FROM msg WHERE {} GROUP BY channel"


@query(
    "guess_mime",
    with_messages(
        f"SELECT name, {sql_mime('name')} AS mime, count(*) AS n FROM (SELECT unnest(list_transform(attachments, lambda a: a.name)) AS name FROM msg "
        r"UNION ALL SELECT unnest(regexp_extract_all(body, '[A-Za-z]+\.[A-Za-z]+')) FROM msg) GROUP BY name"
    ),
)
def guess_mime_query(spark, sf_dir):
    m = messages(spark, sf_dir)
    attached = m.select(F.explode_outer(F.transform("attachments", lambda a: a["name"])).alias("name")).filter("name is not null")
    mentioned = m.select(F.explode_outer(F.regexp_extract_all("body", F.lit(r"[A-Za-z]+\.[A-Za-z]+"), F.lit(0))).alias("name"))
    counted = attached.unionAll(mentioned.filter("name is not null")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("mime", guess_mime(F.col("name")))


def _profile_sql() -> tuple[str, str]:
    summary, marks = [], []
    for kind, profiles in corpus.ATTACHMENT_PROFILES.items():
        for words, text, indicators in profiles:
            hit = f"domain = {sql_text(kind)}" + (f" AND {sql_contains_any('lower(name)', words)}" if words else "")
            summary.append(f"WHEN {hit} THEN {sql_text(text)}")
            marks.append(f"WHEN {hit} THEN {sql_list(indicators)}")
    general = (
        "(CASE WHEN (ends_with(lower(name), '.xlsx') OR ends_with(lower(name), '.csv')) AND (contains(lower(name), 'data') OR contains(lower(name), 'export')) "
        "THEN ['data_export'] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN contains(lower(name), 'confidential') OR contains(lower(name), 'sensitive') "
        "THEN ['confidential'] ELSE CAST([] AS VARCHAR[]) END)"
    )
    return (
        f"CASE {' '.join(summary)} ELSE {sql_text(corpus.GENERAL_ATTACHMENT_SUMMARY)} END",
        f"CASE {' '.join(marks)} ELSE {general} END",
    )


_SUMMARY_SQL, _MARKS_SQL = _profile_sql()
_ENRICH_MIME_SQL = (
    "CASE " + " ".join(f"WHEN ends_with(lower(name), {sql_text(e)}) THEN {sql_text(v)}" for e, v in corpus.ENRICH_MIME.items())
    + f" ELSE {sql_text(corpus.DEFAULT_MIME)} END"
)
ENRICHED_SQL = f"""
enriched AS (SELECT msg_id, name, {_ENRICH_MIME_SQL} AS mime, {_SUMMARY_SQL} AS content_summary,
  {_MARKS_SQL} || CASE WHEN risk = 'high' THEN ['{corpus.HIGH_EXPOSURE_INDICATOR}'] ELSE CAST([] AS VARCHAR[]) END AS marks
FROM (SELECT msg_id, unnest(list_transform(attachments, lambda a: a.name)) AS name, {primary_domain_sql()[0]} AS domain, {RECIPIENT_RISK_SQL} AS risk FROM msg))
"""


def _named(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("file_names", F.transform("attachments", lambda a: a["name"]))


@query(
    "enrich_attachments",
    with_messages("SELECT msg_id, name, mime, content_summary, array_to_string(marks, ',') AS indicators FROM enriched", ENRICHED_SQL),
)
def enrich_attachments(spark, sf_dir):
    done = C.enrich_attachments(_named(spark, sf_dir).drop("attachments"))
    flat = done.select("msg_id", F.inline_outer("attachments")).filter("name is not null")
    return flat.select("msg_id", "name", "mime", "content_summary", F.array_join("sensitivity_indicators", ",").alias("indicators"))


@query(
    "convert_messages",
    with_messages(
        """
SELECT c.msg_id, len(p.spans) AS n_spans, coalesce(e.n_attachments, 0) AS n_attachments, c.sensitivity, c.exposure, c.context, c.obfuscation,
  coalesce(src.agent, 'unknown') AS agent
FROM converted c JOIN spans p USING (msg_id) JOIN (SELECT * FROM source_msg) src USING (msg_id)
LEFT JOIN (SELECT msg_id, count(*) AS n_attachments FROM enriched GROUP BY msg_id) e USING (msg_id)
""",
        "source_msg AS (SELECT * FROM msg)",
        *spans_ctes("converter", "longest"),
        ENRICHED_SQL,
        "rich AS (SELECT m.* REPLACE (coalesce(list_transform(e.files, lambda f: {'sensitivity_indicators': f.marks, 'content_summary': f.summary}), []) AS attachments) "
        "FROM source_msg m LEFT JOIN (SELECT msg_id, list({'marks': marks, 'summary': content_summary}) AS files FROM enriched GROUP BY msg_id) e USING (msg_id))",
        CONVERTER_SQL.replace("FROM msg m", "FROM rich m"),
    ),
)
def convert_messages(spark, sf_dir):
    done = C.convert_messages(_named(spark, sf_dir))
    return done.select(
        "msg_id", F.size("spans").alias("n_spans"), F.size("attachments").alias("n_attachments"), "labels.*",
        F.element_at("meta", "agent").alias("agent"),
    )


@query(
    "filter_valid_examples",
    with_messages(
        "SELECT channel, count(*) AS n, CAST(sum(msg_id) AS BIGINT) AS id_sum FROM msg JOIN spans USING (msg_id) "
        "WHERE len(body) >= 10 AND len(recipients) > 0 AND len(spans) <= 20 AND NOT contains(lower(body), 'lorem ipsum') GROUP BY channel",
        *spans_ctes("full", "confidence"),
    ),
)
def filter_valid_examples(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir), "body", "full")
    return _by_channel(K.filter_valid_examples(found))


@query(
    "example_issues",
    with_messages(
        "SELECT issue, count(*) AS n FROM (SELECT unnest((CASE WHEN len(body) < 10 THEN ['Body too short or empty'] ELSE [] END) || "
        "(CASE WHEN len(recipients) = 0 THEN ['No recipients'] ELSE [] END) || (CASE WHEN len(spans) > 20 THEN ['Too many spans (>20)'] ELSE [] END)) AS issue "
        "FROM msg JOIN spans USING (msg_id)) GROUP BY issue",
        *spans_ctes("converter", "longest"),
    ),
)
def example_issues(spark, sf_dir):
    found = K.check_examples(D.detect_spans(messages(spark, sf_dir), "body", "converter"))
    return found.select(F.explode_outer("issues").alias("issue")).filter("issue is not null").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_valid_generated",
    with_messages(_BY_CHANNEL.format("len(subject) > 0 AND len(recipients) > 0 AND len(body) BETWEEN 50 AND 2000 AND NOT " + sql_contains_any("lower(body)", ["lorem ipsum", "placeholder"]))),
)
def filter_valid_generated(spark, sf_dir):
    return _by_channel(K.filter_valid_generated(messages(spark, sf_dir)))


_AGENT_SQL = (
    "CASE agent "
    + " ".join(f"WHEN {sql_text(a)} THEN {sql_contains_any('lower(body)', t)} AND {sql_in('role', r)}" for a, (t, r) in corpus.AGENT_RULES.items())
    + " ELSE true END"
)


@query("filter_agent_rules", with_messages(_BY_CHANNEL.format(_AGENT_SQL)))
def filter_agent_rules(spark, sf_dir):
    return _by_channel(K.filter_agent_rules(messages(spark, sf_dir)))


def _domain_rule_sql(domain: str) -> str:
    terms, roles, indicators = corpus.DOMAIN_RULES[domain]
    return (
        f"{sql_contains_any('lower(body)', terms)} AND {sql_in('role', roles)} AND len(list_filter(attachments, lambda a: NOT (len(a.name) > 0 "
        "AND a.size > 0 AND len(a.mime) > 0 AND len(a.content_summary) > 0 AND len(a.sensitivity_indicators) > 0 "
        f"AND len(list_filter(a.sensitivity_indicators, lambda i: {sql_in('i', indicators)})) > 0))) = 0"
    )


@query(
    "filter_domain_examples",
    with_messages(" UNION ALL ".join(f"SELECT {sql_text(d)} AS domain, count(*) AS n FROM msg WHERE {_domain_rule_sql(d)}" for d in corpus.DOMAIN_RULES)),
)
def filter_domain_examples(spark, sf_dir):
    counts = messages(spark, sf_dir).agg(*[F.count_if(K.follows_domain_rules(d)).alias(d) for d in corpus.DOMAIN_RULES])
    return counts.unpivot([], list(corpus.DOMAIN_RULES), "domain", "n")


@query(
    "valid_attachments",
    with_messages(_BY_CHANNEL.format(
        "len(list_filter(attachments, lambda a: NOT (len(a.name) > 0 AND a.size > 0 AND len(a.mime) > 0 AND len(a.content_summary) > 0 AND len(a.sensitivity_indicators) > 0))) = 0"
    )),
)
def valid_attachments(spark, sf_dir):
    return _by_channel(messages(spark, sf_dir).filter(K.valid_attachments()))


@query(
    "filter_casual",
    with_messages(_BY_CHANNEL.format(f"{sql_contains_any('lower(body)', corpus.CASUAL_TERMS)} AND NOT {sql_contains_any('lower(body)', corpus.FORMAL_TERMS)}")),
)
def filter_casual(spark, sf_dir):
    return _by_channel(K.filter_casual(messages(spark, sf_dir)))


@query(
    "filter_clean",
    with_messages(_BY_CHANNEL.format(
        f"{sql_contains_any('lower(body)', corpus.CLEAN_TERMS)} AND NOT {sql_contains_any('lower(body)', corpus.CLEAN_FORBIDDEN_WORDS)} AND NOT ("
        + " OR ".join(sql_matches("body", p) for p in corpus.CLEAN_FORBIDDEN_PATTERNS) + ")"
    )),
)
def filter_clean(spark, sf_dir):
    return _by_channel(K.filter_clean(messages(spark, sf_dir)))


@query(
    "filter_obfuscated",
    with_messages(_BY_CHANNEL.format(f"len({_TECHNIQUE_SQL}) >= CASE WHEN risk_level IN ('high_risk', 'obfuscated') THEN 2 ELSE 1 END")),
)
def filter_obfuscated(spark, sf_dir):
    return _by_channel(K.filter_obfuscated(messages(spark, sf_dir)))


# -- text functions ---------------------------------------------------------------------------------------------


@query(
    "clean_text",
    with_messages(
        r"SELECT msg_id, md5(cleaned) AS cleaned_md5, len(cleaned) AS cleaned_length, md5(CASE WHEN len(cleaned) <= 200 THEN cleaned WHEN cut > 160 THEN substr(cleaned, 1, cut) || '...' "
        r"ELSE substr(cleaned, 1, 200) || '...' END) AS short_md5 FROM (SELECT *, CASE WHEN contains(substr(cleaned, 1, 200), ' ') THEN 200 - instr(reverse(substr(cleaned, 1, 200)), ' ') ELSE -1 END AS cut "
        r"FROM (SELECT msg_id, trim(regexp_replace(body, '\s+', ' ', 'g')) AS cleaned FROM msg))"
    ),
)
def clean_text_query(spark, sf_dir):
    cleaned = messages(spark, sf_dir).select("msg_id", clean_text(F.col("body")).alias("cleaned"))
    return cleaned.select(
        "msg_id", F.md5("cleaned").alias("cleaned_md5"), F.length("cleaned").alias("cleaned_length"),
        F.md5(truncate_words(F.col("cleaned"), 200)).alias("short_md5"),
    )


_CLEANED_TURN = r"trim(replace(regexp_replace(text, '(?i)\bturn\s*\d+\s*:?\s*', '', 'g'), '```', ''), ' ' || chr(10) || chr(9))"


@query(
    "synth_subject",
    f"SELECT conv_id, turn, {sql_subject('cleaned')} AS subject, md5(cleaned) AS body_md5 FROM (SELECT conv_id, turn, {_CLEANED_TURN} AS cleaned FROM conversations)",
)
def synth_subject_query(spark, sf_dir):
    cleaned = scan(spark, sf_dir, "conversations").select("conv_id", "turn", clean_artifacts(F.col("text")).alias("cleaned"))
    return cleaned.select("conv_id", "turn", synth_subject(F.col("cleaned")).alias("subject"), F.md5("cleaned").alias("body_md5"))


@query(
    "thread_messages",
    "SELECT conv_id, turn AS prior_msgs, role AS sender_role, substr(md5('conv_' || conv_id), 1, 16) AS id_hash FROM conversations",
)
def thread_messages(spark, sf_dir):
    rows = C.turns_to_messages(scan(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "thread.prior_msgs", "sender_role", "thread.id_hash")


@query(
    "parse_conversation",
    "SELECT conv_id, turn AS prior_msgs, 'email' AS channel, md5(text) AS body_md5 FROM conversations",
)
def parse_conversation(spark, sf_dir):
    # A response per block of eight turns, so that no response grows with the longest conversation.
    turns = scan(spark, sf_dir, "conversations").withColumn("block", F.floor(F.col("turn") / 8))
    line = F.to_json(F.struct(F.col("text").alias("body"), F.lit("s").alias("subject")))
    responses = (
        turns.groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
        .select("conv_id", "block", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("response"))
    )
    parsed = C.parse_conversation(responses)
    return parsed.select("conv_id", (F.col("block") * 8 + F.col("prior_msgs")).alias("prior_msgs"), "channel", F.md5("body").alias("body_md5"))


@query(
    "email_functions",
    with_messages(
        r"SELECT address, lower(list_extract(string_split(address, '@'), -1)) AS domain, regexp_matches(address, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS valid, count(*) AS n "
        "FROM (SELECT unnest(recipients) AS address FROM msg) GROUP BY address"
    ),
)
def email_functions(spark, sf_dir):
    addresses = messages(spark, sf_dir).select(F.explode_outer("recipients").alias("address")).filter("address is not null")
    counted = addresses.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("address", T.email_domain(F.col("address")).alias("domain"), valid_email(F.col("address")).alias("valid"), "n")


@query(
    "stable_id",
    "SELECT doc_id, substr(md5('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}'), 1, 16) AS stable_id FROM documents",
)
def stable_id_query(spark, sf_dir):
    return scan(spark, sf_dir, "documents").select("doc_id", stable_id(F.col("doc_id"), F.col("source")).alias("stable_id"))


@query(
    "profile_structure",
    "SELECT key, count(*) AS present, 'BIGINT' AS kinds, min(json_extract_string(props, '$.' || key)) AS sample "
    "FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY key",
)
def profile_structure(spark, sf_dir):
    from riskweave.operators.statistics import profile_structure as profile

    done = profile(scan(spark, sf_dir, "events", spread=False), "props")
    return done.select("key", "present", F.array_join("kinds", ",").alias("kinds"), "sample")


@query(
    "profile_nested_structure",
    """WITH r AS (SELECT event_id, props, event_type, user_id FROM events), f AS (
SELECT 'props' AS key, 'OBJECT' AS kind, props AS sample FROM r UNION ALL SELECT 'props.k', 'BIGINT', CAST(json_extract(props, '$.k') AS VARCHAR) FROM r
UNION ALL SELECT 'risk_' || event_type, CASE WHEN user_id % 2 = 0 THEN 'STRING' ELSE 'BOOLEAN' END, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE 'true' END FROM r)
SELECT key, count(*) AS present, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, CASE WHEN key <> 'props' THEN min(sample) END AS sample, contains(key, 'risk') AS label_candidate FROM f GROUP BY key""",
)
def profile_nested_structure(spark, sf_dir):
    from riskweave.operators.statistics import profile_structure as profile

    e = scan(spark, sf_dir, "events", spread=False)
    own = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('"u'), "user_id", F.lit('"'))).otherwise("true")
    text = F.concat(F.lit('{"props": '), "props", F.lit(', "risk_'), "event_type", F.lit('": '), own, F.lit("}"))
    done = profile(e.select(text.alias("j")), "j", depth=2)
    return done.select("key", "present", F.array_join("kinds", ",").alias("kinds"), F.when(F.col("key") != "props", F.col("sample")).alias("sample"), "label_candidate")
