"""Span detection, overlap rules, tags and obfuscation over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.fixed import span_patterns as fixed
from riskweave.functions import obfuscation
from riskweave.functions import spans as S
from riskweave.operators import detection as D
from riskweave.plans.message_view import (
    messages,
    sql_contains_any,
    sql_folded,
    sql_matches,
    sql_text,
    with_messages,
)
from riskweave.plans.registry import query
from riskweave.plans.sql_spans import raw_spans_cte, resolved_cte, spans_ctes, sql_luhn

_PER_TYPE_SQL = """
SELECT s.type AS span_type, count(*) AS n_spans, count(DISTINCT msg_id) AS n_messages,
  CAST(sum(s.start) AS BIGINT) AS sum_start, CAST(sum(s.end - s.start) AS BIGINT) AS sum_length
FROM flat GROUP BY s.type
"""


def _per_type(df):
    return (
        D.spans_table(df)
        .groupBy(F.col("type").alias("span_type"))
        .agg(
            F.count(F.lit(1)).alias("n_spans"),
            F.countDistinct("msg_id").alias("n_messages"),
            F.sum(F.col("start").cast("long")).alias("sum_start"),
            F.sum((F.col("end") - F.col("start")).cast("long")).alias("sum_length"),
        )
    )


@query(
    "spans_full",
    with_messages(
        "SELECT msg_id, s.type AS span_type, s.start AS span_start, s.end AS span_end, s.text AS span_text, "
        "s.confidence AS confidence FROM flat",
        *spans_ctes("full", "confidence"),
    ),
)
def spans_full(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir).select("msg_id", "body"), "body", "full")
    return D.spans_table(found).select(
        "msg_id",
        F.col("type").alias("span_type"),
        F.col("start").alias("span_start"),
        F.col("end").alias("span_end"),
        F.col("text").alias("span_text"),
        "confidence",
    )


def _register_ruleset(ruleset: str):
    @query(f"spans_{ruleset}", with_messages(_PER_TYPE_SQL, *spans_ctes(ruleset, S.DEFAULT_OVERLAP[ruleset])))
    def build(spark, sf_dir):
        return _per_type(D.detect_spans(messages(spark, sf_dir).select("msg_id", "body"), "body", ruleset))


for _name in (
    "converter", "converter_strict_names", "semantic", "traditional", "semantic_only", "synth", "generator",
):
    _register_ruleset(_name)


@query(
    "luhn_valid",
    with_messages(
        f"SELECT msg_id, digits, {sql_luhn('digits')} AS valid FROM (SELECT DISTINCT msg_id, regexp_replace(c, '[^0-9]', '', 'g') AS digits "
        r"FROM (SELECT msg_id, unnest(regexp_extract_all(body, '\d[\d -]{11,}\d')) AS c FROM msg))"
    ),
)
def luhn_valid(spark, sf_dir):
    runs = messages(spark, sf_dir).select(
        "msg_id", F.explode(F.regexp_extract_all("body", F.lit(r"\d[\d -]{11,}\d"), F.lit(0))).alias("c")
    )
    digits = runs.select("msg_id", S.digits_of(F.col("c")).alias("digits")).distinct()
    return digits.withColumn("valid", S.luhn_valid("digits"))


def _register_overlap(rule: str):
    @query(f"overlap_{rule}", with_messages(_PER_TYPE_SQL, raw_spans_cte("full"), resolved_cte(rule)))
    def build(spark, sf_dir):
        raw = D.detect_spans(messages(spark, sf_dir).select("msg_id", "body"), "body", "full", "none")
        return _per_type(D.resolve_overlaps(raw, rule))


for _name in ("confidence", "longest"):
    _register_overlap(_name)


@query(
    "overlap_pairs",
    with_messages(
        """
SELECT a.msg_id, a.s.type AS first_type, a.s.start AS first_start, a.s.end AS first_end,
  b.s.type AS second_type, b.s.start AS second_start, b.s.end AS second_end
FROM raw a JOIN raw b ON a.msg_id = b.msg_id AND a.s.start < b.s.end AND a.s.end > b.s.start
  AND (a.s.start < b.s.start OR (a.s.start = b.s.start AND a.s.rule < b.s.rule))
""",
        raw_spans_cte("full"),
    ),
)
def overlap_pairs(spark, sf_dir):
    raw = D.detect_spans(messages(spark, sf_dir).select("msg_id", "body"), "body", "full", "none")
    return D.overlap_pairs(raw)


@query(
    "overlap_counts",
    with_messages(
        """
SELECT a.msg_id, any_value(a.s.type) AS type, a.s.start AS start, any_value(a.s.end) AS end, CAST(count(b.s) AS INT) AS rivals,
  arg_min(b.s.type, (b.s.start, b.s.rule)) AS first_type, arg_min(b.s.start, (b.s.start, b.s.rule)) AS first_start,
  arg_min(b.s.end, (b.s.start, b.s.rule)) AS first_end
FROM raw a LEFT JOIN raw b ON a.msg_id = b.msg_id AND a.s.start < b.s.end AND a.s.end > b.s.start AND (a.s.start <> b.s.start OR a.s.rule <> b.s.rule)
GROUP BY a.msg_id, a.s.start, a.s.rule
""",
        raw_spans_cte("full").replace("raw AS (", "raw AS MATERIALIZED ("),
    ),
)
def overlap_counts(spark, sf_dir):
    raw = D.detect_spans(messages(spark, sf_dir).select("msg_id", "body"), "body", "full", "none")
    return D.overlap_counts(raw)


_COMBINED_SQL = (
    "subject || chr(10) || chr(10) || body || CASE WHEN len(attachments) > 0 THEN chr(10) || chr(10) || 'Attachments: ' || "
    "array_to_string(list_transform(attachments, lambda a: a.name), ', ') ELSE '' END"
)


@query(
    "span_bounds",
    with_messages(
        """
SELECT msg_id, len(spans) AS found,
  len(list_filter(spans, lambda s: s.start >= 0 AND s.end <= len(plain) AND s.start < s.end)) AS inside
FROM spans JOIN (SELECT msg_id, body AS plain FROM msg) USING (msg_id)
""",
        *spans_ctes("full", "confidence", text=_COMBINED_SQL),
    ),
)
def span_bounds(spark, sf_dir):
    from riskweave.operators.labeling import combined_text

    found = D.detect_spans(
        messages(spark, sf_dir).select("msg_id", "body", combined_text().alias("combined")), "combined", "full"
    )
    kept = D.validate_span_bounds(found, "body")
    return kept.select("msg_id", F.size("spans").alias("found"), F.size("valid_spans").alias("inside"))


@query(
    "span_boundary_check",
    with_messages("SELECT count(*) AS messages, CAST(sum(len(spans)) AS BIGINT) AS spans, 0 AS violations FROM spans", *spans_ctes("full", "confidence")),
)
def span_boundary_check(spark, sf_dir):
    from riskweave.operators.packing import serialize_dsl

    found = D.detect_spans(messages(spark, sf_dir), "body", "full")
    marked = serialize_dsl(found).select("msg_id", "markup.*")
    return D.span_boundary_check(marked, "text")


@query(
    "bio_char_tags",
    with_messages(
        """
SELECT tag, CAST(sum(n) AS BIGINT) AS n_chars FROM (
  SELECT 'B-' || s.type AS tag, 1 AS n FROM flat UNION ALL
  SELECT 'I-' || s.type, s.end - s.start - 1 FROM flat WHERE s.end - s.start > 1 UNION ALL
  SELECT 'O', len(body) - coalesce(list_sum(list_transform(spans, lambda s: s.end - s.start)), 0) FROM spans JOIN msg USING (msg_id))
GROUP BY tag
""",
        *spans_ctes("full", "confidence"),
    ),
)
def bio_char_tags(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir).select("msg_id", "body"), "body", "full")
    tagged = D.bio_char_tags(found, "body")
    return tagged.select(F.explode_outer("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_chars"))


@query(
    "bio_token_tags",
    with_messages(
        """
SELECT tag_id, count(*) AS n_tokens FROM (
  SELECT coalesce((SELECT CASE WHEN max(s.start) >= t.tok_start THEN 2 * list_position(types, arg_max(s.type, s.start)) - 1
      ELSE 2 * list_position(types, arg_max(s.type, s.start)) END
    FROM (SELECT unnest(t.spans) AS s) WHERE s.start < t.tok_end AND s.end > t.tok_start), 0) AS tag_id
  FROM tokens t, (SELECT ['EMAIL', 'PHONE', 'PAN', 'SSN', 'SECRET', 'DBURI', 'NDA', 'MATTER', 'NAME', 'ADDR'] AS types))
GROUP BY tag_id
""",
        *spans_ctes("full", "confidence"),
        r"""pieces AS (SELECT msg_id, spans, regexp_extract_all(body, '[^ \n]+') AS words, string_split_regex(body, '[^ \n]+') AS gaps FROM spans JOIN msg USING (msg_id))""",
        """numbered AS (SELECT msg_id, spans, unnest(words) AS word, unnest(list_slice(gaps, 1, len(words))) AS gap,
  unnest(range(1, len(words) + 1)) AS k FROM pieces)""",
        """tokens AS (SELECT msg_id, spans, tok_end - len(word) AS tok_start, tok_end FROM (SELECT *, CAST(sum(len(gap) + len(word))
  OVER (PARTITION BY msg_id ORDER BY k) AS BIGINT) AS tok_end FROM numbered))""",
    ),
)
def bio_token_tags(spark, sf_dir):
    found = D.detect_spans(messages(spark, sf_dir).select("msg_id", "body"), "body", "full")
    tagged = D.bio_token_tags(found.withColumn("tokens", S.token_ranges("body", r"[^ \n]+")))
    return tagged.select(F.explode_outer("tag_ids").alias("tag_id")).groupBy("tag_id").agg(F.count(F.lit(1)).alias("n_tokens"))


def _sql_flags(text: str) -> dict[str, str]:
    folded = sql_folded(text)
    flags = {"base64": sql_contains_any(f"lower({text})", ["base64", "encoded"])}
    for name, pattern in fixed.OBFUSCATION_FLAG_PATTERNS.items():
        flags[name] = sql_matches(folded, pattern, True)
    decomposing = f"len({text}) - len(regexp_replace({text}, '[À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ]', '', 'g'))"
    flags["unicode_tricks"] = (
        f"({sql_contains_any(text, list(fixed.ZERO_WIDTH_CHARACTERS))} OR len({text}) + {decomposing} > len(nfc_normalize({text})) * CAST(1.1 AS DOUBLE))"
    )
    return flags


@query(
    "obfuscation_flags",
    with_messages("SELECT msg_id, " + ", ".join(f"{c} AS {n}" for n, c in _sql_flags("body").items()) + " FROM msg"),
)
def obfuscation_flags(spark, sf_dir):
    flagged = D.detect_obfuscation(messages(spark, sf_dir).select("msg_id", "body"))
    return flagged.drop("body")


_TECHNIQUE_SQL = " || ".join(
    f"(CASE WHEN {sql_contains_any(text, terms)} THEN [{sql_text(name)}] ELSE CAST([] AS VARCHAR[]) END)"
    for name, text, terms in [
        ("numerical_words", "lower(body)", fixed.TECHNIQUE_NUMBER_WORDS),
        ("textual_decomposition", "body", fixed.TECHNIQUE_DECOMPOSITION),
        ("euphemisms", "lower(body)", fixed.TECHNIQUE_EUPHEMISM),
        ("contextual_reference", "lower(body)", fixed.TECHNIQUE_REFERENCE),
        ("multilingual", "lower(body)", fixed.TECHNIQUE_SPANISH),
    ]
)


@query(
    "obfuscation_techniques",
    with_messages(f"SELECT msg_id, array_to_string({_TECHNIQUE_SQL}, ',') AS techniques FROM msg"),
)
def obfuscation_techniques(spark, sf_dir):
    named = D.obfuscation_techniques(messages(spark, sf_dir).select("msg_id", "body"))
    return named.select("msg_id", F.array_join("techniques", ",").alias("techniques"))


@query(
    "obfuscation_regex_flag",
    with_messages(
        "SELECT msg_id, " + " OR ".join(sql_matches("body", p, True) for p in fixed.CONVERTER_OBFUSCATION) + " AS flag FROM msg"
    ),
)
def obfuscation_regex_flag(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", obfuscation.regex_flag(F.col("body")).alias("flag"))


@query(
    "non_ascii_flag",
    with_messages(
        r"SELECT channel, count(*) AS n_messages, count(*) FILTER (regexp_matches(body, '[^\x00-\x7F]')) AS homoglyph, "
        "count(*) FILTER (contains(lower(body), 'base64')) AS base64 FROM msg GROUP BY channel"
    ),
)
def non_ascii_flag(spark, sf_dir):
    return (
        messages(spark, sf_dir)
        .groupBy("channel")
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.count_if(obfuscation.non_ascii(F.col("body"))).alias("homoglyph"),
            F.count_if(F.lower("body").contains("base64")).alias("base64"),
        )
    )


@query(
    "mask_spans",
    with_messages(
        r"SELECT msg_id, md5(masked) AS masked_md5, len(masked) AS masked_length, len(regexp_extract_all(masked, '\*\*\*')) AS stars FROM ("
        r"SELECT msg_id, regexp_replace(regexp_replace(body, '(\d{3})-(\d{2})-(\d{4})', '***-**-\3', 'g'), "
        r"'(\d{4})\s*(\d{4})\s*(\d{4})\s*(\d{4})', '****-****-****-\4', 'g') AS masked FROM msg)"
    ),
)
def mask_spans(spark, sf_dir):
    masked = D.mask_spans(messages(spark, sf_dir).select("msg_id", "body"))
    return masked.select(
        "msg_id",
        F.md5("masked").alias("masked_md5"),
        F.length("masked").alias("masked_length"),
        F.regexp_count("masked", F.lit(r"\*\*\*")).alias("stars"),
    )


