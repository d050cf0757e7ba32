"""Span detection said in SQL, for the checks: matches, offsets, validity tests and overlap rules."""

from __future__ import annotations

from riskweave.fixed import span_patterns as fixed
from riskweave.plans.message_view import sql_contains_any, sql_folded, sql_in, sql_lookup, sql_regex, sql_text

_DIGITS = "regexp_replace({t}, '[^0-9]', '', 'g')"


def sql_luhn(digits: str) -> str:
    digit = f"CAST(substr({digits}, len({digits}) - i + 1, 1) AS INT)"
    weighted = f"CASE WHEN i % 2 = 0 THEN 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END ELSE {digit} END"
    return f"(coalesce(list_sum(list_transform(range(1, len({digits}) + 1), lambda i: {weighted})), 0) % 10 = 0)"


def _keep(ruleset: str, kind: str, pattern: str) -> str | None:
    d = _DIGITS.format(t="m.text")
    if ruleset == "full":
        return {
            "PHONE": f"len({d}) >= 7",
            "PAN": f"len({d}) >= 13 AND {sql_luhn(d)}",
            "SSN": f"len({d}) = 9 AND NOT starts_with({d}, '000')",
            "NAME": f"NOT {sql_in('m.text', fixed.FULL_NAME_STOP_LIST)} AND len(string_split_regex(m.text, '\\s+')) <= 3",
            "SECRET": "len(m.text) >= 16 AND regexp_matches(m.text, '[A-Za-z]') AND regexp_matches(m.text, '[0-9]')",
        }.get(kind)
    if kind == "PAN" and ruleset in ("converter", "converter_strict_names", "generator"):
        return sql_luhn(d)
    if kind == "NAME" and ruleset.startswith("converter"):
        return "NOT " + sql_contains_any("lower(m.text)", [p.lower() for p in fixed.CONVERTER_NAME_STOP_PHRASES])
    if kind == "NAME" and ruleset == "generator":
        return "NOT " + sql_contains_any("lower(m.text)", fixed.GENERATOR_NAME_STOP_PHRASES)
    if "(?=" in pattern:  # look-ahead to the end of the line, as a test on what follows
        rest = "regexp_extract(substr(body, CAST(m.start AS BIGINT) + len(m.text) + 1), '^.*')"
        return " AND ".join(f"regexp_matches({rest}, '{c}')" for c in ("[A-Z]", "[a-z]", "[0-9]"))
    return None


def _type(ruleset: str, kind: str) -> str:
    if ruleset == "full" and kind == "LEGAL":
        u = "upper(m.text)"
        return (
            f"CASE WHEN starts_with({u}, 'NDA') THEN 'NDA' WHEN starts_with({u}, 'MATTER') THEN 'MATTER' "
            f"WHEN starts_with({u}, 'CASE') THEN 'CASE' ELSE 'LEGAL' END"
        )
    if ruleset == "generator" and kind == "NDA":
        return "CASE WHEN contains(upper(m.text), 'NDA') THEN 'NDA' ELSE 'MATTER' END"
    return sql_text(kind)


def _rules(ruleset: str) -> list[tuple[str, str, bool, float]]:
    if ruleset == "full":
        return [
            ("EMAIL", fixed.EMAIL, True, 1.0), ("PHONE", fixed.FULL_PHONE, True, 1.0), ("PAN", fixed.FULL_PAN, True, 1.0),
            ("SSN", fixed.FULL_SSN, False, 1.0), ("NAME", fixed.FULL_NAME, False, 0.8), ("ADDR", fixed.FULL_ADDR, True, 0.9),
            ("DBURI", fixed.FULL_DBURI, True, 1.0), ("SECRET", fixed.FULL_SECRET, True, 0.9), ("LEGAL", fixed.FULL_LEGAL, True, 1.0),
        ]
    if ruleset.startswith("converter"):
        strict = ruleset == "converter_strict_names"
        return [(k, p, not (strict and k == "NAME"), 1.0) for k, p in fixed.CONVERTER]
    if ruleset == "semantic":
        return [(k, p, True, 1.0) for k, p in fixed.TRADITIONAL + fixed.SEMANTIC + fixed.EUPHEMISM]
    if ruleset == "traditional":
        return [(k, p, False, 1.0) for k, p in fixed.TRADITIONAL]
    if ruleset == "semantic_only":
        return [(k, p, True, 1.0) for k, p in fixed.SEMANTIC]
    if ruleset == "synth":
        return [(k, p, i, 1.0) for k, p, i in fixed.SYNTH]
    return [(k, p, i, 1.0) for k, p, i in fixed.GENERATOR]


def _without_look_ahead(pattern: str) -> str:
    return pattern.split("(?=")[0]


def raw_spans_cte(ruleset: str, name: str = "raw", source: str = "msg", text: str = "body") -> str:
    """CTE (msg_id, s): all matches as rows, before any overlap rule. Offsets are running lengths."""
    parts = []
    for number, (kind, pattern, ignore, confidence) in enumerate(_rules(ruleset)):
        regex = sql_regex(_without_look_ahead(pattern), ignore)
        test = _keep(ruleset, kind, pattern) or "true"
        parts.append(
            f"""
SELECT msg_id, {{'start': CAST(m.start AS INT), 'rule': {number}, 'end': CAST(m.start + len(m.text) AS INT),
  'type': {_type(ruleset, kind)}, 'text': m.text, 'confidence': CAST({confidence} AS DOUBLE)}} AS s
FROM (
  SELECT msg_id, body, {{'start': reach - len(hit), 'text': substr(body, CAST(reach - len(hit) AS BIGINT) + 1, len(hit))}} AS m
  FROM (
    SELECT msg_id, body, hit, sum(len(gap) + len(hit)) OVER (PARTITION BY msg_id ORDER BY k) AS reach
    FROM (
      SELECT msg_id, body, unnest(hits) AS hit, unnest(list_slice(gaps, 1, len(hits))) AS gap, unnest(range(len(hits))) AS k
      FROM (
        SELECT msg_id, body, regexp_extract_all(folded, {regex}) AS hits, string_split_regex(folded, {regex}) AS gaps
        FROM {name}_text WHERE regexp_matches(folded, {regex})))))
WHERE {test}"""
        )
    return (
        f"{name}_text AS (SELECT msg_id, {text} AS body, {sql_folded(text)} AS folded FROM {source}),\n"
        f"{name} AS (" + " UNION ALL ".join(parts) + ")"
    )


_EMPTY = (
    'CAST([] AS STRUCT("start" INT, "rule" INT, "end" INT, "type" VARCHAR, "text" VARCHAR, confidence DOUBLE)[])'
)


def resolved_cte(overlap: str, name: str = "flat", source: str = "raw") -> str:
    """CTE (msg_id, s) with an overlap rule applied: a left fold inside each stretch of touching spans."""
    if overlap == "confidence":
        rival = "list_filter(acc, lambda k: x[1].start < k.end AND x[1].end > k.start)[1]"
        better = (
            f"(x[1].confidence > {rival}.confidence OR (x[1].confidence = {rival}.confidence "
            f"AND x[1].end - x[1].start > {rival}.end - {rival}.start))"
        )
        body = (
            f"CASE WHEN {rival} IS NULL THEN acc || x WHEN {better} "
            f"THEN list_filter(acc, lambda k: NOT (k.start = {rival}.start AND k.rule = {rival}.rule)) || x ELSE acc END"
        )
    elif overlap == "longest":
        rank = lambda s: sql_lookup(f"{s}.type", fixed.TYPE_PRIORITY, "0")
        longer = "x[1].end - x[1].start > acc[-1].end - acc[-1].start"
        equal = "x[1].end - x[1].start = acc[-1].end - acc[-1].start"
        body = (
            f"CASE WHEN len(acc) = 0 OR x[1].start >= acc[-1].end THEN acc || x "
            f"WHEN {longer} OR ({equal} AND {rank('x[1]')} > {rank('acc[-1]')}) THEN list_slice(acc, 1, len(acc) - 1) || x ELSE acc END"
        )
    elif overlap == "distinct":
        body = "CASE WHEN len(list_filter(acc, lambda k: k.start = x[1].start AND k.end = x[1].end)) > 0 THEN acc ELSE acc || x END"
    else:
        return f"{name} AS (SELECT msg_id, s FROM {source})"
    return f"""
{name}_edges AS (
  SELECT msg_id, s, coalesce(s.start >= max(s.end) OVER (PARTITION BY msg_id ORDER BY s.start, s.rule
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM {source}),
{name}_islands AS (
  SELECT msg_id, list([s] ORDER BY s.start, s.rule) AS members FROM (
    SELECT msg_id, s, sum(CAST(fresh AS INT)) OVER (PARTITION BY msg_id ORDER BY s.start, s.rule) AS island FROM {name}_edges)
  GROUP BY msg_id, island),
{name} AS (
  SELECT msg_id, unnest(CASE WHEN len(members) = 1 THEN members[1] ELSE list_reduce(members, lambda acc, x: {body}, {_EMPTY}) END) AS s
  FROM {name}_islands)"""


def spans_ctes(ruleset: str, overlap: str, source: str = "msg", text: str = "body") -> list[str]:
    """CTEs ending in flat (msg_id, s) and spans (msg_id, spans): one row per message, also without spans."""
    grouped = (
        f"spans AS (SELECT m.msg_id, coalesce(g.spans, {_EMPTY}) AS spans FROM {source} m LEFT JOIN "
        "(SELECT msg_id, list(s ORDER BY s.start, s.rule) AS spans FROM flat GROUP BY msg_id) g USING (msg_id))"
    )
    return [raw_spans_cte(ruleset, source=source, text=text), resolved_cte(overlap), grouped]
