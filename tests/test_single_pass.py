"""Scores are the same with and without the pass that finds the words, and are computed once."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskweave.fixed import labels as fixed
from riskweave.functions import labels as L
from riskweave.fixed import recipients as recipients_fixed
from riskweave.fixed import span_patterns
from riskweave.functions import recipients as R
from riskweave.functions import spans as S
from riskweave.functions.text import count_matches, literal_starts, total, word_starts
from riskweave.operators import metrics as M

TEXTS = [
    None, "", "SSN 123-45-6789, ssn-ſſn and ſſn; social security", "Unıon ıntern İntern intern internal only internal_only",
    "secretkey secret_key trade secret password: p, api key apikey", "non disclosure nondisclosure nda's NDA", "Key key code-cipheŕ codé",
    "I sell; selling all my data and information, buy database", "employee id emp_id employeeid", "caféreview reviewé _review review_ meeting/discussion",
    "4111 1111 1111 1111 4111111111111111 ٤١١١-1111-1111-1111 415.555.2671", "phone: 5 tel:٥ mobile:x", "$50k for cash payment, pay ① $9k",
    "postgresql://x sk-" + "a" * 25 + " akia" + "B" * 16, "base64 encoded hidden bitcoin dark web tor onion masked " * 3, "x" * 3000 + " urgent asap",
]


def plain_score(text, head):
    parts = [
        F.lit(w) * F.least(count_matches(F.lower(text), p, True) * F.lit(fixed.MATCH_STEP), F.lit(1.0))
        for w, group in fixed.PATTERN_GROUPS[head].values()
        for p in group
    ]
    return F.least(total(parts), F.lit(1.0))


@pytest.mark.parametrize("head", fixed.HEADS)
def test_scores_equal_a_count_of_every_pattern(spark, head):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", L.pattern_scores(F.col("t"), [head])[head].alias("a"), plain_score(F.col("t"), head).alias("b")).collect()
    assert [(r.t, r.a) for r in rows] == [(r.t, r.b) for r in rows]


def test_word_starts():
    assert word_starts(r"\b(ssn|social security)\b") == ["ssn", "social"]
    assert word_starts(r"\b(base64|(?:a|b)c)\b") == [] and word_starts("hacker|rival") == [] and word_starts(r"\b(ab?c|de)\b") == []
    assert word_starts(r"\b(selling|buy)\b.*\b(data|x)\b") == ["selling", "buy"]


def test_calibration_curve_computes_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    score = F.udf(counted, DoubleType()).asNondeterministic()
    rows = [("a", i / 20, i % 2) for i in range(20)] + [("b", 0.5, 1)] * 5
    df = spark.createDataFrame(rows, "head string, s double, truth int").select("head", score("s").alias("score"), "truth")
    curve = M.calibration_curve(df).collect()
    assert {r["head"] for r in curve} == {"a"} and sum(r.n for r in curve) == 20
    assert seen.value == len(rows)


def test_decision_stability_equals_pattern_stability(spark):
    df = spark.createDataFrame([(t or "",) for t in TEXTS], "body string")
    score = lambda text: L.pattern_scores(text, fixed.HEADS)
    assert M.decision_stability(df, score).collect() == M.pattern_stability(df).collect()


CONTENT = [
    None, "", "NDA, \u0130nvoice \u0131nvoice invo\u0131ce", "hr HR chr _hr hr-2", "10-K and 10-q, 110-k, sec filing", "Urgent! please SEND, ur\u017fgent share",
    "don't tell anyone, keep quiet between us", "ta\u017ft \u017fecret data; per\u017fonal information", "delete it\nafter; delete it after", "policy procedure caf\u00e9policy",
    "remove and erase once, wire transfer \u212aeep quiet", "review" * 3 + " review" * 5,
]


def test_content_counts_equal_a_count_of_every_pattern(spark):
    groups = {**recipients_fixed.LEGITIMATE_PATTERNS, "suspicious": recipients_fixed.SUSPICIOUS_PATTERNS}
    plain = F.struct(*[total([count_matches(F.col("t"), p, True) for p in g]).alias(k) for k, g in groups.items()])
    df = spark.createDataFrame([(t,) for t in CONTENT + TEXTS], "t string")
    rows = df.select("t", R.content_counts(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert [(r.t, r.a) for r in rows] == [(r.t, r.b) for r in rows]


def test_content_is_counted_only_where_words_are_found(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(R.content_counts(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in plan


def test_literal_starts():
    assert literal_starts("postgresql://|mysql://") == ["postgresql://", "mysql://"] and literal_starts("AKIA[0-9A-Z]{16}") == ["akia"]
    assert literal_starts(r"\$[0-9]+k\b.*\b(cash|money)\b") == ["$"] and literal_starts("ab?c") == ["a"] and literal_starts("a?b|c") == []


def test_first_letters_leave_no_match_out(spark):
    texts = [
        "nda 5 NDA#7 Matter 12 \u017f Ca\u017fe 9 contract #3",
        "12 Main \u017ftreet, 7 Elm St and 9 Oak Pl; 5 dr", "1 2 3 Berlin, BE 12345",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = {"LEGAL": span_patterns.FULL_LEGAL, "ADDR": span_patterns.FULL_ADDR}
    for i, rule in enumerate(S.ruleset("full")):
        if rule.type in plain:
            other = S.SpanRule(**{**rule.__dict__, "pattern": plain[rule.type]})
            rows = df.select(F.expr(S.rule_matches("t", rule, i)).alias("a"), F.expr(S.rule_matches("t", other, i)).alias("b")).collect()
            assert [r.a for r in rows] == [r.b for r in rows]
