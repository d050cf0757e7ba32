"""Metrics, calibration and decisions over scores of the messages and the given labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.fixed import labels as fixed
from riskweave.fixed import span_patterns
from riskweave.functions import labels as L
from riskweave.functions.spans import bio_vocabulary, let
from riskweave.operators import calibration as Cal
from riskweave.operators import detection as D
from riskweave.operators import labeling as B
from riskweave.operators import metrics as M
from riskweave.plans.label_queries import (
    MEAN_SQL,
    PATTERN_SQL,
    RISK_SQL,
    _pattern_score_sql,
    dbl,
    decision_sql,
    head_columns,
    round_sql,
    rounded,
    scored,
)
from riskweave.plans.message_view import (
    messages,
    scan,
    sql_contains_any,
    sql_count_contained,
    sql_folded,
    sql_text,
    sql_uniform,
    with_messages,
)
from riskweave.plans.registry import query
from riskweave.plans.sql_spans import raw_spans_cte, resolved_cte
from riskweave.plans.statistics_queries import round_all
from riskweave.session import reliable_checkpoint

HEADS = fixed.HEADS


def truth_scores(spark, sf_dir):
    """Score rows with truth: sensitivity against quality, exposure against toxic."""
    truth = scan(spark, sf_dir, "labels", spread=False)
    # The labelled ids are a small part of the corpus: narrow scores first, then join on the id.
    wide = scored(spark, sf_dir).select("msg_id", "scores").join(truth, F.col("msg_id") == F.col("doc_id"))
    rows = F.array(
        F.struct(F.lit("sensitivity").alias("head"), F.round("scores.sensitivity", 6).alias("score"), F.col("quality").alias("truth")),
        F.struct(F.lit("exposure").alias("head"), F.round("scores.exposure", 6).alias("score"), F.col("toxic").alias("truth")),
    )
    return wide.select("msg_id", F.inline(rows))


SCORES_SQL = """
scores AS (SELECT msg_id, 'sensitivity' AS head, round(sensitivity, 6) AS score, quality AS truth FROM pattern JOIN labels ON msg_id = doc_id
  UNION ALL SELECT msg_id, 'exposure', round(exposure, 6), toxic FROM pattern JOIN labels ON msg_id = doc_id)
"""


@query(
    "binary_metrics",
    with_messages(
        """
SELECT head, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (
  SELECT head, count(*) FILTER (score > 0.5 AND truth = 1) AS tp, count(*) FILTER (score > 0.5 AND truth = 0) AS fp,
    count(*) FILTER (score <= 0.5 AND truth = 0) AS tn, count(*) FILTER (score <= 0.5 AND truth = 1) AS fn FROM scores GROUP BY head))
""",
        PATTERN_SQL,
        SCORES_SQL,
    ),
)
def binary_metrics(spark, sf_dir):
    return round_all(M.binary_metrics(truth_scores(spark, sf_dir)), ["precision", "recall", "accuracy", "f1"])


_CURVE_SQL = """
tied AS (SELECT head, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM scores GROUP BY head, score),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY head) AS p, sum(neg) OVER (PARTITION BY head) AS n
  FROM tied WINDOW w AS (PARTITION BY head ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""


@query(
    "ranking_metrics",
    with_messages(
        """
SELECT head, round(sum(neg * (tp - pos) + neg * pos / 2) / (max(p) * max(n)), 6) AS auroc, round(sum(pos * tp / (tp + fp)) / max(p), 6) AS auprc,
  round(arg_min(fp / n, (abs(tp / p - 0.95::DOUBLE), score)), 6) AS fpr_at_recall FROM curve GROUP BY head
""",
        PATTERN_SQL,
        SCORES_SQL,
        _CURVE_SQL,
    ),
)
def ranking_metrics(spark, sf_dir):
    return round_all(M.ranking_metrics(truth_scores(spark, sf_dir)), ["auroc", "auprc", "fpr_at_recall"])


@query(
    "ranking_curve",
    with_messages("SELECT head, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM curve", PATTERN_SQL, SCORES_SQL, _CURVE_SQL),
)
def ranking_curve(spark, sf_dir):
    return M.ranking_curve(truth_scores(spark, sf_dir)).select("head", "score", "tp", "fp")


_EDGES = "[" + ", ".join(f"CAST({i / 10} AS DOUBLE)" for i in range(11)) + "]"


@query(
    "calibration_curve",
    with_messages(
        f"SELECT head, least(len(list_filter({_EDGES}, lambda e: e <= score)) - 1, 9) AS bin, count(*) AS n, round(avg(truth), 6) AS fraction_of_positives, "
        "round(avg(score), 6) AS mean_predicted_value FROM scores GROUP BY 1, 2",
        PATTERN_SQL,
        SCORES_SQL,
    ),
)
def calibration_curve(spark, sf_dir):
    return round_all(M.calibration_curve(truth_scores(spark, sf_dir)), ["fraction_of_positives", "mean_predicted_value"])


@query(
    "ece",
    with_messages(
        "SELECT head, round(sum(CASE WHEN bin > 0 THEN gap * n ELSE 0 END) / sum(n), 6) AS ece FROM ("
        f"SELECT head, len(list_filter({_EDGES}, lambda e: e < score)) AS bin, count(*) AS n, abs(avg(score) - avg(truth)) AS gap FROM scores GROUP BY 1, 2) GROUP BY head",
        PATTERN_SQL,
        SCORES_SQL,
    ),
)
def ece(spark, sf_dir):
    return round_all(M.expected_calibration_error(truth_scores(spark, sf_dir)), ["ece"])


# -- tags -------------------------------------------------------------------------------------------------------


def _tag_table(spark, sf_dir):
    """Token tags of the full rule set as truth and of the traditional one as prediction; every 50th token ignored."""
    from riskweave.functions import spans as S

    both = D.detect_spans(messages(spark, sf_dir).select("msg_id", "body"), "body", "full", out="a")
    both = D.detect_spans(both, "body", "traditional", "confidence", out="b").withColumn("tokens", S.token_ranges("body", r"[^ \n]+"))
    tagged = D.bio_token_tags(D.bio_token_tags(both, spans="a", out="t"), spans="b", out="pred")
    return tagged.select("msg_id", "pred", F.transform("t", lambda x, i: F.when(i % 50 == 49, -100).otherwise(x)).alias("truth"))


_TYPES_SQL = "['" + "', '".join(span_patterns.BIO_TYPES["training"]) + "']"


def _token_tag_sql(spans: str) -> str:
    """The tag of a token from the last span that reaches into it."""
    place = f"list_position({_TYPES_SQL}, arg_max(s.type, s.start))"
    return (
        f"coalesce((SELECT 2 * {place} - CASE WHEN max(s.start) >= t.tok_start THEN 1 ELSE 0 END FROM (SELECT unnest(t.{spans}) AS s) "
        "WHERE s.start < t.tok_end AND s.end > t.tok_start), 0)"
    )


# tags(msg_id, k, pred, truth): every token that isn't ignored.
TAG_CTES = [
    raw_spans_cte("full", "raw_a"), resolved_cte("confidence", "flat_a", "raw_a"),
    raw_spans_cte("traditional", "raw_b"), resolved_cte("confidence", "flat_b", "raw_b"),
    """both_spans AS (SELECT msg_id, body, a.spans AS a, b.spans AS b FROM msg
  LEFT JOIN (SELECT msg_id, list(s) AS spans FROM flat_a GROUP BY msg_id) a USING (msg_id) LEFT JOIN (SELECT msg_id, list(s) AS spans FROM flat_b GROUP BY msg_id) b USING (msg_id))""",
    r"""pieces AS (SELECT msg_id, a, b, regexp_extract_all(body, '[^ \n]+') AS words, string_split_regex(body, '[^ \n]+') AS gaps FROM both_spans)""",
    "numbered AS (SELECT msg_id, a, b, unnest(words) AS word, unnest(list_slice(gaps, 1, len(words))) AS gap, unnest(range(1, len(words) + 1)) AS k FROM pieces)",
    """tokens AS (SELECT msg_id, k, a, b, tok_end - len(word) AS tok_start, tok_end FROM (SELECT *, CAST(sum(len(gap) + len(word))
  OVER (PARTITION BY msg_id ORDER BY k) AS BIGINT) AS tok_end FROM numbered))""",
    f"tags AS MATERIALIZED (SELECT msg_id, k, {_token_tag_sql('b')} AS pred, {_token_tag_sql('a')} AS truth FROM tokens t WHERE k % 50 <> 0)",
]
_RATIO = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"


@query(
    "token_metrics",
    with_messages(
        f"""
SELECT round(sum(tp) / sum(support), 6) AS span_accuracy, round(sum(f) FILTER (tag > 0) / 20, 6) AS span_f1_macro,
  round(sum(p * support) / sum(support), 6) AS token_precision, round(sum(r * support) / sum(support), 6) AS token_recall, round(sum(f * support) / sum(support), 6) AS token_f1,
  round(sum(pp * support) FILTER (tag > 0) / sum(support) FILTER (tag > 0), 6) AS pii_precision, round(sum(r * support) FILTER (tag > 0) / sum(support) FILTER (tag > 0), 6) AS pii_recall,
  round(sum(pf * support) FILTER (tag > 0) / sum(support) FILTER (tag > 0), 6) AS pii_f1
FROM (SELECT *, {_RATIO('2 * p * r', '(p + r)')} AS f, {_RATIO('2 * pp * r', '(pp + r)')} AS pf FROM (
  SELECT tag, tp, support, {_RATIO('tp', 'predicted')} AS p, {_RATIO('tp', 'support')} AS r, {_RATIO('tp', 'predicted_pii')} AS pp FROM (
    SELECT tag, count(*) FILTER (pred = tag AND truth = tag) AS tp, count(*) FILTER (pred = tag) AS predicted, count(*) FILTER (truth = tag) AS support, count(*) FILTER (pred = tag AND truth > 0) AS predicted_pii
    FROM tags, (SELECT pred AS tag FROM tags UNION SELECT truth FROM tags) GROUP BY tag)))
""",
        *TAG_CTES,
    ),
)
def token_metrics(spark, sf_dir):
    done = M.token_metrics(_tag_table(spark, sf_dir), len(bio_vocabulary("training")))
    return round_all(done, done.columns)


def _entities_sql(tag: str) -> str:
    """(msg_id, type, first, last): a B- opens, an I- goes on or, with another type, opens; without an open one it is
    outside."""
    return f"""SELECT msg_id, any_value(kind) AS kind, min(i) AS first, max(i) AS last FROM (
  SELECT *, count(*) FILTER (starts) OVER (PARTITION BY msg_id ORDER BY i) AS number FROM (
    SELECT *, tag % 2 = 1 OR kind <> before AS starts FROM (
      SELECT *, lag(kind) OVER (PARTITION BY msg_id ORDER BY i) AS before FROM (
        SELECT *, count(*) FILTER (tag % 2 = 1) OVER (PARTITION BY msg_id, gap ORDER BY i) > 0 AS open FROM (
          SELECT msg_id, i, {tag} AS tag, ({tag} + 1) // 2 AS kind, count(*) FILTER ({tag} = 0) OVER (PARTITION BY msg_id ORDER BY i) AS gap
          FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY k) AS i FROM tags)))
      WHERE tag > 0 AND open)))
GROUP BY msg_id, number"""


@query(
    "entity_f1",
    with_messages(
        f"""
SELECT tp, predicted, actual, round({_RATIO('tp', 'predicted')}, 6) AS precision, round({_RATIO('tp', 'actual')}, 6) AS recall,
  round({_RATIO('2 * tp', '(predicted + actual)')}, 6) AS entity_f1
FROM (SELECT (SELECT count(*) FROM p JOIN t USING (msg_id, kind, first, last)) AS tp, (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM t) AS actual)
""",
        *TAG_CTES,
        f"p AS ({_entities_sql('pred')})",
        f"t AS ({_entities_sql('truth')})",
    ),
)
def entity_f1(spark, sf_dir):
    return round_all(M.entity_f1(_tag_table(spark, sf_dir)), ["precision", "recall", "entity_f1"])


@query(
    "exact_match",
    """SELECT count(*) AS total, count(*) FILTER (p = t) AS equal_outputs, count(*) FILTER (n > 0 AND ok = n) AS exact_sequences, round(avg(ok / n) FILTER (n > 0), 6) AS mean_accuracy
FROM (SELECT p, t, len(list_filter(t, lambda x: x <> -100)) AS n, len(list_filter(range(1, len(t) + 1), lambda i: t[i] <> -100 AND t[i] = p[i])) AS ok FROM (
  SELECT list_transform(range(1, len(embedding) + 1), lambda i: CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 10) % 10 AS INT)) AS p,
    list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i = 9 THEN -100 ELSE CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 10) % 10 AS INT) * CASE WHEN vec_id % 3 = 0 THEN 1 ELSE i % 2 END END) AS t FROM embeddings))""",
)
def exact_match(spark, sf_dir):
    value = lambda x: (F.floor(F.abs(x.cast("double")) * 10) % 10).cast("int")
    first = F.col("embedding")
    pred = F.transform(first, value)
    truth = F.transform(
        first, lambda x, i: F.when(i == 8, -100).otherwise(value(x) * F.when(F.col("vec_id") % 3 == 0, 1).otherwise((i + 1) % 2))
    )
    df = scan(spark, sf_dir, "embeddings", spread=False).select(pred.alias("p"), truth.alias("t"))
    return round_all(M.exact_match(df, "p", "t"), ["mean_accuracy"])


@query(
    "all_heads_correct",
    with_messages(
        "SELECT count(*) AS messages, round(avg(CAST(ok AS DOUBLE)), 6) AS share FROM (SELECT msg_id, bool_and((score > 0.5) = (truth = 1)) AS ok FROM scores GROUP BY msg_id)",
        PATTERN_SQL,
        SCORES_SQL,
    ),
)
def all_heads_correct(spark, sf_dir):
    return round_all(M.all_heads_correct(truth_scores(spark, sf_dir)), ["share"])


# -- decisions --------------------------------------------------------------------------------------------------


def _text_decisions_sql(text: str) -> str:
    return "[" + ", ".join(f"{_pattern_score_sql(text, h)} > 0.5" for h in HEADS if h != "exposure") + "]"


@query(
    "decision_stability",
    with_messages(
        "SELECT count(*) AS comparisons, round(avg(CAST(same AS DOUBLE)), 6) AS decision_stability FROM (SELECT "
        + f"unnest([CASE WHEN len(low) - 5 > 10 THEN {_text_decisions_sql('substr(low, 6)')} = base END, CASE WHEN len(low) - 3 > 10 THEN {_text_decisions_sql('substr(low, 4)')} = base END, "
        + f"CASE WHEN len(low) - 3 > 10 THEN {_text_decisions_sql('substr(low, 1, len(low) - 3)')} = base END, CASE WHEN len(low) - 5 > 10 THEN {_text_decisions_sql('substr(low, 1, len(low) - 5)')} = base END]) AS same "
        + f"FROM (SELECT low, {_text_decisions_sql('low')} AS base FROM (SELECT {sql_folded('lower(body)')} AS low FROM msg))) WHERE same IS NOT NULL"
    ),
)
def decision_stability(spark, sf_dir):
    def text_scores(text):
        scores = L.pattern_scores(text, [h for h in HEADS if h != "exposure"])
        return let(scores, lambda s: F.struct(*[(F.lit(0.0) if h == "exposure" else s[h]).alias(h) for h in HEADS]))

    return round_all(M.decision_stability(messages(spark, sf_dir), text_scores), ["decision_stability"])


def _all_decisions_sql(text: str) -> str:
    return "[" + ", ".join(f"{_pattern_score_sql(text, h)} > 0.5" for h in HEADS) + "]"


@query(
    "pattern_stability",
    with_messages(
        "SELECT count(*) AS comparisons, round(avg(CAST(same AS DOUBLE)), 6) AS decision_stability FROM (SELECT "
        + "unnest([CASE WHEN len(low) - 5 > 10 THEN first_5 = base END, CASE WHEN len(low) - 3 > 10 THEN first_3 = base END, CASE WHEN len(low) - 3 > 10 THEN last_3 = base END, CASE WHEN len(low) - 5 > 10 THEN last_5 = base END]) AS same "
        + f"FROM (SELECT low, {_all_decisions_sql('low')} AS base, {_all_decisions_sql('substr(low, 6)')} AS first_5, {_all_decisions_sql('substr(low, 4)')} AS first_3, "
        + f"{_all_decisions_sql('substr(low, 1, len(low) - 3)')} AS last_3, {_all_decisions_sql('substr(low, 1, len(low) - 5)')} AS last_5 FROM (SELECT {sql_folded('lower(body)')} AS low FROM msg))) WHERE same IS NOT NULL"
    ),
)
def pattern_stability(spark, sf_dir):
    return round_all(M.pattern_stability(messages(spark, sf_dir)), ["decision_stability"])


@query(
    "decision_distribution",
    with_messages(
        f"SELECT decision, count(*) AS n, {', '.join(round_sql(f'avg({h})', f'mean_{h}') for h in HEADS)}, round(count(*) / (SELECT count(*) FROM pattern) * 100, 6) AS percent "
        f"FROM (SELECT *, {decision_sql()} AS decision FROM pattern) GROUP BY decision",
        PATTERN_SQL,
    ),
)
def decision_distribution(spark, sf_dir):
    return round_all(M.decision_distribution(scored(spark, sf_dir)), ["percent", *[f"mean_{h}" for h in HEADS]])


@query("risk_score", with_messages(f"SELECT msg_id, {round_sql(RISK_SQL, 'risk')}, {round_sql(MEAN_SQL, 'mean_risk')} FROM pattern", PATTERN_SQL))
def risk_score(spark, sf_dir):
    s = F.col("scores")
    return scored(spark, sf_dir).select("msg_id", rounded(L.risk_score(s)).alias("risk"), rounded(L.mean_risk(s)).alias("mean_risk"))


@query(
    "score_spread",
    with_messages(
        " UNION ALL ".join(
            f"SELECT {sql_text(h)} AS head, round(max({h}) - min({h}), 6) AS range, round(stddev_pop({h}), 6) AS std, max({h}) - min({h}) > 1e-6 AS active, "
            f"stddev_pop({h}) = greatest({', '.join(f'stddev_pop({x})' for x in HEADS)}) AS most_discriminative FROM pattern"
            for h in HEADS
        ),
        PATTERN_SQL,
    ),
)
def score_spread(spark, sf_dir):
    return round_all(M.score_spread(scored(spark, sf_dir)), ["range", "std"])


# -- calibration ------------------------------------------------------------------------------------------------


def _logit_sql(p: str) -> str:
    bounded = f"greatest(1e-7, least(CAST(1 AS DOUBLE) - 1e-7, {p}))"
    return f"ln({bounded} / (1 - {bounded}))"


def _calibrated_sql(change) -> str:
    return ", ".join(round_sql(f"1 / (1 + exp(-({change(h)})))", h) for h in HEADS)


@query(
    "apply_temperature",
    with_messages(
        f"SELECT msg_id, {_calibrated_sql(lambda h: f'{_logit_sql(h)} / {dbl(fixed.CALIBRATED_TEMPERATURES[h])} + {dbl(fixed.CALIBRATED_BIASES[h])}')} FROM pattern", PATTERN_SQL
    ),
)
def apply_temperature(spark, sf_dir):
    return Cal.apply_temperature(scored(spark, sf_dir)).select("msg_id", *head_columns("calibrated"))


@query("bias_shift", with_messages(f"SELECT msg_id, {_calibrated_sql(lambda h: f'{_logit_sql(h)} + {dbl(fixed.BIAS_SHIFT[h])}')} FROM pattern", PATTERN_SQL))
def bias_shift(spark, sf_dir):
    return Cal.bias_shift(scored(spark, sf_dir)).select("msg_id", *head_columns("calibrated"))


_CONTENT_TEXT = (
    "lower(subject || ' ' || body || CASE WHEN len(attachments) > 0 THEN ' ' || array_to_string(list_transform(attachments, lambda a: a.name), ' ') ELSE ' ' END) "
    "|| chr(10) || lower(array_to_string(recipients, ' '))"
)


@query(
    "content_calibration",
    with_messages(
        "SELECT msg_id, "
        + ", ".join(round_sql(f"least({head} + least({name}_hits * {dbl(0.2)}, {dbl(weight)}), {dbl(0.99)})", head) for name, (head, weight, _) in fixed.CONTENT_RISKS.items())
        + ", array_to_string("
        + " || ".join(f"(CASE WHEN {n}_hits > 0 THEN ['{n}'] ELSE CAST([] AS VARCHAR[]) END)" for n in fixed.CONTENT_RISKS)
        + ", ',') AS detected_risks FROM pattern JOIN (SELECT msg_id, "
        + ", ".join(f"{sql_count_contained('t', words)} AS {n}_hits" for n, (_, _, words) in fixed.CONTENT_RISKS.items())
        + f" FROM (SELECT msg_id, {_CONTENT_TEXT} AS t FROM msg)) USING (msg_id)",
        PATTERN_SQL,
    ),
)
def content_calibration(spark, sf_dir):
    done = Cal.content_calibration(B.label_pattern(messages(spark, sf_dir), out="scores"))
    return done.select("msg_id", *head_columns("calibrated"), F.array_join("detected_risks", ",").alias("detected_risks"))


def _noise_sql(head: str) -> str:
    return f"({sql_uniform('42', sql_text('heuristic'), sql_text(head), 'msg_id')} * 2 - 1) * {dbl(0.05)}"


@query(
    "heuristic_scores",
    with_messages(
        "SELECT msg_id, "
        + ", ".join(
            round_sql(f"greatest({dbl(0.001)}, least({dbl(0.99)}, {v} + {_noise_sql(h)}))", h)
            for h, v in {
                "sensitivity": f"least({dbl(0.1)} + {sql_count_contained('low', ['ssn', 'password', 'confidential', 'secret'])} * {dbl(0.25)} + len(list_filter(attachments, lambda a: a.size > 1000000)) * {dbl(0.15)}, {dbl(0.95)})",
                "exposure": f"least({dbl(0.05)} + len(list_filter(recipients, lambda r: NOT ends_with(r, '.com') OR {sql_contains_any('r', ['gmail', 'yahoo', 'hotmail'])})) * {dbl(0.3)} + len(recipients) * {dbl(0.1)}, {dbl(0.9)})",
                "context": f"least({dbl(0.02)} + len(low) / 5000, {dbl(0.8)})",
                "obfuscation": f"least({dbl(0.01)} + CAST(contains(low, 'urgent') AS INT) * {dbl(0.4)}, {dbl(0.6)})",
            }.items()
        )
        + " FROM (SELECT *, lower(body || ' ' || subject) AS low FROM msg)"
    ),
)
def heuristic_scores(spark, sf_dir):
    return Cal.heuristic_scores(messages(spark, sf_dir)).select("msg_id", *head_columns("scores"))


@query(
    "calibration_report",
    with_messages(
        f"""SELECT count(*) AS n, round(avg(e), 6) AS mae, round(avg(e) FILTER (x > 0.7), 6) AS mae_high, round(avg(e) FILTER (x BETWEEN 0.3 AND 0.7), 6) AS mae_medium,
  round(avg(e) FILTER (x < 0.3), 6) AS mae_low, round(corr(risk, x), 6) AS correlation, round(max(risk) - min(risk), 6) AS risk_range, round(stddev_pop(risk), 6) AS risk_std,
  round(avg(CAST(d = CASE WHEN x > 0.7 THEN 'BLOCK' WHEN x > 0.3 THEN 'WARN' ELSE 'ALLOW' END AS DOUBLE)), 6) AS decision_accuracy
FROM (SELECT *, abs(risk - x) AS e FROM (SELECT {RISK_SQL} AS risk, {decision_sql()} AS d, CAST((msg_id % 20 + 0.5) / 20 AS DOUBLE) AS x FROM pattern))""",
        PATTERN_SQL,
    ),
)
def calibration_report(spark, sf_dir):
    df = scored(spark, sf_dir).select(
        L.risk_score(F.col("scores")).alias("risk"), L.decide(F.col("scores"))["decision"].alias("decision"),
        ((F.col("msg_id") % 20 + 0.5) / 20).alias("expected"),
    )
    e = F.col("expected")
    done = M.calibration_report(df.withColumn("expected_decision", F.when(e > 0.7, "BLOCK").when(e > 0.3, "WARN").otherwise("ALLOW")))
    return round_all(done, [c for c in done.columns if c != "n"])


@query(
    "risk_ranking",
    with_messages(
        f"SELECT msg_id, row_number() OVER (ORDER BY risk DESC, msg_id) - 1 AS actual_rank, row_number() OVER (ORDER BY msg_id % 20 DESC, msg_id) - 1 AS expected_rank "
        f"FROM (SELECT msg_id, round({RISK_SQL}, 6) AS risk FROM pattern)",
        PATTERN_SQL,
    ),
)
def risk_ranking(spark, sf_dir):
    df = scored(spark, sf_dir).select(
        "msg_id", rounded(L.risk_score(F.col("scores"))).alias("risk"), ((F.col("msg_id") % 20 + 0.5) / 20).alias("expected")
    )
    return M.risk_ranking(df, "msg_id").select("msg_id", "actual_rank", "expected_rank")


@query("fit_temperature")
def fit_temperature(spark, sf_dir):
    """Fits against the given labels and returns the calibrated scores of every message."""
    truth = scan(spark, sf_dir, "labels", spread=False).select(F.col("doc_id").alias("msg_id"), ((1 - F.col("quality")) * 0.5 + F.col("toxic") * 0.5).alias("expected"))
    scores = reliable_checkpoint(scored(spark, sf_dir))  # the fit and its use read the same copy
    fit = Cal.fit_temperature(scores.join(truth, "msg_id"))
    return Cal.apply_temperature(scores, fit.temperatures, fit.biases).select("msg_id", *head_columns("calibrated"))
