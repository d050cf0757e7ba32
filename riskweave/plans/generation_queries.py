"""Splits, samples, plans, augmentation, synthesis, packing and grids over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.fixed import corpus, span_patterns
from riskweave.functions import grids as G
from riskweave.functions import markup, rewrite
from riskweave.operators import augmentation as A
from riskweave.operators import detection as D
from riskweave.operators import grids as Gr
from riskweave.operators import labeling as B
from riskweave.operators import packing as P
from riskweave.operators import splits as Sp
from riskweave.operators import stratification as St
from riskweave.operators import synthesis as Sy
from riskweave.plans.context_queries import RISK_LEVEL_SQL
from riskweave.plans.label_queries import MEAN_SQL, PATTERN_SQL, rounded, scored
from riskweave.plans.message_view import (
    messages,
    scan,
    sql_digest,
    sql_in,
    sql_lookup,
    sql_pick,
    sql_text,
    sql_uniform,
    with_messages,
)
from riskweave.plans.registry import query
from riskweave.plans.sql_spans import spans_ctes
from riskweave.session import reliable_checkpoint

_PLACED = "placed AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)"


def _documents(spark, sf_dir, *columns):
    return scan(spark, sf_dir, "documents", spread=False).select(F.col("doc_id").alias("msg_id"), *columns)


# -- splits -----------------------------------------------------------------------------------------------------


@query(
    "split_by_ratio",
    f"WITH {_PLACED} SELECT doc_id AS msg_id, CASE WHEN idx < floor(n * 0.7) THEN 'train' WHEN idx < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM placed",
)
def split_by_ratio(spark, sf_dir):
    return Sp.split_by_ratio(_documents(spark, sf_dir))


@query(
    "split_by_size",
    f"""WITH s AS (SELECT count(*) AS n FROM documents), c AS (SELECT CAST(floor(n * 0.7) AS INT) AS a, CAST(floor(n * 0.15) AS INT) AS b FROM s)
SELECT doc_id AS msg_id, CASE WHEN idx < a THEN 'train' WHEN idx < a + b THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {sql_digest('42', 'doc_id')}, doc_id) - 1 AS idx FROM documents), c""",
)
def split_by_size(spark, sf_dir):
    df = _documents(spark, sf_dir)
    return Sp.split_by_size(df, Sp.split_sizes(df.count()), shuffle_seed=42)


_DRAW = sql_uniform("42", "'domain'", "source")


@query(
    "split_stratified",
    f"""SELECT msg_id, source, split, row_number() OVER (PARTITION BY split, lang ORDER BY {sql_digest('42', "'row'", 'msg_id')}, msg_id) AS stratum_rank
FROM (SELECT doc_id AS msg_id, source, lang, CASE WHEN {_DRAW} < 0.7 THEN 'train' WHEN {_DRAW} < 0.85 THEN 'val' ELSE 'test' END AS split FROM documents)""",
)
def split_stratified(spark, sf_dir):
    done = Sp.split_stratified(_documents(spark, sf_dir, "source", "lang"), ["lang"], "source")
    return done.select("msg_id", "source", "split", "stratum_rank")


@query(
    "split_by_strata",
    with_messages(
        """SELECT value, count(*) AS n, true AS even, 0 AS leaking FROM (
SELECT 'all=' AS value FROM msg UNION ALL SELECT 'role=' || role FROM msg UNION ALL SELECT 'channel=' || channel FROM msg
UNION ALL SELECT 'kinds=' || k FROM (SELECT unnest(list_distinct(list_transform(list_filter(recipients, lambda r: contains(r, '@')), lambda r: split_part(r, '@', 2)))) AS k FROM msg)
) GROUP BY value"""
    ),
)
def split_by_strata(spark, sf_dir):
    """Whole threads by role, channel and recipients' domains: each value's rows within two points and a thread of 70, 15
    and 15 %, and no thread in two splits."""
    kinds = F.array_distinct(F.transform(F.filter("recipients", lambda r: r.contains("@")), lambda r: F.split_part(r, F.lit("@"), F.lit(2))))
    m = messages(spark, sf_dir).select("msg_id", F.col("thread.id_hash").alias("thread"), "user.role", "channel", kinds.alias("kinds"))
    strata = ["role", "channel", "kinds"]
    done = reliable_checkpoint(St.split_by_strata(m, "thread", strata))
    leaking = Sp.domain_leakage(done, "thread").count()
    shares = St.stratum_shares(done, strata).groupBy("value").pivot("split", ["train", "val", "test"]).agg(F.first("n")).na.fill(0)
    n = F.col("train") + F.col("val") + F.col("test")
    near = lambda split, share: F.abs(F.col(split) - n * share) <= n * 0.02 + 3
    return shares.select("value", n.alias("n"), (near("train", 0.7) & near("val", 0.15) & near("test", 0.15)).alias("even"), F.lit(leaking).alias("leaking"))


@query(
    "domain_leakage",
    with_messages(
        "SELECT domain, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM (SELECT split, lower(list_extract(string_split(r, '@'), -1)) AS domain "
        "FROM (SELECT split, unnest(recipients) AS r FROM msg) WHERE contains(r, '@')) GROUP BY domain HAVING count(DISTINCT split) > 1"
    ),
)
def domain_leakage(spark, sf_dir):
    from riskweave.functions.text import address_domains

    rows = messages(spark, sf_dir, spread=False).select("split", F.explode_outer(address_domains(F.col("recipients"))).alias("domain"))
    return Sp.domain_leakage(rows.filter("domain is not null"), "domain").select("domain", F.array_join("splits", ",").alias("splits"))


@query(
    "evenly_spaced_sample",
    f"WITH {_PLACED} SELECT doc_id AS msg_id, idx AS position FROM placed WHERE idx IN (SELECT CAST(floor(i * ((SELECT max(n) FROM placed) - 1) / 19) AS BIGINT) FROM range(20) t(i))",
)
def evenly_spaced_sample(spark, sf_dir):
    return Sp.evenly_spaced_sample(_documents(spark, sf_dir), 20).select("msg_id", "position")


@query(
    "low_mid_high_sample",
    with_messages(
        f"SELECT msg_id, risk, CASE WHEN idx = 0 THEN 'LOW' WHEN idx = n // 2 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM (SELECT msg_id, risk, row_number() OVER (ORDER BY risk, msg_id) - 1 AS idx, "
        f"count(*) OVER () AS n FROM (SELECT msg_id, round({MEAN_SQL}, 6) AS risk FROM pattern)) WHERE idx = 0 OR idx = n // 2 OR idx = n - 1",
        PATTERN_SQL,
    ),
)
def low_mid_high_sample(spark, sf_dir):
    from riskweave.functions.labels import mean_risk

    risks = scored(spark, sf_dir).select("msg_id", rounded(mean_risk(F.col("scores"))).alias("risk"))
    return Sp.low_mid_high_sample(risks, "risk")


@query(
    "topk_spans",
    "SELECT vec_id, len(list_filter(range(1, len(embedding) + 1), lambda i: floor(abs(CAST(embedding[i] AS DOUBLE)) * 20) % 3 > 0 OR abs(CAST(embedding[i] AS DOUBLE)) * 5 > 0.8)) AS wanted, "
    "least(20, len(list_filter(range(1, len(embedding) + 1), lambda i: floor(abs(CAST(embedding[i] AS DOUBLE)) * 20) % 3 > 0 OR abs(CAST(embedding[i] AS DOUBLE)) * 5 > 0.8))) AS kept FROM embeddings",
)
def topk_spans(spark, sf_dir):
    x = F.col("embedding")
    magnitude = lambda v: F.abs(v.cast("double"))
    df = scan(spark, sf_dir, "embeddings", spread=False).select(
        "vec_id",
        F.transform(x, lambda v: F.when(F.floor(magnitude(v) * 20) % 3 > 0, "B-NAME").otherwise("O")).alias("tags"),
        F.transform(x, lambda v: magnitude(v) * 5).alias("confidences"),
    )
    all_of_them = Sp.topk_spans(df, k=1000, out="every")
    return Sp.topk_spans(all_of_them).select("vec_id", F.size("every").alias("wanted"), F.size("top_spans").alias("kept"))


@query(
    "topk_span_places",
    "SELECT vec_id, array_to_string(list_transform(list_slice(list_filter(range(1, len(embedding) + 1), lambda i: floor(abs(CAST(embedding[i] AS DOUBLE)) * 20) % 3 > 0 OR abs(CAST(embedding[i] AS DOUBLE)) * 5 > 0.8), 1, 20), lambda i: i - 1), ',') AS places FROM embeddings",
)
def topk_span_places(spark, sf_dir):
    magnitude = lambda v: F.abs(v.cast("double"))
    df = scan(spark, sf_dir, "embeddings", spread=False).select(
        "vec_id", F.transform("embedding", lambda v: F.when(F.floor(magnitude(v) * 20) % 3 > 0, "B-NAME").otherwise("O")).alias("tags"),
        F.transform("embedding", lambda v: magnitude(v) * 5).alias("confidences"),
    )
    return Sp.topk_spans(df).select("vec_id", F.array_join(F.transform("top_spans", lambda s: s["position"].cast("string")), ",").alias("places"))


# -- plans ------------------------------------------------------------------------------------------------------


def _weighted_sql(weights: dict[str, float], *keys: str) -> str:
    total, edge, cases = sum(weights.values()), 0.0, []
    for name in list(weights)[:-1]:
        edge += weights[name] / total
        cases.append(f"WHEN u < CAST({edge!r} AS DOUBLE) THEN {sql_text(name)}")
    return f"(SELECT CASE {' '.join(cases)} ELSE {sql_text(list(weights)[-1])} END FROM (SELECT {sql_uniform(*keys)} AS u))"


@query(
    "weighted_plan",
    f"""SELECT doc_id, agent_type, risk_level, conversation_turns, least(2, len({sql_lookup('agent_type', {k: 'X' * max(len(v), 1) for k, v in corpus.AGENT_TARGET_SPANS.items() if v}, "''")})) AS n_spans
FROM (SELECT doc_id, {_weighted_sql(corpus.AGENT_WEIGHTS, '42', "'agent'", 'doc_id')} AS agent_type, {_weighted_sql(corpus.RISK_LEVEL_WEIGHTS, '42', "'risk'", 'doc_id')} AS risk_level,
  CASE WHEN {sql_uniform('42', "'thread'", 'doc_id')} < 0.3 THEN CAST(2 + floor({sql_uniform('42', "'turns'", 'doc_id')} * 3) AS INT) ELSE 1 END AS conversation_turns FROM documents)""",
)
def weighted_plan(spark, sf_dir):
    plan = Sp.weighted_plan(scan(spark, sf_dir, "documents", spread=False), "doc_id")
    return plan.select("doc_id", "agent_type", "risk_level", "conversation_turns", F.size("target_spans").alias("n_spans"))


@query(
    "plan_batches",
    """SELECT doc_id, lang, idx // 37 + 1 AS batch_num, idx % 37 AS request_index, lang || '_batch_' || lpad(CAST(idx // 37 + 1 AS VARCHAR), 3, '0') AS batch_id
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents)""",
)
def plan_batches(spark, sf_dir):
    requests = scan(spark, sf_dir, "documents", spread=False).select("doc_id", "lang")
    return Sp.plan_batches(requests, "doc_id", split="lang", limit=37)


@query("pending_requests", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_requests(spark, sf_dir):
    requests = scan(spark, sf_dir, "documents", spread=False).select("doc_id", "source")
    return Sp.pending_requests(requests, scan(spark, sf_dir, "labels", spread=False), "doc_id")


@query("subsample", f"SELECT vec_id, label FROM embeddings ORDER BY {sql_digest('42', sql_text('subsample'), 'vec_id')}, vec_id LIMIT 100")
def subsample(spark, sf_dir):
    return Sp.subsample(scan(spark, sf_dir, "embeddings", spread=False).select("vec_id", "label"), 100, "vec_id")


@query(
    "head_set_difference",
    "SELECT source, count(*) AS n FROM (SELECT doc_id, source FROM documents EXCEPT ALL SELECT doc_id, source FROM documents JOIN labels USING (doc_id)) GROUP BY source",
)
def head_set_difference(spark, sf_dir):
    d = scan(spark, sf_dir, "documents", spread=False).select("doc_id", "source")
    labelled = d.join(scan(spark, sf_dir, "labels", spread=False).select("doc_id"), "doc_id")
    return d.exceptAll(labelled).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_texts", "SELECT text_md5, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, md5(text) AS text_md5 FROM documents) GROUP BY text_md5")
def distinct_texts(spark, sf_dir):
    hashed = scan(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return hashed.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


# -- augmentation -----------------------------------------------------------------------------------------------

_KEYS = ("42", "msg_id", "variant_id")


def _stranger_sql(i: int, domains) -> str:
    return f"{sql_pick(corpus.VARIANT_MAILBOXES, *_KEYS, sql_text('box'), str(i))} || '@' || {sql_pick(domains, *_KEYS, sql_text('at'), str(i))}"


def _moved_sql(domains, fallback: str, tag: str) -> str:
    box = f"CASE WHEN contains(recipients[i], '@') THEN string_split(recipients[i], '@')[1] ELSE '{fallback}' END"
    return f"list_transform(range(1, len(recipients) + 1), lambda i: {box} || '@' || {sql_pick(domains, *_KEYS, sql_text(tag), 'i - 1')})"


VARIED_RECIPIENTS_SQL = (
    f"CASE WHEN len(recipients) = 0 THEN recipients ELSE CASE {sql_pick(A.MODES, *_KEYS, sql_text('mode'))} "
    f"WHEN 'personal_risk' THEN {_moved_sql(corpus.VARIANT_PERSONAL_DOMAINS, 'user', 'p')} WHEN 'external_business' THEN {_moved_sql(corpus.VARIANT_BUSINESS_DOMAINS, 'contact', 'b')} "
    f"WHEN 'mixed_recipients' THEN recipients || [{_stranger_sql(2, corpus.VARIANT_PERSONAL_DOMAINS)}] "
    f"ELSE recipients || CASE WHEN {sql_uniform(*_KEYS, sql_text('cc'))} < 0.5 THEN [{_stranger_sql(0, corpus.VARIANT_BUSINESS_DOMAINS)}] "
    f"ELSE [{_stranger_sql(0, corpus.VARIANT_BUSINESS_DOMAINS)}, {_stranger_sql(1, corpus.VARIANT_BUSINESS_DOMAINS)}] END END END"
)


def _varied_body_sql() -> str:
    body = "body"
    for name in corpus.VARIANT_SEARCHED_NAMES:
        body = f"replace({body}, {sql_text(name)}, {sql_pick(corpus.VARIANT_FIRST_NAMES, *_KEYS, sql_text('first'), sql_text(name))} || ' ' || {sql_pick(corpus.VARIANT_LAST_NAMES, *_KEYS, sql_text('last'), sql_text(name))})"
    for term, words in corpus.VARIANT_TERMS.items():
        body = f"replace({body}, {sql_text(term)}, {sql_pick(words, *_KEYS, sql_text(term))})"
    return body


def _on(step: str) -> str:
    return f"variant_id > 0 AND {sql_uniform(*_KEYS, sql_text(step))} < {corpus.AUGMENT_PROBABILITIES[step]}"


def _obfuscated_sql(body: str) -> str:
    import base64

    encoded = " ".join(
        f"WHEN contains(lower({body}), {sql_text(p)}) THEN {body} || chr(10) || chr(10) || 'Encoded reference: {base64.b64encode(p.encode()).decode()}'" for p in corpus.ENCODED_PHRASES
    )
    look = body
    for old, new in corpus.LOOK_ALIKE_DIGITS.items():
        look = f"CASE WHEN {sql_uniform(*_KEYS, sql_text('look'), sql_text(old))} < 0.1 THEN regexp_replace({look}, '{old}', '{new}') ELSE {look} END"
    return (
        f"CASE {sql_pick(A.OBFUSCATIONS, *_KEYS, sql_text('kind'))} WHEN 'asterisk_masking' THEN regexp_replace(regexp_replace({body}, '(\\d{{3}})-(\\d{{2}})-(\\d{{4}})', '***-**-\\3', 'g'), "
        f"'(\\d{{4}})\\s*(\\d{{4}})\\s*(\\d{{4}})\\s*(\\d{{4}})', '****-****-****-\\4', 'g') WHEN 'base64_encoding' THEN CASE {encoded} ELSE {body} END "
        f"WHEN 'character_insertion' THEN regexp_replace({body}, '(\\d{{3}})-(\\d{{2}})-(\\d{{4}})', '\\1-\\2-\\3 ', 'g') ELSE {look} END"
    )


@query(
    "augment",
    with_messages(
        f"""
SELECT msg_id, variant_id, variant_id > 0 AS augmented, array_to_string(r, ',') AS recipients, subject, md5(CASE WHEN {_on('obfuscation')} THEN {_obfuscated_sql('varied')} ELSE varied END) AS body_md5,
  CASE WHEN {_on('thread')} AND (prior_msgs > 0 OR (prior_msgs = 0 AND {sql_uniform(*_KEYS, sql_text('multi'))} < 0.5)) THEN CAST(1 + floor({sql_uniform(*_KEYS, sql_text('prior'))} * CASE WHEN prior_msgs > 0 THEN 6 ELSE 4 END) AS INT) ELSE prior_msgs END AS prior_msgs
FROM (SELECT *, CASE WHEN {_on('recipients')} THEN {VARIED_RECIPIENTS_SQL} ELSE recipients END AS r, CASE WHEN {_on('content')} THEN {_varied_body_sql()} ELSE body END AS varied
  FROM (SELECT msg_id, unnest(range(4)) AS variant_id, recipients, body, prior_msgs, subject AS plain_subject FROM msg)) t,
  LATERAL (SELECT CASE WHEN {_on('content')} AND NOT contains(plain_subject, 'Re:') AND {sql_uniform(*_KEYS, sql_text('reply'))} < 0.3 THEN 'Re: ' || plain_subject ELSE plain_subject END AS subject)
"""
    ),
)
def augment(spark, sf_dir):
    done = A.augment(messages(spark, sf_dir))
    return done.select(
        "msg_id", "variant_id", "augmented", F.array_join("recipients", ",").alias("recipients"), "subject",
        F.md5("body").alias("body_md5"), "thread.prior_msgs",
    )


@query(
    "with_scenarios",
    with_messages(
        "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN v = 0 THEN 'original' ELSE 'variant' END AS kind FROM (SELECT unnest(range(4)) AS v FROM msg) "
        "UNION ALL SELECT 'violation' FROM msg WHERE risk_type = 'authorized' UNION ALL SELECT 'obfuscated' FROM msg) GROUP BY kind"
    ),
)
def with_scenarios(spark, sf_dir):
    rows = A.with_scenarios(messages(spark, sf_dir))
    kind = F.when(F.col("augmented"), "variant").when(F.col("augmented").isNotNull(), "original").otherwise(F.col("risk_type"))
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "violation_scenarios",
    with_messages(
        f"SELECT msg_id, array_to_string(list_transform(range(1, len(recipients) + 1), lambda i: CASE WHEN contains(recipients[i], '@') THEN string_split(recipients[i], '@')[1] ELSE 'user' END || '@' || "
        f"{sql_pick(corpus.VARIANT_PERSONAL_DOMAINS, '42', sql_text('violation'), 'msg_id', 'i - 1')}), ',') AS recipients, 'violation' AS risk_type FROM msg WHERE risk_type = 'authorized'"
    ),
)
def violation_scenarios(spark, sf_dir):
    return A.violation_scenarios(messages(spark, sf_dir, spread=False)).select("msg_id", F.array_join("recipients", ",").alias("recipients"), "risk_type")


@query("obfuscated_scenarios")
def obfuscated_scenarios(spark, sf_dir):
    return A.obfuscated_scenarios(messages(spark, sf_dir, spread=False)).select("msg_id", "risk_type", F.md5("body").alias("body_md5"))


@query(
    "flip_requests",
    with_messages(
        f"SELECT msg_id, {RISK_LEVEL_SQL} AS current_risk, CASE WHEN {RISK_LEVEL_SQL} IN ('medium_risk', 'high_risk') THEN 'low_risk' ELSE 'high_risk' END AS goal "
        "FROM (SELECT *, row_number() OVER (ORDER BY msg_id) - 1 AS idx, count(*) OVER () AS n FROM msg) WHERE idx < greatest(1, floor(n * 0.3))"
    ),
)
def flip_requests(spark, sf_dir):
    return A.flip_requests(messages(spark, sf_dir), 0.3).select("msg_id", "current_risk", "goal")


@query(
    "validate_flips",
    with_messages(
        "SELECT count(*) AS n, count(*) FILTER (valid) AS n_valid FROM (SELECT len(list_filter(v, lambda x: NOT contains(x, '@'))) > 0 AND msg_id % 2 = 0 AS valid FROM (SELECT msg_id, "
        r"regexp_extract_all(body, '(?i)\b4[0-9]{15}\b') || regexp_extract_all(body, '(?i)\b\d{3}-?\d{2}-?\d{4}\b') || regexp_extract_all(body, '(?i)\bsk-[A-Za-z0-9]{20,}\b') || "
        r"regexp_extract_all(body, '(?i)\b[A-Za-z]+ [A-Za-z]{2,}\b') AS v FROM msg))"
    ),
)
def validate_flips(spark, sf_dir):
    # An even message keeps its body behind another first line; an odd one loses its text.
    pairs = messages(spark, sf_dir).select(
        "msg_id", "body", F.when(F.col("msg_id") % 2 == 0, F.concat(F.lit("7\n"), F.col("body"))).otherwise("").alias("flipped_body")
    )
    checked = A.validate_flips(pairs)
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"))


# -- rewrites ---------------------------------------------------------------------------------------------------

_SPELL = "array_to_string(list_transform(string_split(v, ''), lambda c: CASE c {} ELSE c END), ' ')"


def _words_sql(language: str) -> str:
    words = {str(i): w for i, w in enumerate(rewrite.DIGIT_WORDS[language])} | rewrite.SEPARATOR_WORDS[language]
    return _SPELL.format(" ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in words.items()))


@query(
    "rewrites",
    f"""SELECT doc_id, {_words_sql('english')} AS english, {_words_sql('spanish')} AS spanish, {_words_sql('french')} AS french, {_words_sql('german')} AS german,
  replace(replace(mail, '.', ' dot '), '@', ' at ') AS decomposed, replace(replace(replace('https://' || mail || '/x', '.', ' dot '), '://', ' colon slash slash '), '/', ' slash ') AS url,
  array_to_string(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i > 1 AND (i - 1) % 4 = 0 THEN '   ' WHEN i > 1 AND (i - 1) % 2 = 0 THEN ' ' ELSE '' END || d[i]), '') AS spaced
FROM (SELECT doc_id, CAST(100 + doc_id % 800 AS VARCHAR) || '-' || CAST(10 + doc_id % 89 AS VARCHAR) || '.' || n_chars AS v, source || '.x@' || lang || '.example.org' AS mail, CAST(10000000 + doc_id AS VARCHAR) AS d FROM documents)""",
)
def rewrites(spark, sf_dir):
    d = scan(spark, sf_dir, "documents", spread=False).select(
        "doc_id",
        F.concat((F.col("doc_id") % 800 + 100).cast("string"), F.lit("-"), (F.col("doc_id") % 89 + 10).cast("string"), F.lit("."), F.col("n_chars").cast("string")).alias("v"),
        F.concat("source", F.lit(".x@"), "lang", F.lit(".example.org")).alias("mail"),
        (F.col("doc_id") + 10000000).cast("string").alias("d"),
    )
    return d.select(
        "doc_id", *[rewrite.digits_to_words(F.col("v"), lang).alias(lang) for lang in rewrite.DIGIT_WORDS],
        rewrite.decompose_email(F.col("mail")).alias("decomposed"),
        rewrite.decompose_url(F.concat(F.lit("https://"), F.col("mail"), F.lit("/x"))).alias("url"),
        rewrite.space_digits(F.col("d")).alias("spaced"),
    )


@query("semantic_obfuscate")
def semantic_obfuscate(spark, sf_dir):
    nth = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values)).cast("int"))
    d = scan(spark, sf_dir, "documents", spread=False).select(
        F.col("doc_id").alias("msg_id"), nth(["credit_card", "ssn", "email", "password", "api_key"]).alias("data_type"),
        nth(["low", "medium", "high"]).alias("sophistication"), (F.col("doc_id") + 4000000000000000).cast("string").alias("value"),
    )
    return A.semantic_obfuscate(d)


@query(
    "progressive_reveal",
    "SELECT conv_id, turn, p AS part_no, substr(v, p * (len(v) // 3) + 1, len(v) // 3) AS part FROM (SELECT conv_id, turn, v, unnest(range((len(v) + len(v) // 3 - 1) // (len(v) // 3))) AS p "
    "FROM (SELECT conv_id, turn, CAST(1000000 + conv_id * 97 + turn AS VARCHAR) AS v FROM conversations))",
)
def progressive_reveal(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", spread=False).select("conv_id", "turn", (F.col("conv_id") * 97 + F.col("turn") + 1000000).cast("string").alias("v"))
    return A.progressive_reveal(c, "v").drop("v")


@query("reassemble", "SELECT conv_id * 100 + turn AS key, CAST(1000000 + conv_id * 97 + turn AS VARCHAR) AS value FROM conversations")
def reassemble(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", spread=False).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("key"), (F.col("conv_id") * 97 + F.col("turn") + 1000000).cast("string").alias("v")
    )
    return A.reassemble(A.progressive_reveal(c, "v"), "key")


# -- synthesis --------------------------------------------------------------------------------------------------


@query("synthesize_messages")
def synthesize_messages(spark, sf_dir):
    done = Sy.synthesize_messages(scan(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return done.select("msg_id", "role", "channel", "subject", "body", F.array_join("recipients", ",").alias("recipients"), F.size("spans").alias("n_spans"), "labels.*")


@query("synthesize_emails")
def synthesize_emails(spark, sf_dir):
    return Sy.synthesize_emails(scan(spark, sf_dir, "documents", spread=False).select("doc_id"), "doc_id")


@query(
    "simple_synth",
    f"""SELECT doc_id AS msg_id, {sql_pick(['legal', 'finance', 'hr', 'security', 'casual'], '42', 'doc_id', "'domain'")} AS domain, {sql_pick(['email', 'chat', 'pr'], '42', 'doc_id', "'channel'")} AS channel,
  {sql_pick(['LEGAL', 'FINANCE', 'HR', 'SECURITY', 'EMPLOYEE'], '42', 'doc_id', "'role'")} AS role, CAST(floor({sql_uniform('42', 'doc_id', "'s'")} * 2) AS INT) AS sensitivity,
  CAST(floor({sql_uniform('42', 'doc_id', "'e'")} * 2) AS INT) AS exposure FROM documents""",
)
def simple_synth(spark, sf_dir):
    done = Sy.simple_synth(scan(spark, sf_dir, "documents", spread=False).select("doc_id"), "doc_id")
    return done.select("msg_id", "domain", "channel", "role", "sensitivity", "exposure")


# -- packing ----------------------------------------------------------------------------------------------------

_DSL_HEAD = (
    "'<CHANNEL ' || channel || '>' || chr(10) || '<USER role=' || role || ' dept=' || dept || ' seniority=' || seniority || '>' || chr(10) || "
    "CASE WHEN len(recipients) > 0 THEN '<RECIPIENT primary=' || recipients[1] || ' all=[' || array_to_string(recipients, ',') || ']>' ELSE '<RECIPIENT>' END || chr(10) || "
    "'<THREAD id_hash=' || id_hash || ' age_days=' || age_days || ' prior_msgs=' || prior_msgs || '>' || chr(10) || '<SUBJECT>' || subject || '</SUBJECT>' || chr(10) || '<BODY>'"
)
_DSL_TAIL = (
    "'</BODY>' || chr(10) || '<ATTACHMENTS>' || coalesce(array_to_string(list_transform(attachments, lambda a: a.name || '|' || (a.size // 1024) || 'KB;' || a.mime), ','), '') || '</ATTACHMENTS>' || chr(10) || "
    "'<LINKS>' || coalesce(array_to_string(links, ','), '') || '</LINKS>' || chr(10) || '<META >' || chr(10)"
)
_DSL_CTE = f"dsl AS (SELECT msg_id, {_DSL_HEAD} || body || {_DSL_TAIL} AS text, len({_DSL_HEAD}) AS body_start, len({_DSL_HEAD}) + len(body) AS body_end FROM msg)"


@query("serialize_dsl", with_messages("SELECT msg_id, md5(text) AS text_md5, len(text) AS text_length, body_start, body_end FROM dsl", _DSL_CTE))
def serialize_dsl(spark, sf_dir):
    done = P.serialize_dsl(messages(spark, sf_dir)).select("msg_id", "markup.*")
    return done.select("msg_id", F.md5("text").alias("text_md5"), F.length("text").alias("text_length"), "body_start", "body_end")


@query("dsl_corpus", with_messages("SELECT md5(text) AS line_md5 FROM dsl", _DSL_CTE))
def dsl_corpus(spark, sf_dir):
    return P.dsl_corpus(messages(spark, sf_dir)).select(F.md5("value").alias("line_md5"))


@query(
    "encode_chars",
    "SELECT doc_id, CAST(w AS INT) AS window_no, CAST(512 AS INT) AS n, CAST(list_sum(ids) AS BIGINT) AS id_sum, "
    "CAST(list_sum(list_transform(range(1, len(ids) + 1), lambda i: ids[i] * (i % 97))) AS BIGINT) AS id_check FROM (SELECT doc_id, w, full_ids[w * 512 + 1:w * 512 + 512] AS ids FROM ("
    "SELECT doc_id, full_ids, unnest(range(CAST(ceil(len(full_ids) / 512.0) AS BIGINT))) AS w FROM (SELECT doc_id, [2] || CASE WHEN text = '' THEN CAST([] AS INTEGER[]) ELSE "
    "list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN unicode(c) - 28 ELSE 1 END) END || [3] AS full_ids FROM documents)))",
)
def encode_chars(spark, sf_dir):
    ids = P.encode_windows(scan(spark, sf_dir, "documents"), "text", 512).select("doc_id", "window_no", "ids")
    return ids.select(
        "doc_id", "window_no", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
        F.aggregate(F.transform("ids", lambda x, i: x * ((i + 1) % 97)), F.lit(0).cast("long"), lambda a, x: a + x).alias("id_check"),
    )


@query(
    "encode_bytes",
    "SELECT doc_id, len(b) AS n, CAST(list_sum(list_transform(b, lambda h: CAST('0x' || h AS INT) + 2)) AS BIGINT) AS id_sum FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents)",
)
def encode_bytes(spark, sf_dir):
    ids = scan(spark, sf_dir, "documents").select("doc_id", markup.encode_bytes(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query(
    "pack_examples",
    with_messages(
        f"""
SELECT msg_id, CAST(w AS INT) AS window_no, 512 AS n_ids, CAST(least(512, n - w * 512) AS INT) AS n_real,
  CAST(coalesce(list_sum(list_transform(spans, lambda s: CASE WHEN {sql_in('s.type', span_patterns.BIO_TYPES['training'])} THEN greatest(0, least(s.end + shift, w * 512 + 512) - greatest(s.start + shift, w * 512)) ELSE 0 END)), 0) AS INT) AS n_tagged,
  CAST(512 - least(512, n - w * 512) AS INT) AS n_ignored
FROM (SELECT msg_id, spans, n, shift, unnest(range((n + 511) // 512)) AS w FROM (SELECT msg_id, spans, len(text) AS n, body_start AS shift FROM dsl JOIN spans USING (msg_id)))
""",
        _DSL_CTE,
        *spans_ctes("full", "confidence"),
    ),
)
def pack_examples(spark, sf_dir):
    found = D.detect_spans(B.label_pattern(messages(spark, sf_dir)), "body", "full")
    packed = P.pack_windows(found, max_length=512).select("msg_id", "window_no", "packed.*")
    return packed.select(
        "msg_id", "window_no", F.size("input_ids").alias("n_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
        F.size(F.filter("bio_labels", lambda t: t > 0)).alias("n_tagged"), F.size(F.filter("bio_labels", lambda t: t == -100)).alias("n_ignored"),
    )


@query(
    "mask_tokens",
    f"SELECT doc_id, len(list_filter(range(5, len(text)), lambda i: {sql_uniform('42', sql_text('mask'), 'doc_id', 'i')} < 0.15)) AS n_masked FROM documents",
)
def mask_tokens(spark, sf_dir):
    ids = scan(spark, sf_dir, "documents").select("doc_id", F.transform(markup.characters(F.col("text")), F.ascii).alias("ids"))
    masked = P.mask_tokens(ids, "ids", -1, key="doc_id")
    return masked.select("doc_id", F.size(F.filter("masked_ids", lambda x: x == -1)).alias("n_masked"))


@query(
    "shuffle_sections",
    f"SELECT doc_id, CAST({sql_uniform('42', sql_text('section'), 'doc_id')} < 0.1 AND len(text) // 64 > 1 AS INT) AS shuffle_label, CAST(len(text) AS INT) AS n FROM documents",
)
def shuffle_sections(spark, sf_dir):
    ids = scan(spark, sf_dir, "documents").select("doc_id", markup.characters(F.col("text")).alias("ids"))
    done = P.shuffle_sections(ids, "ids", key="doc_id")
    return done.select("doc_id", "shuffle_label", F.size("shuffled_ids").alias("n"))


_SECTION = f"{{'k': {sql_digest('42', sql_text('order'), 'doc_id', 'i')}, 's': substr(text, i * 64 + 1, 64)}}"


@query(
    "shuffled_order",
    f"""SELECT doc_id, md5(CASE WHEN {sql_uniform('42', sql_text('section'), 'doc_id')} < 0.1 AND len(text) // 64 > 1
  THEN array_to_string(list_transform(list_sort(list_transform(range(len(text) // 64), lambda i: {_SECTION})), lambda x: x.s), '') || substr(text, len(text) // 64 * 64 + 1) ELSE text END) AS text_md5
FROM documents""",
)
def shuffled_order(spark, sf_dir):
    """The characters themselves in their new order."""
    ids = scan(spark, sf_dir, "documents").select("doc_id", markup.characters(F.col("text")).alias("ids"))
    return P.shuffle_sections(ids, "ids", key="doc_id").select("doc_id", F.md5(F.array_join("shuffled_ids", "")).alias("text_md5"))


# -- grids ------------------------------------------------------------------------------------------------------


def _grid(start: int):
    value = lambda i: f"cast(floor(abs(cast(embedding[{i}] as double)) * 10) % 10 as int)"
    lines = ", ".join("array(" + ", ".join(value(start + 3 * r + c) for c in range(3)) + ")" for r in range(3))
    return f"array({lines})"


def _grid_sql(start: int) -> str:
    value = lambda i: f"CAST(floor(abs(CAST(embedding[{i + 1}] AS DOUBLE)) * 10) % 10 AS INT)"
    return "[" + ", ".join("[" + ", ".join(value(start + 3 * r + c) for c in range(3)) + "]" for r in range(3)) + "]"


def puzzles(spark, sf_dir):
    """A puzzle per vector: two examples of 3 x 3 grids from its first 36 values."""
    e = scan(spark, sf_dir, "embeddings", spread=False)
    return e.select(
        F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("puzzle_id"), "vec_id", "label",
        F.expr(f"array(named_struct('kind', 'train', 'input', {_grid(0)}, 'output', {_grid(9)}), named_struct('kind', 'test', 'input', {_grid(18)}, 'output', {_grid(27)}))").alias("examples"),
    )


def _whole_grid(digit: int) -> str:
    """The 64 values of a vector as an 8 x 8 grid of their decimal digits at the named place."""
    value = f"cast(floor(abs(cast(x as double)) * {10**digit}) % 10 as int)"
    return f"transform(sequence(0, 7), r -> transform(slice(embedding, r * 8 + 1, 8), x -> {value}))"


def whole_puzzles(spark, sf_dir):
    """A puzzle per vector: two examples of 8 x 8 grids, each from all 64 values (their first to fourth digits)."""
    e = scan(spark, sf_dir, "embeddings", spread=False)
    one = lambda kind, d: f"named_struct('kind', '{kind}', 'input', {_whole_grid(d)}, 'output', {_whole_grid(d + 1)})"
    return e.select(
        F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("puzzle_id"), "vec_id", "label",
        F.expr(f"array({one('train', 1)}, {one('test', 3)})").alias("examples"),
    )


_T = {0: "g[i][j]", 1: "g[j][4 - i]", 2: "g[4 - i][4 - j]", 3: "g[4 - j][i]", 4: "g[i][4 - j]", 5: "g[4 - i][j]", 6: "g[j][i]", 7: "g[4 - j][4 - i]"}


@query(
    "dihedral",
    "SELECT vec_id, tid, array_to_string(flatten(CASE tid "
    + " ".join(f"WHEN {t} THEN list_transform(range(1, 4), lambda i: list_transform(range(1, 4), lambda j: {cell}))" for t, cell in _T.items())
    + f" END), ',') AS image, true AS restored FROM (SELECT vec_id, {_grid_sql(0)} AS g, unnest(range(8)) AS tid FROM embeddings)",
)
def dihedral(spark, sf_dir):
    g = scan(spark, sf_dir, "embeddings", spread=False).select("vec_id", F.expr(_grid(0)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("tid"))
    turned = g.withColumn("image", G.dihedral("g", "tid"))
    restored = turned.withColumn("restored", G.inverse_dihedral("image", "tid") == F.col("g"))
    return restored.select("vec_id", "tid", F.array_join(F.flatten("image"), ",").alias("image"), "restored")


@query("augment_grids")
def augment_grids(spark, sf_dir):
    return Gr.augment_grids(whole_puzzles(spark, sf_dir), 4).select("group_id", "puzzle_id", "tid", "hash")


def _text_sql(start: int) -> str:
    return f"sha256(array_to_string(list_transform({_grid_sql(start)}, lambda l: array_to_string(l, ',')), ';'))"


@query(
    "puzzle_hash",
    f"SELECT 'p' || vec_id AS puzzle_id, sha256(array_to_string(list_sort([{_text_sql(0)} || '|' || {_text_sql(9)}, {_text_sql(18)} || '|' || {_text_sql(27)}]), '|')) AS hash FROM embeddings",
)
def puzzle_hash(spark, sf_dir):
    return puzzles(spark, sf_dir).select("puzzle_id", F.expr(G.puzzle_hash_sql("examples")).alias("hash"))


@query(
    "grid_to_sequence",
    f"SELECT vec_id, pr AS pad_row, pc AS pad_column, array_to_string(list_transform(range(900), lambda p: CASE WHEN p // 30 BETWEEN pr AND pr + 2 AND p % 30 BETWEEN pc AND pc + 2 THEN g[p // 30 - pr + 1][p % 30 - pc + 1] + 2 "
    "WHEN (p // 30 = pr + 3 AND p % 30 BETWEEN pc AND pc + 2) OR (p % 30 = pc + 3 AND p // 30 BETWEEN pr AND pr + 2) THEN 1 ELSE 0 END), '') AS inputs, true AS cropped_back FROM ("
    f"SELECT vec_id, {_grid_sql(0)} AS g, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE CAST(floor({sql_uniform('42', sql_text('row'), 'vec_id')} * 28) AS INT) END AS pr, "
    f"CASE WHEN vec_id % 10 = 0 THEN 0 ELSE CAST(floor({sql_uniform('42', sql_text('column'), 'vec_id')} * 28) AS INT) END AS pc FROM embeddings)",
)
def grid_to_sequence(spark, sf_dir):
    examples = scan(spark, sf_dir, "embeddings", spread=False).select(
        "vec_id", F.expr(_grid(0)).alias("input"), F.expr(_grid(9)).alias("output"), (F.col("vec_id") % 10 == 0).alias("plain")
    )
    done = Gr.grid_to_sequence(examples, key="vec_id")
    corner = done.withColumn("corner", G.to_sequence("input", "0", "0")).withColumn("cropped_back", G.crop("corner") == F.col("input"))
    return corner.select("vec_id", "pad_row", "pad_column", F.array_join("inputs", "").alias("inputs"), "cropped_back")


@query(
    "assign_puzzle_ids",
    "SELECT vec_id, name, dense_rank() OVER (ORDER BY first, name) AS identifier FROM (SELECT vec_id, 'g' || (vec_id * 7 % 50) AS name, min(vec_id) OVER (PARTITION BY vec_id * 7 % 50) AS first FROM embeddings)",
)
def assign_puzzle_ids(spark, sf_dir):
    named = scan(spark, sf_dir, "embeddings", spread=False).select("vec_id", F.concat(F.lit("g"), (F.col("vec_id") * 7 % 50).cast("string")).alias("name"))
    return Gr.assign_puzzle_ids(named, "name", "vec_id").select("vec_id", "name", "identifier")


@query(
    "dataset_offsets",
    "SELECT label, vec_id, CAST(sum(1 + vec_id % 4) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS puzzle_end, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS puzzle_no FROM embeddings",
)
def dataset_offsets(spark, sf_dir):
    p = scan(spark, sf_dir, "embeddings", spread=False).select("label", "vec_id", (F.col("vec_id") % 4 + 1).alias("n"))
    return Gr.dataset_offsets(p, ["label"], "vec_id", "n").select("label", "vec_id", "puzzle_end", "puzzle_no")


@query(
    "dataset_metadata",
    "SELECT count(DISTINCT label) AS total_groups, count(*) AS total_puzzles, CAST(sum(1 + vec_id % 4) AS BIGINT) AS total_examples, round(sum(1 + vec_id % 4) / count(*), 6) AS mean_puzzle_examples, 12 AS vocab_size, 900 AS seq_len FROM embeddings",
)
def dataset_metadata(spark, sf_dir):
    p = scan(spark, sf_dir, "embeddings", spread=False).select(F.col("label").alias("group_id"), (F.col("vec_id") % 4 + 1).alias("n_examples"))
    return Gr.dataset_metadata(p).withColumn("mean_puzzle_examples", F.round("mean_puzzle_examples", 6))


@query("shuffle_board")
def shuffle_board(spark, sf_dir):
    """Boards drawn from the vectors: a solved base board with digits shifted by the vector number."""
    solved = "transform(sequence(0, 80), p -> cast((3 * (p div 9 % 3) + p div 27 + p % 9 + vec_id) % 9 + 1 as int))"
    boards = scan(spark, sf_dir, "embeddings", spread=False).select(
        F.col("vec_id").alias("board_id"), F.expr(solved).alias("a"), F.expr(f"transform({solved}, (v, p) -> if((p + vec_id) % 3 = 0, v, 0))").alias("q")
    )
    done = Gr.shuffle_board(boards, 3)
    return done.select("board_id", "variant", F.array_join("inputs", "-").alias("inputs"), F.array_join("labels", "-").alias("labels"))


_MAZE_PLACES = ["i * 4 + j", "j * 4 + 3 - i", "(3 - i) * 4 + 3 - j", "(3 - j) * 4 + i", "i * 4 + 3 - j", "(3 - i) * 4 + j", "j * 4 + i", "(3 - j) * 4 + 3 - i"]
_MAZE_SQL = " UNION ALL ".join(
    f"SELECT vec_id, {t} AS tid, list_transform(range(16), lambda p: ((({place.replace('i', '(p // 4)').replace('j', '(p % 4)')}) * 7 + vec_id) % 4 + 1)) AS ids FROM embeddings"
    for t, place in enumerate(_MAZE_PLACES)
)


@query(
    "augment_maze",
    f"SELECT vec_id, tid, array_to_string(ids, '') AS inputs, replace(array_to_string(ids, ''), '2', '5') AS labels FROM ({_MAZE_SQL})",
)
def augment_maze(spark, sf_dir):
    cell = "transform(sequence(0, 15), p -> element_at(array('#', ' ', 'S', 'G'), cast((p * 7 + vec_id) % 4 + 1 as int)))"
    mazes = scan(spark, sf_dir, "embeddings", spread=False).select("vec_id", F.expr(f"array_join({cell}, '')").alias("q"), F.expr(f"replace(array_join({cell}, ''), ' ', 'o')").alias("a"))
    done = Gr.augment_maze(mazes)
    return done.select("vec_id", "tid", F.array_join("inputs", "").alias("inputs"), F.array_join("labels", "").alias("labels"))


@query(
    "pad_batches",
    "SELECT batch, CAST(16 AS BIGINT) AS n_rows, count(*) AS n_real FROM (SELECT vec_id // 16 AS batch FROM embeddings) GROUP BY batch",
)
def pad_batches(spark, sf_dir):
    rows = scan(spark, sf_dir, "embeddings", spread=False).select(
        F.floor(F.col("vec_id") / 16).alias("batch"), F.flatten(F.expr(_whole_grid(1))).alias("inputs"), F.flatten(F.expr(_whole_grid(2))).alias("labels"), (F.col("vec_id") + 1).alias("identifier")
    )
    padded = Gr.pad_batches(rows, "batch", 16, 64)
    return padded.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("identifier") > 0).alias("n_real"))


@query(
    "pad_masks",
    """SELECT vec_id // 16 AS batch, CAST(sum(len(list_filter(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 100) AS BIGINT) % 10 = 0))) + (16 - count(*)) * 64 AS BIGINT) AS n_ignored,
  CAST(sum(list_sum(list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 10) AS BIGINT) % 10))) AS BIGINT) AS input_sum, CAST(16 - count(*) AS BIGINT) AS n_blank
FROM embeddings GROUP BY 1""",
)
def pad_masks(spark, sf_dir):
    """What the labels of a batch ignore: zeros, and all of the rows that fill it up."""
    rows = scan(spark, sf_dir, "embeddings", spread=False).select(
        F.floor(F.col("vec_id") / 16).alias("batch"), F.flatten(F.expr(_whole_grid(1))).alias("inputs"), F.flatten(F.expr(_whole_grid(2))).alias("labels"), (F.col("vec_id") + 1).alias("identifier")
    )
    padded = Gr.pad_batches(rows, "batch", 16, 64)
    return padded.groupBy("batch").agg(
        F.sum(F.size(F.filter("labels", lambda v: v == -100)).cast("long")).alias("n_ignored"),
        F.sum(F.aggregate("inputs", F.lit(0).cast("long"), lambda a, v: a + v)).alias("input_sum"), F.count_if(F.col("identifier") == 0).alias("n_blank"),
    )


@query("inverse_augment", "SELECT 'p' || vec_id AS group_id, true AS restored FROM embeddings")
def inverse_augment(spark, sf_dir):
    images = Gr.augment_grids(whole_puzzles(spark, sf_dir), 3).select("group_id", "puzzle_id", F.expr("examples[0].input").alias("grid"))
    back = Gr.inverse_augment(images, "puzzle_id", "grid", "back")
    originals = whole_puzzles(spark, sf_dir).select(F.col("puzzle_id").alias("group_id"), F.expr("examples[0].input").alias("original"))
    checked = back.join(originals, "group_id").groupBy("group_id").agg(F.bool_and(F.col("back") == F.col("original")).alias("restored"))
    return checked


@query(
    "vote_predictions",
    """WITH t AS (SELECT user_id // 3 AS puzzle_id, user_id AS input_hash, event_type AS pred_hash, count(*) AS n, avg(round(value * 100)) AS q FROM events GROUP BY ALL),
a AS (SELECT DISTINCT user_id // 3 AS puzzle_id, user_id AS input_hash, (['signup', 'view', 'click', 'purchase', 'error'])[user_id % 5 + 1] AS label_hash FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY puzzle_id, input_hash ORDER BY n DESC, q DESC, pred_hash) AS rank FROM t),
w AS (SELECT a.puzzle_id, max(rank) AS worst, bool_and(rank IS NOT NULL) AS found FROM a LEFT JOIN r ON a.puzzle_id = r.puzzle_id AND a.input_hash = r.input_hash AND a.label_hash = r.pred_hash GROUP BY a.puzzle_id)
SELECT k, round(avg(CAST(found AND worst <= k AS DOUBLE)) * 100, 6) AS percent FROM w, (SELECT unnest([1, 2, 3, 5]) AS k) GROUP BY k""",
)
def vote_predictions(spark, sf_dir):
    e = scan(spark, sf_dir, "events", spread=False)
    votes = e.select(F.floor(F.col("user_id") / 3).alias("puzzle_id"), F.col("user_id").alias("input_hash"), F.col("event_type").alias("pred_hash"), F.round(F.col("value") * 100).alias("q"))
    kinds = F.array(*[F.lit(k) for k in ("signup", "view", "click", "purchase", "error")])
    answers = votes.select("puzzle_id", "input_hash").distinct().withColumn("label_hash", F.get(kinds, (F.col("input_hash") % 5).cast("int")))
    return Gr.vote_predictions(votes, answers, (1, 2, 3, 5)).withColumn("percent", F.round("percent", 6))


