"""Variants of messages, obfuscating rewrites and request pairs. Every choice is a draw fixed by (seed, message, variant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.fixed import corpus
from riskweave.functions import obfuscation, rewrite
from riskweave.functions import recipients as R
from riskweave.functions.hashing import digest, pick, uniform, uniform_int
from riskweave.functions.spans import let
from riskweave.functions.text import flagged, stable_id
from riskweave.operators.splits import _with_position

MODES = ["personal_risk", "external_business", "mixed_recipients", "additional_cc"]


def _kept(recipients: Column, most: int | None) -> Column:
    return recipients if most is None else F.slice(recipients, 1, most)


def _moved(recipients: Column, domains, fallback: str, *keys) -> Column:
    """Same mailboxes at drawn domains."""

    def one(r: Column, i: Column) -> Column:
        box = F.when(r.contains("@"), F.substring_index(r, "@", 1)).otherwise(F.lit(fallback))
        return F.concat(box, F.lit("@"), pick(domains, *keys, i))

    return F.transform(recipients, one)


def varied_recipients(recipients: Column, *keys, most_moved: int | None = None, most_mixed: int | None = None) -> Column:
    """One of four modes: personal domains, business domains, all kept plus a personal one, or one or two more.

    ``most_moved`` and ``most_mixed`` keep only the first recipients in the first three modes.
    """
    mode = pick(MODES, *keys, "mode")
    stranger = lambda i, domains: F.concat(
        pick(corpus.VARIANT_MAILBOXES, *keys, "box", i), F.lit("@"), pick(domains, *keys, "at", i)
    )
    first = stranger(0, corpus.VARIANT_BUSINESS_DOMAINS)
    more = F.when(uniform(*keys, "cc") < 0.5, F.array(first)).otherwise(
        F.array(first, stranger(1, corpus.VARIANT_BUSINESS_DOMAINS))
    )
    changed = let(
        mode,
        lambda m: F.when(m == "personal_risk", _moved(_kept(recipients, most_moved), corpus.VARIANT_PERSONAL_DOMAINS, "user", *keys, "p"))
        .when(m == "external_business", _moved(_kept(recipients, most_moved), corpus.VARIANT_BUSINESS_DOMAINS, "contact", *keys, "b"))
        .when(
            m == "mixed_recipients",
            F.concat(_kept(recipients, most_mixed), F.array(stranger(2, corpus.VARIANT_PERSONAL_DOMAINS))),
        )
        .otherwise(F.concat(recipients, more)),
    )
    return F.when(F.size(recipients) > 0, changed).otherwise(recipients)


def varied_body(body: Column, *keys) -> Column:
    """Searched names replaced by drawn ones, dates and urgency words by drawn alternatives."""
    for name in corpus.VARIANT_SEARCHED_NAMES:
        new = F.concat_ws(" ", pick(corpus.VARIANT_FIRST_NAMES, *keys, "first", name), pick(corpus.VARIANT_LAST_NAMES, *keys, "last", name))
        body = F.replace(body, F.lit(name), new)
    for term, alternatives in corpus.VARIANT_TERMS.items():
        body = F.replace(body, F.lit(term), pick(alternatives, *keys, term))
    return body


def varied_subject(subject: Column, *keys) -> Column:
    reply = ~subject.contains("Re:") & (uniform(*keys, "reply") < 0.3)
    return F.when(reply, F.concat(F.lit("Re: "), subject)).otherwise(subject)


def varied_thread(thread: Column, *keys) -> Column:
    fresh = (thread["prior_msgs"] == 0) & (uniform(*keys, "multi") < 0.5)
    running = thread["prior_msgs"] > 0
    return F.struct(
        F.substring(digest(*keys, "thread"), 1, 16).alias("id_hash"),
        F.when(fresh, uniform_int(1, 7, *keys, "age")).when(running, uniform_int(0, 14, *keys, "age")).otherwise(thread["age_days"]).alias("age_days"),
        F.when(fresh, uniform_int(1, 4, *keys, "prior")).when(running, uniform_int(1, 6, *keys, "prior")).otherwise(thread["prior_msgs"]).alias("prior_msgs"),
    )


OBFUSCATIONS = ["asterisk_masking", "base64_encoding", "character_insertion", "homoglyph_replacement"]


def obfuscated_body(body: Column, *keys) -> Column:
    """One of four: masking, an encoded note, spacing after social security numbers, first look-alike characters."""
    lower = F.lower(body)
    encoded = None
    for phrase in corpus.ENCODED_PHRASES:
        note = F.concat(body, F.lit("\n\nEncoded reference: "), F.base64(F.lit(phrase).cast("binary")))
        encoded = (F if encoded is None else encoded).when(lower.contains(phrase), note)
    look_alike = body
    for old, new in corpus.LOOK_ALIKE_DIGITS.items():
        at = F.locate(old, look_alike)
        swapped = F.when(at > 0, F.overlay(look_alike, F.lit(new), at, F.lit(1))).otherwise(look_alike)
        look_alike = F.when(uniform(*keys, "look", old) < corpus.LOOK_ALIKE_PROBABILITY, swapped).otherwise(look_alike)
    return let(
        pick(OBFUSCATIONS, *keys, "kind"),
        lambda k: F.when(k == "asterisk_masking", obfuscation.mask(body))
        .when(k == "base64_encoding", encoded.otherwise(body))
        .when(k == "character_insertion", F.regexp_replace(body, r"(?U)(\d{3})-(\d{2})-(\d{4})", "$1-$2-$3 "))
        .otherwise(look_alike),
    )


def augment(df: DataFrame, ratio: int = 3, probabilities: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Originals (variant_id 0, augmented false) and ``ratio`` variants, each with four optional rewrites."""
    p = probabilities or corpus.AUGMENT_PROBABILITIES
    rows = df.withColumn("base_id", stable_id(F.col("msg_id"), F.col("subject"), F.col("recipients"))).withColumn(
        "variant_id", F.explode(F.sequence(F.lit(0), F.lit(int(ratio))))
    )
    keys = (seed, F.col("msg_id"), F.col("variant_id"))
    on = lambda step: (F.col("variant_id") > 0) & (uniform(*keys, step) < p[step])
    chosen = lambda step, new, old: F.when(on(step), new).otherwise(old)
    varied = rows.withColumns(
        {
            "recipients": chosen("recipients", varied_recipients(F.col("recipients"), *keys), F.col("recipients")),
            "body": chosen("content", varied_body(F.col("body"), *keys), F.col("body")),
            "subject": chosen("content", varied_subject(F.col("subject"), *keys), F.col("subject")),
            "thread": chosen("thread", varied_thread(F.col("thread"), *keys), F.col("thread")),
            "augmented": F.col("variant_id") > 0,
        }
    )
    return varied.withColumn("body", chosen("obfuscation", obfuscated_body(F.col("body"), *keys), F.col("body")))


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy("msg_id").limit(limit)


def violation_scenarios(df: DataFrame, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Authorised messages (the first ``limit``, if given) sent to the same mailboxes at personal domains."""
    authorised = _first(df.filter(F.col("risk_type") == "authorized"), limit)
    box = lambda r: F.when(r.contains("@"), F.substring_index(r, "@", 1)).otherwise("user")
    at = lambda i: pick(corpus.VARIANT_PERSONAL_DOMAINS, seed, "violation", F.col("msg_id"), i)
    return authorised.withColumns(
        {
            "recipients": F.transform("recipients", lambda r, i: F.concat(box(r), F.lit("@"), at(i))),
            "risk_type": F.lit("violation"),
            "violation_reason": F.lit("personal_email_exposure"),
        }
    )


def obfuscated_scenarios(df: DataFrame, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Messages (the first ``limit``, if given) with obfuscated bodies."""
    return _first(df, limit).withColumns(
        {"body": obfuscated_body(F.col("body"), seed, "scenario", F.col("msg_id")), "risk_type": F.lit("obfuscated")}
    )


def with_scenarios(df: DataFrame, ratio: int = 3, seed: int = 42) -> DataFrame:
    """Originals and variants together with violation and obfuscated scenarios."""
    return (
        augment(df, ratio, seed=seed)
        .unionByName(violation_scenarios(df, seed=seed), allowMissingColumns=True)
        .unionByName(obfuscated_scenarios(df, seed=seed), allowMissingColumns=True)
    )


# -- flips ------------------------------------------------------------------------------------------------------

FLIP_SYSTEM = (
    "Move the message between a legitimate and a violating setting. Keep every sensitive value exactly; change only "
    "recipients, authorisation and context. Answer in JSON only."
)


def flip_requests(df: DataFrame, ratio: float, target: str = "flip") -> DataFrame:
    """The first max(1, int(n x ratio)) messages with current risk, goal and prompt pair."""
    placed = _with_position(df, "msg_id", []).filter(F.col("_idx") < F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)))
    current = R.infer_risk_level(F.col("recipients"), F.col("body"))
    goal = F.when(F.col("current_risk").isin("medium_risk", "high_risk"), "low_risk").otherwise("high_risk") if target == "flip" else F.lit(target)
    with_goal = placed.withColumn("current_risk", current).withColumn("goal", goal)
    text = F.concat(
        F.lit("Channel: "), F.col("channel"), F.lit("\nUser: "), F.to_json("user"), F.lit("\nRecipients: "), F.to_json("recipients"),
        F.lit("\nSubject: "), F.col("subject"), F.lit("\nBody: "), F.col("body"), F.lit("\nCurrent Risk Level: "), F.col("current_risk"),
        F.lit("\n\nTransform to: "), F.col("goal"),
        F.lit("\nKeys: channel, user, recipients, subject, body, attachments, links"),
    )
    return with_goal.withColumns({"system_prompt": F.lit(FLIP_SYSTEM), "user_prompt": text}).drop("_idx", "_n")


def sensitive_values(body: Column) -> Column:
    """Distinct sensitive values of a body, addresses left out."""
    found = F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(flagged(p, True)), F.lit(0)) for p in corpus.FLIP_SENSITIVE_PATTERNS]))
    return F.array_distinct(F.filter(found, lambda v: ~v.contains("@")))


def validate_flips(pairs: DataFrame, original: str = "body", flipped: str = "flipped_body", out: str = "valid") -> DataFrame:
    """True if both bodies hold the same non-empty set of sensitive values."""
    sets = F.struct(sensitive_values(F.col(original)).alias("a"), sensitive_values(F.coalesce(flipped, F.lit(""))).alias("b"))
    same = lambda s: (F.size(F.array_except(s["a"], s["b"])) == 0) & (F.size(F.array_except(s["b"], s["a"])) == 0)
    return pairs.withColumn(out, let(sets, lambda s: (F.size(s["a"]) > 0) & same(s)))


# -- semantic obfuscation ---------------------------------------------------------------------------------------


def semantic_obfuscate(df: DataFrame, value: str = "value", data_type: str = "data_type", level: str = "sophistication", seed: int = 42, key: str = "msg_id") -> DataFrame:
    """Technique by level (those whose business context mentions the data type first), rewritten value, sentence."""
    return df.withColumn(
        "_t", rewrite.choose_technique(F.col(data_type), F.col(level), seed, F.col(key))
    ).withColumns(
        {
            "technique": F.col("_t.name"),
            "technique_type": F.col("_t.kind"),
            "detection_difficulty": F.col("_t.difficulty"),
            "obfuscated": rewrite.apply_technique(F.col(value), F.col(data_type), F.col("_t.kind"), seed, F.col(key)),
            "reason": rewrite.business_reason(F.col(data_type), F.col(level)),
        }
    ).withColumn("sentence", rewrite.sentence(F.col("obfuscated"), F.col("reason"), seed, F.col(key))).drop("_t")


def progressive_reveal(df: DataFrame, value: str, parts: int = 3) -> DataFrame:
    """One row per part of a value (digits by characters, else words), numbered from 0."""
    return df.select("*", F.posexplode(rewrite.parts(F.col(value), parts)).alias("part_no", "part"))


def reassemble(parts: DataFrame, key: str, separator: str = "") -> DataFrame:
    """Values from their parts. A value has few parts (it was split into them), so the gathered list is short."""
    gathered = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part_no", "part"))).alias("p"))
    return gathered.select(key, F.array_join(F.transform("p", lambda x: x["part"]), separator).alias("value"))


