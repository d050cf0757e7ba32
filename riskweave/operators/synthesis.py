"""Synthetic messages, addresses and file names, one per given id, from draws fixed by (seed, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.fixed import synthesis as fixed
from riskweave.functions import rewrite
from riskweave.functions import spans as S
from riskweave.functions.hashing import digest, pick, shuffled, string_array, uniform, uniform_int
from riskweave.functions.spans import let
from riskweave.functions.text import guess_mime
from riskweave.operators.labeling import label_synth


def drawn_digits(n: int, *keys) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: uniform_int(0, 9, *keys, i).cast("string")), "")


def drawn_token(n: int, *keys) -> Column:
    """n upper-case hex characters; a digest has 32."""
    if n > 32:
        raise ValueError("drawn_token gives at most 32 characters")
    return F.upper(F.substring(digest(*keys, "token"), 1, n))


def check_digit(payload: Column) -> Column:
    """The digit that makes payload + digit pass the Luhn check."""

    def weighted(i: Column) -> Column:
        d = F.substring(payload, F.length(payload) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), lambda acc, i: acc + weighted(i))
    return ((10 - total % 10) % 10).cast("string")


def drawn_card(*keys) -> Column:
    """16 digits in groups of four (prefix 4 or 5), the last one the check digit."""
    payload = F.concat(pick(["4", "5"], *keys, "prefix"), drawn_digits(14, *keys, "card"))
    return let(payload, lambda p: F.regexp_replace(F.concat(p, check_digit(p)), r"(\d{4})(?=\d)", "$1 "))


def drawn_name(*keys) -> Column:
    return F.concat_ws(" ", pick(fixed.FIRST_NAMES, *keys, "first"), pick(fixed.LAST_NAMES, *keys, "last"))


def drawn_address_at(domain: Column, *keys) -> Column:
    first, last = F.lower(pick(fixed.FIRST_NAMES, *keys, "first")), F.lower(pick(fixed.LAST_NAMES, *keys, "last"))
    forms = [F.concat_ws(".", first, last), first, F.concat(F.left(first, F.lit(1)), last), F.concat_ws(".", first, F.left(last, F.lit(1)))]
    box = F.get(F.array(*forms), F.floor(uniform(*keys, "form") * len(forms)).cast("int"))
    return F.concat(box, F.lit("@"), domain)


def drawn_term(*keys) -> Column:
    term = pick(fixed.LEGAL_TERMS, *keys, "term")
    numbered = F.concat(term, F.lit(" #"), uniform_int(1000, 9999, *keys, "no").cast("string"))
    return F.when(uniform(*keys, "numbered") < 0.5, numbered).otherwise(term)


def drawn_matter(*keys) -> Column:
    return F.concat_ws("-", pick(fixed.MATTER_PREFIXES, *keys, "mp"), uniform_int(1000, 99999, *keys, "mn").cast("string"))


def drawn_value(kind: Column, *keys) -> Column:
    """A value of a span type."""
    n = lambda low, high, tag: uniform_int(low, high, *keys, tag).cast("string")
    abroad = F.concat_ws(" ", pick(fixed.PHONE_PREFIXES[1:], *keys, "pp"), drawn_digits(3, *keys, "p1"), drawn_digits(3, *keys, "p2"), drawn_digits(3, *keys, "p3"))
    home = F.concat(F.lit("+1 ("), n(201, 999, "area"), F.lit(") "), n(201, 999, "ex"), F.lit("-"), n(1000, 9999, "line"))
    prefix = pick(fixed.SECRET_PREFIXES, *keys, "sp")
    secret = let(
        prefix,
        lambda p: F.concat(p, F.when(p == "ghp_", F.concat(drawn_token(32, *keys), drawn_token(4, *keys, "x"))).otherwise(drawn_token(16, *keys))),
    )
    uri = F.concat(
        pick(fixed.DB_SCHEMES, *keys, "ds"), pick(fixed.DB_USERS, *keys, "du"), F.lit(":"), drawn_token(12, *keys, "pw"), F.lit("@"),
        pick(fixed.DB_HOSTS, *keys, "dh"), F.lit(":"), pick(fixed.DB_PORTS, *keys, "dp"), F.lit("/"), pick(fixed.DB_NAMES, *keys, "dn"),
    )
    place = F.concat(n(100, 9999, "house"), F.lit(" "), pick(fixed.STREETS, *keys, "st"), F.lit(", "), pick(fixed.CITIES, *keys, "ci"), F.lit(" "), n(10000, 99999, "zip"))
    return (
        F.when(kind == "EMAIL", drawn_address_at(pick(fixed.EMAIL_DOMAINS, *keys, "ed"), *keys))
        .when(kind == "PHONE", F.when(uniform(*keys, "home") < 0.2, home).otherwise(abroad))
        .when(kind == "PAN", drawn_card(*keys))
        .when(kind == "SSN", F.concat_ws("-", n(100, 899, "s1"), n(10, 99, "s2"), n(1000, 9999, "s3")))
        .when(kind == "SECRET", secret)
        .when(kind == "DBURI", uri)
        .when(kind == "NDA", drawn_term(*keys))
        .when(kind == "MATTER", drawn_matter(*keys))
        .when(kind == "NAME", drawn_name(*keys))
        .otherwise(place)
    )


def _by_role(role: Column, table: dict[str, list[str]], *keys) -> Column:
    return F.when(role == "LEGAL", pick(table["LEGAL"], *keys)).when(role == "FINANCE", pick(table["FINANCE"], *keys)).otherwise(pick(table["OTHER"], *keys))


def _fill(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _hidden(body: Column, *keys) -> Column:
    """A word in base64, look-alike letters, or a zero-width character at five places."""
    words = F.split(body, " ")
    word = F.get(words, F.floor(uniform(*keys, "word") * F.size(words)).cast("int"))
    encoded = F.replace(body, word, F.concat(F.lit("[BASE64:"), F.base64(word.cast("binary")), F.lit("]")))
    sprinkled = body
    for i in range(5):
        at = F.floor(uniform(*keys, "at", i) * F.length(sprinkled)).cast("int") + 1
        sprinkled = F.overlay(sprinkled, pick(fixed.ZERO_WIDTH, *keys, "zw", i), at, F.lit(0))
    draw = uniform(*keys, "how")
    return F.when(draw < 1 / 3, encoded).when(draw < 2 / 3, rewrite.cyrillic(body, *keys)).otherwise(sprinkled)


def synthesize_messages(ids: DataFrame, key: str, seed: int = 42, obfuscation: float = fixed.OBFUSCATION_PROBABILITY) -> DataFrame:
    """A full message per id: role, values of one to four span types in a template, recipients by role, optional
    obfuscation, spans found again in the final body, and labels."""
    k = (seed, F.col(key))
    base = ids.select(
        F.col(key).alias("msg_id"),
        pick(fixed.ROLES, *k, "role").alias("role"),
        pick(fixed.CHANNELS, *k, "channel").alias("channel"),
        (uniform(*k, "obfuscate") < obfuscation).alias("obfuscated"),
        F.slice(shuffled(string_array(fixed.SPAN_TYPES), *k, "types"), F.lit(1), uniform_int(1, 4, *k, "n")).alias("kinds"),
    )
    k = (seed, F.col("msg_id"))
    data = F.array_join(F.transform("kinds", lambda kind: drawn_value(kind, *k, kind)), ", ")
    values = {
        "nda": drawn_term(*k, "body"), "matter": drawn_matter(*k, "body"),
        "number": uniform_int(10000, 99999, *k, "number").cast("string"), "data": data,
    }
    domains = F.when(F.col("role") == "LEGAL", string_array(fixed.LEGAL_RECIPIENTS)).when(
        F.col("role").isin("FINANCE", "HR"), string_array(fixed.TRUSTED_RECIPIENTS)
    ).otherwise(string_array(fixed.MIXED_RECIPIENTS))
    recipients = F.transform(
        F.sequence(F.lit(1), uniform_int(1, 3, *k, "recipients")),
        lambda i: F.concat(
            F.lower(pick(fixed.FIRST_NAMES, *k, "rf", i)), F.lit("."), F.lower(pick(fixed.LAST_NAMES, *k, "rl", i)), F.lit("@"), pick(domains, *k, "rd", i)
        ),
    )
    files = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).cast("bigint").alias("size"), guess_mime(F.lit(n)).alias("mime")) for n, s in fixed.ATTACHMENTS])
    start = F.floor(uniform(*k, "file") * len(fixed.ATTACHMENTS)).cast("int") + 1
    filled = base.withColumns(
        {
            "subject": _fill(_by_role(F.col("role"), fixed.SUBJECTS, *k, "subject"), values),
            "body": _fill(_by_role(F.col("role"), fixed.BODIES, *k, "template"), values),
            "recipients": recipients,
            "user": F.struct(F.col("role").alias("role"), pick(fixed.DEPARTMENTS, *k, "dept").alias("dept"), pick(fixed.SENIORITIES, *k, "seniority").alias("seniority")),
            "thread": F.struct(
                F.substring(digest(*k, "thread"), 1, 8).alias("id_hash"), uniform_int(0, 30, *k, "age").alias("age_days"), uniform_int(0, 10, *k, "prior").alias("prior_msgs")
            ),
            "attachments": F.when(uniform(*k, "attach") < fixed.ATTACHMENT_PROBABILITY, F.slice(files, start, uniform_int(1, 2, *k, "files"))).otherwise(F.slice(files, 1, 0)),
            "links": F.when(uniform(*k, "link") < fixed.LINK_PROBABILITY, F.array(pick(fixed.LINKS, *k, "url"))).otherwise(F.array().cast("array<string>")),
        }
    )
    hidden = filled.withColumn("body", F.when(F.col("obfuscated"), _hidden(F.col("body"), *k)).otherwise(F.col("body")))
    labelled = label_synth(hidden.withColumn("spans", S.detect("body", "synth")))
    return labelled.withColumn(
        "meta",
        F.create_map(
            F.lit("base64"), (F.col("obfuscated") & F.lower("body").contains("base64")).cast("string"),
            F.lit("homoglyph"), (F.col("obfuscated") & F.col("body").rlike(r"[^\x00-\x7F]")).cast("string"),
        ),
    ).drop("kinds")


def synthesize_emails(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """An internal, an external (by category) and a personal address per id, and a file name by category."""
    k = (seed, F.col(key))
    category = pick(list(fixed.ADDRESS_DOMAINS), *k, "category")
    kind = pick(list(fixed.FILE_NAMES), *k, "kind")
    chosen = ids.select(key, category.alias("category"), kind.alias("file_kind"))
    domain = file_name = None
    for name, domains in fixed.ADDRESS_DOMAINS.items():
        domain = (F if domain is None else domain).when(F.col("category") == name, pick(domains, *k, "domain"))
    for name, names in fixed.FILE_NAMES.items():
        filled = F.replace(pick(names, *k, "name"), F.lit("{n}"), uniform_int(1000, 9999, *k, "no").cast("string"))
        full = F.concat_ws(".", filled, pick(fixed.FILE_EXTENSIONS[name], *k, "ext"))
        file_name = (F if file_name is None else file_name).when(F.col("file_kind") == name, full)
    return chosen.withColumns(
        {
            "internal": drawn_address_at(F.lit("company.com"), *k, "i"),
            "external": drawn_address_at(domain, *k, "e"),
            "personal": drawn_address_at(pick(fixed.PERSONAL_DOMAINS, *k, "pd"), *k, "p"),
            "file_name": file_name,
        }
    )


def simple_synth(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The small template generator."""
    k = (seed, F.col(key))
    base = ids.select(F.col(key).alias("msg_id"), pick(fixed.SMALL_DOMAINS, *k, "domain").alias("domain"))
    k = (seed, F.col("msg_id"))
    body = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.SMALL_BODIES.items() for x in kv]), F.col("domain"))
    return base.withColumns(
        {
            "channel": pick(["email", "chat", "pr"], *k, "channel"),
            "role": pick(["LEGAL", "FINANCE", "HR", "SECURITY", "EMPLOYEE"], *k, "role"),
            "recipients": F.array(F.concat(F.lit("external@"), F.col("domain"), F.lit(".com"))),
            "subject": F.concat(F.lit("Sample "), F.col("domain"), F.lit(" communication")),
            "body": body,
            "sensitivity": uniform_int(0, 1, *k, "s"),
            "exposure": uniform_int(0, 1, *k, "e"),
            "context": F.lit(1),
        }
    )
