"""Obfuscating rewrites of a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.fixed import corpus
from riskweave.functions.hashing import pick, uniform
from riskweave.functions.markup import characters
from riskweave.functions.spans import digits_of
from riskweave.functions.text import lookup

# Words for digits and separators by language.
DIGIT_WORDS = {
    "english": corpus.ENGLISH_DIGITS, "spanish": corpus.SPANISH_DIGITS,
    "french": corpus.FRENCH_DIGITS, "german": corpus.GERMAN_DIGITS,
}
SEPARATOR_WORDS = {
    "english": {"-": "dash", ".": "dot"}, "spanish": {"-": "guión", ".": "punto"},
    "french": {"-": "guión", ".": "punto"}, "german": {"-": "guión", ".": "punto"},
}


def digits_to_words(value: Column, language: str = "english") -> Column:
    """Each digit as its word, '-' and '.' as words, other characters kept, blank-separated."""
    words = {str(d): w for d, w in enumerate(DIGIT_WORDS[language])} | SEPARATOR_WORDS[language]
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(characters(value), lambda c: F.coalesce(F.element_at(table, c), c)), " ")


def decompose_email(address: Column, style: str = "basic") -> Column:
    if style == "basic":
        return F.replace(F.replace(address, F.lit("."), F.lit(" dot ")), F.lit("@"), F.lit(" at "))
    if style == "verbose":
        return F.replace(F.replace(address, F.lit("."), F.lit(" point ")), F.lit("@"), F.lit(" at the domain "))
    spelled = lambda c: F.when(c == ".", " dot ").when(c == "@", " at ").otherwise(F.concat(c, F.lit(" ")))
    return F.trim(F.array_join(F.transform(characters(address), spelled), ""))


def decompose_url(url: Column) -> Column:
    dotted = F.replace(url, F.lit("."), F.lit(" dot "))
    return F.replace(F.replace(dotted, F.lit("://"), F.lit(" colon slash slash ")), F.lit("/"), F.lit(" slash "))


def space_digits(value: Column, pattern: str = "groups", *keys) -> Column:
    """'groups': three blanks before every fourth character, one before every other second; 'random': a blank before
    a character with probability .3."""
    if pattern == "groups":
        gap = lambda i: F.when(i % 4 == 0, "   ").when(i % 2 == 0, " ").otherwise("")
    else:
        gap = lambda i: F.when(uniform(*keys, "gap", i) < 0.3, " ").otherwise("")
    return F.array_join(F.transform(characters(value), lambda c, i: F.concat(F.when(i > 0, gap(i)).otherwise(""), c)), "")


def euphemism(data_type: Column, *keys) -> Column:
    result = None
    for kind, words in corpus.BUSINESS_EUPHEMISMS.items():
        result = (F if result is None else result).when(data_type == kind, pick(words, *keys, "euphemism"))
    return result.otherwise(F.concat(data_type, F.lit(" information")))


def cyrillic(text: Column, *keys) -> Column:
    """Each look-alike letter pair swapped everywhere with probability .3."""
    for old, new in corpus.CYRILLIC_LOOK_ALIKES.items():
        text = F.when(uniform(*keys, "cyrillic", old) < corpus.CYRILLIC_PROBABILITY, F.replace(text, F.lit(old), F.lit(new))).otherwise(text)
    return text


# -- techniques -------------------------------------------------------------------------------------------------


def _techniques(level: str) -> Column:
    rows = [t for t in corpus.TECHNIQUES if t[2] == level]
    return F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(c.lower()).alias("context"), F.lit(d).alias("difficulty"))
            for n, k, _, c, d in rows
        ]
    )


def choose_technique(data_type: Column, level: Column, *keys) -> Column:
    """A drawn technique of the level; those whose business context names the data type are preferred."""

    def of(candidates: Column) -> Column:
        fitting = F.filter(candidates, lambda t: F.contains(t["context"], F.lower(data_type)))
        pool = F.when(F.size(fitting) > 0, fitting).otherwise(candidates)
        return F.get(pool, F.floor(uniform(*keys, "technique") * F.size(pool)).cast("int"))

    levels: Sequence[str] = ("low", "medium", "high")
    return F.when(level == levels[0], of(_techniques("low"))).when(level == levels[1], of(_techniques("medium"))).otherwise(of(_techniques("high")))


def apply_technique(value: Column, data_type: Column, kind: Column, *keys) -> Column:
    """The value rewritten; types a technique cannot rewrite keep the value."""
    all_digits = value.rlike("^[0-9]+$")
    in_words = F.when(data_type.isin("credit_card", "phone"), digits_to_words(digits_of(value))).when(data_type == "ssn", digits_to_words(value)).otherwise(value)
    named = euphemism(data_type, *keys)
    return (
        F.when(kind == "numerical_words", in_words)
        .when(kind == "textual_decomp", F.when(data_type == "email", decompose_email(value)).when(data_type == "url", decompose_url(value)).otherwise(value))
        .when(kind == "spatial_breakdown", space_digits(value))
        .when(kind == "euphemisms", F.when(all_digits, F.concat_ws(": ", named, digits_to_words(value))).otherwise(F.concat(named, F.lit(" details"))))
        .when(kind == "multilingual", F.when(all_digits, digits_to_words(value, "spanish")).otherwise(value))
        .when(kind == "contextual_hiding", F.concat(F.lit("the "), data_type, F.lit(" mentioned in our call")))
        .when(kind == "technical_encoding", F.concat(F.lit("base64 encoded "), data_type, F.lit(" in secure storage")))
        .when(kind == "attachment_hiding", F.concat(data_type, F.lit(" details in attached secure document")))
        .otherwise(value)
    )


def business_reason(data_type: Column, level: Column) -> Column:
    table = {f"{t}|{lv}": text for t, levels in corpus.EUPHEMISM_REASONS.items() for lv, text in levels.items()}
    known = lookup(F.concat_ws("|", data_type, level), table, None)
    return F.coalesce(known, F.concat(data_type, F.lit(" handling for business purposes")))


def sentence(value: Column, reason: Column, *keys) -> Column:
    """A plain sentence holding the value; wording is free."""
    forms = [
        F.concat(F.lit("About the "), reason, F.lit(": we need "), value, F.lit(".")),
        F.concat(F.lit("The "), reason, F.lit(" is waiting for "), value, F.lit(".")),
        F.concat(F.lit("Use "), value, F.lit(" for the "), reason, F.lit(".")),
    ]
    return F.get(F.array(*forms), F.floor(uniform(*keys, "sentence") * len(forms)).cast("int"))


def parts(value: Column, n: int) -> Column:
    """A value in chunks of len // n characters (digits) or words; a value too short for n parts stays whole."""
    words = F.split(F.trim(value), r"(?U)\s+")
    by_chars = value.rlike("^[0-9]+$") & (F.length(value) >= n)
    char_size, word_size = F.floor(F.length(value) / n).cast("int"), F.floor(F.size(words) / n).cast("int")
    starts = lambda total, size: F.sequence(F.lit(0), total - 1, size)
    chunks = F.transform(starts(F.length(value), char_size), lambda s: F.substring(value, s + 1, char_size))
    groups = F.transform(starts(F.size(words), word_size), lambda s: F.array_join(F.slice(words, s + 1, word_size), " "))
    return F.when(by_chars, chunks).when(F.size(words) >= n, groups).otherwise(F.array(value))
