"""Obfuscation flags, technique names and masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.fixed import span_patterns as fixed
from riskweave.functions.normal_forms import normal_lengths
from riskweave.functions.text import any_of, contains_any, let, matches, named_flags


def obfuscation_flags(text: Column) -> dict[str, Column]:
    """The seven flags of one text, by name."""
    lower = F.lower(text)
    flags = {"base64": contains_any(lower, ["base64", "encoded"])}
    for name, pattern in fixed.OBFUSCATION_FLAG_PATTERNS.items():
        flags[name] = matches(text, pattern, True)
    flags["unicode_tricks"] = contains_any(text, list(fixed.ZERO_WIDTH_CHARACTERS)) | let(
        normal_lengths(text), lambda n: n["decomposed"] > n["composed"] * F.lit(fixed.NFD_GROWTH_LIMIT)
    )
    return flags


def is_obfuscated(text: Column) -> Column:
    return any_of(list(obfuscation_flags(text).values()))


def techniques(text: Column) -> Column:
    """Names of the techniques a text shows."""
    lower = F.lower(text)
    return named_flags(
        {
            "numerical_words": contains_any(lower, fixed.TECHNIQUE_NUMBER_WORDS),
            "textual_decomposition": contains_any(text, fixed.TECHNIQUE_DECOMPOSITION),
            "euphemisms": contains_any(lower, fixed.TECHNIQUE_EUPHEMISM),
            "contextual_reference": contains_any(lower, fixed.TECHNIQUE_REFERENCE),
            "multilingual": contains_any(lower, fixed.TECHNIQUE_SPANISH),
        }
    )


def regex_flag(text: Column) -> Column:
    return any_of([matches(text, p, True) for p in fixed.CONVERTER_OBFUSCATION])


def non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def mask(text: Column) -> Column:
    """Masks social security and card numbers, keeping the last four digits."""
    for pattern, stars, group in (fixed.MASK_SSN, fixed.MASK_CARD):
        text = F.regexp_replace(text, "(?U)" + pattern, f"{stars}${group}")
    return text
