"""Text expressions: substring tests, pattern counts, cleaning, subjects, identifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.fixed import corpus


def col_of(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once: lambda bodies otherwise recompute what they mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flagged(pattern: str, ignore_case: bool = False) -> str:
    """Pattern with word, digit and space classes over all of Unicode, and only a line feed ending a line."""
    return ("(?diU)" if ignore_case else "(?dU)") + pattern


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def total(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    return any_of([text.contains(t) for t in terms])


def count_contained(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur at least once."""
    return total([text.contains(t).cast("int") for t in terms])


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(flagged(pattern, ignore_case))


def count_matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_count(text, F.lit(flagged(pattern, ignore_case)))


# -- which words of many patterns a text holds --------------------------------------------------------------------


def word_starts(pattern: str) -> list[str]:
    """Letters or digits with which every match begins behind a word boundary, one entry per alternative; empty if that can't be said
    of some match (fewer than two letters, or no boundary in front)."""
    bounded = re.fullmatch(r"\\b(?:\((?:\?:|(?!\?))([^()]*)\).*|([a-z]{2}.*))", pattern)
    alternatives = (bounded[1] or bounded[2]).split("|") if bounded else []
    if not alternatives or (bounded[2] and len(alternatives) > 1) or re.search(r"(?<!\\)\|", re.sub(r"\([^()]*\)", "", pattern)):
        return []
    starts = [re.match(r"(?:[a-z0-9](?![?*{]))*", a)[0] for a in alternatives]
    return starts if all(len(x) > 1 for x in starts) else []


def found_words(lower: Column, words: Sequence[str]) -> Column:
    """Those of the words with which some word of a lower-cased text begins, as an array.

    The longest of words that begin alike is taken, so whoever looks for a word must accept the longer ones too. Letters that
    only differ from a to z by case are read as these.
    """
    by_letter: dict[str, list[str]] = {}
    for w in sorted(words, reverse=True):  # longer ones first
        by_letter.setdefault(w[0], []).append(w[1:])
    pattern = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    behind = f"(?=[{''.join(by_letter)}])\\b(?:{pattern})"
    odd = any_of([lower.contains(c) for c in "\u017f\u0131\u212a"])
    folded = F.when(odd, F.translate(lower, "\u017f\u0131\u212a", "sik")).otherwise(lower)
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(flagged(behind)), F.lit(0)))


def literal_starts(pattern: str) -> list[str]:
    """Lower-case characters with which every match begins, one entry per alternative; empty if that can't be said."""
    open_choice = re.search(r"(?<!\\)\|", re.sub(r"\([^()]*\)", "", pattern))
    if open_choice and "(" in pattern:
        return []
    starts = [re.match(r"(?:(?:[A-Za-z@:/_-]|\\\$)(?![?*{]))*", a)[0] for a in (pattern.split("|") if open_choice else [pattern])]
    return [x.replace("\\", "").lower() for x in starts] if all(starts) else []


_LONG_NUMBER = r"(?=\d)\b\d{3}(?:-\d{2}-\d|\d[-\s]?\d{4}|[-.\s]\d{3}[-.\s]\d)"  # begins every match of those below
_LONG_NUMBERS = [r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b\d{3}[-\.\s]\d{3}[-\.\s]\d{4}\b"]


def let_gates(text: Column, patterns: Sequence[str], use: Callable[[dict[str, Column]], Column]) -> Column:
    """``use`` over a flag per pattern: false only where it has no match (case ignored) in the text.

    One pass finds the words of all patterns with which a word of the text begins. Patterns without such words may match where
    their first characters occur, long numbers where one of them begins.
    """
    starts = {p: word_starts(p) for p in patterns}
    words = sorted({w for own in starts.values() for w in own})
    numbers = [p for p in patterns if p in _LONG_NUMBERS]

    def gated(t: Column) -> Column:
        def gate(p: str) -> Column:
            if starts[p]:
                return F.arrays_overlap(t["found"], F.array(*[F.lit(w) for w in words if w.startswith(tuple(starts[p]))]))
            if p in numbers:
                return t["number"]
            return t["odd"] | contains_any(t["lower"], literal_starts(p)) if literal_starts(p) else F.lit(True)

        return use({p: gate(p) for p in patterns})

    def with_words(t: Column) -> Column:
        found = found_words(t["lower"], words) if words else F.array().cast("array<string>")
        number = matches(t["text"], _LONG_NUMBER) if numbers else F.lit(False)
        odd = any_of([t["lower"].contains(c) for c in "\u017f\u0131\u212a"])
        return let(F.struct(t["lower"].alias("lower"), found.alias("found"), number.alias("number"), odd.alias("odd")), gated)

    # a dotted capital I is read as i by the patterns, but lower() makes two characters of it
    lower = F.lower(F.when(text.contains("\u0130"), F.translate(text, "\u0130", "i")).otherwise(text))
    return let(F.struct(text.alias("text"), lower.alias("lower")), with_words)


def gated_count(text: Column, pattern: str, gate: Column) -> Column:
    """Number of matches (case ignored) of a pattern of ``let_gates``, 0 where the gate is shut."""
    every = count_matches(text, r"(?=\d)" + pattern if pattern.startswith(r"\b\d") else pattern, True)  # a digit is found faster than a boundary
    return F.when(text.isNull() | gate, every).otherwise(0)


def let_counts(text: Column, patterns: Sequence[str], use: Callable[[dict[str, Column]], Column]) -> Column:
    """``use`` over the number of matches (case ignored) of each pattern; only those are counted that may match."""
    return let(text, lambda t: let_gates(t, patterns, lambda gates: use({p: gated_count(t, p, gates[p]) for p in patterns})))


def array_contains_any(array: Column, values: Sequence[str]) -> Column:
    """True if the array shares a value with a list."""
    if not values:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(array, F.array(*[F.lit(v) for v in values])), F.lit(False))


def is_in(value: Column, values: Sequence[str]) -> Column:
    return F.coalesce(value.isin(*values), F.lit(False)) if values else F.lit(False)


def lookup(value: Column, table: dict, default) -> Column:
    """Small fixed table as a map literal; it travels with the expression, so no join is needed."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(default))


def named_flags(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


# -- cleaning ---------------------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Whitespace of any kind removed from both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_text(text: Column) -> Column:
    """Whitespace runs to one blank, control characters dropped, ends trimmed."""
    one_blank = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.trim(F.regexp_replace(F.trim(one_blank), r"[\x00-\x1f]", ""))


def truncate_words(text: Column, limit: int = 2000) -> Column:
    """At most ``limit`` characters, cut at the last blank if that keeps more than 80 %, with '...' added."""
    head = F.substring(text, 1, limit)
    last_blank = F.length(head) - F.locate(" ", F.reverse(head))  # 0-based, valid if a blank exists
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (last_blank > limit * 0.8), F.left(head, last_blank)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def clean_artifacts(text: Column) -> Column:
    """Drops 'Turn N' markers and code fences."""
    without_turns = F.regexp_replace(text, flagged(r"\bturn\s*\d+\s*:?\s*", True), "")
    return strip(F.replace(without_turns, F.lit("```")))


def synth_subject(body: Column) -> Column:
    """First sentence of the first non-blank line, at most 80 characters; 'Generated Email' if nothing is left."""
    line = strip(F.regexp_extract(body, r"(?U)\S[^\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]*", 0))
    sentence = F.regexp_extract(line, r"^(.{1,80}?)(?:[.!?]|$)", 1)
    chosen = F.when(sentence != "", strip(sentence)).otherwise(F.substring(line, 1, 80))
    bare = strip(F.regexp_replace(chosen, flagged(r"\bturn\s*\d+\b", True), ""))
    return F.when(bare == "", F.lit("Generated Email")).otherwise(bare)


# -- identifiers, addresses, files ------------------------------------------------------------------------------


def email_domain(address: Column) -> Column:
    """Lower-cased text after the last '@' (the whole text if there is none)."""
    return F.lower(F.substring_index(address, "@", -1))


def valid_email(address: Column) -> Column:
    return address.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def address_domains(recipients: Column) -> Column:
    """Domains of the recipients that hold an '@'; channel names drop out."""
    return F.transform(F.filter(recipients, lambda r: r.contains("@")), email_domain)


def stable_id(*fields: Column, length: int = 16) -> Column:
    """First hex digits of the md5 of the fields as JSON."""
    return F.substring(F.md5(F.to_json(F.struct(*fields))), 1, length)


def guess_mime(name: Column) -> Column:
    extension = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    return lookup(extension, corpus.MIME_BY_EXTENSION, corpus.DEFAULT_MIME)


# -- calibration scalars ----------------------------------------------------------------------------------------


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side does not vary (where ``corr`` divides by zero)."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.max(a) > F.min(a)) & (F.max(b) > F.min(b)) & (spread > 0), F.covar_pop(a, b) / spread)


def logit(p: Column, clip: float) -> Column:
    bounded = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.ln(bounded / (1 - bounded))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
