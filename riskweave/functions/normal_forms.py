"""Lengths of the canonical composed and decomposed forms of a text, as column expressions.

The tables are made at import from Python's Unicode data: the characters that a form lengthens, each with a letter that says by
how much, and the sequences of a base letter and marks that compose. ASCII characters stay as they are in both forms, so they are
dropped before anything is looked up.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.text import let

_HANGUL = range(0xAC00, 0xD7A4)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _class(points: list[int]) -> str:
    """Regular expression class of code points, in ranges."""
    out, points = "", sorted(points)
    while points:
        first = last = points.pop(0)
        while points and points[0] == last + 1:
            last = points.pop(0)
        out += f"\\x{{{first:X}}}" + (f"-\\x{{{last:X}}}" if last > first else "")
    return f"[{out}]"


def _tables() -> tuple[dict[tuple[int, int], str], str]:
    """Characters by what NFD and what NFC adds, and a pattern of decomposed letters that compose."""
    longer: dict[tuple[int, int], list[str]] = defaultdict(list)
    bases: dict[str, set[int]] = defaultdict(set)
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point < 0xE000:
            continue
        letter = chr(point)
        full, composed = unicodedata.normalize("NFD", letter), unicodedata.normalize("NFC", letter)
        if len(full) > 1 or len(composed) > 1:
            longer[len(full) - 1, len(composed) - 1].append(letter)
        if point not in _HANGUL and len(full) > 1 and composed == letter:
            bases[full[1:]].add(ord(full[0]))
            step = unicodedata.normalize("NFC", full[:-1])
            if len(step) == 1:
                bases[full[-1]].add(ord(step))
    marks = sorted(bases, key=lambda m: (-len(m), m))
    pattern = "|".join(_class(sorted(bases[m])) + "".join(f"\\x{{{ord(c):X}}}" for c in m) for m in marks)
    followed = f"(?=(?s:.)[^\\x00-\\x7F&&{_class(sorted({ord(m[0]) for m in marks}))}])"  # few characters have a mark behind them
    return {added: "".join(letters) for added, letters in longer.items()}, f"{followed}(?:{pattern})"


_LONGER, _COMPOSING = _tables()
_LETTER_OF = dict(zip(_LONGER, _LETTERS, strict=False))
assert len(_LETTER_OF) == len(_LONGER)
_JAMO = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}](?:[\x{11A8}-\x{11C2}])?"


def _joined(text: Column) -> Column:
    """Every composing sequence, and every sequence of letters of a Hangul syllable, as one character."""
    return F.regexp_replace(F.regexp_replace(text, _JAMO, "x"), _COMPOSING, "x")


def normal_lengths(text: Column) -> Column:
    """struct<decomposed, composed>: lengths of the canonical decomposition (NFD) and of the canonical composition (NFC) of a text
    whose marks stand in canonical order."""
    letters = "".join(_LETTER_OF[added] * len(points) for added, points in _LONGER.items())
    others = F.translate(F.regexp_replace(text, r"[\x00-\x7F]+", ""), "".join(_LONGER.values()), letters)

    def lengths(t: Column) -> Column:
        n = {added: F.length(t) - F.length(F.replace(t, F.lit(letter))) for added, letter in _LETTER_OF.items()}
        decomposed = F.length(text)
        composed = F.length(F.when(t.rlike(r"[\p{M}\x{1161}-\x{11C2}]"), _joined(text)).otherwise(text))
        for (apart, together), count in n.items():
            decomposed = decomposed + count * apart
            composed = composed + count * together if together else composed
        return F.struct(decomposed.alias("decomposed"), composed.alias("composed"))

    same = F.struct(F.length(text).alias("decomposed"), F.length(text).alias("composed"))
    return F.when(text.rlike(r"[^\x00-\x7F]"), let(others, lengths)).otherwise(same)


def decomposed_length(text: Column) -> Column:
    """Length of the canonical decomposition (NFD)."""
    return normal_lengths(text)["decomposed"]


def composed_length(text: Column) -> Column:
    """Length of the canonical composition (NFC) of a text whose marks stand in canonical order."""
    return normal_lengths(text)["composed"]
