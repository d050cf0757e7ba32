"""Repeatable pseudo-randomness.

Every draw is a function of (seed, keys), never of the partition or the attempt, so retried tasks and
differently sized clusters give the same rows. md5 is used because other engines can recompute it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_DRAW_DIGITS = 13  # hex digits of the digest that make one draw: 52 bits, exact in a double
_DRAW_RANGE = float(16**_DRAW_DIGITS)


def _as_text(key) -> Column:
    return (key if isinstance(key, Column) else F.lit(str(key))).cast("string")


def digest(*keys) -> Column:
    """md5 of the keys joined by '|'; sorts like a random shuffle."""
    return F.md5(F.concat_ws("|", *[_as_text(k) for k in keys]))


def uniform(*keys) -> Column:
    """Draw in [0, 1) fixed by the keys."""
    return F.conv(F.substring(digest(*keys), 1, _DRAW_DIGITS), 16, 10).cast("double") / F.lit(_DRAW_RANGE)


def below(p: float, drawn: Column) -> Column:
    """Whether the draw of a digest is below p: ``uniform(*keys) < p`` for ``digest(*keys)``, without the number."""
    edge = math.ceil(p * _DRAW_RANGE)  # exact: p is scaled by a power of two
    if not 0 < edge < _DRAW_RANGE:
        return drawn.isNotNull() & F.lit(edge > 0)
    return drawn < F.lit(f"{edge:0{_DRAW_DIGITS}x}")


def uniform_int(low: int, high: int, *keys) -> Column:
    """Whole number in [low, high], both ends included."""
    return (F.lit(low) + F.floor(uniform(*keys) * F.lit(high - low + 1))).cast("int")


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def pick(values: Sequence[str] | Column, *keys) -> Column:
    """One element of a list chosen by the draw of ``keys``."""
    if isinstance(values, Column):
        return F.get(values, F.floor(uniform(*keys) * F.size(values)).cast("int"))
    return F.get(string_array(values), F.floor(uniform(*keys) * F.lit(len(values))).cast("int"))


def pick_weighted(weights: dict[str, float], *keys) -> Column:
    """One key of ``weights`` with probability proportional to its weight."""
    total = sum(weights.values())
    draw = uniform(*keys)
    names = list(weights)
    edge, branch = 0.0, None
    for name in names[:-1]:
        edge += weights[name] / total
        branch = (F if branch is None else branch).when(draw < F.lit(edge), F.lit(name))
    return F.lit(names[-1]) if branch is None else branch.otherwise(F.lit(names[-1]))


def shuffled(values: Column, *keys) -> Column:
    """The array in the order of each element's digest: a permutation fixed by the keys."""
    keyed = F.transform(values, lambda v, i: F.struct(digest(*keys, i).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda p: p["v"])
