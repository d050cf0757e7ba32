"""Secrets in whole texts by patterns and by a battery of randomness tests (operator 8). DataFrame functions only.

Pattern spans (``assign``, ``access``, ``hex``) are the leftmost non-overlapping matches of each kind. Offsets come from
the lengths of the matches and of the gaps between them, in code points.

``random`` spans are added by tests on the other runs of 20 or more characters ``[A-Za-z0-9+/_-]`` (and up to two
``=``):

1. The encoding is inferred from the characters: decimal, letters of one case, hex in either case, base 32, base 36,
   base 62 or base 64.
2. Evidence against ordinary text, the p-value that is controlled: probability of the run as text over its probability
   under a uniform alphabet of its encoding, times the number of encodings. By Markov's inequality this is a p-value
   under the text model for every length. The model is a chain over the characters of a run: changes between lower
   case, upper case, digits and signs, letters by the letter before (either case), digits and signs by their shares,
   all counted over all words of all documents; ``PLAIN`` of each rate is spread evenly, so that changes and pairs the
   documents happen to lack stay possible.
3. Randomness under the encoding, a gate: chi-squared test of a uniform alphabet (Wilson-Hilferty), runs test about the
   middle of the alphabet, and serial correlation of neighbours. The smallest p-value times three must reach
   ``ALPHA``; a truly random token is lost with that probability.
4. Length-aware false-discovery control: Benjamini-Hochberg at ``FDR`` over the p-values of 2 for all tested runs of the
   corpus, each octave of lengths a family of its own, so that the many short runs don't decide about the long ones. The
   p-values of a family are counted in bins of a tenth of a decade (rounded against discovery), so the corpus-wide step
   is one partial aggregation to at most 40 x 400 counts; only a cut per octave returns to the driver. No cut accepts a
   p-value above ``FDR``, so the gate is computed below it only.

Decimal runs of 24 digits and more are ``hex`` spans; shorter ones are judged by how often digits follow digits in the
documents, so where long numbers are common they can't be told from them.

A random span that overlaps a pattern span is dropped. Two scans of the texts: one counts words (only distinct words are
shuffled, at most 67 x 66 pair counts return), one finds and tests; its narrow result is checkpointed, since the control
needs all counts before the first decision.

Defined results: one row per input row; a null or empty text has no spans; a null id stays null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.tables import let
from riskweave.session import reliable_checkpoint

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more characters: runs are maximal
HEX = r"[0-9a-f]{24,}"
VALUE_LENGTH = 6
KINDS = ("assign", "access", "hex", "random")

RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHA = 0.001
PLAIN = 0.25
FDR = 0.01
_BINS = 400
_LEAST_BIN = 20  # p = FDR

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = "+/_-"
CHARACTERS = _LOWER + _UPPER + _DIGITS + SIGNS
_KINDS = np.repeat(np.arange(4), [26, 26, 10, 4])  # lower case, upper case, digit, sign
START = "^"
# Inferred encoding: the first whose characters are all the run has.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", _DIGITS),
    ("lower", r"^[a-z]+$", _LOWER),
    ("UPPER", r"^[A-Z]+$", _UPPER),
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("base36", r"^[a-z0-9]+$", _DIGITS + _LOWER),
    ("BASE36", r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("base62", r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
)


def match_spans(text: Column, matches: Column, pattern: str) -> Column:
    """Array of (start, stop, found) of the matches; ``matches`` are all matches of ``pattern`` in ``text``."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    none = F.array().cast("array<struct<start:int,stop:int,found:string>>")
    placed = let(
        gaps,
        lambda gap: F.aggregate(
            F.arrays_zip(matches.alias("found"), F.slice(gap, 1, F.size(matches)).alias("gap")),
            F.struct(F.lit(0).alias("at"), none.alias("spans")),
            lambda s, m: _append(s, m["found"], m["gap"]),
            lambda s: s["spans"],
        ),
    )
    return F.when(F.size(matches) > 0, placed).otherwise(none)


def _append(state: Column, found: Column, gap: Column) -> Column:
    start = state["at"] + gap
    stop = start + F.length(found)
    span = F.struct(start.alias("start"), stop.alias("stop"), found.alias("found"))
    return F.struct(stop.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))


def _upper_tail(z: Column) -> Column:
    """P(N > z) for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _battery(codes: Column, k: Column) -> Column:
    """Smallest p-value of the three tests, times three. ``codes``: alphabet positions, ``k``: alphabet size."""
    n = F.size(codes).cast("double")
    squares = F.aggregate(
        F.array_distinct(codes), F.lit(0.0),
        lambda a, c: a + F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0)),
    )
    df = k - 1
    chi = k / n * squares - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p_chi = F.when(z_chi > 0, _upper_tail(z_chi)).otherwise(F.lit(0.5))

    middle = (k - 1) / 2
    high = F.size(F.filter(codes, lambda x: x > middle)).cast("double")
    both = 2 * high * (n - high)
    first, second = F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1)
    changes = F.size(F.filter(F.zip_with(first, second, lambda a, b: (a > middle) != (b > middle)), lambda x: x))
    variance = both * (both - n) / (n * n * (n - 1))
    p_runs = F.when(variance > 0, _two_sided((changes - both / n) / F.sqrt(variance))).otherwise(F.lit(0.0))

    mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(codes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    lagged = F.aggregate(F.zip_with(first, second, lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, x: a + x)
    p_serial = F.when(spread > 0, _two_sided((lagged / spread + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
    return 3 * F.least(p_chi, p_runs, p_serial)


def text_counts(texts: DataFrame, text: str) -> np.ndarray:
    """How often each character of a run follows the start of a word (last row) or each other one, in all words."""
    words = texts.select(F.explode_outer(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_-]+"), F.lit(0))).alias("w"))
    parts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("w is not null").select(
        F.filter(F.split("w", ""), lambda c: c != "").alias("c"), "n"
    )
    before = F.concat(F.array(F.lit(START)), F.slice("c", 1, F.size("c") - 1))
    pairs = parts.select(F.explode_outer(F.zip_with(before, "c", lambda a, b: F.concat(a, b))).alias("pair"), "n")
    counts = np.zeros((len(CHARACTERS) + 1, len(CHARACTERS)))
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 67 x 66
        counts[CHARACTERS.find(r.pair[0]), CHARACTERS.index(r.pair[1])] = r.n  # START isn't found: row -1
    return counts


def text_model(counts: np.ndarray) -> np.ndarray:
    """log10 of the text probability of each character (columns) after each other one, or at the start (last row)."""
    kinds = np.append(_KINDS, 4)
    one = np.eye(5)[kinds]
    change = one.T @ counts @ one[:-1, :4] + 1
    change = (1 - PLAIN) * change / change.sum(axis=1, keepdims=True) + PLAIN / 4
    fold = np.append(np.arange(len(CHARACTERS)), len(CHARACTERS))
    fold[26:52] -= 26
    total = np.bincount(fold[:-1], counts.sum(axis=0), len(CHARACTERS))
    share = np.ones(len(CHARACTERS))
    for kind in (0, 2, 3):
        of = _KINDS == kind
        share[of] = (total[of] + 1) / (total[of] + 1).sum()
    letters = counts[:52, :52].reshape(2, 26, 2, 26).sum(axis=(0, 2)) + 26 * share[:26]
    letters /= letters.sum(axis=1, keepdims=True)
    inside = np.tile(share[fold[:-1]], (len(CHARACTERS) + 1, 1))
    inside[:52, :52] = np.tile(letters, (2, 2))
    size = np.array([26, 26, 10, 4])[_KINDS]
    return np.log10(change[kinds][:, _KINDS] * ((1 - PLAIN) * inside + PLAIN / size))


def _tested(span: Column, model: Column) -> Column:
    """Encoding, octave of the length, bin of the text p-value and whether the battery lets the run pass."""
    run = span["found"]
    alphabet, name = F.lit(""), F.lit("mixed")
    for encoding, pattern, letters in reversed(ENCODINGS):
        fits = run.rlike(pattern)
        alphabet, name = F.when(fits, F.lit(letters)).otherwise(alphabet), F.when(fits, F.lit(encoding)).otherwise(name)
    body = F.regexp_replace(run, "=+$", "")
    codes = lambda a: F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.position(c, a) - 1)
    width = len(CHARACTERS)
    as_text = F.aggregate(
        codes(F.lit(CHARACTERS)),
        F.struct(F.lit(width).alias("before"), F.lit(0.0).alias("log_p")),
        lambda s, c: F.struct(c.alias("before"), (s["log_p"] + F.get(model, s["before"] * width + c)).alias("log_p")),
        lambda s: s["log_p"],
    )
    uniform = lambda a: -F.length(body) * F.log10(F.length(a).cast("double"))
    log_p = lambda a: F.least(as_text - uniform(a) + F.log10(F.lit(float(len(ENCODINGS)))), F.lit(0.0))
    found = lambda a, level: F.struct(
        span["start"].alias("start"), span["stop"].alias("stop"), name.alias("encoding"),
        F.floor(F.log2(F.length(run).cast("double"))).cast("int").alias("octave"), level.alias("bin"),
        F.when(level < _LEAST_BIN, F.lit(False))
        .otherwise(
            let(F.transform(codes(a), lambda c: c.cast("double")), lambda c: _battery(c, F.length(a).cast("double"))) >= ALPHA
        ).alias("random"),
    )
    level = lambda a: F.when(a == "", F.lit(0)).otherwise(F.least(F.floor(-log_p(a) * 10), F.lit(_BINS))).cast("int")
    return let(alphabet, lambda a: let(level(a), lambda b: found(a, b)))


def _without_overlap(runs: Column, base: Column) -> Column:
    return F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))


def discovery_cuts(tested: DataFrame) -> dict[int, int]:
    """Per octave of lengths the lowest bin that Benjamini-Hochberg accepts; ``tested``: octave, bin, random."""
    counts = tested.groupBy("octave", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("random").cast("long")).alias("passed")
    )
    by_octave: dict[int, list] = {}
    for r in counts.collect():  # at most 40 octaves x 401 bins
        by_octave.setdefault(r.octave, []).append((r.bin, r.n, r.passed))
    cuts = {}
    for octave, rows in by_octave.items():
        total, found = sum(n for _, n, _ in rows), 0
        for b, _, passed in sorted(rows, reverse=True):
            found += passed
            if found and 10 ** (-b / 10) <= FDR * found / total:
                cuts[octave] = b
    return cuts


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and spans of each kind (see the module text)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = rows.select(
        "*", *[F.regexp_extract_all("t", F.lit(p), 0).alias(name)
               for name, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("runs", RUN))]
    )
    spans = found.select(
        "doc_id",
        F.filter(
            match_spans(F.col("t"), F.col("assign"), ASSIGN),
            lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= VALUE_LENGTH,
        ).alias("assign"),
        match_spans(F.col("t"), F.col("access"), ACCESS).alias("access"),
        match_spans(F.col("t"), F.col("hex"), HEX).alias("hex"),
        match_spans(F.col("t"), F.col("runs"), RUN).alias("runs"),
    )
    other = spans.select(
        "doc_id", "assign", "access", "hex",
        _without_overlap(F.col("runs"), F.concat("assign", "access", "hex")).alias("runs"),
    )
    strip = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    rates = ",".join(f"{x:.6f}" for x in text_model(text_counts(rows, "t")).ravel())
    model = F.split(F.lit(rates), ",").cast("array<double>")  # a literal once the plan is optimised
    tested = F.transform("runs", lambda r: _tested(r, model)).alias("runs")
    scanned = reliable_checkpoint(other.select("doc_id", *[strip(F.col(k)).alias(k) for k in KINDS[:3]], tested))
    cuts = discovery_cuts(scanned.select(F.explode("runs").alias("r")).select("r.octave", "r.bin", "r.random"))
    accepted = lambda r: F.coalesce(r["random"] & (r["bin"] >= _cut(r["octave"], cuts)), F.lit(False))
    return scanned.select(
        "doc_id", "assign", "access", "hex",
        F.transform(
            F.filter("runs", accepted), lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))
        ).alias("random"),
    )


def _cut(octave: Column, cuts: dict[int, int]) -> Column:
    out = F.lit(_BINS + 1)
    for o, b in cuts.items():
        out = F.when(octave == o, F.lit(b)).otherwise(out)
    return out


def joined_spans(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the named span columns, by start, then in the order of the kinds, comma-joined."""

    def ranked(kind: str, rank: int) -> Column:
        return F.transform(
            kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"))
        )

    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(
            F.array_sort(F.concat(*[ranked(kind, rank) for rank, kind in enumerate(kinds)])),
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )
