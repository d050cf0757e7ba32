"""Span detection inside one row.

A rule's matches and their code-point offsets come from one replacing pass of the regex engine: each match is
wrapped in a marker character and the text is split at the markers, so gaps and matches alternate and a running
length gives the offsets. No Python in the data path and no shuffle; a text is never cut.

The expressions are deep, so they are composed as SQL text and parsed once; texts and span columns are therefore
given by name (or as a SQL expression).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.fixed import span_patterns as fixed
from riskweave.functions.text import flagged, is_in, let

_MARK = "\u0001"
_MARK_STAND_IN = "\u0002"  # a control character of the same regex classes
_STOP = "\u0005"  # put into a text where a match can't go on; takes no room
_BLOCK = "greatest(16, cast(sqrt(size(everything)) as int))"  # items folded at a time by scan()

_WORK_TYPE = "struct<start:int,rule:int,end:int,type:string,text:string,confidence:double>"


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _empty(element_type: str) -> str:
    return f"cast(array() as array<{element_type}>)"


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _scan(items: str, carry: str, advance: str, emit: str, element_type: str, tail: str | None = None) -> str:
    """Left-to-right pass over an array that carries a struct and emits arrays, as SQL.

    ``advance`` is the next carry and ``emit`` what an item adds, both over the item ``x`` and the carry ``{c}``;
    ``tail`` is what the end adds. Results are gathered block by block and flattened once, so a row with very many
    items costs about linear time (appending to one growing array would be quadratic).
    """
    step = (
        f"named_struct('carry', {advance.replace('{c}', 's.carry')}, "
        f"'out', concat(s.out, {emit.replace('{c}', 's.carry')}))"
    )
    inner = f"aggregate(block, named_struct('carry', state.carry, 'out', {_empty(element_type)}), (s, x) -> {step})"
    over_block = _let("r", inner, "named_struct('carry', r.carry, 'chunks', concat(state.chunks, array(r.out)))")
    chunks = f"concat(fin.chunks, array({tail.replace('{c}', 'fin.carry')}))" if tail else "fin.chunks"
    blocks = (
        f"transform(sequence(0, cast((size(everything) - 1) div {_BLOCK} as int)), "
        f"b -> slice(everything, b * {_BLOCK} + 1, {_BLOCK}))"
    )
    whole = (
        f"aggregate({blocks}, named_struct('carry', {carry}, 'chunks', cast(array() as array<array<{element_type}>>)), "
        f"(state, block) -> {over_block}, fin -> flatten({chunks}))"
    )
    return _let("everything", items, f"if(size(everything) > 0, {whole}, {_empty(element_type)})")


# -- rules ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SpanRule:
    """One pattern of a rule set.

    ``keep`` (SQL over the matched text ``{t}``) filters matches; ``type_of`` (the same) derives the type; ``guard``
    are plain patterns that every match must hold, tried first because they are cheap; ``prepare`` (SQL over ``{t}``) may put
    ``_STOP`` where no match can go on, so that attempts that must fail end early.
    """

    type: str
    pattern: str
    ignore_case: bool = False
    confidence: float = 1.0
    keep: str | None = None
    type_of: str | None = None
    guard: str | tuple[str, ...] | None = None
    prepare: str | None = None


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


_DIGITS = "regexp_replace({t}, '[^0-9]', '')"
# From the right, every second digit is doubled (minus 9 above 9); the sum must end in 0.
_LUHN = _let(
    "d",
    _DIGITS,
    "if(length(d) = 0, true, aggregate(transform(sequence(1, length(d)), i -> cast(substring(d, length(d) - i + 1, 1) as int) "
    "* if(i % 2 = 0, 2, 1)), 0, (acc, v) -> acc + if(v > 9, v - 9, v)) % 10 = 0)",
)


def luhn_valid(text: str) -> Column:
    """Luhn check over the digits of a text column."""
    return F.expr(_LUHN.replace("{t}", text))


def _first(letters: str, pattern: str) -> str:
    """The pattern, tried only where one of the letters (in all their cases) stands: one look at a plain set costs far less than
    trying alternatives that ignore case."""
    return f"(?=(?-i:[{letters}]))(?:{pattern})"


_SECRET_CLASS = "A-Za-z0-9+/_=\u0130\u0131\u017f\u212a-"  # with the letters that only differ from i, s and k by case
_SECRET_SIGNS = "[A-Za-z0-9+/\u0130\u0131\u017f\u212a]{36}|(?iu:AIza|AKIA|xoxb-|[0-9a-f]{8}-[0-9a-f]{4}-)"


def _long_run(least: int, pattern: str) -> str:
    """The pattern of secrets, tried only where so many of their characters follow: no match is shorter or holds others."""
    return f"(?=(?-i:[{_SECRET_CLASS}]{{{least}}}))(?:{pattern})"


_ADDR_END = _first("SARBLDCPsarbldcp\u017f", fixed.FULL_ADDR_END)


def _contains_none(text: str, phrases: Sequence[str]) -> str:
    """One search in place of lower() for every match; the Kelvin sign is the only other character that is lowered to a letter
    of the phrases."""
    anywhere = "|".join(re.escape(p.lower()).replace("k", "[k\u212a]") for p in phrases)
    return f"not ({text} rlike {quoted('(?i)' + anywhere)})"


def _stop_numbers() -> str:
    """A number starts an address only if a street word ends one later in the same run of address characters. Trying
    each number of a long list is quadratic, so numbers that can't be starts get a stop behind them, in one pass: a run is
    cut behind its last street word, and only numbers of its rest, or of runs without one, are stopped."""
    open_run, close_run = "\u0003", "\u0004"
    number = quoted(flagged(r"(?<=\p{Nd})(?=\s)"))
    runs = quoted(flagged(f"({fixed.FULL_ADDR_CLASS}*{_ADDR_END})|({fixed.FULL_ADDR_CLASS}++)", True))
    stopped = lambda t: f"regexp_replace({t}, {number}, '{_STOP}')"
    piece = (
        f"case when i % 2 = 0 then x when startswith(x, '{close_run}') then {stopped('substring(x, 2)')} "
        f"else replace(x, '{close_run}', '') end"
    )
    cut = f"split(regexp_replace(t, {runs}, '{open_run}$1{close_run}$2{open_run}'), '{open_run}', -1)"
    either = f"if(t rlike {quoted(flagged(_ADDR_END, True))}, array_join(transform({cut}, (x, i) -> {piece}), ''), {stopped('t')})"
    return _let("t", f"translate({{t}}, '{open_run}{close_run}{_STOP}', '{_MARK_STAND_IN * 3}')", either)


def _address() -> str:
    """What follows a word of the second form can't begin inside it, so a word is taken whole and not given back."""
    words = (r"[A-Z][a-z]+,?\s+[A-Z]{2}\s+", r"[A-Z][a-z]++,?+\s++[A-Z]{2}\s++")
    assert words[0] in fixed.FULL_ADDR
    return fixed.FULL_ADDR.replace(fixed.FULL_ADDR_END, _ADDR_END).replace(*words)


def _rules_full() -> list[SpanRule]:
    names = ", ".join(quoted(n) for n in fixed.FULL_NAME_STOP_LIST)
    legal = (
        "case when startswith(upper({t}), 'NDA') then 'NDA' when startswith(upper({t}), 'MATTER') then 'MATTER' "
        "when startswith(upper({t}), 'CASE') then 'CASE' else 'LEGAL' end"
    )
    four_digits = r"\p{Nd}{4}"
    return [
        SpanRule("EMAIL", fixed.EMAIL, True, guard="@"),
        SpanRule("PHONE", _first(r"+(\d", fixed.FULL_PHONE), True, keep=f"length({_DIGITS}) >= 7", guard=four_digits),
        SpanRule("PAN", _first(r"\d", fixed.FULL_PAN), True, keep=f"length({_DIGITS}) >= 13 and {_LUHN}", guard=four_digits),
        SpanRule(
            "SSN", _first(r"\d", fixed.FULL_SSN), guard=four_digits,
            keep=f"length({_DIGITS}) = 9 and not startswith({_DIGITS}, '000')",
        ),
        SpanRule(
            "NAME", _first("A-Z", fixed.FULL_NAME), confidence=fixed.FULL_NAME_CONFIDENCE,
            keep="{t} not in (" + names + ") and size(split({t}, " + quoted(r"(?U)\s+") + ")) <= 3",
        ),
        SpanRule("ADDR", _address(), True, fixed.FULL_ADDR_CONFIDENCE, guard=r"\p{Nd}", prepare=_stop_numbers()),
        SpanRule("DBURI", fixed.FULL_DBURI, True, guard=r"(?iu)://|jdbc:|server="),
        SpanRule(
            "SECRET", _long_run(10, fixed.FULL_SECRET), True, fixed.FULL_SECRET_CONFIDENCE,
            keep="length({t}) >= 16 and {t} rlike '[A-Za-z]' and {t} rlike '[0-9]'",
            guard="[A-Za-z0-9+/_=ſK-]{16}",
        ),
        SpanRule("LEGAL", _first("NMCnmc", fixed.FULL_LEGAL), True, type_of=legal),
    ]


def _rules_converter(strict_names: bool = False) -> list[SpanRule]:
    checks = {"PAN": _LUHN, "NAME": _contains_none("{t}", fixed.CONVERTER_NAME_STOP_PHRASES)}
    return [
        SpanRule(kind, pattern, not (strict_names and kind == "NAME"), keep=checks.get(kind))
        for kind, pattern in fixed.CONVERTER
    ]


def _rules_generator() -> list[SpanRule]:
    checks = {"PAN": _LUHN, "NAME": _contains_none("{t}", fixed.GENERATOR_NAME_STOP_PHRASES)}
    types = {"NDA": "if(contains(upper({t}), 'NDA'), 'NDA', 'MATTER')"}
    return [
        SpanRule(kind, pattern, ignore, keep=checks.get(kind), type_of=types.get(kind))
        for kind, pattern, ignore in fixed.GENERATOR
    ]


# What each traditional pattern holds, and the characters it begins with.
_TRADITIONAL_SIGNS = [
    ("@", None), (r"\p{Nd}{3}", r"+(\d"), ("[0-9]{13}", "0-9"), (r"\p{Nd}{4}", r"\d"), ("AKIA", None), ("sk-", None), ("ghp_", None),
    ("://", None), (None, "NM"), (None, "A-Z"),
]


def ruleset(name: str) -> list[SpanRule]:
    """A rule set by name; callers may extend the returned list and pass it to ``detect``."""
    if name == "full":
        return _rules_full()
    if name == "converter":
        return _rules_converter()
    if name == "converter_strict_names":
        return _rules_converter(strict_names=True)
    if name == "semantic":
        return [SpanRule(k, p, True) for k, p in fixed.TRADITIONAL + fixed.SEMANTIC + fixed.EUPHEMISM]
    if name == "traditional":
        return [SpanRule(k, _first(begins, p) if begins else p, guard=holds) for (k, p), (holds, begins) in zip(fixed.TRADITIONAL, _TRADITIONAL_SIGNS, strict=True)]
    if name == "semantic_only":
        return [SpanRule(k, p, True) for k, p in fixed.SEMANTIC]
    if name == "synth":
        return [SpanRule(k, p, ignore) for k, p, ignore in fixed.SYNTH]
    if name == "generator":
        return _rules_generator()
    raise ValueError(f"unknown rule set {name!r}")


def _plain(text: str) -> str:
    """The text without the mark."""
    return f"if(contains({text}, '{_MARK}'), translate({text}, '{_MARK}', '{_MARK_STAND_IN}'), {text})"


def rule_matches(text: str, rule: SpanRule, number: int) -> str:
    """SQL of all kept matches of one rule, as work spans (empty array if none)."""
    pattern = quoted(flagged(rule.pattern, rule.ignore_case))
    plain = _plain(text)
    marked = f"regexp_replace({rule.prepare.replace('{t}', plain) if rule.prepare else plain}, {pattern}, '{_MARK}$0{_MARK}{_MARK}')"
    size = (lambda x: f"length(translate({x}, '{_STOP}', ''))") if rule.prepare else (lambda x: f"length({x})")
    found_type = "struct<start:int,end:int,text:string>"
    # pieces: a gap, the mark and a match each; the last one is a gap only
    match = f"named_struct('start', {{c}}.at + {size(f"substring_index(x, '{_MARK}', 1)")}, 'end', {{c}}.at + {size('x')} - 1, 'text', substring_index(x, '{_MARK}', -1))"
    found = _scan(
        f"split(marked, '{_MARK}{_MARK}', -1)",
        "named_struct('at', 0)",
        f"named_struct('at', {{c}}.at + {size('x')} - 1)",
        f"if(contains(x, '{_MARK}'), array({match}), {_empty(found_type)})",
        found_type,
    )
    found = _let("marked", marked, f"if(contains(marked, '{_MARK}'), {found}, {_empty(found_type)})")
    if rule.keep:
        found = f"filter({found}, m -> {rule.keep.replace('{t}', 'm.text')})"
    kind = (rule.type_of or quoted(rule.type)).replace("{t}", "m.text")
    spans = (
        f"transform({found}, m -> cast(named_struct('start', m.start, 'rule', {number}, 'end', m.end, "
        f"'type', {kind}, 'text', m.text, 'confidence', {rule.confidence}D) as {_WORK_TYPE}))"
    )
    guards = (rule.guard,) if isinstance(rule.guard, str) else rule.guard or ()
    held = " and ".join(f"{text} rlike {quoted(g)}" for g in guards)
    return f"if({held}, {spans}, {_empty(_WORK_TYPE)})" if held else spans


def raw_matches(text: str, rules: Sequence[SpanRule]) -> str:
    """SQL of the matches of every rule by start, then rule order (what a stable sort by start gives)."""
    return "array_sort(concat(" + ", ".join(rule_matches(text, r, i) for i, r in enumerate(rules)) + "))"


# -- overlap rules ----------------------------------------------------------------------------------------------


def _keep_most_confident(spans: str) -> str:
    """A span that overlaps a kept one replaces the first such span if it is more confident, or as confident and
    longer; otherwise it is dropped. Spans that touch form an island; only the current island is searched."""
    rival = "get(filter({c}.live, k -> x.start < k.end and x.end > k.start), 0)"
    better = (
        "x.confidence > rival.confidence or "
        "(x.confidence = rival.confidence and x.end - x.start > rival.end - rival.start)"
    )
    others = "filter({c}.live, k -> not (k.start = rival.start and k.rule = rival.rule))"
    fought = (
        f"case when rival is null then concat({{c}}.live, array(x)) "
        f"when {better} then concat({others}, array(x)) else {{c}}.live end"
    )
    live = f"if(x.start >= {{c}}.reach, array(x), {_let('rival', rival, fought)})"
    return "array_sort(" + _scan(
        spans,
        f"named_struct('live', {_empty(_WORK_TYPE)}, 'reach', 0)",
        f"named_struct('live', {live}, 'reach', greatest({{c}}.reach, x.end))",
        f"if(x.start >= {{c}}.reach, {{c}}.live, {_empty(_WORK_TYPE)})",
        _WORK_TYPE,
        "{c}.live",
    ) + ")"


def _priority(kind: str) -> str:
    cases = " ".join(f"when {quoted(k)} then {v}" for k, v in fixed.TYPE_PRIORITY.items())
    return f"case {kind} {cases} else 0 end"


def _keep_longest(spans: str) -> str:
    """Against the last kept span only: the longer one stays, on equal length the type of higher priority."""
    lengths = "x.end - x.start {op} {c}.last.end - {c}.last.start"
    loses = (
        f"({lengths.replace('{op}', '<')} or ({lengths.replace('{op}', '=')} "
        f"and {_priority('x.type')} <= {_priority('{c}.last.type')}))"
    )
    return _scan(
        spans,
        f"named_struct('last', cast(null as {_WORK_TYPE}))",
        f"named_struct('last', if({{c}}.last is not null and x.start < {{c}}.last.end and {loses}, {{c}}.last, x))",
        f"if({{c}}.last is not null and x.start >= {{c}}.last.end, array({{c}}.last), {_empty(_WORK_TYPE)})",
        _WORK_TYPE,
        "array({c}.last)",
    )


def _keep_first_per_range(spans: str) -> str:
    """One span per (start, end), the first by rule order: equal ranges share a start, so only spans of the
    current start are looked at."""
    fresh = "(size({c}.here) = 0 or get({c}.here, 0).start <> x.start)"
    here = (
        f"case when {fresh} then array(x) when exists({{c}}.here, k -> k.end = x.end) then {{c}}.here "
        "else concat({c}.here, array(x)) end"
    )
    return _scan(
        spans,
        f"named_struct('here', {_empty(_WORK_TYPE)})",
        f"named_struct('here', {here})",
        f"if({fresh}, {{c}}.here, {_empty(_WORK_TYPE)})",
        _WORK_TYPE,
        "{c}.here",
    )


OVERLAP_RULES: dict[str, Callable[[str], str]] = {
    "none": lambda spans: spans,
    "confidence": _keep_most_confident,
    "longest": _keep_longest,
    "distinct": _keep_first_per_range,
}
DEFAULT_OVERLAP = {
    "full": "confidence", "converter": "longest", "converter_strict_names": "longest", "semantic": "none",
    "traditional": "none", "semantic_only": "none", "synth": "none", "generator": "distinct",
}


def _public(work: str) -> str:
    """Work spans in the published shape."""
    fields = ", ".join(f"'{f}', w.{f}" for f in ("type", "start", "end", "text", "confidence"))
    return f"transform({work}, w -> named_struct({fields}))"


def _work(spans: str) -> str:
    """Published spans, in any order, as sorted work spans; array order stands for rule order."""
    return (
        f"array_sort(transform({spans}, (p, i) -> cast(named_struct('start', p.start, 'rule', i, 'end', p.end, "
        f"'type', p.type, 'text', coalesce(p.text, ''), 'confidence', coalesce(p.confidence, 1.0D)) as {_WORK_TYPE})))"
    )


def detect(text: str, rules: Sequence[SpanRule] | str, overlap: str | None = None) -> Column:
    """Spans of a text column by a named or own rule set."""
    if isinstance(rules, str):
        overlap = overlap or DEFAULT_OVERLAP[rules]
        rules = ruleset(rules)
    return F.expr(_public(OVERLAP_RULES[overlap or "none"](raw_matches(text, rules))))


def resolve(spans: str, overlap: str) -> Column:
    """An overlap rule applied to a span column."""
    return F.expr(_public(OVERLAP_RULES[overlap](_work(spans))))


def token_ranges(text: str, pattern: str) -> Column:
    """(start, end) of every match of a pattern, as tokens.

    Tokens are dense, so they aren't gathered piece by piece: each match stands between two marks, and the place of the n-th mark
    less the n marks before it is a place in the text.
    """
    marked = f"regexp_replace({_plain(text)}, {quoted(flagged(pattern))}, '{_MARK}$0{_MARK}')"
    at = f"filter(transform(split(marked, ''), (c, i) -> if(c = '{_MARK}', i, -1)), p -> p >= 0)"
    ranges = (
        "transform(sequence(0, cast(size(at) div 2 as int) - 1), "
        "i -> named_struct('start', get(at, 2 * i) - 2 * i, 'end', get(at, 2 * i + 1) - 2 * i - 1))"
    )
    some = _let("at", at, ranges)
    return F.expr(_let("marked", marked, f"if(contains(marked, '{_MARK}'), {some}, {_empty('struct<start:int,end:int>')})"))


# -- questions about spans --------------------------------------------------------------------------------------


def count_types(spans: Column, types: Sequence[str]) -> Column:
    return F.size(F.filter(spans, lambda s: is_in(s["type"], types)))


def has_type(spans: Column, types: Sequence[str]) -> Column:
    return F.exists(spans, lambda s: is_in(s["type"], types))


def overlap_pairs(spans: str) -> Column:
    """Overlapping pairs (first, second), found by one sweep over the spans sorted by start.

    Only spans still open at the current start are compared, so work follows the number of overlaps and not the
    square of the number of spans.
    """
    pair_type = (
        "struct<first_type:string,first_start:int,first_end:int,second_type:string,second_start:int,second_end:int>"
    )
    still_open = "filter({c}.open, o -> o.end > x.start)"
    pair = (
        "named_struct('first_type', o.type, 'first_start', o.start, 'first_end', o.end, "
        "'second_type', x.type, 'second_start', x.start, 'second_end', x.end)"
    )
    return F.expr(
        _scan(
            _work(spans),
            f"named_struct('open', {_empty(_WORK_TYPE)})",
            f"named_struct('open', concat({still_open}, array(x)))",
            f"transform(filter({still_open}, o -> x.end > o.start), o -> {pair})",
            pair_type,
        )
    )


def rivals(spans: str) -> Column:
    """Per span, by start: how many others overlap it, and the first of them (by start, then array order).

    Counted, not paired, so the result is as long as the spans: of n spans, the rivals of one are the starts before its
    end less the ends up to its start. Both are ranks in the sorted starts and ends. The first rival is the first span whose
    end, or an earlier span's, lies behind the start: a rank of the start in the running maximum of the ends. If that
    is the span itself, only the next span can be one. A span without length takes no part.
    """
    count_type = "struct<i:int,kind:int,n:int>"
    points = lambda a, b: f"array_sort(concat(transform({a}), transform({b})))"
    edges = points(
        "w, (s, i) -> named_struct('at', s.end, 'kind', 0, 'i', i)", "w, (s, i) -> named_struct('at', s.start, 'kind', 1, 'i', i)"
    )  # at one place ends come before starts
    counted = _scan(
        edges,
        "named_struct('starts', 0, 'ends', 0)",
        "named_struct('starts', {c}.starts + x.kind, 'ends', {c}.ends + 1 - x.kind)",
        "array(named_struct('i', x.i, 'kind', x.kind, 'n', if(x.kind = 1, {c}.ends, {c}.starts)))",
        count_type,
    )
    reach = _scan("w", "named_struct('to', 0)", "named_struct('to', greatest({c}.to, x.end))", "array(greatest({c}.to, x.end))", "int")
    placed = points(
        f"{reach}, (p, i) -> named_struct('at', p, 'kind', 0, 'i', i)", "w, (s, i) -> named_struct('at', s.start, 'kind', 1, 'i', i)"
    )
    before = _scan(
        placed, "named_struct('n', 0)", "named_struct('n', {c}.n + 1 - x.kind)", "if(x.kind = 1, array({c}.n), cast(array() as array<int>))", "int"
    )
    first = "case when get(b, i) < i then get(w, get(b, i)) when get(w, i + 1).start < s.end then get(w, i + 1) end"
    row = (
        "named_struct('type', s.type, 'start', s.start, 'end', s.end, 'rivals', get(n, 2 * i).n - get(n, 2 * i + 1).n - 1, "
        "'first_type', f.type, 'first_start', f.start, 'first_end', f.end)"
    )
    rows = f"transform(w, (s, i) -> {_let('f', first, row)})"
    return F.expr(_let("w", f"filter({_work(spans)}, s -> s.start < s.end)", _let("n", f"array_sort({counted})", _let("b", before, rows))))


def valid_bounds(spans: Column, text: Column, offset: Column | int = 0) -> Column:
    """Spans inside the text, moved by an offset (where the text starts in a larger one)."""
    shift = offset if isinstance(offset, Column) else F.lit(offset)
    frame = F.struct(F.length(text).alias("n"), shift.cast("int").alias("by"))

    def moved(f: Column) -> Column:
        inside = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] <= f["n"]) & (s["start"] < s["end"]))
        return F.transform(
            inside, lambda s: s.withField("start", s["start"] + f["by"]).withField("end", s["end"] + f["by"])
        )

    return let(frame, moved)


def boundary_violations(spans: Column, text: Column) -> Column:
    """How many spans do not cover the text they carry."""
    return F.size(F.filter(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]) != s["text"]))


# -- tags -------------------------------------------------------------------------------------------------------


def bio_vocabulary(name: str) -> dict[str, int]:
    """Tag -> id of a named vocabulary."""
    tags = {"O": 0}
    for i, kind in enumerate(fixed.BIO_TYPES[name]):
        tags[f"B-{kind}"] = 2 * i + 1
        tags[f"I-{kind}"] = 2 * i + 2
    return tags


def char_tags(spans: str, text: str) -> Column:
    """One B-/I-/O tag per character, built run by run from spans that do not overlap (as overlap rules return)."""
    last = f"least(x.end, length({text}))"
    fits = f"(x.start >= {{c}}.at and x.start < length({text}))"
    run = (
        "concat(array_repeat('O', x.start - {c}.at), array(concat('B-', x.type)), "
        f"array_repeat(concat('I-', x.type), {last} - x.start - 1))"
    )
    tagged = _scan(
        _work(spans),
        "named_struct('at', 0)",
        f"named_struct('at', if({fits}, {last}, {{c}}.at))",
        f"if({fits}, {run}, cast(array() as array<string>))",
        "string",
        f"array_repeat('O', length({text}) - {{c}}.at)",
    )
    return F.expr(f"if(size({spans}) = 0, array_repeat('O', length({text})), {tagged})")


def _in_order(spans: Column) -> Column:
    """Whether spans are sorted and apart, as overlap rules leave them."""
    return F.forall(
        F.transform(spans, lambda s, i: (s["start"] < s["end"]) & ((i == 0) | (s["start"] >= F.get(spans, i - 1)["end"]))), lambda ok: ok
    )


def _end_before(spans: Column, i: Column, first: Column) -> Column:
    return F.when(i == 0, first).otherwise(F.get(spans, i - 1)["end"])


def _id_of(kind: Column, mark: str, vocabulary: str) -> Column:
    ids = bio_vocabulary(vocabulary)
    cases = None
    for k in fixed.BIO_TYPES[vocabulary]:
        cases = (F if cases is None else cases).when(kind == k, F.lit(ids[f"{mark}-{k}"]))
    return cases.otherwise(0)


def token_tag_ids(tokens: Column, spans: Column, vocabulary: str) -> Column:
    """Tag ids of tokens with (start, end) character ranges: B- on the token holding the first character of a span,
    I- on the rest up to the token holding its last character; a later span overwrites.

    Spans that are sorted and apart are laid out once, as the number of the span at each character; a token looks only at its
    own characters. Other spans are searched for each token.
    """
    known = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), _id_of(s["type"], "B", vocabulary).alias("b"), _id_of(s["type"], "I", vocabulary).alias("i")
        ),
    )

    def tag(last: Column, token: Column) -> Column:
        begins = (last["start"] >= token["start"]) & (last["start"] < token["end"])
        return F.when(last.isNull(), 0).when(begins, last["b"]).otherwise(last["i"])

    def laid_out(own: Column) -> Column:
        runs = F.transform(
            own,
            lambda s, i: F.concat(
                F.array_repeat(F.lit(0), s["start"] - _end_before(own, i, F.lit(0))), F.array_repeat(i + 1, s["end"] - s["start"])
            ),
        )

        def over(owner: Column) -> Column:
            def of_token(token: Column) -> Column:
                last = F.array_max(F.slice(owner, token["start"] + 1, token["end"] - token["start"]))
                return let(F.get(own, last - 1), lambda s: tag(s, token))

            return F.transform(tokens, of_token)

        return let(F.flatten(runs), over)

    def searched(own: Column) -> Column:
        def of_token(token: Column) -> Column:
            hit = F.filter(own, lambda s: (s["start"] < token["end"]) & (s["end"] > token["start"]))
            return let(F.try_element_at(hit, F.lit(-1)), lambda last: tag(last, token))

        return F.transform(tokens, of_token)

    fine = F.forall(tokens, lambda t: (t["start"] >= 0) & (t["end"] > t["start"]))
    first = F.forall(spans, lambda s: s["start"] >= 0)
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, F.transform(tokens, lambda t: F.lit(0))).otherwise(
        let(known, lambda own: F.when(_in_order(own) & first & fine, laid_out(own)).otherwise(searched(own)))
    )


def char_tag_ids(n: Column, start: Column, spans: Column, vocabulary: str) -> Column:
    """Tag ids of the n characters from ``start`` on; a span that began before goes on with I-, a later one overwrites.

    Sorted spans that are apart are written run by run; others fall back to one token per character.
    """
    stop = start + n
    inside = F.filter(spans, lambda s: (s["start"] < stop) & (s["end"] > start))

    def runs(own: Column) -> Column:
        def run(s: Column, i: Column) -> Column:
            first, last = F.greatest(s["start"], start), F.least(s["end"], stop)
            gap = F.array_repeat(F.lit(0), first - _end_before(own, i, start))
            b = _id_of(s["type"], "B", vocabulary)
            rest = _id_of(s["type"], "I", vocabulary)
            head = F.array_repeat(F.when(s["start"] >= start, b).otherwise(rest), F.lit(1))
            return F.concat(gap, head, F.array_repeat(rest, last - first - 1))

        end = F.least(F.coalesce(F.try_element_at(own, F.lit(-1))["end"], start), stop)
        return F.concat(F.flatten(F.transform(own, run)), F.array_repeat(F.lit(0), stop - end))

    each = F.when(n > 0, F.transform(F.sequence(start, stop - 1), lambda i: F.struct(i.alias("start"), (i + 1).alias("end")))).otherwise(
        F.array().cast("array<struct<start:int,end:int>>")
    )
    return F.when((n <= 0) | (F.coalesce(F.size(spans), F.lit(0)) <= 0), F.array_repeat(F.lit(0), n)).otherwise(
        let(inside, lambda own: F.when(_in_order(own), runs(own)).otherwise(token_tag_ids(each, own, vocabulary)))
    )


def tag_entities(tags: str, vocabulary: str) -> Column:
    """(type, first, last) of a tag-id array, given by name. B- opens; I- of the same type extends; I- of another type closes
    and opens; I- with nothing open and everything else is outside."""
    entity = "struct<type:string,first:int,last:int>"
    nothing = f"cast(named_struct('type', null, 'first', -1, 'last', -1) as {entity})"
    kinds = "array(" + ", ".join(quoted(k) for k in fixed.BIO_TYPES[vocabulary]) + ")"
    marked = (  # O only separates: a gap in places shows it
        f"filter(transform({tags}, (t, i) -> named_struct('i', i, 'inside', t % 2 = 0, 'type', if(t > 0, try_element_at({kinds}, cast((t + 1) div 2 as int)), null))), "
        "x -> x.type is not null)"
    )
    touching = "({c}.type is not null and {c}.last = x.i - 1)"
    extends = f"(x.inside and {touching} and {{c}}.type = x.type)"
    grown = "named_struct('type', {c}.type, 'first', {c}.first, 'last', x.i)"
    fresh = "named_struct('type', x.type, 'first', x.i, 'last', x.i)"
    return F.expr(
        _scan(
            marked,
            nothing,
            f"cast(case when {extends} then {grown} when not x.inside or {touching} then {fresh} else {nothing} end as {entity})",
            f"if({{c}}.type is not null and not {extends}, array({{c}}), {_empty(entity)})",
            entity,
            f"if({{c}}.type is not null, array({{c}}), {_empty(entity)})",
        )
    )
