"""Markup of a message, token ids and packed training rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.fixed import labels as labels_fixed
from riskweave.fixed import span_patterns as spans_fixed
from riskweave.functions.spans import char_tag_ids, valid_bounds

# Ids of the character tokenizer.
PAD, UNKNOWN, BEGIN, END = 0, 1, 2, 3
FIRST_CHARACTER, FIRST_CHARACTER_ID, LAST_CHARACTER = 32, 4, 126
BYTE_SHIFT = 2
VOCABULARY_SIZE = 16000


def _attributes(pairs: list[tuple[str, Column]]) -> Column:
    """'name=value' of the present values, blank-separated."""
    return F.concat_ws(" ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{n}="), v.cast("string"))) for n, v in pairs])


def _head(channel: Column, user: Column, recipients: Column, thread: Column, subject: Column) -> Column:
    """Everything before the body text."""
    recipient_line = F.when(
        F.size(recipients) > 0,
        F.concat(
            F.lit("<RECIPIENT primary="), F.get(recipients, F.lit(0)), F.lit(" all=["), F.array_join(recipients, ","), F.lit("]>\n")
        ),
    ).otherwise(F.lit("<RECIPIENT>\n"))
    return F.concat(
        F.lit("<CHANNEL "), F.coalesce(channel, F.lit("email")), F.lit(">\n<USER "),
        _attributes([(k, user[k]) for k in ("role", "dept", "seniority")]),
        F.lit(">\n"), recipient_line, F.lit("<THREAD "),
        _attributes([(k, thread[k]) for k in ("id_hash", "age_days", "prior_msgs")]),
        F.lit(">\n<SUBJECT>"), F.coalesce(subject, F.lit("")), F.lit("</SUBJECT>\n<BODY>"),
    )


def _tail(attachments: Column, links: Column, meta: Column) -> Column:
    files = F.transform(
        F.coalesce(attachments, F.array()),
        lambda a: F.concat(
            F.coalesce(a["name"], F.lit("")), F.lit("|"),
            F.greatest(F.floor(F.coalesce(a["size"].cast("bigint"), F.lit(0)) / 1024), F.lit(0)).cast("string"),
            F.lit("KB;"), F.coalesce(a["mime"], F.lit("")),
        ),
    )
    marks = _attributes([(k, F.element_at(meta, k)) for k in ("base64", "homoglyph", "ts")])
    return F.concat(
        F.lit("</BODY>\n<ATTACHMENTS>"), F.array_join(files, ","), F.lit("</ATTACHMENTS>\n<LINKS>"),
        F.array_join(F.coalesce(links, F.array().cast("array<string>")), ","), F.lit("</LINKS>\n<META "), marks, F.lit(">\n"),
    )


def serialize(
    channel: Column, user: Column, recipients: Column, thread: Column, subject: Column, body: Column,
    attachments: Column, links: Column, meta: Column, spans: Column | None = None,
) -> Column:
    """struct<text, body_start, body_end, spans>: sections in fixed order, spans moved to offsets in the markup."""
    head = _head(channel, user, recipients, thread, subject)
    text = F.coalesce(body, F.lit(""))
    start = F.length(head)
    moved = valid_bounds(spans, text, start) if spans is not None else None
    fields = [
        F.concat(head, text, _tail(attachments, links, meta)).alias("text"),
        start.alias("body_start"),
        (start + F.length(text)).alias("body_end"),
    ]
    return F.struct(*fields, *([moved.alias("spans")] if moved is not None else []))


def link_texts(links: Column) -> Column:
    """Links held as a variant, in any of four shapes, as an array of strings.

    A list gives its strings and 'url|label' of its objects; an object gives 'value|key' of its text values and the
    bare value of others; any other value gives its text; null gives nothing.
    """
    as_objects = F.try_variant_get(links, "$", "array<variant>")
    from_list = F.transform(
        as_objects,
        lambda v: F.when(
            F.schema_of_variant(v).startswith("OBJECT"),
            F.concat_ws(
                "|",
                F.coalesce(F.try_variant_get(v, "$.url", "string"), F.lit("")),
                F.when(F.try_variant_get(v, "$.label", "string") != "", F.try_variant_get(v, "$.label", "string")),
            ),
        ).otherwise(F.try_variant_get(v, "$", "string")),
    )
    as_map = F.try_variant_get(links, "$", "map<string,variant>")
    from_object = F.transform(
        F.map_entries(as_map),
        lambda e: F.when(
            F.schema_of_variant(e["value"]) == "STRING",
            F.concat_ws("|", F.try_variant_get(e["value"], "$", "string"), e["key"]),
        ).otherwise(F.to_json(e["value"])),
    )
    kind = F.schema_of_variant(links)
    nothing = F.array().cast("array<string>")
    return (
        F.when(links.isNull() | (kind == "VOID"), nothing)
        .when(kind.startswith("ARRAY"), F.filter(from_list, lambda x: x.isNotNull()))
        .when(kind.startswith("OBJECT"), from_object)
        .otherwise(F.array(F.try_variant_get(links, "$", "string")))
    )


# -- token ids --------------------------------------------------------------------------------------------------


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def byte_values(text: Column) -> Column:
    """UTF-8 bytes as numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def encode_chars(text: Column, max_length: int | None = None) -> Column:
    """Begin id, one id per character (1 if not printable ASCII), end id; cut keeping the end id, or padded."""

    def char_id(c: Column) -> Column:
        code = F.ascii(c)
        known = (code >= FIRST_CHARACTER) & (code <= LAST_CHARACTER)
        return F.when(known, code - FIRST_CHARACTER + FIRST_CHARACTER_ID).otherwise(UNKNOWN)

    if max_length is None:
        return F.concat(F.array(F.lit(BEGIN)), F.transform(characters(text), char_id), F.array(F.lit(END)))
    ids = F.transform(characters(F.left(text, F.lit(max_length))), char_id)
    full = F.concat(F.array(F.lit(BEGIN)), ids, F.array(F.lit(END)))
    return F.when(
        F.length(text) + 2 > max_length, F.concat(F.slice(full, 1, max_length - 1), F.array(F.lit(END)))
    ).otherwise(F.concat(full, F.array_repeat(F.lit(PAD), F.lit(max_length) - F.length(text) - 2)))


def encode_bytes(text: Column, vocabulary_size: int = VOCABULARY_SIZE) -> Column:
    return F.transform(byte_values(text), lambda b: F.least(b + BYTE_SHIFT, F.lit(vocabulary_size - 1)))


def _fit(values: Column, length: int, filler: int) -> Column:
    cut = F.slice(values, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(filler), F.lit(length) - F.size(cut)))


def pack(markup: Column, labels: Column, max_length: int = 1024, vocabulary: str = "training") -> Column:
    """The first window only: characters behind ``max_length`` and their tags are cut (see ``windows``)."""
    return pack_window(
        F.left(markup["text"], F.lit(max_length)), F.lit(0), markup["spans"], labels, max_length, vocabulary
    )


def windows(markup: Column, max_length: int) -> Column:
    """Array of (window_no, text, spans): consecutive windows of ``max_length`` characters of the whole markup, each
    with the spans that reach into it, in offsets of the markup. An empty text has one empty window."""
    parts = F.regexp_extract_all(markup["text"], F.lit(f"(?s).{{1,{max_length}}}"), F.lit(0))

    def window(part: Column, no: Column) -> Column:
        start = no * max_length
        inside = F.filter(markup["spans"], lambda s: (s["start"] < start + max_length) & (s["end"] > start))
        return F.struct(no.alias("window_no"), part.alias("text"), inside.alias("spans"))

    return F.transform(F.when(markup["text"] == "", F.array(F.lit(""))).otherwise(parts), window)


def pack_window(
    text: Column, start: Column, spans: Column, labels: Column, max_length: int, vocabulary: str
) -> Column:
    """struct<input_ids, attention_mask, bio_labels, doc_labels> with one token per character of a window of the markup.

    The window's text begins at ``start``; a span that began before it goes on with I-. Padded tags are -100.
    """
    n = F.length(text).cast("int")
    ids = F.transform(
        characters(text),
        lambda c: F.when(F.ascii(c).between(FIRST_CHARACTER, LAST_CHARACTER), F.ascii(c) - FIRST_CHARACTER + FIRST_CHARACTER_ID).otherwise(UNKNOWN),
    )
    tags = char_tag_ids(n, start.cast("int"), spans, vocabulary)
    return F.struct(
        _fit(ids, max_length, PAD).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n)).alias("attention_mask"),
        _fit(tags, max_length, spans_fixed.IGNORE_ID).alias("bio_labels"),
        F.array(*[F.coalesce(labels[h].cast("double"), F.lit(0.0)) for h in labels_fixed.HEADS]).alias("doc_labels"),
    )
