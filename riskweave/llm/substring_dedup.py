"""Passages of ``WINDOW`` (50) words that repeat across documents, by prefix-partitioned suffix trees (operator 9).

A window is 50 consecutive words (runs of non-blanks, unchanged) of one document. Each word is removed that lies in a
window whose word sequence also starts in a document with a smaller id. Windows are judged on the input.

1. Documents with the same words are one: only the one with the smallest id goes on, all others consist of repeats
   (if they have a window at all). So groups of copies cost a narrow aggregate.
2. A repeat holds the same minimiser (the 8-word gram with the smallest hash) at the same place. Minimisers, 5 % of the
   positions, that occur in one content only are dropped by an aggregate; a suffix (window start) goes on only if its
   minimiser is left. This loses nothing, and text without repeats ends here.
3. The remaining suffixes are grouped by a variable-length prefix: first by hash buckets of their first 10 words; a
   bucket of more than ``MEMORY_ROWS`` suffixes is split by the first 30 words, one that is still too large by all 50.
   The number of buckets follows the number of suffixes.
4. A task sorts the suffixes of its buckets by their symbols (10, 20 and 20 words: the edges of the tree) and walks the
   subtree: neighbours that agree on all three lie below one internal node of depth 50 or more, a repeat. The first
   leaf of the node has the smallest id; the leaves of all other documents are repeated window starts. A bucket that is
   too large even at 50 words is such a node by itself and needs no tree: its smallest id comes from a partial
   aggregate, so a passage in a third of all documents is never gathered in one place.
5. Window starts return to their documents, where overlapping repeats merge to maximal ones, and the rest is hashed.

Symbols are 64-bit hashes of word hashes; a node agrees in 192 bits.

Texts travel once, and only those with suffixes left are written (``checkpoint``) for steps 3 to 5. Defined results: a
null text has no words; a null id is smaller than none and larger than none, so its words stay and repeat nowhere;
rows of one id are judged one by one; texts of under 50 words stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.tables import pieces
from riskweave.llm.words import Words, join_words, shingle_hashes, shingle_starts, split_words
from riskweave.session import reliable_checkpoint

WINDOW = 50
GRAM = 8
EDGES = (10, 20, 20)  # words of the edges of a path to depth 50
MEMORY_ROWS = 500_000
_LOW = (1 << 32) - 1


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every i the leftmost place of the smallest of values[i : i + width]."""
    n = len(values) - width + 1
    place, reach = np.arange(len(values)), 1
    while 2 * reach <= width:
        left, right = place[: len(place) - reach], place[reach:]
        place = np.where(values[left] <= values[right], left, right)
        reach *= 2
    if reach < width:
        left, right = place[:n], place[width - reach : width - reach + n]
        place = np.where(values[left] <= values[right], left, right)
    return place[:n]


def minimisers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their rows, the place of each window's minimiser, and the hashes of all grams."""
    starts, rows = shingle_starts(words.bounds, WINDOW)
    grams = shingle_hashes(words.hash, GRAM)
    if not len(starts):
        return starts, rows, starts, grams
    return starts, rows, _least_places(grams, WINDOW - GRAM + 1)[starts], grams


def row_digests(words: Words, keep: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
    """Hex SHA-256 of each row's (kept) words one space apart, and their number."""
    text, begin, end, bounds = join_words(words, keep)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(hashlib.sha256(text[begin[a] : end[b - 1]] if b > a else b"").hexdigest())
    return out, np.diff(bounds)


_PROFILE = "doc_id long, th long, n_words long, sha string, content long, anchors array<struct<at: int, h: long>>"
_ANCHORS = pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64())]))


def _profiles(batches):
    """Words, digest and distinct minimisers of every text."""
    for piece in pieces(batches):
        words = split_words(piece.column("text"))
        digests, counts = row_digests(words)
        _, rows, place, grams = minimisers(words)
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]  # a minimiser's windows follow each other
        place, rows = place[new], rows[new]
        offsets = np.searchsorted(rows, np.arange(piece.num_rows + 1)).astype(np.int32)
        found = pa.StructArray.from_arrays(
            [pa.array((place - words.bounds[rows]).astype(np.int32)), pa.array(grams[place].view(np.int64))], names=["at", "h"]
        )
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"), piece.column("th"), pa.array(counts.astype(np.int64)), pa.array(digests),
                pa.array([int(d[:15], 16) for d in digests], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), found, type=_ANCHORS),
            ],
            names=["doc_id", "th", "n_words", "sha", "content", "anchors"],
        )


def _suffixes(batches):
    """Symbols of the window starts whose minimiser is among ``places``; spot: the start and 32 bits of the text's hash,
    which tell texts of one id apart."""
    for piece in pieces(batches):
        words = split_words(piece.column("text"))
        starts, rows, place, _ = minimisers(words)
        known = piece.column("places")
        flat = np.asarray(known.flatten(), dtype=np.int64)
        owner = np.repeat(np.arange(piece.num_rows), np.asarray(known.value_lengths().fill_null(0), dtype=np.int64))
        mine = np.isin(place, flat + words.bounds[owner])
        at, row = starts[mine], rows[mine]
        edges = {n: shingle_hashes(words.hash, n) for n in set(EDGES)}
        symbols = [edges[n][at + sum(EDGES[:i])].view(np.int64) for i, n in enumerate(EDGES)]
        take = pa.array(row)
        yield pa.RecordBatch.from_pydict({
            "d1": pa.array(symbols[0]), "d2": pa.array(symbols[1]), "d3": pa.array(symbols[2]), "doc_id": piece.column("doc_id").take(take),
            "spot": pa.array(((at - words.bounds[row]) << 32) | (np.asarray(piece.column("th"))[row] & _LOW)),
        })


def walk_subtrees(batches):
    """Suffixes sorted by symbols and id: the leaves below nodes of full depth, but those of the smallest id.

    Only the node that the walk is in is kept, so a subtree of any size passes.
    """
    node, lowest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        symbols = np.stack([np.asarray(batch.column(c)) for c in ("d1", "d2", "d3")], axis=1)
        ids = np.asarray(batch.column("doc_id"))
        new = np.ones(batch.num_rows, bool)  # leaves with which a node of full depth begins
        new[1:] = (symbols[1:] != symbols[:-1]).any(axis=1)
        new[0] = node is None or (symbols[0] != node).any()
        head = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), -1))
        low = np.where(head >= 0, ids[head], lowest if lowest is not None else 0)
        yield batch.filter(pa.array(ids > low)).select(["doc_id", "spot"])
        node, lowest = symbols[-1], int(low[-1])


def _removed(batches):
    """Digest of what is left of each text when the windows at ``starts`` go."""
    for piece in pieces(batches):
        words = split_words(piece.column("text"))
        starts = piece.column("starts")
        owner = np.repeat(np.arange(piece.num_rows), np.asarray(starts.value_lengths().fill_null(0), dtype=np.int64))
        at = np.asarray(starts.flatten(), dtype=np.int64) + words.bounds[owner]
        cover = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        digests, kept = row_digests(words, np.cumsum(cover)[:-1] == 0)
        yield pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id"), "th": piece.column("th"), "left": pa.array(kept.astype(np.int64)),
            "left_sha": pa.array(digests),
        })


def _bucket(columns: list[str], n: int):
    return F.pmod(F.xxhash64(*columns), F.lit(n))


def repeated_starts(suffixes: DataFrame, rows: int, memory_rows: int = MEMORY_ROWS) -> DataFrame:
    """doc_id and spot of the window starts that a smaller id has too. rows: about the number of suffixes."""
    n = max(64, -(-4 * rows // memory_rows))
    rest, found = suffixes, None
    for prefix in (["d1"], ["d1", "d2"]):
        sizes = rest.groupBy(_bucket(prefix, n).alias("bucket")).agg(F.count(F.lit(1)).alias("size"))
        large = reliable_checkpoint(sizes.filter(F.col("size") > memory_rows).select("bucket"))
        split = not large.isEmpty()
        small = rest.join(large, _bucket(prefix, n) == F.col("bucket"), "left_anti") if split else rest
        trees = small.repartition(_bucket(prefix, n)).sortWithinPartitions("d1", "d2", "d3", "doc_id")
        walked = trees.mapInArrow(walk_subtrees, "doc_id long, spot long")
        found = walked if found is None else found.unionByName(walked)
        if not split:
            return found
        rest = rest.join(large, _bucket(prefix, n) == F.col("bucket"), "left_semi")
    # nodes too large to gather: only the smallest id of each is needed
    nodes = reliable_checkpoint(rest.groupBy("d1", "d2", "d3").agg(F.min("doc_id").alias("lowest")))
    return found.unionByName(rest.join(nodes, ["d1", "d2", "d3"]).filter("doc_id > lowest").select("doc_id", "spot"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memory_rows: int = MEMORY_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (see the module text)."""
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).select("doc_id", "text", F.xxhash64("text").alias("th"))
    profile = reliable_checkpoint(source.mapInArrow(_profiles, _PROFILE))
    known = profile.filter((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    firsts = reliable_checkpoint(known.groupBy("sha").agg(F.min("doc_id").alias("first")))

    # A gram is shared if two different contents hold it: copies of one text don't count.
    grams = known.select("content", F.explode("anchors.h").alias("h")).groupBy("h")
    shared = grams.agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low < high").select("h")
    shared = reliable_checkpoint(shared)
    # One number stands for id and text here; should two documents share it, both just get more places to look at.
    key = F.xxhash64("doc_id", "th").alias("key")
    anchors = known.select(key, F.explode("anchors").alias("x")).select("key", "x.at", "x.h")
    places = anchors.join(shared, "h", "left_semi").groupBy("key").agg(F.collect_list("at").alias("places"))
    # of each content only the document with the smallest id goes on
    owners = known.select("doc_id", "th", "sha").distinct().join(firsts, "sha").filter("doc_id = first").select("doc_id", "th", key)
    places = reliable_checkpoint(places.join(owners, "key").drop("key"))
    texts = reliable_checkpoint(source.join(places, ["doc_id", "th"]))

    rows = (places.agg(F.sum(F.size("places"))).first()[0] or 0) * (WINDOW - GRAM + 2) // 2
    suffixes = texts.mapInArrow(_suffixes, "d1 long, d2 long, d3 long, doc_id long, spot long")
    spots = repeated_starts(suffixes, rows, memory_rows)
    starts = spots.groupBy("doc_id", F.col("spot").bitwiseAND(F.lit(_LOW)).alias("low")).agg(
        F.collect_list(F.shiftright("spot", 32).cast("int")).alias("starts")
    )
    marked = texts.drop("places").withColumn("low", F.col("th").bitwiseAND(F.lit(_LOW)))
    left = marked.join(starts, ["doc_id", "low"]).select("doc_id", "text", "th", "starts").mapInArrow(
        _removed, "doc_id long, th long, left long, left_sha string"
    )
    left = left.dropDuplicates(["doc_id", "th"])  # repeated rows are alike
    empty = F.sha2(F.lit(""), 256)
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    joined = profile.drop("anchors", "content").join(firsts, "sha", "left").join(left, ["doc_id", "th"], "left")
    return joined.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_words") - F.coalesce("left", "n_words")).alias("n_removed"),
        F.when(copy, empty).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )
