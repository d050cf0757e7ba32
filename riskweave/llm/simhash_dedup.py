"""Near-duplicates by SimHash and pivot distance tables (operator 4).

``fingerprints``: words are lower-cased (A-Z) runs of non-blanks; every ``shingle`` of words, repeats included, is hashed
by XXH64 (seed 42); a bit of the fingerprint is 1 if it is set in over half the hashes.

``close_fingerprints`` links fingerprints at ``RADIUS`` (2) or fewer differing bits:

1. Equal fingerprints are one node from here on, so copies are never compared.
2. The 64 bits are split into 5 blocks. Two fingerprints that differ in at most 2 bits agree on some 3 whole blocks.
3. Pivot distance table: Hamming distances of every fingerprint to ``PIVOTS`` fixed pseudo-random reference
   fingerprints, split by block. On blocks where two fingerprints agree, all their distances agree, so the vector of
   distances over 3 blocks is a join key: every pair to be linked shares one of the 10 keys.
4. Pairs that share a key are discarded by the maximum coordinate difference (by the triangle inequality, distances to
   a pivot differ by at most the distance of the pair), and survivors are verified by their differing bits.
5. A key shared by more than ``CROWD`` fingerprints would give all pairs of its group. Its fingerprints are linked
   exactly and linearly instead: two fingerprints are within 2 bits if and only if some value is within 1 bit of both, so
   each emits its 65 values within 1 bit, and the owners of one value (65 at most) are tied to their smallest.

Groups are the connected components. Nothing is capped: step 5 handles exactly what step 4 leaves out.

``near_copies`` finds texts of word-shingle similarity .8 or more, which lie 3 to 16 bits apart, where no key of a pivot
table over 64 bits is selective any more. There, MinHash bands give the candidates, 128-bit SimHash distance discards,
and the exact Jaccard similarity of the shingle sets decides (see its text).

Defined results: a null or empty text has fingerprint 0 and is linked like any other; rows of one id stay separate
rows; a null id stays null and counts for no smallest id (a group of null ids only has component null).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.components import components
from riskweave.llm.tables import pieces
from riskweave.llm.words import join_words, split_words
from riskweave.session import reliable_checkpoint

RADIUS = 2
PIVOTS = 24
CROWD = 48
SEED = 42
_BLOCKS = (13, 13, 13, 13, 12)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks() -> list[int]:
    masks, at = [], 0
    for n in _BLOCKS:
        masks.append(((1 << n) - 1) << at)
        at += n
    return masks


def pivots() -> list[int]:
    return [xxhash.xxh64_intdigest(f"pivot {i}", 7) for i in range(PIVOTS)]


def text_fingerprints(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """64-bit fingerprint of each row."""
    words = split_words(column, lower=True)
    n = len(words.bounds) - 1
    out = np.zeros(n, np.uint64)
    text, begin, end, _ = join_words(words)  # a shingle is then one slice
    digest = xxhash.xxh64_intdigest
    begins, ends, bounds = begin.tolist(), end.tolist(), words.bounds.tolist()
    hashes, counts = [], np.zeros(n, np.int64)
    for row in range(n):
        a, b = bounds[row], bounds[row + 1]
        if a == b:
            continue
        if b - a <= shingle:
            hashes.append(digest(text[begins[a] : ends[b - 1]], SEED))
            counts[row] = 1
        else:
            hashes += [digest(text[s:e], SEED) for s, e in zip(begins[a : b - shingle + 1], ends[a + shingle - 1 : b], strict=True)]
            counts[row] = b - a - shingle + 1
    full = np.flatnonzero(counts)
    if len(full):
        first = np.concatenate([[0], np.cumsum(counts[full])])
        all_hashes = np.array(hashes, dtype=">u8")
        for s in range(0, len(full), 256):  # bits of some texts at a time
            rows = full[s : s + 256]
            a, b = first[s], first[min(s + 256, len(full))]
            bits = np.unpackbits(all_hashes[a:b].view(np.uint8)).reshape(-1, 64)
            ones = np.add.reduceat(bits, first[s : s + len(rows)] - a, axis=0, dtype=np.int32)
            packed = np.packbits(2 * ones > counts[rows][:, None], axis=1)
            out[rows] = packed.view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long) of every row."""

    def made(batches):
        for piece in pieces(batches):
            fp = text_fingerprints(piece.column("text"), shingle)
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "fp": pa.array(fp.view(np.int64))})

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(made, "doc_id long, fp long")


def _within_one_bit(fp: Column) -> Column:
    return F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])


def pivot_distances(fp: Column) -> list[Column]:
    """Per block, the distances to every pivot over the bits of that block, as an array."""
    references = F.array(*[F.lit(_signed(p)) for p in pivots()])
    return [
        F.transform(references, lambda p: F.bit_count(fp.bitwiseXOR(p).bitwiseAND(F.lit(_signed(m))))).alias(f"block_{i}")
        for i, m in enumerate(block_masks())
    ]


def pivot_keys() -> Column:
    """The 10 keys: which blocks, and a hash of the distances to all pivots over these blocks."""
    n = len(_BLOCKS)
    return F.array(*[
        F.struct(F.lit(i).alias("blocks"), F.xxhash64(*[f"block_{b}" for b in some]).alias("key"))
        for i, some in enumerate(combinations(range(n), n - RADIUS))
    ])


def full_distances() -> Column:
    """Distances to the pivots: the sums over the blocks."""
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    return reduce(add, [F.col(f"block_{i}") for i in range(len(_BLOCKS))])


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within ``RADIUS`` bits. nodes: distinct fp."""
    table = reliable_checkpoint(nodes.select("fp", *pivot_distances(F.col("fp"))))
    keyed = table.select("fp", F.explode(pivot_keys()).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("blocks", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = reliable_checkpoint(keyed.join(sizes, ["blocks", "key"]))
    to_pivots = table.select("fp", full_distances().alias("to_pivots"))
    few = shared.filter(F.col("n") <= CROWD).select("blocks", "key", "fp").join(to_pivots, "fp")
    few = reliable_checkpoint(few)
    others = few.select("blocks", "key", F.col("fp").alias("other"), F.col("to_pivots").alias("other_to_pivots"))
    spread = F.array_max(F.zip_with("to_pivots", "other_to_pivots", lambda x, y: F.abs(x - y)))
    near = (
        few.join(others, ["blocks", "key"])
        .filter("fp < other")
        .filter(spread <= RADIUS)  # the pivot table discards
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS)  # exact
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    crowded = shared.filter(F.col("n") > CROWD).select("fp").distinct()
    values = crowded.select("fp", F.explode(_within_one_bit(F.col("fp"))).alias("value"))
    stars = values.groupBy("value").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    ties = values.join(stars, "value").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return near.unionByName(ties).distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the group) of every row."""
    prints = reliable_checkpoint(fingerprints(docs, shingle, doc_id, text))
    nodes = reliable_checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    groups = components(close_fingerprints(nodes.select("fp")))
    rooted = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = reliable_checkpoint(rooted)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
