"""Benchmark passages inside documents (operator 1).

Every item of L words is compared with all L-word windows of every text (the whole text, if it is shorter):

1. A window and an item can only be similar if they share a five-word shingle, so windows without any shingle of an
   item of their length are skipped; this loses nothing and keeps the next steps off nearly all text.
2. Each window gets a 128-bit SimHash of its shingles, weighted by rarity among the items (the items have theirs).
3. A multi-index finds all items within ``RADIUS`` bits: 16 blocks of 8 bits; of 31 differing bits at most one falls
   into some block, so an index of each block's values with all one-bit changes returns every such item.
4. Exact weighted Jaccard similarity of the two shingle multisets decides.

At similarity .8 fingerprints differ in 19.4 bits on average (standard deviation 4.1), so 31 bits leave out about .2 %
of the pairs that lie exactly on the limit and next to none above .85.

The items are the stated query set: they are taken in blocks of bounded size (``block_bytes``), each broadcast and
compared with all documents in one scan without a shuffle. Cost per text is linear in its words.

Words are lower-cased runs of letters, digits and non-ASCII characters. Defined results: a null or empty text has no
windows; items of under five words (null ones too) have no shingle and take no part; repeated rows are judged one by
one; other columns, whatever their names, are passed by.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.tables import pieces
from riskweave.llm.words import MARKS, mix, shingle_hashes, shingle_starts, split_words

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
BLOCKS = 16
RADIUS = 31
_GATE_BITS = 22
_STEP = 1024  # windows fingerprinted at once

LEAK_SCHEMA = "doc_id long, item_id long, start_word int, n_words int, differing_bits int, similarity double"


@dataclass
class ItemIndex:
    """The items of one block, ready for comparison."""

    ids: list[int | None]
    lengths: np.ndarray  # words
    shingles: list[Counter]
    prints: np.ndarray  # items x 16 bytes
    gate: np.ndarray
    gate_hash: np.ndarray  # sorted shingle hashes with the items that hold them
    gate_item: np.ndarray
    rarity_hash: np.ndarray
    rarity: np.ndarray
    unseen: float
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # items, pointers, members of the multi-index

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.rarity_hash, hashes), len(self.rarity_hash) - 1)
        return np.where(self.rarity_hash[at] == hashes, self.rarity[at], self.unseen).astype(np.float32)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """128 bits of each shingle as +1 and -1."""
    both = np.stack([hashes, mix(hashes ^ np.uint64(0xA5A5A5A5DEADBEEF))], axis=-1)
    bits = np.unpackbits(both.view(np.uint8).reshape(*hashes.shape, 16), axis=-1)
    return bits.astype(np.float32) * 2 - 1


def fingerprints(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SimHash (16 bytes) of each row of a rows x shingles matrix."""
    sums = np.einsum("rs,rsb->rb", weights, _signs(hashes))
    return np.packbits(sums > 0, axis=1)


def _one_bit_changes() -> np.ndarray:
    return np.array([[v] + [v ^ (1 << b) for b in range(8)] for v in range(256)], dtype=np.int64)


def build_index(ids: list, texts: list) -> ItemIndex | None:
    """Index of the given items; None if none has five words."""
    words = split_words(pc.utf8_lower(pa.array(texts, pa.string())), MARKS)
    keep, shingles = [], []
    for i, (a, b) in enumerate(pairwise(words.bounds.tolist())):
        if b - a >= SHINGLE:
            keep.append(i)
            shingles.append(shingle_hashes(words.hash[a:b], SHINGLE))
    if not keep:
        return None
    lengths = np.diff(words.bounds)[keep]
    all_hash = np.concatenate(shingles)
    owner = np.repeat(np.arange(len(keep)), [len(s) for s in shingles])
    pairs = np.unique(np.stack([all_hash, owner.astype(np.uint64)], axis=1), axis=0)
    known, spread = np.unique(pairs[:, 0], return_counts=True)
    index = ItemIndex(
        ids=[ids[i] for i in keep], lengths=lengths, shingles=[Counter(s.tolist()) for s in shingles],
        prints=np.zeros((len(keep), BITS // 8), np.uint8), gate=np.zeros(1 << _GATE_BITS, bool),
        gate_hash=pairs[:, 0], gate_item=pairs[:, 1].astype(np.int64), rarity_hash=known,
        rarity=np.log1p(len(keep) / spread), unseen=float(np.log1p(len(keep))), by_length={},
    )
    index.gate[(known >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True
    for i, s in enumerate(shingles):
        index.prints[i] = fingerprints(s[None, :], index.weights(s)[None, :])[0]
    near = _one_bit_changes()
    for length in np.unique(lengths).tolist():
        members = np.flatnonzero(lengths == length)
        keys = (near[index.prints[members]] + 256 * np.arange(BLOCKS)[None, :, None]).reshape(len(members), -1)
        flat, item = keys.ravel(), np.repeat(members, keys.shape[1])
        order = np.argsort(flat, kind="stable")
        pointers = np.searchsorted(flat[order], np.arange(BLOCKS * 256 + 1))
        index.by_length[length] = (members, pointers, item[order])
    return index


def _spans(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the stretches [start, start + count), and which stretch each is of."""
    which = np.repeat(np.arange(len(starts)), counts)
    return starts[which] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts), which


def within_radius(index: ItemIndex, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(print, item, differing bits) for all items of a length within ``RADIUS`` of the given fingerprints."""
    _, pointers, members = index.by_length[length]
    found = []
    for block in range(BLOCKS):
        key = prints[:, block].astype(np.int64) + 256 * block
        at, which = _spans(pointers[key], pointers[key + 1] - pointers[key])
        found.append(which * len(index.ids) + members[at])
    code = np.unique(np.concatenate(found))
    which, item = code // len(index.ids), code % len(index.ids)
    distance = np.bitwise_count(prints[which] ^ index.prints[item]).sum(axis=1)
    near = distance <= RADIUS
    return which[near], item[near], distance[near]


def weighted_similarity(index: ItemIndex, item: int, window: Counter, weight: dict) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    low = high = 0.0
    own = index.shingles[item]
    for s, n in own.items():
        m = window.get(s, 0)
        low += weight[s] * min(n, m)
        high += weight[s] * max(n, m)
    return low / (high + sum(weight[s] * n for s, n in window.items() if s not in own))


def find_leaks(index: ItemIndex, text: pa.Array) -> list[tuple]:
    """(row, item number, start word, words, differing bits, similarity): per row and item the best window."""
    words = split_words(pc.utf8_lower(text), MARKS)
    starts, rows = shingle_starts(words.bounds, SHINGLE)
    if not len(starts):
        return []
    shingles = shingle_hashes(words.hash, SHINGLE)
    own = shingles[starts]
    maybe = np.flatnonzero(index.gate[(own >> np.uint64(64 - _GATE_BITS)).astype(np.int64)])
    low = np.searchsorted(index.gate_hash, own[maybe], side="left")
    high = np.searchsorted(index.gate_hash, own[maybe], side="right")
    at, which = _spans(low, high - low)
    if not len(at):
        return []
    hit, row = starts[maybe[which]], rows[maybe[which]]
    length = index.lengths[index.gate_item[at]]
    first, size = words.bounds[row], words.bounds[row + 1] - words.bounds[row]
    latest = first + np.maximum(0, size - length)
    lo = np.clip(hit - (length - SHINGLE), first, latest)
    hi = np.clip(hit, first, latest)
    keys = np.unique(np.stack([length, row, lo, hi], axis=1), axis=0)
    begin, of = _spans(keys[:, 2], keys[:, 3] - keys[:, 2] + 1)
    windows = np.unique(np.stack([keys[of, 0], keys[of, 1], begin], axis=1), axis=0)
    best: dict[tuple[int, int], tuple] = {}
    for length in np.unique(windows[:, 0]).tolist():
        mine = windows[windows[:, 0] == length]
        span = np.minimum(length, words.bounds[mine[:, 1] + 1] - mine[:, 2])
        for width in np.unique(span).tolist():  # texts shorter than the item have a shorter window
            part = mine[span == width]
            for s in range(0, len(part), _STEP):
                _compare(index, length, width, part[s : s + _STEP], shingles, words.bounds, best)
    return [(row, item, *found) for (row, item), found in sorted(best.items())]


def _compare(index, length, width, windows, shingles, bounds, best) -> None:
    matrix = shingles[windows[:, 2][:, None] + np.arange(width - SHINGLE + 1)]
    weights = index.weights(matrix)
    which, item, distance = within_radius(index, length, fingerprints(matrix, weights))
    for w, i, d in zip(which.tolist(), item.tolist(), distance.tolist(), strict=True):
        hashes = matrix[w].tolist()
        known = index.shingles[i]
        weight = dict(zip(hashes, weights[w].tolist(), strict=True))
        missing = [s for s in known if s not in weight]
        if len(missing):
            weight |= dict(zip(missing, index.weights(np.array(missing, np.uint64)).tolist(), strict=True))
        similarity = weighted_similarity(index, i, Counter(hashes), weight)
        if similarity >= SIMILARITY:
            row = int(windows[w, 1])
            found = (int(windows[w, 2] - bounds[row]), width, d, similarity)
            old = best.get((row, i))
            if old is None or (-found[3], found[0]) < (-old[3], old[0]):
                best[row, i] = found


def _indexes(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[ItemIndex]:
    """The items in blocks by a hash of their ids; the driver holds one block at a time."""
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        index = build_index([r.i for r in rows], [r.t for r in rows])
        if index is not None:
            yield index


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per document and item it holds, with the best window (see the module text)."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], LEAK_SCHEMA)
    for index in _indexes(benchmark, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def leaks(batches, shared=shared):
            for piece in pieces(batches):
                ids = piece.column("doc_id").to_pylist()
                rows = find_leaks(shared.value, piece.column("text"))
                if rows:
                    r, i, start, n, bits, similarity = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([ids[x] for x in r], pa.int64()),
                        "item_id": pa.array([shared.value.ids[x] for x in i], pa.int64()),
                        "start_word": pa.array(start, pa.int32()), "n_words": pa.array(n, pa.int32()),
                        "differing_bits": pa.array(bits, pa.int32()), "similarity": pa.array(similarity, pa.float64()),
                    })

        out = out.unionByName(source.mapInArrow(leaks, LEAK_SCHEMA))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no item; decided inside the scan, so no id is needed or joined."""
    spark = docs.sparkSession
    for index in _indexes(benchmark, "item_id", "text", block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            for piece in pieces(batches, text):
                keep = np.ones(piece.num_rows, bool)
                keep[[r[0] for r in find_leaks(shared.value, piece.column(text))]] = False
                yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
