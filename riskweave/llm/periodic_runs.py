"""Periodic runs of words by a dictionary of basic factors (operator 12).

A run is a stretch of words with smallest period q, at least ``min_periods`` periods and ``min_words`` words long, that no
neighbouring word extends keeping period q. Per document:

1. The dictionary of basic factors names every factor (stretch) of a power-of-two length: equal factors have equal
   names. The names of length 1 are the distinct words, checked byte by byte; a name of length 2m is that of the pair of
   names of its halves. A factor that occurs once in its document can't be a half of one that occurs twice, so it gets
   no name, and the dictionary of a text without repeats ends after a few lengths.
2. For length m, the successor of an occurrence is the next occurrence of its name. Occurrences that follow each other
   within a stretch of 2m words form an arithmetic progression whose difference is a period of that stretch. So a
   distance d with m/2 < d <= m proposes period d there. Each period belongs to exactly one length, the smallest power
   of two that isn't below it.
3. Proposals of one period at consecutive words overlap: together they reach from the first word to the last + m + d,
   and no further, since one more word would give one more proposal. That extends and deduplicates them into runs.

Why nothing is lost: in a run of period q and three periods or more, a factor of length m, q <= m < 2q, starts at every
word up to m + q before the end, and its first q words (a primitive word, as q is the smallest period) come back after
q words and not before. So all these words, and only they, propose q; a smaller period would propose itself instead.

Work and memory are n log n and n in the words of one document; documents are independent, so there is no shuffle and a
lost executor costs its own part of the scan.

Defined results: null, empty and blank texts have no words and no runs, and the collapsed text is empty. Ids (null and
repeated ones too) are handed through: one row per row. Texts are used whole. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.tables import pieces, share_package
from riskweave.llm.words import Words, join_words, split_words

MIN_WORDS = 24
MIN_PERIODS = 3
RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_names(words: Words) -> np.ndarray:
    """Equal words have equal numbers; hashes that meet by chance are told apart by their bytes."""
    _, first, name = np.unique(words.hash, return_index=True, return_inverse=True)
    size = words.end - words.start
    like = first[name]
    if (size == size[like]).all():
        stops = np.cumsum(size)
        inside = np.arange(int(size.sum())) - np.repeat(stops - size, size)
        if (words.data[inside + np.repeat(words.start, size)] == words.data[inside + np.repeat(words.start[like], size)]).all():
            return name
    text, known = words.data.tobytes(), {}
    return np.array([known.setdefault(text[a:b], len(known)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)], np.int64)


def _successors(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of occurrences (places ascending, keys): those whose key occurs more than once as (place, name, next place or -1),
    in ascending places."""
    order = np.argsort(key, kind="stable")
    keys, places = key[order], at[order]
    same = keys[1:] == keys[:-1]
    more = np.zeros(len(keys), bool)
    more[1:] |= same
    more[:-1] |= same
    name = np.concatenate([[0], np.cumsum(~same)]) if len(keys) else np.zeros(0, np.int64)
    following = np.full(len(keys), -1, np.int64)
    following[:-1][same] = places[1:][same]
    back = np.flatnonzero(more)
    back = back[np.argsort(places[back], kind="stable")]
    return places[back], name[back], following[back]


def find_runs(
    names: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs, by start and then period. Row r of names is bounds[r]:bounds[r+1]; no run
    crosses a bound. ``min_periods`` is 3 at least (the proof above needs three)."""
    if min_periods < 3:
        raise ValueError("runs of under three periods are not found by this method")
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    stop = bounds[1:][row]
    at = np.arange(len(names))
    key = row * (int(names.max(initial=0)) + 1) + names
    found = []
    m = 1
    while len(at):
        at, name, following = _successors(at, key)
        distance = following - at
        near = np.flatnonzero((following >= 0) & (distance <= m) & (2 * distance > m))
        if len(near):
            place, period = at[near], distance[near]
            order = np.lexsort((place, period))
            place, period = place[order], period[order]
            new = np.ones(len(place), bool)
            new[1:] = (np.diff(place) != 1) | (np.diff(period) != 0) | (row[place[1:]] != row[place[:-1]])
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(place)) - 1
            length = place[last] + m + period[head] - place[head]
            good = (length >= min_words) & (length >= min_periods * period[head])
            found.append(np.stack([place[head], length, period[head]])[:, good])
        # names of twice the length, where both halves have a name and lie in one row
        dense = np.full(len(names), -1, np.int64)
        dense[at] = name
        inside = at + 2 * m <= stop[at] if len(at) else np.zeros(0, bool)
        at, name = at[inside], name[inside]
        other = dense[at + m]
        at, name, other = at[other >= 0], name[other >= 0], other[other >= 0]
        key = name * (int(dense.max(initial=0)) + 1) + other
        m *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def without_repeats(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those that any run contains after its first period go."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS,
    arrange: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; words numbered from 0) and the collapsed text of every row.

    ``arrange`` (id, number of words) may give an order of a document's words to look at in place of the text's own.
    """
    share_package(docs.sparkSession)

    def scan(batches):
        for piece in pieces(batches):
            words = split_words(piece.column("text"))
            bounds = words.bounds
            if arrange is not None:
                sizes = np.diff(bounds).tolist()
                orders = [arrange(i, n) if n else None for i, n in zip(piece.column("doc_id").to_pylist(), sizes, strict=True)]
                if any(o is not None for o in orders):
                    order = np.concatenate([a + (np.arange(n) if o is None else o) for o, n, a in zip(orders, sizes, bounds.tolist(), strict=False)])
                    bounds = np.concatenate([[0], np.cumsum([n if o is None else len(o) for o, n in zip(orders, sizes, strict=True)])])
                    words = Words(words.data, words.start[order], words.end[order], bounds, words.hash[order])
            start, length, period = find_runs(word_names(words), bounds, min_words, min_periods)
            keep = without_repeats(len(words.start), start, length, period)
            joined, begin, end, kept = join_words(words, keep)
            row = np.searchsorted(bounds, start, side="right") - 1
            runs_of = np.searchsorted(row, np.arange(len(bounds)))
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start - bounds[row], length, period)], fields=list(_RUNS.value_type))
            texts = [joined[begin[a] : end[b - 1]].decode() if b > a else "" for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(runs_of, pa.int32()), runs).cast(_RUNS), pa.array(texts)],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, RESULT)
