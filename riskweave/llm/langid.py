"""Language of whole texts by segmentation-marginalised unigrams (operator 5).

Each language has a probability for every piece of a fixed public vocabulary (``piece_bpe_32k.model`` by default; the
path is a parameter). The probability of a word is the sum over all its segmentations into pieces, by the forward
algorithm; a text's is the product over its words, and Bayes' rule with equal priors picks the language.

* Training: expectation-maximisation (forward-backward over all segmentations) on the words of a bounded sample, the
  ``SAMPLE`` distinct texts per language with the smallest hash. Spark counts the words of the sample; the
  ``WORDS`` most frequent ones per language come to the driver. Each language keeps ``SHARED`` of its probability for
  what all languages have in common (the mean of their pieces, plus ``PRIOR`` of a count for every piece), so no word is
  impossible, and a word that a language has never met is as likely in a scarce language as in a rich one. A character
  outside the vocabulary counts as an unknown piece of fixed probability.
* Scoring: one scan, no shuffle. Words repeat, so a task finds the distinct words of a piece of texts first and runs
  the forward algorithm on all of them at once, one character position after another. Words are cut into stretches of
  ``LONGEST`` characters, which only concerns text without blanks.
* ``score`` is the probability of the picked language against the other learned ones, per word (geometric mean of the
  likelihoods), so a long text isn't always 1; ties go to the smaller name.

Words are lower-cased runs of letters with a leading mark for the word start, as in the vocabulary. Defined results: a
text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learned; repeated rows
are judged one by one; null languages and texts aren't learned from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.tables import pieces, text_sample

SAMPLE = 1_500
WORDS = 60_000
ROUNDS = 4
PRIOR = 0.1
SHARED = 0.05
UNKNOWN = 1e-7
LONGEST = 32
_MARK = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def load_vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are lower-cased letters, with or without the mark of a word start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_control(i))
    return sorted({p for p in text if len(p.strip(_MARK)) and p.lstrip(_MARK).isalpha() and p.count(_MARK) < 2})


@dataclass
class Lattice:
    """Hash table of the pieces: sorted hashes and the longest piece's length in characters."""

    hashes: np.ndarray
    longest: int
    _slots: np.ndarray | None = None

    @classmethod
    def of(cls, vocabulary: list[str]) -> tuple[Lattice, np.ndarray]:
        codes, sizes = _codes(vocabulary)
        h = _rolling(codes)
        own = h[np.arange(len(sizes)), sizes] if len(sizes) else np.zeros(0, np.uint64)
        order = np.argsort(own)
        return cls(own[order], int(sizes.max(initial=1))), order

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1. A table by the top 20 bits leaves few steps."""
        if self._slots is None:
            tops = np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)
            self._slots = np.append(np.searchsorted(self.hashes, tops), len(self.hashes)).astype(np.int32)
        top = (h >> np.uint64(44)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        at, end = self._slots[top], self._slots[top + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.hashes[at[live]] == h[live]
            out[live[same]] = at[live[same]]
            at[live] += 1
            live = live[~same & (at[live] < end[live])]
        return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one word a row, and the lengths."""
    array = np.array(words, dtype=np.str_) if words else np.zeros(0, "<U1")
    width = array.dtype.itemsize // 4
    codes = array.view(np.uint32).reshape(len(words), width)
    return codes, np.char.str_len(array)


def _rolling(codes: np.ndarray) -> np.ndarray:
    """Hash of every prefix: h[i, j] is of the first j characters; finished stretches come from ``_stretch``."""
    h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        c = (codes[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)
        c ^= c >> np.uint64(29)
        h[:, j + 1] = h[:, j] * _BASE + c * _BASE
    return h


def _segments(lattice: Lattice, words: list[str]):
    """For every end position: the rows whose word reaches it, and per piece length the index of the piece (or -1)."""
    codes, sizes = _codes(words)
    h = _rolling(codes)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(lattice.longest, _BASE)]))
    for end in range(1, codes.shape[1] + 1):
        rows = np.flatnonzero(sizes >= end)
        yield end, rows, [
            (n, lattice.find(h[rows, end] - h[rows, end - n] * power[n])) for n in range(1, min(end, lattice.longest) + 1)
        ]


def forward(lattice: Lattice, words: list[str], p: np.ndarray) -> np.ndarray:
    """log P(word) for every word and language; p: languages x pieces."""
    if not words:
        return np.zeros((0, p.shape[0]))
    table = np.ascontiguousarray(p.T)
    longest = max(map(len, words))
    alpha = np.zeros((len(words), longest + 1, p.shape[0]))
    alpha[:, 0] = 1
    out = np.zeros((len(words), p.shape[0]))
    sizes = np.array([len(w) for w in words])
    for end, rows, found in _segments(lattice, words):
        total = np.zeros((len(rows), p.shape[0]))
        for n, piece in found:
            hit = np.flatnonzero(piece >= 0)
            total[hit] += alpha[rows[hit], end - n] * table[piece[hit]]
            if n == 1:
                miss = np.flatnonzero(piece < 0)
                total[miss] += alpha[rows[miss], end - 1] * UNKNOWN
        alpha[rows, end] = total
    out = np.log(np.maximum(alpha[np.arange(len(words)), sizes], 1e-300))
    return out


def _expected(lattice: Lattice, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language (forward-backward over all segmentations)."""
    longest = max(map(len, words))
    sizes = np.array([len(w) for w in words])
    steps = list(_segments(lattice, words))
    alpha = np.zeros((len(words), longest + 1))
    alpha[:, 0] = 1
    for end, rows, found in steps:
        for n, piece in found:
            value = np.where(piece >= 0, p[piece], UNKNOWN if n == 1 else 0.0)
            alpha[rows, end] += alpha[rows, end - n] * value
    beta = np.zeros((len(words), longest + 1))
    beta[np.arange(len(words)), sizes] = 1
    total = np.maximum(alpha[np.arange(len(words)), sizes], 1e-300)
    out = np.zeros(len(p))
    for end, rows, found in reversed(steps):
        for n, piece in found:
            value = np.where(piece >= 0, p[piece], UNKNOWN if n == 1 else 0.0)
            beta[rows, end - n] += beta[rows, end] * value
            share = alpha[rows, end - n] * value * beta[rows, end] / total[rows] * counts[rows]
            hit = piece >= 0
            out += np.bincount(piece[hit], share[hit], minlength=len(p))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    lattice: Lattice
    p: np.ndarray  # languages x pieces


def fit(words: dict[str, dict[str, int]], vocabulary: list[str]) -> LanguageModel:
    """Piece probabilities from word counts per language."""
    languages = sorted(words)
    lattice, _ = Lattice.of(vocabulary)
    p = np.zeros((len(languages), len(vocabulary)))
    common = np.full(len(vocabulary), PRIOR)
    for i, language in enumerate(languages):
        own, counts = list(words[language]), np.array(list(words[language].values()), float)
        q = np.full(len(vocabulary), 1 / len(vocabulary))
        for _ in range(ROUNDS if own else 0):
            met = _expected(lattice, own, counts, q)
            q = met + PRIOR
            q /= q.sum()
            p[i] = met / max(met.sum(), 1e-300)
        common += p[i] * counts.sum() / len(languages)
    common /= max(common.sum(), 1e-300)
    return LanguageModel(languages, lattice, np.where(p.sum(axis=1, keepdims=True) > 0, (1 - SHARED) * p + SHARED * common, common))


def words_in(text: str) -> list[str]:
    """Lower-cased runs of letters, marked at the word start, in stretches of at most ``LONGEST`` characters."""
    out = []
    for w in _LETTERS.findall(text.lower()):
        w = _MARK + w
        out += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]
    return out


def train(docs: DataFrame, vocabulary: list[str], lang: str = "lang", text: str = "text") -> LanguageModel:
    """Model of the languages that ``docs`` names (give it the training rows only)."""
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    languages = [r.lang for r in known.select("lang").distinct().collect()]  # one row per language
    words: dict[str, dict[str, int]] = {}
    for language in languages:
        sample = text_sample(known.filter(F.col("lang") == language), SAMPLE, 0)

        def counted(batches):
            for batch in batches:
                found = [w for t in batch.column("text").to_pylist() for w in words_in(t)]
                got, n = np.unique(np.array(found, dtype=object), return_counts=True) if found else ([], [])
                yield pa.RecordBatch.from_pydict({"w": pa.array(got, pa.string()), "n": pa.array(n, pa.int64())})

        counts = sample.mapInArrow(counted, "w string, n long")
        counts = counts.groupBy("w").agg(F.sum("n").alias("n"))
        words[language] = {r.w: r.n for r in counts.orderBy(F.desc("n"), "w").limit(WORDS).collect()}
    return fit(words, vocabulary)


def identify(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    place: dict[str, int] = {}
    ids, owners, letters = [], [], []
    for i, t in enumerate(texts):
        found = words_in(t) if t else []
        letters.append(bool(found) or any(c.isalpha() for c in t or ""))
        ids += [place.setdefault(w, len(place)) for w in found]
        owners += [i] * len(found)
    languages = model.languages
    if not languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    word = forward_in_steps(model, list(place))
    owners, ids = np.array(owners, np.int64), np.array(ids, np.int64)
    total = np.stack([np.bincount(owners, word[ids, k], minlength=len(texts)) for k in range(len(languages))], axis=1)
    n = np.maximum(np.bincount(owners, minlength=len(texts)), 1)
    best = total.argmax(axis=1)
    share = np.exp((total - total.max(axis=1, keepdims=True)) / n[:, None])
    score = 1 / share.sum(axis=1)
    return (
        [languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)],
        [float(s) if ok else 0.0 for s, ok in zip(score, letters, strict=True)],
    )


def forward_in_steps(model: LanguageModel, words: list[str], step: int = 20_000) -> np.ndarray:
    """``forward`` with words of like length together, so short words don't pay for long ones."""
    out = np.zeros((len(words), len(model.languages)))
    order = np.argsort([len(w) for w in words], kind="stable")
    for s in range(0, len(words), step):
        part = order[s : s + step]
        out[part] = forward(model.lattice, [words[i] for i in part], model.p)
    return out


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for piece in pieces(batches):
            found, score = identify(shared.value, piece.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"), "lang_pred": pa.array(found, pa.string()),
                "score": pa.array(score, pa.float64()),
            })

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(scored, "doc_id long, lang_pred string, score double")
