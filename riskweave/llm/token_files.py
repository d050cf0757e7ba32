"""Token ids as wavelet matrices (operator 6).

Documents are encoded in ascending id order and cut into shards of about ``SHARD`` tokens (a document stays whole).
Each shard's ids become a wavelet matrix: one bit plane per bit of the largest id, highest first; below each plane the
ids are stably parted by that bit. A plane keeps the number of ones before every 512th bit, so

* ``access(i)``: the id at a place, * ``rank(token, i)``: how often a token occurs before a place,
* ``select(token, k)``: the place of its k-th occurrence, * ``decode()``: all ids

work on the planes alone, without decoding the rest.

File format: a folder of Parquet files, one per range of ids and each a compressed file of its own, with one row per
shard: ``part`` and ``shard`` (order), ``first`` (ids in this part before the shard), ``n`` (ids), ``width`` (planes),
``docs`` (list of doc_id and number of ids) and ``planes`` (per plane the packed bits, zstd-compressed, with the
number of zeros). Spark writes and reads them, so any store that Spark knows will do.

The texts are range-partitioned by id once; they are encoded where they land, and only narrow per-document rows leave
a task. Offsets over all parts need one row per part on the driver.

The encoder is the tokenizers library. A byte-level BPE never merges across the blank before a word, so a task encodes
each distinct word once (the tokenizer's own model, after its own pre-tokenizer or the same cut), keeps a bounded store
and joins the ids. Texts with runs of blanks or blanks other than space and line feed are encoded whole. The results are
those of ``encode(text, add_special_tokens=False)``.

Defined results: a null or empty text is the end id alone; null ids come first; rows of one id follow each other in
the order of their texts; an empty table gives no files' rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.tables import pieces, text_buffer
from riskweave.llm.words import mix, split_words
from riskweave.session import ensure_checkpoint_dir

SHARD = 1 << 20
END = 2
CACHE = 2_000_000  # words a worker keeps, some 70 MB
_TOGETHER = 200
_BLOCK = 512

FILE_SCHEMA = (
    "part int, shard int, first long, n long, width int, docs array<struct<doc_id: long, n: int>>, "
    "planes array<struct<zeros: long, bits: binary>>"
)


def _number(width: int) -> type:
    """The narrowest type for ids of so many bits."""
    return np.uint16 if width <= 16 else np.uint32


@dataclass
class WaveletMatrix:
    n: int
    planes: list[np.ndarray]  # packed bits, highest plane first
    zeros: list[int]
    _ones: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max(initial=0)).bit_length())
        planes, zeros = [], []
        ids = ids.astype(_number(width))
        for level in range(width - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(bit))
            low = ids[~bit]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[bit]])
        return cls(int(len(ids)), planes, zeros)

    def _directory(self) -> list[np.ndarray]:
        """Ones before every block of 512 bits."""
        if self._ones is None:
            self._ones = []
            for p in self.planes:
                ones = np.bitwise_count(np.pad(p, (0, -len(p) % (_BLOCK // 8)))).reshape(-1, _BLOCK // 8).sum(axis=1)
                self._ones.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int64)]))
        return self._ones

    def _rank1(self, level: int, i: int) -> int:
        plane, block = self.planes[level], i // _BLOCK
        start, stop = block * _BLOCK // 8, i // 8
        ones = int(self._directory()[level][block]) + int(np.bitwise_count(plane[start:stop]).sum())
        return ones + (int(plane[stop] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i // 8] >> (7 - i % 8)) & 1
            ones = self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _descend(self, token: int, i: int, j: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._rank1(level, i), self._rank1(level, j)
            if token >> (len(self.planes) - 1 - level) & 1:
                i, j = self.zeros[level] + a, self.zeros[level] + b
            else:
                i, j = i - a, j - b
        return i, j

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        if token < 0 or token >> len(self.planes):
            return 0
        start, stop = self._descend(token, 0, i)
        return stop - start

    def _place(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self._rank1(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence, or -1."""
        if k < 0 or k >= self.rank(token, self.n):
            return -1
        at = self._descend(token, 0, 0)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: the parting undone from the lowest plane up."""
        ids = np.zeros(self.n, _number(len(self.planes)))
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            upper = np.empty_like(ids)
            z = self.zeros[level]
            upper[~bit] = ids[:z]
            upper[bit] = ids[z:] | ids.dtype.type(1 << (len(self.planes) - 1 - level))
            ids = upper
        return ids.astype(np.uint32)

    def packed(self) -> list[dict]:
        codec = pa.Codec("zstd", compression_level=1)
        return [{"zeros": z, "bits": codec.compress(p.tobytes(), asbytes=True)} for z, p in zip(self.zeros, self.planes, strict=True)]

    @classmethod
    def unpacked(cls, n: int, planes: list[dict]) -> WaveletMatrix:
        codec = pa.Codec("zstd")
        size = -(-n // 8)
        bits = [np.frombuffer(codec.decompress(p["bits"], size, asbytes=True), np.uint8) for p in planes]
        return cls(n, bits, [p["zeros"] for p in planes])


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b if b in prints else 256 + others.index(b)) for b in range(256)}


class Encoder:
    """ids of texts, as the library's ``encode`` gives them; a bounded store keeps those of words met before.

    The store is arrays, sorted by the 64-bit hash of a word and its blank, so words met before are looked up together
    and never become Python values. New words go to the tokenizer's model together, with a byte letter between them
    that no merge of the vocabulary holds, so no token can reach over it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.place, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes, sorted, and the unit of each
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # unit k has flat[starts[k] : starts[k + 1]]
        self.letters = _byte_letters()
        model = json.loads(self.tokenizer.to_str())["model"]
        merged = set("".join(chain.from_iterable(model["merges"])))
        # bytes that no UTF-8 text has
        self.gap_letter = next(
            x for b in range(0xF5, 0x100) if (x := self.letters[b]) not in merged and x in model["vocab"]
        )
        self.gap = model["vocab"][self.gap_letter]

    def _together(self, written: str) -> tuple[np.ndarray, np.ndarray]:
        """ids of all written pre-tokens, which have the gap letter between them, and how many each has."""
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(written)], np.uint32)
        gap = ids == self.gap
        return ids[~gap], np.diff(np.concatenate([[-1], np.flatnonzero(gap), [len(ids)]])) - 1

    def _split(self, units: list[str]) -> tuple[list[str], list[int]]:
        """Written pre-tokens of the units, and how many each has: a word, then signs, is two at most; others are split
        by the library."""
        written, counts = [], []
        for u in units:
            word = u.rstrip(".,;:!?")
            if (word[1:] if word[:1] == " " else word).isalpha():
                parts = [word, u[len(word) :]] if len(word) < len(u) else [word]
                written += [p.encode().decode("latin-1").translate(self.letters) for p in parts]
                counts.append(len(parts))
            else:
                parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(u)
                written += [part for part, _ in parts]
                counts.append(len(parts))
        return written, counts

    def _learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Adds the ids of new units data[begin:end], under their keys, which are sorted."""
        written, simple, signed = _simple_units(data, begin, end)
        ids, sizes = [self.flat], []
        letters = written.tobytes().decode("latin-1").replace(" ", self.letters[0x20]).replace("\0", self.gap_letter)
        stops = np.flatnonzero(written == 0)  # behind each pre-token
        start = 0
        for stop in [*stops[_TOGETHER - 1 :: _TOGETHER].tolist(), *stops[-1:].tolist()]:
            if start < stop:
                some, n = self._together(letters[start:stop])
                ids.append(some)
                sizes.append(n)
            start = stop + 1
        raw = data.tobytes() if not simple.all() else b""
        others = [raw[b:e].decode() for b, e in zip(begin[~simple].tolist(), end[~simple].tolist(), strict=True)]
        parts, counts = self._split(others)
        for s in range(0, len(parts), _TOGETHER):
            some, n = self._together(self.gap_letter.join(parts[s : s + _TOGETHER]))
            ids.append(some)
            sizes.append(n)
        counts = np.concatenate([1 + signed[simple], np.array(counts, np.int64)])
        own = np.add.reduceat(np.concatenate(sizes), np.cumsum(counts) - counts)
        number = np.empty(len(keys), np.int32)
        number[np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])] = np.arange(len(keys)) + len(self.starts) - 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(own)])
        self.flat = np.concatenate(ids)
        at = np.searchsorted(self.place, keys)
        self.place, self.number = np.insert(self.place, at, keys), np.insert(self.number, at, number)

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, or would be, and whether it is there."""
        at = np.searchsorted(self.place, keys)
        known = at < len(self.place)
        known[known] = self.place[at[known]] == keys[known]
        return at, known

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """ids of each text. Plain texts are cut before each blank, and each distinct word with its blank is met once."""
        words = split_words(texts)
        data, offsets = text_buffer(texts)
        plain = plain_rows(data, offsets)
        row = words.row_of_word()
        start = words.start
        blank = np.where(start > offsets[:-1][row], data[np.maximum(start - 1, 0)], 0).astype(np.uint64)
        keys, first, unit = np.unique(mix(words.hash + blank), return_index=True, return_inverse=True)
        if plain.all():
            used = np.ones(len(first), bool)
        else:
            used = np.zeros(len(first), bool)
            used[unit[plain[row]]] = True
        if len(self.place) > CACHE:  # later words are rarer: keep the first
            self._shrink()
        new = used & ~self._known(keys)[1]
        if new.any():
            met = first[new]
            self._learn(keys[new], data, start[met] - (blank[met] > 0), words.end[met])
        at = np.zeros(len(first), np.int64)
        at[used] = self.number[np.searchsorted(self.place, keys[used])]
        own = np.where(used, self.starts[at + 1] - self.starts[at], 0) if len(self.starts) > 1 else np.zeros(len(first), np.int64)
        counts = own[unit] if plain.all() else np.where(plain[row], own[unit], 0)
        stops = np.cumsum(counts)
        places = np.repeat(self.starts[at][unit] - (stops - counts), counts)
        places += np.arange(len(places))
        ids = self.flat[places]
        bounds = np.concatenate([[0], stops])[words.bounds]
        out = []
        for i, (a, b) in enumerate(pairwise(bounds.tolist())):
            if plain[i]:
                out.append(ids[a:b])
            else:
                whole = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                out.append(np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, np.uint32))
        return out

    def _shrink(self) -> None:
        kept = CACHE // 2
        first = self.number < kept
        self.place, self.number, self.starts = self.place[first], self.number[first], self.starts[: kept + 1]
        self.flat = self.flat[: self.starts[-1]]


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[[*b".,;:!?"]] = True


def _simple_units(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, simple, signed) of the units data[begin:end]. Simple ones are ASCII letters, with a space before and signs
    behind them or not; bytes has their pre-tokens (space and letters; signs), each with a zero byte behind it; signed
    says which units end in signs."""
    spaced = data[begin] == 0x20
    size = end - begin - spaced
    before = np.cumsum(size) - size
    unit = np.repeat(np.arange(len(size)), size)
    inside = data[np.arange(len(unit)) + np.repeat(begin + spaced - before, size)]
    letter, sign = _LETTERS[inside], _SIGNS[inside]
    wrong = ~letter & ~sign
    wrong[1:] |= letter[1:] & sign[:-1] & (unit[1:] == unit[:-1])
    letters = np.add.reduceat(letter, before, dtype=np.int64)
    simple = (np.add.reduceat(wrong, before, dtype=np.int64) == 0) & (letters > 0)
    signed = simple & (letters < size)
    room = np.where(simple, spaced + size + 1 + signed, 0)
    to = np.cumsum(room) - room
    written = np.zeros(int(room.sum()), np.uint8)
    written[to[simple & spaced]] = 0x20
    kept = simple[unit]
    places = np.arange(len(unit)) + np.repeat(to + spaced - before, size) + sign  # signs are behind a zero byte
    written[places[kept]] = inside[kept]
    return written, simple, signed


_OTHER_BLANKS = np.zeros(256, bool)
_OTHER_BLANKS[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether all white space of a row is single spaces and line feeds inside it, and no special token can occur."""
    plain = offsets[:-1] < offsets[1:]
    if not len(data):
        return plain
    blank = (data == 0x20) | (data == 0x0A)
    bad = _OTHER_BLANKS[data]
    bad[:-1] |= blank[:-1] & blank[1:]
    bad[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # <|
    one, two = np.append(data[1:], 0), np.append(data[2:], [0, 0])[: len(data)]
    # blanks beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    bad |= (data == 0xC2) & ((one == 0x85) | (one == 0xA0))
    bad |= ((data == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((data == 0xE3) & (one == 0x80) & (two == 0x80))
    general = (data == 0xE2) & (one == 0x80)
    bad |= general & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
    bad |= (data == 0xE2) & (one == 0x81) & (two == 0x9F)
    full = np.flatnonzero(plain)
    plain[np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1] = False
    plain[full] &= ~blank[offsets[:-1][full]] & ~blank[offsets[1:][full] - 1]
    return plain


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker, so later tasks find the words of earlier ones."""
    return Encoder(path)


def _plain(text: str) -> bool:
    """Whether all white space is single spaces and line feeds inside the text, and no special token can occur."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text:
        return False
    if " \n" in text or "\n " in text or "<|" in text:
        return False
    solid = text.replace("\n", "").replace(" ", "")
    return solid.split() == [solid]


def _shards(rows: Iterator[tuple[int | None, np.ndarray]], part: int) -> Iterator[dict]:
    """File rows from (doc_id, ids) in order."""
    docs, ids, size, first, shard = [], [], 0, 0, 0

    def finish():
        matrix = WaveletMatrix.build(np.concatenate(ids))
        return {
            "part": part, "shard": shard, "first": first, "n": matrix.n, "width": len(matrix.planes), "docs": docs,
            "planes": matrix.packed(),
        }

    for doc, own in rows:
        if size and size + len(own) > SHARD:
            yield finish()
            first, shard = first + size, shard + 1
            docs, ids, size = [], [], 0
        docs.append({"doc_id": doc, "n": len(own)})
        ids.append(own)
        size += len(own)
    if size:
        yield finish()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes and writes all documents in ascending id order (see the module text for the format)."""
    # The end id is part of the format; the vocabulary file must be at the same place for all executors.
    sorted_rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sorted_rows = sorted_rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encoded(batches):
        encoder, part = encoder_of(tokenizer), None

        def rows():
            nonlocal part
            for piece in pieces(batches, size=4 << 20):
                if part is None:
                    part = piece.column("part")[0].as_py()
                for doc, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text")), strict=True):
                    yield doc, np.append(ids, np.uint32(END))

        for shard in _shards(rows(), 0):
            shard["part"] = part
            yield pa.RecordBatch.from_pylist([shard], schema=_ARROW)

    sorted_rows.withColumn("part", F.spark_partition_id()).mapInArrow(encoded, FILE_SCHEMA).write.mode("overwrite").option(
        "compression", "uncompressed"  # planes are compressed already
    ).parquet(path)


_ARROW = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("width", pa.int32()),
    ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int32())]))),
    ("planes", pa.list_(pa.struct([("zeros", pa.int64()), ("bits", pa.binary())]))),
])


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per written file
    before, offsets = 0, {}
    for r in totals:
        offsets[r.part] = before
        before += r.n
    shared = spark.sparkContext.broadcast(offsets)

    def decoded(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = WaveletMatrix.unpacked(row["n"], row["planes"]).decode().astype("<u4")
                sizes = np.array([d["n"] for d in row["docs"]], np.int64)
                stops = np.cumsum(sizes)
                starts = stops - sizes
                base = shared.value[row["part"]] + row["first"]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([d["doc_id"] for d in row["docs"]], pa.int64()),
                    "start": pa.array(starts + base), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return files.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def scratch_folder(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the token files and returns what they hold (one row per document)."""
    spark = docs.sparkSession
    path = scratch_folder(spark, "token-files")
    write_token_files(docs, path, tokenizer, doc_id, text)
    return read_token_files(spark, path)
