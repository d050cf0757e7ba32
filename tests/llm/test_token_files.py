import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import token_files as T


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_257, 3000), rng.integers(0, 3, 2000), np.zeros(10, int), np.array([5])):
        ids = ids.astype(np.uint32)
        m = T.WaveletMatrix.build(ids)
        m = T.WaveletMatrix.unpacked(m.n, m.packed())
        assert (m.decode() == ids).all()
        for i in {0, len(ids) // 2, len(ids) - 1}:
            token = int(ids[i])
            places = np.flatnonzero(ids == token)
            assert m.access(i) == token
            assert m.rank(token, i) == (ids[:i] == token).sum() and m.rank(token, m.n) == len(places)
            assert [m.select(token, k) for k in (0, len(places) - 1, len(places))] == [places[0], places[-1], -1]
        assert m.rank(60_000, m.n) == 0 and m.select(60_000, 0) == -1


def test_wavelet_matrix_at_the_edges_of_its_numbers():
    for top in (1, 2, 65_535, 65_536, (1 << 32) - 1):
        ids = np.array([0, top, top // 2, top, 1, 0], np.uint32)
        m = T.WaveletMatrix.build(ids)
        back = T.WaveletMatrix.unpacked(m.n, m.packed()).decode()
        assert back.dtype == np.uint32 and back.tolist() == ids.tolist()
    assert T._number(16) is np.uint16 and T._number(17) is np.uint32


def test_encoder_equals_library(tokenizer):
    random.seed(3)
    parts = ["a", "b", " ", "\n", " ", "é", "1", "'s", "'ll", "\t", "  ", "!", "日本", " ", "x\x1ey", "<|endoftext|>", " The", "\r\n", "\x85", ".", ",", "²"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(14))) for _ in range(5000)]
    encoder = T.Encoder(tokenizer)
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == expected
    assert [x.tolist() for x in encoder.encode(pa.array([None, *texts[:50]]))] == [[], *expected[:50]]


def test_store_of_words_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "CACHE", 20)
    encoder = T.Encoder(tokenizer)
    for i in range(6):
        text = " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(15))
        assert encoder.encode(pa.array([text]))[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.place) <= 20 + 15


def test_words_met_before_are_looked_up_in_arrays(tokenizer, monkeypatch):
    random.seed(5)
    letters = ["a", "Zq", ".", ",", "!?", "-", "7", "é", "the", ":"]
    texts = [" ".join("".join(random.choice(letters) for _ in range(random.randrange(1, 6))) for _ in range(40)) for _ in range(60)]
    encoder = T.Encoder(tokenizer)
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for some in (texts[:1], texts[:20], texts):  # new words join the sorted store
        assert [x.tolist() for x in encoder.encode(pa.array(some))] == expected[: len(some)]
    assert isinstance(encoder.place, np.ndarray) and (np.diff(encoder.place.view(np.int64) ^ np.int64(-(1 << 63))) > 0).all()
    monkeypatch.setattr(encoder, "_learn", None)  # nothing is new any more
    assert [x.tolist() for x in encoder.encode(pa.array(texts[::-1]))] == expected[::-1]


def test_simple_units():
    units = [b" word", b"word", b" word.", b"w!?", b" a.b", b".", b" ,", b" x7", b"\nword", b" \xc3\xa9", b" end;:"]
    end = np.cumsum([len(u) for u in units])
    written, simple, signed = T._simple_units(np.frombuffer(b"".join(units), np.uint8), np.append(0, end[:-1]), end)
    assert simple.tolist() == [True, True, True, True, False, False, False, False, False, False, True]
    assert np.flatnonzero(signed).tolist() == [2, 3, 10]
    assert written.tobytes() == b" word\0word\0 word\0.\0w\0!?\0 end\0;:\0"


def test_round_trip(odd, none, tokenizer, monkeypatch):
    library = T.Encoder(tokenizer).tokenizer
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, start = [], 0
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in T.round_trip(odd, tokenizer).collect()), key=lambda r: r[1])
    assert got == expected
    assert T.round_trip(none, tokenizer).count() == 0


def test_shards():
    rows = [(i, np.full(T.SHARD // 3, i, np.uint32)) for i in range(7)] + [(9, np.zeros(T.SHARD + 5, np.uint32))]
    shards = list(T._shards(iter(rows), 4))
    assert [len(s["docs"]) for s in shards] == [3, 3, 1, 1] and [s["first"] for s in shards] == [0, *np.cumsum([s["n"] for s in shards])[:-1]]
