import random

import pytest
from pyspark.sql import functions as F

from riskweave.llm import token_counts as C


@pytest.fixture(scope="module")
def tokenizers():
    return pytest.importorskip("public_tokenizers")


def library(path):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def expected(rows, count):
    return sorted(((i, len((t or "").encode()), count(t or "")) for i, t in rows), key=str)


def test_normal_form_keeps_counts(tokenizers):
    random.seed(5)
    path = tokenizers.path("piece_bpe_32k.model")
    tokenizer, one = C.Tokenizer.load(path), library(path)
    assert tokenizer.blank
    parts = [" ", "▁", "a", "the", "\n", "é", "日本", "<s>", "1", ".", "▁▁", "  "]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randrange(12)))
        assert one(text) == one(text.replace("▁", " ")), repr(text)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("few", [100_000, 1])
def test_odd_rows(odd, none, tokenizers, tmp_path, monkeypatch, name, few):
    monkeypatch.setattr(C, "FEW", few)
    path = tokenizers.path(name)
    count = library(path)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r) for r in C.token_counts(odd, path, str(tmp_path)).collect()]
    assert sorted(got, key=str) == expected(rows, count)
    stored = odd.sparkSession.read.parquet(str(tmp_path)).collect()
    assert len(stored) == len({r.digest for r in stored}) == len({t or "" for _, t in rows})  # each distinct text once
    assert C.token_counts(none, path, str(tmp_path / "none")).count() == 0
    assert not (tmp_path / "none").exists()


def test_cache_is_joined_and_grows_by_misses(spark, tokenizers, tmp_path, monkeypatch):
    path = tokenizers.path("piece_bpe_32k.model")
    tokenizer, count = C.Tokenizer.load(path), library(path)
    folder = C.cache_folder(str(tmp_path), tokenizer)
    first = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, C.token_counts(first, path, str(tmp_path)).collect()), key=str) == expected([(i, f"text {i % 7}") for i in range(50)], count)
    assert spark.read.parquet(folder).count() == 7
    # stored counts are what is returned: put a false one in place of the true one
    false = spark.createDataFrame([("text 3", 777), ("text 3", 777)], "text string, n_tokens long").select(F.unhex(F.sha2("text", 256)).alias("digest"), "n_tokens")
    false.write.mode("append").parquet(folder)
    more = first.unionByName(spark.createDataFrame([(99, "new"), (100, "new"), (101, "text▁3")], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in C.token_counts(more, path, str(tmp_path)).collect()}
    assert got[99] == got[100] == count("new") and got[101] == got[3] == 777 and got[4] == count("text 4") and len(got) == 53
    assert spark.read.parquet(folder).count() == 7 + 2 + 1
    # another version of the library: nothing of the old folder is read
    import sentencepiece

    monkeypatch.setattr(sentencepiece, "__version__", "next")
    assert {r.n_tokens for r in C.token_counts(more.filter("doc_id = 3"), path, str(tmp_path)).collect()} == {count("text 3")}


def test_hot_and_rare_contents(spark, tokenizers, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "HOT", 4)
    path = tokenizers.path("piece_bpe_32k.model")
    rows = [(i, "very often" if i % 2 else f"rare {i}") for i in range(60)]
    got = C.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, library(path))
