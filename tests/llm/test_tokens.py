"""Token counts against the tokenizers and sentencepiece libraries on whole texts."""

import random

import public_tokenizers
import pytest
from lodestone.llm import tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def texts():
    r = random.Random(5)
    alphabet = ["a", "b", "é", "日", "1", "22", " ", "  ", "\n", "\n\n", "\t", " ", "\x1c", "'s", "'", ".", "<|endoftext|>", "🙂", "word", "The "]
    return ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(600)]


def test_against_library_with_small_parts(library, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 12)
    monkeypatch.setattr(tokens, "BATCH", 64)
    monkeypatch.setattr(tokens, "CALL", 32)
    monkeypatch.setattr(tokens, "KNOWN", 50)
    with open(PATH, "rb") as f:
        count = tokens.TokenCounter("json", f.read()).count
    sample = [*texts(), "ab12" * 40, " " * 100, "x" * 500, "  <|endoftext|>  "]
    assert count(sample) == library(sample)


def test_whole_table(spark, library):
    long = " ".join(texts()) * 40 + "q7" * 200_000 + " " * 3000
    rows = [(1, "one two", "a", 5), (1, "one two", "a", 5), (2, None, None, None), (3, "", "b", 1), (4, long, "c", 2), *((10 + i, t, "d", 0) for i, t in enumerate(texts()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, `a.b` int").repartition(3)
    got = tokens.count_tokens(docs, PATH)
    assert got.columns == ["doc_id", "a.b", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((i, len((t or "").encode()), n, n > 1024) for (i, t, _, _), n in zip(rows, library([r[1] for r in rows]), strict=True))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert tokens.count_tokens(docs.where("false"), PATH).collect() == []


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_kinds(name):
    path, sample = public_tokenizers.path(name), ["Hello  world", "", "a\nb  c 12 é", " lead"]
    with open(path, "rb") as f:
        got = tokens.TokenCounter(name.rsplit(".", 1)[1], f.read()).count(sample)
    if name.endswith("model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(sample)]
    else:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        want = [len(e) for e in t.encode_batch(sample, add_special_tokens=False)]
    assert got == want


def test_batches_are_balanced():
    got = list(tokens.balanced(["aa", "bb", "c" * 9, "é", "d"], 4))
    assert got == [["aa", "bb"], ["c" * 9], ["é", "d"]]
