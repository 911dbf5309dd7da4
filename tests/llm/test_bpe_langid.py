import hashlib
import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from lodestone.llm import bpe, langid

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = "aZé ßñ0٣ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​'’s!?…🙂́漢字ÀǅΣ_-<|endoftext|>"


def texts():
    r = random.Random(5)
    out = [None, "", " ", "\n\n", "don't we'll I'D he's", "a" * 3000, "<|endoftext|>", "x <|endoftext|><|endoftext|> y", "  two  spaces \n next"]
    for _ in range(400):
        out.append("".join(r.choice([r.choice(ODD), r.choice(["the ", "Hello", "'s", "  ", "<|endoftext|>", "thouinor "]), chr(r.randrange(0x20, 0x3000))]) for _ in range(r.randint(1, 60))))
    return [t if t is None else t.encode("utf-8", "ignore").decode() for t in out]


def test_bpe_equals_library(spark):
    rows = list(enumerate(texts()))
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, PATH).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for i, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want, t
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert back[i] == library.decode(want, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(back[i].encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_langid(spark):
    r = random.Random(3)
    parts = {"en": "the and ing tion er on th re".split(), "fr": "eau tion ou é è qu ai eux".split(), "de": "ung sch ein ich ä tz pf er".split()}
    make = lambda g: " ".join("".join(r.choices(parts[g], k=r.randint(1, 3))) for _ in range(r.randint(8, 60)))
    rows = [(i, make(g), g) for i in range(600) for g in [r.choice(list(parts))]]
    model = langid.fit([(t, g) for _, t, g in rows[:400]])
    odd = [(-1, None, "en"), (-2, "", None), (-3, "123 !?", "en"), (-4, rows[0][1] * 2000, None), (-4, rows[0][1] * 2000, None)]
    docs = spark.createDataFrame(rows[400:] + odd, "doc_id long, text string, score string")
    got = langid.identify(docs, model).collect()
    held = {i: g for i, _, g in rows[400:]}
    assert sum(x.lang_pred == held[x.doc_id] for x in got if x.doc_id >= 0) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in got)
    assert [(x.lang_pred, x.score) for x in got if x.doc_id in (-1, -2, -3)] == [("und", 0.0)] * 3
    assert [x.lang_pred for x in got if x.doc_id == -4] == [rows[0][2]] * 2
    assert {x.lang_pred for x in langid.identify(docs, langid.fit([])).collect()} == {"und"}
    sample = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 4 != 2, per_lang=50)
    assert 90 < len(sample) < 220
