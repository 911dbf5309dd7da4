"""Lines shared by different documents are boilerplate, however long they are; lines of near copies are not."""

import random

import pytest

import corpus_pipeline
from lodestone.llm import quality

LICENCE = " ".join(f"licence{i}" for i in range(150))
SHORT = ["Read the cookie notice here", "All rights are with the author"]


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=7)) for _ in range(n))


def documents():
    r = random.Random(3)
    rows = [(i, "\n".join([LICENCE, *SHORT, prose(r, 80), prose(r, 80)]), "a") for i in range(60)]
    base = [prose(r, 90) for _ in range(6)]
    for i in range(200):
        lines = list(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            j = r.randrange(6)
            w = lines[j].split()
            w[r.randrange(90)] = prose(r, 1)
            lines[j] = " ".join(w)
        rows.append((1000 + i, "\n".join(lines), "a"))
    return rows


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_lines(spark, broadcast_rows):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {x.doc_id: x.text for x in quality.clean(docs, by_rest=True, broadcast_rows=broadcast_rows).collect()}
    assert got == {d: "\n".join(t.split("\n")[3:]) if d < 1000 else t for d, t, _ in rows}


def test_stage(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert not any("licence1 " in x.text for x in corpus_pipeline.quality_stage(spark, docs, "").collect())
