"""Conflicting memories against brute force: titles, cues, full text, and nulls as empty values."""

import random
import re

from lodestone.functions.text import STOP_WORDS
from lodestone.operators import mining


def words(text):
    return {w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP_WORDS}


def test_conflicts(spark):
    r = random.Random(5)
    vocabulary = ["the", "Firmware", "gateway", "reset", "of", "billing", "outage", "node", "rollback", "disk"]
    pick = lambda n: r.choice([None, "", "the", *[" ".join(r.choices(vocabulary, k=r.randint(1, n)))] * 12])
    rows = [(i, r.choice(["t", "u"]), r.choice([None, "", "a", "b"]), pick(3), pick(12)) for i in range(90)]
    cues = [(i, f"c{r.randrange(60)}") for i in range(90)]
    want = {}
    for i, ti, si, a, x in rows:
        for j, tj, sj, b, y in rows:
            a, x, b, y = a or "", x or "", b or "", y or ""
            if i < j and ti == tj and (si or "") == (sj or "") and x != y:
                same, shared = int(a.lower() == b.lower()), len({c for k, c in cues if k == i} & {c for k, c in cues if k == j})
                text = words(b) and words(b) <= words(f"{a} {x}") or words(a) and words(a) <= words(f"{b} {y}")
                if same or shared or text:
                    want[i, j] = (same, shared)
    memories = spark.createDataFrame(rows, "memory_id long, tenant string, scope_path string, title string, narrative string")
    cue_table = spark.createDataFrame(cues, "memory_id long, cue_hash string")
    got = {(x.a, x.b): (x.same_title, x.shared_cues) for x in mining.conflicts(memories, cue_table, full_text=True).collect()}
    assert got == want and (0, 0) in want.values()
    some = {(x.a, x.b): (x.same_title, x.shared_cues) for x in mining.conflicts(memories, cue_table).collect()}
    assert some == {k: v for k, v in want.items() if v != (0, 0)}
