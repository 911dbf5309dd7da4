"""Stems, cover density and search against brute force; other scripts, nulls and empty questions."""

import itertools
import random

from lodestone.functions import fulltext as X
from lodestone.functions.stem import stem

#: Pairs of the algorithm's published sample vocabulary. Fixed values.
SAMPLES = """consign consign consigned consign consignment consign consistency consist consolatory consolatori consolation consol knightly knight kneeling kneel knavish knavish generate generat generic generic
relational relat hopping hop hoping hope happy happi cries cri ties tie outages outag outage outag failures failur possibility possibl rational ration agreed agre falling fall say say enjoy enjoy dying die news news
proceeding proceed gas gas gaps gap hopefulness hope electricity electr decisiveness decis adjustable adjust replacement replac adoption adopt roll roll universities univers national nation yesterday yesterday""".split()


def test_stems():
    for word, want in itertools.batched(SAMPLES, 2):
        assert stem(word) == want, word
    # The native test before matching relies on this.
    parts = ["cr", "hop", "tan", "agre", "skat", "y", "ie", "bl", "iz", "at", "ll"]
    ends = ["", "s", "ed", "ing", "ies", "y", "ly", "ation", "ational", "iveness", "fulness", "biliti", "bility", "ement", "eedly", "ss", "e"]
    for a, b, c in itertools.product(parts, parts, ends):
        k = stem(a + b + c)
        assert k and (a + b + c).startswith(k[: max(1, len(k) - 2)]), (a + b + c, k)


def covers(places, n):
    """All windows that hold every lexeme while neither window without one end does."""
    full = lambda a, b: len({k for _, k in places[a : b + 1]}) == n
    total = 0.0
    for a, b in itertools.combinations_with_replacement(range(len(places)), 2):
        if full(a, b) and not (a < b and (full(a + 1, b) or full(a, b - 1))):
            total += 0.1 / (1 + places[b][0] - places[a][0] - (b - a))
    return total


def test_cover_density():
    r = random.Random(3)
    for _ in range(400):
        n = r.randint(1, 4)
        places = [(i, r.randrange(n)) for i in sorted(r.sample(range(60), r.randint(0, 14)))]
        want = covers(places, n) if len({k for _, k in places}) == n else 0.0
        assert abs(X.cover_density(places, n) - want) < 1e-12
    assert X.cover_density([], 0) == 0.0 and X.proximity([], 2) == 0.0
    near, far = X.proximity([(0, 0), (1, 1)], 2), X.proximity([(0, 0), (9, 1)], 2)
    assert 0 < far < near < 0.1 and X.proximity([(0, 0)], 1) < X.proximity([(0, 0), (5, 0)], 1)


def test_search(spark):
    texts = ["Gateway outage: the outages of gateways", "no such thing", None, "", "Überlauf im Gateway — outage später", "gateway " + "x " * 40000 + "outage", "GATEWAY/outage", "gateway/outage"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r.id: r.v for r in X.matching(d, "text", "What about gateway outages?").collect()}
    assert set(found) == {0, 4, 5, 6, 7} and found[6] == found[7] == 0.1 and found[5] < 1e-5 and found[0] > found[4]
    assert [r.id for r in X.matching(d, "text", "ÜBERLAUF").collect()] == [4]
    assert X.matching(d, "text", "of the").count() == 0 and X.matching(d, "text", "").count() == 0
    stored = X.postings(d, "id", "text")
    asked = spark.createDataFrame([(1, "gateway outage"), (2, "überlauf"), (3, "the"), (4, "gateway nothere"), (5, None)], "query_id int, question string")
    got = {(r.query_id, r.id): (r.rank_value, r.place) for r in X.batch_search(stored, asked, "id", 4).collect()}
    assert {k for k in got if k[0] == 1} == {(1, 0), (1, 4), (1, 6), (1, 7)} and got[1, 6][1] < got[1, 7][1]
    assert all(abs(v - found[i]) < 1e-8 for (q, i), (v, _) in got.items() if q == 1)
    assert {k for k in got if k[0] != 1} == {(2, 4)}
    assert X.batch_search(stored.where("false"), asked, "id", 4).count() == 0
