"""The as-of join in buckets against the plain one and a loop; percentiles against a sorted list."""

import datetime
import math
import random

from lodestone.operators import ranking, temporal


def test_asof_in_buckets(spark):
    r = random.Random(4)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=r.randrange(6000))
    left = [(i, r.choice("ab"), at()) for i in range(300)] + [(900, "c", at()), (901, "a", None)]
    right = list({(k, t): (k, t, i) for i in range(40) for k, t in [(r.choice("abd"), at())]}.values())
    l, q = spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, rt timestamp, v int")
    want = {i: max(((rt, v) for k2, rt, v in right if k2 == k and t is not None and rt <= t), default=(None, None))[1] for i, k, t in left}
    for bucket in (None, 3600, 86400):
        got = temporal.asof(l, q, ["k"], "t", "rt", ["v"], bucket)
        assert {x.id: x.v for x in got.collect()} == want and got.columns == ["id", "k", "t", "v"]
    assert temporal.asof(l, q.where("false"), ["k"], "t", "rt", ["v"], 3600).where("v is not null").isEmpty()


def test_nearest_rank(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice([1.5, 2.5, 2.5, 7.0, None])) for _ in range(200)] + [("c", 3.0)]
    got = {x.k: (x.n, x.p50, x.p95, x.p0) for x in ranking.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "v", (0.5, 0.95, 0.0), ["k"]).collect()}
    for k in "abc":
        v = sorted(x for a, x in rows if a == k and x is not None)
        assert got[k] == (len(v), *(v[max(1, math.ceil(p * len(v))) - 1] for p in (0.5, 0.95, 0.0)))
    whole = ranking.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "v", (0.5,)).first()
    assert whole.n == sum(x is not None for _, x in rows)
