"""Every query of the engine against its SQL on the driver tables."""

import datetime
import os

import duckdb
import pytest

from lodestone.plans import queries, queries_engine, queries_ingest, queries_lifecycle, queries_more, queries_repair, queries_retrieval, queries_sources, queries_text, queries_upkeep  # noqa: F401

DIR = os.environ.get("LODESTONE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {k: plain(v) for k, v in sorted(x.items())}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data), [names[i] for i in order]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    got, columns = rows(df.columns, df.collect())
    if name not in queries.ORACLE:
        return
    cursor = duck.execute(queries.ORACLE[name])
    want, expected = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == expected
    if got != want:
        a = [x for x in got if x not in set(want)][:2]
        b = [x for x in want if x not in set(got)][:2]
        raise AssertionError(f"{name}: {len(got)} rows, SQL has {len(want)}; only here {str(a)[:400]}; only there {str(b)[:400]}")
