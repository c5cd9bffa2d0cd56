"""Every query that SQL can express gives the SQL's rows, and the others run."""

import math

import duckdb
import pytest

from privloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, float) and math.isnan(x):
        return None
    return x


def ordered(rows):
    return sorted(([plain(v) for v in r] for r in rows), key=lambda r: [(v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", str(v) if isinstance(v, list) else v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = [[r[c] for c in names] for r in df.collect()]
    assert rows
    if name in ORACLES:
        got = con.execute(ORACLES[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == names
        assert ordered(rows) == ordered([[r[columns.index(c)] for c in names] for r in got.fetchall()])
