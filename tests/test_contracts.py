"""Every query against the SQL that says what it returns."""

from collections import Counter

import duckdb
import pytest

from tidemark.plans import contracts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(contracts.QUERIES))
def test_query_is_its_sql(spark, duck, sf, name):
    df = contracts.QUERIES[name](spark, sf)
    got = rows_of(df.columns, map(tuple, df.collect()))
    asked = duck.execute(contracts.SQL[name])
    columns = [c[0] for c in asked.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, asked.fetchall())
