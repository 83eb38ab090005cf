"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from ledgerloom.plans import catalog, catalog_documents  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found, columns):
    plain = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(([plain(r[c]) for c in columns] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    if name not in catalog.SQL:
        assert got
        return
    q = con.execute(catalog.SQL[name])
    columns = [d[0] for d in q.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(got, sorted(columns)) == rows([dict(zip(columns, r, strict=True)) for r in q.fetchall()], sorted(columns))
