"""Every core query against its DuckDB twin."""

import os

import duckdb
import pytest

from tessera.plans import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "nation part lineitem events embeddings".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def flat(v):
    if isinstance(v, float):
        return f"{v:.6g}" if v == v else "nan"
    return "[" + ",".join(map(flat, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_oracle(spark, con, name):
    got = Q.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(flat, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(flat, want))


def test_entry_needs_no_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["node", "patch", "err", "score"]
    assert Q.QUERIES.keys() <= e.queries().keys()
