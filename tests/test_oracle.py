"""Every query with SQL gives SQL's rows, and the entry works with and without the optional operators."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from stackloom import file_queries, queries

QUERIES = queries.queries() | file_queries.queries()
SQL = queries.oracle_sql() | file_queries.oracle_sql()

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got) == sorted(want) and len(got) > 0
    assert sorted(map(str, got[sorted(got)].values.tolist())) == sorted(map(str, want[sorted(want)].values.tolist()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_optional_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'tree_both_cf' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0], timeout=120)
