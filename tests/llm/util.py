"""A query against its SQL over the smallest tables."""

import duckdb

from stackloom.llm import queries

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, query):
    con = duckdb.connect()
    for t in ("stamps", "embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = query(spark, SF).toArrow(), con.sql(queries.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and got.num_rows > 0
    rows = lambda t: sorted(map(repr, t.select(sorted(t.column_names)).to_pylist()))
    assert rows(got) == rows(want)
