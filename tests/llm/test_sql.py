import os

import pytest

from recordloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for name_ in ("documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{SF}/{name_}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    order = [columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
