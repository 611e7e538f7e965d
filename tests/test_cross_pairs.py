import os

import pytest
from pyspark.sql import functions as F

from recordloom.plans import catalog, more

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_namesakes_are_dealt_to_many_tasks(spark, monkeypatch, tmp_path):
    """Ten customers for each name and document: the pairs are spread, each is told once."""
    import duckdb

    db = duckdb.connect()
    db.execute(f"COPY (SELECT c_custkey + 143000 * i AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM '{SF}/customer.parquet', range(10) t(i)) TO '{tmp_path}/customer.parquet'")
    os.symlink(f"{SF}/documents.parquet", tmp_path / "documents.parquet")
    for name in ("customer", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(db.execute(catalog.SQL["doc_inconsistencies"]).fetchall())
    monkeypatch.setattr(more, "TASK_PAIRS", 40)
    found = catalog.QUERIES["doc_inconsistencies"](spark, str(tmp_path))
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:4] for r in got) == want and len(want) > 400
    assert len({r.task for r in got}) > 8 and max(sum(r.task == t for r in got) for t in {r.task for r in got}) < len(got) / 4
