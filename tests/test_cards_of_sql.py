import pytest

from recordloom.plans import catalog

#: Numbers that pass the Luhn check: a card, one that no card opens with, one of 14 digits that is a company number too; and one that fails.
NUMBERS = ("4111111111111111", "9000000000000001", "45000007000141", "4111111111111112")


@pytest.mark.parametrize("name", ["findings_context", "findings_placed", "risk_by_category"])
def test_card_numbers_are_judged_as_in_sql(spark, tmp_path, name):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(i, f"pago com {n}, senha: x{i}y") for i, n in enumerate(NUMBERS)] + [(8, " ".join(NUMBERS)), (9, None)])
    db.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = db.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
