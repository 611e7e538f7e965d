import os

import pytest

from recordloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return db


def rows(names, found):
    plain = lambda v: None if v is None else round(float(v), 6) if not isinstance(v, (str, bool)) and not hasattr(v, "isoformat") else v
    return sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in found), key=str)


@pytest.mark.parametrize("name", ["payment_reconcile", "sales_dedup", "stock_ledger", "cpf_checksum", "amount_parse", "date_read", "keysync_outer", "column_profile", "file_inventory", "csv_cells", "doc_references", "dossier_gaps", "doc_cards", "encodings", "json_records", "hidden_csv", "xml_rows", "read_any", "table_content", "golden_cpf", "transaction_shape", "correction_log", "sku_resolution", "name_mentions", "people_by_source", "populations", "entity_components", "problem_counts", "findings_placed", "findings_context", "risk_by_category", "redact_plain", "dossier_holes", "dossier_main", "page_tables", "sheet_formulas", "sheet_info", "docx_text", "rtf_text", "record_schemas", "package_manifest", "sales_alerts", "doc_conflicts", "column_dictionary", "hidden_examples", "remark_counts", "side_registries", "mapped_transactions", "entity_cluster_open"])
def test_queries_match_their_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, want.fetchall())
