from recordloom.plans import catalog


def test_headings_that_open_with_an_agency(spark, tmp_path):
    """A line of the text that opens with a word of agencies: long, with spaces at the end, before a letter that is no ASCII one."""
    import duckdb

    long = "Estado de " + "muitas  palavras " * 20
    texts = [f"x\n{long}\ny", "x\nEstado  \ny", "x\nEstadoñ um\ny", "x\nEstadomente\ny", "x\n\t Governo do  norte \r\ny", "Instituto" + " a" * 55 + " bcde fghij", "x Estado y", "x\r\nEstado um", None]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(3 * i + j, t) for i, t in enumerate(texts) for j in range(3)])
    db.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    df = catalog.QUERIES["doc_cards"](spark, str(tmp_path))
    want = db.execute(catalog.SQL["doc_cards"])
    columns = [c[0] for c in want.description]
    shaped = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert shaped(df.select(*columns).collect()) == shaped(want.fetchall())
