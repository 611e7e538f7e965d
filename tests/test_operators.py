import sqlite3
import zipfile

from pyspark.sql import functions as F

from recordloom.graph import components
from recordloom.operators import dossier, entity, inventory, keysync, privacy
from recordloom.operators import tables as tabs
from recordloom.sources import files, sinks
from recordloom.streaming import redaction

LETTER = "Sra. Maria da Silva, CPF 529.982.247-25, RG nº 12.345.678-9 SSP/DF, e-mail maria@x.gov.br, CID F32.1, mãe de criança. CNPJ 11.222.333/0001-81"


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_findings_and_redaction_leave_nothing_raw(spark):
    docs = spark.createDataFrame([(1, LETTER), (2, None), (3, "nada")], "doc_id long, text string")
    found = privacy.findings(docs)
    assert {r.kind for r in found.collect()} == {"CPF", "CNPJ", "RG", "Nome de pessoa", "E-mail", "Saúde: CID", "Criança/adolescente"}
    text = docs.select(privacy.redacted(F.col("text")).alias("t")).first().t
    assert not any(x in text for x in ("Maria", "529.982", "12.345.678", "maria@", "F32")) and "11.222.333/0001-81" in text
    assert {r.origin: r.level for r in privacy.risk(found).collect()} == {1: "ALTO"}


def test_redact_table_drops_and_masks(spark):
    df = spark.createDataFrame([("Ana Lima", "529.982.247-25", "01310-100", "x", "06/05/1980", "ok")], "nome string, cpf string, cep string, senha string, nascimento string, obs string")
    row = privacy.redact_table(df, {"cpf": "cpf", "cep": "cep"}).first().asDict()
    assert row == {"nome": "A. L.", "cpf": "***.982.247-**", "cep": "01310-***", "nascimento": 1980, "obs": "ok"}
    assert sinks.without_secrets(df).columns == ["nome", "cpf", "cep", "nascimento", "obs"]


def test_normalised_logs_problems(spark):
    rows = [(1, "529.982.247-25", "R$ 10,00"), (2, "529.982.247-25", "R$ 10,00"), (3, "123", "abc"), (4, None, "-")]
    tidy, problems = tabs.normalised(spark.createDataFrame(rows, "k int, cpf string, valor string"), "k", {"cpf": "cpf", "valor": "valor"})
    assert tidy.count() == 2
    assert {(r.key, r.column) for r in problems.collect()} == {(3, "cpf"), (3, "valor")}


def test_unique_headers():
    assert tabs.unique_headers(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]


def test_synchronised_sums_and_diverges(spark):
    a = spark.createDataFrame([("529.982.247-25", "Ana", None)], "cpf string, nome string, valor double")
    b = spark.createDataFrame([("52998224725", "ANA", 10.0), ("52998224725", "Anna", 5.5), ("111", "Z", None)], "cpf string, nome string, valor double")
    out = keysync.synchronised([keysync.Source("a", a, "cpf", ("nome",)), keysync.Source("b", b, "cpf", ("nome", "valor"), ("valor",))])
    rows = {r.k: r for r in out.collect()}
    assert rows["52998224725"].n_sources == 2 and rows["52998224725"].valor__b == 15.5 and rows["111"].valor__b == 0
    assert keysync.divergences(out, "nome", ["a", "b"]).count() == 0


def test_clusters_respect_exclusions(spark):
    people = lambda rows: spark.createDataFrame(rows, "line long, id string, name string, cpf string, email string, phone string, birth string, city string")
    main = people([(1, "1", "Ana Lima", "529.982.247-25", "a@x.com", None, None, None), (2, "2", "Bia Reis", None, None, None, None, None), (3, "3", "Ana Lima", "111.444.777-35", None, None, None, None)])
    other = people([(1, "9", "Ana M Lima", "52998224725", None, None, None, None), (2, "2", "Bia Reis", None, None, None, None, None), (3, "7", "Caio Dias", None, "a@x.com", None, None, None)])
    rows, blocked = entity.clusters(entity.records([("main", 100, main), ("old", 10, other)]))
    got = {r.rid: r.cluster for r in rows.collect()}
    old = entity._LINES
    assert got[old + 1] == got[1] and got[old + 2] == got[2] and got[3] != got[1]
    assert got[old + 3] != got[1]  # it would bring a second id of one source together
    assert {(r.a, r.b) for r in blocked.collect()} >= {(1, 3)}


def test_dossiers_and_gaps(spark):
    docs = [(1, "EDITAL nº 1/2024 Processo nº 12345.000123/2024-11"), (2, "CONTRATO nº 5/2024 Processo nº 12345.000123/2024-11 de 3 de maio de 2024"), (3, "3º TERMO ADITIVO ao contrato nº 5/24 fls. 7"), (4, "Ofício sem ligação")]
    cards = dossier.cards(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r.doc: r for r in dossier.dossiers(cards, dossier.reference_edges(cards)).collect()}
    assert [rows[i].kind for i in (1, 2, 3, 4)] == ["Edital", "Contrato", "Termo aditivo", "Ofício"]
    assert [rows[i].dossier for i in (1, 2, 3, 4)] == [1, 1, 1, 4]
    missing = dossier.missing_numbers(cards.withColumn("g", F.lit(1)), "g", "amendment")
    assert sorted(r.missing for r in missing.collect()) == [1, 2]


def test_inventory(spark):
    listed = [("backup/a.csv", "x;y"), ("a.csv", "x;y"), ("~$t.xlsx", "z"), ("e.txt", " "), (".env", "password=1"), ("n.txt", "olá"), ("p.bin", "?")]
    got = {r.path: r for r in inventory.inventory(spark.createDataFrame(listed, "path string, text string")).collect()}
    assert {p: r.category for p, r in got.items()} == {"backup/a.csv": "duplicata", "a.csv": "dados", "~$t.xlsx": "lixo", "e.txt": "vazio", ".env": "segredo", "n.txt": "documento", "p.bin": "nao_suportado"}
    assert got["backup/a.csv"].copy_of == "a.csv"


def test_inventory_searches_whole_texts_for_secrets(spark):
    filler = "NAME_1 = um valor\n" * 20000
    listed = [(".env", filler + "password=1\n"), ("c.yaml", filler + "x\n"), ("d.ini", filler * 4 + "AKIA" + "A1" * 8)]
    got = {r.path: r.category for r in inventory.inventory(spark.createDataFrame(listed, "path string, text string")).collect()}
    assert got == {".env": "segredo", "c.yaml": "nao_suportado", "d.ini": "segredo"}


def test_readers(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "d.csv").write_bytes("CPF;Município\n012;São João\n".encode("latin-1"))
    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE t (a, b); INSERT INTO t VALUES (1, 'x'), (2, NULL)")
    (tmp_path / "in" / "t.db").write_bytes(db.serialize())
    with zipfile.ZipFile(tmp_path / "in" / "z.zip", "w") as z:
        z.writestr("m.eml", "Subject: Oi\nFrom: a@b.c\n\ncorpo")
    (tmp_path / "in" / "bad.zip").write_bytes(b"no archive")
    found = files.expanded(files.scan(spark, str(tmp_path / "in")))
    rows = {r.path: r for r in found.collect()}
    assert set(rows) == {"sub/d.csv", "t.db", "z.zip", "z.zip/m.eml", "bad.zip"}
    texts = found.filter("path = 'sub/d.csv'").select("path", files.decoded(F.col("content")).alias("text"))
    assert {(r.column, r.value) for r in files.delimited(texts).collect()} == {("cpf", "012"), ("municipio", "São João")}
    cells = files.opened(found.filter("path = 't.db'"), "sqlite").collect()
    assert [(c.line, c.column, c.value) for c in cells] == [(0, "a", "1"), (0, "b", "x"), (1, "a", "2"), (1, "b", None)]
    mail = {c.column: c.value for c in files.opened(found.filter("path like '%.eml'"), "eml").collect()}
    assert mail["Subject"] == "Oi" and mail["body"].strip() == "corpo"
    assert files.opened(found.filter("path = 'sub/d.csv'"), "sqlite").first().error


def test_stream_redaction(spark, tmp_path):
    spark.createDataFrame([(1, LETTER)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = redaction.redacted_stream(stream).writeStream.format("memory").queryName("red").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert "[CPF]" in spark.table("red").first().text
