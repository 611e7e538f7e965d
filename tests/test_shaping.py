import os
import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import crosscheck, domains, dossier, entity, privacy, tables
from recordloom.sources import files, records, sinks


def test_gaps_of_any_numbers(spark):
    rows = [("a", 0), ("b", 2_100_000_000), ("b", 1), ("c", 3), ("c", None), ("d", None), ("e", -4), ("e", 2)]
    rows = spark.createDataFrame(rows, "g string, n long")
    assert sorted(map(tuple, dossier.missing_ranges(rows, "g", "n").collect())) == [("b", 2, 2_099_999_999), ("c", 1, 2), ("e", 1, 1)]
    assert sorted(map(tuple, dossier.missing_numbers(rows.filter("n < 9"), "g", "n").collect())) == [("c", 1), ("c", 2), ("e", 1)]
    assert [r[0] for r in dossier.missing_numbers(rows, "g", "n").filter("g = 'b' AND missing % 1000 = 0").select("missing").limit(3).collect()] == [1000, 2000, 3000]
    sheets = spark.createDataFrame([("a", 1, 10), ("a", 2, 3), ("a", 12, 12), ("a", 12, 12)], "g string, lo int, hi int")
    assert [tuple(r) for r in dossier.sheet_gaps(sheets, "g").collect()] == [("a", 11, 11)]


def test_zero_quantities_and_prices(spark):
    rows = spark.createDataFrame([(100.0, 0.0, 2.0), (100.0, 1.0, 0.0), (200.0, 1.0, 2.0)], "total double, qty double, price double")
    assert domains.in_cents(rows, "total", "qty", "price").first().ratio == 100.0


@pytest.mark.parametrize("name_bytes", [4 << 20, 60])
def test_names_as_plain_search(spark, name_bytes):
    rng = random.Random(4)
    word = lambda: rng.choice("ana bia maria silva de souza lima jose neto".split())
    names = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(60)] + [None, "", "José Neto"]
    texts = [(i, ", ".join(" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(8))) for i in range(40)] + [(40, None), (41, ""), (42, "Sr. JOSÉ  neto!")]
    got = entity.mentions(spark.createDataFrame(texts, "doc int, text string"), spark.createDataFrame([(n,) for n in names], "name string"), name_bytes)
    plain = lambda t: " ".join(w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower().replace("é", "e")).split())
    want = {(d, plain(n)) for d, t in texts for n in names if " " in plain(n) and f" {plain(n)} " in f" {plain(t)} "}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_findings_tell_their_place_and_show_no_value(spark):
    text = "Contato: ana.lima@mail.com\nCPF 529.982.247-25, de novo 529.982.247-25\n\fsenha: 52998224725abc, CPF 529.982.247-25"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\f\f")], "doc_id long, text string")
    rows = privacy.findings(docs).collect()
    pages = text.split("\f")
    for r in rows:
        assert pages[r.page - 1][r.start : r.end] == r.value and r.value not in r.context and r.value not in r.masked
    assert {(r.page, r.kind, r.start) for r in rows if r.kind == "CPF"} == {(1, "CPF", 31), (2, "CPF", 7), (2, "CPF", 27)}  # the first one on page 2 is a part of the password
    assert {(r.within, r.context) for r in rows if r.page == 2 and r.start == 7} == {("Senha/segredo em texto puro", "senha: [SENHA/SEGREDO EM TEXTO PURO], CPF [CPF]"), (None, "senha: [SENHA/SEGREDO EM TEXTO PURO], CPF [CPF]")}
    found = privacy.risk(privacy.findings(docs), docs.select(F.col("doc_id").alias("origin")))
    assert {r.origin: (r.level, r.n_findings) for r in found.collect()} == {1: ("CRÍTICO", len(rows)), 2: ("BAIXO", 0), 3: ("BAIXO", 0), 4: ("BAIXO", 0)}


def test_overlapping_findings_leave_no_part_of_a_secret(spark):
    text = "x" * 150 + " token = aebccd11987654321c759 " + "y" * 150
    rows = privacy.findings(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert any(r.within for r in rows) or len(rows) == 1
    assert all("aebccd" not in r.context and "c759" not in r.context and len(r.context) <= 200 for r in rows)


def test_conflicts_of_documents(spark):
    people = spark.createDataFrame([(1, "Ana Lima", "529.982.247-25", "(61) 91234-5678"), (2, "Bia Reis", "111.444.777-35", None), (3, None, None, None)], "id long, name string, cpf string, phone string")
    said = "Ana Lima CPF 11144477735\r\nBia Reis, 000.000.000-00\nana lima tel (61) 91234-5678 e (61) 99999-0000\nninguém 123.456.789-09 "
    got = crosscheck.conflicts(spark.createDataFrame([(7, said), (8, None), (9, "")], "doc long, text string"), people).collect()
    assert {(r.line, r.person, r.field, r.situation) for r in got} == {
        (1, "1", "cpf", crosscheck.OTHERS), (2, "2", "cpf", crosscheck.TEST), (2, "2", "cpf", crosscheck.INVALID), (3, "1", "telefone", crosscheck.OTHER_PHONE), (4, "", "cpf", crosscheck.TEST),
    }
    assert not any(ch in (r.found + r.registered) for r in got for ch in ("529", "91234"))


def test_variant_schemas(spark):
    texts = [("a", '{"id": 1, "x": 2}\n{"id": "b"}\nbroken'), ("b", '{"nome_id": 3, "id": null}'), ("c", "[1]\n3"), ("d", '{"id": 1, "outro_id": "x"}')]
    lines, _ = files.json_lines(spark.createDataFrame(texts, "path string, text string"))
    got = {r.path: (r.n_records, r.n_schemas, r.mixed_ids) for r in records.schemas(lines, "path").collect()}
    assert got == {"a": (2, 2, "id: número, texto"), "b": (1, 1, None), "c": (2, 0, None), "d": (1, 1, "id: número; outro_id: texto")}


def test_package_is_whole_or_not_there(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "p"), (2, None, "q")], "id long, obs string, senha string")
    path = str(tmp_path / "pack")
    told = sinks.package({"t": df, "u": df.limit(0)}, path, "parquet").collect()
    assert {(r.table, r.n_rows, r.n_columns, r.filled["obs"]) for r in told} == {("t", 2, 2, 1), ("u", 0, 2, 0)}
    assert spark.read.parquet(f"{path}/t").columns == ["id", "obs"] and os.listdir(tmp_path) == ["pack"]
    with pytest.raises(FileExistsError):
        sinks.package({"t": df}, path)
    with pytest.raises(Exception):  # noqa: B017
        sinks.package({"t": df.withColumn("id", F.raise_error("no"))}, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
    assert [sinks.readable("a/b?" + "x" * 40, set()), sinks.readable("t", {"T", "t_2"}), sinks.readable("", set())] == ["a_b_" + "x" * 24, "t_3", "aba"]


def test_roles_by_matching():
    roles = entity.assigned_roles(["cod", "codigo", "vlr_total", "data_pedido", "obs", "nome_mae", "nome"])
    assert roles["nome"] == "nome" and roles["valor"] == "vlr_total" and roles["data"] == "data_pedido" and roles["id"] in ("cod", "codigo")
    assert len(set(roles.values())) == len(roles) and "obs" not in roles.values()


def test_side_registries_and_phones(spark):
    rows = spark.createDataFrame([("feira/a.csv", "ana", "A@x.com", "sim"), ("rh/b.csv", "bia", None, None), ("base.csv", "caio", None, "sim")], "path string, nome string, email string, optin string")
    got = {(r.kind, r.name, r.email, r.consent, r.may_contact[:3]) for r in entity.side_registry(rows).collect()}
    assert got == {("leads", "Ana", "a@x.com", "sim", "sim"), ("colaboradores", "Bia", None, "não informado", "NÃO")}
    assert {r.may_contact for r in entity.side_registry(rows.drop("optin")).collect()} == {None}
    people = spark.createDataFrame([(1, "5566-7788", 100, 1, "a", 1), (1, "+5561912345678", 50, 1, "b", 1), (2, None, 1, 1, "a", 2)], "cluster long, phone string, priority int, quality int, source string, line long")
    assert [tuple(r) for r in entity.golden_phone(people).collect()] == [(1, "+5561912345678")]
    status = spark.createDataFrame([("Excluído",), ("ativo",), (None,)], "s string")
    assert [r[0] for r in status.select(entity.inactive(F.col("s"))).collect()] == [True, False, False]


def test_tidied_tables(spark):
    df = spark.createDataFrame([("cafÃ©", None, " "), ("TOTAL", "9", None), (None, None, ""), ("chá", "1", "-")], "a string, b string, c string")
    assert sorted(map(tuple, tables.tidied(df).collect()), key=str) == sorted([("café", None), ("chá", "1")], key=str)
