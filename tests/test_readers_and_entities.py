"""Readers on odd files, and entity operators against plain twins."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators import domains, entity, privacy
from recordloom.sources import files


def cells(df):
    return {(r.path, r.line, r.column): r.value for r in df.collect()}


def test_quoted_cells_and_headers(spark):
    texts = [
        ("a", 'x;y;z\n1;"p;q";"say ""hi"""\n2;"two\nlines";\n'),
        ("b", "Relatório mensal\n\nid,nome,cidade\n1,Ana,Recife\n"),
        ("c", "1;2\n3;4\n"),  # no header: the first row is taken
        ("d", 'a;b\n5" tube;x\n'),  # a quote alone is a character
    ]
    got = {}
    for path, _, column, value in sorted(files.delimited(spark.createDataFrame(texts, "path string, text string")).collect(), key=lambda r: (r.path, r.line)):
        got.setdefault(path, []).append((column, value))
    assert got["a"] == [("x", "1"), ("y", "p;q"), ("z", 'say "hi"'), ("x", "2"), ("y", "two\nlines"), ("z", None)]
    assert got["b"] == [("id", "1"), ("nome", "Ana"), ("cidade", "Recife")]
    assert [v for _, v in got["c"]] == ["3", "4"]
    assert got["d"] == [("a", '5" tube'), ("b", "x")]


def test_encodings(spark):
    text = "preço € 5 – ação"
    made = [(i, text.encode(e)) for i, e in enumerate(("cp1252", "utf-8", "utf-8-sig", "utf-16", "utf-16-le"))] + [(9, b"")]
    out = {r.i: r.t for r in spark.createDataFrame(made, "i int, b binary").select("i", files.decoded(F.col("b")).alias("t")).collect()}
    assert {i: out[i] for i in range(5)} == dict.fromkeys(range(5), text) and out[9] == ""
    broken = spark.createDataFrame([("preÃ§o",), ("â‚¬ 5",), ("ação",), (None,)], "t string").select(T.repaired(F.col("t")).alias("t"))
    assert [r.t for r in broken.collect()] == ["preço", "€ 5", "ação", None]


def test_xml_rows_are_the_most_common_children(spark):
    text = "<fornecedores><meta>x</meta><fornecedor id='1'><codigo>7</codigo><sede uf='PE'>Recife</sede><nada/></fornecedor><fornecedor id='2'><codigo>8</codigo></fornecedor></fornecedores>"
    rows = [("a", text.encode()), ("tie", b"<r><b>1</b><a>2</a></r>"), ("bad", b"<r><b>"), ("none", b"<r/>")]
    got = files.opened(spark.createDataFrame(rows, "path string, content binary"), "xml").collect()
    assert {(r.line, r.column, r.value) for r in got if r.path == "a"} == {(0, "id", "1"), (0, "codigo", "7"), (0, "sede", "Recife"), (0, "sede_uf", "PE"), (0, "nada", None), (1, "id", "2"), (1, "codigo", "8")}
    assert [r.part for r in got if r.path == "tie"] in ([], ["b"])
    assert [r.error is not None for r in got if r.path == "bad"] == [True] and not [r for r in got if r.path == "none"]


def test_json_shapes(spark):
    texts = [("list", '[{"a": 1}, 5, {"a": {"b": {"c": [1]}}}]'), ("held", '{"n": 1, "z": [{"a": 2}], "b": [{"a": 3}]}'), ("one", '{"a": 4}'), ("bad", "{"), ("empty", "[]")]
    got = files.json_records(spark.createDataFrame(texts, "path string, text string"))
    assert sorted((r.path, r.record, r.error is None) for r in got.collect() if r.path != "bad") == [("held", '{"a":2}', True), ("list", '{"a":1}', True), ("list", '{"a":{"b":{"c":[1]}}}', True), ("one", '{"a": 4}', True)]
    assert [r.error for r in got.collect() if r.path == "bad"] == ["not JSON"]
    leaves = files.flattened(got.filter("path = 'list'").select("path", "record"), "path", "record")
    assert sorted((r.name, r.value) for r in leaves.collect()) == [("a", "1"), ("a.b.c", "[1]")]


def test_archive_limits_hold_over_all_levels(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        for i in range(4):
            z.writestr(f"d{i}.txt", "x")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("last.txt", "y")
    rows = spark.createDataFrame([("a.zip", outer.getvalue())], "path string, content binary")
    assert files.expanded(rows).filter("error is null").count() == 7
    some = files.expanded(rows, max_files=3).collect()
    assert sum(r.error is not None for r in some) >= 1 and sum(r.path.endswith(".txt") for r in some if r.error is None) == 2


def test_prose_is_no_table(spark):
    rows = [("a;b\n1;2\n3;4", True), ("Fulano: precisa melhorar, afastado\nBeltrano: faltou muito, avisado", False), ("uma linha só", False), ("a tarde foi longa e quente, e a noite veio\no dia seguinte foi muito frio, e choveu", False)]
    out = spark.createDataFrame(rows, "t string, want boolean").select(files.is_table(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in out)


def test_long_names_are_found(spark):
    texts = spark.createDataFrame([(1, "Compareceu Ana Maria da Silva Souza Lima ontem"), (2, "Ana Maria"), (3, None)], "doc long, text string")
    people = spark.createDataFrame([("Ana Maria da Silva Souza Lima",), ("ANA MARIA",), ("Bia",), (None,)], "name string")
    got = {(r.doc, r.name_key) for r in entity.mentions(texts, people).collect()}
    assert got == {(1, "ana maria da silva souza lima"), (1, "ana maria"), (2, "ana maria")}


def test_table_kinds():
    assert entity.table_kind(["id_cliente", "nome", "cpf", "email_2"]) == ("pessoas", {"id": ["id_cliente"], "nome": ["nome"], "cpf": ["cpf"], "email": ["email_2"]})
    kind, roles = entity.table_kind(["pedido_id", "cliente_cpf", "total", "obs"])
    assert kind == "transacoes" and roles == {"id": ["pedido_id"], "cliente_ref": ["cliente_cpf"], "valor": ["total"]}
    assert entity.table_kind(["sku", "qtd"])[0] == "outra"


def test_transactions_without_a_reference(spark):
    index = spark.createDataFrame([], "kind string, key string, n long, cluster long")
    rows = spark.createDataFrame([("7", "R$ 1,50", "x", 1)], "pedido string, valor string, row_number string, i int")
    row = entity.transactions(rows, "venda", index).first()
    assert (row.venda_id, row.value, row.cluster, row.row_number, row.i) == ("7", 1.5, None, "x", 1)


def test_clusters_match_a_plain_union_find(spark):
    rng = random.Random(3)
    cpfs = ["529.982.247-25", "111.444.777-35", "390.533.447-05", None]
    person = lambda line: (line, str(rng.randint(1, 6)) if rng.random() < 0.7 else None, rng.choice(["Ana Lima", "Ana L Lima", "Bia Reis", "Caio Dias", None]), rng.choice(cpfs), rng.choice(["a@x.com", "b@x.com", None, None]), None, None, None)
    shape = "line long, id string, name string, cpf string, email string, phone string, birth string, city string"
    people = entity.records([(s, p, spark.createDataFrame([person(i) for i in range(12)], shape)) for s, p in (("a", 100), ("b", 50))]).cache()
    links = sorted(tuple(r) for r in entity.evidence(people).collect())
    held = {r.rid: ({r.source: {r.id}} if r.id else {}, {r.cpf} if r.cpf_ok else set(), {r.rid}) for r in people.collect()}
    at, refused = {r: r for r in held}, set()
    for phase, _, a, b in links:
        x, y = sorted((at[a], at[b]))
        if x == y:
            continue
        ids = held[x][0], held[y][0]
        if any(ids[0][s] != ids[1][s] for s in ids[0].keys() & ids[1].keys()) or (phase == 5 and held[x][1] and held[y][1] and not held[x][1] & held[y][1]):
            refused.add((a, b))
            continue
        held[x] = ({s: ids[0].get(s, set()) | ids[1].get(s, set()) for s in ids[0].keys() | ids[1].keys()}, held[x][1] | held[y][1], held[x][2] | held[y][2])
        at |= dict.fromkeys(held[x][2], x)
    clusters, blocked = entity.clusters(people)
    assert {r.rid: r.cluster for r in clusters.collect()} == at
    assert {(r.a, r.b) for r in blocked.collect()} == refused


def test_medians_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(domains, "SORTED", 100)
    rng = random.Random(1)
    for values in ([rng.random() for _ in range(5001)], [rng.randint(0, 5) * 1.0 for _ in range(4000)], [1.0], [], [2.0, 4.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        v = sorted(values)
        assert domains.median(df, F.col("v")) == ((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None)


def test_dictionary_hides_marked_examples(spark):
    profile = spark.createDataFrame([("cpf", "529"), ("obs", "ok")], "column string, example string")
    marked = spark.createDataFrame([("cpf", "CPF")], "column string, kind string")
    assert {r.column: r.example for r in privacy.dictionary(profile, marked).collect()} == {"cpf": "[oculto]", "obs": "ok"}


def test_people_by_source_order_and_population(spark):
    rows = spark.createDataFrame([("a", 1, "10", "Bia"), ("a", 1, "9", "Ana"), ("a", 2, None, "Caio"), ("b", 2, "x1", None), ("b", 3, "x1", "Davi")], "source string, cluster long, id string, name string")
    assert {r.source: (r.n_rows, r.n_people, r.n_duplicates) for r in entity.source_stats(rows).collect()} == {"a": (3, 2, 1), "b": (2, 2, 0)}
    assert [r.name for r in entity.in_order(rows).collect()] == ["Ana", "Bia", "Caio", "Davi", None]
    kinds = lambda *paths: {r.kind: (r.n, r.main) for r in entity.populations(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert kinds("feira.csv", "feira.csv", "base.csv") == {"leads": (2, False), "clientes": (1, True)}
    assert kinds("feira.csv", "rh/x.csv") == {"leads": (1, False), "colaboradores": (1, True)}
    assert kinds() == {}


def test_each_file_is_made_and_told_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def content(text):
        made.add(1)
        return text.encode()

    some = [("a.csv", "id;nome\n1;Ana\n"), ("b.txt", "uma linha"), ("c.json", '{"a": {"b": 1}}'), ("d.xml", "<a><r><t>1</t></r></a>"), ("e.html", "<p>x</p>"), ("f.bin", "?")]
    rows = spark.createDataFrame(some, "path string, text string").select("path", content("text").alias("content"))
    assert sorted((r.path, r.value) for r in files.read(rows).collect()) == sorted([("a.csv", "1"), ("a.csv", "Ana"), ("b.txt", "uma linha"), ("c.json", "1"), ("d.xml", "1"), ("e.html", "x"), ("f.bin", None)])
    assert made.value == len(some)


def test_headers_of_texts_of_one_name(spark):
    texts = spark.createDataFrame([("a", "x;y\n1;2\n"), ("a", "p;q\n3;4\n"), ("b", "\n" * 20 + "1;2\n")], "path string, text string")
    assert sorted((r.column, r.value) for r in files.delimited(texts).collect()) == [("p", "3"), ("q", "4"), ("x", "1"), ("y", "2")]
