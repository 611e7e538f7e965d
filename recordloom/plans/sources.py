"""Queries of the readers, over files that Spark derives from the given tables."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.sources import files, office, records, sinks
from recordloom.tables import shared_dir, spread, table

QUERIES: dict = {}
SQL: dict = {}
C = F.col


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: A file of the derived ones holds the rows of a thousand keys, so their number grows with the table and not their size.
_FILE = lambda key: F.floor(C(key) / 1000).cast("string")


@query(
    "csv_cells",
    """SELECT n || '.csv' AS path, "column", value FROM (SELECT (c_custkey // 1000)::VARCHAR AS n, c_custkey::VARCHAR AS id, 'de "' || c_name || '"; ' || c_nationkey || chr(10) || 'fim' AS nome_completo, c_mktsegment AS area FROM customer) UNPIVOT (value FOR "column" IN (id, nome_completo, area))""",
)
def csv_cells(spark, sf_dir):
    """Cells with separators, quotes and line breaks inside quotes."""
    name = F.concat(F.lit('"de ""'), C("c_name"), F.lit('""; '), C("c_nationkey").cast("string"), F.lit('\nfim"'))
    line = F.concat_ws(";", C("c_custkey").cast("string"), name, "c_mktsegment")
    rows = table(spark, sf_dir, "customer").groupBy(_FILE("c_custkey").alias("f")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    texts = rows.select(F.concat("f", F.lit(".csv")).alias("path"), F.concat(F.lit("Id;Nome Completo;Área\n\n"), "body").alias("text"))
    return files.delimited(texts).select("path", "column", "value")


@query("encodings", "SELECT doc_id, sha256(coalesce(text, '') || ' preço € 5') AS sha256 FROM documents")
def encodings(spark, sf_dir):
    """Every text in one of four encodings, told without being told which."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" preço € 5"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    fits = C("t").rlike("^[\\x{00}-\\x{7F}\\x{A0}-\\x{FF}€]*$")
    narrow = F.encode(F.translate("t", "€", "\x80"), "ISO-8859-1")
    kind = F.pmod(C("doc_id"), F.lit(4))
    wide = F.when(kind == 0, F.concat(F.lit(b"\xff\xfe"), F.encode("t", "UTF-16LE"))).when(kind == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("t", "UTF-8")))
    content = wide.when((kind == 2) & fits, F.when(fits, narrow)).otherwise(F.encode("t", "UTF-8"))
    return rows.select("doc_id", F.sha2(files.decoded(content), 256).alias("sha256"))


@query("jsonl_records", "SELECT count(*) FILTER (event_id % 13 <> 0) AS n_records, count(*) FILTER (event_id % 13 = 0) AS n_broken FROM events")
def jsonl_records(spark, sf_dir):
    line = F.when(C("event_id") % 13 == 0, F.concat(F.lit("{broken "), "props")).otherwise(C("props"))
    texts = table(spark, sf_dir, "events").groupBy(_FILE("event_id").alias("path")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    good, broken = files.json_lines(texts)
    bad = broken.agg(F.coalesce(F.sum(F.size("broken")), F.lit(0)).alias("n_broken"))
    return good.agg(F.count("*").alias("n_records")).crossJoin(bad)


@query("json_records", "SELECT event_id::VARCHAR AS id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events UNION ALL SELECT NULL, 'not JSON', NULL FROM (SELECT DISTINCT event_id // 1000 AS f FROM events) WHERE f % 4 = 3")
def json_records(spark, sf_dir):
    """Files with an array, with an object that holds a list, with an object alone, and broken ones."""
    f = F.floor(C("event_id") / 1000)
    one = F.concat(F.lit('{"id": '), C("event_id").cast("string"), F.lit(', "kind": "'), "event_type", F.lit('", "props": '), "props", F.lit("}"))
    rows = table(spark, sf_dir, "events").select(f.alias("f"), "event_id", one.alias("one"))
    listed = rows.groupBy("f").agg(F.array_join(F.collect_list("one"), ", ").alias("all"))
    held = F.when(C("f") % 2 == 0, F.concat(F.lit("["), "all", F.lit("]"))).otherwise(F.concat(F.lit('{"total": 3, "dados": ['), "all", F.lit('], "outros": [1]}')))
    texts = listed.select(C("f").cast("string").alias("path"), held.alias("text"))
    texts = texts.union(listed.filter("f % 4 = 3").select(F.concat(C("f").cast("string"), F.lit("-broken")), F.lit('{"dados": [')))
    got = files.json_records(texts)
    field = lambda path: F.get_json_object("record", path)
    return got.select(field("$.id").alias("id"), F.coalesce("error", field("$.kind")).alias("kind"), field("$.props.k").alias("k"))


@query("hidden_csv", """SELECT c_custkey AS k, "column", value FROM (SELECT c_custkey, c_custkey::VARCHAR AS id, c_name AS nome, c_mktsegment AS area FROM customer) UNPIVOT (value FOR "column" IN (id, nome, area))""")
def hidden_csv(spark, sf_dir):
    """A delimited text in base64 inside a nested field of each record."""
    text = F.concat(F.lit("id;nome;area\n"), F.concat_ws(";", C("c_custkey").cast("string"), "c_name", "c_mktsegment"))
    made = F.concat(F.lit('{"x": {"anexo": {"dados": "'), F.base64(F.encode(text, "UTF-8")), F.lit('"}}, "y": "curto"}'))
    leaves = files.flattened(table(spark, sf_dir, "customer").select("c_custkey", made.alias("j")), "c_custkey", "j")
    cells = files.delimited(files.hidden_tables(leaves, "c_custkey"))
    return cells.select(F.split("path", "__")[0].cast("long").alias("k"), "column", "value")


@query(
    "xml_rows",
    """SELECT p_partkey AS k, "column", value FROM (SELECT p_partkey, p_partkey::VARCHAR AS codigo, p_name AS dados_nome, p_brand AS dados_marca_sigla, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS tipo FROM part)
        UNPIVOT INCLUDE NULLS (value FOR "column" IN (codigo, dados_nome, dados_marca_sigla, tipo))""",
)
def xml_rows(spark, sf_dir):
    """Rows with attributes, nested elements and empty ones, between children of another tag."""
    p = lambda c: F.replace(F.replace(C(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = F.concat(
        F.lit('<peca codigo="'), C("p_partkey").cast("string"), F.lit('"><dados><nome>'), p("p_name"), F.lit('</nome><marca sigla="'), p("p_brand"), F.lit('"/></dados><tipo>'),
        F.when(C("p_partkey") % 3 == 0, "").otherwise(p("p_type")), F.lit("</tipo></peca>"),
    )
    made = table(spark, sf_dir, "part").groupBy(_FILE("p_partkey").alias("path")).agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><catalogo><aviso>x</aviso>'), "rows", F.lit("</catalogo>"))
    cells = files.opened(made.select("path", F.encode(text, "UTF-8").alias("content")), "xml")
    key = F.max(F.when(C("column") == "codigo", C("value"))).over(Window.partitionBy("path", "line")).cast("long")
    marca = C("column") == "dados_marca"  # the empty element beside its attribute
    return cells.filter(~marca).select(key.alias("k"), "column", "value")


@query(
    "read_any",
    """SELECT path, count(*) AS n, count(value) AS n_values, count(error) AS n_errors FROM (
        SELECT doc_id || '.' || e AS path, CASE WHEN e <> 'bin' THEN 'x' END AS value, CASE WHEN e = 'bin' THEN 'x' END AS error
        FROM (SELECT doc_id, ['csv', 'txt', 'json', 'xml', 'eml', 'html', 'bin'][doc_id % 7 + 1] AS e FROM documents), range(CASE WHEN e IN ('csv', 'json', 'xml') THEN 2 WHEN e = 'eml' THEN 6 ELSE 1 END) r(i)) GROUP BY 1""",
)
def read_any(spark, sf_dir):
    """One reader for files of seven kinds, one of them unknown."""
    n = C("doc_id").cast("string")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]+", " ")
    text = (
        F.when(C("doc_id") % 7 == 0, F.concat(F.lit("id,nome\n"), n, F.lit(",\""), plain, F.lit(" x\"\n")))
        .when(C("doc_id") % 7 == 1, F.concat(F.lit("Prezada: recebemos o texto, "), plain))
        .when(C("doc_id") % 7 == 2, F.concat(F.lit('[{"id": '), n, F.lit(', "a": {"b": "'), plain, F.lit('"}}]')))
        .when(C("doc_id") % 7 == 3, F.concat(F.lit("<r><i k='"), n, F.lit("'><b>x "), plain, F.lit("</b></i></r>")))
        .when(C("doc_id") % 7 == 4, F.concat(F.lit("From: a@b.c\nTo: d@e.f\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nSubject: x\n\n"), plain))
        .when(C("doc_id") % 7 == 5, F.concat(F.lit("<html><body><p>x"), plain, F.lit("</p></body></html>")))
        .otherwise(plain)
    )
    kind = F.element_at(F.array(*map(F.lit, ("csv", "txt", "json", "xml", "eml", "html", "bin"))), (C("doc_id") % 7 + 1).cast("int"))
    made = table(spark, sf_dir, "documents").select(F.concat(n, F.lit("."), kind).alias("path"), F.encode(text, "UTF-8").alias("content"))
    return files.read(made).groupBy("path").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.count("error").alias("n_errors"))


@query("json_flatten", "SELECT event_id, 'outer.k' AS name, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'kind', event_type FROM events")
def json_flatten(spark, sf_dir):
    made = F.concat(F.lit('{"outer": '), "props", F.lit(', "kind": "'), "event_type", F.lit('"}'))
    return files.flattened(table(spark, sf_dir, "events").select("event_id", made.alias("j")), "event_id", "j")


_TAGS = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<nav\\b.*?</nav\\s*>|<footer\\b.*?</footer\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query("html_text", f"SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace({_TAGS}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS sha256 FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(files.html_text(C("html")), 256).alias("sha256"))


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc_id, text in zip(batch.doc_id, batch.text):
            inner, outer = io.BytesIO(), io.BytesIO()
            with zipfile.ZipFile(inner, "w") as z:
                z.writestr("deep.txt", text or "")
            with zipfile.ZipFile(outer, "w") as z:
                z.writestr("ação.txt", text or "")
                z.writestr("in.zip", inner.getvalue())
            yield pd.DataFrame({"path": [f"{doc_id}.zip"], "content": [outer.getvalue()]})


@query("zip_expand", "SELECT doc_id || '.zip/' || f AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents, (VALUES ('ação.txt'), ('in.zip/deep.txt')) t(f)")
def zip_expand(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(_zipped, "path string, content binary")
    return files.expanded(made).filter(C("path").endswith(".txt")).select("path", F.octet_length("content").cast("long").alias("n_bytes"))


@query("sql_dump_rows", "SELECT \"column\", count(*) AS n, count(value) AS n_values FROM (SELECT s_suppkey::VARCHAR AS id, s_name AS nome, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'o''brien' END AS nota FROM supplier) UNPIVOT INCLUDE NULLS (value FOR \"column\" IN (id, nome, nota)) GROUP BY 1")
def sql_dump_rows(spark, sf_dir):
    note = F.when(C("s_suppkey") % 3 == 0, "NULL").otherwise("'o''brien'")
    row = F.concat(F.lit("("), C("s_suppkey").cast("string"), F.lit(", '"), "s_name", F.lit("', "), note, F.lit(")"))
    dumps = table(spark, sf_dir, "supplier").groupBy(_FILE("s_suppkey").alias("f")).agg(F.concat(F.lit("INSERT INTO f (id, nome, nota) VALUES "), F.array_join(F.collect_list(row), ", "), F.lit(";")).alias("t"))
    cells = files.opened(dumps.select(F.concat("f", F.lit(".sql")).alias("path"), F.encode("t", "UTF-8").alias("content")), "sql")
    return cells.groupBy("column").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
_BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="vendas" sheetId="1" r:id="a"/><sheet name="rascunho" sheetId="2" state="hidden" r:id="b"/></sheets></workbook>'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>'


def _workbook(rows: list) -> bytes:
    """A title, a header, rows with a shared product formula and a running sum, a row of sums, and a hidden draft; no formula has a result."""
    text = lambda at, s: f'<c r="{at}" t="inlineStr"><is><t>{s}</t></is></c>'
    body = [f'<row r="1">{text("A1", "Relatório de vendas")}</row>']
    body.append('<row r="3">' + "".join(text(f"{c}3", s) for c, s in zip("ABCDEF", ("Pedido", "Linha", "Qtd", "Preço", "Total", "Acumulado"))) + "</row>")
    for r, x in enumerate(rows, 4):
        product = '<f t="shared" ref="E4:E9" si="0">C4*(D4+0)</f>' if r == 4 else '<f t="shared" si="0"/>'
        running = "E4" if r == 4 else f"F{r - 1}+E{r}"
        body.append(f'<row r="{r}">' + "".join(f'<c r="{c}{r}"><v>{v}</v></c>' for c, v in zip("ABCD", x)) + f'<c r="E{r}">{product}</c><c r="F{r}"><f>{running}</f></c></row>')
    last = len(rows) + 3
    body.append(f'<row r="{last + 1}"><c r="C{last + 1}"><f>SUM(C4:C{last})</f></c><c r="E{last + 1}"><f>SUM($E$4:$E${last})</f></c></row>')
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", _BOOK)
        z.writestr("xl/_rels/workbook.xml.rels", _RELS)
        z.writestr("xl/worksheets/s1.xml", _SHEET.format("".join(body)))
        z.writestr("xl/worksheets/s2.xml", _SHEET.format(f'<row r="2">{text("B2", "rever")}<c r="C2"><f>C2+1</f></c></row>'))
    return held.getvalue()


def _books(spark, sf_dir):
    """A workbook for the lines of a thousand order keys."""
    row = F.struct("l_orderkey", "l_linenumber", C("l_quantity").cast("long").alias("q"), F.round(C("l_extendedprice") * 100).cast("long").alias("p"))
    rows = table(spark, sf_dir, "lineitem").groupBy(_FILE("l_orderkey").alias("path")).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rows in zip(batch.path, batch.rows):
                yield pd.DataFrame({"path": [f"{path}.xlsx"], "content": [_workbook([(r["l_orderkey"], r["l_linenumber"], r["q"], r["p"]) for r in rows])]})

    return rows.repartition(2 * spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "path string, content binary")


_LINES = "SELECT l_orderkey // 1000 || '.xlsx' AS path, l_orderkey AS pedido, l_linenumber AS linha, l_quantity::BIGINT AS qtd, round(l_extendedprice * 100)::BIGINT AS preco, row_number() OVER w + 3 AS line FROM lineitem WINDOW w AS (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT)"


@query(
    "sheet_formulas",
    f"""WITH r AS ({_LINES}), s AS (SELECT *, qtd * preco AS total, sum(qtd * preco) OVER (PARTITION BY path ORDER BY line) AS acumulado FROM r)
        SELECT path, line, "column", value FROM (SELECT path, line, pedido::BIGINT AS pedido, linha::BIGINT AS linha, qtd, preco, total::BIGINT AS total, acumulado::BIGINT AS acumulado FROM s) UNPIVOT (value FOR "column" IN (pedido, linha, qtd, preco, total, acumulado))""",
)
def sheet_formulas(spark, sf_dir):
    """Cells of workbooks whose products and running sums have no stored result; the row of sums is gone."""
    cells, _ = office.sheet_tables(office.sheets(_books(spark, sf_dir)))
    return cells.select("path", "line", "column", C("value").cast("long").alias("value"))


@query(
    "sheet_info",
    "SELECT l_orderkey // 1000 || '.xlsx' AS path, 'vendas' AS part, false AS hidden, false AS draft, 3 AS header_line, 'Relatório de vendas' AS title, 2 * count(*) AS n_computed FROM lineitem GROUP BY 1 UNION ALL SELECT DISTINCT l_orderkey // 1000 || '.xlsx', 'rascunho', true, true, NULL, NULL, 0 FROM lineitem",
)
def sheet_info(spark, sf_dir):
    """Where the header of each sheet is, what stands above, and which sheets are hidden or drafts."""
    return office.sheet_tables(office.sheets(_books(spark, sf_dir)))[1].withColumn("title", F.when(~C("draft"), C("title")))


@query(
    "page_tables",
    """WITH w AS (SELECT page_id, list_transform(range(1, 5), lambda i: coalesce(regexp_extract_all(html, '<a href="/([A-Za-z]+)', 1)[i], '-')) AS x FROM pages)
        SELECT page_id, 1 AS "table", line::INT AS line, i::INT AS i, CASE i WHEN 2 THEN 'Página' ELSE 'Links' END AS "column", CASE i WHEN 2 THEN page_id::VARCHAR || ' & co' WHEN 0 THEN x[[1, 1, 4][line]] WHEN 1 THEN CASE line WHEN 3 THEN NULL ELSE x[line + 1] END END AS value
        FROM w, (SELECT unnest([1, 2, 3]) AS line), (SELECT unnest([0, 1, 2]) AS i)""",
)
def page_tables(spark, sf_dir):
    """A table of each page's first links, with cells over several rows and columns and end tags left out."""
    links = F.regexp_extract_all("html", F.lit('<a href="/([A-Za-z]+)'), F.lit(1))
    word = lambda n: F.coalesce(F.get(links, F.lit(n)), F.lit("-"))
    page = C("page_id").cast("string")
    said = F.concat(
        F.lit("<TABLE class=x><tr><th colspan='2'>Links</th><th>P&aacute;gina</th></tr><tr><td rowspan=2><b>"), word(0), F.lit("</b><td>\n "), word(1), F.lit("<script>var a = 1;</script><td>"), page, F.lit(" &amp; co</tr><tr><td>"), word(2), F.lit("</td><td>"), page,
        F.lit("\n&amp; co<tr><td>"), word(3), F.lit("<td></td><td>"), page, F.lit(" &amp; <i>co</i></td></tr></TABLE><table><tr><td>too small</td></tr></table>"),
    )
    return office.document_tables(table(spark, sf_dir, "pages").select("page_id", F.concat("html", said).alias("html")), "html", "page_id", "html")


def _packed(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch.text:
                if kind == "docx":
                    said = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in (text or "").split("\n"))
                    held = io.BytesIO()
                    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{said}</w:body></w:document>')
                    out.append(held.getvalue())
                else:
                    said = re.sub(r"([\\{}])", r"\\\1", text or "")
                    said = re.sub("[^\x00-\x7f]", lambda m: "".join(f"\\u{int.from_bytes(m[0].encode('utf-16-le')[i : i + 2], 'little', signed=True)}?" for i in range(0, len(m[0].encode("utf-16-le")), 2)), said)
                    out.append((r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 " + said.replace("\n", "\\par\n") + "}").encode("latin-1"))
            yield pd.DataFrame({"doc_id": batch.doc_id, "content": out})

    return run


@query("docx_text", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def docx_text(spark, sf_dir):
    """Every text out of a word-processor document again."""
    made = spread(table(spark, sf_dir, "documents")).select("doc_id", "text").mapInPandas(_packed("docx"), "doc_id long, content binary")
    return office.document_text(made, "docx", "doc_id", "content").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("rtf_text", "SELECT doc_id, sha256(trim(coalesce(text, ''), chr(10))) AS sha256 FROM documents")
def rtf_text(spark, sf_dir):
    """Every text out of an RTF file again, without line breaks at its ends."""
    made = spread(table(spark, sf_dir, "documents")).select("doc_id", "text").mapInPandas(_packed("rtf"), "doc_id long, content binary")
    return office.document_text(made, "rtf", "doc_id", "content").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    "record_schemas",
    """SELECT (event_id // 1000)::VARCHAR AS path, count(*) AS n_records, count(DISTINCT event_id % 3 = 0) AS n_schemas,
        CASE WHEN count(*) FILTER (event_id % 1999 = 5) > 0 THEN 'event_id: número, texto; user_id: número' END AS mixed_ids,
        'OBJECT<event_id: ' || CASE WHEN count(*) FILTER (event_id % 1999 = 5) = 0 THEN 'BIGINT' WHEN count(*) FILTER (event_id % 1999 <> 5) > 0 THEN 'VARIANT' ELSE 'STRING' END || CASE WHEN count(*) FILTER (event_id % 3 = 0) > 0 THEN ', extra: ARRAY<STRING>' ELSE '' END || ', kind: STRING, user_id: BIGINT>' AS schema
        FROM events GROUP BY 1""",
)
def record_schemas(spark, sf_dir):
    """Files of JSON lines: sets of fields, the schema of all, and ids that are numbers here and texts there."""
    key = C("event_id").cast("string")
    one = F.concat(
        F.lit('{"event_id": '), F.when(C("event_id") % 1999 == 5, F.concat(F.lit('"E'), key, F.lit('"'))).otherwise(key), F.lit(', "user_id": '), C("user_id").cast("string"), F.lit(', "kind": "'), "event_type", F.lit('"'),
        F.when(C("event_id") % 3 == 0, F.lit(', "extra": ["a"]}')).otherwise(F.lit("}")),
    )
    texts = table(spark, sf_dir, "events").groupBy(_FILE("event_id").alias("path")).agg(F.array_join(F.collect_list(one), "\n").alias("text"))
    return records.schemas(files.json_lines(texts)[0], "path")


@query(
    "package_manifest",
    'SELECT \'clientes\' AS "table", count(*) AS n_rows, 3 AS n_columns, count(*) AS n_read, count(*) FILTER (c_custkey % 3 <> 0) AS n_filled FROM customer UNION ALL SELECT \'pedidos\', count(*), 3, count(*), count(*) FILTER (o_orderkey % 5 <> 0) FROM orders',
)
def package_manifest(spark, sf_dir):
    """A package with a partitioned table: what the manifest says beside what is read back; a password column stays out."""
    people = table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), C("c_name").alias("nome"), F.when(C("c_custkey") % 3 != 0, C("c_mktsegment")).alias("obs"), F.lit("x").alias("senha"))
    orders = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), F.when(C("o_orderkey") % 5 != 0, C("o_custkey")).alias("obs"), F.year("o_orderdate").alias("ano"))
    path = f"{shared_dir(spark)}/package-{uuid.uuid4().hex}"
    told = sinks.package({"clientes": people, "pedidos": orders}, path, "parquet", {"pedidos": ("ano",)})
    back = sinks.summary({n: spark.read.parquet(f"{path}/{n}") for n in ("clientes", "pedidos")}).select("table", C("n_rows").alias("n_read"))
    return told.join(back, "table").select("table", "n_rows", "n_columns", "n_read", F.element_at("filled", "obs").alias("n_filled"))
