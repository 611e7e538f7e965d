"""Queries of the entity, linking and dossier operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.functions import ids
from recordloom.graph import components
from recordloom.operators import crosscheck, dossier, entity
from recordloom.plans.dirty import TYPE, duck, view
from recordloom.plans.scalars import d_cpf, d_digits, d_name, d_pad
from recordloom.tables import spread, table, written

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


_A = "SELECT k AS line, cast(k AS string) AS id, name, cpf, email, phone, '1980-05-06' AS birth, city FROM people"
_B = "SELECT k AS line, concat('B', cast(k AS string)) AS id, CASE WHEN k % 5 = 0 THEN concat(name, ' Neto') ELSE name END AS name, cpf11 AS cpf, CASE WHEN k % 2 = 0 THEN email END AS email, '-' AS phone, CASE WHEN k % 4 = 0 THEN '06/05/1980' END AS birth, 'São Paulo' AS city FROM people WHERE k % 3 <> 0"
_C = "SELECT k AS line, cast(CASE WHEN k % 50 = 0 THEN k + 1 ELSE k END AS string) AS id, name, NULL AS cpf, email, phone, NULL AS birth, city FROM people WHERE k % 4 = 0"


def _people(spark, sf_dir):
    base = view(spark, sf_dir, "people")
    part = lambda q: spark.sql(q.replace("FROM people", "FROM {people}"), people=base)
    return written(entity.records([("main", 100, part(_A)), ("branch", 80, part(_B)), ("old", 40, part(_C))]), "people")


def _by_cpf(spark, sf_dir):
    return _people(spark, sf_dir).filter("cpf_ok").withColumn("cluster", C("cpf"))


_REC = duck("people") + f""", a AS ({_A}), b AS ({_B}), u AS (SELECT 'main' AS source, 100 AS priority, line, name, cpf FROM a UNION ALL SELECT 'branch', 80, line, name, cpf FROM b),
    n AS (SELECT source, priority, line, {d_name('name')} AS name, {d_pad(d_digits('cpf'), 11)} AS cpf FROM u), r AS (SELECT * FROM n WHERE {d_cpf('cpf')})"""


@query("golden_record", _REC + " SELECT cpf AS cluster, arg_min(name, -priority) AS name, count(*) AS n_records, array_to_string(list_sort(list_distinct(list(source))), ', ') AS sources FROM r GROUP BY 1")
def golden_record(spark, sf_dir):
    return entity.golden(_by_cpf(spark, sf_dir).withColumn("quality", F.lit(0)), ("name",))


@query(
    "entity_conflicts",
    _REC + """, v AS (SELECT cpf, name, array_to_string(list_sort(list_distinct(list(source))), '+') AS s FROM r GROUP BY 1, 2) SELECT cpf AS cluster, 'name' AS field, array_to_string(list_sort(list(name || ' (' || s || ')')), '; ') AS "values" FROM v GROUP BY 1 HAVING count(*) > 1""",
)
def entity_conflicts(spark, sf_dir):
    return entity.conflicts(_by_cpf(spark, sf_dir), ("name",))


@query("cpf_owner", _REC + " SELECT cpf, arg_min(name, (-n, name)) AS name FROM (SELECT cpf, name, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1")
def cpf_owner(spark, sf_dir):
    return entity.cpf_owner(_people(spark, sf_dir), "name")


@query("entity_cluster", None)
def entity_cluster(spark, sf_dir):
    return entity.clusters(_people(spark, sf_dir))[0]


@query("entity_blocked", None)
def entity_blocked(spark, sf_dir):
    return entity.clusters(_people(spark, sf_dir))[1]


@query("people_by_source", _REC + " SELECT source, count(*) AS n_rows, count(DISTINCT cpf) AS n_people, count(*) - count(DISTINCT cpf) AS n_duplicates FROM r GROUP BY 1")
def people_by_source(spark, sf_dir):
    return entity.source_stats(_by_cpf(spark, sf_dir))


_ORIGIN = "CASE c_mktsegment WHEN 'BUILDING' THEN 'feira/' WHEN 'MACHINERY' THEN 'rh/' WHEN 'FURNITURE' THEN 'folha_2024/' ELSE 'cadastro/' END"


@query(
    "populations",
    "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'leads' WHEN 'MACHINERY' THEN 'colaboradores' WHEN 'FURNITURE' THEN 'colaboradores' ELSE 'clientes' END AS kind, count(*) AS n, kind = 'clientes' AS main FROM customer GROUP BY 1",
)
def populations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.expr(_ORIGIN), F.lit("lista.csv")).alias("path"))
    return entity.populations(rows)


@query(
    "entity_components",
    "SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1",
)
def entity_components(spark, sf_dir):
    """Long chains: each customer hangs on the next one of its nation and segment."""
    after = F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    return components(table(spark, sf_dir, "customer").select(C("c_custkey").alias("src"), after.alias("dst")).filter("dst is not null"))


_REF = "CASE k % 5 WHEN 0 THEN upper(concat('p', cast(k AS string), '@mail.com')) WHEN 1 THEN cpf11 WHEN 2 THEN cast(k AS string) WHEN 3 THEN name ELSE concat('Fulano ', cast(k AS string)) END"
_IDX = duck("people") + f""", n AS (SELECT k, {d_name('name')} AS name, cpf11, CASE WHEN email LIKE '%@%' AND NOT contains(email, ' ') THEN replace(lower(email), '@@', '@') END AS email FROM people),
    i AS (SELECT 'email' AS kind, email AS key, k FROM n UNION ALL SELECT 'cpf', cpf11, k FROM n UNION ALL SELECT 'id', k::VARCHAR, k FROM n UNION ALL SELECT 'name', lower(strip_accents(name)), k FROM n UNION ALL SELECT 'first', split_part(lower(strip_accents(name)), ' ', 1), k FROM n),
    g AS (SELECT kind, key, count(DISTINCT k) AS n, min(k) AS k FROM i WHERE key IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT k AS t, {_REF} AS ref FROM people),
    m AS (SELECT t, ref, CASE WHEN contains(ref, '@') THEN 'email' WHEN regexp_full_match(ref, '[0-9]+') AND length(ref) >= 9 THEN 'cpf' WHEN regexp_full_match(ref, '[0-9]+') THEN 'id' ELSE 'name' END AS kind FROM t),
    x AS (SELECT m.*, g.n, g.k FROM m LEFT JOIN g ON g.kind = m.kind AND g.key = CASE m.kind WHEN 'email' THEN lower(ref) WHEN 'name' THEN lower(strip_accents({d_name('ref')})) ELSE ref END)"""


def _linked(spark, sf_dir):
    base = view(spark, sf_dir, "people")
    people = written(entity.records([("main", 100, spark.sql(_A.replace("FROM people", "FROM {people}"), people=base))]), "people").withColumn("cluster", C("line"))
    return entity.linked(base.selectExpr("k AS t", f"{_REF} AS ref"), entity.reference_index(people), "ref")


@query("link_transactions", _IDX + " SELECT t, ref, CASE WHEN n = 1 THEN k END AS cluster, CASE WHEN n = 1 THEN kind END AS method, CASE WHEN n = 1 THEN '' WHEN n > 1 THEN 'nome ambíguo: ' || n || ' clientes homônimos' ELSE 'não encontrado' END AS note FROM x")
def link_transactions(spark, sf_dir):
    return _linked(spark, sf_dir)


@query("unlinked_transactions", _IDX + " SELECT t, ref FROM x WHERE n IS NULL OR n > 1")
def unlinked_transactions(spark, sf_dir):
    return _linked(spark, sf_dir).filter("cluster is null").select("t", "ref")


_TXT = "SELECT doc_id AS doc, concat(head, CASE WHEN doc_id % 3 = 0 THEN concat('O cliente ', n.name, ', CPF ', n.cpf11, ', compareceu.', chr(10)) ELSE '' END, text) AS text FROM docs_headed d LEFT JOIN (SELECT k, trim(regexp_replace(name, '  +', ' ')) AS name, cpf11 FROM people) n ON n.k = d.doc_id % 100"
_TXT_DUCK = _TXT.replace("'  +', ' ')", "'  +', ' ', 'g')")


def _texts(spark, sf_dir):
    q = _TXT.replace("FROM docs_headed", "FROM {docs}").replace("FROM people", "FROM {people}")
    return spread(spark.sql(q, docs=view(spark, sf_dir, "docs_headed"), people=view(spark, sf_dir, "people")))


@query(
    "name_mentions",
    duck("docs_headed", "people") + f""", x AS ({_TXT_DUCK}), k AS (SELECT DISTINCT trim(regexp_replace(lower(strip_accents({d_name('name')})), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM people),
    y AS (SELECT doc, ' ' || trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM x) SELECT doc, name_key FROM y JOIN k ON contains(t, ' ' || name_key || ' ')""",
)
def name_mentions(spark, sf_dir):
    return entity.mentions(_texts(spark, sf_dir), view(spark, sf_dir, "people"))


@query("doc_cpf_join", duck("docs_headed", "people") + f", x AS ({_TXT_DUCK}), f AS (SELECT doc, unnest(regexp_extract_all(text, 'CPF ([0-9]{{11}})', 1)) AS cpf FROM x) SELECT cpf, count(DISTINCT doc) AS n_docs, array_to_string(list_sort(list_distinct(list(doc))), ',') AS docs FROM f WHERE {d_cpf('cpf')} AND cpf IN (SELECT cpf11 FROM people) GROUP BY 1")
def doc_cpf_join(spark, sf_dir):
    return crosscheck.cited(_texts(spark, sf_dir), view(spark, sf_dir, "people").select(C("cpf11").alias("cpf")), "cpf")


def _cards(spark, sf_dir):
    return written(dossier.cards(spread(view(spark, sf_dir, "docs_headed")).withColumn("full", F.concat("head", "text")), "doc_id", "full"), "cards")


_WHEN = f"CASE {TYPE} WHEN 0 THEN 'Edital' WHEN 1 THEN 'Contrato' WHEN 2 THEN 'Nota de empenho' WHEN 3 THEN 'Termo aditivo' WHEN 4 THEN 'Nota fiscal / liquidação' WHEN 5 THEN 'Ordem bancária / pagamento' WHEN 6 THEN 'Termo de referência' WHEN 7 THEN 'Ofício' WHEN 8 THEN 'Ata de registro de preços' ELSE 'Outro' END"
_STAGE = f"CASE {TYPE} WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 6 WHEN 4 THEN 8 WHEN 5 THEN 9 WHEN 6 THEN 1 WHEN 8 THEN 4 ELSE 0 END"
_YEAR = "2010 + doc_id % 15"


def _re2(pattern: str) -> str:
    """A pattern in the syntax of DuckDB's engine, inside an SQL text."""
    return pattern.replace("(?! social)", "").replace("'", "''")


_ANY = "|".join(f"(?:{_re2(p)})" for _, _, p in dossier.TYPES)
_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(m, '(?i)(?:{_re2(p)})') THEN '{kind}'" for kind, _, p in dossier.TYPES) + " ELSE 'Outro' END"
_KIND_STAGE = "CASE kind " + " ".join(f"WHEN '{kind}' THEN {stage}" for kind, stage, _ in dossier.TYPES) + " ELSE 0 END"
_LONG = r"\b\d{1,2}[º°]?\s+de\s+[A-Za-zçÇ]+\s+de\s+\d{4}\b"
_SPOT = lambda x, p: rf"nullif(regexp_extract({x}, '{p}', 1), '')"
_OWN = lambda x: f"(ltrim(split_part(regexp_replace({x}, '\\s', '', 'g'), '/', 1), '0') || '/' || CASE WHEN length(split_part({x}, '/', 2)) = 2 THEN '20' ELSE '' END || trim(split_part({x}, '/', 2)))"


@query(
    "doc_cards",
    duck("docs_headed")
    + rf""", f AS (SELECT doc_id AS doc, head || text AS full_text FROM docs_headed),
        c AS (SELECT *, coalesce(nullif(regexp_extract(substring(full_text, 1, {dossier.HEAD}), '(?i)(?:{_ANY})', 0), ''), regexp_extract(full_text, '(?i)(?:{_ANY})', 0), '') AS m FROM f),
        k AS (SELECT *, {_KIND} AS kind FROM c),
        a AS (SELECT *, CASE WHEN kind = 'Termo aditivo' THEN coalesce({_SPOT(f"substring(full_text, 1, {dossier.HEAD})", r"(?i)(\d+)[ºo°]?\s*(?:\(\w+\)\s*)?termo aditivo")}, {_SPOT(f"substring(full_text, 1, {dossier.HEAD})", r"(?i)termo aditivo\s*(?:n[ºo°.]?\s*|n[úu]mero\s*)?(\d+)")})::INT END AS amendment,
            {_SPOT(f"substring(full_text, 1, {dossier.NUMBER_HEAD})", r"(?i)n[ºo°.]\s*([\d.]+\s*/\s*\d{2,4})")} AS own FROM k)
        SELECT doc, kind, {_KIND_STAGE} AS stage, list_max([try_cast(regexp_extract(x, '(\d{{4}})$', 1) || '-' || list_position(['janeiro', 'fevereiro', 'marco', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro'], strip_accents(lower(regexp_extract(x, 'de\s+([A-Za-zçÇ]+)\s+de', 1)))) || '-' || regexp_extract(x, '^(\d+)', 1) AS DATE) FOR x IN regexp_extract_all(full_text, '(?i){_LONG}')] || [try_strptime(x, '%d/%m/%Y')::DATE FOR x IN regexp_extract_all(full_text, '\b(\d{{1,2}}/\d{{1,2}}/\d{{4}})\b', 1)])::VARCHAR AS date,
            list_max([replace(replace(x, '.', ''), ',', '.')::DOUBLE FOR x IN regexp_extract_all(full_text, 'R\$\s*([\d.]+,\d{{2}})', 1)]) AS amount, amendment, list_min([x::INT FOR x IN regexp_extract_all(full_text, '(?i)\b(?:fls?\.|folhas?)\s*(\d{{1,5}})\b', 1)]) AS lo,
            {_SPOT("regexp_replace(substring(full_text, 1, 3000), '[ ]+', ' ', 'g')", r"(?im)^[ \t\n]*((?:PREFEITURA|SECRETARIA|GOVERNO|CONSELHO|COMPANHIA|INSTITUTO|ESTADO)\b[^\n]{0,120})")} AS agency, {_SPOT("full_text", r"(?i)(?:^|\n)\s*(?:do\s+)?(?:objeto|assunto|ementa)\s*[:.–-]\s*([^\n]{10,400})")} AS subject,
            CASE WHEN kind = 'Termo aditivo' THEN amendment || 'º TA' ELSE {_OWN('own')} END AS number FROM a""",
)
def doc_cards(spark, sf_dir):
    fields = ("doc", "kind", "stage", C("date").cast("string").alias("date"), "amount", "amendment", C("sheets.lo").alias("lo"), "agency", "subject", "number")
    return _cards(spark, sf_dir).select(*fields)


@query(
    "dossier_summary",
    f"""WITH v AS (SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 4 THEN doc_id ELSE min(doc_id) FILTER (doc_id % 5 <> 4) OVER (PARTITION BY doc_id // 10 % 100000) END AS dossier FROM documents),
        s AS (SELECT dossier, count(*) AS n_docs FROM v GROUP BY 1) SELECT dossier, n_docs, row_number() OVER (ORDER BY n_docs DESC, dossier) AS number FROM s""",
)
def dossier_summary(spark, sf_dir):
    cards = _cards(spark, sf_dir)
    return dossier.summaries(dossier.dossiers(cards, dossier.reference_edges(cards, ("processo",)))).select("dossier", "n_docs", "number")


_PROC = "lpad((doc_id // 10 % 100000)::VARCHAR, 5, '0') || '.000123/2024-11'"
_NO = "(doc_id % 90 + 1)::VARCHAR || '/' || CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE '2023' END"


@query(
    "doc_references",
    f"""SELECT doc_id AS doc, 'processo' AS kind, ltrim(split_part({_PROC}, '/', 1), '0') || '/' || '2024-11' AS value FROM documents WHERE doc_id % 5 <> 4 AND doc_id >= 10 UNION ALL SELECT doc_id, 'processo', '.000123/2024-11' FROM documents WHERE doc_id % 5 <> 4 AND doc_id < 10
        UNION ALL SELECT doc_id, 'contrato', {_NO} FROM documents WHERE {TYPE} = 1 UNION ALL SELECT doc_id, 'licitacao', {_NO} FROM documents WHERE {TYPE} = 0 UNION ALL SELECT doc_id, 'ata_srp', {_NO} FROM documents WHERE {TYPE} = 8""",
)
def doc_references(spark, sf_dir):
    return _cards(spark, sf_dir).select("doc", F.explode("refs").alias("r")).select("doc", "r.kind", F.explode("r.found").alias("value"))


_DOSSIER = f"""WITH RECURSIVE v AS (SELECT doc_id AS doc, 'p' || (doc_id // 10 % 100000) AS ref FROM documents WHERE doc_id % 5 <> 4 UNION ALL SELECT doc_id, CASE {TYPE} WHEN 1 THEN 'c' WHEN 0 THEN 'l' ELSE 'a' END || {_NO} FROM documents WHERE {TYPE} IN (0, 1, 8)),
    e AS (SELECT DISTINCT a.doc AS a, b.doc AS b FROM v a JOIN v b USING (ref)), r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
    d AS (SELECT node AS doc, min(seen) AS dossier FROM r GROUP BY 1)"""


def _placed(spark, sf_dir):
    cards = _cards(spark, sf_dir)
    return dossier.dossiers(cards, dossier.reference_edges(cards))


@query("dossier_order", _DOSSIER + f" SELECT doc, dossier, row_number() OVER (PARTITION BY dossier ORDER BY make_date((2010 + doc % 15)::BIGINT, 3, (doc % 28 + 1)::BIGINT), {_STAGE.replace('doc_id', 'doc')}, CASE WHEN {TYPE.replace('doc_id', 'doc')} = 3 THEN 2 ELSE 0 END, doc) AS place FROM d")
def dossier_order(spark, sf_dir):
    return _placed(spark, sf_dir).select("doc", "dossier", "place")


_BY_PROCESS = "WITH d AS (SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 4 THEN doc_id ELSE min(doc_id) FILTER (doc_id % 5 <> 4) OVER (PARTITION BY doc_id // 10 % 100000) END AS dossier FROM documents)"


@query(
    "dossier_gaps",
    _BY_PROCESS + f""", s AS (SELECT dossier, list_distinct(list({_STAGE.replace('doc_id', 'doc')})) AS s, max({_STAGE.replace('doc_id', 'doc')}) AS top FROM d WHERE {_STAGE.replace('doc_id', 'doc')} > 0 GROUP BY 1)
    SELECT dossier, 'falta: Edital' AS gap FROM s WHERE list_has_any(s, [2, 3, 4, 5]) AND NOT list_contains(s, 2) AND top > 2 UNION ALL SELECT dossier, 'falta: Contrato/Convênio' FROM s WHERE list_has_any(s, [2, 3, 4, 5]) AND NOT list_contains(s, 5) AND top > 5
    UNION ALL SELECT dossier, 'empenho sem contrato' FROM s WHERE list_contains(s, 7) AND NOT list_has_any(s, [4, 5]) UNION ALL SELECT dossier, 'pagamento sem empenho' FROM s WHERE list_contains(s, 9) AND NOT list_contains(s, 7)
    UNION ALL SELECT dossier, 'próximo: empenho' FROM s WHERE top = 5 UNION ALL SELECT dossier, 'próximo: homologação/contrato' FROM s WHERE top = 2""",
)
def dossier_gaps(spark, sf_dir):
    cards = _cards(spark, sf_dir)
    return dossier.stage_gaps(dossier.dossiers(cards, dossier.reference_edges(cards, ("processo",))))


@query("missing_amendments", "SELECT grp, m AS missing FROM (SELECT doc_id // 10 AS grp, list(doc_id * 3 % 13 + 1) AS have, max(doc_id * 3 % 13 + 1) AS top FROM documents GROUP BY 1), LATERAL (SELECT unnest(range(1, top + 1)) AS m) WHERE NOT list_contains(have, m)")
def missing_amendments(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("cast(floor(doc_id / 10) as bigint) AS grp", "doc_id * 3 % 13 + 1 AS number")
    return dossier.missing_numbers(rows, "grp", "number")


@query(
    "sheet_gaps",
    "SELECT grp, before + 1 AS first, lo - 1 AS last FROM (SELECT grp, lo, max(hi) OVER (PARTITION BY grp ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT doc_id // 10 AS grp, doc_id % 10 * 3 + 1 AS lo, doc_id % 10 * 3 + 1 + doc_id % 4 AS hi FROM documents)) WHERE lo > before + 1",
)
def sheet_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("cast(floor(doc_id / 10) as bigint) AS grp", "doc_id % 10 * 3 + 1 AS lo", "doc_id % 10 * 3 + 1 + doc_id % 4 AS hi")
    return dossier.sheet_gaps(rows, "grp")


@query("file_parts", "SELECT doc_id AS src, doc_id + 20 AS dst FROM documents WHERE doc_id + 20 IN (SELECT doc_id FROM documents)")
def file_parts(spark, sf_dir):
    names = table(spark, sf_dir, "documents").selectExpr("doc_id AS doc", "concat('rel', cast(doc_id % 20 as string), '_parte', cast(cast(floor(doc_id / 20) as bigint) as string)) AS name")
    return dossier.part_edges(names).select("src", "dst")


#: A file in parts for each process: its documents say which amendment they are and which sheets they have, in words of their own.
_LEAF = "concat('Processo nº 23000.', lpad(cast({grp} AS string), 6, '0'), '/2024-11', chr(10), 'Fls. ', cast({lo} AS string), ' a folhas ', cast({lo} + doc_id % 4 AS string), chr(10), CASE WHEN doc_id % 3 <> 1 THEN concat(cast({n} AS string), 'º Termo Aditivo', chr(10)) ELSE '' END, coalesce(text, ''))"
_LEAF_SPARK = _LEAF.format(grp="doc_id div 10", lo="(doc_id % 10 * 5 + 1)", n="CASE WHEN doc_id % 97 = 3 THEN 2000000000 ELSE doc_id * 7 % 11 END")
_LEAF_DUCK = _LEAF.format(grp="doc_id // 10", lo="(doc_id % 10 * 5 + 1)", n="CASE WHEN doc_id % 97 = 3 THEN 2000000000 ELSE doc_id * 7 % 11 END")


@query(
    "dossier_holes",
    rf"""WITH t AS (SELECT doc_id AS doc, {_LEAF_DUCK} AS body FROM documents),
        k AS (SELECT doc, body, coalesce(nullif(regexp_extract(body[:{dossier.HEAD}], '(?i)(?:{_ANY})', 0), ''), regexp_extract(body, '(?i)(?:{_ANY})', 0)) AS m FROM t),
        c AS (SELECT doc, ltrim(split_part(regexp_extract(body, 'Processo nº ([0-9./-]+)', 1), '/', 1), '0') || '/2024-11' AS process,
                     CASE WHEN {_KIND} = 'Termo aditivo' THEN try_cast(nullif(regexp_extract(body[:{dossier.HEAD}], '(?i)\b(\d+)[ºo°]?\s*(?:\(\w+\)\s*)?termo aditivo', 1), '') AS INT) END AS amendment,
                     list_transform(regexp_extract_all(body, '(?i)\b(?:fls?\.|folhas?)\s*(\d{{1,5}})\b', 1), lambda x: x::INT) AS s FROM k),
        d AS (SELECT *, min(doc) OVER (PARTITION BY process) AS dossier FROM c),
        r AS (SELECT dossier, 'aditivo' AS kind, '' AS place, amendment::BIGINT AS lo, amendment::BIGINT AS hi FROM d WHERE amendment >= 1
              UNION SELECT dossier, 'aditivo', '', 0, 0 FROM d WHERE amendment >= 1
              UNION SELECT dossier, 'parte', '', doc // 10 % 3 + doc % 7, doc // 10 % 3 + doc % 7 FROM d WHERE doc % 2 = 0 AND doc // 10 % 3 + doc % 7 >= 1 UNION SELECT dossier, 'parte', '', 0, 0 FROM d WHERE doc % 2 = 0 AND doc // 10 % 3 + doc % 7 >= 1
              UNION SELECT dossier, 'folhas', CASE WHEN doc % 2 = 0 THEN 'arquivo autos' || (doc // 10) ELSE 'processo ' || process END, list_min(s), list_max(s) FROM d WHERE len(s) > 0),
        w AS (SELECT *, max(hi) OVER (PARTITION BY dossier, kind, place ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
        SELECT dossier, kind, place, before + 1 AS begin, lo - 1 AS finish FROM w WHERE lo > before + 1""",
)
def dossier_holes(spark, sf_dir):
    """Amendments, parts and sheets that each dossier lacks, from the texts and file names; one in 97 says a number of two thousand millions."""
    docs = spark.sql(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('autos', doc_id div 10, '_parte', doc_id div 10 % 3 + doc_id % 7) ELSE concat('doc', doc_id, 'x') END AS name, {_LEAF_SPARK} AS full FROM {{docs}}", docs=table(spark, sf_dir, "documents"))
    cards = written(dossier.cards(spread(docs), "doc_id", "full").join(docs.select(C("doc_id").alias("doc"), "name"), "doc"), "cards")
    return dossier.number_gaps(dossier.dossiers(cards, dossier.reference_edges(cards, ("processo",))), "name").select("dossier", "kind", "place", C("first").alias("begin"), C("last").alias("finish"))


#: A line for each document: somebody's name and a number of seven kinds, then the text.
_CITED = """SELECT doc_id AS doc, nome, CASE doc_id % 7 WHEN 0 THEN '123.456.789-09' WHEN 1 THEN outro WHEN 2 THEN proprio WHEN 3 THEN '529.982.247-25' WHEN 4 THEN '111.444.777-00' WHEN 5 THEN concat('(11) 91234-', lpad(cast(doc_id % 100 AS string), 4, '0')) ELSE 'nenhum' END AS num, text
    FROM (SELECT d.doc_id, d.text, trim(regexp_replace(n.name, '  +', ' '{g})) AS nome, n.cpf11 AS proprio, m.cpf11 AS outro FROM {docs} d JOIN {people} n ON n.k = d.doc_id % 100 JOIN {people} m ON m.k = d.doc_id % 100 + 1)"""


@query(
    "doc_conflicts",
    duck("people") + f""", x AS ({_CITED.format(docs="documents", people="people", g=", 'g'")}),
        y AS (SELECT doc, num, regexp_replace(num, '[^0-9]', '', 'g') AS d, doc % 7 = 5 AS ring, ' ' || trim(regexp_replace(lower(strip_accents('Cliente ' || nome || ', documento ' || num || ' compareceu.')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM x WHERE doc % 7 <> 6),
        k AS (SELECT trim(regexp_replace(lower(strip_accents({d_name('name')})), '[^a-z0-9]+', ' ', 'g')) AS name_key, max(k) AS id, arg_max(cpf11, k) AS cpf, arg_max(phone, k) AS phone FROM people WHERE name IS NOT NULL GROUP BY 1),
        n AS (SELECT y.*, k.id, k.cpf, right(regexp_replace(k.phone, '[^0-9]', '', 'g'), 9) AS nine, k.phone FROM y JOIN k ON contains(t, ' ' || name_key || ' ') WHERE name_key LIKE '% %'),
        g AS (SELECT doc, array_to_string(list_sort(list(id)), ', ') AS person, list(id) AS ids FROM n GROUP BY 1),
        o AS (SELECT cpf11 AS d, max(k) AS owner FROM people GROUP BY 1)
        SELECT y.doc, 1 AS line, coalesce(person, '') AS person, 'cpf' AS field, '***.456.789-**' AS found, '' AS registered, '{crosscheck.TEST}' AS situation FROM y LEFT JOIN g USING (doc) WHERE d = '12345678909'
        UNION SELECT y.doc, 1, person, 'cpf', '***.' || d[4:6] || '.' || d[7:9] || '-**', '***.' || d[4:6] || '.' || d[7:9] || '-**', '{crosscheck.OTHERS}' FROM y JOIN g USING (doc) JOIN o USING (d) WHERE NOT ring AND NOT list_contains(ids, owner)
        UNION SELECT n.doc, 1, id::VARCHAR, 'cpf', '***.' || d[4:6] || '.' || d[7:9] || '-**', '***.' || cpf[4:6] || '.' || cpf[7:9] || '-**', CASE WHEN {d_cpf('d')} THEN '{crosscheck.DIFFERENT}' ELSE '{crosscheck.INVALID}' END FROM n LEFT JOIN o USING (d) WHERE NOT ring AND owner IS NULL AND cpf <> d
        UNION SELECT doc, 1, id::VARCHAR, 'telefone', '(**) *****-' || right(d, 4), coalesce(CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 8 THEN '(**) *****-' || right(nine, 4) END, phone), '{crosscheck.OTHER_PHONE}' FROM n WHERE ring AND nine <> '' AND nine <> right(d, 9)""",
)
def doc_conflicts(spark, sf_dir):
    """What documents say about people whom a line names, against the register."""
    rows = spark.sql(_CITED.format(docs="{docs}", people="{people}", g=""), docs=table(spark, sf_dir, "documents"), people=view(spark, sf_dir, "people"))
    texts = rows.select("doc", F.concat(F.lit("Cliente "), "nome", F.lit(", documento "), "num", F.lit(" compareceu.\n"), "text").alias("text"))
    people = view(spark, sf_dir, "people").select(C("k").alias("id"), "name", C("cpf11").alias("cpf"), "phone")
    return crosscheck.conflicts(spread(texts), people).filter("line = 1")


_LEADS = "SELECT k, CASE k % 5 WHEN 0 THEN 'feira/leads.csv' WHEN 1 THEN 'rh/folha.csv' ELSE 'cadastro/base.csv' END AS path, name AS nome, email AS e_mail, CASE k % 4 WHEN 0 THEN 'Sim' WHEN 1 THEN 'n' WHEN 2 THEN '' ELSE 'talvez' END AS consentimento FROM people"


@query(
    "side_registries",
    duck("people") + f""", l AS ({_LEADS}) SELECT CASE k % 5 WHEN 0 THEN 'leads' ELSE 'colaboradores' END AS kind, {d_name('nome')} AS name, CASE WHEN e_mail LIKE '%@%' AND NOT contains(e_mail, ' ') THEN replace(lower(e_mail), '@@', '@') END AS email,
        CASE k % 4 WHEN 0 THEN 'sim' WHEN 1 THEN 'não' ELSE 'não informado' END AS consent, CASE k % 4 WHEN 0 THEN 'sim' ELSE 'NÃO (sem consentimento registrado — LGPD art. 7º, I)' END AS may_contact FROM l WHERE k % 5 < 2""",
)
def side_registries(spark, sf_dir):
    """Leads and staff with what their consent allows."""
    rows = spark.sql(_LEADS.replace("FROM people", "FROM {people}"), people=view(spark, sf_dir, "people"))
    return entity.side_registry(rows.drop("k")).drop("phone")


@query(
    "dossier_main",
    _BY_PROCESS + f""", r AS (SELECT doc_id AS doc, 'processo' AS kind, CASE WHEN doc_id < 10 THEN '.000123/2024-11' ELSE ltrim(split_part({_PROC}, '/', 1), '0') || '/2024-11' END AS value FROM documents WHERE doc_id % 5 <> 4
            UNION ALL SELECT doc_id, 'contrato', {_NO} FROM documents WHERE {TYPE} = 1 UNION ALL SELECT doc_id, 'licitacao', {_NO} FROM documents WHERE {TYPE} = 0 UNION ALL SELECT doc_id, 'ata srp', {_NO} FROM documents WHERE {TYPE} = 8),
        n AS (SELECT dossier, kind || ' ' || value AS label, count(*) AS n FROM r JOIN d USING (doc) GROUP BY 1, 2),
        p AS (SELECT *, row_number() OVER (PARTITION BY dossier ORDER BY n DESC, label) AS i FROM n)
        SELECT dossier, string_agg(label, '; ' ORDER BY i) AS main FROM p WHERE i <= 2 GROUP BY 1""",
)
def dossier_main(spark, sf_dir):
    """The two references that a dossier's documents cite most."""
    cards = _cards(spark, sf_dir)
    return dossier.summaries(dossier.dossiers(cards, dossier.reference_edges(cards, ("processo",)))).filter("main is not null").select("dossier", "main")


@query(
    "entity_cluster_open",
    (duck("people") + f""", a AS ({_A}), b AS ({_B}), c AS ({_C}), u AS (SELECT line, cpf, email FROM a UNION ALL SELECT line + 1099511627776, cpf, email FROM b UNION ALL SELECT line + 2 * 1099511627776, cpf, email FROM c),
        n AS (SELECT line AS rid, {d_pad(d_digits('cpf'), 11)} AS d, CASE WHEN email LIKE '%@%' AND NOT contains(email, ' ') THEN replace(lower(email), '@@', '@') END AS email FROM u),
        k AS (SELECT rid, 'c' || d AS key FROM n WHERE {d_cpf('d')} UNION ALL SELECT rid, 'e' || email FROM n WHERE email IS NOT NULL),
        e AS (SELECT DISTINCT x.rid AS a, y.rid AS b FROM k x JOIN k y USING (key)), r AS (SELECT rid AS node, rid AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
        SELECT node AS rid, min(seen) AS cluster FROM r GROUP BY 1""").replace("WITH ", "WITH RECURSIVE ", 1),
)
def entity_cluster_open(spark, sf_dir):
    """Clusters of records that have neither ids nor names, so that nothing excludes: those linked by CPF and e-mail."""
    people = _people(spark, sf_dir).withColumns({"id": F.lit(None).cast("string"), "name": F.lit(None).cast("string")})
    return entity.clusters(people)[0]
