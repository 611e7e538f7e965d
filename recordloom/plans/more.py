"""Queries of further joins and functions: key discovery, cross-checks of documents against people, parts, sheets and lists of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import ids
from recordloom.functions import text as T
from recordloom.operators import dossier, entity, keysync, privacy
from recordloom.operators import tables as tabs
from recordloom.plans.dirty import duck, view
from recordloom.plans.people import _TXT_DUCK, _texts
from recordloom.plans.scalars import d_cpf, d_name
from recordloom.plans.wholetables import _REGS, _registries
from recordloom.tables import table, written

QUERIES: dict = {}
SQL: dict = {}
C = F.col
#: Pairs of a person and a document, for each name that both share, that a task makes.
TASK_PAIRS = 4_000_000


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query(
    "json_items",
    "SELECT l_orderkey, string_agg('p' || l_partkey || ' x' || l_quantity::BIGINT, '; ' ORDER BY 'p' || l_partkey, l_quantity::BIGINT::VARCHAR) AS items FROM lineitem GROUP BY 1",
)
def json_items(spark, sf_dir):
    item = F.struct(F.concat(F.lit("p"), C("l_partkey").cast("string")).alias("produto"), C("l_quantity").cast("long").cast("string").alias("qtd"))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("j"))
    return lists.select("l_orderkey", T.items(C("j")).alias("items"))


@query(
    "doc_inconsistencies",
    duck("docs_headed", "people")
    + f""", x AS ({_TXT_DUCK}), k AS (SELECT k, cpf11, trim(regexp_replace(lower(strip_accents({d_name('name')})), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM people),
        y AS (SELECT doc, ' ' || trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, unnest(regexp_extract_all(text, 'CPF ([0-9]{{11}})', 1)) AS cited FROM x)
        SELECT DISTINCT doc, k.k, cited, cpf11 AS registered FROM y JOIN k ON contains(t, ' ' || name_key || ' ') WHERE cited <> cpf11""",
)
def doc_inconsistencies(spark, sf_dir):
    texts, people = _texts(spark, sf_dir), view(spark, sf_dir, "people")
    cited = texts.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("CPF ([0-9]{11})"), F.lit(1)))).alias("cited"))
    told = written(entity.mentions(texts, people).join(cited.distinct(), "doc"), "told")  # each document, name and number once
    # a person's name and number come from k, so every k has one name and pairs of different names are different rows
    named = people.select("k", C("cpf11").alias("registered"), T.text_key(C("name")).alias("name_key")).distinct()
    n = told.groupBy("name_key").agg(F.count("*").alias("n")).join(named.groupBy("name_key").agg(F.count("*").alias("m")), "name_key")
    pairs, most = n.agg(F.coalesce(F.sum(C("n") * C("m")), F.lit(0)), F.coalesce(F.max(C("n") * C("m")), F.lit(0))).first()
    # namesakes times documents: as many tasks as the rows need, and a frequent name is dealt to several
    cuts, parts = max(1, -(-most // TASK_PAIRS)), max(2 * spark.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS))
    told = told.withColumn("cut", F.pmod(F.xxhash64("doc", "cited"), F.lit(cuts))).repartition(parts, "name_key", "cut")
    named = named.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cuts - 1).cast("long")))).repartition(parts, "name_key", "cut")
    found = named.hint("merge").join(told, ["name_key", "cut"])
    return found.filter("cited <> registered").select("doc", "k", "cited", "registered")


@query("key_discovery", _REGS + " SELECT 'cpf' AS key, round(3 * 1.5 * avg(share), 6) AS score FROM (SELECT (SELECT count(*) FROM ks p JOIN ks q ON p.k = q.k WHERE p.s = x.s AND q.s = y.s) / least(x.n, y.n) AS share FROM sz x JOIN sz y ON x.s < y.s)")
def key_discovery(spark, sf_dir):
    """The best key of three registries: the mean overlap times the number of tables, official ids count half more, at least 0.1."""
    regs = _registries(spark, sf_dir)
    scored = None
    for i, (column, weight) in enumerate((("cpf", 1.5), ("name", 1.0), ("bal", 1.0))):
        share = keysync.overlap(keysync.keys({n: C(column) for n in regs}, regs)).agg(F.avg("share").alias("share"))
        part = share.select(F.lit(column).alias("key"), F.lit(i).alias("i"), (len(regs) * weight * C("share")).alias("score"))
        scored = part if scored is None else scored.union(part)
    return scored.filter("score >= 0.1").orderBy(F.desc("score"), "i").limit(1).select("key", F.round("score", 6).alias("score"))


@query(
    "masked_samples",
    duck("people") + " SELECT k, substring(regexp_replace(replace(cpf11 || ' ' || email, cpf11, '###########'), '[A-Za-z0-9_.+-]+@', '***@', 'g'), 1, 60) AS sample FROM people",
)
def masked_samples(spark, sf_dir):
    return view(spark, sf_dir, "people").select("k", privacy.masked_sample(F.concat("cpf11", F.lit(" "), "email")).alias("sample"))


_SHEETS = "SELECT doc_id AS doc, cast(floor(doc_id / 10) as bigint) AS grp, doc_id % 10 * 3 + 1 AS lo, doc_id % 10 * 3 + 1 + doc_id % 4 AS hi, text FROM {documents}"


@query(
    "sheet_continuation",
    f"WITH s AS ({_SHEETS.format(documents='documents')}) SELECT a.doc AS src, b.doc AS dst FROM s a JOIN s b ON a.grp = b.grp AND a.hi + 1 = b.lo AND a.doc <> b.doc WHERE NOT regexp_matches(trim(a.text), '[.!?;:]$') OR regexp_matches(trim(b.text), '^\\p{{Ll}}')",
)
def sheet_continuation(spark, sf_dir):
    return dossier.sheet_edges(spark.sql(_SHEETS, documents=table(spark, sf_dir, "documents")))


@query(
    "part_inheritance",
    "SELECT doc_id, first_value(CASE WHEN doc_id % 3 = 0 THEN lang END IGNORE NULLS) OVER (PARTITION BY doc_id // 10 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kind FROM documents",
)
def part_inheritance(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", F.floor(C("doc_id") / 10).alias("base"), F.when(C("doc_id") % 3 == 0, C("lang")).alias("kind"))
    return dossier.inherited(parts, "base", "doc_id", "kind").select("doc_id", "kind")


_PHONES = "SELECT k, k % 40 AS grp, CASE WHEN k % 9 = 0 THEN concat('(11) 9', lpad(cast(k % 10000 as string), 4, '0'), '-1234') ELSE concat('+55 61 9', lpad(cast(k % 10000 as string), 4, '0'), '4321') END AS tel FROM people"


@query("dominant_area", duck("people") + f", p AS ({_PHONES}), a AS (SELECT CASE WHEN tel LIKE '(11)%' THEN '11' ELSE '61' END AS area, count(*) AS n FROM p GROUP BY 1) SELECT CASE WHEN max(n) / sum(n) >= 0.8 THEN arg_max(area, n) END AS area FROM a")
def dominant_area(spark, sf_dir):
    return entity.area_code(spark.sql(_PHONES.replace("FROM people", "FROM {people}"), people=view(spark, sf_dir, "people")), "tel")


#: Of each person two sources, with a spoilt CPF for every thirteenth that a document cites rightly for every second of these, and another one's for every 29th.
_CPFS = """SELECT p.k AS cluster, 'main' AS source, 100 AS priority, 0 AS quality, p.k AS line, p.cpf11 AS cpf FROM people p UNION ALL
    SELECT p.k, 'branch', 80, 0, p.k, CASE WHEN p.k % 29 = 0 THEN q.cpf11 ELSE p.cpf11 END FROM people p JOIN people q ON q.k = p.k + 1"""
_CITED = "SELECT k AS cluster, concat(substring(cpf11, 1, 10), cast((cast(substring(cpf11, 11, 1) AS int) + 9) % 10 AS string)) AS cpf, 'nota' AS origin FROM people WHERE k % 26 = 0"


@query(
    "golden_cpf",
    duck("people")
    + f""", r AS ({_CPFS}), c AS (SELECT cluster, cpf, CASE WHEN source = 'main' THEN 0 ELSE 1 END AS pos, source || ' linha ' || line AS origin FROM r UNION ALL SELECT cluster, cpf, 2, origin FROM ({_CITED})),
        v AS (SELECT *, {d_cpf('cpf')} AS ok FROM c), o AS (SELECT cpf, arg_min(cluster, (-n, cluster)) AS owner FROM (SELECT cpf, cluster, count(*) AS n FROM v WHERE ok AND pos < 2 GROUP BY 1, 2) GROUP BY 1),
        f AS (SELECT v.*, ok AND coalesce(owner, cluster) <> cluster AS alien FROM v LEFT JOIN o USING (cpf)),
        g AS (SELECT cluster, arg_min(cpf, pos) FILTER (ok AND NOT alien) AS good, arg_min(origin, pos) FILTER (ok AND NOT alien) AS origin, arg_min(cpf, pos) AS anyone, arg_min(ok, pos) FILTER (pos < 2) AS first_ok, coalesce(array_to_string(list_sort(list_distinct(list(cpf) FILTER (alien))), ', '), '') AS "foreign" FROM f GROUP BY 1)
        SELECT cluster, substring(coalesce(good, anyone), 1, 3) || '.' || substring(coalesce(good, anyone), 4, 3) || '.' || substring(coalesce(good, anyone), 7, 3) || '-' || substring(coalesce(good, anyone), 10, 2) AS cpf, "foreign",
        CASE WHEN good IS NULL THEN 'INVÁLIDO em todas as fontes — conferir com o titular' WHEN first_ok THEN 'válido' ELSE 'corrigido: cadastro principal tinha CPF inválido; válido encontrado em ' || origin END AS cpf_status FROM g""",
)
def golden_cpf(spark, sf_dir):
    base = view(spark, sf_dir, "people").select("k", "cpf11")
    of = lambda q: spark.sql(q.replace(" people", " {people}"), people=base)
    return entity.golden_cpf(of(_CPFS).withColumn("cpf_ok", ids.cpf_valid(C("cpf"))), of(_CITED))


_BOOKED = """SELECT cast(o_orderkey AS string) AS pedido_id, CASE o_orderkey % 3 WHEN 0 THEN cast(o_custkey AS string) WHEN 1 THEN '' ELSE 'Fulano Ausente' END AS cliente, concat('c', cast(o_custkey AS string), '@mail.com') AS cliente_email,
    concat('R$ ', cast(cast(floor(o_totalprice) AS bigint) AS string), ',50') AS valor, concat(cast(year(o_orderdate) AS string), '-', lpad(cast(month(o_orderdate) AS string), 2, '0'), '-', lpad(cast(day(o_orderdate) AS string), 2, '0')) AS data_venda,
    CASE o_orderkey % 4 WHEN 0 THEN 'sim' WHEN 1 THEN 'nao' ELSE '' END AS pago, 'Pendente?' AS status, '4111 1111 1111 1234' AS cartao, o_orderpriority AS obs FROM orders"""


@query(
    "transaction_shape",
    f"""WITH b AS ({_BOOKED}) SELECT pedido_id AS venda_id, CASE WHEN try_cast(cliente AS BIGINT) IS NOT NULL THEN cliente::BIGINT ELSE m.c END AS cluster, CASE WHEN try_cast(cliente AS BIGINT) IS NOT NULL THEN 'id' ELSE 'email' END AS link,
        CASE WHEN try_cast(cliente AS BIGINT) IS NOT NULL THEN 'cliente=' || cliente ELSE 'cliente_email=' || cliente_email END AS reference, replace(replace(valor, 'R$ ', ''), ',', '.')::DOUBLE AS value, 'BRL' AS currency, data_venda AS date,
        CASE pago WHEN 'sim' THEN 'sim' WHEN 'nao' THEN 'não' ELSE 'não informado' END AS paid, 'pendente (a confirmar)' AS status, '**** 1234' AS card, obs FROM b, LATERAL (SELECT regexp_extract(cliente_email, '[0-9]+')::BIGINT AS c) m""",
)
def transaction_shape(spark, sf_dir):
    return _shaped(spark, sf_dir)


#: Other names of the columns, which only a part of them tells.
_OTHER_NAMES = {"pedido_id": "codigo_pedido", "valor": "valor_bruto", "data_venda": "data_lancamento", "pago": "foi_quitado_ja", "status": "situacao_atual", "cartao": "cartao_usado"}


def _shaped(spark, sf_dir, names=None):
    known = table(spark, sf_dir, "customer")
    index = known.select(F.lit("id").alias("kind"), C("c_custkey").cast("string").alias("key"), F.lit(1).cast("long").alias("n"), C("c_custkey").alias("cluster"))
    index = index.union(known.select(F.lit("email"), F.concat(F.lit("c"), C("c_custkey").cast("string"), F.lit("@mail.com")), F.lit(1).cast("long"), C("c_custkey")))
    rows = spark.sql(_BOOKED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    if names:
        rows = rows.withColumnsRenamed(names)
        rows = entity.mapped_columns(rows, entity.assigned_roles(rows.columns))
    out = entity.transactions(rows, "venda", index)
    return out.drop("items").withColumn("date", C("date").cast("string"))


@query("mapped_transactions", SQL["transaction_shape"])
def mapped_transactions(spark, sf_dir):
    """The transactions of transaction_shape from a table with other column names."""
    return _shaped(spark, sf_dir, _OTHER_NAMES)


_DICT = "SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN ' - ' ELSE c_mktsegment END AS area, concat('R$ ', replace(cast(cast(abs(c_acctbal) AS decimal(18,2)) AS string), '.', ',')) AS saldo, concat(lpad(cast(c_custkey % 28 + 1 AS string), 2, '0'), '/03/', cast(2000 + c_custkey % 20 AS string)) AS desde, cast(c_nationkey AS string) AS nacao FROM customer"


@query(
    "column_dictionary",
    f"""WITH d AS ({_DICT}), l AS (SELECT k, 'area' AS "column", 'texto' AS kind, CASE WHEN area <> ' - ' THEN area END AS v, NULL::DECIMAL(18,2) AS n, NULL::DATE AS day FROM d
            UNION ALL SELECT k, 'saldo', 'valor', saldo, replace(replace(saldo, 'R$ ', ''), ',', '.')::DECIMAL(18,2), NULL FROM d UNION ALL SELECT k, 'desde', 'data', desde, NULL, strptime(desde, '%d/%m/%Y')::DATE FROM d UNION ALL SELECT k, 'nacao', 'numero', nacao, nacao::DECIMAL(18,2), NULL FROM d),
        f AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY min(k), v) AS i FROM l WHERE v IS NOT NULL GROUP BY 1, 2), x AS (SELECT "column", string_agg(v, ', ' ORDER BY i) AS example FROM f WHERE i <= 3 GROUP BY 1)
        SELECT "column", kind, count(v) AS n_filled, count(*) - count(v) AS n_empty, round(100.0 * count(v) / count(*), 1) AS pct_filled, count(DISTINCT v) AS n_distinct, any_value(example) AS example, coalesce(min(n)::DOUBLE::VARCHAR, min(day)::VARCHAR) AS least, coalesce(max(n)::DOUBLE::VARCHAR, max(day)::VARCHAR) AS greatest, sum(n)::DOUBLE AS total
        FROM l JOIN x USING ("column") GROUP BY 1, 2""",
)
def column_dictionary(spark, sf_dir):
    """A data dictionary: examples, and least, greatest and total of numbers and days."""
    rows = spark.sql(_DICT.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return tabs.described(rows, "k", {"saldo": "valor", "desde": "data", "nacao": "numero"})


@query(
    "hidden_examples",
    f"""WITH d AS ({_DICT}), l AS (SELECT 'area' AS "column", k, CASE WHEN area <> ' - ' THEN area END AS v FROM d UNION ALL SELECT 'saldo', k, saldo FROM d UNION ALL SELECT 'desde', k, desde FROM d UNION ALL SELECT 'nacao', k, nacao FROM d),
        f AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY min(k), v) AS i FROM l WHERE v IS NOT NULL GROUP BY 1, 2)
        SELECT "column", CASE "column" WHEN 'saldo' THEN '[oculto]' ELSE string_agg(v, ', ' ORDER BY i) FILTER (i <= 3) END AS shown, count(*) AS n_distinct FROM f GROUP BY 1""",
)
def hidden_examples(spark, sf_dir):
    """The same dictionary without the examples of a column that is marked as personal."""
    marked = spark.createDataFrame([("saldo",)], "column string")
    return privacy.dictionary(column_dictionary(spark, sf_dir), marked).select("column", C("example").alias("shown"), "n_distinct")


@query(
    "remark_counts",
    """SELECT 'problems' AS what, CASE WHEN c_custkey % 4 = 0 THEN 'CEP inválido' ELSE 'UF inválida' END AS kind, count(*) AS n FROM customer WHERE c_custkey % 4 < 2 GROUP BY 2
        UNION ALL SELECT 'conflicts', 'nation', count(*) FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1) UNION ALL SELECT 'assumptions', 'moeda BRL assumida', count(*) FROM orders WHERE o_orderkey % 3 = 0""",
)
def remark_counts(spark, sf_dir):
    """How often problems, conflicts and assumptions occur, by kind."""
    rows = table(spark, sf_dir, "customer")
    dirty = rows.select("c_custkey", F.when(C("c_custkey") % 4 == 0, "abc").otherwise("70000-123").alias("cep"), F.when(C("c_custkey") % 4 == 1, "QQ").otherwise("DF").alias("uf"))
    _, problems = tabs.normalised(dirty, "c_custkey", {"cep": "cep", "uf": "uf"})
    people = rows.select(C("c_mktsegment").alias("cluster"), F.lit("base").alias("source"), C("c_nationkey").alias("nation"))
    assumed = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.lit("moeda BRL assumida").alias("kind"))
    return tabs.tally(problems=problems.withColumnRenamed("problem", "kind"), conflicts=entity.conflicts(people, ("nation",)).withColumnRenamed("field", "kind"), assumptions=assumed)


@query(
    "correction_log",
    duck("people")
    + f""", m AS (SELECT k, email, replace(replace(lower(trim(email)), ' ', ''), '@@', '@') AS e FROM people)
        SELECT k AS key, 'cpf' AS field, '***.' || substring(cpf11, 4, 3) || '.' || substring(cpf11, 7, 3) || '-**' AS raw, CASE WHEN {d_cpf('cpf11')} THEN '***.' || substring(cpf11, 4, 3) || '.' || substring(cpf11, 7, 3) || '-**' END AS corrected, CASE WHEN {d_cpf('cpf11')} THEN '' ELSE 'CPF inválido' END AS alert FROM people WHERE cpf <> cpf11 OR NOT {d_cpf('cpf11')}
        UNION ALL SELECT k, 'city', city, strip_accents(city), '' FROM people WHERE city <> strip_accents(city)""",
)
def correction_log(spark, sf_dir):
    d = ids.cpf_digits(C("cpf"))
    fields = {"cpf": (F.when(ids.cpf_valid(d), d), F.when(~ids.cpf_valid(d), "CPF inválido")), "city": (T.plain(C("city")), F.lit(""))}
    return entity.corrections(view(spark, sf_dir, "people").select("k", "cpf", "city"), "k", fields)
