"""Queries over whole tables: scrubbing, profiles, types, problems, key discovery and synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions.text import BLANK_TABLE, STATES
from recordloom.operators import keysync
from recordloom.operators import tables as tabs
from recordloom.plans.dirty import duck, view
from recordloom.plans.scalars import d_blank, d_cpf, d_digits, d_money, d_pad
from recordloom.tables import table

QUERIES: dict = {}
SQL: dict = {}
C = F.col


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


_SMALL = ", ".join(f"'{b}'" for b in BLANK_TABLE)


def d_filled(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND lower(trim({x})) NOT IN ({_SMALL}) THEN {x} END"


@query("blank_tokens", duck("orders_raw", "people") + f" SELECT 'amount' AS field, count(*) FILTER ({d_blank('amount_text')}) AS n_blank, count(*) AS n FROM orders_raw UNION ALL SELECT 'date', count(*) FILTER ({d_blank('date_text')}), count(*) FROM orders_raw UNION ALL SELECT 'email', count(*) FILTER ({d_blank('email')}), count(*) FROM people")
def blank_tokens(spark, sf_dir):
    orders, people = view(spark, sf_dir, "orders_raw"), view(spark, sf_dir, "people")
    count = lambda df, name, c: df.agg(F.count_if(tabs.blank(C(c))).alias("n_blank"), F.count("*").alias("n")).select(F.lit(name).alias("field"), "n_blank", "n")
    return count(orders, "amount", "amount_text").union(count(orders, "date", "date_text")).union(count(people, "email", "email"))


_ROWS = "SELECT k, CASE WHEN k % 101 = 0 THEN '' WHEN k % 103 = 0 THEN 'TOTAL geral' WHEN k % 107 = 0 THEN NULL ELSE status_text END AS a, CASE WHEN k % 101 = 0 THEN 'n/a' WHEN k % 107 = 0 THEN 'Soma' ELSE amount_text END AS b FROM {o}"


@query("row_scrub", duck("orders_raw") + f", r AS ({_ROWS.format(o='orders_raw')}), f AS (SELECT *, coalesce({d_filled('a')}, {d_filled('b')}) AS first FROM r) SELECT k, a, b FROM f WHERE first IS NOT NULL AND NOT regexp_matches(first, '(?i)^\\s*(total|totais|soma|subtotal|total geral)\\b')")
def row_scrub(spark, sf_dir):
    rows = spark.sql(_ROWS, o=view(spark, sf_dir, "orders_raw"))
    return tabs.scrubbed(rows, ["a", "b"])


@query("exact_rows", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS removed, count(DISTINCT (l_orderkey, l_linenumber)) AS n_kept FROM lineitem")
def exact_rows(spark, sf_dir):
    kept, removed = tabs.distinct_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))
    return removed.crossJoin(kept.agg(F.count("*").alias("n_kept")))  # one row each


_COLUMNS = {"cpf": "cpf", "nome": "name", "email": "email", "telefone": "phone", "uf": "state", "saldo": "cast(bal AS string)"}
_CELLS = "(" + " UNION ALL ".join(f"SELECT k, '{c}' AS col, {e} AS v FROM people" for c, e in _COLUMNS.items()) + ")"


def _people_table(spark, sf_dir):
    return view(spark, sf_dir, "people").selectExpr("k", *(f"{e} AS {c}" for c, e in _COLUMNS.items()))


@query(
    "column_profile",
    duck("people")
    + f""" SELECT col AS "column", count(*) AS n_rows, count(f) AS n_filled, count(*) - count(f) AS n_empty, round(100.0 * count(f) / count(*), 1) AS pct_filled, count(DISTINCT f) AS n_distinct
        , min(f) AS least, max(f) AS greatest FROM (SELECT col, {d_filled('v')} AS f FROM {_CELLS}) GROUP BY 1""",
)
def column_profile(spark, sf_dir):
    return tabs.profile(tabs.cells(_people_table(spark, sf_dir), "k"))


_STATE_WORDS = ", ".join(f"'{x}'" for kv in STATES.items() for x in kv)


@query(
    "type_inference",
    duck("people")
    + f""" SELECT col AS "column", CASE WHEN col = 'cpf' THEN 'cpf' WHEN uf > 0.95 OR (col = 'uf' AND uf > 0.7) THEN 'uf' WHEN (money > 0.9 AND marked > 0.5) OR (money > 0.6 AND col = 'saldo') THEN 'valor' WHEN number > 0.95 AND NOT zero_led THEN 'numero' ELSE 'texto' END AS kind
        FROM (SELECT col, avg(CASE WHEN upper(strip_accents(v)) IN ({_STATE_WORDS}) THEN 1.0 ELSE 0.0 END) AS uf, avg(CASE WHEN ({d_money('v')}) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS money, avg(CASE WHEN regexp_matches(v, 'R\\$|,[0-9]{{2}}$') THEN 1.0 ELSE 0.0 END) AS marked,
            avg(CASE WHEN regexp_full_match(v, '-?[0-9]+([.,][0-9]+)?') THEN 1.0 ELSE 0.0 END) AS number, max(regexp_matches(v, '^0[0-9]')) AS zero_led FROM (SELECT col, trim(v) AS v FROM {_CELLS} WHERE v IS NOT NULL AND trim(v) <> '') GROUP BY 1)""",
)
def type_inference(spark, sf_dir):
    return tabs.inferred(_people_table(spark, sf_dir), "k").select("column", "kind")


@query(
    "type_shares",
    duck("people")
    + f""" SELECT col AS "column", count(*) AS n, round(avg(CASE WHEN {d_cpf('d')} THEN 1.0 ELSE 0.0 END), 6) AS cpf, round(avg(CASE WHEN length(g) BETWEEN 10 AND 11 THEN 1.0 ELSE 0.0 END), 6) AS n10_11,
        round(avg(CASE WHEN ({d_money('v')}) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS money FROM (SELECT col, trim(v) AS v, {d_digits('trim(v)')} AS g, {d_pad(d_digits('trim(v)'), 11)} AS d FROM {_CELLS} WHERE v IS NOT NULL AND trim(v) <> '') GROUP BY 1""",
)
def type_shares(spark, sf_dir):
    out = tabs.shares(tabs.cells(_people_table(spark, sf_dir), "k"))
    return out.select("column", "n", *(F.round(c, 6).alias(c) for c in ("cpf", "n10_11", "money")))


_KINDS = {"cpf": "cpf", "saldo": "valor", "uf": "uf"}


@query(
    "problem_log",
    duck("people") + f" SELECT k AS key, 'cpf' AS \"column\", cpf AS raw, 'CPF inválido' AS problem FROM people WHERE NOT {d_cpf(d_pad(d_digits('cpf'), 11))} UNION ALL SELECT k, 'uf', state, 'UF inválida' FROM people WHERE state = 'xx'",
)
def problem_log(spark, sf_dir):
    return tabs.normalised(_people_table(spark, sf_dir), "k", _KINDS)[1]


@query("problem_counts", f'SELECT "column", problem, count(*) AS n FROM ({SQL["problem_log"]}) GROUP BY 1, 2')
def problem_counts(spark, sf_dir):
    return tabs.counted(tabs.normalised(_people_table(spark, sf_dir), "k", _KINDS)[1])


_REG_A = "SELECT k, cpf, name, bal FROM people WHERE k % 3 <> 0"
_REG_B = "SELECT k, replace(cpf11, '.', '') AS cpf, CASE WHEN k % 8 = 0 THEN concat(name, ' Neto') ELSE upper(name) END AS name, bal FROM people WHERE k % 4 <> 0"
_REG_C = "SELECT k * 2 AS k, cpf11 AS cpf, CASE WHEN k % 9 = 0 THEN 'outro' ELSE name END AS name, bal FROM people WHERE k % 5 < 2 UNION ALL SELECT k * 2 + 1, cpf11, NULL, 1.5 FROM people WHERE k % 10 = 0"


def _registries(spark, sf_dir):
    people = view(spark, sf_dir, "people")
    return {n: spark.sql(q.replace("FROM people", "FROM {people}"), people=people) for n, q in (("a", _REG_A), ("b", _REG_B), ("c", _REG_C))}


def d_key(x: str) -> str:
    t, d = f"trim({x})", d_digits(f"trim({x})")
    return f"CASE WHEN {d} <> '' AND length({d}) * 10 >= length(replace({t}, ' ', '')) * 6 THEN CASE WHEN ltrim({d}, '0') = '' THEN '0' ELSE ltrim({d}, '0') END ELSE nullif(upper(strip_accents({t})), '') END"


_REGS = duck("people") + f", a AS ({_REG_A}), b AS ({_REG_B}), c AS ({_REG_C}), ks AS (SELECT DISTINCT s, k FROM (SELECT 'a' AS s, {d_key('cpf')} AS k FROM a UNION ALL SELECT 'b', {d_key('cpf')} FROM b UNION ALL SELECT 'c', {d_key('cpf')} FROM c) WHERE k IS NOT NULL), sz AS (SELECT s, count(*) AS n FROM ks GROUP BY 1)"


@query("key_overlap", _REGS + " SELECT x.s AS a, y.s AS b, (SELECT count(*) FROM ks p JOIN ks q ON p.k = q.k WHERE p.s = x.s AND q.s = y.s) AS shared, round((SELECT count(*) FROM ks p JOIN ks q ON p.k = q.k WHERE p.s = x.s AND q.s = y.s) / least(x.n, y.n), 6) AS share FROM sz x JOIN sz y ON x.s < y.s")
def key_overlap(spark, sf_dir):
    regs = _registries(spark, sf_dir)
    return keysync.overlap(keysync.keys({n: C("cpf") for n in regs}, regs)).withColumn("share", F.round("share", 6))


def _synced(spark, sf_dir):
    regs = _registries(spark, sf_dir)
    return keysync.synchronised([keysync.Source(n, r.withColumn("bal", C("bal").cast("decimal(18,2)")), "cpf", ("name", "bal"), ("bal",), "k") for n, r in regs.items()])


_COLL = ", ".join(
    f"c{n} AS (SELECT {d_key('cpf')} AS k, arg_min(cpf, k) AS shown, arg_min(name, k) FILTER (name IS NOT NULL) AS name, coalesce(sum(bal::DECIMAL(18,2)), 0)::DOUBLE AS bal FROM {n} GROUP BY 1)" for n in "abc"
)
_SYNC = _REGS + f""", {_COLL}, s AS (SELECT k, coalesce(ca.shown, cb.shown, cc.shown) AS shown, (ca.shown IS NOT NULL)::INT + (cb.shown IS NOT NULL)::INT + (cc.shown IS NOT NULL)::INT AS n_sources,
    concat_ws(', ', CASE WHEN ca.shown IS NOT NULL THEN 'a' END, CASE WHEN cb.shown IS NOT NULL THEN 'b' END, CASE WHEN cc.shown IS NOT NULL THEN 'c' END) AS sources,
    ca.name AS name__a, cb.name AS name__b, cc.name AS name__c, ca.bal AS bal__a, cb.bal AS bal__b, cc.bal AS bal__c FROM ca FULL JOIN cb USING (k) FULL JOIN cc USING (k))"""


@query("keysync_outer", _SYNC + " SELECT * FROM s")
def keysync_outer(spark, sf_dir):
    out = _synced(spark, sf_dir)
    return out.withColumns({f"bal__{n}": C(f"bal__{n}").cast("double") for n in "abc"})


@query("keysync_coverage", _SYNC + " SELECT n AS source, count(*) FILTER (contains(sources, n)) AS n_keys, round(100.0 * count(*) FILTER (contains(sources, n)) / count(*), 1) AS pct, count(*) FILTER (sources = n) AS exclusive FROM s, (VALUES ('a'), ('b'), ('c')) t(n) GROUP BY 1")
def keysync_coverage(spark, sf_dir):
    return keysync.coverage(_synced(spark, sf_dir), ["a", "b", "c"])


@query("keysync_divergence", _SYNC + """ SELECT k, 'name' AS field, array_to_string(list_sort(v), ' | ') AS "values" FROM (SELECT k, list_distinct([upper(trim(strip_accents(x))) FOR x IN [name__a, name__b, name__c] IF x IS NOT NULL]) AS v FROM s) WHERE len(v) > 1""")
def keysync_divergence(spark, sf_dir):
    return keysync.divergences(_synced(spark, sf_dir), "name", ["a", "b", "c"])
