"""Messy views of the given tables, in SQL that Spark and DuckDB both run.

Each view is a query over base tables in braces; the given tables have no Brazilian ids, dates or mixed writings, so these are derived from their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.tables import table

FIRST = ("Ana", "João", "Maria", "José", "Luís", "Antônia", "Sérgio", "Conceição", "Caio", "Débora", "Hugo")
LAST = ("Silva", "Souza", "Araújo", "Gonçalves", "Lima", "Moraes", "Pires", "Rocha", "Brandão", "Castro", "Dias", "Farias", "Galvão")
CITY = ("Recife-PE", "poa", "São Paulo", "salvador/BA", "BH", "Curitiba - PR", "Natal", "rio de janeiro", "floripa", "Xique-Xique")
STATE = ("SP", "rio de janeiro", "Paraná", "BA", "xx", "Ceará", "MG")


def _pick(words: tuple[str, ...], key: str) -> str:
    """The word of a list at key, by its place in a text of fixed-width cells."""
    width = max(map(len, words))
    cells = "".join(w.ljust(width) for w in words)
    return f"trim(substring('{cells}', cast(({key}) % {len(words)} as int) * {width} + 1, {width}))"


def _digits(n: str, count: int) -> list[str]:
    """The decimal digits of a number, as arithmetic on it: short, so that plans which nest the view stay small."""
    return [f"(cast(floor({n} / {10 ** (count - 1 - i)}) as bigint) % 10)" for i in range(count)]


def _sum(digits: list[str], weights) -> str:
    return " + ".join(f"{d} * {w}" for d, w in zip(digits, weights))


def _cpf(source: str, key: str) -> str:
    """source's rows with cpf11: nine digits from a key and their check digits; every thirteenth is spoilt."""
    n = f"(({key} * 7919 + 12345) % 1000000000)"
    nine = _digits(n, 9)
    first = f"((({_sum(nine, range(10, 1, -1))}) * 10 % 11) % 10)"
    second = f"((({_sum(nine, range(11, 2, -1))} + {first} * 2) * 10 % 11) % 10)"
    last = f"CASE WHEN {key} % 13 = 0 THEN ({second} + 1) % 10 ELSE {second} END"
    return f"SELECT *, concat(lpad(cast({n} as string), 9, '0'), cast({first} as string), cast({last} as string)) AS cpf11 FROM {source}"


def _cnpj(source: str, key: str) -> str:
    weights = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
    n = f"(({key} * 104729 + 777) % 100000000)"
    twelve = [*_digits(n, 8), "0", "0", "0", "1"]
    check = lambda total: f"((11 - ({total}) % 11) % 11 % 10)"
    first = check(_sum(twelve, weights[1:]))
    second = check(f"{_sum(twelve, weights)} + {first} * 2")
    return f"SELECT *, concat(lpad(cast({n} as string), 8, '0'), '0001', cast({first} as string), cast({second} as string)) AS cnpj14 FROM {source}"


def _dashed(c: str) -> str:
    return f"concat(substring({c}, 1, 3), '.', substring({c}, 4, 3), '.', substring({c}, 7, 3), '-', substring({c}, 10, 2))"


_P2 = lambda x: f"lpad(cast({x} as string), 2, '0')"
_DAY, _MONTH, _YEAR = "day(o_orderdate)", "month(o_orderdate)", "year(o_orderdate)"
_CENTS = "cast(round(o_totalprice * 100) as bigint)"
_WHOLE, _PART = f"cast(floor({_CENTS} / 100) as bigint)", f"lpad(cast({_CENTS} % 100 as string), 2, '0')"

PEOPLE = f"""
    SELECT k, cpf11,
        CASE k % 4 WHEN 0 THEN upper(full_name) WHEN 1 THEN concat('  ', lower(full_name), ' ') WHEN 2 THEN replace(full_name, ' ', '  ') ELSE full_name END AS name,
        CASE k % 3 WHEN 0 THEN cpf11 WHEN 1 THEN {_dashed("cpf11")} ELSE concat(substring(cpf11, 1, 9), ' ', substring(cpf11, 10, 2)) END AS cpf,
        CASE k % 7 WHEN 0 THEN concat('Pessoa', cast(k as string), '@@Mail.com') WHEN 1 THEN 'N/A' WHEN 2 THEN upper(concat('p', cast(k as string), '@mail.com')) WHEN 3 THEN concat('sem arroba ', cast(k as string)) ELSE concat('p', cast(k as string), '@mail.com') END AS email,
        CASE k % 5 WHEN 0 THEN concat('(61) 9', lpad(cast(k % 10000 as string), 4, '0'), '-1234') WHEN 1 THEN concat('+55619', lpad(cast(k % 10000 as string), 4, '0'), '4321') WHEN 2 THEN concat('3', lpad(cast(k % 1000 as string), 3, '0'), '-5566')
            WHEN 3 THEN concat('0613', lpad(cast(k % 1000 as string), 3, '0'), '7788') ELSE '-' END AS phone,
        {_pick(CITY, "k")} AS city, {_pick(STATE, "k")} AS state, seg, bal
    FROM ({_cpf("(SELECT c_custkey AS k, concat(" + _pick(FIRST, "c_custkey") + ", ' de ', " + _pick(LAST, "c_custkey * 3 + 1") + ", ' ', " + _pick(LAST, "c_custkey * 7 + 2") + ") AS full_name, c_mktsegment AS seg, c_acctbal AS bal FROM {customer}) t0", "k")}) t4
"""

ORDERS = f"""
    SELECT o_orderkey AS k, o_custkey AS client,
        CASE o_orderkey % 6 WHEN 0 THEN concat({_P2(_DAY)}, '/', {_P2(_MONTH)}, '/', cast({_YEAR} as string)) WHEN 1 THEN concat({_P2(_MONTH)}, '-', {_P2(_DAY)}, '-', cast({_YEAR} as string))
            WHEN 2 THEN concat(cast({_YEAR} as string), '-', {_P2(_MONTH)}, '-', {_P2(_DAY)}) WHEN 3 THEN concat(cast({_DAY} as string), ' de ', {_pick(("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"), _MONTH + " - 1")}, ' ', cast({_YEAR} as string))
            WHEN 4 THEN concat('31/02/', cast({_YEAR} as string)) ELSE '?' END AS date_text,
        CASE o_orderkey % 5 WHEN 0 THEN concat('R$ ', cast({_WHOLE} as string), ',', {_PART}) WHEN 1 THEN concat(cast({_WHOLE} as string), '.', {_PART}) WHEN 2 THEN concat('USD ', cast({_WHOLE} as string), '.', {_PART})
            WHEN 3 THEN '-' ELSE concat('(', cast({_WHOLE} as string), ',', {_PART}, ')') END AS amount_text,
        CASE o_orderstatus WHEN 'F' THEN 'Pago' WHEN 'O' THEN 'pendente?' ELSE 'sim' END AS status_text,
        o_orderkey % 101 = 0 AS junk, {_CENTS} AS cents
    FROM {{orders}}
"""

SUPPLIERS = f"""
    SELECT s_suppkey AS k, c.copy, CASE WHEN c.copy = 1 THEN upper(s_name) ELSE s_name END AS name, cnpj14,
        CASE WHEN s_suppkey % 9 = 0 THEN concat(substring(cnpj14, 1, 13), cast((cast(substring(cnpj14, 14, 1) as int) + 1) % 10 as string)) ELSE cnpj14 END AS cnpj, CASE WHEN c.copy = 1 THEN NULL ELSE s_nationkey END AS nation
    FROM ({_cnpj("(SELECT * FROM {supplier}) u0", "s_suppkey")}) s CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1) c WHERE c.copy = 0 OR s_suppkey % 3 = 0
"""

CATALOG = """
    SELECT concat('SKU-', cast(p_partkey AS string)) AS sku, c.copy, p_name AS name,
        CASE p_partkey % 3 WHEN 0 THEN concat('R$ ', cast(cast(floor(p_retailprice) AS bigint) AS string), ',50') WHEN 1 THEN concat(cast(cast(floor(p_retailprice) AS bigint) AS string), '.25') ELSE concat(cast(cast(floor(p_retailprice) AS bigint) AS string), '99 centavos') END AS price_text,
        concat(cast(p_size * 10 AS string), ',5') AS weight_text, CASE p_partkey % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'KG' WHEN 2 THEN 't' ELSE NULL END AS unit, CASE WHEN p_partkey % 17 = 0 THEN 'sim' ELSE 'não' END AS deleted
    FROM {part} CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1) c WHERE c.copy = 0 OR p_partkey % 10 = 0
"""

STOCK = """
    SELECT concat('SKU-', cast(l_partkey + CASE WHEN l_orderkey % 101 = 0 THEN 10000000 ELSE 0 END AS string)) AS sku, l_orderkey AS move,
        CASE l_returnflag WHEN 'R' THEN 'Entrada' WHEN 'A' THEN 'compra' ELSE 'Saída' END AS kind, cast(l_quantity AS bigint) AS qty
    FROM {lineitem}
"""

SALES = """
    SELECT concat('PV', cast(o_orderkey AS string)) AS code, 'system' AS source, 0 AS manual, o_custkey AS client, cast(round(o_totalprice * 100) AS bigint) AS cents, o_orderdate AS sold_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'loja' END AS channel FROM {orders}
    UNION ALL
    SELECT concat('PV', cast(o_orderkey AS string)), 'manual', 1, CASE WHEN o_orderkey % 30 = 0 THEN NULL ELSE o_custkey END, cast(round(o_totalprice * 100) AS bigint) + CASE WHEN o_orderkey % 20 = 0 THEN 100 ELSE 0 END, o_orderdate, 'planilha' FROM {orders} WHERE o_orderkey % 10 = 0
    UNION ALL
    SELECT concat('WEB-', cast(o_orderkey AS string)), 'web', 0, o_custkey, cast(round(o_totalprice * 100) AS bigint), o_orderdate, 'site' FROM {orders} WHERE o_orderkey % 50 = 0
    UNION ALL
    SELECT concat('WEB-', cast(o_orderkey + 900000000 AS string)), 'web', 0, CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE o_custkey END, cast(round(o_totalprice * 100) AS bigint), CASE WHEN o_orderkey % 77 = 0 THEN NULL ELSE o_orderdate END, 'site' FROM {orders} WHERE o_orderkey % 7 = 0
"""

PAYMENTS = """
    SELECT concat('PV', cast(o_orderkey AS string)) AS code, cast(round(o_totalprice * 100) AS bigint) + CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS paid_cents,
        CASE o_orderkey % 17 WHEN 0 THEN 'Refunded' WHEN 1 THEN 'CHARGEBACK' WHEN 2 THEN 'em analise' ELSE 'approved' END AS status
    FROM {orders} WHERE o_orderkey % 11 <> 0
"""

_TYPES = (
    "EDITAL DE PREGÃO ELETRÔNICO", "CONTRATO ADMINISTRATIVO", "NOTA DE EMPENHO", "2º TERMO ADITIVO", "NOTA FISCAL", "ORDEM BANCÁRIA", "TERMO DE REFERÊNCIA",
    "OFÍCIO", "ATA DE REGISTRO DE PREÇOS", "comunicado",
)

#: The place of a document's type in the list; a group of ten documents has about six of them.
TYPE = "(doc_id * doc_id + cast(floor(doc_id / 10) as bigint)) % 10"

DOCS = f"""
    SELECT doc_id, cast(floor(doc_id / 10) as bigint) AS grp, concat(CASE WHEN doc_id % 3 = 0 THEN concat('PREFEITURA  MUNICIPAL DE RECIFE', chr(10)) ELSE '' END, {_pick(_TYPES, TYPE)}, ' nº ', cast(doc_id % 90 + 1 as string), '/', CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE '23' END, chr(10),
            CASE WHEN doc_id % 5 = 4 THEN 'sem numero' ELSE concat('Processo nº ', lpad(cast(floor(doc_id / 10) as bigint) % 100000, 5, '0'), '.', '000123/2024-11') END, chr(10),
            'Valor: R$ ', cast(doc_id % 900 + 100 as string), ',50. fls. ', cast(doc_id % 10 * 3 + 1 as string), chr(10), 'Brasília, ', cast(doc_id % 28 + 1 as string), ' de março de 20', cast(10 + doc_id % 15 as string), chr(10), CASE WHEN doc_id % 4 = 0 THEN concat('Objeto: compra do lote ', cast(doc_id as string), chr(10)) ELSE '' END) AS head,
        text
    FROM {{documents}}
""".replace("lpad(cast(floor(doc_id / 10) as bigint) % 100000, 5, '0')", "lpad(cast(cast(floor(doc_id / 10) as bigint) % 100000 as string), 5, '0')")

FILES = """
    SELECT doc_id, text, concat(CASE doc_id % 7 WHEN 0 THEN 'backup_old/' WHEN 1 THEN 'Nova pasta (2)/' WHEN 2 THEN 'temp/' ELSE '' END,
            CASE doc_id % 6 WHEN 0 THEN 'relatorio FINAL v' WHEN 1 THEN 'clientes_final_final ' WHEN 2 THEN 'Cópia de notas ' WHEN 3 THEN '~$trava' WHEN 4 THEN 'senhas_sistema' ELSE 'vendas' END, cast(doc_id AS string),
            CASE doc_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.TXT' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.env' ELSE '.exe' END) AS path
    FROM {documents}
"""

VIEWS = {
    "people": (PEOPLE, ("customer",)),
    "orders_raw": (ORDERS, ("orders",)),
    "suppliers_raw": (SUPPLIERS, ("supplier",)),
    "catalog_raw": (CATALOG, ("part",)),
    "stock_raw": (STOCK, ("lineitem",)),
    "sales_raw": (SALES, ("orders",)),
    "payments": (PAYMENTS, ("orders",)),
    "docs_headed": (DOCS, ("documents",)),
    "files": (FILES, ("documents",)),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A messy view as a DataFrame."""
    text, bases = VIEWS[name]
    return spark.sql(text, **{b: table(spark, sf_dir, b) for b in bases})


def duck(*names: str) -> str:
    """WITH clauses of messy views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0].format(**{b: b for b in VIEWS[n][1]})})" for n in names)
