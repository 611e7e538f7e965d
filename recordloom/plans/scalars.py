"""Queries of the scalar functions over the messy views, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import dates, ids, money
from recordloom.functions import text as T
from recordloom.operators.privacy import masked
from recordloom.plans.dirty import duck, view

QUERIES: dict = {}
SQL: dict = {}

C = F.col


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def d_digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def d_pad(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) < {n} THEN lpad({x}, {n}, '0') ELSE {x} END"


def d_sum(d: str, weights) -> str:
    return "(" + " + ".join(f"try_cast(substring({d}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


def d_digit(d: str, i: int) -> str:
    return f"try_cast(substring({d}, {i + 1}, 1) AS INT)"


def d_varied(d: str, n: int) -> str:
    return f"(length({d}) = {n} AND {d} <> repeat(substring({d}, 1, 1), {n}))"


def d_cpf(d: str) -> str:
    return f"coalesce({d_varied(d, 11)} AND {d_sum(d, range(10, 1, -1))} * 10 % 11 % 10 = {d_digit(d, 9)} AND {d_sum(d, range(11, 1, -1))} * 10 % 11 % 10 = {d_digit(d, 10)}, false)"


def d_cnpj(d: str) -> str:
    w = ids.CNPJ_WEIGHTS
    check = lambda s, i: f"CASE WHEN {s} % 11 < 2 THEN 0 ELSE 11 - {s} % 11 END = {d_digit(d, i)}"
    return f"coalesce({d_varied(d, 14)} AND {check(d_sum(d, w[1:]), 12)} AND {check(d_sum(d, w), 13)}, false)"


def d_blank(x: str) -> str:
    words = ", ".join("'" + b.replace("'", "''") + "'" for b in T.BLANK)
    return f"({x} IS NULL OR lower(trim({x})) IN ({words}))"


def d_map(key: str, values: dict[str, str]) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def d_name(x: str) -> str:
    particles = ", ".join(f"'{p}'" for p in T.PARTICLES)
    words = f"string_split(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), ' ')"
    return f"CASE WHEN NOT {d_blank(x)} THEN array_to_string(list_transform({words}, lambda w, i: CASE WHEN i > 1 AND w IN ({particles}) THEN w ELSE concat(upper(substring(w, 1, 1)), substring(w, 2)) END), ' ') END"


def d_money(t: str) -> str:
    bare = f"regexp_replace({t}, 'R\\$|US\\$|USD|BRL|EUR|reais|real|centavos?|€|\\$', '', 'gi')"
    d = f"regexp_replace({t}, '[^0-9,.]', '', 'g')"
    last = lambda ch: f"(length({d}) - strpos(reverse({d}), '{ch}'))"
    number = f"""try_cast(CASE WHEN contains({d}, ',') AND contains({d}, '.') AND {last(',')} > {last('.')} THEN replace(replace({d}, '.', ''), ',', '.')
        WHEN contains({d}, ',') AND contains({d}, '.') THEN replace({d}, ',', '') WHEN contains({d}, ',') THEN replace({d}, ',', '.')
        WHEN regexp_matches({d}, '\\..*\\.') THEN replace({d}, '.', '') ELSE {d} END AS DOUBLE)"""
    negative = f"(({t} LIKE '(%' AND {t} LIKE '%)') OR {t} LIKE '-%')"
    return f"CASE WHEN NOT regexp_matches({bare}, '[A-Za-zÀ-ú]{{2,}}|[@/:#]') THEN CASE WHEN {negative} THEN -({number}) ELSE {number} END END"


@query("cpf_checksum", duck("people") + f", d AS (SELECT k, cpf, {d_pad(d_digits('cpf'), 11)} AS d FROM people) SELECT k, cpf, {d_cpf('d')} AS valid, concat(substring(d, 1, 3), '.', substring(d, 4, 3), '.', substring(d, 7, 3), '-', substring(d, 10)) AS formatted FROM d")
def cpf_checksum(spark, sf_dir):
    return view(spark, sf_dir, "people").select("k", "cpf", ids.cpf_valid(C("cpf")).alias("valid"), ids.format_cpf(C("cpf")).alias("formatted"))


@query("cnpj_checksum", duck("suppliers_raw") + f", d AS (SELECT k, copy, cnpj, {d_pad(d_digits('cnpj'), 14)} AS d FROM suppliers_raw) SELECT k, copy, {d_cnpj('d')} AS valid, concat(substring(d, 1, 2), '.', substring(d, 3, 3), '.', substring(d, 6, 3), '/', substring(d, 9, 4), '-', substring(d, 13)) AS formatted FROM d")
def cnpj_checksum(spark, sf_dir):
    return view(spark, sf_dir, "suppliers_raw").select("k", "copy", ids.cnpj_valid(C("cnpj")).alias("valid"), ids.format_cnpj(C("cnpj")).alias("formatted"))


_NUMBERS = "(SELECT k, lpad(cast(k * 48271 % 100000000000 AS string), 11, '0') AS pis, concat(cast(7 + k % 3 AS string), lpad(cast(k * 16807 % 100000000000000 AS string), 14, '0')) AS cns, concat('4', lpad(cast(k * 69621 % 1000000000000000 AS string), 15, '0')) AS card FROM orders_raw)"
_LUHN = "(" + " + ".join(
    f"CASE WHEN {i} % 2 = 1 THEN CASE WHEN {d_digit('card', 15 - i)} > 4 THEN {d_digit('card', 15 - i)} * 2 - 9 ELSE {d_digit('card', 15 - i)} * 2 END ELSE {d_digit('card', 15 - i)} END" for i in range(16)
) + ")"


@query(
    "number_checksums",
    duck("orders_raw")
    + f""" SELECT k, coalesce({d_varied('pis', 11)} AND CASE WHEN 11 - {d_sum('pis', ids.PIS_WEIGHTS)} % 11 >= 10 THEN 0 ELSE 11 - {d_sum('pis', ids.PIS_WEIGHTS)} % 11 END = {d_digit('pis', 10)}, false) AS pis_ok,
        regexp_full_match(cns, '[12789][0-9]{{14}}') AND {d_sum('cns', range(15, 0, -1))} % 11 = 0 AS cns_ok, {_LUHN} % 10 = 0 AS card_ok FROM {_NUMBERS}""",
)
def number_checksums(spark, sf_dir):
    rows = spark.sql("SELECT * FROM " + _NUMBERS.replace("FROM orders_raw", "FROM {orders_raw}"), orders_raw=view(spark, sf_dir, "orders_raw"))
    return rows.select("k", ids.pis_valid(C("pis")).alias("pis_ok"), ids.cns_valid(C("cns")).alias("cns_ok"), ids.card_valid(C("card")).alias("card_ok"))


_MARKS = " ".join(f"WHEN contains(lower(t), '{m}') THEN '{code}'" for m, code in money.CURRENCIES)


@query(
    "amount_parse",
    duck("orders_raw")
    + f""", t AS (SELECT k, amount_text, trim(amount_text) AS t, CASE {_MARKS.replace('lower(t)', 'lower(trim(amount_text))')} END AS mark FROM orders_raw),
        n AS (SELECT *, {d_money('t')} AS n, {d_blank('t')} AS blank FROM t)
        SELECT k, CASE WHEN NOT blank AND n IS NOT NULL THEN round(n, 2) END AS amount, CASE WHEN NOT blank AND n IS NOT NULL THEN coalesce(mark, 'BRL') END AS currency,
            CASE WHEN blank THEN '' WHEN n IS NULL THEN 'valor não reconhecido (' || t || ')' WHEN mark IS NULL THEN 'moeda não informada (assumido BRL)' WHEN mark <> 'BRL' THEN 'valor em ' || mark || ' — não convertido para BRL' ELSE '' END AS alert FROM n""",
)
def amount_parse(spark, sf_dir):
    return view(spark, sf_dir, "orders_raw").withColumn("a", money.amount(C("amount_text"))).select("k", "a.amount", "a.currency", "a.alert")


@query(
    "price_and_weight",
    duck("catalog_raw")
    + f""", t AS (SELECT sku, copy, lower(trim(price_text)) AS p, weight_text, lower(trim(coalesce(unit, 'kg'))) AS u FROM catalog_raw),
        n AS (SELECT *, regexp_matches(p, 'centavos?') AS cents, {d_money('weight_text')} AS w FROM t)
        SELECT sku, copy, CASE WHEN cents THEN try_cast(regexp_replace(p, '[^0-9]', '', 'g') AS DOUBLE) / 100 ELSE {d_money('p')} END AS price, cents,
            CASE u WHEN 'g' THEN round(w / 1000, 4) WHEN 't' THEN round(w * 1000, 3) ELSE round(w, 4) END AS kg,
            CASE u WHEN 'g' THEN 'peso em gramas convertido para kg' WHEN 't' THEN 'peso em toneladas convertido para kg' ELSE '' END AS kg_alert FROM n""",
)
def price_and_weight(spark, sf_dir):
    rows = view(spark, sf_dir, "catalog_raw").withColumn("p", money.price(C("price_text"))).withColumn("w", money.weight_kg(C("weight_text"), C("unit")))
    return rows.select("sku", "copy", "p.price", C("p.alert").contains("centavos").alias("cents"), "w.kg", C("w.alert").alias("kg_alert"))


_TRUE, _FALSE = (", ".join(f"'{w}'" for w in words) for words in (T.TRUE_WORDS, T.FALSE_WORDS))


@query(
    "status_words",
    duck("orders_raw")
    + f""" SELECT k, CASE WHEN {d_blank('status_text')} THEN NULL WHEN lower(strip_accents(trim(status_text))) IN ({_TRUE}) THEN true WHEN lower(strip_accents(trim(status_text))) IN ({_FALSE}) THEN false END AS flag,
        CASE WHEN lower(trim(status_text)) LIKE '%?' THEN trim(regexp_replace(lower(trim(status_text)), '\\?+$', '')) || ' (a confirmar)' ELSE lower(trim(status_text)) END AS status FROM orders_raw""",
)
def status_words(spark, sf_dir):
    return view(spark, sf_dir, "orders_raw").select("k", T.boolean(C("status_text")).alias("flag"), T.status(C("status_text")).alias("status"))


_SHORT = r"^(\d{1,2})([/\-.])(\d{1,2})[/\-.](\d{2,4})$"
_MONTH = "CASE " + " ".join(f"WHEN regexp_extract(date_text, ' de ([a-z]+) ', 1) = '{m}' THEN {n}" for m, n in dates.MONTHS.items()) + " END"
_D_DATE = f"""d AS (SELECT k, date_text, try_cast(regexp_extract(date_text, '{_SHORT}', 1) AS INT) AS a, regexp_extract(date_text, '{_SHORT}', 2) AS sep, try_cast(regexp_extract(date_text, '{_SHORT}', 3) AS INT) AS b,
            try_cast(regexp_extract(date_text, '{_SHORT}', 4) AS INT) AS y FROM orders_raw)"""


@query(
    "date_read",
    duck("orders_raw")
    + f""", {_D_DATE}, v AS (SELECT *, CASE WHEN regexp_matches(date_text, '^[0-9]{{4}}-') THEN try_cast(date_text AS DATE)
            WHEN contains(date_text, ' de ') THEN make_date(try_cast(right(date_text, 4) AS BIGINT), {_MONTH}, try_cast(regexp_extract(date_text, '^([0-9]+)', 1) AS BIGINT))
            WHEN sep <> '' AND b > 12 AND a <= 12 THEN try_cast(printf('%04d-%02d-%02d', y, a, b) AS DATE) WHEN sep <> '' THEN try_cast(printf('%04d-%02d-%02d', y, b, a) AS DATE) END AS value FROM d)
        SELECT k, strftime(value, '%Y-%m-%d') AS iso, CASE WHEN {d_blank('date_text')} THEN '' WHEN value IS NULL THEN 'data inexistente' WHEN sep = '' THEN '' WHEN a > 12 AND b <= 12 THEN ''
            WHEN b > 12 AND a <= 12 THEN 'formato americano MM/DD convertido' WHEN a = b THEN '' ELSE 'data ambígua: assumido DD/MM' END AS alert FROM v""",
)
def date_read(spark, sf_dir):
    return view(spark, sf_dir, "orders_raw").withColumn("d", dates.read_date(C("date_text"))).select("k", F.date_format("d.value", "yyyy-MM-dd").alias("iso"), "d.alert")


@query(
    "date_order_vote",
    duck("orders_raw") + f", {_D_DATE} SELECT sep, count(*) FILTER (a > 12 AND b <= 12) AS day_first, count(*) FILTER (b > 12 AND a <= 12) AS month_first, CASE WHEN count(*) FILTER (b > 12 AND a <= 12) > count(*) FILTER (a > 12 AND b <= 12) THEN 'MD' ELSE 'DM' END AS vote FROM d WHERE sep <> '' GROUP BY sep",
)
def date_order_vote(spark, sf_dir):
    part = lambda i: F.regexp_extract("date_text", _SHORT, i)
    rows = view(spark, sf_dir, "orders_raw").select(part(2).alias("sep"), part(1).try_cast("int").alias("a"), part(3).try_cast("int").alias("b")).filter("sep <> ''")
    counted = rows.groupBy("sep").agg(F.expr("count_if(a > 12 and b <= 12)").alias("day_first"), F.expr("count_if(b > 12 and a <= 12)").alias("month_first"))
    return counted.withColumn("vote", F.when(C("month_first") > C("day_first"), "MD").otherwise("DM"))


@query(
    "datetime_local",
    """SELECT event_id, strftime(coalesce(CASE WHEN event_id % 3 = 0 THEN to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC' - INTERVAL 3 HOURS WHEN event_id % 3 = 1 THEN date_trunc('second', ts) - INTERVAL 3 HOURS
        ELSE date_trunc('second', ts) - INTERVAL 5 HOURS END), '%Y-%m-%d %H:%M:%S') AS local, true AS has_time FROM events""",
)
def datetime_local(spark, sf_dir):
    from recordloom.tables import table

    second = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = F.when(C("event_id") % 3 == 0, F.unix_seconds(C("ts").cast("timestamp")).cast("string")).when(C("event_id") % 3 == 1, F.concat(F.replace(second, F.lit(" "), F.lit("T")), F.lit("Z"))).otherwise(F.concat(second, F.lit("+02:00")))
    rows = table(spark, sf_dir, "events").withColumn("d", dates.read_datetime(raw))
    return rows.select("event_id", F.date_format("d.ts", "yyyy-MM-dd HH:mm:ss").alias("local"), "d.has_time")


@query("name_normalize", duck("people") + f", n AS (SELECT k, {d_name('name')} AS person FROM people) SELECT k, person, lower(strip_accents(person)) AS name_key, trim(regexp_replace(lower(strip_accents(person)), '[^a-z0-9]+', ' ', 'g')) AS text_key FROM n")
def name_normalize(spark, sf_dir):
    return view(spark, sf_dir, "people").select("k", T.person_name(C("name")).alias("person"), T.name_key(C("name")).alias("name_key"), T.text_key(T.person_name(C("name"))).alias("text_key"))


_UFS = ", ".join(f"'{s}'" for s in T.STATES.values())


@query(
    "city_and_state",
    duck("people")
    + f""", s AS (SELECT k, regexp_replace(trim(city), '\\s+', ' ', 'g') AS t, upper(trim(strip_accents(state))) AS uf FROM people),
        c AS (SELECT *, upper(regexp_extract(t, '\\s*[-/,]\\s*([A-Za-z]{{2}})$', 1)) IN ({_UFS}) AS cut FROM s),
        b AS (SELECT *, CASE WHEN cut THEN regexp_replace(t, '\\s*[-/,]\\s*[A-Za-z]{{2}}$', '') ELSE t END AS base FROM c),
        m AS (SELECT *, {d_map("regexp_replace(lower(strip_accents(base)), '[^a-z]', '', 'g')", T.CITY_SHORT)} AS short, {d_map("lower(strip_accents(base))", T.CITIES)} AS known FROM b)
        SELECT k, coalesce(short, known, {d_name('base')}) AS city, CASE WHEN short IS NOT NULL THEN 'abreviação expandida' WHEN known IS NOT NULL AND length(base) <= 4 AND lower(strip_accents(base)) <> lower(known) THEN 'abreviação expandida'
            WHEN cut THEN 'UF removida do nome da cidade' ELSE '' END AS alert, CASE WHEN uf IN ({_UFS}) THEN uf ELSE {d_map("uf", T.STATES)} END AS state FROM m""",
)
def city_and_state(spark, sf_dir):
    return view(spark, sf_dir, "people").withColumn("c", T.city(C("city"))).select("k", C("c.value").alias("city"), "c.alert", T.state(C("state")).alias("state"))


_MADE = "regexp_replace(replace(lower(trim(email)), ' ', ''), '@+', '@', 'g')"


@query(
    "email_normalize",
    duck("people")
    + f""" SELECT k, CASE WHEN NOT {d_blank('email')} AND regexp_full_match({_MADE}, '[^@\\s]+@[^@\\s]+\\.[a-z]{{2,}}') THEN {_MADE} END AS value,
        CASE WHEN {d_blank('email')} THEN 'e-mail vazio' WHEN NOT regexp_full_match({_MADE}, '[^@\\s]+@[^@\\s]+\\.[a-z]{{2,}}') THEN 'e-mail inválido (' || trim(email) || ')'
            WHEN contains(email, '@@') THEN '''@@'' corrigido para ''@''' WHEN trim(email) <> lower(trim(email)) THEN 'convertido para minúsculas' ELSE '' END AS alert FROM people""",
)
def email_normalize(spark, sf_dir):
    return view(spark, sf_dir, "people").withColumn("e", T.email(C("email"))).select("k", "e.value", "e.alert")


@query(
    "phone_normalize",
    duck("people")
    + f""", a AS (SELECT k, phone, {d_digits('phone')} AS d FROM people), b AS (SELECT k, phone, CASE WHEN d LIKE '55%' AND length(d) IN (12, 13) THEN substring(d, 3) ELSE d END AS d FROM a),
        c AS (SELECT k, phone, CASE WHEN d LIKE '0%' AND length(d) IN (11, 12) THEN substring(d, 2) ELSE d END AS d FROM b), e AS (SELECT *, length(d) IN (8, 9) AS bare, CASE WHEN length(d) IN (8, 9) THEN '61' || d ELSE d END AS f FROM c),
        v AS (SELECT *, CASE WHEN length(f) = 11 AND substring(f, 3, 1) = '9' THEN '+55 (' || substring(f, 1, 2) || ') ' || substring(f, 3, 5) || '-' || substring(f, 8, 4)
            WHEN length(f) = 10 THEN '+55 (' || substring(f, 1, 2) || ') ' || substring(f, 3, 4) || '-' || substring(f, 7, 4) END AS value FROM e)
        SELECT k, CASE WHEN NOT {d_blank('phone')} THEN value END AS value, CASE WHEN {d_blank('phone')} THEN 'telefone vazio' WHEN value IS NULL THEN 'telefone inválido (' || phone || ')' WHEN bare THEN 'DDD 61 inferido' ELSE '' END AS alert FROM v""",
)
def phone_normalize(spark, sf_dir):
    return view(spark, sf_dir, "people").withColumn("p", T.phone(C("phone"), F.lit("61"))).select("k", "p.value", "p.alert")


@query(
    "format_census",
    duck("people", "orders_raw").replace("WITH", "WITH", 1)
    + f""", f AS (
        SELECT 'cpf' AS field, CASE WHEN regexp_full_match(cpf, '[0-9]{{3}}\\.[0-9]{{3}}\\.[0-9]{{3}}-[0-9]{{2}}') THEN '000.000.000-00' WHEN regexp_full_match(cpf, '[0-9]{{11}}') THEN 'só dígitos' WHEN regexp_full_match(cpf, '[0-9 ]+') THEN 'dígitos com espaços' ELSE 'outro' END AS label FROM people
        UNION ALL SELECT 'nome', CASE WHEN name <> trim(name) THEN 'espaços sobrando' WHEN name = upper(name) THEN 'MAIÚSCULAS' WHEN name = lower(name) THEN 'minúsculas' ELSE 'Normal' END FROM people
        UNION ALL SELECT 'email', CASE WHEN {d_blank('email')} THEN 'vazio/N/A' WHEN contains(email, '@@') THEN 'com @@' WHEN email <> lower(email) THEN 'MAIÚSCULAS' WHEN regexp_full_match(email, '[^@\\s]+@[^@\\s]+\\.\\w+') THEN 'minúsculas' ELSE 'inválido' END FROM people
        UNION ALL SELECT 'telefone', CASE WHEN {d_blank('phone')} THEN 'vazio/N/A' WHEN phone LIKE '+55%' THEN '+55DDNÚMERO' WHEN regexp_full_match(phone, '\\([0-9]{{2}}\\)\\s?[0-9]{{4,5}}-[0-9]{{4}}') THEN '(DD) NNNNN-NNNN'
            WHEN length({d_digits('phone')}) IN (10, 11) THEN 'DDNÚMERO só dígitos' WHEN length({d_digits('phone')}) IN (8, 9) THEN 'sem DDD' ELSE 'outro' END FROM people)
        SELECT field, label, count(*) AS n FROM f GROUP BY 1, 2""",
)
def format_census(spark, sf_dir):
    people = view(spark, sf_dir, "people")
    fields = {"cpf": "cpf", "nome": "name", "email": "email", "telefone": "phone"}
    labels = F.array(*(F.struct(F.lit(f).alias("field"), T.format_label(f, C(c)).alias("label")) for f, c in fields.items()))
    return people.select(F.explode(labels).alias("x")).groupBy("x.field", "x.label").agg(F.count("*").alias("n"))


@query(
    "mask_values",
    duck("people")
    + f""" SELECT k, '***.' || substring(cpf11, 4, 3) || '.' || substring(cpf11, 7, 3) || '-**' AS cpf_masked, CASE WHEN contains(email, '@') THEN substring(split_part(email, '@', 1), 1, 2) || '***@' || regexp_extract(email, '@(.*)$', 1)
            WHEN length(email) <= 4 THEN '***' ELSE substring(email, 1, 2) || repeat('*', length(email) - 4) || right(email, 2) END AS email_masked,
        CASE WHEN length({d_digits('phone')}) >= 8 THEN '(**) *****-' || right({d_digits('phone')}, 4) WHEN length(phone) <= 4 THEN '***' ELSE 'x' END AS phone_masked FROM people""",
)
def mask_values(spark, sf_dir):
    return view(spark, sf_dir, "people").select("k", masked(F.lit("CPF"), C("cpf")).alias("cpf_masked"), masked(F.lit("E-mail"), C("email")).alias("email_masked"), masked(F.lit("Telefone"), C("phone")).alias("phone_masked"))


@query(
    "names_compatible",
    duck("people")
    + f""", n AS (SELECT k, string_split(lower(strip_accents({d_name('name')})), ' ') AS w FROM people)
        SELECT a.k, a.w[1] = b.w[1] AND a.w[-1] = b.w[-1] AND substring(a.w[2], 1, 1) = substring(b.w[2], 1, 1) AND (len(a.w) = 3 OR substring(a.w[3], 1, 1) = substring(b.w[3], 1, 1)) AS compatible
        FROM n a JOIN n b ON b.k = a.k + 143""",
)
def names_compatible(spark, sf_dir):
    people = view(spark, sf_dir, "people").select("k", "name")
    other = people.select((C("k") - 143).alias("k"), C("name").alias("other"))
    return people.join(other, "k").select("k", T.names_compatible(C("name"), C("other")).alias("compatible"))
