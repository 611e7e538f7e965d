"""People across sources: records, constrained clusters, golden records, conflicts, CPF owners, and links of transactions to people."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import ids
from recordloom.functions.dates import read_date
from recordloom.functions.money import amount
from recordloom.functions.text import blank, boolean, city, email, first_filled, items, name_key, names_compatible, person_name, phone, status, text_key
from recordloom.operators import cluster
from recordloom.tables import free_name, written

FIELDS = ("name", "cpf", "email", "phone", "birth", "city")
#: Lines of one source that a record number leaves room for.
_LINES = 1 << 40


def records(sources: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """Normalised people of sources (name, priority, rows with line, id, name, cpf, email, phone, birth, city as text), with a record number rid.

    Sources come by priority, so a smaller rid is the earlier record. quality counts what is filled, a valid CPF twice.
    """
    out = None
    for i, (source, priority, rows) in enumerate(sorted(sources, key=lambda s: (-s[1], s[0]))):
        d = ids.cpf_digits(F.col("cpf"))
        part = rows.select(
            (F.lit(i * _LINES) + F.col("line")).alias("rid"), F.lit(source).alias("source"), F.lit(priority).alias("priority"), "line", ids.id_text(F.col("id")).alias("id"),
            person_name(F.col("name")).alias("name"), d.alias("cpf"), F.coalesce(ids.cpf_valid(d) & d.isNotNull(), F.lit(False)).alias("cpf_ok"), email(F.col("email"))["value"].alias("email"),
            phone(F.col("phone"), keep_short=True)["value"].alias("phone"), read_date(F.col("birth"))["value"].alias("birth"), city(F.col("city"))["value"].alias("city"),
        )
        out = part if out is None else out.unionByName(part)
    filled = [F.col(c).isNotNull().cast("int") for c in ("email", "phone", "birth", "city")]
    return out.withColumn("quality", 2 * F.col("cpf_ok").cast("int") + sum(filled, F.lit(0)))


def evidence(people: DataFrame) -> DataFrame:
    """(phase, ord, a, b): candidate links, each record to the first with the same key, in the order in which they are tried."""

    def star(phase: int, *key: Column, where: Column | None = None, by_group: bool = False) -> DataFrame:
        rows = people if where is None else people.filter(where)
        rows = rows.select("rid", F.struct(*key).alias("key"), "name")
        first = rows.groupBy("key").agg(F.min(F.struct("rid", "name")).alias("first"))
        return rows.join(first, "key").filter(F.col("rid") != F.col("first.rid")).select(F.lit(phase).alias("phase"), F.col("first.rid" if by_group else "rid").alias("ord"), F.col("first.rid").alias("a"), F.col("rid").alias("b"), F.col("first.name").alias("na"), "name")

    full = F.size(F.split(name_key(F.col("name")), " ")) >= 2
    out = star(1, F.col("source"), F.col("id"), where=F.col("id").isNotNull())
    out = out.union(star(2, F.col("id"), where=F.col("id").isNotNull(), by_group=True).filter(names_compatible(F.col("na"), F.col("name"))))
    out = out.union(star(3, F.col("cpf"), where=F.col("cpf_ok"))).union(star(4, F.col("email"), where=F.col("email").isNotNull()))
    return out.union(star(5, name_key(F.col("name")), where=F.col("name").isNotNull() & full)).select("phase", "ord", "a", "b")


def clusters(people: DataFrame, finish: int = cluster.FINISH) -> tuple[DataFrame, DataFrame]:
    """(rid, cluster) of every record, and the refused links (a, b, reason): the evidence in its order, under the exclusions of cluster.constrained()."""
    return cluster.constrained(people, evidence(people), finish)


def golden(people: DataFrame, fields: tuple[str, ...] = FIELDS, cluster: str = "cluster") -> DataFrame:
    """One record for each cluster: of each field the value of the best record that has one, by priority, quality and line."""
    best = lambda f: F.expr(f"min_by(`{f}`, struct(-priority, -quality, source, line)) FILTER (WHERE `{f}` IS NOT NULL)")
    return people.groupBy(cluster).agg(*(best(f).alias(f) for f in fields), F.count("*").alias("n_records"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


def conflicts(people: DataFrame, fields: tuple[str, ...] = FIELDS, cluster: str = "cluster") -> DataFrame:
    """(cluster, field, values): fields with more than one value in a cluster, each with its sources."""
    long = people.select(cluster, "source", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).filter("x.value is not null")
    per_value = long.groupBy(cluster, "x.field", "x.value").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    shown = F.array_join(F.array_sort(F.collect_list(F.concat("value", F.lit(" ("), "sources", F.lit(")")))), "; ")
    return per_value.groupBy(cluster, "field").agg(F.count("*").alias("n"), shown.alias("values")).filter("n > 1").select(cluster, "field", "values")


def cpf_owner(people: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cpf, cluster): the cluster that shows a valid CPF most often, the first on ties."""
    counted = people.filter("cpf_ok").groupBy("cpf", cluster).count()
    return counted.groupBy("cpf").agg(F.min_by(cluster, F.struct(-F.col("count"), F.col(cluster))).alias(cluster))


def source_stats(people: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(source, n_rows, n_people, n_duplicates): lines of each source, the people they stand for, and lines beyond the first of a person."""
    n_rows, n_people = F.count("*"), F.count_distinct(cluster)
    return people.groupBy("source").agg(n_rows.alias("n_rows"), n_people.alias("n_people"), (n_rows - n_people).alias("n_duplicates"))


def in_order(people: DataFrame, id_: str = "id", name: str = "name") -> DataFrame:
    """people by number of the id, then name; ids that are no numbers, and missing names, come last."""
    return people.orderBy(F.col(id_).try_cast("double").asc_nulls_last(), F.col(name).asc_nulls_last())


def reference_index(people: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(kind, key, n, cluster): what a transaction may name a person by, with the number of clusters it stands for."""
    key = name_key(F.col("name"))
    named = F.array(
        F.struct(F.lit("email").alias("kind"), F.col("email").alias("key")),
        F.struct(F.lit("cpf").alias("kind"), F.col("cpf").alias("key")),
        F.struct(F.lit("id").alias("kind"), F.col("id").alias("key")),
        F.struct(F.lit("name").alias("kind"), F.when(F.size(F.split(key, " ")) >= 2, key).alias("key")),
        F.struct(F.lit("first").alias("kind"), F.nullif(F.element_at(F.split(key, " "), 1), F.lit("")).alias("key")),
    )
    rows = people.select(cluster, F.explode(named).alias("x")).filter("x.key is not null")
    return rows.groupBy("x.kind", "x.key").agg(F.count_distinct(cluster).alias("n"), F.min(cluster).alias("cluster"))


def linked(transactions: DataFrame, index: DataFrame, ref: str) -> DataFrame:
    """transactions with cluster, method and note: the reference decides which kind it is, one join looks it up, ambiguity is refused."""
    t = F.trim(F.col(ref))
    bare = F.regexp_replace(t, r"[ .\-/]", "")
    number = bare.rlike("^[0-9]+$")
    key = name_key(t)
    kind = F.when(t.contains("@"), "email").when(number & (F.length(bare) >= 9), "cpf").when(number, "id").when(F.size(F.split(key, " ")) >= 2, "name").otherwise("first")
    rows = transactions.withColumn("_kind", kind)
    made = F.when(F.col("_kind") == "email", F.lower(t)).when(F.col("_kind") == "cpf", ids.cpf_digits(bare)).when(F.col("_kind") == "id", bare).otherwise(key)
    rows = rows.withColumn("_key", made).join(index.withColumnsRenamed({"kind": "_kind", "key": "_key", "n": "_n", "cluster": "_c"}), ["_kind", "_key"], "left")
    one = F.col("_n") == 1
    note = F.when(one, "").when(F.col("_n") > 1, F.concat(F.lit("nome ambíguo: "), F.col("_n").cast("string"), F.lit(" clientes homônimos"))).otherwise("não encontrado")
    return rows.select(*transactions.columns, F.when(one, F.col("_c")).alias("cluster"), F.when(one, F.col("_kind")).alias("method"), note.alias("note"))


#: Bytes of names that one automaton takes; of more there are several, each of which reads the texts once.
NAME_BYTES = 4 << 20
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, names: list[str]) -> ahocorasick.Automaton:
    """The automaton of a part of the names, made once in a worker."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for n in names:
            made.add_word(f" {n} ", n)
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def _named(key: str, names: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(key, names.value)
        for batch in batches:
            held = [sorted({name for _, name in found.iter(text)}) for text in batch["key"].to_pylist()]
            place = pa.array([i for i, some in enumerate(held) for _ in some], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc"].take(place), pa.array([n for some in held for n in some], pa.string())], ["doc", "name_key"])

    return run


def mentions(texts: DataFrame, people: DataFrame, name_bytes: int = NAME_BYTES) -> DataFrame:
    """(doc, name_key): full names of two words or more, however many, that stand in a text (doc, text), each once.

    The names are dealt to automata of a bounded size; a text runs through one once and gives no more rows than it holds names. Null texts hold none.
    """
    spark = texts.sparkSession
    keys = written(people.select(text_key(F.col("name")).alias("name_key")).filter("name_key like '% %'").distinct(), "names")
    n = -(-(keys.agg(F.sum(F.octet_length("name_key") + 2)).first()[0] or 0) // name_bytes)
    rows = texts.filter("text is not null").select("doc", F.concat(F.lit(" "), text_key(F.col("text")), F.lit(" ")).alias("key"))
    rows, shape = written(rows, "texts") if n > 1 else rows, f"doc {dict(texts.dtypes)['doc']}, name_key string"
    out = spark.createDataFrame([], shape)
    for i in range(n):
        part = [r.name_key for r in keys.filter(F.pmod(F.xxhash64("name_key"), F.lit(n)) == i).collect()]  # of bounded size
        out = out.union(rows.mapInArrow(_named(uuid.uuid4().hex, spark.sparkContext.broadcast(part)), shape))
    return out.distinct()


# The names of columns by role, roles of people and of transactions, words of kinds of people and of inactive rows.
ROLES = {
    "id": (
        "id", "codigo", "cod", "id_cliente", "cliente_id", "cod_cliente", "pedido_id", "pedidoid", "id_pedido", "id_venda", "venda_id", "vendaid", "numero", "num", "matricula",
        "id_beneficiario", "pedido", "order", "order_ref", "order_id", "customer_id",
    ),
    "nome": ("nome", "nome_completo", "name", "full_name", "nome_cliente", "nm_cliente", "razao_social", "nome_beneficiario"),
    "cpf": ("cpf", "documento", "doc", "nr_cpf", "cpf_cnpj", "num_documento", "cpf_cliente", "tax_id"),
    "email": ("email", "e_mail", "mail", "correio_eletronico", "email_cliente"),
    "telefone": ("telefone", "fone", "tel", "celular", "whatsapp", "phone", "telefone_celular"),
    "cidade": ("cidade", "municipio", "city", "localidade", "cidade_uf", "municipio_uf", "cidade_estado"),
    "nascimento": ("dt_nasc", "data_nascimento", "nascimento", "data_nasc", "dt_nascimento", "birth", "birthdate"),
    "senha": ("senha", "password", "pass", "pwd", "senha_acesso", "passwd", "senha_md5", "senha_hash", "password_hash"),
    "cartao": ("cartao", "card", "numero_cartao", "cartao_credito", "cc", "num_cartao"),
    "valor": ("valor", "vlr", "preco", "total", "amount", "valor_total", "vl_pago", "valor_pago", "amount_value"),
    "data": ("data", "dt", "date", "data_venda", "data_pedido", "dt_venda", "dt_pagamento", "data_pagamento", "created_at", "created_at_utc", "data_hora", "dia", "ts", "timestamp"),
    "sku": ("sku", "cod_produto", "codigo_produto", "produto_sku"),
    "qtd": ("qtd", "qty", "quantidade", "quant", "qtde"),
    "pago": ("pago", "status_pagamento", "paid", "quitado", "foi_pago"),
    "status": ("status", "situacao", "estado_pedido"),
    "itens": ("itens", "items", "produtos", "produto", "item"),
    "cliente_ref": ("cliente", "cli", "cliente_id", "id_cliente", "cod_cliente", "comprador", "beneficiario", "cliente_nome", "cliente_cpf", "cliente_email", "cliente_documento", "customer"),
}
OF_PEOPLE, OF_TRANSACTIONS = ("nome", "cpf", "email", "telefone", "nascimento"), ("valor", "itens", "sku", "qtd", "pago")
OWN_IDS = ("id_cliente", "cliente_id", "cod_cliente")
PEOPLE_KINDS = (
    ("leads", r"(?i)lead|prospect|feira|evento|campanha|newsletter|interessad"),
    ("colaboradores", r"(?i)folha|(^|/)rh(/|_|$)|funcion|colaborad|servidor|vendedor|comiss|holerite|salari"),
)
INACTIVE = r"(?i)exclu|delet|inativ|cancelad|bloquead|removid|desativ"


def role_of(column: str) -> str | None:
    """The role of a column by its name, without a number at its end."""
    base = re.sub(r"_\d+$", "", column)
    named = [role for role, names in ROLES.items() if base in names]
    return named[0] if named else "cliente_ref" if base.startswith(("cliente_", "customer_")) else None


def table_kind(columns: list[str]) -> tuple[str, dict[str, list[str]]]:
    """("pessoas", "transacoes" or "outra", columns by role) of a table.

    People have two personal columns, or one beside an id, and nothing of a transaction; a transaction refers to a client. In a register of people a
    client id is the row's own, in transactions it refers.
    """
    roles: dict[str, list[str]] = {}
    for c in columns:
        if role := role_of(c):
            roles.setdefault(role, []).append(c)
    own = [c for c in roles.get("id", []) if re.sub(r"_\d+$", "", c) in OWN_IDS]
    personal, booked = sum(r in roles for r in OF_PEOPLE), any(r in roles for r in OF_TRANSACTIONS)
    if not booked and "cliente_ref" not in roles and (personal >= 2 or (personal and "id" in roles)):
        return "pessoas", roles
    # A client's id is found under id; beside the columns of a transaction it is the reference.
    if "cliente_ref" in roles or (own and booked):
        left = [c for c in roles.get("id", []) if c not in own]
        return "transacoes", {k: v for k, v in roles.items() if k != "id"} | ({"id": left} if left else {}) | {"cliente_ref": roles.get("cliente_ref", []) + own}
    return "outra", roles


def people_kind(path: Column) -> Column:
    """clientes, or leads or colaboradores by a path and table name."""
    return F.coalesce(*(F.when(path.rlike(p), name) for name, p in PEOPLE_KINDS), F.lit("clientes"))


def populations(rows: DataFrame, path: str = "path") -> DataFrame:
    """(kind, n, main): people by kind of their register; clients are the main population, without any the largest kind, the first name on ties."""
    counted = rows.groupBy(people_kind(F.col(path)).alias("kind")).agg(F.count("*").alias("n"))
    best = counted.agg(F.min_by("kind", F.struct(F.col("kind") != "clientes", -F.col("n"), F.col("kind"))).alias("best"))
    return counted.join(F.broadcast(best), F.lit(True)).select("kind", "n", (F.col("kind") == F.col("best")).alias("main"))  # best is one row


# Fixed value: words in the names of columns that tell of consent.
CONSENT = r"consent|optin|opt_in|aceite|autoriza"


def side_registry(rows: DataFrame, path: str = "path") -> DataFrame:
    """(kind, name, email, phone, consent, may_contact) of leads and staff, by the roles of their columns, apart from clients and never merged with them.

    The first column whose name tells of consent counts; without one both are null. What isn't known to be a yes may not be contacted. Columns of a role are
    tried in their order; a missing one gives null. Registers of clients are left out.
    """
    _, roles = table_kind([c for c in rows.columns if c != path])
    one = lambda role: first_filled(*(F.col(f"`{c}`").cast("string") for c in roles[role])) if roles.get(role) else F.lit(None).cast("string")
    told = next((c for c in rows.columns if re.search(CONSENT, c)), None)
    yes = boolean(F.col(f"`{told}`").cast("string")) if told else None
    consent = F.when(yes, "sim").when(~yes, "não").otherwise("não informado") if told else F.lit(None).cast("string")
    may = F.when(F.coalesce(yes, F.lit(False)), "sim").otherwise("NÃO (sem consentimento registrado — LGPD art. 7º, I)") if told else F.lit(None).cast("string")
    kind = people_kind(F.col(path))
    return rows.filter(kind != "clientes").select(
        kind.alias("kind"), person_name(one("nome")).alias("name"), email(one("email"))["value"].alias("email"), phone(one("telefone"), keep_short=True)["value"].alias("phone"), consent.alias("consent"), may.alias("may_contact"),
    )


def assigned_roles(columns: list[str]) -> dict[str, str]:
    """(role: column), at most one column a role and one role a column: the most pairs, and of these the best by name.

    A column that has a name of the role scores highest, by the place of that name in the role's list; one with a number at its end a little less; one that has
    a name of the role as a part least. Columns take turns in finding a role, and make room where another role serves them too.
    """
    score: dict[str, dict[str, float]] = {}
    for c in columns:
        base = re.sub(r"_\d+$", "", c)
        for role, names in ROLES.items():
            if base in names:
                score.setdefault(c, {})[role] = 3 - names.index(base) / len(names) - (0.5 if base != c else 0)
            elif part := [n for n in names if len(n) > 3 and n in base.split("_")]:
                score.setdefault(c, {})[role] = 1 - names.index(part[0]) / len(names)
    held: dict[str, str] = {}

    def place(c: str, tried: set[str]) -> bool:
        for role in sorted(score[c], key=lambda r: (-score[c][r], r)):
            if role not in tried:
                tried.add(role)
                if role not in held or place(held[role], tried):
                    held[role] = c
                    return True
        return False

    for c in sorted(score, key=lambda c: (-max(score[c].values()), columns.index(c))):
        place(c, set())
    return held


def mapped_columns(rows: DataFrame, roles: dict[str, str]) -> DataFrame:
    """rows with the columns of roles (role: column) under the first name of their role, where their own name tells none and that name is free, so that any
    table has the names that the operators know."""
    taken = {c.lower() for c in rows.columns}
    named = {column: ROLES[role][0] for role, column in roles.items() if role_of(column) is None and ROLES[role][0] not in taken}
    return rows.select(*[F.col(f"`{c}`").alias(named.get(c, c)) for c in rows.columns])


def inactive(status: Column) -> Column:
    """Whether a status says that a row is deleted or blocked."""
    return F.coalesce(status.rlike(INACTIVE), F.lit(False))


def area_code(rows: DataFrame, phone_: str, share: float = 0.8) -> DataFrame:
    """One row: the area code that at least a share of the numbers with one have, else null; ties go to the smaller."""
    d = ids.digits(F.col(phone_))
    d = F.when(d.startswith("55") & F.length(d).isin(12, 13), F.substring(d, 3, 11)).otherwise(d)
    many = rows.select(F.when(F.length(d).isin(10, 11), F.substring(d, 1, 2)).alias("area")).filter("area is not null").groupBy("area").count()
    return many.agg(F.max_by("area", F.struct("count", -F.col("area").cast("int"))).alias("area"), (F.max("count") / F.sum("count")).alias("share")).select(F.when(F.col("share") >= share, F.col("area")).alias("area"))


def golden_phone(people: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, phone): of each cluster the best phone; one with an area code comes before those without."""
    order = F.struct((~F.col("phone").startswith("+55")).alias("short"), (-F.col("priority")).alias("p"), (-F.col("quality")).alias("q"), "source", "line")
    return people.filter("phone is not null").groupBy(cluster).agg(F.min_by("phone", order).alias("phone"))


def golden_cpf(people: DataFrame, extra: DataFrame | None = None, cluster: str = "cluster") -> DataFrame:
    """(cluster, cpf, cpf_status, foreign): of each cluster the best CPF that is valid and its own.

    extra has (cluster, cpf, origin) of CPFs cited elsewhere, which repair an invalid one. A valid CPF belongs to the cluster that shows it most often;
    another cluster's is foreign and never used. Without a valid one the best candidate stays, marked.
    """
    owner = cpf_owner(people, cluster).select("cpf", F.col(cluster).alias("owner"))
    own = people.filter("cpf is not null").select(cluster, "cpf", "cpf_ok", F.concat("source", F.lit(" linha "), "line").alias("origin"), F.struct(F.lit(0).alias("x"), (-F.col("priority")).alias("p"), (-F.col("quality")).alias("q"), "source", F.col("line").cast("long").alias("line")).alias("at"))
    if extra is not None:
        last = F.struct(F.lit(1).alias("x"), F.lit(0).alias("p"), F.lit(0).alias("q"), F.col("origin").alias("source"), F.lit(0).cast("long").alias("line"))
        own = own.unionByName(extra.select(cluster, "cpf", ids.cpf_valid(F.col("cpf")).alias("cpf_ok"), "origin", last.alias("at")))
    rows = own.join(owner, "cpf", "left").withColumn("foreign", F.col("cpf_ok") & (F.coalesce("owner", F.col(cluster)) != F.col(cluster)))
    best = lambda c, where: F.expr(f"min_by({c}, at) FILTER (WHERE {where})")
    held = rows.groupBy(cluster).agg(
        best("cpf", "cpf_ok and not foreign").alias("good"), best("origin", "cpf_ok and not foreign").alias("origin"), best("cpf", "true").alias("any"), best("cpf_ok", "at.x = 0").alias("first_ok"),
        F.array_join(F.array_sort(F.array_distinct(F.expr("collect_list(cpf) FILTER (WHERE foreign)"))), ", ").alias("foreign"),
    )
    status = (
        F.when(F.col("good").isNull(), "INVÁLIDO em todas as fontes — conferir com o titular")
        .when(F.coalesce("first_ok", F.lit(True)), "válido")
        .otherwise(F.concat(F.lit("corrigido: cadastro principal tinha CPF inválido; válido encontrado em "), "origin"))
    )
    out = held.select(cluster, ids.format_cpf(F.coalesce("good", "any")).alias("cpf"), status.alias("cpf_status"), "foreign")
    alone = people.select(cluster).distinct().join(out, cluster, "left")
    return alone.select(cluster, "cpf", F.coalesce("cpf_status", F.lit("sem CPF")).alias("cpf_status"), F.coalesce("foreign", F.lit("")).alias("foreign"))


def corrections(rows: DataFrame, key: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, field, raw, corrected, alert): values that reading changed or remarked on; fields are (cleaned value, alert) by column. CPFs are masked."""
    hide = lambda f, c: F.when(F.lit(f) == "cpf", mask_cpf(c)).otherwise(c)
    notes = [
        F.struct(F.lit(f).alias("field"), hide(f, F.col(f).cast("string")).alias("raw"), hide(f, value.cast("string")).alias("corrected"), F.coalesce(alert, F.lit("")).alias("alert"), (~F.col(f).cast("string").eqNullSafe(value.cast("string"))).alias("changed"))
        for f, (value, alert) in fields.items()
    ]
    out = rows.select(F.col(key).alias("key"), F.explode(F.array(*notes)).alias("n")).filter("n.changed or n.alert <> ''")
    return out.filter("n.raw is not null").select("key", "n.field", "n.raw", "n.corrected", "n.alert")


def mask_cpf(c: Column) -> Column:
    """A CPF as a log may show it."""
    d = ids.digits(c)
    return F.when(c.isNull(), c).when(F.length(d) >= 9, F.concat(F.lit("***."), F.substring(d, 4, 3), F.lit("."), F.substring(d, 7, 3), F.lit("-**"))).otherwise("***")


def transactions(rows: DataFrame, entity: str, index: DataFrame, month_first: bool = False) -> DataFrame:
    """Transactions in one shape by the roles of their columns: id, cluster, link, reference, value, currency, date, paid, status, items, last card digits.

    The first reference that finds a person counts. Columns without a role stay as they are.
    """
    _, roles = table_kind(rows.columns)
    used = {c for cs in roles.values() for c in cs}
    one = lambda role: first_filled(*map(F.col, roles[role])) if roles.get(role) else F.lit(None).cast("string")
    refs = roles.get("cliente_ref", [])
    row, given = free_name(rows, "row_number"), free_name(rows, "given_reference")
    found = written(rows.withColumn(row, F.monotonically_increasing_id()), "transactions")
    shape = f"{row} long, i int, cluster {dict(index.dtypes)['cluster']}, method string, note string, reference string"
    tried = rows.sparkSession.createDataFrame([], shape)  # without a reference nothing is tried
    for i, c in enumerate(refs):
        part = linked(found.filter(~blank(F.col(c))).select(row, F.col(c).cast("string").alias(given)), index, given)
        tried = tried.union(part.select(row, F.lit(i).alias("i"), "cluster", "method", "note", F.concat(F.lit(f"{c}="), given).alias("reference")))
    best = tried.groupBy(row).agg(F.min_by(F.struct("cluster", "method", "note", "reference"), F.struct(F.col("cluster").isNull(), "i")).alias("b"))
    made = amount(one("valor"))
    paid = boolean(one("pago"))
    when = read_date(one("data"), month_first)
    card = one("cartao")
    unlinked = F.concat(F.lit("NÃO VINCULADO ("), F.coalesce("b.note", F.lit("")), F.lit(")"))
    out = found.join(best, row, "left").select(
        ids.id_text(one("id")).alias(f"{entity}_id"), "b.cluster", F.when(F.col("b.cluster").isNotNull(), F.col("b.method")).otherwise(unlinked).alias("link"), "b.reference",
        made["amount"].alias("value"), made["currency"].alias("currency"), when["value"].alias("date"), F.when(paid, "sim").when(~paid, "não").otherwise("não informado").alias("paid"),
        status(one("status")).alias("status"), items(one("itens")).alias("items"), F.when(~blank(card), F.concat(F.lit("**** "), F.right(ids.digits(card), F.lit(4)))).alias("card"),
        *(F.col(c) for c in rows.columns if c not in used),
    )
    return out
