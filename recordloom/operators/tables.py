"""Whole tables of text cells: scrubbing, profiles, type inference, cleaning with a problem log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import dates, ids, money
from recordloom.functions.text import BLANK_TABLE, blank, filled, repaired, state

# Hints for types in column names, and the words that open a total row.
HINTS = {
    "cpf": ("cpf",),
    "cnpj": ("cnpj",),
    "cpf_cnpj": ("cpf_cnpj", "cnpj_cpf", "documento", "nr_doc", "cpfcnpj", "inscricao"),
    "data": ("data", "dt_", "dt", "dia", "vencimento", "nascimento", "competencia"),
    "valor": ("valor", "vlr", "vl_", "preco", "montante", "saldo", "empenhado", "liquidado", "pago", "repasse", "salario", "remuneracao", "total", "custo"),
    "uf": ("uf", "estado", "sg_uf", "sigla_uf"),
    "cep": ("cep",),
    "codigo_ibge": ("ibge", "cod_municipio", "codigo_municipio", "cd_municipio", "id_municipio"),
}
TOTAL_ROW = r"(?i)^\s*(total|totais|soma|subtotal|total geral)\b"


def hinted(column: str, kind: str) -> bool:
    """Whether a column name hints at a type: a whole part, a prefix (hints ending in _), or a longer piece."""
    parts = column.split("_")
    return any(column.startswith(h) if h.endswith("_") else h in parts or (len(h) > 3 and h in column) for h in HINTS.get(kind, ()))


def unique_headers(names: list[str], first_suffix: int = 1) -> list[str]:
    """Column names made unique by a suffix, starting at first_suffix for the second of a name."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        at = seen.get(n)
        seen[n] = first_suffix if at is None else at + 1
        out.append(n if at is None else f"{n}_{at}")
    return out


def scrubbed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Without blank rows and total rows, judged by the given columns or all; a total row is told by its first cell that isn't blank."""
    first = F.coalesce(*(filled(F.col(c).cast("string"), BLANK_TABLE) for c in columns or df.columns))
    return df.filter(first.isNotNull() & ~first.rlike(TOTAL_ROW))


def cells(df: DataFrame, key: str) -> DataFrame:
    """(key, column, value): the long form of a table; one pass over it serves all columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns if c != key))
    return df.select(F.col(key).alias("key"), F.explode(pairs).alias("cell")).select("key", "cell.column", "cell.value")


def profile(long: DataFrame) -> DataFrame:
    """Per column: rows, filled, empty, pct_filled, distinct values, least and greatest value, of a long table."""
    v = filled(F.col("value"), BLANK_TABLE)
    return long.groupBy("column").agg(
        F.count("*").alias("n_rows"),
        F.count(v).alias("n_filled"),
        (F.count("*") - F.count(v)).alias("n_empty"),
        F.round(100.0 * F.count(v) / F.count("*"), 1).alias("pct_filled"),
        F.count_distinct(v).alias("n_distinct"),
        F.min(v).alias("least"),
        F.max(v).alias("greatest"),
    )


def described(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """A row for each column of df but key, in the words of a data dictionary: column, kind, n_filled, n_empty, pct_filled, n_distinct, example, least, greatest, total.

    example has the first three different values in the order of key, joined by commas. Values of the kinds valor and numero are compared and added as numbers,
    those of data as days; other kinds have neither least, greatest nor total. Values that don't fit their kind don't count there.
    """
    long = cells(df, key).withColumn("value", filled(F.col("value"), BLANK_TABLE))
    kind = F.create_map(*(x for c in df.columns if c != key for x in (F.lit(c), F.lit(kinds.get(c, "texto")))))[F.col("column")]
    long = long.withColumn("kind", kind)
    number = F.when(F.col("kind") == "valor", money.money(F.col("value")).cast("decimal(28,4)")).when(F.col("kind") == "numero", F.translate("value", ",", ".").try_cast("decimal(28,4)"))
    day = F.when(F.col("kind") == "data", dates.to_date(F.col("value")))
    text = lambda n, d: F.coalesce(n.cast("double").cast("string"), d.cast("string"))
    found = long.groupBy("column", "kind").agg(
        F.count("value").alias("n_filled"), (F.count("*") - F.count("value")).alias("n_empty"), F.round(100.0 * F.count("value") / F.count("*"), 1).alias("pct_filled"), F.count_distinct("value").alias("n_distinct"),
        text(F.min(number), F.min(day)).alias("least"), text(F.max(number), F.max(day)).alias("greatest"), F.sum(number).cast("double").alias("total"),
    )
    first = long.filter("value is not null").groupBy("column", "value").agg(F.min("key").alias("at"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("at", "value"))
    some = first.withColumn("place", place).filter("place <= 3").groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("some"))
    shown = F.array_join(F.transform("some", lambda x: x["value"]), ", ")
    return found.join(some, "column", "left").select("column", "kind", "n_filled", "n_empty", "pct_filled", "n_distinct", F.coalesce(shown, F.lit("")).alias("example"), "least", "greatest", "total")


def tidied(df: DataFrame) -> DataFrame:
    """df scrubbed, its texts with broken letters mended, and without the columns that hold nothing at all."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    mended = df.withColumns({c: repaired(F.col(f"`{c}`")) for c in texts})
    rows = scrubbed(mended)
    held = rows.agg(*[F.count(filled(F.col(f"`{c}`").cast("string"), BLANK_TABLE)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return rows.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if held[f"c{i}"]])


def tally(**kinds: DataFrame) -> DataFrame:
    """(what, kind, n): how often each kind occurs in tables of remarks that have a column kind, given by what they are (problems, findings, conflicts, assumptions)."""
    out = None
    for what, df in kinds.items():
        part = df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
        out = part if out is None else out.union(part)
    return out


def shares(long: DataFrame) -> DataFrame:
    """Per column the shares of values that fit each type, over all values that aren't blank."""
    v = F.trim(F.col("value"))
    n = F.length(ids.digits(v))
    share = lambda c: F.avg(c.cast("double"))
    return (
        long.filter((v != "") & F.col("value").isNotNull())
        .groupBy("column")
        .agg(
            F.count("*").alias("n"),
            share(ids.cnpj_valid(v)).alias("cnpj"),
            share(n >= 13).alias("n13"),
            share(ids.cpf_valid(v)).alias("cpf"),
            share(n.between(10, 11)).alias("n10_11"),
            share(n.isin(6, 7)).alias("n6_7"),
            share(state(v).isNotNull()).alias("uf"),
            share(dates.to_date(v).isNotNull()).alias("date"),
            F.min(v.rlike(r"^\d+$")).alias("all_digits"),
            share(money.money(v).isNotNull()).alias("money"),
            share(v.rlike(r"R\$|,\d{2}$")).alias("marked"),
            share(n >= 12).alias("n12"),
            share(v.rlike(r"^-?\d+([.,]\d+)?$")).alias("number"),
            F.max(v.rlike(r"^0\d")).alias("zero_led"),
        )
    )


def kind_of(column: Column, names: list[str]) -> Column:
    """The logical type from the shares of shares(), with the name hints of the given columns, in a fixed order of tests."""
    hint = lambda *kinds: column.isin(*[n for n in names if all(hinted(n, k) for k in kinds)] or [""])
    c = F.col
    return (
        F.when(hint("cpf_cnpj") | hint("cpf", "cnpj"), "cpf_cnpj")
        .when(hint("cnpj") | ((c("cnpj") > 0.8) & (c("n13") > 0.8)), "cnpj")
        .when(hint("cpf") | ((c("cpf") > 0.8) & (c("n10_11") > 0.8)), "cpf")
        .when(hint("cep"), "cep")
        .when(hint("codigo_ibge") & (c("n6_7") > 0.8), "codigo_ibge")
        .when((c("uf") > 0.95) | (hint("uf") & (c("uf") > 0.7)), "uf")
        .when((c("date") > 0.8) & (hint("data") | ~c("all_digits")), "data")
        .when(((c("money") > 0.9) & (c("marked") > 0.5)) | ((c("money") > 0.6) & hint("valor")), "valor")
        .when(c("n12") > 0.5, "texto")
        .when((c("number") > 0.95) & ~c("zero_led"), "numero")
        .otherwise("texto")
    )


def inferred(df: DataFrame, key: str) -> DataFrame:
    """(column, kind, n) for each column with values; columns without any are text."""
    names = [c for c in df.columns if c != key]
    return shares(cells(df, key)).select("column", kind_of(F.col("column"), names).alias("kind"), "n")


def clean(c: Column, kind: str) -> tuple[Column, Column]:
    """The cleaned value of a type as text, and the problem of a value that doesn't fit (else null)."""
    v = filled(F.trim(c.cast("string")), BLANK_TABLE)
    valid = {
        "cpf": lambda: (F.when(ids.cpf_valid(v), ids.format_cpf(v)), "CPF inválido"),
        "cnpj": lambda: (F.when(ids.cnpj_valid(v), ids.format_cnpj(v)), "CNPJ inválido"),
        "cpf_cnpj": lambda: (F.when((F.length(ids.digits(v)) <= 11) & ids.cpf_valid(v), ids.format_cpf(v)).when(ids.cnpj_valid(v), ids.format_cnpj(v)), "CPF/CNPJ inválido"),
        "data": lambda: (dates.to_date(v).cast("string"), "data não reconhecida"),
        "valor": lambda: (money.money(v).cast("decimal(18,2)").cast("string"), "valor não numérico"),
        "uf": lambda: (state(v), "UF inválida"),
        "cep": lambda: (ids.format_cep(v), "CEP inválido"),
        "numero": lambda: (F.translate(v, ",", ".").try_cast("double").cast("string"), "número inválido"),
    }
    if kind not in valid:
        return v, F.lit(None).cast("string")
    made, problem = valid[kind]()
    keeps_raw = kind in ("cpf", "cnpj", "cpf_cnpj", "uf", "cep")
    return (F.coalesce(made, v) if keeps_raw else made), F.when(v.isNotNull() & made.isNull(), problem)


def normalised(df: DataFrame, key: str, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The cleaned table, without all-null and repeated rows, and the problems (key, column, raw, problem)."""
    made = {c: clean(F.col(c), kinds.get(c, "texto")) for c in df.columns if c != key}
    tidy = df.select(key, *(v.alias(c) for c, (v, _) in made.items())).dropna("all", subset=list(made))
    notes = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw"), p.alias("problem")) for c, (_, p) in made.items()))
    problems = df.select(F.col(key).alias("key"), F.explode(F.filter(notes, lambda x: x["problem"].isNotNull())).alias("p")).select("key", "p.*")
    return tidy.dropDuplicates(list(made)), problems


def counted(problems: DataFrame) -> DataFrame:
    """(column, problem, n): how often each problem of normalised() occurs in each column."""
    return problems.groupBy("column", "problem").agg(F.count("*").alias("n"))


def distinct_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df without repeated rows, and one row with the number removed."""
    kept = df.dropDuplicates()
    return kept, df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("removed"))


__all__ = ["blank", "cells", "clean", "described", "distinct_rows", "hinted", "inferred", "kind_of", "normalised", "profile", "scrubbed", "shares", "tally", "tidied", "unique_headers"]
