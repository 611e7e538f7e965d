"""Documents against the register: numbers that texts cite, and people whom a line names with another number than theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import ids
from recordloom.functions.text import text_key
from recordloom.operators import entity
from recordloom.operators.privacy import masked
from recordloom.tables import written

# Numbers as texts write them, and CPFs that stand for none.
CPF, CNPJ = r"(?<![\d./-])\d{3}\.?\d{3}\.?\d{3}-?\d{2}(?![\d./-])", r"(?<![\d./-])\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}(?![\d./-])"
PHONE = r"(?<!\d)(?:\+?55\s?)?\(?\d{2}\)?\s?9?\d{4}[-\s]?\d{4}(?!\d)"
TEST_CPFS = ("12345678909", "01234567890", "98765432100")
# What is wrong with a cited number.
TEST, OTHERS, DIFFERENT, INVALID, OTHER_PHONE = (
    "CPF de teste/sequencial (dígitos em sequência) — provavelmente fictício", "CPF pertence a outra pessoa da base", "CPF citado no documento é diferente do CPF da pessoa na base",
    "CPF citado no documento é diferente do CPF da pessoa na base (e é inválido)", "telefone citado no documento não é o telefone cadastrado",
)


def _all(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), ids.digits))


def cited(texts: DataFrame, known: DataFrame, number: str, kind: str = "cpf") -> DataFrame:
    """(number, n_docs, docs): numbers of the register ("cpf" or "cnpj") that texts (doc, text) cite, in any writing; docs are joined in order."""
    valid = ids.cpf_valid if kind == "cpf" else ids.cnpj_valid
    found = texts.select("doc", F.explode(_all(F.col("text"), CPF if kind == "cpf" else CNPJ)).alias("cited")).filter(valid(F.col("cited")))
    register = known.select(ids.digits(F.col(number)).alias("cited")).filter(F.col("cited") != "").distinct()
    docs = F.array_join(F.transform(F.array_sort(F.collect_set("doc")), lambda d: d.cast("string")), ",")
    return found.join(register, "cited", "left_semi").groupBy(F.col("cited").alias(number)).agg(F.count_distinct("doc").alias("n_docs"), docs.alias("docs"))


def conflicts(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(doc, line, person, field, found, registered, situation): what lines of texts (doc, text) say about people (id, name, cpf, phone) against the register.

    A CPF for tests or of one repeated digit; one that belongs to somebody whom the line doesn't name; one that nobody has, beside a name with another; a phone
    whose last nine digits aren't those of the person named. person lists the ids that the line names, found and registered are masked. Of several people
    with one name or CPF the one with the largest id counts. Lines are numbered from 1; null texts have none.
    """
    base = people.select("id", "name", text_key(F.col("name")).alias("name_key"), ids.digits(F.col("cpf")).alias("cpf"), "phone")
    base = written(base.withColumn("cpf", F.nullif("cpf", F.lit(""))), "register")
    last = lambda *by: base.filter(" AND ".join(f"{c} IS NOT NULL" for c in by)).groupBy(*by).agg(F.max_by(F.struct("id", "name", "cpf", "phone"), "id").alias("r"))
    lines = texts.select("doc", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line", "text"))
    cpfs = _all(F.col("text"), CPF)
    lines = lines.select("doc", (F.col("line") + 1).alias("line"), "text", cpfs.alias("cpfs"), F.array_except(_all(F.col("text"), PHONE), cpfs).alias("phones")).filter("size(cpfs) > 0 OR size(phones) > 0")
    lines = written(lines, "lines")
    spots = entity.mentions(lines.select(F.struct("doc", "line").alias("doc"), "text"), base)
    named = spots.join(last("name_key"), "name_key").groupBy(F.col("doc.doc").alias("doc"), F.col("doc.line").alias("line")).agg(F.array_sort(F.collect_list("r")).alias("named"))
    rows = lines.drop("text").join(named, ["doc", "line"], "left").withColumn("named", F.coalesce("named", F.array().cast(dict(named.dtypes)["named"])))
    everyone = F.array_join(F.transform("named", lambda r: r["id"].cast("string")), ", ")
    shown = lambda field, value: F.coalesce(masked(F.lit(field), value), F.lit(""))
    told = lambda person, field, found, registered, situation: F.struct(person.cast("string").alias("person"), F.lit(field).alias("field"), found.alias("found"), registered.alias("registered"), situation.alias("situation"))

    each = rows.select("doc", "line", "named", F.explode("cpfs").alias("cited")).join(last("cpf").select(F.col("cpf").alias("cited"), F.col("r").alias("owner")), "cited", "left")
    here, c, owner = shown("CPF", F.col("cited")), F.col("cited"), F.col("owner")
    fake = c.isin(*TEST_CPFS) | c.rlike(r"^(\d)\1{10}$")
    foreign = owner.isNotNull() & (F.size("named") > 0) & ~F.exists("named", lambda r: r["id"] == owner["id"])
    wrong = F.transform(
        F.filter("named", lambda r: owner.isNull() & r["cpf"].isNotNull() & (r["cpf"] != c)),
        lambda r: told(r["id"], "cpf", here, shown("CPF", r["cpf"]), F.when(ids.cpf_valid(c), DIFFERENT).otherwise(INVALID)),
    )
    always = F.array(F.when(fake, told(everyone, "cpf", here, F.lit(""), F.lit(TEST))), F.when(foreign, told(everyone, "cpf", here, shown("CPF", owner["cpf"]), F.lit(OTHERS))))
    out = each.select("doc", "line", F.explode(F.concat(F.array_compact(always), wrong)).alias("x"))
    ring = rows.select("doc", "line", "named", F.explode("phones").alias("cited"))
    nine = lambda p: F.right(ids.digits(p), F.lit(9))
    other = F.filter("named", lambda r: (F.coalesce(nine(r["phone"]), F.lit("")) != "") & (nine(r["phone"]) != nine(F.col("cited"))))
    rings = F.transform(other, lambda r: told(r["id"], "telefone", shown("Telefone", F.col("cited")), shown("Telefone", r["phone"]), F.lit(OTHER_PHONE)))
    return out.union(ring.select("doc", "line", F.explode(rings))).select("doc", "line", "x.*").distinct()
