"""Amounts, prices and weights written in many ways, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.base import let, once
from recordloom.functions.text import blank, plain

# Currency marks in the order of their tests, and weight units with factor and decimals.
CURRENCIES = (("r$", "BRL"), ("brl", "BRL"), ("us$", "USD"), ("usd", "USD"), ("$", "USD"), ("eur", "EUR"), ("€", "EUR"))
UNITS = (
    (("g", "gr", "grama", "gramas"), 0.001, 4, "peso em gramas convertido para kg"),
    (("mg",), 0.000001, 6, "peso em mg convertido para kg"),
    (("t", "ton", "tonelada"), 1000.0, 3, "peso em toneladas convertido para kg"),
)


@once
def money(c: Column) -> Column:
    """A number from 'R$ 1.234,56', '1,234.56' or '(1.000,00)'; text with words gives null."""
    return let(F.trim(c.cast("string")), lambda t: let(F.regexp_replace(t, "[^0-9,.]", ""), lambda d: _money(t, d)))


def _money(t: Column, d: Column) -> Column:
    bare = F.regexp_replace(t, r"(?i)R\$|US\$|USD|BRL|EUR|reais|real|centavos?|€|\$", "")
    wordy = bare.rlike(r"[A-Za-zÀ-ú]{2,}|[@/:#]")
    negative = (t.startswith("(") & t.endswith(")")) | t.startswith("-")
    comma, dot = F.length(d) - F.locate(",", F.reverse(d)), F.length(d) - F.locate(".", F.reverse(d))
    both = d.contains(",") & d.contains(".")
    number = (
        F.when(both & (comma > dot), F.translate(F.translate(d, ".", ""), ",", "."))
        .when(both, F.translate(d, ",", ""))
        .when(d.contains(","), F.translate(d, ",", "."))
        .when(d.rlike(r"\..*\."), F.translate(d, ".", ""))
        .otherwise(d)
        .try_cast("double")
    )
    return F.when(~wordy, F.when(negative, -number).otherwise(number))


@once
def amount(c: Column) -> Column:
    """(amount, currency, alert) of a written amount."""
    t = F.trim(c.cast("string"))
    number = F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("double")).otherwise(money(t))
    return let(number, lambda n: _amount(c, t, n))


def _amount(c: Column, t: Column, number: Column) -> Column:
    currency = F.coalesce(*(F.when(F.lower(t).contains(mark), code) for mark, code in CURRENCIES))
    good = ~blank(c) & number.isNotNull()
    alert = (
        F.when(blank(c), "")
        .when(number.isNull(), F.concat(F.lit("valor não reconhecido ("), t, F.lit(")")))
        .when(currency.isNull(), "moeda não informada (assumido BRL)")
        .when(currency != "BRL", F.concat(F.lit("valor em "), currency, F.lit(" — não convertido para BRL")))
        .otherwise("")
    )
    return F.struct(F.when(good, F.round(number, 2)).alias("amount"), F.when(good, F.coalesce(currency, F.lit("BRL"))).alias("currency"), alert.alias("alert"))


@once
def price(c: Column) -> Column:
    """(price, alert); '1234 centavos' is 12.34."""
    t = F.lower(F.trim(c.cast("string")))
    cents = t.rlike(r"centavos?|cents?\b")
    value = F.when(cents, F.regexp_replace(t, "[^0-9]", "").try_cast("double") / 100).otherwise(money(t))
    alert = F.when(blank(c), "").when(cents, "preço em centavos convertido para reais").when(value.isNull(), F.concat(F.lit("preço não reconhecido ("), c.cast("string"), F.lit(")"))).otherwise("")
    return F.struct(F.when(~blank(c), value).alias("price"), alert.alias("alert"))


def weight_kg(c: Column, unit: Column) -> Column:
    """(kg, alert) of a weight and its unit; no unit means kg."""
    return let(money(c), lambda number: let(F.lower(F.trim(plain(F.coalesce(unit, F.lit("kg"))))), lambda u: _weight(number, u)))


def _weight(number: Column, u: Column) -> Column:
    kg, alert = F.when(number.isNull(), None), F.when(number.isNull(), "")
    for names, factor, places, note in UNITS:
        scaled = number * factor if factor >= 1 else number / round(1 / factor)
        kg, alert = kg.when(u.isin(*names), F.round(scaled, places)), alert.when(u.isin(*names), note)
    return F.struct(kg.otherwise(F.round(number, 4)).alias("kg"), alert.otherwise("").alias("alert"))
