"""Checksummed identifiers as Column expressions (CPF, CNPJ, PIS, CNS, payment cards, postal codes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.base import let

# The weights of the public check digit rules.
CNPJ_WEIGHTS = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
PIS_WEIGHTS = (3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def digits(c: Column) -> Column:
    """Only 0-9; null gives an empty text."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def padded(c: Column, n: int) -> Column:
    """Zero-padded on the left to n; longer texts stay whole."""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).try_cast("int")


def _weighted(d: Column, weights) -> Column:
    return sum((_digit(d, i) * w for i, w in enumerate(weights)), F.lit(0))


def _varied(d: Column, n: int) -> Column:
    return (F.length(d) == n) & (d != F.repeat(F.substring(d, 1, 1), F.lit(n)))


def cpf_valid(c: Column) -> Column:
    def check(d: Column) -> Column:
        first, second = ((_weighted(d, range(n + 1, 1, -1)) * 10 % 11 % 10) == _digit(d, n) for n in (9, 10))
        return F.coalesce(_varied(d, 11) & first & second, F.lit(False))

    return let(padded(digits(c), 11), check)


def cnpj_valid(c: Column) -> Column:
    def right(d: Column, n: int) -> Column:
        return let(_weighted(d, CNPJ_WEIGHTS[13 - n :]) % 11, lambda rest: F.when(rest < 2, 0).otherwise(11 - rest)) == _digit(d, n)

    return let(padded(digits(c), 14), lambda d: F.coalesce(_varied(d, 14) & right(d, 12) & right(d, 13), F.lit(False)))


def pis_valid(c: Column) -> Column:
    def check(d: Column) -> Column:
        rest = 11 - _weighted(d, PIS_WEIGHTS) % 11
        return F.coalesce(_varied(d, 11) & (F.when(rest >= 10, 0).otherwise(rest) == _digit(d, 10)), F.lit(False))

    return let(digits(c), check)


def cns_valid(c: Column) -> Column:
    return let(digits(c), lambda d: F.coalesce(d.rlike("^[12789][0-9]{14}$") & (_weighted(d, range(15, 0, -1)) % 11 == 0), F.lit(False)))


def luhn_valid(c: Column) -> Column:
    d = digits(c)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def card_valid(c: Column) -> Column:
    """A card number: Luhn, first digit 2 to 6, and not a valid CNPJ."""
    return let(digits(c), lambda d: luhn_valid(d) & d.rlike("^[23456]") & ~((F.length(d) == 14) & cnpj_valid(d)))


def format_cpf(c: Column) -> Column:
    d = padded(digits(c), 11)
    return F.concat(F.substring(d, 1, 3), F.lit("."), F.substring(d, 4, 3), F.lit("."), F.substring(d, 7, 3), F.lit("-"), F.substring(d, 10, 99))


def format_cnpj(c: Column) -> Column:
    d = padded(digits(c), 14)
    return F.concat(F.substring(d, 1, 2), F.lit("."), F.substring(d, 3, 3), F.lit("."), F.substring(d, 6, 3), F.lit("/"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 99))


def format_cep(c: Column) -> Column:
    d = digits(c)
    full = padded(d, 8)
    return F.when((d != "") & (F.length(d) <= 8), F.concat(F.substring(full, 1, 5), F.lit("-"), F.substring(full, 6, 3)))


def id_text(c: Column) -> Column:
    """An id as text; "2.0" is "2"."""
    return F.regexp_replace(F.trim(c.cast("string")), r"^(\d+)\.0$", "$1")


def cpf_digits(c: Column) -> Column:
    """Eleven digits of a CPF with nine or more, else null."""
    d = digits(c)
    return F.when(F.length(d).between(9, 11), padded(d, 11))
