from datetime import date

import pytest
from pyspark.sql import functions as F

from recordloom.functions import dates, ids, money
from recordloom.functions import text as T


def value(spark, make, x):
    return spark.createDataFrame([(x,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "make,x,want",
    [
        (ids.cpf_valid, "529.982.247-25", True), (ids.cpf_valid, "529.982.247-26", False), (ids.cpf_valid, "11111111111", False), (ids.cpf_valid, None, False),
        (ids.cnpj_valid, "11.222.333/0001-81", True), (ids.cnpj_valid, "11.222.333/0001-82", False), (ids.cnpj_valid, "191", True),
        (ids.format_cnpj, "191", "00.000.000/0001-91"), (ids.format_cep, "1310100", "01310-100"), (ids.format_cep, "123456789", None),
        (ids.card_valid, "4111 1111 1111 1111", True), (ids.card_valid, "4111 1111 1111 1112", False), (ids.cpf_digits, "529982247", "00529982247"),
        (money.money, "R$ 1.234,56", 1234.56), (money.money, "1,234.56", 1234.56), (money.money, "(1.000,00)", -1000.0), (money.money, "abc", None), (money.money, "1.234", 1.234),
        (dates.to_date, "05/03/2024", date(2024, 3, 5)), (dates.to_date, "2024-03-05T10:00:00", date(2024, 3, 5)), (dates.to_date, "31/02/2024", None),
        (lambda c: dates.read_date(c)["value"], "12 mar 2024", date(2024, 3, 12)), (lambda c: dates.read_date(c)["alert"], "07/14/2024", "formato americano MM/DD convertido"),
        (lambda c: dates.read_date(c)["value"], "3/4/70", date(1970, 4, 3)), (lambda c: F.date_format(dates.read_datetime(c)["ts"], "yyyy-MM-dd HH:mm"), "2018-01-15T01:30:00Z", "2018-01-14 22:30"),
        (T.state, "São Paulo", "SP"), (T.state, "xx", None), (T.person_name, "  MARIA  DA silva ", "Maria da Silva"), (T.person_name, "n/a", None),
        (lambda c: T.person_name(T.repaired(c)), "joÃ£o", "João"), (T.name_key, "José de Araújo", "jose de araujo"), (T.join_key, "000.123", "123"), (T.join_key, "Pará", "PARA"), (T.join_key, "0", "0"),
        (T.reference, " 0012 / 26 ", "12/2026"), (T.status, "Pago?", "pago (a confirmar)"), (T.boolean, "Não", False), (T.boolean, "x", True), (T.boolean, "talvez", None),
        (lambda c: T.phone(c)["value"], "+55 61 99999-1234", "+55 (61) 99999-1234"), (lambda c: T.phone(c, keep_short=True)["value"], "99999-1234", "99999-1234"),
        (lambda c: T.email(c)["value"], "Fulano@@X.com", "fulano@x.com"), (lambda c: T.email(c)["alert"], "sem", "e-mail vazio"), (lambda c: T.city(c)["value"], "salvador/BA", "Salvador"),
        (T.file_name, "Nova pasta (2)/Cópia de Vendas FINAL v2.XLSX", "de_vendas_copia.xlsx"), (T.header, " Valor  Pago (R$) ", "valor_pago_r"), (T.header, "??", "coluna"),
    ],
)
def test_scalars(spark, make, x, want):
    got = value(spark, make, x)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_weights(spark):
    row = spark.sql("SELECT '500' AS w, 'g' AS u").select(money.weight_kg(F.col("w"), F.col("u")).alias("k")).first().k
    assert (row.kg, row.alert) == (0.5, "peso em gramas convertido para kg")
