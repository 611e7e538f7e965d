"""Business domains: suppliers, catalogue, stock ledger, unified sales and payment reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import ids, money
from recordloom.functions.text import blank, boolean, name_key, plain
from recordloom.tables import free_name, written

# Words of stock movements and payment statuses.
ENTRY, EXIT = r"^(entr|compra|devol|in$|e$)", r"^(said|venda|baixa|out$|s$)"
PAYMENT_STATUS = (("refund|estorn", "estornado"), ("chargeback|contesta", "chargeback"), ("approved|aprovad|pago|paid", "aprovado"))


def suppliers(rows: DataFrame, key: str, name: str, cnpj: str, *optional: str) -> DataFrame:
    """One row for each supplier: mixed-case writing first, then the fullest; with the number of rows and a CNPJ check."""
    shouted = (F.col(name) == F.upper(name)).cast("int")
    full = sum((F.when(blank(F.col(c).cast("string")), 0).otherwise(1) for c in (name, cnpj, *optional)), F.lit(0))
    w = Window.partitionBy(key)
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy(shouted, -full, name))).withColumn("n_rows", F.count("*").over(w))
    return ranked.filter("_rn = 1").select(key, name, cnpj, *optional, "n_rows", ids.cnpj_valid(F.col(cnpj)).alias("cnpj_ok"))


def catalogue(rows: DataFrame, sku: str, name: str, price: str, weight: str, unit: str, deleted: str, order: str) -> DataFrame:
    """The first row of each SKU with price and weight, and whether later or deleted rows are refused."""
    made = rows.withColumn("_p", money.price(F.col(price))).withColumn("_w", money.weight_kg(F.col(weight), F.col(unit)))
    rn = F.row_number().over(Window.partitionBy(sku).orderBy(order))
    reason = F.when(F.coalesce(boolean(F.col(deleted)), F.lit(False)), "excluído na origem").when(rn > 1, "SKU repetido").otherwise("")
    return made.select(sku, name, F.col("_p.price").alias("price"), F.col("_w.kg").alias("kg"), reason.alias("refused"), order)


def movement(kind: Column) -> Column:
    """entrada, saida or null from a movement word."""
    t = F.lower(F.trim(plain(kind)))
    return F.when(t.rlike(ENTRY), "entrada").when(t.rlike(EXIT), "saida")


def ledger(moves: DataFrame, known: DataFrame, sku: str, kind: str, qty: str, when: str | None = None, as_of: str | None = None) -> DataFrame:
    """Per known SKU entries, exits, balance and a flag below zero; movements of unknown SKUs or kinds are counted apart under a null SKU.

    With a date column, movements after the day as_of are counted there too.
    """
    direction = movement(F.col(kind))
    rows = moves.join(known.select(sku, F.lit(True).alias("_known")).distinct(), sku, "left")
    good = F.col("_known").isNotNull() & direction.isNotNull()
    good = good & F.coalesce(F.col(when) <= F.lit(as_of).cast("date"), F.lit(True)) if when else good
    signed = F.when(direction == "entrada", F.col(qty)).otherwise(-F.col(qty))
    held = rows.groupBy(F.when(good, F.col(sku)).alias(sku)).agg(
        F.coalesce(F.sum(F.when(good & (direction == "entrada"), F.col(qty))), F.lit(0)).alias("entries"),
        F.coalesce(F.sum(F.when(good & (direction == "saida"), F.col(qty))), F.lit(0)).alias("exits"),
        F.coalesce(F.sum(F.when(good, signed)), F.lit(0)).alias("balance"),
        F.count("*").alias("n_moves"),
    )
    return held.withColumn("negative", F.col("balance") < 0)


def sales(rows: DataFrame) -> DataFrame:
    """Verdict of each sale (code, source, manual, client, cents, sold_at, channel, client_ok), by rank and source.

    rank = 10 * manual + missing time + missing fields. A row with another prefix than the most common, but number, amount and client of a row with that
    prefix, is a duplicate; later rows of an accepted code are booked already; rows with a problem are orphans; the rest is accepted, with the
    channel filled from later rows of the code.

    Rows may have two more columns: ambiguous (the reference fits several clients: accepted without one, with an alert) and currency (any but BRL is a
    problem). problem is the first one, problems lists all; alert also tells a booked row whose amount is another than the accepted one's.
    """
    for name, kind in (("ambiguous", "boolean"), ("currency", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    vague = F.coalesce("ambiguous", F.lit(False))
    problems = F.array_compact(
        F.array(
            F.when(~F.coalesce("client_ok", F.lit(False)) & ~vague, "cliente desconhecido"), F.when(F.col("sold_at").isNull(), "sem data"), F.when(F.col("cents").isNull(), "sem valor"),
            F.when(F.coalesce("currency", F.lit("BRL")) != "BRL", F.concat(F.lit("moeda "), "currency", F.lit(" sem cotação"))),
        )
    )
    prefix, number = F.regexp_extract("code", "^([A-Za-z]*)", 1), F.regexp_extract("code", "([0-9]+)$", 1)
    main = rows.groupBy(prefix.alias("p")).count().orderBy(F.desc("count"), "p").limit(1)
    rank = 10 * F.col("manual") + F.col("sold_at").isNull().cast("int") + F.col("channel").isNull().cast("int")
    made = rows.withColumn("prefix", prefix).withColumn("number", number).withColumn("rank", rank).withColumn("problems", problems).withColumn("problem", F.get("problems", F.lit(0)))
    made = made.crossJoin(F.broadcast(main.select(F.col("p").alias("main"))))  # one row
    originals = made.filter("prefix = main").groupBy(F.col("number").alias("_n"), F.col("cents").alias("_c"), F.col("client").alias("_k")).agg(F.min("code").alias("twin_of"))
    twins = made.join(originals, (F.col("number") == F.col("_n")) & (F.abs(F.col("cents") - F.col("_c")) < 1) & (F.col("client") == F.col("_k")) & (F.col("cents") == F.col("_c")), "left")
    twin = (F.col("prefix") != F.col("main")) & F.col("twin_of").isNotNull()
    ordered = Window.partitionBy("code").orderBy("rank", "source")
    valid = ~twin & F.col("problem").isNull()
    flagged = twins.withColumn("twin", twin).withColumn("valid", valid)
    flagged = flagged.withColumn("taken", F.coalesce(F.max(F.col("valid").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    booked = F.first(F.when(F.col("valid"), F.col("cents")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    flagged = flagged.withColumn("booked", booked).withColumn("later", F.first("channel", ignorenulls=True).over(ordered.rowsBetween(1, Window.unboundedFollowing)))
    verdict = F.when(F.col("twin"), "DUPLICATA").when(F.col("taken") == 1, "JÁ LANÇADA").when(F.col("problem").isNotNull(), "ÓRFÃ").otherwise("ACEITA")
    differs = (verdict == "JÁ LANÇADA") & (F.abs(F.coalesce("cents", F.lit(0)) - F.coalesce("booked", F.lit(0))) >= 1)
    alert = F.when(differs, F.concat(F.lit("valor diferente ("), "cents", F.lit(" × "), "booked", F.lit(")"))).when((verdict == "ACEITA") & vague, "cliente AMBÍGUO — não atribuído").otherwise("")
    return flagged.select(
        F.array_join("problems", "; ").alias("problems"), F.coalesce(alert, F.lit("valor diferente")).alias("alert"), F.when(~vague, F.col("client")).alias("assigned"),
        "code", "source", "client", "cents", "sold_at", "rank", verdict.alias("verdict"), F.when(F.col("twin"), F.col("twin_of")).alias("twin_of"), F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("channel", "later").alias("channel")
    )


def reconciled(accepted: DataFrame, payments: DataFrame) -> DataFrame:
    """Each sale (code, cents) with its payment (code, paid_cents, status): missing, divergent by more than a cent, or ok."""
    status = F.coalesce(*(F.when(F.lower("status").rlike(p), name) for p, name in PAYMENT_STATUS), F.lower("status"))
    paid = payments.select("code", "paid_cents", status.alias("status"))
    situation = F.when(F.col("paid_cents").isNull(), "missing").when(F.abs(F.col("paid_cents") - F.col("cents")) > 1, "divergent").otherwise("ok")
    return accepted.join(paid, "code", "left").select("code", "cents", "paid_cents", "status", situation.alias("situation"))


#: Values that may be sorted on the driver for a median.
SORTED = 1 << 16


def median(rows: DataFrame, c: Column) -> float | None:
    """The exact median of a column without nulls: quantiles narrow the range until what lies in it is few, so no task holds all values."""
    held = written(rows.select(c.cast("double").alias("v")).filter("v is not null"), "values")  # each round reads this one column, not the input again
    n, below = held.count(), 0
    while n:
        m = held.count()
        low, high = (n - 1) // 2 - below, n // 2 - below
        if m <= SORTED:
            v = sorted(r.v for r in held.collect())
            return (v[low] + v[high]) / 2
        a, b = held.agg(F.percentile_approx("v", [max(0.0, low / m - 0.001), min(1.0, (high + 1) / m + 0.001)], 100000)).first()[0]
        if a == b:
            return a
        below += held.filter(F.col("v") < a).count()
        held = held.filter(F.col("v").between(a, b))
    return None


def outliers(rows: DataFrame, amount: str, times: float = 50, at_least: int = 10) -> DataFrame:
    """Rows over `times` the median of more than `at_least` amounts."""
    middle = median(rows, F.col(amount)) if rows.filter(F.col(amount).isNotNull()).count() > at_least else None
    return rows.filter(F.col(amount) > times * middle) if middle is not None else rows.limit(0)


def in_cents(rows: DataFrame, total: str, qty: str, price: str) -> DataFrame:
    """One row: whether a column of totals holds cents, by the median of total / (qty * price), where that isn't 0, and the share of whole numbers."""
    ratio = median(rows, F.try_divide(F.col(total), F.col(qty) * F.col(price)))
    whole = F.avg(F.col(total).cast("string").rlike(r"^\d+(\.0)?$").cast("double"))
    return rows.agg(whole.alias("whole")).select(F.lit(ratio).cast("double").alias("ratio"), "whole", F.coalesce(F.lit(ratio).between(95, 105) & (F.col("whole") > 0.95), F.lit(False)).alias("cents"))


STATUS_WORDS = r"(?i)approved|aprovad|refund|estorn|chargeback|contesta|pago|paid|recusad|declined|pendente|pending"


def payment_share(rows: DataFrame, status: str) -> DataFrame:
    """One row: the share of filled statuses that are those of payments, and whether that makes the table one of payments (0.8 or more)."""
    share = F.avg(F.col(status).rlike(STATUS_WORDS).cast("double"))
    return rows.filter(~blank(F.col(status))).agg(F.coalesce(share, F.lit(0.0)).alias("share")).select("share", (F.col("share") >= 0.8).alias("payments"))


def with_sku(rows: DataFrame, item: str, known: DataFrame, sku: str, name: str) -> DataFrame:
    """rows with the column resolved_sku: an item that is a SKU or looks like one, else the SKU of the product of that name (the first of several)."""
    text, key = free_name(rows, "item_text"), free_name(rows, "item_key")
    t = F.upper(F.trim(F.col(item)))
    by_name = known.select(name_key(F.col(name)).alias(key), F.col(sku).alias(text)).filter(F.col(key) != "").groupBy(key).agg(F.min(text).alias("_named"))
    codes = known.select(F.upper(F.col(sku)).alias(text), F.lit(True).alias("_code")).distinct()
    made = rows.withColumn(text, F.when(~blank(F.col(item)), t)).withColumn(key, name_key(F.col(item)))
    made = made.join(codes, text, "left").join(by_name, key, "left")
    coded = F.col("_code").isNotNull() | F.col(text).rlike("^[A-Z]{2,5}-?[0-9]{2,}$")
    return made.select(*(F.col(f"`{c}`") for c in rows.columns), F.when(F.col(text).isNotNull(), F.when(coded, F.col(text)).otherwise(F.col("_named"))).alias("resolved_sku"))
