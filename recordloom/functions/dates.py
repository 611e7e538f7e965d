"""Dates and times written in many ways, as Column expressions. Nothing reads the clock: `as_of` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.base import let, once
from recordloom.functions.text import blank, plain

# Formats in the order of their tests, and month abbreviations.
FORMATS = (
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("d/M/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"), ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"), ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), ("d/M/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d/M/yyyy H:m", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"), ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
)
MONTHS = {
    "jan": 1, "fev": 2, "mar": 3, "abr": 4, "mai": 5, "jun": 6, "jul": 7, "ago": 8, "set": 9, "out": 10, "nov": 11, "dez": 12,
    "feb": 2, "apr": 4, "may": 5, "aug": 8, "sep": 9, "oct": 10, "dec": 12,
}
AS_OF_YEAR = 2026


@once
def month_number(c: Column) -> Column:
    """The month of a name or abbreviation, by its first three letters."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.substring(plain(F.lower(c)), 1, 3))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there's no such day."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(month.between(1, 12) & day.between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))


@once
def to_date(c: Column) -> Column:
    """The date of the first format that fits, of the years 1900 to 2100."""
    t = F.trim(c.cast("string"))
    t = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.substring_index(t, ".", 1)).otherwise(t)
    first = lambda x: F.coalesce(*(F.when(x.rlike(shape), F.try_to_date(x, form)) for form, shape in FORMATS))
    return let(let(t, first), lambda found: F.when(F.year(found).between(1900, 2100), found))


def _year(c: Column, as_of_year: int) -> Column:
    n = c.try_cast("int")
    return F.when(F.length(c) <= 2, n + F.when(n <= as_of_year % 100, 2000).otherwise(1900)).otherwise(n)


@once
def read_date(c: Column, month_first: Column | bool = False, as_of_year: int = AS_OF_YEAR) -> Column:
    """(date, alert): ISO, long-hand, day and month by their size, and by month_first where both are possible."""
    t = F.lower(F.trim(c.cast("string")))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    iso, long, short = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[ t].*)?$", r"^(\d{1,2})[º°]?\s*(?:de\s+)?([a-zç]{3,9})\.?\s*(?:de\s+)?(\d{2,4})$", r"^(\d{1,2})([/\-.])(\d{1,2})[/\-.](\d{2,4})$"
    as_int = lambda pattern, i: part(pattern, i).try_cast("int")
    iso_date = date_of(as_int(iso, 1), as_int(iso, 2), as_int(iso, 3))
    month = month_number(part(long, 2))
    long_date = date_of(_year(part(long, 3), as_of_year), month, as_int(long, 1))
    a, b, year = as_int(short, 1), as_int(short, 3), _year(part(short, 4), as_of_year)
    month_first = F.lit(month_first) if isinstance(month_first, bool) else month_first
    return let(
        F.struct(a.alias("a"), b.alias("b"), year.alias("year"), iso_date.alias("iso"), month.alias("month"), long_date.alias("long"), to_date(t).alias("other")),
        lambda v: _choose(c, t, v, month_first, iso, long, short),
    )


def _choose(c: Column, t: Column, v: Column, month_first: Column, iso: str, long: str, short: str) -> Column:
    a, b, year, iso_date, month, long_date, other = (v[k] for k in ("a", "b", "year", "iso", "month", "long", "other"))
    swapped = ((b > 12) & (a <= 12)) | (~((a > 12) & (b <= 12)) & (a != b) & month_first)
    short_date = F.when(swapped, date_of(year, a, b)).otherwise(date_of(year, b, a))
    note = F.when((a > 12) & (b <= 12), "").when((b > 12) & (a <= 12), "formato americano MM/DD convertido").when(a == b, "")
    note = note.otherwise(F.when(month_first, "data ambígua: assumido MM/DD").otherwise("data ambígua: assumido DD/MM"))
    is_iso, is_long, is_short = t.rlike(iso), t.rlike(long) & month.isNotNull(), t.rlike(short)
    found = F.when(is_iso, iso_date).when(is_long, long_date).when(is_short, short_date).otherwise(other)
    return let(found, lambda value: _with_alert(c, value, note, is_iso, is_long, is_short))


def _with_alert(c: Column, value: Column, note: Column, is_iso: Column, is_long: Column, is_short: Column) -> Column:
    missing = F.when(is_iso | is_long | is_short, "data inexistente").otherwise("formato de data não reconhecido")
    alert = F.when(blank(c), "").when(value.isNull(), missing).when(is_short & ~is_iso & ~is_long, note).otherwise("")
    return F.struct(F.when(~blank(c), value).alias("value"), alert.alias("alert"))


@once
def read_datetime(c: Column, utc: bool = False, as_of_year: int = AS_OF_YEAR) -> Column:
    """(ts, has_time, alert) in the fixed offset of -03:00: serial numbers of spreadsheets, epochs, ISO with an offset, or a date with a time."""
    t = F.trim(c.cast("string"))
    n = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
    iso = r"(?i)^(\d{4}-\d{2}-\d{2})[T ](\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(Z|[+-]\d{2}:?\d{2}|UTC)?$"
    clocked = r"(?i)^(\d{1,2}/\d{1,2}/\d{2,4})\s+(\d{1,2}):(\d{2})(?::\d{2})?(?:\s*\((BRT|UTC)\))?$"
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    clock = F.regexp_replace(part(iso, 2), r"^(\d):", "0$1:")
    local = F.try_to_timestamp(F.concat(part(iso, 1), F.lit(" "), clock)).cast("timestamp_ntz")
    found = F.struct(read_date(F.when(t.rlike(clocked), part(clocked, 1)), as_of_year=as_of_year).alias("day"), read_date(t, as_of_year=as_of_year).alias("plain"), local.alias("local"))
    return let(found, lambda v: _moment(c, t, n, v["day"], v["plain"], v["local"], utc, iso, clocked))


def _moment(c: Column, t: Column, n: Column, day: Column, plain_day: Column, local: Column, utc: bool, iso: str, clocked: str) -> Column:
    back = F.expr("INTERVAL 3 HOURS")
    at = lambda seconds: F.timestamp_seconds(seconds).cast("timestamp_ntz")
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    serial, epoch = n.between(20000, 80000), n.between(9e8, 4.2e9) | n.between(9e11, 4.2e12)
    seconds = F.when(n > 1e11, n / 1000).otherwise(n)
    zone = F.upper(part(iso, 3))
    in_utc = zone.isin("Z", "UTC") | ((zone == "") & F.lit(utc))
    offset = F.regexp_replace(zone, ":", "")
    minutes = (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1)
    zoned = F.when(in_utc, local - back).when(zone == "", local).otherwise(local - F.make_interval(mins=minutes) - back)
    timed = day["value"].cast("timestamp_ntz") + F.make_interval(hours=part(clocked, 2).try_cast("int"), mins=part(clocked, 3).try_cast("int"))
    to_local = (F.upper(part(clocked, 4)) == "UTC") | ((part(clocked, 4) == "") & F.lit(utc))
    note = "horário UTC convertido para Brasília (−3h)"
    value = (
        F.when(serial, at((n - 25569) * 86400))
        .when(epoch, at(seconds) - back)
        .when(t.rlike(iso), zoned)
        .when(t.rlike(clocked), F.when(to_local, timed - back).otherwise(timed))
        .otherwise(plain_day["value"].cast("timestamp_ntz"))
    )
    has_time = F.when(serial, n % 1 != 0).when(epoch | t.rlike(iso) | t.rlike(clocked), True).otherwise(False)
    alert = (
        F.when(blank(c), "")
        .when(serial, "data em número serial do Excel convertida")
        .when(epoch, "data em epoch (segundos desde 1970, UTC) convertida para horário de Brasília")
        .when(t.rlike(iso), F.when(local.isNull(), "data inexistente").when(in_utc, note).otherwise(""))
        .when(t.rlike(clocked), F.when(to_local, F.concat_ws("; ", F.nullif(day["alert"], F.lit("")), F.lit(note))).otherwise(day["alert"]))
        .otherwise(plain_day["alert"])
    )
    return F.struct(F.when(~blank(c), value).alias("ts"), F.coalesce(has_time & value.isNotNull(), F.lit(False)).alias("has_time"), alert.alias("alert"))
