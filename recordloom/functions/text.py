"""Cleaning and normalising of names, contacts and free text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.base import let, once
from recordloom.functions.ids import digits

# Null tokens, name particles, states, city names and abbreviations, boolean words.
BLANK = (
    "", "nan", "none", "null", "n/a", "na", "nd", "-", "--", "s/n", "sem", "nat", "sem telefone", "sem email",
    "sem e-mail", "nao informado", "não informado", "nao tem", "não tem", "?",
)
BLANK_TABLE = ("", "nan", "none", "null", "n/a", "-", "nat")
PARTICLES = ("da", "de", "do", "das", "dos", "e", "di", "du", "van", "von")
STATES = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPA": "AP", "AMAZONAS": "AM", "BAHIA": "BA", "CEARA": "CE", "DISTRITO FEDERAL": "DF",
    "ESPIRITO SANTO": "ES", "GOIAS": "GO", "MARANHAO": "MA", "MATO GROSSO": "MT", "MATO GROSSO DO SUL": "MS", "MINAS GERAIS": "MG",
    "PARA": "PA", "PARAIBA": "PB", "PARANA": "PR", "PERNAMBUCO": "PE", "PIAUI": "PI", "RIO DE JANEIRO": "RJ", "RIO GRANDE DO NORTE": "RN",
    "RIO GRANDE DO SUL": "RS", "RONDONIA": "RO", "RORAIMA": "RR", "SANTA CATARINA": "SC", "SAO PAULO": "SP", "SERGIPE": "SE", "TOCANTINS": "TO",
}
CITIES = {
    "poa": "Porto Alegre", "porto alegre": "Porto Alegre", "bh": "Belo Horizonte", "bhz": "Belo Horizonte", "belo horizonte": "Belo Horizonte",
    "rj": "Rio de Janeiro", "rio": "Rio de Janeiro", "rio de janeiro": "Rio de Janeiro", "sp": "São Paulo", "sampa": "São Paulo",
    "sao paulo": "São Paulo", "cwb": "Curitiba", "curitiba": "Curitiba", "bsb": "Brasília", "brasilia": "Brasília", "ssa": "Salvador",
    "salvador": "Salvador", "rec": "Recife", "recife": "Recife", "fortaleza": "Fortaleza", "manaus": "Manaus", "belem": "Belém",
    "goiania": "Goiânia", "floripa": "Florianópolis", "florianopolis": "Florianópolis", "vitoria": "Vitória", "joao pessoa": "João Pessoa",
    "teresina": "Teresina", "cuiaba": "Cuiabá", "maceio": "Maceió", "natal": "Natal", "aracaju": "Aracaju", "sao luis": "São Luís",
    "campo grande": "Campo Grande", "porto velho": "Porto Velho", "macapa": "Macapá", "boa vista": "Boa Vista", "palmas": "Palmas",
    "rio branco": "Rio Branco", "campinas": "Campinas", "niteroi": "Niterói", "santos": "Santos",
}
CITY_SHORT = {
    "bhorizonte": "Belo Horizonte", "bhte": "Belo Horizonte", "spaulo": "São Paulo", "sampa": "São Paulo", "rjaneiro": "Rio de Janeiro",
    "palegre": "Porto Alegre", "ptoalegre": "Porto Alegre", "fpolis": "Florianópolis", "cwb": "Curitiba", "rec": "Recife", "ssa": "Salvador",
    "poa": "Porto Alegre", "bsb": "Brasília", "for": "Fortaleza", "bel": "Belém", "mao": "Manaus", "gyn": "Goiânia", "nat": "Natal",
}
TRUE_WORDS = ("sim", "s", "yes", "y", "1", "true", "verdadeiro", "x", "pago", "ok", "1.0")
FALSE_WORDS = ("nao", "n", "no", "0", "false", "falso", "0.0", "pendente")

#: Letters with marks and what is left without them.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def mapped(key: Column, values: dict[str, str]) -> Column:
    """The value of a key in a fixed table, else null."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def blank(c: Column, tokens=BLANK) -> Column:
    """Null, or one of the words that stand for a missing value."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*tokens)


def filled(c: Column, tokens=BLANK) -> Column:
    """c, or null where it is blank."""
    return F.when(~blank(c, tokens), c)


def first_filled(*cs: Column) -> Column:
    """The first of several columns that isn't blank."""
    return F.coalesce(*map(filled, cs))


def plain(c: Column) -> Column:
    """Without the marks of Latin letters."""
    return F.translate(c, MARKED, PLAIN)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@once
def repaired(c: Column) -> Column:
    """UTF-8 text that was read as code page 1252 or Latin-1 is read again, twice at most; other text stays."""
    read = tuple("".join(chars) for chars in zip(*((bytes([b]).decode("cp1252"), chr(b)) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))))

    def read_again(t: Column) -> Column:
        latin = F.translate(t, *read)
        narrow = latin.rlike("^[\\x{00}-\\x{FF}]*$") & latin.rlike("[\\x{C2}-\\x{F4}][\\x{80}-\\x{BF}]")
        return F.coalesce(F.try_validate_utf8(F.encode(F.when(narrow, latin), "ISO-8859-1").cast("string")), t)

    return let(read_again(c), read_again)


@once
def person_name(c: Column) -> Column:
    """Single spaces, each word capitalised, particles small unless first; blank gives null."""
    words = F.split(F.lower(squeezed(c)), " ")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*PARTICLES), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, (1 << 31) - 1))))
    return F.when(~blank(c), F.array_join(cased, " "))


def name_key(c: Column) -> Column:
    return F.lower(plain(F.coalesce(person_name(c), F.lit(""))))


def text_key(c: Column) -> Column:
    """Letters and digits of free text, small and unmarked, separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(plain(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def header(c: Column) -> Column:
    """A column name in snake case; nothing usable gives "coluna"."""
    made = F.regexp_replace(F.regexp_replace(F.lower(plain(F.trim(c))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", "coluna").otherwise(made)


def names_compatible(a: Column, b: Column) -> Column:
    """Equal first and last words, and middle words that agree in their initials as far as both go; empty names agree."""
    x, y = F.split(name_key(a), " "), F.split(name_key(b), " ")
    short = F.least(F.size(x), F.size(y)) - 2
    middle = lambda w: F.slice(w, F.lit(2), F.greatest(short, F.lit(0)))
    agree = F.forall(F.zip_with(middle(x), middle(y), lambda p, q: F.substring(p, 1, 1) == F.substring(q, 1, 1)), lambda ok: ok)
    ends = (x[0] == y[0]) & (F.element_at(x, -1) == F.element_at(y, -1))
    return (name_key(a) == "") | (name_key(b) == "") | (ends & agree)


@once
def join_key(c: Column) -> Column:
    """A key for joining tables: digits without leading zeros if they are most of the text, else capitals without marks."""
    t = F.trim(c.cast("string"))
    d = digits(t)
    bare = F.regexp_replace(d, "^0+", "")
    mostly = (d != "") & (F.length(d) * 10 >= F.length(F.replace(t, F.lit(" "), F.lit(""))) * 6)
    return F.when(mostly, F.when(bare == "", "0").otherwise(bare)).otherwise(F.nullif(F.upper(plain(t)), F.lit("")))


@once
def state(c: Column) -> Column:
    """The two-letter code of a state given by code or name."""
    t = F.upper(F.trim(plain(F.coalesce(c, F.lit("")))))
    return F.when(t.isin(*STATES.values()), t).otherwise(mapped(t, STATES))


@once
def city(c: Column) -> Column:
    """(value, alert): abbreviations expanded, a state after the name removed."""
    return let(squeezed(c), lambda t: _city(c, t))


def _city(c: Column, t: Column) -> Column:
    tail = F.upper(F.regexp_extract(t, r"\s*[-/,]\s*([A-Za-z]{2})$", 1))
    cut = tail.isin(*STATES.values())
    base = F.when(cut, F.regexp_replace(t, r"\s*[-/,]\s*[A-Za-z]{2}$", "")).otherwise(t)
    key = F.lower(plain(base))
    short, known = mapped(F.regexp_replace(key, "[^a-z]", ""), CITY_SHORT), mapped(key, CITIES)
    removed = F.when(cut, "UF removida do nome da cidade").otherwise("")
    alert = F.when(short.isNotNull(), "abreviação expandida").when(known.isNotNull() & (F.length(key) <= 4) & (key != F.lower(known)), "abreviação expandida").otherwise(removed)
    return F.struct(F.when(~blank(c), F.coalesce(short, known, person_name(base))).alias("value"), F.when(blank(c), "").otherwise(alert).alias("alert"))


@once
def email(c: Column) -> Column:
    """(value, alert): small, one @, checked."""
    raw = F.trim(c)
    made = F.regexp_replace(F.replace(F.lower(raw), F.lit(" "), F.lit("")), "@+", "@")
    good = made.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$")
    notes = F.array_compact(
        F.array(
            F.when(raw.contains("@@"), "'@@' corrigido para '@'").when(raw != F.lower(raw), "convertido para minúsculas"),
            F.when(~made.rlike("^[\\x00-\\x7F]*$"), "e-mail com acento/caractere não-ASCII: válido pelo padrão (SMTPUTF8), mas muitos sistemas rejeitam"),
        )
    )
    alert = F.when(blank(c), "e-mail vazio").when(~good, F.concat(F.lit("e-mail inválido ("), raw, F.lit(")"))).otherwise(F.array_join(notes, "; "))
    return F.struct(F.when(~blank(c) & good, made).alias("value"), alert.alias("alert"))


@once
def phone(c: Column, area: Column | None = None, keep_short: bool = False) -> Column:
    """(value, alert) as +55 (DD) NNNNN-NNNN; area is put before a number without one."""
    return let(digits(c), lambda d: _phone(c, d, area, keep_short))


def _phone(c: Column, d: Column, area: Column | None, keep_short: bool) -> Column:
    d = F.when(d.startswith("55") & F.length(d).isin(12, 13), F.substring(d, 3, 99)).otherwise(d)
    d = F.when(d.startswith("0") & F.length(d).isin(11, 12), F.substring(d, 2, 99)).otherwise(d)
    bare = F.length(d).isin(8, 9)
    area = F.lit(None).cast("string") if area is None else area
    full = F.when(bare & area.isNotNull(), F.concat(area, d)).otherwise(d)
    part = lambda a, n: F.substring(full, a, n)
    lead = F.concat(F.lit("+55 ("), part(1, 2), F.lit(") "))
    made = F.when((F.length(full) == 11) & (part(3, 1) == "9"), F.concat(lead, part(3, 5), F.lit("-"), part(8, 4)))
    made = made.when(F.length(full) == 10, F.concat(lead, part(3, 4), F.lit("-"), part(7, 4)))
    text = F.coalesce(c.cast("string"), F.lit(""))
    short = bare & area.isNull()
    alert = F.when(blank(c), "telefone vazio")
    if keep_short:
        cut = F.length(d) - 4
        made = F.when(short, F.concat(d.substr(F.lit(1), cut), F.lit("-"), d.substr(cut + 1, F.lit(4)))).otherwise(made)
        alert = alert.when(short, "telefone SEM DDD na origem — completar")
    else:
        alert = alert.when(short, F.concat(F.lit("telefone sem DDD ("), text, F.lit(")")))
    alert = alert.when(made.isNull(), F.concat(F.lit("telefone inválido ("), text, F.lit(")"))).when(bare, F.concat(F.lit("DDD "), area, F.lit(" inferido"))).otherwise("")
    return F.struct(F.when(~blank(c), made).alias("value"), alert.alias("alert"))


@once
def boolean(c: Column) -> Column:
    """True, false or null from words."""
    t = F.lower(F.trim(plain(c.cast("string"))))
    return F.when(blank(c), None).when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


@once
def status(c: Column) -> Column:
    """A status word, small; a question mark after it becomes a note."""
    t = F.lower(F.trim(c))
    return F.when(~blank(c), F.when(t.endswith("?"), F.concat(F.trim(F.regexp_replace(t, r"\?+$", "")), F.lit(" (a confirmar)"))).otherwise(t))


@once
def reference(c: Column) -> Column:
    """A contract or process number: no spaces, no leading zeros, a year of four digits."""
    t = F.regexp_replace(F.upper(F.regexp_replace(c, r"\s+", "")), "^[.,;:-]+|[.,;:-]+$", "")
    number = F.regexp_replace(F.substring_index(t, "/", 1), "^0+", "")
    rest = F.regexp_extract(t, "^[^/]*/(.*)$", 1)
    year = F.regexp_extract(rest, "^([0-9]*)", 1)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.when(t.contains("/"), F.concat(F.when(number == "", "0").otherwise(number), F.lit("/"), full, F.regexp_replace(rest, "^[0-9]*", ""))).otherwise(t)


def format_label(field: str, c: Column) -> Column:
    """The kind of writing of a raw value of a field (cpf, data, telefone, email, nome)."""
    t = F.trim(c)
    if field == "cpf":
        label = F.when(t.rlike(r"^\d{3}\.\d{3}\.\d{3}-\d{2}$"), "000.000.000-00").when(t.rlike(r"^\d{11}$"), "só dígitos").when(t.rlike(r"^[\d ]+$"), "dígitos com espaços").otherwise("outro")
    elif field == "data":
        part = lambda i: F.regexp_extract(t, r"^(\d{1,2})([/\-.])(\d{1,2})[/\-.](\d{2,4})$", i)
        a, sep, b, year = part(1).try_cast("int"), part(2), part(3).try_cast("int"), F.when(F.length(part(4)) == 4, "AAAA").otherwise("AA")
        label = (
            F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), "AAAA-MM-DD (ISO)")
            .when(t.rlike(r"(?iU)^\d{1,2}\s+de\s+\w+\.?\s+(de\s+)?\d{2,4}$"), "DD de mês AAAA")
            .when((b > 12) & (a <= 12), F.concat(F.lit("MM"), sep, F.lit("DD"), sep, year, F.lit(" (americano)")))
            .when((a <= 12) & (b <= 12) & (a != b), F.concat(F.lit("DD"), sep, F.lit("MM"), sep, year, F.lit(" ambígua")))
            .when(sep != "", F.concat(F.lit("DD"), sep, F.lit("MM"), sep, year))
            .otherwise("outro")
        )
    elif field == "telefone":
        n = F.length(digits(t))
        label = F.when(t.startswith("+55"), "+55DDNÚMERO").when(t.rlike(r"^\(\d{2}\)\s?\d{4,5}-\d{4}$"), "(DD) NNNNN-NNNN").when(n.isin(10, 11), "DDNÚMERO só dígitos").when(n.isin(8, 9), "sem DDD").otherwise("outro")
    elif field == "email":
        label = F.when(t.contains("@@"), "com @@").when(t != F.lower(t), "MAIÚSCULAS").when(t.rlike(r"(?U)^[^@\s]+@[^@\s]+\.\w+$"), "minúsculas").otherwise("inválido")
    elif field == "nome":
        cased = F.upper(t) != F.lower(t)
        label = F.when(c != t, "espaços sobrando").when(cased & (t == F.upper(t)), "MAIÚSCULAS").when(cased & (t == F.lower(t)), "minúsculas").otherwise("Normal")
    else:
        label = F.lit("—")
    return F.when(blank(c), "vazio/N/A").otherwise(label)


@once
def file_name(path: Column) -> Column:
    """A tidy file name: no noise words, snake case, marks of copies and backups at the end, the extension small."""
    noise = r"(?i)final|v\d+|agora[_ ]?vai|definitiv\w*|c[óo]pia|copy|\(\d+\)|nova pasta|new folder|sem t[ií]tulo|untitled|old|antig\w*|backup|bkp|ultim[oa]|revisad\w*"
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1))
    stem = F.when(extension != "", F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    base = F.regexp_replace(F.regexp_replace(plain(stem), noise, " "), "[^A-Za-z0-9]+", "_")
    base = F.lower(F.regexp_replace(base, "^_+|_+$", ""))
    copied = F.when((base != "") & name.rlike("(?iu)c[óo]pia|copy"), "_copia").otherwise("")
    older = F.when((base != "") & path.rlike(r"(?i)backup|bkp|\bold\b|_old|antig"), "_antigo").otherwise("")
    return F.concat(F.when(base == "", "arquivo").otherwise(base), copied, older, extension)


def items(json: Column) -> Column:
    """"name xqty; ..." of a JSON list of {produto, qtd}; other text stays."""
    listed = F.from_json(json, "array<struct<produto:string,qtd:string>>")
    made = F.array_join(F.transform(listed, lambda i: F.concat(i["produto"], F.lit(" x"), F.coalesce(i["qtd"], F.lit("1")))), "; ")
    return F.when(F.trim(json).startswith("["), made).otherwise(json)
