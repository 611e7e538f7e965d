"""File inventory: name problems, categories, identical copies, tidy names and the trust in a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import file_name

# Patterns of bad names with their labels, junk, extensions, and what gives a secret away.
BAD_NAMES = (
    (r"nova pasta|new folder", "nome padrão do sistema ('Nova pasta')"),
    (r"sem t[ií]tulo|untitled|documento\d*$", "arquivo sem título"),
    (r"\bfinal\b.*\bfinal\b|final[_ ]?final", "'final final'"),
    (r"(?<![a-z])v\d+(?![a-z0-9])|vers[aã]o ?\d", "versão no nome (v2...)"),
    (r"agora[_ ]?vai|definitiv|ultim[oa]|\bok\b|revisad", "nome informal (AGORA_VAI, definitivo...)"),
    (r"\bfinal\b", "'final' no nome"),
    (r"c[óo]pia|copy|\(\d+\)", "cópia / numeração automática"),
    (r"\bold\b|_old|antig|backup|bkp", "pasta/arquivo de backup antigo"),
    (r"\s", "espaços no nome"),
    (r"(?=.*[a-z])[A-Z]{3,}", "maiúsculas misturadas"),
    (r"[^\x00-\x7f]", "acentos/caracteres especiais"),
)
JUNK_NAMES = ("thumbs.db", "desktop.ini", ".ds_store", "ehthumbs.db", "icon\r", ".localized")
JUNK = r"^~\$|^\._|^~.*\.tmp$|\.tmp$|^\.~lock\.|\.crdownload$|\.part$"
JUNK_FOLDERS = r"__macosx/|\.git/|\.svn/|\$recycle\.bin/"
SECRET_NAME = r"^\.env(\..*)?$|^id_(rsa|dsa|ecdsa|ed25519)$|\.(pem|key|pfx|p12|jks|keystore|kdbx)$|senha|password|passwd|credencia|credential|secret|segredo|token"
SECRET_TEXT = r"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:password|passwd|senha|secret(?:_key)?|api[_-]?key|token|aws_secret)\b\s*[:=]\s*\S+|\b[a-z][a-z0-9+.-]*://[^:\s/]+:[^@\s]+@|\bAKIA[0-9A-Z]{16}\b"
DATA = (".csv", ".xlsx", ".xlsm", ".xls", ".json", ".tsv", ".jsonl", ".ndjson", ".xml", ".db", ".sqlite", ".sqlite3", ".sql")
DOCUMENT = (".pdf", ".docx", ".html", ".htm", ".md", ".rtf", ".txt", ".log", ".eml")
CONFIG = (".yaml", ".yml", ".ini", ".conf", ".cfg", ".toml", ".properties", ".env", ".bak", ".config")
WORSE = r"(?iu)backup|old|antig|c[óo]pia|copy|lixeira|trash|\.bak$|nao usar|não usar"
OLD_PATH, COPY_PATH = r"(?i)backup|bkp|\bold\b|_old|antig|obsolet|lixeira|arquivo morto", r"(?iu)c[óo]pia|copy|\(\d+\)"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def name_problems(path: Column) -> Column:
    """The labels of the bad-name patterns that a path shows; a double "final" hides the single one."""
    stem = F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")
    hits = [(label, (stem if "[A-Z]" in p else F.lower(path)).rlike(("" if "[A-Z]" in p else "(?U)") + p)) for p, label in BAD_NAMES]
    double = dict(hits)["'final final'"]
    return F.array_compact(F.array(*(F.when(hit & (~double if label == "'final' no nome" else F.lit(True)), label) for label, hit in hits)))


def inventory(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, sha256, category, copy_of, problems, suggested) for files with their content as text.

    Of identical contents the best-placed file is the original: outside backups, near the root, first by name. Junk and empty files come before copies.
    """
    p, name = F.col(path), F.lower(base_name(F.col(path)))
    junk = name.isin(*JUNK_NAMES) | name.rlike(JUNK) | F.lower(p).rlike(JUNK_FOLDERS)
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    rows = files.select(
        p.alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"), junk.alias("junk"), empty.alias("empty"), extension(p).alias("ext"),
        (name.rlike("(?i)" + SECRET_NAME) | ((extension(p).isin(*CONFIG) | (extension(p) == "")) & F.col(text).rlike(SECRET_TEXT))).alias("secret"),
    )
    place = F.struct(F.col("path").rlike(WORSE).alias("worse"), F.length(F.regexp_replace("path", "[^/]", "")).alias("depth"), "path")
    best = rows.filter("not junk and not empty").groupBy("sha256").agg(F.min(place)["path"].alias("best"))
    rows = rows.join(best, "sha256", "left")
    copied = F.col("best") != F.col("path")
    category = (
        F.when(F.col("junk"), "lixo").when(F.col("empty"), "vazio").when(copied, "duplicata").when(F.col("secret"), "segredo").when(F.col("ext").isin(*DATA), "dados").when(F.col("ext").isin(*DOCUMENT), "documento").otherwise("nao_suportado")
    )
    rows = rows.withColumn("category", category)
    return rows.select(
        "path", "sha256", "category", F.when(F.col("category") == "duplicata", F.col("best")).alias("copy_of"), name_problems(F.col("path")).alias("problems"),
        F.when(F.col("category").isin("dados", "documento"), file_name(F.col("path"))).alias("suggested"),
    )


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with a unique name: _2, _3 before the extension of later ones."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    dot = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return rows.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), dot)))


def trust(path: Column, n_rows: Column, n_personal: Column, as_of_year: int = 2026) -> Column:
    """How far a source is trusted: 100, less for backups, copies and past years in the name, more for personal columns and rows."""
    years = F.transform(F.regexp_extract_all(path, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    stale = F.coalesce(F.array_max(years) < as_of_year, F.lit(False))
    less = F.when(path.rlike(OLD_PATH), 40).otherwise(0) + F.when(path.rlike(COPY_PATH), 20).otherwise(0) + F.when(stale, 25).otherwise(0)
    return 100 - less + 3 * n_personal + F.floor(F.least(n_rows, F.lit(1000)) / 100).cast("int")
