"""Files of many formats as rows: a recursive scan, decoding, and readers that turn contents into cells (path, line, column, value).

Text formats are split with Column expressions. Archives and binary formats open one file at a time in a task; a file that can't be read gives a
row with an error, never a failed job.
"""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.base import let
from recordloom.functions.text import header
from recordloom.sources import office
from recordloom.tables import spread, written

# The limits of archive expansion, and how far its levels go.
MAX_BYTES, MAX_FILES, MAX_LEVELS = 500 << 20, 5000, 3
#: Characters in which a separator is looked for, and rows in which a header is.
SNIFF_CHARS, HEADER_ROWS = 20_000, 15
SEPARATORS = (";", ",", "\t", "|")
#: Rows, and bytes of files, from which on what was read of small files is handed on.
FRAME_ROWS, FRAME_BYTES = 10_000, 8 << 20
#: The characters that code page 1252 has where Latin-1 has control characters, and these.
C1 = tuple("".join(chars) for chars in zip(*((chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))))
CELLS = "path string, part string, line long, column string, value string, error string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below root, with paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^(?:[a-z]+:/*)?/*" + re.escape(re.sub("^[a-z]+:/*", "", root).strip("/")) + "/+", "").alias("path"), "content")


def _opened(path: str, content: bytes, level: int, left: list[int]) -> Iterator[tuple[str, bytes | None, str | None]]:
    """The members of an archive one by one; left holds the files and bytes that all levels together may still give."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if i.is_dir():
                    continue
                left[0], left[1] = left[0] - 1, left[1] - i.file_size
                if min(left) < 0:
                    raise ValueError("archive over the limits")
                name = i.filename if i.flag_bits & 0x800 else i.filename.encode("cp437", "replace").decode("utf-8", "replace")
                body = z.read(i)
                yield f"{path}/{name}", body, None
                if name.lower().endswith(".zip") and level < MAX_LEVELS:
                    yield from _opened(f"{path}/{name}", body, level + 1, left)
    except Exception as e:
        yield path, None, f"{type(e).__name__}: {e}"


def expanded(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, content, error): files beside archives as they are, archives with what they hold, nested ones too.

    Of an archive that has more files or bytes than allowed, nested ones included, what comes first stays and an error row follows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                yield pd.DataFrame([(path, content, None)], columns=["path", "content", "error"])
                if path.lower().endswith(".zip"):
                    for row in _opened(path, content, 1, [max_files, max_bytes]):
                        yield pd.DataFrame([row], columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, error string")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-16 by its mark or by zero bytes at every second place, UTF-8 if valid, else code page 1252, whose five unused bytes stay."""
    latin = F.decode(content, "ISO-8859-1")
    plain = F.encode(F.regexp_replace(latin, "^ï»¿", ""), "ISO-8859-1")
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    head = F.substring(latin, 1, 200)
    zeros = F.length(F.regexp_replace(head, "(?s)[^\\x{00}]\\x{00}", "")) * 5 < F.length(head)
    return (
        F.when(marked, F.decode(content, "UTF-16"))
        .when((F.octet_length(content) >= 4) & (F.octet_length(content) % 2 == 0) & zeros, F.decode(content, "UTF-16LE"))
        .when(F.is_valid_utf8(plain.cast("string")), plain.cast("string"))
        .otherwise(F.translate(latin, *C1))
    )


def separator(text: Column) -> Column:
    """The separator of delimited text: the one by which most of the first lines have equally many cells, two at least; of several the first."""
    lines = F.slice(F.filter(F.split(F.substring(text, 1, SNIFF_CHARS), "\r?\n"), lambda x: F.trim(x) != ""), 1, 30)
    return let(lines, lambda held: F.array_max(F.array(*(_votes(held, s, i) for i, s in enumerate(SEPARATORS))))["s"])


def _votes(lines: Column, s: str, i: int) -> Column:
    sizes = F.filter(F.transform(lines, lambda x: F.size(F.split(x, re.escape(s)))), lambda n: n > 1)
    alike = let(sizes, lambda all_: F.array_max(F.transform(F.array_distinct(all_), lambda n: F.size(F.filter(all_, lambda m: m == n)))))
    return F.struct(F.coalesce(alike, F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s"))


def is_table(text: Column) -> Column:
    """Whether text is delimited, not prose: most of its first lines have as many separators as the first one, short cells, and no colon in their first cell."""
    lines = F.slice(F.filter(F.split(F.substring(text, 1, SNIFF_CHARS), "\r?\n"), lambda x: F.trim(x) != ""), 1, 30)

    def verdict(held: Column) -> Column:
        out = None
        for s in (";", "\t", "|", ","):
            cut = re.escape(s)
            n = F.size(F.split(held[0], cut))
            steady = (n >= 2) & (F.size(F.filter(held, lambda x: F.size(F.split(x, cut)) == n)) > 0.8 * F.size(held))  # noqa: B023
            cells = F.flatten(F.transform(held, lambda x: F.split(x, cut)))  # noqa: B023
            spoken = F.aggregate(cells, F.lit(0), lambda acc, x: acc + F.regexp_count(x, F.lit(r"\S+"))) > 3 * F.size(cells)
            headed = F.exists(F.slice(held, 1, 3), lambda x: F.split(x, cut)[0].contains(":"))  # noqa: B023
            out = F.when(steady, ~(spoken | headed)) if out is None else out.when(steady, ~(spoken | headed))
        return F.when(F.size(held) >= 2, out.otherwise(False)).otherwise(False)

    return let(lines, verdict)


def _records(text: Column) -> Column:
    """The lines of delimited text; a line break between quotes is no end of a line, if the quotes pair up."""
    text = F.concat(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\n"))
    paired = F.length(F.regexp_replace(text, '[^"]+', "")) % 2 == 0
    return F.when(paired, F.regexp_extract_all(text, F.lit('([^"\n]*+(?:"[^"]*+"[^"\n]*+)*+)\n'), F.lit(1))).otherwise(F.split(text, "\n"))


def _cells(row: Column, sep: Column) -> Column:
    """The cells of a line: a separator between quotes belongs to its cell, outer quotes go and doubled ones are one."""
    found = None
    for s in SEPARATORS:
        cut = re.escape(s)
        cells = F.regexp_extract_all(F.concat(row, F.lit(s)), F.lit(rf'[^\S\t]*("(?:[^"]|"")*+"[^\S\t]*|[^{cut}]*){cut}'), F.lit(1))
        found = F.when(sep == s, cells) if found is None else found.when(sep == s, cells)
    bare = lambda c: F.trim(F.replace(F.regexp_replace(F.trim(c), '(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    return F.transform(found, bare)


def delimited(texts: DataFrame) -> DataFrame:
    """(path, line, column, value) of delimited texts (path, text); quotes around a cell go, blank lines are skipped.

    The header is the first of the leading rows that has three fifths of the most filled cells, two at least, all of them short and none of them a
    number, or else the first row; names are canonical and unique by place.
    """
    rows = F.filter(F.transform(_records(F.col("text")), lambda r, i: F.struct(i.alias("line"), r.alias("row"))), lambda x: F.trim(x["row"]) != "")
    split = texts.select("path", separator(F.col("text")).alias("sep"), rows.alias("rows"))
    split = split.select("path", "sep", _head(F.col("rows"), F.col("sep")).alias("h"), F.explode("rows").alias("r")).filter("r.line > h.head")
    cells = split.select("path", "r.line", "h.names", F.posexplode(_cells(F.col("r.row"), F.col("sep"))).alias("i", "value"))
    return cells.select("path", "line", F.coalesce(header(F.get("names", F.col("i"))), F.concat(F.lit("coluna_"), F.col("i") + 1)).alias("column"), F.nullif("value", F.lit("")).alias("value"))


def _head(rows: Column, sep: Column) -> Column:
    """(worse, head, names) of the header among the rows (line, row) of a text; null if no row is leading."""

    def shaped(x: Column) -> Column:
        held = lambda cells: F.filter(cells, lambda c: c != "")
        named = lambda cells: F.forall(held(cells), lambda c: (F.char_length(c) <= 60) & ~c.rlike(r"^[\d.,\s-]+$"))
        return let(_cells(x["row"], sep), lambda cells: F.named_struct(F.lit("line"), x["line"], F.lit("cells"), cells, F.lit("n"), F.size(held(cells)), F.lit("named"), named(cells)))

    def best(leading: Column) -> Column:
        most = F.array_max(F.transform(leading, lambda x: x["n"]))
        fits = lambda x: (x["n"] >= F.greatest(F.lit(2), F.ceil(most * 0.6))) & x["named"]
        return F.array_min(F.transform(leading, lambda x: F.named_struct(F.lit("worse"), ~fits(x), F.lit("head"), x["line"], F.lit("names"), x["cells"])))

    return let(F.transform(F.filter(rows, lambda x: x["line"] < HEADER_ROWS), shaped), best)


def json_lines(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, line, record as variant) of JSON lines, and (path, broken) with the numbers of lines that can't be read."""
    rows = texts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "row")).filter(F.trim("row") != "")
    rows = rows.withColumn("record", F.try_parse_json("row"))
    broken = rows.filter("record is null").groupBy("path").agg(F.array_sort(F.collect_list(F.col("line") + 1)).alias("broken"))
    return rows.filter("record is not null").select("path", "line", "record"), broken


def json_records(texts: DataFrame) -> DataFrame:
    """(path, line, record, error) of JSON texts (path, text): the objects of an array, or of the first list that an object holds, else the object itself.

    record is JSON text. A text that is no JSON gives one row with an error; elements that are no objects are left out.
    """
    t = F.trim("text")
    fields = F.map_entries(F.from_json(t, "map<string,string>"))
    lists = F.filter(F.transform(F.coalesce(fields, F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.when(F.trim(e["value"]).startswith("["), F.from_json(e["value"], "array<string>"))), lambda x: x.isNotNull())
    found = F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.coalesce(F.get(lists, F.lit(0)), F.array(t)))
    record = lambda r: F.struct(r.alias("record"), F.lit(None).cast("string").alias("error"))
    wrong = F.array(F.struct(F.lit(None).cast("string").alias("record"), F.lit("not JSON").alias("error")))
    rows = texts.select("path", F.posexplode(F.when(F.try_parse_json(t).isNotNull(), F.transform(found, record)).otherwise(wrong)).alias("line", "r"))
    return rows.select("path", "line", "r.record", "r.error").filter(F.col("error").isNotNull() | F.trim("record").startswith("{"))


def flattened(records: DataFrame, key: str, value: str) -> DataFrame:
    """(key, name, value): the leaves of JSON texts at any depth, nested names joined by points, lists as JSON text."""
    fields = lambda c: F.explode(F.from_json(c, "map<string,string>"))
    nested = F.col("value").startswith("{") & F.from_json("value", "map<string,string>").isNotNull()
    level = records.select(key, fields(value).alias("name", "value"))
    leaves = None
    while True:  # once a level, while any row has a deeper one
        flat = level.filter(~nested | F.col("value").isNull())
        leaves = flat if leaves is None else leaves.union(flat)
        deep = level.filter(nested)
        if deep.isEmpty():
            return leaves
        level = deep.select(key, F.col("name").alias("outer"), fields("value").alias("inner", "value")).select(key, F.concat("outer", F.lit("."), "inner").alias("name"), "value")


def hidden_tables(leaves: DataFrame, key: str) -> DataFrame:
    """(path, text) of delimited texts that stand in base64 in leaves (key, name, value): two lines or more with a separator in the first."""
    text = F.try_to_binary(F.regexp_replace("value", r"\s+", ""), F.lit("base64"))
    rows = leaves.filter((F.length("value") >= 40) & F.col("value").rlike(r"^[A-Za-z0-9+/=\s]+$")).select(key, "name", text.alias("content"))
    rows = rows.filter(F.is_valid_utf8(F.col("content").cast("string"))).select(F.concat_ws("__", F.col(key).cast("string"), "name").alias("path"), F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "").alias("text"))
    lines = F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")
    return rows.filter((F.size(lines) >= 2) & F.get(lines, F.lit(0)).rlike(r"[,;\t|]"))


def html_text(html: Column) -> Column:
    """The readable text of a page: no scripts, styles, navigation and footers, tags as spaces, common entities resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _reader(read: Callable[[bytes], Iterator[tuple[str, int, str, str | None]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "part", "line", "column", "value", "error"]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"line": "Int64"})
        for batch in batches:
            rows, size = [], 0
            for path, content in zip(batch.path, batch.content):
                try:
                    found = [(path, *r, None) for r in read(bytes(content))]
                except Exception as e:
                    found = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
                rows += found
                size += len(content)
                if len(rows) >= FRAME_ROWS or size >= FRAME_BYTES:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    return run


def _sqlite(content: bytes) -> Iterator[tuple[str, int, str, str | None]]:
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
        found = db.execute(f'SELECT * FROM "{name}"')
        columns = [c[0] for c in found.description]
        for line, row in enumerate(found):
            for column, value in zip(columns, row):
                yield name, line, column, None if value is None else str(value)


_INSERT = re.compile(r"INSERT\s+INTO\s+[`\"\[]?(\w+)[`\"\]]?\s*(?:\(([^)]*)\))?\s*VALUES\s*", re.I)
_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|''|\\.)*)'|([^,()']+))\s*([,)])")


def _dump(content: bytes) -> Iterator[tuple[str, int, str, str | None]]:
    text, line = content.decode("utf-8", "replace"), 0
    for m in _INSERT.finditer(text):
        names = [c.strip(' `"[]') for c in (m[2] or "").split(",") if c.strip()]
        at = m.end()
        while text[at : at + 1] == "(":
            row, end = [], ""
            at += 1
            while end != ")" and (v := _VALUE.match(text, at)):
                raw, end, at = v[2], v[3], v.end()
                row.append(re.sub(r"\\(.)", r"\1", v[1].replace("''", "'")) if raw is None else None if raw.strip().upper() == "NULL" else raw.strip())
            for i, value in enumerate(row):
                yield m[1], line, names[i] if i < len(names) else f"coluna_{i + 1}", value
            line += 1
            at += len(re.match(r"\s*,?\s*", text[at:])[0])


def _sheets(content: bytes) -> Iterator[tuple[str, int, str, str | None]]:
    for sheet, _, row, col, value, _ in office.grid(content):
        yield sheet, row, office.column_letters(col), value


def _docx(content: bytes) -> Iterator[tuple[str, int, str, str | None]]:
    yield "document", 0, "text", "\n".join(office.docx_text(content)[0])


def _rtf(content: bytes) -> Iterator[tuple[str, int, str, str | None]]:
    yield "document", 0, "text", office.rtf_text(content)


def _mail(content: bytes) -> Iterator[tuple[str, int, str, str | None]]:
    m = message_from_bytes(content, policy=policy.default)
    body = m.get_body(("plain", "html"))
    found = {k: m.get(k) for k in ("From", "To", "Date", "Subject")} | {"body": body.get_content() if body else "", "attachments": "; ".join(a.get_filename() or "" for a in m.iter_attachments())}
    for k, v in found.items():
        yield "mail", 0, k, None if v is None else str(v)


def _leaves(element: ElementTree.Element, path: tuple[str, ...] = ()) -> Iterator[tuple[str, str | None]]:
    """(name, text) of an element's attributes, its own text and everything below, names joined by _."""
    for name, value in element.attrib.items():
        yield "_".join((*path, name)), value
    text = (element.text or "").strip() or None
    if path and (text or not (len(element) or element.attrib)):
        yield "_".join(path), text
    for child in element:
        yield from _leaves(child, (*path, child.tag))


def _xml(content: bytes) -> Iterator[tuple[str, int, str, str | None]]:
    """Rows are the children of the root with its most common child tag (the first of those that tie); part is that tag. A name that a row has again gets a number."""
    root = ElementTree.fromstring(content)  # reads the declared encoding
    many: dict[str, int] = {}
    for child in root:
        many[child.tag] = many.get(child.tag, 0) + 1
    tag = max(many, key=many.__getitem__, default=None)
    for line, child in enumerate(c for c in root if c.tag == tag):
        seen: dict[str, int] = {}
        for column, value in _leaves(child):
            seen[column] = n = seen.get(column, 0) + 1
            yield tag, line, column if n == 1 else f"{column}_{n}", value


READERS = {"sqlite": _sqlite, "sql": _dump, "xlsx": _sheets, "eml": _mail, "xml": _xml, "docx": _docx, "rtf": _rtf}
# The kind of a file by its extension; SQLite is known by its first bytes.
KINDS = {
    "csv": "table", "tsv": "table", "txt": "table or prose", "json": "json", "jsonl": "lines", "ndjson": "lines", "xml": "xml", "sql": "sql", "xlsx": "xlsx", "xlsm": "xlsx",
    "docx": "docx", "rtf": "rtf", "eml": "eml", "html": "page", "htm": "page", "md": "prose", "log": "prose",
}
SQLITE_MARK = b"SQLite format 3\0".hex().upper()


def opened(files: DataFrame, kind: str) -> DataFrame:
    """(path, part, line, column, value, error) of files (path, content) of a kind of READERS; part is the table, sheet or row tag."""
    return files.select("path", "content").mapInPandas(_reader(READERS[kind]), CELLS)


def kind_of(path: Column, content: Column) -> Column:
    """The kind of a file: SQLite by its first bytes, others by the extension; text files are tables or prose by what they hold; else null."""
    known = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    kind = F.element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)))
    told = F.when(kind == "table or prose", F.when(is_table(decoded(content)), "table").otherwise("prose")).otherwise(kind)
    return F.when(F.hex(F.substring(content, 1, 16)) == SQLITE_MARK, "sqlite").otherwise(told)


def read(files: DataFrame) -> DataFrame:
    """(path, part, line, column, value, error): the cells of files (path, content) of every kind that has a reader, each file by its own kind.

    Archives are read as what they hold. A file that can't be read, is null, empty or a table without rows, or has no reader, gives one row with an error and
    doesn't stop the others. Documents give one cell, text, and the cells of their tables.
    """
    zipped = F.lower("path").endswith(".zip")
    held = written(expanded(files.filter(zipped)).filter(F.col("error").isNotNull() | ~zipped), "members")  # so that archives are opened once
    failed, files = held.filter("error IS NOT NULL"), files.filter(~zipped).select("path", "content").union(held.filter("error IS NULL").select("path", "content"))
    void = lambda c: F.when(c.isNull(), "no content").when(F.octet_length(c) == 0, "empty file")

    def told(path: Column, c: Column) -> Column:
        kind = F.when(void(c).isNull(), kind_of(path, c))
        return let(kind, lambda k: F.named_struct(F.lit("void"), void(c), F.lit("kind"), k, F.lit("text"), F.when(~k.isin(*READERS), decoded(c)), F.lit("content"), F.when(k.isin(*READERS), c)))

    files = spread(files).select("path", let(F.col("content"), lambda c: told(F.col("path"), c)).alias("f")).select("path", "f.*")
    files = written(files, "kinds", "kind")  # so that each file is told and decoded once, and a reader meets its own kinds only
    missing, files = files.filter("void IS NOT NULL").select("path", F.col("void").alias("error")), files.filter("void IS NULL")
    of = lambda *kinds: files.filter(F.col("kind").isin(*kinds))
    texts = lambda *kinds: of(*kinds).select("path", "text", "kind")
    none = lambda name: F.lit(None).cast("string").alias(name)
    shaped = lambda df: df.select("path", none("part"), F.col("line").cast("long").alias("line"), "column", "value", none("error"))
    out = shaped(delimited(texts("table")))
    whole = json_records(texts("json"))
    lines, broken = json_lines(texts("lines"))
    objects = whole.filter("error is null").select("path", "line", "record").union(lines.select("path", "line", F.to_json("record")))
    leaves = flattened(objects.select(F.struct("path", F.col("line").cast("long").alias("line")).alias("at"), "record"), "at", "record")
    out = out.union(shaped(leaves.select("at.path", "at.line", F.col("name").alias("column"), "value")))
    wrong = lambda df, error: df.select("path", none("part"), F.lit(None).cast("long").alias("line"), none("column"), none("value"), error.alias("error"))
    out = out.union(wrong(whole.filter("error is not null"), F.col("error")))
    out = out.union(wrong(broken, F.concat(F.lit("broken lines: "), F.array_join(F.transform("broken", lambda n: n.cast("string")), ", "))))
    page = F.when(F.col("kind") == "page", html_text(F.col("text"))).otherwise(F.col("text"))
    out = out.union(shaped(texts("page", "prose").select("path", F.lit(0).alias("line"), F.lit("text").alias("column"), page.alias("value"))))
    for kind in READERS:
        out = out.union(opened(of(kind), kind))
    tables = office.document_tables(of("docx"), "docx", "path", "content")
    out = out.union(tables.select("path", F.concat(F.lit("table "), F.col("table").cast("string")), F.col("line").cast("long"), "column", "value", F.lit(None).cast("string")))
    out = out.union(wrong(files.filter("kind is null"), F.lit("no reader for this kind of file")))
    bare = texts("table").filter(F.size(F.filter(_records(F.col("text")), lambda r: F.trim(r) != "")) < 2)
    return out.union(wrong(bare, F.lit("no rows"))).union(wrong(failed, F.col("error"))).union(wrong(missing, F.col("error")))
