"""Writing results: Parquet or separated text, without columns that hold secrets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recordloom.operators.privacy import column_class

#: The table of a package that tells what is in it.
MANIFEST = "manifest"
#: Fixed value: characters that names of sheets can't have.
REFUSED = "[]:*?/\\"


def without_secrets(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """df without columns that its names mark as secrets, cards or other protected data."""
    kept = lambda c: (column_class(c) or ("", ""))[1] not in ("credencial", "financeiro", "sensivel", "crianca", "infraestrutura")
    return df.select(*[c for c in df.columns if kept(c) and c not in also and not c.startswith("_")])


def package(tables: dict[str, DataFrame], path: str, form: str = "csv", partition_by: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Write each table to a folder of its own below path, with a manifest, and return it: table, n_rows, n_columns, filled (filled values by column).

    Tables are text separated by semicolons or Parquet; secret columns stay out. Counts are taken in the pass that writes. All is written beside path and
    renamed to it when complete, so a package that is there is whole; one that exists already is left alone and raises FileExistsError.
    """
    spark = next(iter(tables.values())).sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, staged = hadoop(path), f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    rows = []
    for name, df in tables.items():
        kept = without_secrets(df)
        seen = Observation()
        counts = [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(kept.columns)]
        writer = kept.observe(seen, F.count(F.lit(1)).alias("n"), *counts).write
        if partition_by and partition_by.get(name):
            writer = writer.partitionBy(*partition_by[name])
        if form == "csv":
            writer.option("header", "true").option("sep", ";").csv(f"{staged}/{name}")
        else:
            writer.parquet(f"{staged}/{name}")
        found = seen.get
        rows.append((name, found["n"], len(kept.columns), {c: found[f"c{i}"] for i, c in enumerate(kept.columns)}))
    shape = "table string, n_rows long, n_columns int, filled map<string,long>"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{staged}/{MANIFEST}")
    if not fs.rename(hadoop(staged), target):
        raise OSError(f"{staged} could not be renamed to {path}")
    return spark.read.schema(shape).parquet(f"{path}/{MANIFEST}")


def readable(name: str, taken: set[str], limit: int = 28) -> str:
    """A name for a table or sheet of a package: no characters that files refuse, at most limit characters, with a number if it is taken already."""
    base = "".join("_" if c in REFUSED else c for c in name)[:limit] or "aba"
    made, n = base, 1
    while made.lower() in {t.lower() for t in taken}:
        n += 1
        made = f"{base}_{n}"
    return made


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_columns) of results."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = part if out is None else out.union(part)
    return out
