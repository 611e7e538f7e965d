"""Sharding by extendible hashing.

The directory is indexed by leading bits of a row's hash. A bucket over the byte limit is split on the next bit, and only such a bucket, until
each shard fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.tables import forget, free_name, small, written

BYTE_LIMIT, HASH_BITS, STEP = 8 << 20, 60, 12


def _directory(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """rows (h, n_bytes, ...) with depth and prefix of their shards, and those rows that share all bits and still don't fit."""
    placed, used = None, 0
    while True:
        bits = min(HASH_BITS, used + STEP)
        cell = F.shiftright("h", HASH_BITS - bits)
        cells = written(rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("held"), F.count("*").alias("n")), "cells")
        tree = cells.select("*", F.explode(F.sequence(F.lit(used), F.lit(bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        fits = tree.groupBy("depth", "prefix").agg(F.sum("held").alias("held"), F.sum("n").alias("n")).filter((F.col("held") <= limit) | (F.col("n") == 1))
        chosen = tree.select("cell", "depth", "prefix").join(fits.select("depth", "prefix"), ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix")).alias("at"))
        chosen = written(chosen.select("cell", "at.depth", "at.prefix"), "directory")
        here = rows.withColumn("cell", cell)
        done = here.join(small(chosen, 32), "cell").drop("cell")
        placed = done if placed is None else placed.unionByName(done)
        rest = here.join(small(chosen.select("cell"), 16), "cell", "left_anti").drop("cell")
        if rest.isEmpty():
            return placed, None
        rows, used = written(rest, "oversized"), bits
        if used == HASH_BITS:
            return placed, rows


def _bits(hex_text):
    return F.conv(F.substring(hex_text, 1, 15), 16, 10).cast("long")


def shards(docs: DataFrame, limit: int = BYTE_LIMIT) -> DataFrame:
    """One row for each row of docs: doc_id, shard (its hash prefix as bits), depth, n_bytes, oversize.

    The hash is of doc_id. Rows that share every bit (null or repeated ids) and don't fit together are told apart by a hash of a row number, shown
    after a "+". A single row over the limit has a shard of its own, marked oversize. Null text has no bytes. An empty table gives an empty result.
    """
    return _named(docs.withColumn("_rid", F.monotonically_increasing_id()), limit).drop("rid")


def _named(docs: DataFrame, limit: int) -> DataFrame:
    """The rows of shards() with the row number "_rid" of docs as rid."""
    rows = docs.select(
        F.col("_rid").alias("rid"),
        F.col("doc_id").cast("long"),
        _bits(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    placed, rest = _directory(written(rows, "hashes"), limit)
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    out = placed.withColumn("shard", name)
    if rest is not None:
        again = rest.withColumn("first", F.lpad(F.bin("h"), HASH_BITS, "0")).withColumn("h", _bits(F.md5(F.col("rid").cast("string"))))
        more, _ = _directory(written(again, "hashes"), limit)
        out = out.unionByName(more.withColumn("shard", F.concat("first", F.lit("+"), name)).withColumn("depth", F.col("depth") + HASH_BITS).drop("first"))
    return out.select("rid", "doc_id", "shard", F.col("depth").cast("int"), "n_bytes", (F.col("n_bytes") > limit).alias("oversize"))


def write_shards(docs: DataFrame, path: str, limit: int = BYTE_LIMIT) -> str:
    """Write docs to path as Parquet, a folder for each shard, and return the name of the folders' column: "shard", or with underscores before it if docs has one.

    Each row goes to its own shard of shards(). A folder is named "s" and the bits, since bits alone would be read back as a number ("01" as "1"). All columns
    of docs stay as they are.
    """
    rid, folder, row = (free_name(docs, name) for name in ("row_number", "shard", "placed_row"))
    rows = written(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")  # the row numbers stay as they are
    at = _named(rows.select(F.col(rid).alias("_rid"), "doc_id", "text"), limit).select(F.col("rid").alias(row), F.concat(F.lit("s"), "shard").alias(folder))
    rows.join(at, F.col(rid) == F.col(row)).drop(rid, row).write.partitionBy(folder).parquet(path)
    forget(rows)
    return folder
