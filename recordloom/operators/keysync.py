"""Finding the key that tables share, and synchronising them on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import join_key, plain


@dataclass(frozen=True)
class Source:
    """A table, its key column, the fields to bring along, and those of them that are amounts and add up."""

    name: str
    rows: DataFrame
    key: str
    fields: tuple[str, ...]
    amounts: tuple[str, ...] = ()
    order: str | None = None


def keys(sources: dict[str, Column], rows: dict[str, DataFrame]) -> DataFrame:
    """(source, k): the distinct normalised keys of each source."""
    out = None
    for name, c in sources.items():
        part = rows[name].select(F.lit(name).alias("source"), join_key(c).alias("k")).filter("k is not null").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def overlap(found: DataFrame) -> DataFrame:
    """(a, b, shared, share): for each pair of sources the keys in both, and their share of the smaller set."""
    size = found.groupBy("source").count()
    sides = found.groupBy("k").agg(F.array_sort(F.collect_set("source")).alias("s")).filter("size(s) > 1")  # a source is listed once a key
    pairs = sides.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    a, b = size.select(F.col("source").alias("a"), F.col("count").alias("na")), size.select(F.col("source").alias("b"), F.col("count").alias("nb"))
    every = F.broadcast(a).join(F.broadcast(b), F.col("a") < F.col("b"))  # a handful of sources
    return every.join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"), (F.coalesce("shared", F.lit(0)) / F.least("na", "nb")).alias("share"))


def collapsed(s: Source) -> DataFrame:
    """One row for each key of a source: amounts added up, the first value of other fields, the rows behind it."""
    order = F.col(s.order) if s.order else F.monotonically_increasing_id()
    rows = s.rows.withColumn("_k", join_key(F.col(s.key))).filter("_k is not null").withColumn("_o", order)
    first = lambda c: F.expr(f"min_by(`{c}`, _o) FILTER (WHERE `{c}` IS NOT NULL)")
    made = [F.coalesce(F.sum(f), F.lit(0)).alias(f) if f in s.amounts else first(f).alias(f) for f in s.fields]
    return rows.groupBy(F.col("_k").alias("k")).agg(F.expr(f"min_by(`{s.key}`, _o)").alias("shown"), F.count("*").alias("n"), *made)


def synchronised(sources: list[Source]) -> DataFrame:
    """All keys of all sources in one row each: shown key, sources, n_sources, and each field as field__source.

    The sources are stacked and aggregated by key, which takes one shuffle however many they are.
    """
    out = None
    for i, s in enumerate(sources):
        part = collapsed(s)
        part = part.select("k", F.lit(i).alias("i"), F.lit(s.name).alias("source"), F.col("shown").cast("string").alias("shown"), *(F.col(f).alias(f"{f}__{s.name}") for f in s.fields))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    fields = [c for c in out.columns if c not in ("k", "i", "source", "shown")]
    return out.groupBy("k").agg(
        F.min_by("shown", "i").alias("shown"),
        F.count("*").alias("n_sources"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "source"))), lambda x: x["source"]), ", ").alias("sources"),
        *(F.max(c).alias(c) for c in fields),
    )


def coverage(synced: DataFrame, names: list[str]) -> DataFrame:
    """(source, n_keys, pct, exclusive): how much of all keys each source has, and has alone."""
    has = F.array(*(F.struct(F.lit(n).alias("source"), F.array_contains(F.split("sources", ", "), n).alias("has")) for n in names))
    rows = synced.select("n_sources", F.explode(has).alias("h"))
    there = F.col("h.has")
    return rows.groupBy("h.source").agg(
        F.count_if(there).alias("n_keys"), F.round(100.0 * F.count_if(there) / F.count("*"), 1).alias("pct"), F.count_if(there & (F.col("n_sources") == 1)).alias("exclusive")
    )


def comparable(c: Column) -> Column:
    """A value as it is compared between sources: text without marks and case."""
    return F.upper(F.trim(plain(c.cast("string"))))


def divergences(synced: DataFrame, field: str, names: list[str]) -> DataFrame:
    """(k, field, values): keys whose field differs between sources; nulls are skipped."""
    held = F.array_compact(F.array(*(comparable(F.col(f"{field}__{n}")) for n in names)))
    return synced.withColumn("held", F.array_distinct(held)).filter("size(held) > 1").select("k", F.lit(field).alias("field"), F.array_join(F.array_sort("held"), " | ").alias("values"))
