"""Removal of boilerplate lines by their spread over sites.

Every line hash gets a HyperLogLog sketch of the sites that show it; Spark merges the sketches by aggregation. Estimates clearly over the
threshold decide at once; hashes near it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.tables import forget, free_name, small, written

#: Sites that make a line boilerplate, characters of the shortest line that is judged, and the size of a sketch. Shorter lines (brackets, bullets, "Yes")
#: recur by chance on any number of sites, so their spread tells nothing.
MIN_SITES, MIN_CHARS, LG_K = 5, 10, 12


def _hash(line: Column) -> Column:
    """128 bits of the trimmed line, so that no two lines of a corpus are taken for one."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line): hashes of lines (line, site) that occur on at least min_sites sites. Null sites count as one site; an empty table has none."""
    margin = max(1.0, 3 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg(F.coalesce("site", F.lit("")), F.lit(lg_k)).alias("sketch"))
    spread = written(sketched.select("line", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin), "spread")
    near = spread.filter(F.col("sites") <= min_sites + margin).select("line")
    exact = lines.join(small(near, 32), "line", "left_semi").select("line", F.coalesce("site", F.lit("")).alias("site")).distinct().groupBy("line").count().filter(F.col("count") >= min_sites).select("line")
    out = written(spread.filter(F.col("sites") > min_sites + margin).select("line").union(exact), "boilerplate")
    forget(spread)
    return out


def strip_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K) -> DataFrame:
    """docs with the new columns n_lines, n_removed and kept_text: lines whose trimmed form stands on min_sites or more sites are gone.

    The site is the column source. Lines of fewer than min_chars trimmed characters always stay. Null text counts as empty (one empty line), null
    sources are one site; repeated rows and repeated or null ids are treated alike, each row by its own text; an empty table gives an empty result.
    Columns of docs that have the name of a new one are replaced; all others stay, whatever their names.
    """
    long_enough = lambda x: F.char_length(F.trim(x)) >= min_chars
    row = lambda: F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    site = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site")
    lines = docs.select(row().alias("row"), site, F.posexplode(_split(F.col("text"))).alias("pos", "line")).filter(long_enough(F.col("line")))
    lines = written(lines.select("row", "pos", "site", _hash(F.col("line")).alias("line")), "lines")
    common = boilerplate(lines.select("line", "site"), min_sites, lg_k)
    spots = lines.join(small(common, 32), "line", "left_semi").groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("spots"))
    # A flag for each line up to the last one that goes: the gaps between the places, unrolled, so that the work grows with the lines alone.
    before = lambda i: F.when(i == 0, -1).otherwise(F.get("spots", i - 1))
    flags = F.flatten(F.transform("spots", lambda s, i: F.concat(F.array_repeat(F.lit(False), s - before(i) - 1), F.array(F.lit(True)))))
    new = ["n_lines", "n_removed", "kept_text"]
    old = [c for c in docs.columns if c.lower() not in new]
    key, found, gone = (free_name(docs, name) for name in ("row_key", "row_found", "row_flags"))
    spots = spots.select(F.col("row").alias(found), flags.alias(gone))
    rows = docs.withColumn(key, row()).join(spots, F.col(key).eqNullSafe(F.col(found)), "left")
    parts = _split(F.col("text"))
    kept = F.filter(F.zip_with(parts, F.col(gone), lambda line, flag: F.when(~F.coalesce(flag, F.lit(False)), line)), lambda line: line.isNotNull())
    return rows.select(
        *[F.col(f"`{c}`") for c in old],
        F.size(parts).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.filter(F.col(gone), lambda flag: flag))).cast("long").alias("n_removed"),
        F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
