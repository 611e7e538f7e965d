"""Exact duplicates by deterministic block naming.

Each text, lower-cased in A-Z only, is cut into blocks of a fixed number of bytes. Blocks are sorted and replaced by integer names, then adjacent
names are paired and the pairs named in the same way, level by level, until each document has one name. Names are ranks in a sorted bucket, so two
texts get one identity exactly if they are equal: no hash decides.

Each task first gathers its own repeats of a block. A block that still comes in many gathered rows is hot: only its distinct bytes are named, apart from
the others, and the bounded list of hot names is joined back, so that the places of a block that a third of all rows hold never meet in one bucket.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.tables import forget, free_name, pick, written

#: Bytes in a block, and documents for each naming bucket (with at least MIN_BUCKETS).
BLOCK_BYTES = 1024
DOCS_PER_BUCKET = 2000
MIN_BUCKETS = 1024
#: Hot blocks, at most: those in more than this part of all gathered rows, and in HOT_ROWS of them at least.
HOT_BLOCKS, HOT_ROWS = 8192, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PLACES = "array<struct<rid:bigint,pos:int>>"


def _block_rows(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ids = batch["rid"].to_pylist(), batch["doc_id"].to_pylist()
            texts = batch["text"].cast(pa.binary()).to_pylist()
            blocks: dict[bytes, list] = defaultdict(list)
            shas, sizes = [], []
            for rid, text in zip(rids, texts):
                low = (text or b"").lower()  # bytes: A-Z only
                shas.append(hashlib.sha256(low).digest())
                sizes.append(len(low))
                for pos, at in enumerate(range(0, len(low), block_bytes)):
                    blocks[low[at : at + block_bytes]].append({"rid": rid, "pos": pos})
            n, m = len(blocks), len(rids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*blocks, *[None] * m], pa.binary()),
                    pa.array([*blocks.values(), *([{"rid": r, "pos": -1}] for r in rids)], pa.list_(pa.struct([("rid", pa.int64()), ("pos", pa.int32())]))),
                    pa.array([None] * n + ids, pa.int64()),
                    pa.array([None] * n + sizes, pa.int64()),
                    pa.array([None] * n + shas, pa.binary()),
                ],
                ["block", "places", "doc_id", "n_bytes", "sha"],
            )

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs: dict[tuple[int, int], list] = defaultdict(list)
        for rid, names in zip(batch["rid"].to_pylist(), batch["names"].to_pylist()):
            for pos in range(0, len(names), 2):
                pairs[names[pos], names[pos + 1] if pos + 1 < len(names) else -1].append({"rid": rid, "pos": pos // 2})
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a for a, _ in pairs], pa.int64()),
                pa.array([b for _, b in pairs], pa.int64()),
                pa.array(list(pairs.values()), pa.list_(pa.struct([("rid", pa.int64()), ("pos", pa.int32())]))),
            ],
            ["a", "b", "places"],
        )


def _named(rows: DataFrame, keys: list[str], spread: Column, buckets: int) -> DataFrame:
    """rows with a name: equal keys, and they only, share one. Keys are dealt to buckets and ranked in each; hot ones are ranked apart.

    rows is a stored table. Rows whose keys are null belong to no block; their name has no meaning.
    """
    mark = F.xxhash64(*keys)
    seen = rows.filter(F.col(keys[0]).isNotNull()).groupBy(mark.alias("mark")).agg(F.count("*").alias("many"))
    total = rows.count()
    hot = seen.filter(F.col("many") > max(HOT_ROWS, total // HOT_BLOCKS)).select("mark")  # HOT_BLOCKS rows at most
    hot = written(rows.join(F.broadcast(hot), mark == F.col("mark"), "left_semi").select(*keys).distinct(), "hot")
    listed = hot.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.lit(buckets) + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys))).alias("_hot"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    rows = rows.join(F.broadcast(listed), same, "left").withColumn("bucket", F.pmod(spread, F.lit(buckets)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys))
    usual = rows.filter("_hot is null").withColumn("name", F.shiftleft("bucket", 32) + rank)
    return usual.unionByName(rows.filter("_hot is not null").withColumn("name", F.shiftleft("_hot", 32))).drop("_hot", *(f"_{k}" for k in keys))


def _in_order(named: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(named)), lambda x: x["name"])


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, doc_id, n_bytes, sha, name) for each row of docs: rows of equal normalised text, and they only, share (n_bytes, name).

    docs has doc_id and text and is a stored table. Null text counts as empty; an empty text has name -1. Other columns are ignored.
    """
    buckets = max(MIN_BUCKETS, docs.count() // DOCS_PER_BUCKET)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text").mapInArrow(
        _block_rows(block_bytes), f"block binary, places {PLACES}, doc_id long, n_bytes long, sha binary"
    )
    spread = F.when(F.col("block").isNotNull(), F.xxhash64("block")).otherwise(F.xxhash64(F.col("places")[0]["rid"]))
    rows = written(rows, "blocks")
    placed = _named(rows, ["block"], spread, buckets).select(F.explode("places").alias("at"), "name", "doc_id", "n_bytes", "sha")
    spot = F.when(F.col("at.pos") >= 0, F.struct(F.col("at.pos").alias("pos"), "name"))
    base = written(
        placed.groupBy(F.col("at.rid").alias("rid")).agg(
            F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.max("sha").alias("sha"), _in_order(spot).alias("names")
        ),
        "names",
    )
    forget(rows)
    done = [base.filter("size(names) <= 1").select("rid", F.coalesce(F.get("names", F.lit(0)), F.lit(-1)).alias("name"))]
    level, before = base.filter("size(names) > 1").select("rid", "names"), None
    while not level.isEmpty():
        pairs = written(level.mapInArrow(_pair_rows, f"a long, b long, places {PLACES}"), "pairs")
        placed = _named(pairs, ["a", "b"], F.xxhash64("a", "b"), buckets).select(F.explode("places").alias("at"), "name")
        after = written(placed.groupBy(F.col("at.rid").alias("rid")).agg(_in_order(F.struct(F.col("at.pos").alias("pos"), "name")).alias("names")), "names")
        forget(pairs)
        done.append(after.filter("size(names) = 1").select("rid", F.col("names")[0].alias("name")))
        level, before = after.filter("size(names) > 1"), after
    found = done[0]
    for part in done[1:]:
        found = found.union(part)
    out = written(base.join(found, "rid").select("rid", "doc_id", "n_bytes", "sha", "name"), "identity")
    forget(base)
    if before is not None:
        forget(before)
    return out


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts (A-Z lower-cased; null as empty) the one with the largest doc_id stays; null ids come before all others, and of
    repeated rows with that id exactly one is kept. An empty table gives an empty result; other columns of docs are ignored.
    """
    rows = identities(docs, block_bytes)
    groups = rows.groupBy("n_bytes", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size"))
    groups = written(groups.filter("group_size > 1").select("n_bytes", "name", "keep", "group_size"), "groups")
    alone = F.col("group_size").isNull()
    return rows.join(groups, ["n_bytes", "name"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep.rid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest doc_id; the columns stay as they are, whatever their names.

    Null counts as empty text; of repeated rows one stays; null ids come before all others; an empty table stays empty.
    """
    found = written(exact_groups(docs, block_bytes), "exact")
    ids = found.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    if ids.n == ids.ids:
        return pick(docs, found.filter("not kept"), "doc_id", keep=False)
    # Repeated or null ids: rows are told apart by their text too.
    key, copy = ([free_name(docs, f"{name}_{part}") for part in ("id", "sha")] for name in ("row", "kept"))
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), 256)
    kept = found.filter("kept").select(F.col("doc_id").alias(copy[0]), F.col("text_sha256").alias(copy[1])).distinct()
    rows = docs.withColumns({key[0]: F.col("doc_id").cast("long"), key[1]: sha})
    rows = rows.join(kept, F.col(key[0]).eqNullSafe(F.col(copy[0])) & (F.col(key[1]) == F.col(copy[1])), "left_semi")
    return rows.dropDuplicates(key).select(*(F.col(f"`{c}`") for c in docs.columns))
