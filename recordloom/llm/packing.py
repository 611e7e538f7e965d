"""Sequence packing by optimal length buckets.

A histogram of all piece lengths goes to a dynamic program that sets the bucket boundaries with the least padding. Inside a bucket, pieces are
dealt to shards and numbered, and every `token_budget // boundary` of them form a batch that fits the budget when padded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.tables import written

MAX_LEN, N_BUCKETS, TOKEN_BUDGET, PIECES_PER_SHARD = 2048, 8, 16384, 8192
WORD = r"[^\x20\x09-\x0D]+"


def boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Upper ends of at most n_buckets ranges that cover the sorted lengths with the least total padding; ties go to the earlier cut."""
    size, count = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    m = len(size)
    if not m:
        return []
    many, tokens = np.r_[0, count.cumsum()], np.r_[0, (size * count).cumsum()]
    cost = np.where(np.arange(m + 1) == 0, 0.0, np.inf)  # of the first j lengths, without a bucket
    cuts = []
    for _ in range(min(n_buckets, m)):
        after, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        after[0] = 0
        for j in range(1, m + 1):
            pad = cost[:j] + size[j - 1] * (many[j] - many[:j]) - (tokens[j] - tokens[:j])
            cut[j] = pad.argmin()
            after[j] = pad[cut[j]]
        cost = after
        cuts.append(cut)
    ends, j = [], m
    for cut in reversed(cuts):
        if j:
            ends.append(int(size[j - 1]))
            j = int(cut[j])
    return ends[::-1]


def _looked_up(bucket: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), bucket + 1)


def pack(docs: DataFrame, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """One row for each piece: doc_id, piece, start_token, n_tokens, bucket, bucket_len, shard, batch, slot.

    A token is a word; a text of more than max_len of them is cut into pieces of max_len and a rest, so nothing is lost. bucket, shard and batch
    name a batch together. A null or wordless text gives one piece of no tokens, in no batch (bucket -1, the rest null). Repeated rows are packed as often
    as they occur. An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < max_len <= token_budget:
        raise ValueError("max_len must be positive and fit the token budget")
    sized = written(docs.select(F.col("doc_id").cast("long"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("n")), "sizes")
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - 1) / max_len), F.lit(0)).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * max_len).alias("start_token"), F.least(F.lit(max_len), F.col("n") - F.col("piece") * max_len).alias("n_tokens"))
    histogram = pieces.filter("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").collect()  # max_len rows at most
    lengths, counts = [r.n_tokens for r in histogram], [r["count"] for r in histogram]
    ends = boundaries(lengths, counts, n_buckets) or [max_len]
    held = [sum(c for n, c in zip(lengths, counts) if low < n <= end) for low, end in zip([0, *ends], ends)]
    shards = [max(1, -(-c // pieces_per_shard)) for c in held]
    bucket = F.when(F.col("n_tokens") > 0, sum(F.when(F.col("n_tokens") > e, 1).otherwise(0) for e in ends)).otherwise(-1)
    pieces = pieces.withColumn("bucket", bucket.cast("int"))
    real = F.col("bucket") >= 0
    pieces = pieces.withColumn("shard", F.when(real, F.pmod(F.xxhash64("doc_id", "piece"), _looked_up(F.col("bucket"), shards))).cast("int"))
    # Pieces without tokens are spread over the shards too, so that they don't meet in one task.
    spread = F.coalesce("shard", F.pmod(F.xxhash64("doc_id"), F.lit(4096)).cast("int"))
    order = F.row_number().over(Window.partitionBy("bucket", spread).orderBy("n_tokens", "doc_id", "piece")) - 1
    fits = _looked_up(F.col("bucket"), [token_budget // e for e in ends])
    return pieces.select(
        "doc_id",
        "piece",
        "start_token",
        "n_tokens",
        "bucket",
        F.when(real, _looked_up(F.col("bucket"), ends)).alias("bucket_len"),
        "shard",
        F.when(real, F.floor(order / fits)).cast("long").alias("batch"),
        F.when(real, order % fits).cast("int").alias("slot"),
    )
