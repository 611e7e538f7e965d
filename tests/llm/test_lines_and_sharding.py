from collections import Counter, defaultdict

from pyspark.sql import functions as F

from recordloom.llm import lines, sharding

from .conftest import SCHEMA, messy_rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s) + (None,) * 9 for i, t, s in rows], SCHEMA)


def test_lines_on_many_sites_go(spark):
    rows = [(i, f"common header line {'x' * 3}\nown line number {i}\n  common header line xxx\nshort", f"s{i % 6}") for i in range(12)]
    rows += [(100 + i, "seen on four sites only", f"s{i}") for i in range(4)] + [(200, None, None), (201, "", "s1")]
    out = {r.doc_id: r for r in lines.strip_lines(frame(spark, rows), min_sites=5).collect()}
    assert all(out[i].kept_text == f"own line number {i}\nshort" and out[i].n_removed == 2 for i in range(12))
    assert all(out[100 + i].n_removed == 0 for i in range(4))
    assert (out[200].n_lines, out[200].kept_text) == (1, "")


def test_lines_keep_columns_and_rows(messy, empty):
    out = lines.strip_lines(messy)
    assert out.columns == [*messy.columns, "n_lines", "n_removed", "kept_text"]
    assert out.count() == len(messy_rows())
    assert lines.strip_lines(empty).count() == 0


def test_shards_fit_and_only_oversized_buckets_split(messy, empty):
    got = sharding.shards(messy, limit=3000).collect()
    size, depth = Counter(), {}
    for r in got:
        size[r.shard] += r.n_bytes
        depth[r.shard] = r.depth
    assert len(got) == len(messy_rows())
    for r in got:
        assert size[r.shard] <= 3000 or (r.oversize and size[r.shard] == r.n_bytes)
    held = defaultdict(int)
    for r in got:
        if "+" not in r.shard:
            for d in range(len(r.shard)):
                held[r.shard[:d]] += r.n_bytes
    assert all(n > 3000 for n in held.values())
    assert sharding.shards(empty).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    got = sharding.shards(frame(spark, [(1, "x" * 100, "s")] * 40), limit=500).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.n_bytes
    assert max(size.values()) <= 500 and sum(size.values()) == 4000


def test_write_shards_keeps_all_rows(messy, tmp_path):
    sharding.write_shards(messy, str(tmp_path / "out"), limit=3000)
    assert messy.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(messy_rows())


def test_written_shards_of_a_hot_id_fit(spark, tmp_path):
    ids = [None] * 100 + [7] * 50 + list(range(100, 250))
    docs = spark.createDataFrame([(i, f"{n} ".ljust(100, "x")) for n, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    sharding.write_shards(docs, str(tmp_path / "out"), limit=1000)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted((r.doc_id or 0, r.text) for r in docs.collect())
    held = out.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n_bytes")).collect()
    assert max(r.n_bytes for r in held) <= 1000


def test_shards_are_read_back_under_their_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 100, i) for i in range(64)], "doc_id long, text string, shard int").withColumn("_rid", F.lit("kept"))
    folder = sharding.write_shards(docs, str(tmp_path / "out"), limit=700)
    out = spark.read.parquet(str(tmp_path / "out"))
    want = {r.doc_id: "s" + r.shard for r in sharding.shards(docs.drop("_rid"), limit=700).collect()}
    assert folder == "_shard" and len(set(want.values())) > 8
    assert {r.doc_id: (r["_shard"], r["shard"], r["_rid"]) for r in out.collect()} == {i: (s, i, "kept") for i, s in want.items()}
