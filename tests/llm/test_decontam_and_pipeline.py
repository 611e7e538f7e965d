import random

import corpus_pipeline
import numpy as np

from recordloom.llm import decontam, queries
from recordloom.llm.words import shingle_numbers, word_numbers

from .conftest import SCHEMA, messy_rows, words


def test_leaks_are_found_and_clean_rows_stay(spark, messy, empty, monkeypatch):
    rng = random.Random(9)
    items = [(i, words(rng, n)) for i, n in enumerate((3, 5, 12, 30, 55, 200))] + [(None, None), (50, ""), (51, "  ")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, words(rng, 40) + "\n" + t.upper() + "\t" + words(rng, 20)) for i, t in items[:6]]
    edited = items[5][1].split()
    edited[100] = "zzz"
    rows += [(20, " ".join(edited)), (21, words(rng, 300)), (22, items[3][1][:40])]
    docs = spark.createDataFrame([(*r, None, None) + (None,) * 9 for r in rows], SCHEMA)
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, benchmark).collect()}
    assert set(got) == {(i, i) for i in range(6)} | {(20, 5)}
    for i, t in items[:6]:
        assert got[i, i].similarity == 1.0
        assert dict(rows)[i].encode()[got[i, i].start : got[i, i].end].decode().lower() == t
    assert 0.8 <= got[20, 5].similarity < 1
    kept = decontam.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {21, 22}
    monkeypatch.setattr(decontam.indexes, "__defaults__", (2, 100))
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()} == set(got)
    assert decontam.leaks(messy, benchmark).count() == 0
    assert decontam.without_leaks(messy, benchmark).count() == len(messy_rows())
    assert decontam.leaks(empty, benchmark).count() == 0
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0


def test_near_fingerprints_are_all_found():
    rng = random.Random(1)
    index = decontam.Index([(i, words(rng, 20)) for i in range(50)])
    held = index.by_length[20]
    for _ in range(200):
        item = rng.choice(held)
        fingerprint = item[3]
        for bit in rng.sample(range(64), decontam.RADIUS):
            fingerprint ^= 1 << bit
        assert item[0] in {i[0] for i in index.near(20, fingerprint)}


def test_documents_shorter_than_an_item_are_judged(spark):
    rng = random.Random(11)
    items = [(i, words(rng, 55)) for i in range(20)] + [(20, words(rng, 400))]
    rows = []
    for i, text in items:
        w = text.split()
        rows.append((i, " ".join(w[: len(w) * 10 // 11])))  # cut at the end
        rows.append((100 + i, " ".join(w[:20] + w[21:])))  # without one word
        rows.append((200 + i, " ".join(w[: len(w) // 2])))  # far below the similarity
    docs = spark.createDataFrame([(*r, None, None) + (None,) * 9 for r in rows], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.leaks(docs, benchmark).collect()}
    assert {(d, r.item_id) for d, r in got.items()} == {(i + at, i) for i, _ in items for at in (0, 100)}
    assert all(0.8 <= r.similarity < 1 and (r.start, r.end) == (0, len(dict(rows)[d])) for d, r in got.items())
    assert abs(got[0].similarity - 46 / 51) < 0.02 and abs(got[100].similarity - 46 / 55) < 0.02
    assert {r.doc_id for r in decontam.without_leaks(docs, benchmark).collect()} == {200 + i for i, _ in items}


def test_windows_at_the_threshold_are_found():
    rng = random.Random(12)
    items = [(i, words(rng, 55)) for i in range(300)]
    index = decontam.Index(items)
    far = 0
    for i, text in items:
        w = text.split()
        w[rng.randrange(8, 45)] = "zzzz"  # five of 51 shingles: 46 of 56
        numbers = word_numbers(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w))]))[0]
        shingles = shingle_numbers(numbers)
        print_ = int(decontam._packed((index.weigh(shingles)[:, None] * decontam._signs(shingles)).sum(axis=0)[None])[0])
        far += (print_ ^ index.by_length[55][i][3]).bit_count() > 15
        assert i in index.search(numbers)
    assert far  # fingerprints beyond 15 bits are among them


def test_pipeline_runs_over_messy_rows(spark, messy, tmp_path):
    messy.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == messy.columns, name
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))  # thirteen since the last three were added
