import hashlib
import random
import time
from collections import Counter

import pyarrow as pa
import pytest

from recordloom.llm import suffix

from .conftest import messy_rows, words


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length,gram,hot,passage", [(60, 20, 2000, None), (60, 20, 0, None), (60, 20, 0, 40), (60, 20, 1, 24), (400, 128, 2000, None), (400, 128, 2000, 240)])
def test_strip_repeats_matches_brute_force(messy, length, gram, hot, passage):
    rows = [r for r in messy_rows() if r[1] is None or len(r[1]) < 20000 or length == 400]
    docs = messy if length == 400 else messy.filter("text is null or length(text) < 20000")
    got = suffix.strip_repeats(docs, length, gram, hot, passage).collect()
    want = Counter((r[0], *w) for r, w in zip(rows, brute([(r[1] or "").encode() for r in rows], length)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("hot", [2000, 3, 0])
def test_passages_shorter_than_a_string_are_reported(spark, hot):
    rng = random.Random(8)
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(55))  # 274 bytes
    rows = [(i, words(rng, 40) + " " + passage + " " + words(rng, 60)) for i in range(30)]
    rows += [(100 + i, words(rng, 300)) for i in range(10)] + [(200, rows[0][1]), (300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in suffix.strip_repeats(docs, hot_classes=hot, passage=240).collect()}
    for i, text in rows[1:30]:
        (found,) = out[i].passages
        held = text.encode()[found.s : found.e].decode()
        assert passage in held and len(held) < len(passage) + 8 and out[i].n_removed == 0
    assert all(out[100 + i].passages == [] for i in range(10))
    assert out[0].n_removed == len(rows[0][1]) and out[300].n_bytes == 0


def test_empty(empty):
    assert suffix.strip_repeats(empty).count() == 0


def test_suffix_arrays_are_sorted_and_find_repeats():
    rng = random.Random(5)
    for _ in range(60):
        length = rng.choice([8, 12, 30])
        letters = rng.choice([b"ab", b"abc", b"\0a", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(200))
        segments, starts, many = [], [], []
        for _ in range(rng.randint(1, 8)):
            size = rng.randint(1, 40) + length - 1
            at = rng.randint(0, 200 - size)
            segments.append(base[at : at + size] if rng.random() < 0.6 else bytes(rng.choice(letters) for _ in range(size)))
            starts.append(size - length + 1)
            many.append(rng.choice([1, 1, 2]))
        t = suffix._Text(segments, starts)
        order = suffix.suffix_array(t)
        found = [bytes(t.bytes[p : t.end[t.owner[p]]]) for p in order]
        assert found == sorted(found) and len(set(order.tolist())) == sum(starts)
        seen = Counter()
        for s, n, m in zip(segments, starts, many):
            for i in range(n):
                seen[s[i : i + length]] += m
        for s, n, ranges in zip(segments, starts, suffix.repeated_starts(segments, starts, many, length)):
            assert all(whole for _, _, whole in ranges)
            assert {i for a, b, _ in ranges for i in range(a, b)} == {i for i in range(n) if seen[s[i : i + length]] > 1}


def test_order_of_the_first_bytes_alone():
    """The operator sorts no further than its strings reach: suffixes that share `most` bytes stand together."""
    rng = random.Random(6)
    for _ in range(40):
        most, letters = rng.choice([7, 8, 20]), rng.choice([b"a", b"ab", b"\0a"])
        base = bytes(rng.choice(letters) for _ in range(300))
        segments = [base[(at := rng.randint(0, 200)) : at + rng.randint(most, 100)] for _ in range(rng.randint(1, 8))]
        t = suffix._Text(segments, [len(s) - most + 1 for s in segments])
        order = suffix.suffix_array(t, most).tolist()
        found = [bytes(t.bytes[p : min(t.end[t.owner[p]], p + most)]) for p in order]
        assert found == sorted(found) and len(set(order)) == sum(len(s) - most + 1 for s in segments)


def test_ranges_are_not_made_into_objects():
    """Stripping 400 texts of 500 ranges each, and cutting them, takes less CPU time than making the ranges into Python objects would alone."""
    ranges = [[{"s": 20 * i, "e": 20 * i + 15, "whole": bool(i % 2)} for i in range(500)]] * 400
    parts = [[{"start": 20 * i, "n": 5, "anchor": i, "digest": i, "many": 2} for i in range(500)]] * 400
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("whole", pa.bool_())]))
    piece = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("digest", pa.int64()), ("many", pa.int64())]))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400), pa.int64()), "text": ["x" * 10000] * 400, "spans": pa.array(ranges, kind), "parts": pa.array(parts, piece)})

    def seconds(run):
        times = []
        for _ in range(3):
            began = time.process_time()
            out = run()
            times.append(time.process_time() - began)
        return min(times), out

    plain, _ = seconds(batch["spans"].to_pylist)
    took, (out,) = seconds(lambda: list(suffix._strip_rows(iter([batch]))))
    assert took < plain and set(out["n_removed"].to_pylist()) == {15 * 250} and set(out["n_spans"].to_pylist()) == {250}
    plain, _ = seconds(batch["parts"].to_pylist)
    took, out = seconds(lambda: list(suffix._cut_rows(10)(iter([batch]))))
    assert took < plain and sum(b.num_rows for b in out) == 200000 and {len(x) for b in out for x in b["text"].to_pylist()} == {14}
