import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from recordloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, some in wanted.items():
        scores = []
        for (i, c), size in zip(counted, sizes):
            m = 100 - 50 + (50 * size * n // length if length else 0)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in some if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=str)


def zipf(rng, n):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(n))


@pytest.mark.parametrize("limits", [{}, {"accumulators": 0, "window": 7}, {"accumulators": 40, "window": 16, "shard_docs": 30}, {"accumulators": 10**9, "shard_postings": 50}, {"part_bytes": 300}])
def test_ranks_as_brute_force(spark, limits):
    rng = random.Random(11)
    docs = [(i, zipf(rng, rng.randint(0, 90))) for i in range(300)] + [(None, zipf(rng, 30)), (None, None), (7, zipf(rng, 20)), (301, "w1 " * 40000)]
    docs += [(1000 + i, "w2 w3 W399") for i in range(60)] + [docs[5]]
    items = [(i, zipf(rng, rng.randint(1, 25))) for i in range(20)] + [(20, None), (21, ""), (22, "nowhere"), (23, "w2-W3_w399"), (24, "w1"), (24, "w2 w350"), (None, "w9 w300")]
    rng.shuffle(docs)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    for top in (50, 3):
        got = lexical.search(d, b, top=top, **limits)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, top)


def test_terms_and_hard_texts(spark, messy, empty):
    some = "Ünïcödé ÉÀ x-1 a_b\x7fc 12:AZ[az] ½漢字"
    buf = np.frombuffer(some.encode(), np.uint8)
    assert len(lexical.terms(buf, np.array([0, len(buf)]))[0]) == len(terms(some)) == 11
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    items = [(1, "abc UM dois texto"), (2, docs[0][1]), (3, docs[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in lexical.search(messy, bench).collect()), key=str) == brute(docs, items)
    assert lexical.search(empty, bench).count() == 0
    assert lexical.search(messy, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_lists_that_cannot_matter_are_only_probed():
    items = lexical.Items([(0, "a b")])
    items.measured({-1: (10_000, 10_000), **{i: ((9_000, 0), (3, 0))[i] for i in (0, 1)}})
    rows = np.r_[np.arange(9000), [5, 6, 9500]]
    place = np.r_[np.zeros(9000, int), [1, 1, 1]]
    shard = lexical.Shard(items, np.arange(10_000), np.ones(10_000, np.int64), rows, place, np.ones(len(rows), np.int64))
    best = lexical.Best(2)
    shard.search(items.places[0], best, accumulators=0, window=100)
    assert best.doc.tolist() == [5, 6]
