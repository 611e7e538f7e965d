import random
from collections import defaultdict

import pytest

from recordloom.llm import ngram_join

from .conftest import SCHEMA, messy_rows, words


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, parent = defaultdict(set), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = [(i, shingles(t)) for i, t in rows if i is not None]
    for i, s in listed:
        for j, t in listed:
            k = len(s & t)
            if s and 100 * k >= 80 * (len(s) + len(t) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for i, s in listed:
        sets[i].add((len(s), root(i)))
    return sets


def test_near_groups_match_brute_force(messy, empty):
    got = ngram_join.near_groups(messy).collect()
    want = brute([(r[0], r[1]) for r in messy_rows()])
    assert len(got) == len(messy_rows())
    for r in got:
        assert (r.component_id is None) if r.doc_id is None else (r.n_shingles, r.component_id) in want[r.doc_id]
    assert ngram_join.near_groups(empty).count() == 0
    assert ngram_join.without_near_copies(messy).columns == messy.columns


@pytest.mark.parametrize("block", [512, 7])
def test_a_large_group_of_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(5)
    base, line = words(rng, 80).split(), words(rng, 12)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, line + " " + words(rng, rng.randint(3, 40))) for i in range(40)]
    rows += [(200 + i, " ".join(base[: 40 + i])) for i in range(20)]
    got = ngram_join.near_groups(spark.createDataFrame([(i, t) + (None,) * 11 for i, t in rows], SCHEMA)).collect()
    want = brute(rows)
    assert all((r.n_shingles, r.component_id) in want[r.doc_id] for r in got)


def test_rows_of_one_id_are_one_node_and_no_text_is_lost(spark):
    rng = random.Random(9)
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(0, a), (1, a + " x"), (1, b), (2, b + " y"), (3, c), (3, c), (4, words(rng, 30)), (4, None), (None, a), (5, b), (6, c + " z"), (6, words(rng, 9))]
    docs = spark.createDataFrame([(i, t) + (None,) * 11 for i, t in rows], SCHEMA)
    want = brute(rows)
    for r in ngram_join.near_groups(docs).collect():
        assert (r.component_id is None) if r.doc_id is None else (r.n_shingles, r.component_id) in want[r.doc_id]
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.without_near_copies(docs).collect()), key=str)
    assert kept == sorted([(0, a), (1, b), (3, c), (3, c), rows[6], rows[7], rows[8], rows[11]], key=str)


def test_every_text_has_a_near_copy_left(spark):
    rng = random.Random(12)
    bases = [words(rng, 30) for _ in range(12)]
    rows = []
    for _ in range(150):
        w = rng.choice(bases).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(30)] = "x" + words(rng, 1)
        rows.append((rng.randint(0, 60), " ".join(w)))
    docs = spark.createDataFrame([(i, t) + (None,) * 11 for i, t in rows], SCHEMA)
    want = brute(rows)
    assert all((r.n_shingles, r.component_id) in want[r.doc_id] for r in ngram_join.near_groups(docs).collect())
    kept = {(r.doc_id, r.text) for r in ngram_join.without_near_copies(docs).collect()}
    texts = dict(enumerate(sorted({t for _, t in rows})))
    parts = brute(texts.items())
    component = {t: next(iter(parts[k]))[1] for k, t in texts.items()}
    assert {component[t] for _, t in kept} == set(component.values())
    best = {}
    for i, t in rows:
        best[component[t]] = min(best.get(component[t], i), i)
    assert all(i == best[component[t]] for i, t in kept)
