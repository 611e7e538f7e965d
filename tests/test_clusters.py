import random

import pytest

from recordloom.operators import cluster

NODES, LINKS = "rid long, source string, id string, cpf string, cpf_ok boolean", "phase int, ord long, a long, b long"


def plain(nodes, links):
    held = {r: ({s: i} if i is not None else {}, {c} if ok else set(), {r}) for r, s, i, c, ok in nodes}
    at, refused = {r: r for r in held}, {}
    for phase, _, a, b in sorted(links):
        x, y = sorted((at[a], at[b]))
        if x == y:
            continue
        (ix, cx, mx), (iy, cy, my) = held[x], held[y]
        if any(iy.get(s, i) != i for s, i in ix.items()):
            refused[a, b] = cluster.IDS
        elif phase == 5 and cx and cy and not cx & cy:
            refused[a, b] = cluster.CPFS
        else:
            held[x] = (ix | iy, cx | cy, mx | my)
            at |= dict.fromkeys(mx | my, x)
    return at, refused


def cases(seed, n):
    """Many components at once: stars, chains and random links over nodes with few ids, sources and CPFs."""
    rng = random.Random(seed)
    nodes, links = [], []
    for c in range(n):
        at, size = c * 1000, rng.randint(2, 14)
        ids, sources, cpfs = rng.randint(1, 4), rng.randint(1, 4), rng.randint(1, 6)
        for i in range(size):
            nodes.append((at + i, f"s{rng.randint(1, sources)}", str(rng.randint(1, ids)) if rng.random() < 0.6 else None, f"c{rng.randint(1, cpfs)}", rng.random() < 0.5))
        kind = c % 3
        pairs = [(0, i) for i in range(1, size)] if kind == 0 else [(i, i + 1) for i in range(size - 1)] if kind == 1 else []
        pairs += [tuple(sorted(rng.sample(range(size), 2))) for _ in range(rng.randint(0, 3 * size))]
        rng.shuffle(pairs)
        links += [(rng.randint(3, 5), i if kind == 2 else at + b, at + a, at + b) for i, (a, b) in enumerate(dict.fromkeys(pairs))]
    return nodes, links


@pytest.mark.parametrize("finish", [0, 40, 10**6])
def test_rounds_give_what_one_after_the_other_gives(spark, finish):
    nodes, links = cases(finish + 1, 240)
    found, refused = cluster.constrained(spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS), finish)
    at, blocked = plain(nodes, links)
    assert {r.rid: r.cluster for r in found.collect()} == at
    assert {(r.a, r.b): r.reason for r in refused.collect()} == blocked


def test_a_key_of_all_records_takes_few_rounds(spark, monkeypatch):
    """3000 records of one name and one address: with ids of their own, with CPFs of their own, and with neither."""
    rounds = []
    monkeypatch.setattr(cluster, "_decided", lambda j, real=cluster._decided: rounds.append(1) or real(j))
    nodes = [(i, f"s{i % 2}", str(i) if i % 3 == 0 else None, f"c{i}", i % 3 == 1) for i in range(3000)]
    links = [(p, i, 0, i) for p in (4, 5) for i in range(1, 3000) if p == 5 or i % 5 == 0]
    found, refused = cluster.constrained(spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS), 0)
    at, blocked = plain(nodes, links)
    assert {r.rid: r.cluster for r in found.collect()} == at
    assert {(r.a, r.b): r.reason for r in refused.collect()} == blocked
    assert len(rounds) <= 12


def test_empty_tables(spark):
    nodes = spark.createDataFrame([(1, "a", None, None, False)], NODES)
    found, refused = cluster.constrained(nodes, spark.createDataFrame([], LINKS))
    assert [tuple(r) for r in found.collect()] == [(1, 1)] and refused.count() == 0
    found, refused = cluster.constrained(spark.createDataFrame([], NODES), spark.createDataFrame([], LINKS), 0)
    assert found.count() == 0 and refused.count() == 0
