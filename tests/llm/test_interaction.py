import itertools
import random
import re

import pytest

from recordloom.llm import interaction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def masks(docs):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, part in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])
        yield i, part or "", sum(1 << k for k, f in enumerate(fails) if f)


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, parts = [], {}
    for i, part, mask in masks(docs):
        parts.setdefault(part, []).append((i, mask))
    for part, rows in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        own = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone, left = [r for r in left if r[1] & bit], [r for r in left if not r[1] & bit]
                removed_by[name] += len(gone)
                fail = sum(1 for r in rows if r[1] & bit)
                own.append([part, order, step, len(left), len(gone), fail - len(gone), sum(r[1] == bit for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), name])
        out += [(*r[:-1], removed_by[r[-1]]) for r in own]
    return sorted(out)


def test_audit_as_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["um", "dois", "TRES", "x#", "quatro", f"n{rng.randint(0, 500)}", f"m{rng.randint(0, 500)}"])
    docs = [(i, " ".join(word() for _ in range(rng.choice([3, 40, 60, 90]))), rng.choice(["a", "b", None, ""])) for i in range(150)]
    docs += [(200 + i, docs[i % 20][1], rng.choice(["a", "b"])) for i in range(60)] + [(300, None, "a"), (301, "", "b"), (302, " \t\x0b ", None), (None, docs[0][1], "a"), (None, None, "a"), (3, docs[4][1], "b")]
    docs += [docs[0], docs[170], (400, "Único É texto " * 20, "c"), (401, "a\x85b c " * 30, "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumnRenamed("nothing", "part").repartition(3)
    counts = interaction.masks(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = interaction.audit(counts, "ABCDE")
    assert got.columns == list(interaction.COLUMNS)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, labels)


def test_hard_tables(spark, messy, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in messy.collect()]
    assert sorted(tuple(r) for r in interaction.audit(interaction.masks(messy, labels), "ABCDE").collect()) == brute(docs, [])
    assert interaction.audit(interaction.masks(empty, labels), "ABCDE").count() == 0
    with pytest.raises(ValueError):
        interaction.audit(interaction.masks(empty, labels), "AAB")


@pytest.mark.parametrize("n", range(1, 7))
def test_adjacent_swaps_visit_every_order_once(n):
    names = "ABCDEF"[:n]
    seen = ["".join(names)]
    for level in interaction.swaps(n):
        x = list(seen[-1])
        x[level], x[level + 1] = x[level + 1], x[level]
        seen.append("".join(x))
    assert sorted(seen) == sorted("".join(p) for p in itertools.permutations(names))


def test_equal_subgraphs_are_one():
    counts = {m: (1, 0, 0) for m in range(32)}
    diagram = interaction.Diagram("ABCDE", counts, 3)
    assert len(diagram.weight) == 6  # a node for each level, and the leaf
