"""Inputs beyond what a bound, a collision or a hot key would have spoilt, and brute-force twins."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import decontam, exact, langid, lines, ngram_join, secret_scan, toxicity

from .conftest import SCHEMA, messy_rows, words


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_mirrored_words_are_different_sets(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = frame(spark, [(1, a, None, None), (2, b, None, None), (3, f"{a} one two three four", None, None), (4, f"{b} one two three four", None, None), (5, a.upper(), None, None)])
    assert {r.doc_id: r.component_id for r in ngram_join.near_groups(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    benchmark = spark.createDataFrame([(7, a)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.leaks(docs, benchmark).collect()) == [1, 3, 5]


def test_small_sets_link_as_brute_force_says(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 9))), None, None) for i in range(150)]
    sets = {}
    for i, text, *_ in rows:
        w = text.split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    least = {i: i for i in sets}
    for _ in range(10):
        for i, s in sets.items():
            for j, t in sets.items():
                if s and 100 * len(s & t) >= 80 * len(s | t):
                    least[i] = min(least[i], least[j])
    got = ngram_join.near_groups(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), least[i]) for i in sets}


@pytest.mark.parametrize("languages", [2, 4, 140])
def test_every_language_is_learned(spark, languages):
    rng = random.Random(6)
    letters = [[chr(0x4E00 + 12 * k + j) for j in range(12)] for k in range(languages)]
    make = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(n))
    rows = [(i, make(i % languages, 12), f"l{i % languages}", None) for i in range(30 * languages)] + [(-1, "1234", None, None), (-2, None, None, None)]
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in langid.identify(docs, dims=1 << 13).collect()}
    held = [i for i in out if out[i].held_out and i >= 0]
    assert np.mean([out[i].lang_pred == f"l{i % languages}" for i in held]) > 0.9
    assert {r.lang_pred for r in out.values()} == {f"l{k}" for k in range(languages)} | {"und"}
    assert {r.doc_id for r in langid.understood(docs, dims=1 << 13).collect()} >= {i for i in out if i >= 0}
    assert not {r.doc_id for r in langid.understood(docs, dims=1 << 13).collect()} & {-1, -2}


def test_nothing_labelled_passes_through(spark, tmp_path, empty):
    rows = [(i, f"{words(random.Random(i), 30)}", None, None) for i in range(20)] + [(90, None, None, None), (91, " 12 ", None, None)]
    docs = frame(spark, rows)
    assert sorted(r.doc_id for r in langid.understood(docs).collect()) == list(range(20))
    frame(spark, rows).write.parquet(str(tmp_path / "some/documents.parquet"))
    empty.write.parquet(str(tmp_path / "none/documents.parquet"))
    for name, many in (("some", 20), ("none", 0)):
        spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / f"{name}/benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == many


def clashing(spark):
    rng = random.Random(3)
    rows = [(i % 9 or None, f"a header line that is common\nown line {rng.random()}\n" + "x" * 1500, f"s{i % 7}", i, i, i, i, i) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, _gone long, row_key long, `row.sha` long, n_lines long")


def test_columns_of_internal_names_stay(spark):
    docs = clashing(spark)
    out = lines.strip_lines(docs)
    assert out.columns == [*docs.columns[:-1], "n_lines", "n_removed", "kept_text"]
    assert all(r.n_removed == 2 and r.kept_text.startswith("own line") and r._id == r._gone == r.row_key for r in out.collect())
    kept = exact.without_copies(docs.unionAll(docs))
    assert kept.columns == docs.columns and kept.count() == 30


def test_lines_of_a_long_text_go_in_linear_time(spark):
    body = "\n".join(f"this is line number {i % 5000} of the text" for i in range(60000))
    docs = frame(spark, [(i, body, None, f"s{i}") for i in range(5)] + [(9, body + "\nlast of its kind", None, "s0")])
    out = {r.doc_id: r for r in lines.strip_lines(docs).collect()}
    assert (out[0].n_lines, out[0].n_removed, out[0].kept_text) == (60000, 60000, "")
    assert (out[9].n_removed, out[9].kept_text) == (60000, "last of its kind")


@pytest.mark.parametrize("rows,blocks", [(1, 4), (32, 8192)])
def test_hot_blocks_keep_their_names(messy, monkeypatch, rows, blocks):
    monkeypatch.setattr(exact, "HOT_ROWS", rows)
    monkeypatch.setattr(exact, "HOT_BLOCKS", blocks)
    groups = defaultdict(list)
    for r in messy_rows():
        groups[hashlib.sha256((r[1] or "").encode().lower()).hexdigest()].append(r[0])
    for r in exact.exact_groups(messy.repartition(40), 16).collect():
        assert r.group_size == len(groups[r.text_sha256])


def weighted(items):
    """Shingles of words with their weights: brute force, on the words themselves."""
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in items]
    df = Counter(s for one in sets for s in one)
    return lambda s: round(1024 * (1 + math.log((1 + len(items)) / (1 + df.get(s, 0)))))


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(14)
    items = [words(rng, rng.choice([20, 40, 80])) for _ in range(60)]
    weight, docs = weighted(items), []
    for i, text in enumerate(items * 4):
        w = text.split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["zzz"], ["zzz", "yyy"]])
        docs.append((i, " ".join(words(rng, rng.randint(0, 30)).split() + w + words(rng, 20).split())))
    want = {}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in items]
    for i, text in docs:
        w = text.split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for j, item in enumerate(sets):
            m = min(len(items[j].split()) - 4, len(grams))
            for s in range(len(grams) - m + 1):
                window = set(grams[s : s + m])
                both = sum(map(weight, window & item))
                value = both / sum(map(weight, window | item))
                if both and value >= 0.8:
                    want[i, j] = max(value, want.get((i, j), 0))
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(frame_, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    near = [k for k, v in want.items() if v < 0.9]
    assert len(near) > 20 and len(got) >= 0.99 * len(want) and sum(k in got for k in near) >= 0.95 * len(near)


def test_base_spans_match_a_plain_reading():
    rng = random.Random(5)
    assign = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    pieces = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "x", "\n", "ſecret"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        want = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        assert sorted(secret_scan.base_spans(text)) == sorted(want)
        runs = [m.span() for m in secret_scan.RUN.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _ in want)]
        assert list(secret_scan.other_runs(text, want)) == runs


def test_secrets_of_a_long_text_are_scanned_in_linear_time(spark):
    text = " ".join(f"token={'ab12' * 4}{i} somelongidentifiername{i}" for i in range(40000))
    docs = frame(spark, [(1, text, None, None), (2, None, None, None), (3, "x" * 3_000_000, None, None)])
    out = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert out[1].n_assign == 40000 and out[2].spans == "" and out[3].n_assign == 0


def test_a_long_clean_text_is_not_toxic(spark):
    rng = random.Random(2)
    vocabulary = words(rng, 2000).split()
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(8))
    rows = []
    for i in range(800):
        said = [sentence() for _ in range(rng.randint(1, 8))]
        if i % 4 == 0:
            said[rng.randrange(len(said))] += " vileword"
        rows.append((i, ". ".join(said)))
    clean = ". ".join(sentence() for _ in range(20000))
    rows += [(5000, clean), (5001, clean + ". you vileword you"), (5002, rows[1][1] * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.assess(docs, labels).collect()}
    assert [out[i].predicted for i in (5000, 5001, 5002)] == [0, 1, 0]
    (found,) = out[5001].sentences
    assert b"vileword" in rows[801][1].encode()[found.start : found.end]
    held = [i for i in range(800) if out[i].held_out]
    assert np.mean([out[i].predicted == (i % 4 == 0) for i in held]) > 0.95


def test_hot_lists_are_paired_by_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rng = random.Random(4)
    line = words(rng, 9)
    rows = [(i, " ".join([line, words(rng, 2 + i % 25)] if i % 3 else [line, "tail " * (i % 20)])) for i in range(90)]
    from .test_near import brute

    got = ngram_join.near_groups(spark.createDataFrame([(i, t) + (None,) * 11 for i, t in rows], SCHEMA)).collect()
    want = brute(rows)
    assert all((r.n_shingles, r.component_id) in want[r.doc_id] for r in got)
    assert F is not None
