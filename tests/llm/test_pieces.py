import hashlib
import random

import pytest

from recordloom.llm import pieces

from .conftest import SCHEMA

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "▁", "▁▁a", "a▁b", "a ▁ b", "\n", " \n \t", "\x00a", "a\tb  c   ", "ﬁ　x﻿", "�", "<s>", "</s> <unk> <0x0A>", "é é 漢字 😀😀 ‍", "x" * 3000, " " * 300, "  if x:\n        return",
]


@pytest.fixture(scope="module")
def model():
    return pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def texts():
    rng = random.Random(5)
    some = ODD + ["".join(rng.choice(["a", "the", "ção", " ", "  ", "\n", "▁", "😀", "12", ".", "Zz"]) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    return some + some[:30] + ["palavra " * 60000]


@pytest.mark.parametrize("limits", [{}, {"block_chars": 500, "part_bytes": 2000}, {"block_chars": 1, "part_bytes": 1 << 30}])
def test_encodes_and_decodes_as_the_library_does(spark, model, limits):
    sp = pieces.processor(model)
    docs = spark.createDataFrame([(i if i % 9 else None, t, i) for i, t in enumerate(texts())], "doc_id long, text string, n long").repartition(3)
    out = pieces.decode(pieces.encode(docs, model, **limits), model)
    assert out.columns == ["doc_id", "n", "ids", "text"]
    rows = out.collect()
    assert len(rows) == len(texts())
    for r in rows:
        want = sp.encode(texts()[r["n"]] or "")
        assert r["ids"] == want and r["text"] == (sp.decode(want) if want else "")
        assert r["doc_id"] == (r["n"] if r["n"] % 9 else None)


def test_keeps_columns_of_clashing_names_and_empty_tables(spark, model, messy):
    docs = messy.withColumnRenamed("key", "block").withColumnRenamed("spans", "spots").withColumnRenamed("name", "chunks").withColumnRenamed("n", "IDS")
    out = pieces.encode(docs, model)
    assert out.columns == [c for c in docs.columns if c not in ("text", "IDS")] + ["ids"]
    sp = pieces.processor(model)
    assert sorted(map(str, (r["ids"] for r in out.collect()))) == sorted(str(sp.encode(r["text"] or "")) for r in docs.collect())
    none = spark.createDataFrame([], SCHEMA)
    assert pieces.decode(pieces.encode(none, model), model).count() == 0


def test_query_digests_what_the_library_gives(spark, tmp_path, model):
    from recordloom.llm import queries

    some = [(i, t) for i, t in enumerate(texts())]
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sp = pieces.processor(model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(i, len(x), sha(",".join(map(str, x))), sha(sp.decode(x) if x else "")) for i, t in some for x in [sp.encode(t or "")]}
    assert {tuple(r) for r in queries.op11_sentencepiece(spark, str(tmp_path)).collect()} == want


def test_a_model_whose_pieces_cross_markers_is_refused(monkeypatch, model):
    class Crossing:
        get_piece_size, id_to_piece, unk_id, piece_to_id = lambda s: 1, lambda s, i: "a▁b", lambda s: 0, lambda s, p: 1

        def normalize(self, t):
            return "▁" + t.replace(" ", "▁")

    monkeypatch.setattr(pieces, "processor", lambda m: Crossing())
    with pytest.raises(ValueError):
        pieces.check_separable(model)


def test_a_table_has_each_chunk_once_a_block(spark, model):
    table: dict = {}
    assert [table.setdefault(c, len(table)) for c in pieces.chunks("a b a  b")] == [0, 1, 0, 2]
    assert list(table) == ["▁a", "▁b", "▁▁b"]
    assert pieces.unpacked(pieces.packed(__import__("numpy").array([0, 1, 70000, 1 << 31]))).tolist() == [0, 1, 70000, 1 << 31]
