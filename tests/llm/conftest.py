import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, name string, key string, kept boolean, score double, spans string, part int, bucket int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, shared passages, columns with clashing names."""
    rng = random.Random(3)
    base = words(rng, 120)
    edited = base.split()
    edited[60] = "zzz"
    passage = words(rng, 90)
    long = words(rng, 20000)
    texts = {
        1: base, 2: base.upper(), 3: None, 4: "", 5: " \t\n ", 6: " ".join(edited), 7: long, 8: words(rng, 40) + " " + passage + " " + words(rng, 30),
        9: passage + "\n" + words(rng, 50), 10: "um dois", 11: "UM DOIS", 12: "Ünïcödé ÉÀ texto com acentos é só", 13: "1234 !!! ???", 14: long + " fim", 15: words(rng, 5), 16: "a b c d", 17: "\x00 nul " + words(rng, 10),
    }
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None, None, "n", "k", None, None, None, None, None) for i, t in texts.items()]
    extra = (None, None, None, None, None, None, None, None, None, None, None)
    rows += [rows[0], rows[15]]  # repeated rows
    rows += [(None, base, *extra), (None, None, *extra), (20, words(rng, 60), *extra), (20, words(rng, 61), *extra)]  # null ids, one id with two texts
    return rows


@pytest.fixture(scope="session")
def messy(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messy") / "documents.parquet")
    spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
