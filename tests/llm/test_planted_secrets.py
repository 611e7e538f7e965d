import os
import random
import string

import pytest
from pyspark.sql import functions as F

from recordloom.llm import secret_scan

SF = "/root/testdata/sf0.01/documents.parquet"
KINDS = {
    "token": lambda r: "ghp_" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(36)),
    "letters and digits": lambda r: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(32)),
    "upper hex": lambda r: "".join(r.choice("0123456789ABCDEF") for _ in range(40)),
    "small letters and digits": lambda r: "".join(r.choice(string.ascii_lowercase + string.digits) for _ in range(25)),
    "base64": lambda r: "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(40)),
}


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")
def test_secrets_planted_in_the_given_documents_are_found(spark):
    rng = random.Random(8)
    docs = spark.read.parquet(SF).select("doc_id", "text")
    rows, want = [], {}
    for i, r in enumerate(docs.orderBy("doc_id").collect()):
        words, kind = (r.text or "").split(" "), None
        if i % 4 == 0:
            kind = list(KINDS)[i // 4 % len(KINDS)]
            value, at = KINDS[kind](rng), rng.randrange(len(words) + 1)
            words[at:at] = [value]
            start = len(" ".join(words[:at])) + (at > 0)
            want[r.doc_id] = (kind, f"markov:{start}:{start + len(value)}")
        rows.append((r.doc_id, " ".join(words)))
    got = {r.doc_id: (r.n_markov, r.spans.split(",")) for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in KINDS:
        found = [span in got[i][1] for i, (k, span) in want.items() if k == kind]
        assert len(found) == 50 and sum(found) >= 48
    assert sum(n for i, (n, _) in got.items() if i not in want) <= 1
    plain = secret_scan.scan(docs)
    assert plain.agg(F.sum("n_markov")).first()[0] <= 1


def test_numbers_and_rules_of_signs_are_no_secrets():
    assert not any(secret_scan.judged(s) for s in ("4111111111111111", "================", "abababababababab", "-" * 80))
    assert secret_scan.judged("0123456789abcdef")
    assert {len(v) >= secret_scan.DRAWN for v in secret_scan.random_strings(["a1b2c3d4e5f60718", "????"]).values()} == {True}
