import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from recordloom.llm import exact, packing

from .conftest import messy_rows


def low(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("block", [3, 1024])
def test_exact_groups_match_equality(messy, block):
    got = exact.exact_groups(messy, block).collect()
    groups = defaultdict(list)
    for r in messy_rows():
        groups[low(r[1])].append(r[0])
    assert len(got) == len(messy_rows())
    by_sha = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_without_copies_keeps_one_row_of_each_text(messy, empty):
    out = exact.without_copies(messy)
    assert out.columns == messy.columns
    assert Counter(low(r.text) for r in out.collect()) == Counter({low(r[1]): 1 for r in messy_rows()})
    assert exact.without_copies(empty).count() == 0
    assert exact.exact_groups(empty).count() == 0


def test_boundaries_have_least_padding():
    lengths, counts = [1, 2, 3, 7, 8, 20, 21], [5, 1, 9, 4, 2, 3, 1]

    def padding(ends):
        return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))

    for k in range(1, 8):
        best = min(padding([*c, 21]) for r in range(k) for c in combinations(lengths[:-1], r))
        assert padding(packing.boundaries(lengths, counts, k)) == best
    assert packing.boundaries([], [], 3) == []


def test_pack_covers_every_token_within_the_budget(messy, empty):
    got = packing.pack(messy, max_len=100, n_buckets=4, token_budget=400, pieces_per_shard=50).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        assert r.n_tokens == 0 or r.n_tokens <= r.bucket_len
    want = Counter()
    for r in messy_rows():
        want[r[0]] += len(low(r[1]).split())
    assert tokens == want
    batches = defaultdict(list)
    for r in got:
        if r.n_tokens:
            batches[r.bucket, r.shard, r.batch].append(r)
        else:
            assert (r.bucket, r.batch) == (-1, None)
    for rows in batches.values():
        assert len(rows) * rows[0].bucket_len <= 400
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert packing.pack(empty).count() == 0
