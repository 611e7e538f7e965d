"""Benchmark decontamination with SimHash windows.

Every window of a document that has as many words as a benchmark item gets a SimHash of its weighted five-word shingles; a document with fewer words
than the item is one window as a whole. The fingerprints of the items lie in a multi-index: 64 bits in 8 blocks, each block searched within two bits,
which finds every fingerprint within 23 bits. Candidates are verified by the exact weighted Jaccard similarity of the shingle sets.

A window's fingerprint is computed only if enough of its shingles stand in the benchmark at all for the similarity to be reachable, which loses nothing.
Items are taken in parts of a bounded size; each part is one pass over the documents, so the passes grow with the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import words
from recordloom.tables import written

SIMILARITY, BLOCKS, BLOCK_RADIUS = 0.8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Items and bytes of items in a part, and words worked on at a time.
PART_ITEMS, PART_BYTES, SPAN = 20000, 16 << 20, 8192
_SCALE = 1 << 10
_BITS = np.arange(64, dtype=np.uint64)


def _signs(shingles: np.ndarray) -> np.ndarray:
    return ((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.int64) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class Index:
    """The items of a part: shingle weights, fingerprints by length, and the blocks that lead to them."""

    def __init__(self, items: list[tuple[int, str]], counted: tuple[np.ndarray, np.ndarray, int] | None = None):
        """counted: sorted shingles, the number of items with each, and of all items, if the items are a part of the benchmark only."""
        self.k = words.SHINGLE
        numbers = []
        for item, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            buf = np.frombuffer((text or "").encode(), np.uint8)
            w = words.word_numbers(buf, np.array([0, len(buf)], np.int64))[0]
            if len(w):
                numbers.append((item, w))
        sets = [words.shingle_numbers(w, min(self.k, len(w))) for _, w in numbers]
        known, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(s) for s in sets)]), return_counts=True)
        self.known, self.n = known, len(sets)
        if counted is not None:
            df, self.n = counted[1][np.searchsorted(counted[0], known)], counted[2]
        self.weights = np.round(_SCALE * (1 + np.log((1 + self.n) / (1 + df)))).astype(np.int64)
        self.other = int(round(_SCALE * (1 + np.log(1 + self.n))))  # of a shingle that no item has
        self.seen = np.zeros(1 << 20, bool)
        self.seen[known & np.uint64((1 << 20) - 1)] = True
        self.by_length: dict[int, list] = defaultdict(list)
        for (item, w), s in zip(numbers, sets):
            weight = self.weigh(s)
            own = np.unique(s)
            fingerprint = int(_packed((weight[:, None] * _signs(s)).sum(axis=0)[None])[0])
            self.by_length[len(w)].append((item, own, int(self.weigh(own).sum()), fingerprint))
        self.blocks = {length: self._blocked([i[3] for i in held]) for length, held in self.by_length.items()}
        most = int(self.weights.max()) if len(known) else 1
        #: Positions of a window that must hold a known shingle for any item of that length to reach the similarity.
        self.least = {length: max(1, int(np.ceil(SIMILARITY * min(i[2] for i in held) / most - 1e-9))) for length, held in self.by_length.items()}

    @staticmethod
    def _blocked(fingerprints: list[int]) -> list[dict[int, list[int]]]:
        width = 64 // BLOCKS
        flips = [sum(1 << i for i in bits) for r in range(BLOCK_RADIUS + 1) for bits in combinations(range(width), r)]
        out: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
        for at, f in enumerate(fingerprints):
            for b in range(BLOCKS):
                block = f >> (b * width) & ((1 << width) - 1)
                for flip in flips:
                    out[b][block ^ flip].append(at)
        return out

    def near(self, length: int, fingerprint: int) -> list[tuple]:
        """Items of that length within the radius."""
        width = 64 // BLOCKS
        held = self.by_length[length]
        at = {i for b, block in enumerate(self.blocks[length]) for i in block.get(fingerprint >> (b * width) & ((1 << width) - 1), ())}
        return [held[i] for i in sorted(at) if (held[i][3] ^ fingerprint).bit_count() <= RADIUS]

    def knows(self, shingles: np.ndarray) -> np.ndarray:
        out = self.seen[shingles & np.uint64((1 << 20) - 1)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.known, shingles[at]), max(0, len(self.known) - 1))
        out[at] = self.known[place] == shingles[at]
        return out

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(shingles), self.other)
        place = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[place] == shingles, self.weights[place], self.other)

    def search(self, numbers: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Of one document's words: item -> (best similarity, first word, words) of what reaches the similarity."""
        best: dict[int, tuple[float, int, int]] = {}
        for k in {min(self.k, length) for length in self.by_length}:
            shingles = words.shingle_numbers(numbers, k)
            known = self.knows(shingles)
            if not known.any():
                continue
            count = np.r_[0, known.cumsum()]
            for length in sorted(self.by_length):
                if min(self.k, length) != k:
                    continue
                m = min(length - k + 1, len(shingles))  # a document shorter than the item is one window as a whole
                starts = np.flatnonzero(count[m:] - count[:-m] >= self.least[length])
                for _, part in groupby(starts.tolist(), lambda s: s // SPAN):
                    self._verify(shingles, np.array(list(part)), length, m, m + k - 1, best)
        return best

    def _verify(self, shingles: np.ndarray, starts: np.ndarray, length: int, m: int, size: int, best: dict) -> None:
        """Fingerprints of the windows of m shingles (`size` words) at `starts`, which lie less than SPAN apart, and the exact check of what is near."""
        low = int(starts[0])
        span = shingles[low : int(starts[-1]) + m]
        sums = np.zeros((len(span) + 1, 64), np.int64)
        np.cumsum(self.weigh(span)[:, None] * _signs(span), axis=0, out=sums[1:])
        prints = _packed(sums[starts - low + m] - sums[starts - low])
        for start, fingerprint in zip(starts.tolist(), prints.tolist()):
            for item, own, weight, _ in self.near(length, fingerprint):
                window = np.unique(shingles[start : start + m])
                weights = self.weigh(window)
                both = int(weights[own[np.minimum(np.searchsorted(own, window), len(own) - 1)] == window].sum())
                value = both / (weight + int(weights.sum()) - both)
                if value >= SIMILARITY and value > best.get(item, (0.0,))[0]:
                    best[item] = (value, start, size)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [np.zeros(0, np.uint64), *words.shingle_sets(batch["text"])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["shingle"])


def indexes(benchmark: DataFrame, part_items: int = PART_ITEMS, part_bytes: int = PART_BYTES) -> Iterator[Index]:
    """Indexes of the benchmark's items (item_id, text), dealt by hash to as many parts as keep each one small; weights are those of the whole benchmark."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = max(1, -(-size.n // part_items), -(-size.b // part_bytes))
    if size.n and n == 1:
        yield Index([tuple(r) for r in items.collect()])
    elif size.n:
        df = written(items.mapInArrow(_shingle_rows, "shingle long").groupBy("shingle").count(), "item-shingles")
        for i in range(n):
            part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
            own = part.mapInArrow(_shingle_rows, "shingle long").distinct().join(df, "shingle").collect()  # of a part of bounded size
            own = sorted((r["shingle"] & (1 << 64) - 1, r["count"]) for r in own)
            yield Index([tuple(r) for r in part.collect()], (np.array([x[0] for x in own], np.uint64), np.array([x[1] for x in own], np.int64), size.n))


def _found(index: Index, column: pa.Array) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
    for at, buf, offsets in words.runs(column):
        numbers, starts, ends, firsts = words.word_numbers(buf, offsets)
        near = np.zeros(len(numbers) + 1, np.int64)
        for k in {min(index.k, length) for length in index.by_length}:
            hit = index.knows(words.shingle_numbers(numbers, k))
            near[1 : len(hit) + 1] += hit
        near = near.cumsum()
        for d in np.flatnonzero(near[firsts[1:]] > near[firsts[:-1]]).tolist():
            a, b = firsts[d], firsts[d + 1]
            found = index.search(numbers[a:b])
            if found:
                yield at + d, found, starts[a:b] - offsets[d], ends[a:b] - offsets[d]


def _hits(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch["doc_id"].to_pylist()
            for row, found, starts, ends in _found(index.value, batch["text"]):
                rows += [(ids[row], item, s, int(starts[w]), int(ends[w + n - 1])) for item, (s, w, n) in found.items()]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "similarity", "start", "end"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, similarity, start and end (bytes of the best window).

    Words are split at ASCII white space and lower-cased in A-Z. An item of fewer than five words counts as one shingle. Null, empty and wordless
    texts and items match nothing. Repeated rows give repeated results; of windows that tie the first is shown. Empty tables give an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    slim, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    for part in indexes(benchmark):
        index = spark.sparkContext.broadcast(part)  # of bounded size
        found = slim.mapInArrow(_hits(index), "doc_id long, item_id long, similarity double, start long, end long")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "doc_id long, item_id long, similarity double, start long, end long") if out is None else out


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in _found(index.value, batch["text"])]] = False
            yield batch.filter(pa.array(keep))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item, as leaks() finds them; the columns stay as they are.

    Rows with a null, empty or wordless text stay, as do all rows where the benchmark is empty; repeated rows are treated alike; an empty table stays empty.
    """
    for part in indexes(benchmark):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(part)), docs.schema)
    return docs
