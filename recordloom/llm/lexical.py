"""Ranked lexical search: a stated set of items against all documents, term at a time for short lists and document at a time for long ones.

The documents stay where they are read. A task inverts its documents, in shards of a bounded number of postings, for the terms of the items alone. For each
item it first adds up the short lists of a shard, term at a time, into one list of accumulators; this list then is one more iterator, with the highest of
its sums as its bound, among the long lists. Those are walked document at a time, in windows of documents: lists whose bounds together can't reach the
lowest score that still counts only answer for the documents that others propose, by binary search, and documents that can't reach it any more are let go.
That score is carried from shard to shard of a task. What a task found, at most `top` documents an item, is merged by windows in two rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm import words

TOP = 50
#: Bytes of items that are searched in one pass over the documents; postings and documents of a shard; accumulators of an item; documents of a window.
PART_BYTES, SHARD_POSTINGS, SHARD_DOCS, ACCUMULATORS, WINDOW = 4 << 20, 2 << 20, 1 << 16, 1 << 13, 1 << 12
NULL_ID = (1 << 63) - 1

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Bytes of a term: ASCII letters and digits, and every byte of a character beyond ASCII.
_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[65:91] = _INNER[97:123] = _INNER[128:] = True


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, firsts): the terms of a run of texts as 64-bit numbers, and for each text the index of its first term, then their count."""
    inner = _INNER[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inner[:-1], inner[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inner & ~before), np.flatnonzero(inner & ~after) + 1
    return words.spelled(_LOW[buf], starts, ends), np.searchsorted(starts, offsets)


class Items:
    """The items of a part: the sorted terms of all, and each item's terms as places in them."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        found: dict[int | None, list[np.ndarray]] = {}
        for item, text in rows:
            buf = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            found.setdefault(item, []).append(terms(buf, np.array([0, len(buf)], np.int64))[0])
        self.ids = list(found)
        own = [np.unique(np.concatenate(x)) for x in found.values()]
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        self.places = [np.searchsorted(self.terms, x) for x in own]
        self.bits = 8 * max(1 << 10, len(self.terms))
        self.bits = 1 << self.bits.bit_length()
        self.seen = np.zeros(self.bits, bool)
        self.seen[(self.terms & np.uint64(self.bits - 1)).astype(np.int64)] = True
        self.weight = np.zeros(len(self.terms), np.int64)
        self.n = self.length = 0

    def measured(self, counts: dict[int, tuple[int, int]]) -> Items:
        """Set the statistics of the corpus: counts has df by term, and at -1 the documents with a term and the terms of all."""
        self.n, self.length = counts.get(-1, (0, 0))
        for place, (df, _) in counts.items():
            if place >= 0:
                self.weight[place] = math.floor(1000 * math.log((2 * self.n + 2) / (2 * df + 1)))
        return self

    def postings(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, terms of each row, and of each posting the row in the run, the term and its occurrences) of runs of whole texts."""
        width = max(1, len(self.terms))
        for at, buf, offsets in words.runs(column):
            numbers, firsts = terms(buf, offsets)
            likely = np.flatnonzero(self.seen[(numbers & np.uint64(self.bits - 1)).astype(np.int64)])
            place = np.searchsorted(self.terms, numbers[likely])
            place[place == len(self.terms)] = 0
            hit = self.terms[place] == numbers[likely] if len(self.terms) else np.zeros(len(likely), bool)
            row = np.searchsorted(firsts, likely[hit], "right") - 1
            cells, tf = np.unique(row * width + place[hit], return_counts=True)
            yield at, np.diff(firsts), cells // width, cells % width, tf


def _statistics(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = items.value
        df, n, length = np.zeros(len(found.terms), np.int64), 0, 0
        for batch in batches:
            for _, sizes, _, place, _ in found.postings(batch["text"]):
                np.add.at(df, place, 1)
                n, length = n + int((sizes > 0).sum()), length + int(sizes.sum())
        used = np.flatnonzero(df)
        columns = np.r_[-1, used], np.r_[n, df[used]], np.r_[length, np.zeros(len(used), np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "df", "length"])

    return run


class Best:
    """The best documents of an item so far: by falling score, then rising doc_id."""

    def __init__(self, top: int):
        self.top, self.score, self.doc, self.least = top, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.r_[self.score, score], np.r_[self.doc, doc]
        kept = np.lexsort((doc, -score))[: self.top]
        self.score, self.doc = score[kept], doc[kept]
        if len(kept) == self.top:
            self.least = int(self.score[-1])


class Shard:
    """The inverted lists of some documents, numbered in the order they came, with the score that each posting adds."""

    def __init__(self, items: Items, ids: np.ndarray, sizes: np.ndarray, row: np.ndarray, place: np.ndarray, tf: np.ndarray):
        self.ids = ids
        spread = np.array([50 + 50 * n * items.n // max(1, items.length) for n in sizes.tolist()], np.int64)  # whole numbers of any size
        order = np.argsort(place, kind="stable")  # rows stay in order inside a list
        self.row, place, tf = row[order], place[order], tf[order]
        self.impact = items.weight[place] * ((1_000_000_000 * tf) // (1000 * tf + 20 * spread[self.row]))
        self.first = np.searchsorted(place, np.arange(len(items.terms) + 1))

    def search(self, places: np.ndarray, best: Best, accumulators: int, window: int) -> None:
        lists = sorted(((self.row[a:b], self.impact[a:b]) for a, b in zip(self.first[places].tolist(), self.first[places + 1].tolist()) if a < b), key=lambda x: len(x[0]))
        if not lists:
            return
        held = 0  # short lists, term at a time
        short = next((i for i, (rows, _) in enumerate(lists) if (held := held + len(rows)) > accumulators), len(lists))
        if short > 1:
            rows, impacts = np.concatenate([x[0] for x in lists[:short]]), np.concatenate([x[1] for x in lists[:short]])
            order = np.argsort(rows, kind="stable")
            rows, starts = np.unique(rows[order], return_index=True)
            lists = [(rows, np.add.reduceat(impacts[order], starts)), *lists[short:]]
        lists = sorted(((rows, impacts, int(impacts.max())) for rows, impacts in lists), key=lambda x: x[2])
        bound = np.cumsum([x[2] for x in lists])
        for low in range(0, len(self.ids), window):  # long lists, document at a time
            asked = int(np.searchsorted(bound, best.least))  # lists before this one can't reach the least score together
            if asked == len(lists):
                return
            score = np.zeros(min(window, len(self.ids) - low), np.int64)
            for rows, impacts, _ in lists[asked:]:
                a, b = np.searchsorted(rows, (low, low + window))
                score[rows[a:b] - low] += impacts[a:b]
            found = np.flatnonzero(score)
            score = score[found]
            for i in range(asked - 1, -1, -1):
                able = score + bound[i] >= best.least
                found, score = found[able], score[able]
                if not len(found):
                    break
                rows, impacts, _ = lists[i]
                at = np.minimum(np.searchsorted(rows, found + low), len(rows) - 1)
                score = score + np.where(rows[at] == found + low, impacts[at], 0)
            able = score >= best.least
            if able.any():
                best.add(score[able], self.ids[found[able] + low])


def _best(items, top: int, accumulators: int, window: int, shard_postings: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best, held, docs, n = items.value, [Best(top) for _ in items.value.ids], [], 0, 0

        def search() -> None:
            if n:
                shard = Shard(asked, *(np.concatenate(x) for x in zip(*held)))
                for places, own in zip(asked.places, best):
                    shard.search(places, own, accumulators, window)

        for batch in batches:
            ids = batch["doc_id"].fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for at, sizes, row, place, tf in asked.postings(batch["text"]):
                held.append((ids[at : at + len(sizes)], sizes, row + docs, place, tf))
                docs, n = docs + len(sizes), n + len(row)
                if n >= shard_postings or docs >= shard_docs:
                    search()
                    held, docs, n = [], 0, 0
        search()
        part = TaskContext.get().partitionId()
        for i in range(0, len(best), 1000):
            some = best[i : i + 1000]
            item = np.repeat(np.arange(i, i + len(some)), [len(x.doc) for x in some])
            doc = np.concatenate([x.doc for x in some])
            columns = pa.array(item), pa.array(doc, mask=doc == NULL_ID), pa.array(np.concatenate([x.score for x in some])), pa.array(np.full(len(doc), part, np.int64))
            yield pa.RecordBatch.from_arrays(list(columns), ["item", "doc_id", "score", "part"])

    return run


def parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[Items]:
    """The items in parts of about part_bytes of text; rows of one item_id are in one part. Nothing for an empty table."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = max(1, -(-size.b // part_bytes), -(-size.n * 64 // part_bytes)) if size.n else 0
    for i in range(n):
        yield Items([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()])  # of bounded size


def search(
    docs: DataFrame, benchmark: DataFrame, top: int = TOP, part_bytes: int = PART_BYTES, accumulators: int = ACCUMULATORS, window: int = WINDOW, shard_postings: int = SHARD_POSTINGS, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each item with a score above 0, by falling score, then rising doc_id, null last.

    Terms are the runs of letters, digits and characters beyond ASCII of whole texts, lower-cased in A-Z; a null text has none. Rows of benchmark with one
    item_id are one item, whose terms count once. Each row of docs is a document: repeated rows and ids are ranked each for itself. Items without terms or
    without a match, and empty tables, give no rows; other columns are ignored. accumulators, window and the limits of a shard don't change the result.
    """
    spark = docs.sparkSession
    slim, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    salts = math.isqrt(slim.rdd.getNumPartitions()) + 1
    best_first = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for items in parts(benchmark, part_bytes):
        told = spark.sparkContext.broadcast(items)  # of bounded size
        counts = slim.mapInArrow(_statistics(told), "place long, df long, length long").groupBy("place").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
        told = spark.sparkContext.broadcast(items.measured({r["place"]: (r["df"], r["length"]) for r in counts.collect()}))  # a row for each term of the part
        found = slim.mapInArrow(_best(told, top, accumulators, window, shard_postings, shard_docs), "item long, doc_id long, score long, part long")
        some = F.row_number().over(Window.partitionBy("item", F.pmod("part", F.lit(salts))).orderBy(*best_first))
        found = found.withColumn("rank", some).filter(F.col("rank") <= top)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best_first))).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
        found = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
