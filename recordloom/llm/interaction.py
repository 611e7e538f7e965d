"""Audit of how filters interact, by decision diagrams over the filters that a document fails.

Spark counts the documents of each part by their failure mask, so what is left of a part is at most 2**filters rows. Each part becomes a count-weighted
decision diagram: a level for each filter, at each node the documents that pass it on one side and those that fail it on the other, equal subgraphs
shared. All orders of the filters are visited by swaps of two adjacent levels, which rebuild no more than the nodes of these two levels. In each order the
path on which all pass shows what every step keeps and removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.tables import forget, written

#: The filters of the registered query. Letters name them; E (a copy of a document with a smaller id) needs the whole table and is added by masks().
COPY = "E"
#: Weights of a diagram: documents, of these with quality 1, with toxic 1.
WEIGHTS = ("n", "good", "toxic")
MAX_FILTERS = 8

Weight = tuple[int, ...]


def failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails the filters A to D; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 65,
        "C": upper.cast("long") * 100 > F.char_length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the filters they fail; bit i of mask is the i-th filter, the last one is COPY.

    fails: conditions on the columns of docs, by default failures(text). A document is a copy if any smaller doc_id has the same text, null being empty;
    a null doc_id has no smaller one. Null sources are the part "". Labels of one doc_id are joined by their maximum; null and missing labels count as 0.
    """
    fails = failures(F.col("text")) if fails is None else fails
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    part, text = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    rows = written(docs.select("doc_id", part.alias("part"), F.unhex(F.sha2(text, 256)).alias("text"), mask.alias("mask")), "failures")
    first = rows.groupBy("text").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    marks = labels.groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << len(fails)).otherwise(0)
    found = rows.join(first, "text", "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask")).join(marks, "doc_id", "left")
    counts = found.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in WEIGHTS[1:]])
    out = written(counts, "masks")
    forget(rows)
    return out


class Diagram:
    """A count-weighted decision diagram; a node is a number, told from others of its level by its two children, so equal subgraphs are one."""

    def __init__(self, names: str, counts: dict[int, Weight], width: int):
        self.order, self.width = list(names), width
        self.weight: list[Weight] = []
        self.child: list[tuple[int, int]] = []
        self.made: dict[tuple, int] = {}

        def build(level: int, mask: int) -> int:
            if level == len(names):
                return self._leaf(counts.get(mask, (0,) * width))
            return self._node(names[level], build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _new(self, key: tuple, weight: Weight, children: tuple[int, int]) -> int:
        if key not in self.made:
            self.made[key] = len(self.weight)
            self.weight.append(weight)
            self.child.append(children)
        return self.made[key]

    def _leaf(self, weight: Weight) -> int:
        return self._new(("", *weight), weight, (-1, -1))

    def _node(self, name: str, passed: int, failed: int) -> int:
        return self._new((name, passed, failed), tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed])), (passed, failed))

    def swap(self, level: int) -> None:
        """Exchange the filters of this level and the next: nodes of both are made anew, those below stay, and their parents are led to them."""
        upper, lower = self.order[level], self.order[level + 1]
        done: dict[int, int] = {}

        def turned(node: int, depth: int) -> int:
            if node not in done:
                passed, failed = self.child[node]
                if depth < level:
                    done[node] = self._node(self.order[depth], turned(passed, depth + 1), turned(failed, depth + 1))
                else:
                    (pp, pf), (fp, ff) = self.child[passed], self.child[failed]
                    done[node] = self._node(lower, self._node(upper, pp, fp), self._node(upper, pf, ff))
            return done[node]

        self.root = turned(self.root, 0)
        self.order[level], self.order[level + 1] = lower, upper

    def steps(self) -> list[tuple[str, Weight, Weight]]:
        """(filter, kept, removed) along the path on which all filters pass."""
        node, found = self.root, []
        for name in self.order:
            passed, failed = self.child[node]
            found.append((name, self.weight[passed], self.weight[failed]))
            node = passed
        return found


def swaps(n: int) -> Iterator[int]:
    """Places of adjacent swaps that lead through all orders of n things: the last one wanders to and fro, and at each end the others take a step."""
    if n > 1:
        inner, down = swaps(n - 1), True
        while True:
            yield from range(n - 2, -1, -1) if down else range(n - 1)
            step = next(inner, None)
            if step is None:
                return
            yield step + down
            down = not down


def orders(names: str, counts: dict[int, Weight]) -> Iterator[tuple[str, list[tuple[str, Weight, Weight]]]]:
    """Each order of the filters with its steps."""
    diagram = Diagram(names, counts, len(WEIGHTS))
    yield "".join(diagram.order), diagram.steps()
    for level in swaps(len(names)):
        diagram.swap(level)
        yield "".join(diagram.order), diagram.steps()


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def part_rows(part: str, names: str, counts: dict[int, Weight]) -> list[tuple]:
    """The rows of one part, as COLUMNS names them. What a filter removes first is all that fails it, what it removes last fails nothing else."""
    found = list(orders(names, counts))
    total = {steps[0][0]: steps[0][2][0] for _, steps in found}
    alone = {steps[-1][0]: steps[-1][2][0] for _, steps in found}
    shapley = dict.fromkeys(names, 0)
    for _, steps in found:
        for name, _, removed in steps:
            shapley[name] += removed[0]
    return [
        (part, order, i, kept[0], removed[0], total[name] - removed[0], alone[name], removed[1], removed[2], shapley[name])
        for order, steps in found
        for i, (name, kept, removed) in enumerate(steps, 1)
    ]


def audit(counts: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts (part, mask, n, good, toxic) of masks(); names has a letter for each filter.

    kept: documents after the step; removed: by it; redundant: failing its filter but removed before; unique_fails: failing its filter only; good_lost and
    toxic_lost: of the removed; shapley: removed by its filter, summed over all orders. An empty table gives none.
    """
    if not 1 <= len(names) <= MAX_FILTERS or len(set(names)) != len(names):
        raise ValueError(f"1 to {MAX_FILTERS} filters, each with a letter of its own")
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("cells"))  # at most 2**filters of a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = part_rows(row["part"], names, {c["mask"]: tuple(c[w] for w in WEIGHTS) for c in row["cells"]})
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], list(COLUMNS))

    return cells.mapInArrow(run, SCHEMA)
