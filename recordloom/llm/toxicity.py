"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model over hashed words and word beginnings scores each sentence, and a noisy-or joins the sentence
scores to the document's. Only documents are labelled; training passes the document's error back to its sentences, whose scores then show where
the offence is.

In a long text many sentences that say nothing would add up. So the highest score counts in full, and of the other distinct sentences only what lies
over a floor, under which the sentences of clean training documents stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm import words
from recordloom.llm.linear import Ftrl
from recordloom.tables import written

#: Hash dimensions, bytes of word beginnings, labelled documents taken of each class, the longest of them in bytes, and bytes of each class (in the mean).
DIMS, BEGINNINGS, SAMPLE_PER_CLASS, SAMPLE_TEXT_BYTES, SAMPLE_BYTES = 1 << 18, (4, 5, 6, 7, 8), 4000, 1 << 16, 24 << 20
#: The share of clean sentences under the floor, and the highest floor.
CLEAN_SHARE, MOST_FLOOR = 0.9999, 0.3
#: Documents in a training step, and steps at least; passes over the sample at least.
BATCH, STEPS, EPOCHS = 25, 1000, 4
FOLDS, HELD_OUT = 5, 0
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder that is kept from training; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def bags(column: pa.Array, dims: int = DIMS) -> Iterator[tuple]:
    """For runs of texts: (first row, texts, features, their sentence, first and last byte of each sentence, text of each sentence, offsets).

    A sentence ends at a full stop, exclamation or question mark or line feed; its features are its words and their beginnings.
    """
    shift = np.uint64(64 - (dims - 1).bit_length())
    for at, buf, offsets in words.runs(column):
        numbers, starts, ends, firsts = words.word_numbers(buf, offsets)
        sums, down = words.rolling(words._LOW[buf])
        stops = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_STOP[buf], out=stops[1:])
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
        trimmed = ends - _STOP[buf[ends - 1]] if len(ends) else ends  # a stop at the end is no part of the word
        numbers = words.mix((sums[trimmed] - sums[starts]) * down[starts])
        new = np.r_[True, (doc[1:] != doc[:-1]) | (stops[starts[1:]] != stops[starts[:-1]])][: len(starts)]
        sentence = np.cumsum(new) - 1
        opens = np.flatnonzero(new)
        features, whose = [numbers], [sentence]
        for n in BEGINNINGS:
            long_enough = trimmed - starts > n
            s = starts[long_enough]
            features.append(words.mix((sums[s + n] - sums[s]) * down[s] + np.uint64(n)))
            whose.append(sentence[long_enough])
        hashed = (np.concatenate(features) >> shift).astype(np.int64)
        closes = np.r_[opens[1:], len(starts)] - 1 if len(opens) else opens
        yield at, len(offsets) - 1, hashed, np.concatenate(whose), starts[opens], ends[closes], doc[opens], offsets


def _sentence_scores(hashed: np.ndarray, whose: np.ndarray, n: int, w: np.ndarray, bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.bincount(whose, weights=w[hashed], minlength=n) + bias, -30, 30)))


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) over the sentences of each document; 0 without sentences."""
    return 1 - np.exp(-np.bincount(doc, weights=-np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def joined(p: np.ndarray, doc: np.ndarray, n: int, hashed: np.ndarray, whose: np.ndarray, floor: float) -> np.ndarray:
    """The score of each document: noisy-or of its highest sentence and of what its other distinct sentences have over the floor; 0 without sentences."""
    alike = np.zeros(len(p), np.uint64)
    np.add.at(alike, whose, words.mix(hashed.astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((alike, -p, doc))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (p[order][1:] != p[order][:-1]) | (alike[order][1:] != alike[order][:-1])][: len(p)]
    order = order[new]
    first = np.r_[True, doc[order][1:] != doc[order][:-1]][: len(order)]
    return noisy_or(np.where(first, p[order], np.maximum(0.0, (p[order] - floor) / (1 - floor))), doc[order], n)


def train(docs: DataFrame, labels: DataFrame, dims: int = DIMS, per_class: int = SAMPLE_PER_CLASS, text_bytes: int = SAMPLE_TEXT_BYTES, epochs: int = EPOCHS) -> dict:
    """Weights, bias and floor from documents and labels (doc_id, toxic) that are not held out; null labels are ignored.

    The sample holds per_class documents of each class, fewer if they have over SAMPLE_BYTES together, of text_bytes at most each, chosen by a hash of
    doc_id and put in an order of their own, so that the order of rows doesn't matter. Several labels of one document count as the highest. Null texts and
    empty tables leave nothing to learn from: then every sentence has the score of the prior.
    """
    known = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r.toxic: r["count"] for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    of_class = lambda c, shares: F.when(c, shares.get(True, 0.0)).otherwise(shares.get(False, 0.0)) * (1 << 30)
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    share = {y: per_class / n for y, n in count.items()}
    known = known.filter(place < of_class(F.col("toxic") > 0, share)).limit(4 * per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").filter(F.octet_length("text") <= text_bytes)
    rows = written(rows.select("doc_id", "text", (F.col("toxic") > 0).alias("y")), "labelled")
    size = {r.y: r["size"] for r in rows.groupBy("y").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    less = {y: share[y] * min(1.0, SAMPLE_BYTES / max(1, size.get(y, 0))) for y in share}
    rows = rows.filter(place < of_class(F.col("y"), less)).select("text", "y")
    rows = sorted((r.text, r.y) for r in rows.limit(4 * per_class).collect())  # a bounded sample
    rows = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    model = Ftrl((dims + 1,), alpha=0.3, l1=0.2, l2=0.01)
    model.w[-1] = -6.0
    prior = -6.0
    parts = [rows[i : i + BATCH] for i in range(0, len(rows), BATCH)]
    made = [(list(bags(pa.array([t for t, _ in part], pa.string()), dims)), np.array([y for _, y in part])) for part in parts]
    for _ in range(max(epochs, -(-STEPS // max(1, len(parts))))):
        for part, truth in made:
            gradient = np.zeros(dims + 1)
            for at, n, hashed, whose, _, _, doc, _ in part:
                p = _sentence_scores(hashed, whose, len(doc), model.w[:-1], model.w[-1] + prior)
                whole = np.clip(noisy_or(p, doc, n), 1e-9, 1 - 1e-9)
                y = truth[at : at + n]
                slope = np.where(y, -(1 - whole) / whole, 1.0)[doc] * p
                gradient[:-1] += np.bincount(hashed, weights=slope[whose], minlength=dims)
                gradient[-1] += slope.sum()
            model.update(gradient)
    clean = [np.zeros(0)]
    for part, truth in made:
        for at, n, hashed, whose, _, _, doc, _ in part:
            p = _sentence_scores(hashed, whose, len(doc), model.w[:-1], model.w[-1] + prior)
            clean.append(p[~truth[at : at + n][doc]])
    clean = np.concatenate(clean)
    floor = min(MOST_FLOOR, float(np.quantile(clean, CLEAN_SHARE))) if len(clean) else 0.0
    return {"w": model.w[:-1].astype(np.float32), "b": float(model.w[-1] + prior), "floor": floor}


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores, worst = [], []
            for _, n, hashed, whose, first, last, doc, offsets in bags(batch["text"], len(m["w"])):
                p = _sentence_scores(hashed, whose, len(doc), m["w"], m["b"])
                scores.append(joined(p, doc, n, hashed, whose, m["floor"]))
                spans: list[list] = [[] for _ in range(n)]
                for k in np.flatnonzero(p >= 0.5).tolist():
                    d = int(doc[k])
                    spans[d].append({"start": int(first[k] - offsets[d]), "end": int(last[k] - offsets[d]), "score": float(p[k])})
                worst += spans
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(np.clip(np.concatenate([np.zeros(0), *scores]), 0, 1)), pa.array(worst, kind)], ["doc_id", "held_out", "score", "sentences"]
            )

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, sentences (byte spans and scores of those of 0.5 or more).

    Whole texts of any length are read. Null, empty and wordless texts score 0; repeated rows get equal results; an empty table gives an empty result;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims numbers
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    out = rows.mapInArrow(_judge(shared), "doc_id long, held_out boolean, score double, sentences array<struct<start:bigint,end:bigint,score:double>>")
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "sentences")


def assess(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labels and score every row of docs.

    A null, empty or wordless text has no sentence and scores 0. Of several labels of one document the highest counts. Without labels every text scores by
    the prior. Repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    return predict(docs, train(docs, labels, **options))
