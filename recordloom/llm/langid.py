"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every training document; the weights are trained by FTRL with an elastic net on a bounded sample of them, and
a temperature fitted on a held-back part of that sample calibrates the scores. Every language that has a labelled row is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.linear import Ftrl, softmax, temperature
from recordloom.tables import forget, written

#: Hash dimensions, longest n-gram, training documents of a language, and of all languages together, passes over the sample.
DIMS, ORDER, SAMPLE_PER_LANG, SAMPLE_DOCS, EPOCHS = 1 << 15, 3, 800, 16000, 3
#: Different n-grams of a training document that are kept, the most frequent ones, so that the sample's bytes are bounded.
SAMPLE_GRAMS = 8192
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Scores under GUESS times that of a guess are rejected in filtering, unless more than REJECTED of the held-back rows have such scores too.
GUESS, REJECTED = 1.04, 0.001
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SLICE = 1 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder that is kept from training; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def gram_counts(text: str, dims: int = DIMS) -> np.ndarray:
    """How often each hashed n-gram of 1 to ORDER characters stands in the lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - (dims - 1).bit_length())
    total = np.zeros(dims, np.int64)
    for at in range(0, len(codes), _SLICE):
        part = codes[at : at + _SLICE + ORDER - 1]
        sums = part * _MULTIPLIERS[0]
        for n in range(1, ORDER + 1):
            if n > 1:
                sums = sums[:-1] * _MULTIPLIERS[3] + part[n - 1 :] * _MULTIPLIERS[n - 1]
            starts = sums[: min(_SLICE, len(codes) - at)]
            total += np.bincount((starts * _MULTIPLIERS[1] >> shift).astype(np.int64), minlength=dims)
    return total


def vectors(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Rows of log-scaled TF times IDF, of length one."""
    x = np.log1p(np.stack(counts).astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _study(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the sample, packed, and at the end one row of document frequencies for the task."""
        seen = np.zeros(dims, np.int64)

        def rows(labels: list, packed: list, at: list, df: list) -> pa.RecordBatch:
            columns = [pa.array(labels, pa.string()), *(pa.array([p[i] for p in packed], pa.binary()) for i in (0, 1)), pa.array(at, pa.list_(pa.int32())), pa.array(df, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["label", "packed_dims", "packed_counts", "dims", "df"])

        for batch in batches:
            labels, packed = [], []
            for text, lang, chosen in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), batch["chosen"].to_pylist()):
                counts = gram_counts(text or "", dims)
                seen += counts > 0
                if chosen:
                    at = np.flatnonzero(counts)
                    if len(at) > SAMPLE_GRAMS:
                        at = np.sort(np.argsort(-counts, kind="stable")[:SAMPLE_GRAMS])
                    labels.append(lang)
                    packed.append((at.astype(np.int32).tobytes(), counts[at].astype(np.int32).tobytes()))
            yield rows(labels, packed, [None] * len(labels), [None] * len(labels))
        at = np.flatnonzero(seen)
        if len(at):
            yield rows([None], [(None, None)], [at.astype(np.int32)], [seen[at]])

    return run


def train(docs: DataFrame, dims: int = DIMS, sample_per_lang: int = SAMPLE_PER_LANG, epochs: int = EPOCHS) -> dict:
    """A model from docs (doc_id, text, lang): languages, weights, bias, idf and temperature. Rows held out or without lang are not read.

    Null texts count as empty ones. The weights are fitted on sample_per_lang rows of each language, fewer if all languages would have over SAMPLE_DOCS
    (at least one each), chosen by a hash of doc_id; rows that tie are ordered by their n-grams, so the order of docs doesn't matter. Nothing labelled, or
    an empty table, gives a model of no language.
    """
    known = docs.filter(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    tally = known.groupBy("lang").count().collect()  # a row for each language
    langs = sorted(r.lang for r in tally)
    many = sum(r["count"] for r in tally)
    if not langs:
        return {"langs": [], "w": np.zeros((dims, 0), np.float32), "b": np.zeros(0), "idf": np.ones(dims, np.float32), "t": 1.0, "floor": 0.0}
    per_lang = max(1, min(sample_per_lang, SAMPLE_DOCS // len(langs)))
    rare = known.sparkSession.createDataFrame([(r.lang, per_lang / r["count"]) for r in tally], "lang string, share double")
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    study = written(known.join(F.broadcast(rare), "lang").select("text", "lang", chosen.alias("chosen")).mapInArrow(_study(dims), "label string, packed_dims binary, packed_counts binary, dims array<int>, df array<long>"), "langid")
    pairs = study.filter("label is null").select(F.explode(F.arrays_zip("dims", "df")).alias("p")).groupBy("p.dims").agg(F.sum("p.df").alias("df"))
    df = np.zeros(dims)
    for r in pairs.collect():  # dims rows at most
        df[r.dims] = r.df
    idf = np.log((1 + many) / (1 + df)).astype(np.float32) + 1

    rows = study.filter("label is not null").select("label", "packed_dims", "packed_counts").limit(2 * per_lang * len(langs) + 64).collect()
    rows.sort(key=lambda r: (r.label, r.packed_dims, r.packed_counts))
    rows = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    place = {lang: i for i, lang in enumerate(langs)}
    labels = np.array([place[r.label] for r in rows], np.int64)
    forget(study)

    def dense(part: range) -> np.ndarray:
        counts = np.zeros((len(part), dims), np.int32)
        for i, k in enumerate(part):
            counts[i, np.frombuffer(rows[k].packed_dims, np.int32)] = np.frombuffer(rows[k].packed_counts, np.int32)
        return vectors(list(counts), idf)

    back = len(rows) // 5
    model = Ftrl((dims + 1, len(langs)), alpha=1.0, l1=0.002, l2=0.01)
    for _ in range(epochs):
        for at in range(back, len(rows), 16):
            part = range(at, min(at + 16, len(rows)))
            x = np.c_[dense(part), np.ones((len(part), 1), np.float32)]
            p = softmax(x @ model.w)
            p[np.arange(len(part)), labels[part.start : part.stop]] -= 1
            model.update(x.T @ p / len(part))
    w, b = model.w[:-1].astype(np.float32), model.w[-1]
    logits = [dense(range(at, min(at + 64, back))) @ w + b for at in range(0, back, 64)]
    t, floor = 1.0, 0.0
    if logits:
        t = temperature(np.concatenate(logits), labels[:back])
        floor = min(GUESS / len(langs), float(np.quantile(softmax(np.concatenate(logits) / t).max(axis=1), REJECTED, method="lower")))
    return {"langs": langs, "w": w, "b": b, "idf": idf, "t": t, "floor": floor}


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if m["langs"] else []
            for at in range(0, len(lettered), 64):
                part = lettered[at : at + 64]
                p = softmax((vectors([gram_counts(texts[i], len(m["idf"])) for i in part], m["idf"]) @ m["w"] + m["b"]) / m["t"])
                for i, k, s in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    langs[i], scores[i] = m["langs"][k], min(1.0, s)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), pa.array(langs), pa.array(scores, pa.float64())], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score (its calibrated probability).

    A null text, one without a letter, and every text of a model of no language is `und` with score 0. Repeated rows get equal results, whole texts of
    any length are read; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims times languages numbers
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_judge(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on docs' own labels and predict every row: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is `und` with score 0; so is every text if nothing is labelled. Repeated rows get equal results; an empty table
    gives an empty result; columns besides doc_id, text and lang are ignored.
    """
    return predict(docs, train(docs, **options))


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([bool(t) and any(map(str.isalpha, t)) for t in batch["text"].to_pylist()], pa.bool_()))


def understood(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are rejected: `und` for want of a text or of any letter, and those that the model can only guess at. The columns stay.

    A guess is a score about as low as chance gives for the number of languages, if held-back rows of known language have no such scores. Where nothing is labelled, no language can be told and the rows with a letter stay. Repeated rows are treated alike; an empty table stays empty.
    """
    model = train(docs, **options)
    if not model["langs"]:
        return docs.mapInArrow(_readable, docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    judge, floor = _judge(shared), model["floor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (found,) = judge([batch.select(["text"])])
            yield batch.filter(pc.and_(pc.not_equal(found["lang_pred"], UNKNOWN), pc.greater_equal(found["score"], floor)))

    return docs.mapInArrow(run, docs.schema)
