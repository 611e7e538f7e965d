"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The models are of order one over the characters of identifiers, and trained from labelled strings. Random strings have a model for each alphabet that secrets
come in; it learns from what the patterns mark in a bounded sample of documents, and from strings drawn with a fixed seed, since the marked ones may all be of
one alphabet. The other strings of the sample are ordinary, unless they look like random ones. A run whose log-likelihood ratio for any alphabet is over
that alphabet's threshold is reported beside the patterns' own spans. Random strings that the models haven't seen set the thresholds, whatever share of the
runs is over them. Runs of digits alone, and of few different characters, are no secrets.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.tables import written

#: The patterns, fixed values.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models judge, documents and distinct strings of each label in the sample, the share of marked strings' pieces that reach the threshold,
#: its least value in nats, and the rounds (at most) and parts of the sorting out of unmarked secrets.
MIN_RUN = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
SAMPLE_DOCS, SAMPLE_STRINGS, SHARE, MARGIN, ROUNDS, FOLDS = 20000, 20000, 0.99, 3.0, 20, 5
#: The alphabets, and the drawn strings of each and their length; a marked string counts for the first alphabet that has all its characters.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base36": _LOWER + _DIGITS, "BASE36": _UPPER + _DIGITS, "base62": _UPPER + _LOWER + _DIGITS, "url": _UPPER + _LOWER + _DIGITS + "_-", "base64": _UPPER + _LOWER + _DIGITS + "+/=",
    "any": _UPPER + _LOWER + _DIGITS + "+/_=-",
}
DRAWN, DRAWN_CHARS, MIN_DISTINCT = 500, 48, 6
#: Characters of a string that the models learn from; the scan itself judges whole strings.
SAMPLE_CHARS = 256
WORD = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{7,15}(?![A-Za-z0-9_])")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(ALPHABET) + 1
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the patterns' matches."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def covered(base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a text that the patterns' matches cover, in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e, _ in sorted(base):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def other_runs(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Runs that no pattern's match touches, in one sweep over both."""
    parts, i = covered(base), 0
    for m in RUN.finditer(text):
        while i < len(parts) and parts[i][1] <= m.start():
            i += 1
        if i == len(parts) or parts[i][0] >= m.end():
            yield m.span()


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = set()
        for text in batch["text"].to_pylist():
            text = text or ""
            base = base_spans(text)
            for s, e, kind in base:
                value = ASSIGN.match(text, s)[2] if kind == "assign" else text[s:e]
                rows.add((value, True))
            rows |= {(text[s:e], False) for s, e in other_runs(text, base)}
            edges = [0, *(x for span in covered(base) for x in span), len(text)]
            rest = RUN.sub(" ", " ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))  # a piece of a secret is no word
            rows |= {(w, False) for w in WORD.findall(rest)}
        rows = sorted({(v[:SAMPLE_CHARS], secret) for v, secret in rows})
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["value", "secret"])


class Markov:
    """Log probabilities of each character after another, backed off to the frequency of the character alone."""

    def __init__(self, pairs: np.ndarray, backing: float = 200.0):
        alone = pairs.sum(axis=0) + 0.5
        alone /= alone.sum()
        self.log = np.log((pairs + backing * alone) / (pairs.sum(axis=1, keepdims=True) + backing))


def codes(s: str) -> np.ndarray:
    return _CODE[np.minimum(np.frombuffer(s.encode("ascii", "replace"), np.uint8), 127)]


class Steps:
    """The steps from each character of some strings to the next, with the string that each one is of."""

    def __init__(self, strings: list[str]):
        coded = [codes(s) for s in strings]
        self.n, self.lengths = len(strings), np.array([max(0, len(c) - 1) for c in coded], np.int64)
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), self.lengths)
        self.at = np.concatenate([np.zeros(0, np.int16), *((c[:-1] * _N + c[1:]).astype(np.int16) for c in coded)])

    def pairs(self, of: np.ndarray) -> np.ndarray:
        """How often each step occurs in the strings where `of` holds."""
        return np.bincount(self.at[of[self.owner]], minlength=_N * _N).reshape(_N, _N).astype(float)

    def sums(self, log: np.ndarray) -> np.ndarray:
        """For each string the sum over its steps."""
        return np.bincount(self.owner, log.ravel()[self.at], self.n)


def judged(s: str) -> bool:
    """Whether a run can be a secret at all."""
    return not s.isdigit() and len(set(s)) >= MIN_DISTINCT


def random_strings(marked: list[str]) -> dict[str, list[str]]:
    """The labelled random strings of each alphabet: marked ones, then drawn ones."""
    out: dict[str, list[str]] = {name: [] for name in ALPHABETS}
    for s in marked:
        name = next((n for n, chars in ALPHABETS.items() if set(s) <= set(chars)), None)
        if name and judged(s):
            out[name].append(s)
    for name, chars in ALPHABETS.items():
        rng = random.Random(name)
        out[name] += ["".join(rng.choice(chars) for _ in range(DRAWN_CHARS)) for _ in range(DRAWN)]
    return out


class Judge:
    """The models and the thresholds of their log-likelihood ratios, which grow with the length of a run.

    Secrets that no pattern marks are among the unmarked strings. Those over a threshold leave the ordinary model, which moves the thresholds, until
    none changes sides. Each string is judged here by models of the other ones.
    """

    def __init__(self, secret: list[str], ordinary: list[str]):
        self.able = bool(ordinary)
        models, pieces = [], []
        for strings in random_strings(secret).values():
            unseen, seen = strings[::5], Steps([s for i, s in enumerate(strings) if i % 5])
            models.append(Markov(seen.pairs(np.ones(seen.n, bool))).log)
            # The shortest runs are the hardest to tell, so that pieces of their length set the threshold.
            pieces.append(Steps([s[i : i + MIN_RUN] for s in unseen for i in range(0, len(s) - MIN_RUN + 1, MIN_RUN)]))
        steps = Steps(ordinary)
        fold, over = np.arange(steps.n) % FOLDS, np.zeros(steps.n, bool)
        able = np.array([judged(s) and len(s) >= MIN_RUN for s in ordinary], bool)
        for _ in range(ROUNDS):
            parts = [steps.pairs(~over & (fold == f)) for f in range(FOLDS)]
            plain = Markov(sum(parts)).log
            self.logs = [m - plain for m in models]
            self.rates = [float(np.quantile(p.sums(log), 1 - SHARE, method="lower")) / (MIN_RUN - 1) for p, log in zip(pieces, self.logs)]
            before, over = over, np.zeros(steps.n, bool)
            for f in range(FOLDS):
                others = Markov(sum(parts) - parts[f]).log
                for m, rate in zip(models, self.rates):
                    over |= able & (fold == f) & (steps.sums(m - others) > np.maximum(MARGIN, rate * steps.lengths))
            if (over == before).all():
                break

    def ratios(self, s: str) -> list[float]:
        """By how much the log-likelihood ratio of each alphabet is over its threshold."""
        code = codes(s)
        return [float(log[code[:-1], code[1:]].sum()) - max(MARGIN, rate * (len(s) - 1)) for log, rate in zip(self.logs, self.rates)]

    def marks(self, s: str) -> bool:
        return self.able and judged(s) and max(self.ratios(s)) > 0


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> Judge:
    """Models from a sample of docs, chosen by a hash of doc_id and text, so that it doesn't depend on the order of rows.

    sample_docs documents (about), sample_strings strings of each label and SAMPLE_CHARS of each string bound what is collected. Null texts hold no
    strings; without ordinary strings, as in an empty table, the models mark nothing.
    """
    share = sample_docs / max(1, docs.count())
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("text")
    rows = written(chosen.mapInArrow(_labelled, "value string, secret boolean").groupBy("value").agg(F.max("secret").alias("secret")), "labelled")

    def some(where: str) -> list[str]:
        return [r.value for r in rows.filter(where).orderBy(F.xxhash64("value"), "value").limit(sample_strings).collect()]

    mixed = lambda strings: sorted(strings, key=lambda s: hashlib.md5(s.encode()).digest())
    long = f"length(value) >= {MIN_RUN}"  # the runs that are judged, beside shorter words
    return Judge(mixed(some("secret")), mixed(some(f"not secret and {long}") + some(f"not secret and not {long}")))


def _scan(judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans = [], []
            for text in batch["text"].to_pylist():
                text = text or ""
                base = base_spans(text)
                more = [(s, e, "markov") for s, e in other_runs(text, base) if judge.value.marks(text[s:e])]
                for kind in KINDS:
                    counts[kind].append(sum(k == kind for _, _, k in base + more))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests), pa.array(spans)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return run


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans (kind:start:end, in code points).

    Null text counts as empty and has no spans. Runs that touch a pattern's span are not judged again. Without ordinary strings to learn from the models mark nothing.
    Repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    judge = docs.sparkSession.sparkContext.broadcast(train(slim, **options))
    return slim.mapInArrow(_scan(judge), "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
