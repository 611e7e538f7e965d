"""Removal of long repeated byte strings with suffix arrays.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Each start of such a string is dealt by content: among the
grams inside the string, the one with the least hash is its anchor, so equal strings have equal anchors. Successive starts with one anchor form
a segment. Segments whose anchor stands alone repeat nothing and go; equal segments are one class with a count. The segments of an anchor meet in
one task, where a suffix array over all its segments is built in two stages: suffixes smaller than their successors are sorted directly, the others
are induced by scanning the buckets of first bytes. Adjacent common prefixes of `length` bytes or more then show the repeated starts.

An anchor with too many classes for one task is split: its segments are cut again by the anchors of longer grams, in the end by the whole string,
and the suffix arrays are built in those parts.

A shorter length can be judged on the way: segments are then those of the shorter strings, with enough text behind them for the longer ones, and the
same adjacent common prefixes answer for both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import words
from recordloom.tables import forget, pick, small, written

LENGTH, GRAM = 400, 128
#: Length of strings and words of a passage: runs of such repeated strings with more words are passages.
PASSAGE_LENGTH, PASSAGE_WORDS = 240, 50
#: Bytes of segments in one suffix array, classes of an anchor over which it is split, and bytes of segments in a partition.
CHUNK_BYTES, HOT_CLASSES, PARTITION_BYTES = 2 << 20, 2000, 16 << 20


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` successive numbers."""
    n = len(key)
    whole = -(-n // width) * width
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments_of(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash) of the segments of a run of documents, of the first `most` starts of each; positions are of the run."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none.astype(np.uint64)
    sums, down = words.rolling(buf)
    grams = words.mix((sums[gram:] - sums[:-gram]) * down[: len(buf) - gram + 1])
    bits = np.uint64(len(grams).bit_length())
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = (_least((grams >> bits << bits) | place, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int8)
    a, b = offsets[:-1], offsets[1:] - length + 1
    b = b if most is None else np.minimum(b, a + most)
    fits = b > a
    valid[a[fits]] += 1
    np.subtract.at(valid, b[fits], 1)
    valid = valid[:-1].cumsum() > 0
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    starts = np.flatnonzero(opens)
    stops = np.flatnonzero(valid & np.r_[opens[1:] | ~valid[1:], True]) + 1
    return starts, stops - starts, grams[anchor[starts]]


def _segment_rows(least: int, length: int, gram: int):
    """Segments of the starts of strings of `least` bytes, told apart by their text up to `length` bytes from the last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, many, most = (batch[c].to_numpy(zero_copy_only=False) for c in ("id", "hash", "many", "most"))
            for at, buf, offsets in words.runs(batch["text"]):
                starts, counts, anchors = segments_of(buf, offsets, least, gram, most[at : at + len(offsets) - 1])
                if not len(starts):
                    continue
                view = memoryview(np.ascontiguousarray(buf))
                of = np.searchsorted(offsets, starts, "right") - 1
                ends = np.minimum(starts + counts + length - 1, offsets[of + 1])
                digest = [xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c[at + of]) for c in (ids, hashes, many)), pa.array(anchors.view(np.int64)), pa.array(np.array(digest, np.uint64).view(np.int64)),
                        pa.array((starts - offsets[of]).astype(np.int32)), pa.array(counts.astype(np.int32)),
                    ],
                    ["id", "hash", "many", "anchor", "digest", "start", "n"],
                )

    return run


def _fields(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct in a column of lists, where a null list is empty, and their fields; no struct becomes a Python object."""
    many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column), dtype=np.int64), many), [f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten()]


def _cut_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, (start, n, anchor, digest, many) = _fields(batch["parts"])
            texts = batch["text"].cast(pa.binary()).to_pylist()
            end = np.minimum(start.astype(np.int64) + n + length - 1, np.array([len(t) for t in texts], np.int64)[of])
            held = np.cumsum(end - start)
            at = 0
            while at < len(of):
                stop = int(np.searchsorted(held, (held[at - 1] if at else 0) + CHUNK_BYTES)) + 1
                part = slice(at, stop)
                cut = [texts[i][a:b] for i, a, b in zip(of[part].tolist(), start[part].tolist(), end[part].tolist())]
                columns = [pa.array(c[part]) for c in (anchor, digest, many, n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], ["anchor", "digest", "many", "n", "text"])
                at = stop

    return run


class _Text:
    """Segments laid end to end, each followed by eight zero bytes."""

    def __init__(self, segments: list[bytes], starts: list[int]):
        size = np.array([len(s) for s in segments], np.int64)
        self.first = np.r_[0, np.cumsum(size + 8)[:-1]].astype(np.int64)
        self.end = self.first + size
        self.last_start = self.first + np.array(starts, np.int64) - 1
        self.bytes = np.frombuffer((b"\0" * 8).join(segments) + b"\0" * 16, np.uint8)
        self.owner = np.repeat(np.arange(len(segments), dtype=np.int32), size + 8)
        self.word = np.ndarray((len(self.bytes) - 7,), ">u8", self.bytes, strides=(1,)).astype(np.uint64)  # the eight bytes from each place on

    def words_at(self, at: np.ndarray) -> np.ndarray:
        return self.word[np.minimum(at, len(self.word) - 1)]


def _smaller_than_next(t: _Text) -> np.ndarray:
    """True where a suffix of a segment is smaller than the one a byte later; the end of a segment is smaller than any byte."""
    now = t.bytes[:-1].astype(np.int16)
    step = np.sign(t.bytes[1:].astype(np.int16) - now).astype(np.int8)
    step[t.end - 1] = -1
    decided = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _sorted_directly(t: _Text, at: np.ndarray, most: int | None = None) -> np.ndarray:
    """Suffixes in the order of their first `most` bytes (or more): seven bytes and the number of bytes that are left at most, again and again for those that tie."""
    seven = ~np.uint64(0xFF)

    def key(places: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
        return (t.word[places + depth] & seven) | np.minimum(left - depth, 7).view(np.uint64)  # at the end of a segment all bytes are zero

    left = t.end[t.owner[at]] - at
    keys = key(at, left, 0)
    rank = np.argsort(keys)
    order, keys, left = at[rank], keys[rank], left[rank]
    places, slots, group, depth = order, np.arange(len(at)), np.zeros(len(at), np.int64), 0
    while len(slots):
        new = np.ones(len(slots) + 1, bool)
        new[1:-1] = (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])
        tied = np.flatnonzero(~(new[:-1] & new[1:]) & ((keys & ~seven) == 7))
        depth += 7
        if not len(tied) or most and depth >= most:
            break
        slots, group, places, left = slots[tied], np.cumsum(new[:-1])[tied], places[tied], left[tied]
        keys = key(places, left, depth)
        differ = np.flatnonzero((keys[1:] != keys[:-1]) & (group[1:] == group[:-1]))
        if len(differ):  # groups that are equal so far, as most are while a repeat lasts, need no sorting
            mixed = np.zeros(int(group[-1]) + 1, bool)
            mixed[group[differ]] = True
            mixed = np.flatnonzero(mixed[group])
            rank = mixed[np.lexsort((keys[mixed], group[mixed]))]
            places[mixed], keys[mixed], left[mixed] = places[rank], keys[rank], left[rank]
            order[slots[mixed]] = places[mixed]
    return order


def suffix_array(t: _Text, most: int | None = None) -> np.ndarray:
    """Starts of all segments in the order of their suffixes, by two-stage sorting; with `most` suffixes that share that many bytes stand together in any order."""
    small_ones = _smaller_than_next(t)
    n = len(small_ones)
    next_small = np.minimum.accumulate(np.where(small_ones, np.arange(n), n)[::-1])[::-1]
    upto = np.minimum(next_small[t.last_start], t.end - 1)  # the chain of larger suffixes after the last start ends here
    taken = np.zeros(n + 1, np.int8)
    taken[t.first] += 1
    taken[upto + 1] -= 1
    taken = np.cumsum(taken[:-1]) > 0
    direct = _sorted_directly(t, np.flatnonzero(taken & small_ones), most)
    limits = np.searchsorted(t.bytes[direct], np.arange(257))
    opening = np.zeros(n, bool)
    opening[t.first] = True
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(before: np.ndarray, byte: int) -> np.ndarray:
        """Queue the larger suffixes that start at `before`, and return those that begin with the byte itself."""
        first = t.bytes[before]
        same = before[first == byte]
        rest, first = before[first != byte], first[first != byte]
        order = np.argsort(first, kind="stable")
        rest, first = rest[order], first[order]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]][: len(first)])
        for c, part in zip(first[cuts].tolist(), np.split(rest, cuts[1:])):
            queue[c].append(part)
        return same

    def larger_before(found: np.ndarray) -> np.ndarray:
        before = found[~opening[found]] - 1
        return before[taken[before] & ~small_ones[before]]

    whole = (t.end - 1)[(upto == t.end - 1) & ~small_ones[t.end - 1]]
    induce(whole, -1)
    for byte in range(256):
        now = np.concatenate(queue[byte]) if queue[byte] else direct[:0]
        while len(now):
            out.append(now)
            now = induce(larger_before(now), byte)
        now = direct[limits[byte] : limits[byte + 1]]
        if len(now):
            out.append(now)
            induce(larger_before(now), byte)
    found = np.concatenate([direct[:0], *out])
    return found[found <= t.last_start[t.owner[found]]]


def repeated_starts(segments: list[bytes], starts: list[int], many: list[int], length: int = LENGTH, shorter: int | None = None) -> list[list[tuple[int, int, bool]]]:
    """For each segment the ranges [a, b) of its starts whose string of `length` bytes occurs twice or more, many being how often a segment stands.

    With `shorter` also those whose string of that many bytes does; the third of a range says whether it is of the length itself.
    """
    t = _Text(segments, starts)
    order = suffix_array(t, length)
    x, y = order[:-1], order[1:]
    common = np.full(len(x), length, np.int64)  # adjacent common prefixes, up to length
    active = np.arange(len(x))
    for depth in range(0, length, 8):
        a, b = t.words_at(x[active] + depth), t.words_at(y[active] + depth)
        same = a == b
        ends = np.flatnonzero(~same)
        common[active[ends]] = depth + _equal_bytes(a[ends], b[ends])
        active = active[same]
    common = np.minimum(common, np.minimum(t.end[t.owner[x]] - x, t.end[t.owner[y]] - y))
    out: list[list[tuple[int, int, bool]]] = [[] for _ in segments]
    for size in {length, shorter or length}:
        group = np.cumsum(np.r_[True, common < size]) - 1
        total = np.bincount(group, weights=np.array(many, np.float64)[t.owner[order]])
        hit = order[total[group] >= 2]
        hit = np.sort(hit[t.end[t.owner[hit]] - hit >= size])
        if len(hit):
            opens = np.r_[True, (np.diff(hit) != 1) | (np.diff(t.owner[hit]) != 0)]
            firsts, lasts = hit[opens], hit[np.r_[opens[1:], True]]
            for seg, a, b in zip(t.owner[firsts].tolist(), firsts.tolist(), lasts.tolist()):
                out[seg].append((a - int(t.first[seg]), b + 1 - int(t.first[seg]), size == length))
    return out


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of leading bytes that two big-endian words share."""
    differ = a ^ b
    out = np.zeros(len(a), np.int64)
    for i in range(8):
        out += (differ >> np.uint64(56 - 8 * i)) == 0
    return out


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("whole", pa.bool_())]))
RANGES_SQL = "array<struct<a:int,b:int,whole:boolean>>"


def _array_rows(least: int, length: int, chunk_bytes: int):
    def done(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[4] for r in rows], [r[3] for r in rows], [r[2] for r in rows], length, least)
        kept = [(r[0], r[1], [{"a": a, "b": b, "whole": w} for a, b, w in f]) for r, f in zip(rows, found) if f]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], RANGES)], ["anchor", "digest", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a suffix array takes whole anchors until it has chunk_bytes."""
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "digest", "many", "n", "text"))):
                if held >= chunk_bytes and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield done(rows)

    return run


def _found(texts: DataFrame, least: int, length: int, grams: list[int], hot_classes: int) -> tuple[DataFrame, DataFrame]:
    """Segments of texts (id, hash, many, text; most is the number of their starts) whose anchor stands elsewhere too, and the repeated ranges of their
    classes (anchor, digest, ranges)."""
    gram = grams[0]
    # How a hot anchor is split: by the next gram, and where the whole shorter string is hot, by the longer strings.
    after = (least, grams[1:]) if grams[1:] else (length, [(least + length) // 2, length]) if least < length else None
    every = written(texts.mapInArrow(_segment_rows(least, length, gram), "id long, hash long, many long, anchor long, digest long, start int, n int"), "segments")
    again = written(every.groupBy("anchor").agg(F.sum("many").alias("many")).filter("many > 1").select("anchor"), "anchors")
    listed = written(every.join(small(again, 8), "anchor", "left_semi"), "repeated")
    forget(every, again)
    classes = listed.groupBy("anchor", "digest").agg(F.sum("many").alias("many"), F.min(F.struct("id", "hash", "start", "n")).alias("at"))
    classes = written(classes.select("anchor", "digest", "many", "at.*"), "classes")
    ids = written(classes.select("id").distinct(), "ids")
    parts = classes.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "n", "anchor", "digest", "many")).alias("parts"))
    cut = pick(texts, ids, "id").join(parts, ["id", "hash"]).select("text", "parts")
    cut = written(cut.mapInArrow(_cut_rows(length), "anchor long, digest long, many long, n int, text binary"), "texts")
    hot = classes.groupBy("anchor").count().filter(F.col("count") > hot_classes).select("anchor")
    hot = written(hot if after else hot.limit(0), "hot")
    forget(ids)
    held = cut.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = cut.join(small(hot, 8), "anchor", "left_anti").repartition(max(64, held // PARTITION_BYTES), "anchor").sortWithinPartitions("anchor")
    found = written(dealt.mapInArrow(_array_rows(least, length, CHUNK_BYTES), f"anchor long, digest long, ranges {RANGES_SQL}"), "ranges")
    if not hot.isEmpty():
        # A class is a text of its own here; what follows its own starts belongs to other segments.
        longer = cut.join(small(hot, 8), "anchor", "left_semi").select(F.col("anchor").alias("id"), F.col("digest").alias("hash"), "many", "text", F.col("n").cast("long").alias("most"))
        longer = written(longer, "split")
        inner, ranges = _found(longer, after[0], length, after[1], hot_classes)
        one = F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b"), F.col("r.whole").alias("whole"))
        spread = inner.join(ranges, ["anchor", "digest"]).select("id", "hash", "start", F.explode("ranges").alias("r")).select(F.col("id").alias("anchor"), F.col("hash").alias("digest"), one.alias("r"))
        if after[0] > least:  # the gram is the shorter string itself
            shared = F.struct(F.lit(0).alias("a"), F.col("most").cast("int").alias("b"), F.lit(False).alias("whole"))
            spread = spread.union(longer.select(F.col("id").alias("anchor"), F.col("hash").alias("digest"), shared.alias("r")))
        found, first = written(found.union(spread.groupBy("anchor", "digest").agg(F.collect_set("r").alias("ranges"))), "ranges"), found
        forget(first, longer, inner, ranges)
    forget(cut, classes, hot)
    return listed, found


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_classes: int = HOT_CLASSES, least: int | None = None) -> DataFrame:
    """(id, hash, spans): for texts with repeated strings, the byte ranges (s, e, whole) that such strings cover; ranges may overlap.

    docs has id, hash and text. whole is false for ranges of strings of `least` bytes, where that is less than the length.
    """
    least = min(least or length, length)
    gram = gram if least == length else max(8, min(gram, least // 3))
    whole = docs.select("id", "hash", F.lit(1).cast("long").alias("many"), "text", F.lit(1 << 40).alias("most"))
    listed, found = _found(whole, least, length, sorted({gram, (gram + least) // 2, least}), hot_classes)
    spans = listed.join(found, ["anchor", "digest"]).select("id", "hash", "start", F.explode("ranges").alias("r"))
    size = F.when(F.col("r.whole"), length).otherwise(least)
    span = F.struct((F.col("start") + F.col("r.a")).alias("s"), (F.col("start") + F.col("r.b") - 1 + size).alias("e"), F.col("r.whole").alias("whole"))
    out = written(spans.select("id", "hash", span.alias("span")).groupBy("id", "hash").agg(F.collect_set("span").alias("spans")), "spans")
    forget(listed, found)
    return out


def _merged(of: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of the ranges [s, e) of each text: the numbers of the texts, the starts and the ends, in order."""
    a, b = (of << 32) + s, (of << 32) + e
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    opens = np.ones(len(a) + 1, bool)
    opens[1:-1] = a[1:] > b[:-1]
    a, b = a[opens[:-1]], b[opens[1:]]
    return a >> 32, a & 0xFFFFFFFF, b & 0xFFFFFFFF


def _ranges(of: np.ndarray, s: np.ndarray, e: np.ndarray, rows: int) -> pa.Array:
    first = np.r_[0, np.cumsum(np.bincount(of, minlength=rows))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays([pa.array(s), pa.array(e)], ["s", "e"]))


def _strip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]
        rows, sizes = len(texts), np.array([len(t) for t in texts], np.int64)
        of, (s, e, whole) = _fields(batch["spans"])
        whole = whole.astype(bool)
        gone, runs = _merged(of[whole], s[whole], e[whole]), _merged(of, s, e)
        long = np.array([len(texts[i][a:b].split()) > PASSAGE_WORDS for i, a, b in zip(*(x.tolist() for x in runs))], bool)
        pieces: dict[int, list[bytes]] = {}
        last: dict[int, int] = {}
        for i, a, b in zip(*(x.tolist() for x in gone)):
            pieces.setdefault(i, []).append(texts[i][last.get(i, 0) : a])
            last[i] = b
        kept = [b"".join([*pieces[i], t[last[i] :]]) if i in last else t for i, t in enumerate(texts)]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array(sizes),
                pa.array(sizes - np.array([len(k) for k in kept], np.int64)),
                pa.array(np.bincount(gone[0], minlength=rows)),
                _ranges(*gone, rows),
                _ranges(*(x[long] for x in runs), rows),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "passages", "kept_sha256", "kept"],
        )


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_classes: int = HOT_CLASSES, passage: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, spans (the removed byte ranges), passages, kept_sha256, kept (the bytes that stay).

    Texts are UTF-8 bytes; null counts as empty. Every byte covered by a string of `length` bytes that also starts anywhere else, in the same document or
    another row, is removed, all copies included; a match never crosses documents. passages are the ranges of more than PASSAGE_WORDS words covered by
    strings of `passage` bytes (by default of `length`) that also start elsewhere; they are reported, not removed.
    Repeated rows count as separate documents, null ids too. An empty table gives an empty result; other columns are ignored.
    """
    if not 8 <= gram <= length or passage is not None and not 16 <= passage <= length:
        raise ValueError("gram must lie between 8 and length, and passage between 16 and length")
    none = F.lit(-(2**63))
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.xxhash64("text").alias("hash"))
    spans = repeats(docs, length, gram, hot_classes, passage)
    ids = written(spans.select("id").distinct(), "ids")
    shape = "array<struct<s:int,e:int,whole:boolean>>"
    touched = pick(docs, ids, "id").join(spans, ["id", "hash"], "left").select("doc_id", "text", "spans")
    rest = pick(docs, ids, "id", keep=False).select("doc_id", "text", F.lit(None).cast(shape).alias("spans"))
    ranges = "array<struct<s:bigint,e:bigint>>"
    out = f"doc_id long, n_bytes long, n_removed long, n_spans long, spans {ranges}, passages {ranges}, kept_sha256 string, kept binary"
    return touched.mapInArrow(_strip_rows, out).union(rest.mapInArrow(_strip_rows, out))
