"""Jaccard join of documents on word n-grams by vertical partitioning.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of 0.8 or more. The n-gram order is cut into
fragments: each fragment is worked on apart, and its partial counts are summed per document or per pair.

1. Every set gives the n-grams that come first in hash order, as many as the prefix lemma asks for, dealt to fragments. A fragment counts for each
   set the n-grams that other sets show too. Sets whose counts sum to too little can link with none and go, which leaves about a tenth.
2. The sets that stay are ordered by n-gram frequency; prefixes in that order propose pairs. First each set is paired with one hub, the set of
   its group with the fewest n-grams of its own, and what links is joined to components. Then all pairs that share a prefix n-gram, lie in different
   components and can reach the threshold by their counts are proposed; lists of frequent n-grams are cut into blocks for this.
3. A pair's overlap is counted in each fragment of the frequency order, and summed.

Equal sets are one class throughout, so copies are never paired. Pairs inside a component are skipped, as no link of theirs can change it.
A set of fewer than MIN_SET n-grams links with equal ones only. Lists over BLOCK members are cut by size first, as linked sets differ by a fourth at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.graph import components
from recordloom.llm import words
from recordloom.tables import forget, pick, small, written

#: Text bytes for each fragment of the first step, fragments of the last, and members of an n-gram's list that are paired in one task.
FRAGMENT_BYTES, MIN_FRAGMENTS, PAIR_FRAGMENTS, BLOCK = 16 << 20, 64, 4, 512
#: Slices of the n-gram space in which the shared n-grams of a set are counted to bound the overlap of a pair.
SLICES = 64
#: The least set that can link with another one: 4 of 5 n-grams shared.
MIN_SET = 4


def least_overlap(n):
    """Shared n-grams that a set of n needs for similarity 0.8 with any other."""
    return (4 * n + 4) // 5


#: The same of a column n, in SQL.
LEAST = "((4 * n + 4) div 5)"


def _extra(n):
    """Shared n-grams asked of a prefix."""
    return np.maximum(1, n // 10)


def _prefixes(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, keys, owners, parts, whose, seen = batch["doc_id"].to_pylist(), [], [], [], [], [], {}
            for shingles, key in words.keyed_sets(batch["text"]):
                owner = int.from_bytes(key[:8], "little") | 1
                n = len(shingles)
                if n >= MIN_SET and owner not in seen:
                    seen[owner] = len(sizes)
                    parts.append(shingles[: n - least_overlap(n) + int(_extra(n))])
                    whose.append(owner)
                sizes.append(n)
                keys.append(key)
                owners.append(owner)
            tokens = np.concatenate([np.zeros(0, np.uint64), *parts])
            who = np.repeat(np.array(whose, np.uint64), [len(p) for p in parts])
            order = np.argsort(tokens, kind="stable")
            tokens, who = tokens[order], who[order]
            first = np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)]
            times = np.diff(np.r_[np.flatnonzero(first), len(tokens)]) if len(tokens) else np.zeros(0, np.int64)
            often = np.repeat(times, times) > 1
            local = np.zeros(len(sizes), np.int64)  # n-grams that this batch alone shows to be shared
            for owner, n in zip(*np.unique(who[often], return_counts=True)):
                local[seen[int(owner)]] = n
            who[often] = 0
            sent = first | ~often
            tokens, who = tokens[sent], who[sent]
            part = ((tokens & np.uint64(0xFFFFFFFF)) % np.uint64(fragments)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, tokens, who = part[order], tokens[order], who[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)]).tolist()
            m, k = len(cuts), len(sizes)
            ends = [*cuts[1:], len(part)]
            at = np.array(owners, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[part[cuts], (at >> np.uint64(40)).astype(np.int64) % fragments].astype(np.int32)),
                    pa.array([tokens[a:b].tobytes() for a, b in zip(cuts, ends)] + [None] * k, pa.binary()),
                    pa.array([who[a:b].tobytes() for a, b in zip(cuts, ends)] + [None] * k, pa.binary()),
                    pa.array([None] * m + ids, pa.int64()),
                    pa.array([None] * m + sizes, pa.int64()),
                    pa.array([None] * m + keys, pa.binary()),
                    pa.array([None] * m + at.view(np.int64).tolist(), pa.int64()),
                    pa.array([None] * m + local.tolist(), pa.int64()),
                ],
                ["part", "tokens", "who", "doc_id", "n", "key", "owner", "shared"],
            )

    return run


def _count_shared(rows: pa.Table) -> pa.Table:
    """Of one fragment: its document rows as they are, and for each set the number of n-grams that others show too."""
    blobs = rows.filter(pc.is_valid(rows["tokens"]))
    docs = rows.filter(pc.is_null(rows["tokens"])).select(["doc_id", "n", "key", "owner", "shared"])
    joined = lambda name: np.frombuffer(b"".join(blobs[name].to_pylist()), np.uint64)
    tokens, who = joined("tokens"), joined("who")
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)])
    if len(starts):
        low, high = np.minimum.reduceat(who, starts), np.maximum.reduceat(who, starts)
        common = np.repeat(low != high, np.diff(np.r_[starts, len(tokens)]))
        who = who[common & (who != 0)]
    owners, counts = np.unique(who, return_counts=True)
    none = lambda kind: pa.nulls(len(owners), kind)
    more = pa.table([none(pa.int64()), none(pa.int64()), none(pa.binary()), pa.array(owners.view(np.int64)), pa.array(counts.astype(np.int64))], names=docs.column_names)
    return pa.concat_tables([docs, more.cast(docs.schema)])


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sets = [], []
        for shingles, key in words.keyed_sets(batch["text"]):
            keys.append(key)
            sets.append(shingles.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "tokens"])


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sets with their shared n-grams in frequency order: the prefix, and the counts in each slice."""
    for batch in batches:
        counts, prefixes, sizes = [], [], []
        for n, tokens in zip(batch["n"].to_pylist(), batch["tokens"]):
            t = tokens.values.to_numpy(zero_copy_only=False)
            sizes.append(len(t))
            counts.append(np.bincount(t % SLICES, minlength=SLICES).astype(np.uint32).tobytes())
            prefixes.append(t[: max(0, len(t) - least_overlap(n) + 1)])
        yield pa.RecordBatch.from_arrays(
            [batch["sid"], batch["n"], pa.array(sizes, pa.int64()), pa.array(counts, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["sid", "n", "m", "slices", "tokens"]
        )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell's members that lie in different components and can reach the threshold; two of the upper size are another list's."""
    for batch in batches:
        for lo, hi, members in zip(batch["lo"].to_pylist(), batch["hi"].to_pylist(), batch["members"]):
            found = []
            v = members.values
            sid, n, m, comp, block, upper = (v.field(k).to_numpy(zero_copy_only=False) for k in ("sid", "n", "m", "comp", "block", "upper"))
            slices = np.frombuffer(b"".join(v.field("slices").to_pylist()), np.uint32).reshape(-1, SLICES)
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            own = n - m
            able = (comp[left, None] != comp[right]) & ~(upper[left, None] & upper[right]) & (9 * (own[left, None] + own[right]) <= n[left, None] + n[right])
            able &= 9 * np.minimum(m[left, None], m[right]) >= 4 * (n[left, None] + n[right])
            a, b = np.nonzero(able)
            a, b = left[a], right[b]
            for at in range(0, len(a), 1 << 15):
                x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
                most = np.minimum(slices[x], slices[y]).sum(axis=1)
                fits = 9 * most >= 4 * (n[x] + n[y])
                x, y = sid[x[fits]], sid[y[fits]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            if found:
                x = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["x", "y"])


def _linked(pairs: DataFrame, segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Those pairs (x, y) with similarity 0.8 or more: overlaps are counted fragment by fragment and summed."""
    one = segments.select(F.col("sid").alias("x"), "fragment", F.col("tokens").alias("tx"))
    two = segments.select(F.col("sid").alias("y"), "fragment", F.col("tokens").alias("ty"))
    partial = pairs.join(one, "x").join(two, ["y", "fragment"]).select("x", "y", F.size(F.array_intersect("tx", "ty")).alias("part"))
    total = partial.groupBy("x", "y").agg(F.sum("part").alias("overlap"))
    of = lambda c: sizes.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"))
    return written(total.join(of("x"), "x").join(of("y"), "y").filter("9 * overlap >= 4 * (n_x + n_y)").select("x", "y"), "links")


def links(sets: DataFrame) -> DataFrame:
    """(node, component) for the sets (sid, n, tokens) that link with another; sid names distinct sets."""
    posted = sets.select("sid", "n", F.explode("tokens").alias("token"))
    twice = posted.groupBy("token").count().filter("count > 1").select("token")
    alive = posted.join(twice, "token").groupBy("sid", "n").count().filter(f"count >= {LEAST}")
    alive = written(alive.select("sid"), "alive")
    posted = sets.join(alive, "sid", "left_semi").select("sid", "n", F.explode("tokens").alias("token"))
    often = written(posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "df")
    shared = written(posted.join(often, "token").select("sid", "n", "token", "df"), "shared")  # the tokens of one set only come first in the order
    ordinal = F.col("df") + F.pmod("token", F.lit(1 << 20)) / float(1 << 20)
    cuts = shared.agg(F.percentile_approx(ordinal, [i / PAIR_FRAGMENTS for i in range(1, PAIR_FRAGMENTS)])).first()[0] or []
    fragment = sum((F.when(ordinal > c, 1).otherwise(0) for c in cuts), F.lit(0))
    segments = written(shared.groupBy("sid", "n", fragment.alias("fragment")).agg(F.collect_list("token").alias("tokens")), "segments")
    sizes = written(segments.groupBy("sid", "n").agg(F.sum(F.size("tokens")).alias("m")), "set-sizes")

    place = F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"])
    ahead = shared.groupBy("sid", "n").agg(place.alias("tokens")).mapInArrow(_ahead, "sid long, n long, m long, slices binary, tokens array<long>")
    ahead = written(ahead, "ahead")
    prefix = written(ahead.select("sid", "n", "m", F.explode("tokens").alias("token")), "prefix")

    hubs = prefix.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("m")).alias("own"), F.col("sid").alias("hub"), F.col("n").alias("hub_n"), F.col("m").alias("hub_m"))).alias("h"), F.count("*").alias("many"))
    hubs = written(hubs.filter("many > 1").select("token", "many", "h.hub", "h.hub_n", "h.hub_m"), "hubs")
    tried = prefix.join(hubs, "token").filter("sid <> hub and 9 * least(m, hub_m) >= 4 * (n + hub_n)").groupBy("sid", "hub").count()
    tried = tried.groupBy("sid").agg(F.max(F.struct("count", "hub")).alias("best")).select(F.col("sid").alias("x"), F.col("best.hub").alias("y"))
    tried = written(tried, "hub-pairs")
    first = _linked(tried, segments, sizes)

    joined = components(first.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    joined = written(joined, "components")
    member = prefix.join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
    member = written(member, "members")
    mixed = member.groupBy("token").agg(F.count("*").alias("many"), F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("token", "many")
    mixed = written(mixed, "mixed")
    # Sets that link lie in one band of sizes or in neighbouring ones; list b of a frequent n-gram holds the bands b and b + 1.
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    lists = F.when(F.col("many") <= BLOCK, F.array(F.lit(-1))).otherwise(F.array("band", F.col("band") - 1))
    listed = member.join(mixed, "token").withColumn("band", band).withColumn("list", F.explode(lists)).withColumn("upper", (F.col("list") >= 0) & (F.col("list") < F.col("band")))
    listed = written(listed.select("token", "list", "upper", "sid", "n", "m", "comp"), "lists")
    held = listed.groupBy("token", "list").agg(F.count("*").alias("many"), F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("upper").alias("only")).filter("a <> b and not only")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    cells = listed.join(held.select("token", "list", "many"), ["token", "list"]).join(ahead.select("sid", "slices"), "sid")
    cells = cells.select("token", "list", "upper", "sid", "n", "m", "comp", "slices", F.pmod(F.xxhash64("sid"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = cells.groupBy("token", "list", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.collect_list(F.struct("sid", "n", "m", "comp", "block", "upper", "slices")).alias("members"))
    more = cells.mapInArrow(_pairs, "x long, y long").distinct()
    more = more.join(tried.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
    more = written(more, "pairs")
    second = _linked(more, segments, sizes)
    forget(alive, often, shared, segments, sizes, ahead, prefix, hubs, tried, joined, member, mixed, listed, more)
    found = components(first.union(second).select(F.col("x").alias("src"), F.col("y").alias("dst")))
    forget(first, second)
    return found


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, comp, label) for each row of docs: its set, the component of sets that it is in, if there are others in it, and the smallest doc_id of
    that component, else its own."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(MIN_FRAGMENTS, total // FRAGMENT_BYTES)
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    rows = slim.mapInArrow(_prefixes(fragments), "part int, tokens binary, who binary, doc_id long, n long, key binary, owner long, shared long")
    rows = written(rows.groupBy("part").applyInArrow(_count_shared, "doc_id long, n long, key binary, owner long, shared long"), "counted")
    listed = rows.filter("n is not null")
    kept = rows.groupBy("owner").agg(F.sum("shared").alias("shared"), F.max("n").alias("n"))
    kept = written(kept.filter(f"n > 0 and shared >= greatest(1, {LEAST} div 10)").select("owner"), "kept")
    classes = listed.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.max("n").alias("n"), F.max("owner").alias("owner"), F.count("*").alias("many"))
    classes = written(classes, "classes")
    named = written(classes.join(kept, "owner", "left_semi").select("key", "low", "n", F.monotonically_increasing_id().alias("sid")), "named")
    ids = named.select(F.col("low").alias("doc_id"))
    sets = pick(slim, ids, "doc_id").mapInArrow(_token_rows, "key binary, tokens array<long>")
    sets = sets.join(named, "key").groupBy("sid", "n").agg(F.first("tokens").alias("tokens"))
    sets = written(sets, "sets")
    found = links(sets)
    forget(sets, kept)
    found = written(named.join(found, F.col("sid") == F.col("node")).select("key", "low", "component"), "linked")
    lowest = found.groupBy("component").agg(F.min("low").alias("label"))
    linked = found.join(lowest, "component").select("key", F.concat(F.lit("c"), F.col("component").cast("string")).alias("comp"), "label")
    known = linked.union(classes.filter("many > 1").join(linked, "key", "left_anti").select("key", F.hex("key"), "low"))
    known = written(known, "known")
    forget(classes, named, found)
    placed = listed.join(known, "key", "left").select("doc_id", "n", "key", "comp", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("label"))
    placed = written(placed.withColumn("comp", F.when(F.col("doc_id").isNotNull(), F.col("comp"))), "placed")
    forget(rows, known)
    return placed


def near_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Texts are lower-cased in A-Z, words split at ASCII white space; fewer than five words make one shingle, none (or a null text) an empty set
    that links with nothing. Rows of one doc_id are one node; a row with a null doc_id links with nothing and has a null component. An empty
    table gives an empty result; other columns are ignored.
    """
    placed = _placed(docs)
    torn = placed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    torn = written(torn.select("doc_id"), "torn")  # documents whose rows are in several components, which they join
    label = F.col("label")
    if not torn.isEmpty():
        joined = components(pick(placed, torn, "doc_id").select(F.col("doc_id").alias("src"), label.alias("dst")))
        placed, label = placed.join(joined, label == F.col("node"), "left"), F.coalesce("component", "label")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([key for _, key in words.keyed_sets(batch["text"])], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names[: batch.num_columns], KEY])


#: The column that holds the key of a row's set while rows of one id are told apart.
KEY = "_set_key"


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component of near copies: the one with the smallest doc_id.

    Texts are judged, not ids: of two texts under one doc_id the one that a smaller document is near goes, the other stays. Rows with the same doc_id and the
    same set of shingles stay or go together. Rows with a null doc_id, and null, empty and wordless texts, stay. The columns stay as they are.
    """
    placed = _placed(docs).filter("doc_id is not null")
    near = placed.filter("comp is not null")
    best = written(near.groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("best")), "best")
    gone = near.join(small(best, 80), "comp").select("doc_id", "key", (F.struct("doc_id", "key") != F.col("best")).alias("gone"))
    judged = written(placed.filter("comp is null").select("doc_id", "key", F.lit(False).alias("gone")).union(gone), "judged")  # rows without a component meet no join
    ids = written(judged.groupBy("doc_id").agg(F.every("gone").alias("whole"), F.some("gone").alias("some")).filter("some"), "gone")
    out = pick(docs, ids.filter("whole"), "doc_id", keep=False)
    parted = ids.filter("NOT whole").select("doc_id")
    if parted.isEmpty():
        return out
    shape = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField(KEY, T.BinaryType())])
    mixed = pick(out, parted, "doc_id").mapInArrow(_keyed, shape)
    drop = judged.filter("gone").select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct()
    kept = mixed.join(drop, (F.col("doc_id") == F.col("_gone_id")) & (F.col(KEY) == F.col("_gone_key")), "left_anti").drop(KEY)
    return pick(out, parted, "doc_id", keep=False).union(kept)
