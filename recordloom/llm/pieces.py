"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece crosses from other characters into a space marker, a text is cut before each run of markers, and its pieces are those of its chunks one
after the other. Texts are gathered in blocks of bounded size. A block becomes its distinct chunks and, for each text, the places of its chunks among
them. The chunks of all blocks are dealt by their hash; each part of that table of distinct chunks segments a chunk when it first meets it. The ids come
back to their block, and are set in by position. A chunk reaches the table once a block at most, so a frequent word makes no large group. Blocks are made
twice from the texts, once for the chunks and once for the places, both compressed, which takes less room than to store them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.tables import written

MARK = "▁"
#: Characters of the texts of a block (a longer text is a block alone), and bytes of text for each part of the table of chunks.
BLOCK_CHARS, PART_BYTES = 8 << 20, 16 << 20
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


@lru_cache(maxsize=2)
def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """The library's processor; models are given as bytes, so that executors need no file."""
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def check_separable(model: bytes) -> None:
    """Raise ValueError unless texts are kept as they are but for markers (one more in front), and no piece has a marker after another character."""
    sp = processor(model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    kept = all(sp.normalize(t) == MARK + t.replace(" ", MARK) for t in ("a", " a  b ", "\n\t\x00", "ﬁ　﻿éé", f"x{MARK}y", "Aa"))
    if crossing or not kept or sp.piece_to_id(MARK) == sp.unk_id():
        raise ValueError("pieces of this model can cross space markers, or its texts are changed: chunks can't be segmented alone")


def chunks(text: str | None) -> list[str]:
    """The marked chunks of a text."""
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def segmented(sp: sentencepiece.SentencePieceProcessor, some: list[str]) -> list[list[int]]:
    """The ids of chunks; the library sets the first marker itself, but makes nothing of an empty text."""
    lone = [sp.piece_to_id(MARK)]
    return [ids or lone for ids in sp.encode([c[1:] for c in some], num_threads=1)]


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as four planes of bytes, the lowest first (what compresses well lies together), compressed."""
    return pressed(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpressed(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pressed(data: bytes) -> bytes:
    """Bytes compressed, after their length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpressed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _schema(docs: DataFrame, kept: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, docs.schema[c].dataType) for c in kept])


def _blocks(kept: list[str], text: str, parts: int, block_chars: int):
    """Rows of two kinds for each block: under the block's key a text with the places of its chunks in the block's list, and under a key below 0, which
    stands for a part of the table, the block's chunks that fall there with their places."""

    def block(batches: list[pa.RecordBatch], spots: list[bytes], table: dict[str, int], number: int) -> Iterator[pa.RecordBatch]:
        docs = pa.Table.from_batches(batches).select(kept)
        own = [pa.array([number] * len(spots), pa.int64()), pa.array([number] * len(spots), pa.int64()), pa.array(spots, pa.binary()), pa.nulls(len(spots), pa.binary())]
        yield pa.RecordBatch.from_arrays([*(c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in docs.columns), *own], [*kept, "key", "block", "spots", "chunks"])
        found = list(table)
        part = np.fromiter((crc32(c.encode()) % parts for c in found), np.int64, len(found))
        order = np.argsort(part, kind="stable")
        used, first = np.unique(part[order], return_index=True)
        shares = np.split(order, first[1:]) if len(found) else []
        said = [pressed(" ".join(found[i] for i in s.tolist()).encode()) for s in shares]
        own = [pa.array(-1 - used, pa.int64()), pa.array([number] * len(used), pa.int64()), pa.array([packed(np.diff(s, prepend=0)) for s in shares], pa.binary()), pa.array(said, pa.binary())]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), c.type) for c in docs.columns), *own], [*kept, "key", "block", "spots", "chunks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = TaskContext.get().partitionId(), 0
        held, spots, table, chars = [], [], {}, 0
        for batch in batches:
            first = 0
            for i, t in enumerate(batch[text].to_pylist()):
                spots.append(packed(np.array([table.setdefault(c, len(table)) for c in chunks(t)], np.int64)))
                chars += len(t or "")
                if chars >= block_chars:  # at a row, so that blocks don't depend on how rows came in batches
                    yield from block([*held, batch.slice(first, i + 1 - first)], spots, table, (part << 32) + blocks)
                    held, spots, table, chars, blocks, first = [], [], {}, 0, blocks + 1, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if spots:
            yield from block(held, spots, table, (part << 32) + blocks)

    return run


def _segment(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known = processor(model), {}  # the distinct chunks of this part of the table
        for batch in batches:
            sizes, ids = [], []
            for said in batch["chunks"].to_pylist():
                some = unpressed(said).decode().split(" ")
                new = [c for c in some if c not in known]
                known.update(zip(new, (array("I", x).tobytes() for x in segmented(sp, new)) if new else ()))
                found = [known[c] for c in some]
                sizes.append(packed(np.fromiter(map(len, found), np.int64, len(found)) >> 2))
                ids.append(packed(np.frombuffer(b"".join(found), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch["block"], batch["spots"], pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["key", "spots", "sizes", "ids"])

    return run


def _join(kept: list[str], out: str):
    def run(docs: pa.Table, dealt: pa.Table) -> pa.Table:
        shares = [tuple(map(unpacked, x)) for x in zip(*(dealt[c].to_pylist() for c in ("spots", "sizes", "ids")))]
        shares = [(np.cumsum(spots), sizes, ids) for spots, sizes, ids in shares]
        spots, sizes, ids = (np.concatenate([np.zeros(0, np.int64), *(s[k] for s in shares)]).astype(np.int64) for k in range(3))
        size, first = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
        size[spots], first[spots] = sizes, np.cumsum(sizes) - sizes
        found, ends = [], [0]
        for said in docs["spots"].to_pylist():
            place = unpacked(said).astype(np.int64)
            n = size[place]
            total = int(n.sum())
            found.append(ids[np.arange(total) + np.repeat(first[place] - np.cumsum(n) + n, n)].astype(np.int32))
            ends.append(ends[-1] + total)
        column = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32())).cast(pa.list_(pa.int32()))
        return pa.table([*(docs[c] for c in kept), column], names=[*kept, out])

    return run


def encode(docs: DataFrame, model: bytes, block_chars: int = BLOCK_CHARS, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with ids, the piece ids of every whole text, in place of text: as the library encodes it, without begin or end ids and without sampling.

    Null and empty texts have no ids. Repeated rows and repeated or null ids are treated alike, each row by its own text; an empty table gives an empty
    result. A column of docs named ids is replaced, all others but text stay, whatever their names. ValueError if the model's pieces can cross markers.
    """
    check_separable(model)
    kept = [c for c in docs.columns if c.lower() not in ("text", "ids")]
    text = next(c for c in docs.columns if c.lower() == "text")
    inner = {c: f"kept{i}" for i, c in enumerate(kept)}  # names that clash with none of ours
    slim = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in kept], F.col(f"`{text}`").alias("text"))
    if "Exchange" in slim._jdf.queryExecution().executedPlan().toString():
        slim = written(slim, "texts")  # rows of a shuffle may come in another order when a lost part is made again, and blocks would differ
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    columns = list(inner.values())
    schema = _schema(slim, columns)
    made = T.StructType([*schema, *T._parse_datatype_string("key long, block long, spots binary, chunks binary")])
    blocks = slim.mapInArrow(_blocks(columns, "text", parts, block_chars), made).repartition(2 * parts, "key")
    dealt = blocks.filter("key < 0").select("block", "spots", "chunks").mapInArrow(_segment(model), "key long, spots binary, sizes binary, ids binary")
    rows = blocks.filter("key >= 0").drop("block", "chunks")
    out = rows.groupBy("key").cogroup(dealt.groupBy("key")).applyInArrow(_join(columns, "ids"), T.StructType([*schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.select(*[F.col(inner[c]).alias(c) for c in kept], "ids")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded with a column text, the library's decoding of the column ids; null and empty ids give an empty text, a column named text is replaced."""
    kept = [c for c in encoded.columns if c.lower() != "text"]
    encoded = encoded.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            ids = batch[kept.index("ids")]
            ends, flat = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), ids.flatten().to_numpy(zero_copy_only=False)
            texts = pa.array((sp.decode(flat[a:b].tolist()) if a < b else "" for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())), pa.string())  # one list of numbers at a time
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*kept, "text"])

    return encoded.mapInArrow(run, T.StructType([*_schema(encoded, kept), T.StructField("text", T.StringType())]))
