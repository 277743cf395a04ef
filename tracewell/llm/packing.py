"""Packing of documents into token sequences along a space-filling curve.

One pass encodes every text, projects its hashed token counts to three dimensions and takes the Hilbert key of the
point; the rows are sorted by that key over ranges, and each range is filled into sequences in that order, so that a
sequence holds neighbours on the curve. Documents are cut at sequence ends. What a range leaves over is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import IdTable
from .bpe_coding import WORD_FILE, coder
from .common import written

BUCKETS, DIMS, BITS = 64, 3, 10


_tables: dict[str, IdTable] = {}


def encoded(path: str, column: pa.Array, end: int) -> list[bytes]:
    """Ids of each whole text and the end id, 16 bits each."""
    if path not in _tables:
        _tables[path] = IdTable(coder(path))
    tail = end.to_bytes(2, "little")
    return [ids.astype("<u2", copy=False).tobytes() + tail for ids in _tables[path].texts(column)]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of integer ``points`` (rows; coordinates below 2**bits).

    Each level, from the top bit down, turns the coordinates so that the curve enters and leaves the chosen cell as
    its parent does; the turned bits, Gray-decoded over the dimensions, make up the key.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            inside = (x[d] & high) != 0
            swap = np.where(inside, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(inside, low, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level & 1)
    return key


def curve_keys(rows: list[bytes]) -> np.ndarray:
    """Hilbert key of each row of ids: hashed token counts, scaled to length 1, projected to DIMS fixed directions."""
    directions = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    vectors = np.empty((len(rows), BUCKETS))
    for k, row in enumerate(rows):
        ids = np.frombuffer(row, "<u2").astype(np.uint32)
        vectors[k] = np.bincount((ids * np.uint32(2654435761)) >> np.uint32(26), minlength=BUCKETS)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    spread = 1 / (1 + np.exp(-2 * (vectors @ directions)))
    return hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def fill(rows: Iterator[tuple[int | None, bytes]], size: int, first: int, with_ids: bool) -> Iterator[tuple]:
    """Pieces (id, start, length, crc, tokens of the document, sequence, offset[, ids]) of rows in order."""
    held: list[tuple[int | None, int, np.ndarray, int]] = []  # pieces of the open sequence: id, start, ids, tokens
    have, sequence = 0, first

    def out(pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            yield (doc, start, len(ids), zlib.crc32(raw), total, sequence, at, *([raw] if with_ids else []))
            at += len(ids)

    for doc, row in rows:
        ids = np.frombuffer(row, "<u2")
        total, start = len(ids), 0
        while start < total:
            take = min(size - have, total - start)
            held.append((doc, start, ids[start : start + take], total))
            start, have = start + take, have + take
            if have == size:
                yield from out(held)
                held, have, sequence = [], 0, sequence + 1
    while have:
        part, room = [], 1 << have.bit_length() - 1
        while room:
            doc, start, ids, total = held.pop(0)
            part.append((doc, start, ids[:room], total))
            if len(ids) > room:
                held.insert(0, (doc, start + room, ids[room:], total))
            have -= len(part[-1][2])
            room -= len(part[-1][2])
        yield from out(part)
        sequence += 1


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, end: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Every id of every document lies in exactly one piece; a sequence's pieces follow each other without gaps and fill
    ``size`` (a power of two) or another power of two. A null or empty text is the end id alone. Rows with equal or
    null ids are packed as rows of their own, side by side. An empty table has no pieces. Other columns are left out.
    ``with_ids`` adds each piece's ids as little-endian 32-bit bytes. Ids of the tokenizer must be below 65536.
    """
    path = path or public_tokenizers.path(WORD_FILE)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                rows = encoded(path, part.column(1), end)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve_keys(rows)), pa.array(rows, pa.binary())], ["doc_id", "curve", "ids"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d.as_py(), i.as_py()) for b in batches for d, i in zip(b.column(0), b.column(1), strict=True))
        kept: list[tuple] = []
        for piece in fill(rows, size, TaskContext.get().partitionId() << 40, with_ids):
            kept.append(piece)
            if len(kept) == 4000:
                yield made(kept)
                kept = []
        if kept:
            yield made(kept)

    def made(pieces: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([*SCHEMA, *([pa.field("ids", pa.binary())] if with_ids else [])])
    rows = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id bigint, curve bigint, ids binary"), "packing")
    ordered = rows.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids").select("doc_id", "ids")
    return ordered.mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids binary" if with_ids else ""))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
