"""Helpers that several operators share: the shared scratch folder, words, hashes and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share (``spark.checkpoint.dir``). Where that is unset, a temporary folder
    does on a local master, as in tests; a cluster's executors could not see it, so there it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(scratch, "own", None) or tempfile.mkdtemp(prefix="tracewell-")
        scratch.own = base
    return f"{base}/tracewell/{name}-{uuid.uuid4().hex}"


#: Spark removes a finished query's shuffle files early when this is on.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and lost executors cost no more than the read."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        if df is not None:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of text that are hashed at once.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: A random value for each byte; with A-Z as a-z for texts that are lower-cased.
_EXACT = np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]


@lru_cache(None)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    up, down = (np.full(SLICE + 1, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _long_word(raw: np.ndarray, table: np.ndarray) -> int:
    total = 0
    for k in range(0, len(raw), SLICE):
        part = raw[k : k + SLICE]
        total += int((table[part] * _powers()[0][: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, k, 1 << 64)
    return total & (1 << 64) - 1


def _slices(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about SLICE, cut at document ends, else at white space, else after a longer word."""
    at = 0
    while at < len(raw):
        k = int(np.searchsorted(ends, at + SLICE, "right"))
        end = int(ends[k - 1]) if k else 0
        if end <= at:  # the document goes on beyond the slice
            limit = int(ends[np.searchsorted(ends, at, "right")])
            blank = np.flatnonzero(_BLANK[raw[at : min(limit, at + SLICE)]])
            end = at + int(blank[-1]) + 1 if len(blank) else at + SLICE
            while not len(blank) and end < limit:
                blank = np.flatnonzero(_BLANK[raw[end : min(limit, end + SLICE)]])
                end = end + int(blank[0]) if len(blank) else end + SLICE
            end = min(end, limit)
        yield at, end
        at = end


def word_hashes(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of a column of texts, a few documents at a time: (first document, one after the last, bounds, hashes,
    starts, ends, bytes), where document first + k has the words from bounds[k] to bounds[k + 1], word j has the 64-bit
    hash hashes[j] (of its bytes; A-Z count as a-z with ``fold``) and the bytes from starts[j] to ends[j]. A null text
    has no words. Documents longer than SLICE come alone."""
    table, (up, down) = _FOLDED if fold else _EXACT, _powers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if column.null_count:  # bytes under a null count for nothing
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if (np.diff(offsets) != sizes).any():
            yield from word_hashes(pc.fill_null(column, ""), fold)
            return
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        raw = whole[offsets[first] : offsets[last]]
        ends = offsets[first + 1 : last + 1] - offsets[first]
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in _slices(raw, ends):
            part = raw[a:b]
            word = ~_BLANK[part]
            edge = np.empty(len(part) + 1, bool)  # a word starts or ends here
            edge[0], edge[-1] = word[0], word[-1]
            np.not_equal(word[1:], word[:-1], out=edge[1:-1])
            places = np.flatnonzero(edge)
            starts, stops = places[::2], places[1::2]
            inner = ends[(ends > a) & (ends < b)] - a  # document ends within words
            inner = np.unique(inner[word[inner - 1] & word[inner]]) if len(inner) else inner
            if len(inner):
                starts, stops = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([stops, inner]))
            if len(part) > SLICE:
                h = np.array([_long_word(part[x:y], table) for x, y in zip(starts, stops, strict=True)], np.uint64)
            else:
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(table[part] * up[: len(part)], out=total[1:])
                h = (total[stops] - total[starts]) * down[starts]
            got.append((mixed(h ^ ((stops - starts).astype(np.uint64) << np.uint64(32))), starts + a, stops + a))
        hashes, starts, stops = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        yield first, last, np.searchsorted(starts, np.concatenate([[0], ends])), hashes, starts, stops, raw
        first = last


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its ``width``-word shingles (A-Z lower-cased); of all words as
    one shingle if there are fewer."""
    step = np.uint64(0xD6E8FEB86659FD93)
    for first, last, bounds, h, *_ in word_hashes(column):
        m = max(0, len(h) - width + 1)
        rolled = np.zeros(m, np.uint64)
        for k in range(width):
            rolled = rolled * step + h[k : k + m]
        rolled = mixed(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out = np.sort(rolled[a : b - width + 1])
                yield out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) > 1 else out
            elif b > a:
                value = np.zeros(1, np.uint64)
                for k in range(a, b):
                    value = value * step + h[k : k + 1]
                yield mixed(value)
            else:
                yield h[:0]


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs, either direction, no nulls) as ``(node, root)``, root being the
    least node of the component; a node without edges has no row. Every round takes the least label among a node's
    neighbours and then follows labels of labels, so paths shrink by half or more; each round's labels are a written
    table. A label that very many nodes have is a skewed key of a plain join only, which Spark splits."""
    both = written(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root")), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = written(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), f"{name}-step")
        done = step.where("root <> old").isEmpty()
        if done:
            forget(both, step)
            return labels
        roots = step.select("root").distinct()
        up = written(step.select(F.col("node").alias("root"), F.col("root").alias("up")).join(roots, "root", "left_semi"), f"{name}-roots")
        new = written(step.join(up, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")), f"{name}-labels")
        forget(labels, step, up)
        labels = new
