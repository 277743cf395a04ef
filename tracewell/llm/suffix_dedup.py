"""Removal of byte strings that repeat, within and across documents, by suffix sorting with bucket pointers.

A string of LENGTH bytes that repeats has, at each of its places, the same anchor: the q-gram of least hash among those
in it. Anchors that occur once are dropped by one count over all; around the others, the starts whose every anchor
repeats make contexts. Contexts with equal bytes are one but for the first. Those that differ and share an anchor
meet in a task, which sorts their suffixes by bucket-pointer refinement: the first buckets are those of q-grams, and
buckets are refined by sorting on the bucket pointers at later offsets, each refinement reusing the last one's
pointers, until LENGTH bytes are told apart. A bucket of more contexts than a task sorts is refined by tables first: its
contexts are dealt into the buckets of longer shared strings, equal ones again but for the first, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, written

GRAM = 24
#: Bytes that are looked at at once; longer documents are looked at in parts that overlap by LENGTH - 1.
PART = 1 << 21
#: Contexts of one bucket that one task sorts; one with more is dealt into buckets of longer strings first.
MOST_CONTEXTS = 2000
#: Bytes of contexts after which a task sorts what it has, at the next anchor.
BATCH = 1 << 19
#: Keys that more than a HOT-th of all rows share (so fewer than HOT keys) are broadcast instead of dealt out.
HOT = 1000


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (8 or more) at each place."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    out = np.zeros(n, np.uint64)
    for k in range(0, size - 7, 8):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n] * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(32)
    for k in range(size // 8 * 8, size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + raw[k : k + n].astype(np.uint64)
    return mixed(out)


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of ``length`` bytes, the place of its anchor (leftmost of equals); all gram hashes."""
    h = grams(raw, GRAM)
    width = length - GRAM + 1
    if len(h) < width:
        return np.empty(0, np.int64), h
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    low, span = key, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: len(h) - width + 1], low[width - span : width - span + len(h) - width + 1])
    return (low & np.uint64(0xFFFFFF)).astype(np.int64), h


def parts(raw: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of parts in which every string of ``length`` bytes lies whole once."""
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(1, len(data) - length + 1), PART):
        yield at, data[at : at + PART + length - 1]


def found_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(h, v, pos) of all anchors of ``docs(v, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d, p = [], [], []
            for version, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                for at, data in parts(raw, length):
                    places, hashes = anchors(data, length)
                    places = places[np.flatnonzero(np.diff(places, prepend=-1))]
                    h.append(hashes[places].view(np.int64))
                    d.append(np.full(len(places), version, np.int64))
                    p.append(places + at)
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (h, d, p)], ["h", "v", "pos"])

    return docs.mapInArrow(run, "h bigint, v bigint, pos bigint")


def contexts(marked: DataFrame, length: int) -> DataFrame:
    """(h, doc_id, th, start, ctx): bytes around each repeated anchor of ``marked(doc_id, th, text, marks)``; a string
    starts at each place from ``start`` on but the last length - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, th, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                marks = marks.values.to_numpy()
                for at, data in parts(raw, length):
                    places, hashes = anchors(data, length)
                    if not len(places):
                        continue
                    cut = np.flatnonzero(np.diff(places, prepend=-1))
                    ends = np.append(cut[1:], len(places))
                    good = np.isin(places[cut] + at, marks)
                    cut, ends = cut[good], ends[good]
                    body = data.tobytes()
                    out[0] += hashes[places[cut]].view(np.int64).tolist()
                    out[1] += [doc] * len(cut)
                    out[2] += [th] * len(cut)
                    out[3] += (cut + at).tolist()
                    out[4] += [body[s : e + length - 1] for s, e in zip(cut.tolist(), ends.tolist(), strict=True)]
                    if len(out[0]) > 20000:
                        yield made(out)
                        out = [[], [], [], [], []]
            if out[0]:
                yield made(out)

    def made(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["h", "doc_id", "th", "start", "ctx"])

    return marked.mapInArrow(run, "h bigint, doc_id bigint, th bigint, start bigint, ctx binary")


def refine(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each of ``starts`` that is equal for equal strings of ``length`` bytes (a multiple of 4).

    Pointers hold the bucket of every place, first by q-gram. A round sorts the places in buckets of two or more by
    (own pointer, pointer at the depth reached so far), and writes back the buckets found; since those pointers are
    refined themselves, the depth doubles with each round. Places in buckets of one are not sorted again.
    """
    q = length // 4
    first = grams(raw, q)
    pointer = np.full(len(raw), -1, np.int64)
    _, pointer[: len(first)], count = np.unique(first, return_inverse=True, return_counts=True)
    depth = q
    while depth < length:
        own = pointer[: len(first)]
        step = min(depth, length - depth)
        again = np.flatnonzero(np.bincount(own)[own] > 1)
        later = np.where(again + step < len(raw), pointer[np.minimum(again + step, len(raw) - 1)], -1)
        order = np.lexsort((later, own[again]))
        a, b = own[again][order], later[order]
        new = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(order) else order
        fresh = pointer.copy()
        fresh[again[order]] = pointer.max() + new
        pointer = fresh
        depth += step
    return pointer[starts]


def _removed(rows: list[tuple], length: int) -> Iterator[tuple]:
    """Runs (doc_id, th, first start, last start + 1) of strings that occur earlier among ``rows`` (doc_id, th, start, ctx)."""
    sizes = np.array([len(r[3]) for r in rows])
    raw = np.frombuffer(b"".join([r[3] for r in rows]), np.uint8)
    offset = np.concatenate([[0], sizes.cumsum()])[:-1]
    n = sizes - length + 1
    which = np.repeat(np.arange(len(rows)), n)
    inner = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    bucket = refine(raw, offset[which] + inner, length)
    doc, start = np.array([r[0] for r in rows], np.int64)[which], np.array([r[2] for r in rows], np.int64)[which] + inner
    order = np.lexsort((start, doc, bucket))
    b, d, s = bucket[order], doc[order], start[order]
    fresh = np.concatenate([[True], b[1:] != b[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(b)), 0))
    later = np.zeros(len(b), bool)
    later[order] = (d != d[first]) | (s != s[first])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], later.astype(np.int8)])) | (np.diff(which, prepend=-1) != 0))
    for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(later)], strict=True):
        if later[x]:
            r = rows[which[x]]
            yield r[0], r[1], r[2] + int(inner[x]), r[2] + int(inner[x]) + y - x


RUNS = "doc_id bigint, th bigint, a bigint, b bigint"


def sorted_runs(rows: DataFrame, length: int) -> DataFrame:
    """Runs to remove among ``rows(h, doc_id, th, start, ctx)``, each anchor's rows in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for h, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if h != last and size > BATCH:
                    yield made(held)
                    held, size = [], 0
                held.append(tuple(row))
                size, last = size + len(row[3]), h
        if held:
            yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        runs = list(_removed(held, length))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in runs], pa.int64()) for k in range(4)], ["doc_id", "th", "a", "b"])

    return rows.repartition("h").sortWithinPartitions("h").select("h", "doc_id", "th", "start", "ctx").mapInArrow(run, RUNS)


def halved(rows: DataFrame, length: int) -> DataFrame:
    """The contexts of ``rows(h, doc_id, th, start, ctx, lo, hi)`` in buckets of a later offset, with the new bucket as ``h``.

    A context's strings have their anchor from ``lo`` to ``hi`` - 1 bytes after their start, so all hold the ``lo``
    bytes before it and some after it. Half of that range fixes more bytes on one side or the other: each context gives
    at most two. The bucket so far stands for the bytes fixed before, so the new one is made of it and of the bytes at the
    offsets just fixed; no byte is looked at twice. At a range of one, the bytes fixed are the whole string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for was, doc, th, start, ctx, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                at = int(anchors(np.frombuffer(ctx, np.uint8), length)[0][0])
                mid = (lo + hi) // 2
                fixed = (at + length - hi + 1, at + length - mid + 1), (at - mid, at - lo)
                for (low, high), (a, b) in zip(((lo, mid), (mid, hi)), fixed, strict=True):
                    first, last = max(0, at - high + 1), min(len(ctx) - length, at - low)
                    if low < high and first <= last:
                        h = xxhash.xxh3_64_intdigest(ctx[a:b], seed=(was * 0x9E3779B97F4A7C15 + (low << 32 | high)) & (1 << 64) - 1)
                        values = (h - (1 << 64) if h >> 63 else h, doc, th, start + first, ctx[first : last + length], low, high)
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["h", "doc_id", "th", "start", "ctx", "lo", "hi"])

    return rows.mapInArrow(run, "h bigint, doc_id bigint, th bigint, start bigint, ctx binary, lo int, hi int")


_LAST = (1 << 63) - 1


def counted_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` (a written table) joined with ``table(*keys, n, ...)``, which has a row for a key and in ``n`` its number
    of rows in ``rows``. Rows of a hot key stay where they are."""
    often = F.col("n") > rows.count() / HOT
    hot = F.broadcast(table.where(often).drop("n"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(~often).drop("n"), keys, how)
    return rows.join(hot, keys, how).unionByName(rest)


def repeated_runs(docs: DataFrame, length: int, most: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, th, runs): for each document with any, the ranges of starts of strings that occur earlier."""
    # marks go by a number of id and text, so that many rows of one id are not one group; texts that share a number
    # share their marks, which adds contexts that repeat nowhere and takes none away
    docs = docs.withColumn("v", F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 40)))
    found = written(found_anchors(docs.select("v", "text"), length), "suffix-anchors")
    again = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "suffix-again")
    marks = written(counted_join(found, again, ["h"], "left_semi").groupBy("v").agg(F.collect_set("pos").alias("marks")), "suffix-marks")
    rows, runs, span = contexts(docs.join(marks, "v").select("doc_id", "th", "text", "marks"), length), [], []
    while rows is not None:
        rows = written(rows.withColumn("same", F.xxhash64("ctx")).withColumn("size", F.octet_length("ctx")), "suffix-contexts")
        # equal contexts of one bucket: all but the first go
        firsts = rows.groupBy("h", "same").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
        firsts = written(firsts, "suffix-firsts")
        copied = counted_join(rows.select("h", "same", "doc_id", "th", "start", "size"), firsts.where("n > 1"), ["h", "same"], "inner")
        whole = copied.where(F.struct("doc_id", "start") != F.col("first"))
        runs.append(whole.select("doc_id", "th", F.col("start").alias("a"), (F.col("start") + F.col("size") - (length - 1)).alias("b")))
        # contexts of one bucket that differ
        many = firsts.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
        differ = firsts.join(many, "h").select("h", "same", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "kinds")
        differ = written(rows.join(differ, ["h", "same", "doc_id", "start"]).select("h", "doc_id", "th", "start", "ctx", "kinds", *span), "suffix-differ")
        runs.append(sorted_runs(differ.where(F.col("kinds") <= most), length))
        hot = differ.where(F.col("kinds") > most)
        if not span:  # at first, the anchor is anywhere in a string
            hot = hot.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - GRAM + 1))
        span = ["lo", "hi"]
        rows = None if hot.isEmpty() else halved(hot.select("h", "doc_id", "th", "start", "ctx", *span), length)
    every = reduce(DataFrame.union, runs)
    # repeated rows have the same ranges, which count once
    return written(every.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("runs")), "suffix-runs")


def removed_spans(runs: list, length: int) -> list[tuple[int, int]]:
    """Ranges of starts as disjoint, maximal ranges of bytes."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + length - 1) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_runs(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a column ``_runs`` (null: nothing to remove)."""
    if length % 4 or length < 2 * GRAM:
        raise ValueError("length must be a multiple of 4, and twice GRAM at least")
    key = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("_d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th")]
    runs = repeated_runs(docs.select(key[0].alias("doc_id"), key[1].alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), length)
    runs = runs.select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), F.col("runs").alias("_runs"))
    return docs.select("*", *key).join(runs, ["_d", "_th"], "left").drop("_d", "_th")


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row, judged on the texts' UTF-8 bytes: each byte
    goes that is covered by a string of ``length`` bytes that also starts earlier, in a row of smaller id or before in
    the same row.

    A null text is an empty one. Rows with a null id come after all others, and count as rows of one id. Rows of one id
    are one document's versions: a string at one place in two of them starts earlier in neither. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = removed_spans(runs.as_py() or [], length)
                at, kept = 0, []
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out[0].append(len(raw))
                out[1].append(sum(b - a for a, b in spans))
                out[2].append(len(spans))
                out[3].append(sha256(b"".join(kept)).hexdigest())
                out[4].append([list(s) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.list_(pa.int64())))], names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = with_runs(docs.select(id_col, text_col), length, id_col, text_col)
    return rows.select(id_col, text_col, "_runs").mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>")


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut from the text; of a character that is cut in part, nothing stays. A null text stays null."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, runs, strict=True):
            if text is not None and own is not None:
                raw, at, left = text.encode("utf-8", "surrogatepass"), 0, []
                for a, b in removed_spans(own, length):
                    left.append(raw[at:a])
                    at = b
                text = b"".join([x.decode("utf-8", "ignore").encode() for x in [*left, raw[at:]]]).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    rows = with_runs(docs, length, id_col, text_col)
    return rows.withColumn(text_col, kept(F.col(text_col), F.col("_runs"))).drop("_runs")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
