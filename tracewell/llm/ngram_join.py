"""N-gram Jaccard join: documents whose shingle sets are alike, and the groups that such links make.

Rows with equal sets form a class. Each class's shingles are put in one order for all, rare first by a sketch of
counts; by prefix filtering, classes that are alike share one of the first few. Classes meet on these, pass filters on
length, position and suffix (counts of the shingles after the shared one by hash range, and parities of the whole
sets), and each pair that is left is verified once on whole sets.

Classes that share a shingle meet in rounds. In each round a shingle has one centre, drawn anew for each shingle and
round, and the others meet it alone; links join groups, and classes of one group don't meet again. So a large group of
near copies is joined by as many pairs as it has rows. Only classes that are in different groups after that meet each
other, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forget, shingle_sets, written

#: The sketch of shingle counts has 2**SKETCH_BITS cells of one byte, whatever the input; it only orders shingles.
SKETCH_BITS, SLICES = 22, 64
#: Bits of the filter that leaves out documents that are in no pair before their sets are made.
PICK_BITS = 23
RANGES = 8
#: Longs that hold the parities of a set's shingles by hash range, 64 ranges each.
PARITIES = 4
#: Rounds in which classes meet the centres of their shingles before those still apart meet in blocks of BLOCK.
ROUNDS, BLOCK = 2, 1000
#: Prefix rows that are put in one batch for Spark, about.
ROWS = 50_000


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit key of a set: sum of its (well mixed) hashes, and its size."""
    return _signed((int(hashes.sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15 + int(np.bitwise_xor.reduce(hashes)) * 31 + len(hashes)))


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each of 64 * PARITIES hash ranges: whether the set has an odd number of hashes there. The number of bits
    that differ is at most the number of hashes that only one of two sets has."""
    odd = np.bincount((hashes >> np.uint64(64 - 6 - PARITIES.bit_length() + 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, own, n, cls, odd0.., slice, counts): a row for each of ``docs(doc_id, text, own)`` (cls null without words) with
    its set's parities, and each task's counts of shingles by hash cell, in slices."""
    cells = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint16)
        for batch in batches:
            n, keys, odd = [], [], []
            for hashes in shingle_sets(batch.column(1), width):
                n.append(len(hashes))
                keys.append(set_key(hashes) if len(hashes) else None)
                odd.append(parities(hashes))
                cell = (hashes & np.uint64(cells - 1)).astype(np.int64)
                counts[cell] += counts[cell] < 65535  # a document's cells count once each
            bits = np.frombuffer(b"".join(odd), np.int64).reshape(-1, PARITIES)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), *(pa.array(bits[:, k].copy()) for k in range(PARITIES)), none.cast(pa.int32()), none.cast(pa.binary())], names)
        packed = zstandard.ZstdCompressor(level=1)
        none = pa.nulls(1, pa.int64())
        for k, part in enumerate(np.split(counts, SLICES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([none] * (4 + PARITIES) + [pa.array([k], pa.int32()), pa.array([packed.compress(part.tobytes())])], names)

    odds = [f"odd{k}" for k in range(PARITIES)]
    names = ["doc_id", "own", "n", "cls", *odds, "slice", "counts"]
    return docs.mapInArrow(run, f"doc_id bigint, own bigint, n bigint, cls bigint, {', '.join(f'{o} bigint' for o in odds)}, slice int, counts binary")


def sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts on a log scale, a byte for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of the slices that this task has, SLICES at most
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zstandard.decompress(raw.as_py()), np.uint16).astype(np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(255, np.log2(1 + total.astype(float)) * 8).astype(np.uint8).tobytes()])], ["slice", "level"])

    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for r in rows.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(run, "slice int, level binary").collect():
        out[r.slice] = np.frombuffer(r.level, np.uint8)
    return out.ravel()


def prefixes(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(key, cls, n, pos, suffix): the first shingles of each document's set in the order of levels, enough that sets
    that are alike share one. ``suffix`` has the number of shingles after this one (255 at most) in each of 8 ranges."""
    held = docs.sparkSession.sparkContext.broadcast(levels.tobytes())
    shifts = np.arange(0, 64, 8, dtype=np.uint64)
    names = ["key", "cls", "n", "pos", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            rows = 0
            for hashes in shingle_sets(batch.column(0), width):
                n = len(hashes)
                if not n:
                    continue
                order = np.argsort(level[(hashes & np.uint64(len(level) - 1)).astype(np.int64)], kind="stable")  # hashes are sorted: ties by hash
                take = n - -(-n * percent // 100) + 1
                ordered = hashes[order]
                ranges = (ordered >> np.uint64(61)).astype(np.int64)
                gone = np.zeros((take, RANGES), np.int64)
                gone[np.arange(take), ranges[:take]] = 1
                rest = np.minimum(np.bincount(ranges, minlength=RANGES) - gone.cumsum(axis=0), 255).astype(np.uint64)
                out[0].append(ordered[:take].view(np.int64))
                out[1].append(np.full(take, set_key(hashes)))
                out[2].append(np.full(take, n, np.int32))
                out[3].append(np.arange(take, dtype=np.int32))
                out[4].append((rest << shifts).sum(axis=1, dtype=np.uint64).view(np.int64))
                rows += take
                if rows > ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)
                    out, rows = [[], [], [], [], []], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return docs.select("text").mapInArrow(run, "key bigint, cls bigint, n int, pos int, suffix bigint")


def _need(n1: Column, n2: Column, percent: int) -> Column:
    """Least number of shingles that alike sets of these sizes share."""
    return F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100.0 + percent) - 1e-9)


def _may_link(percent: int) -> Column:
    """Length, positional and suffix filters for rows a and b of one key. They hold for the first shingle that two
    sets share, so that a pair is left out only if none of its rows passes."""
    n1, n2, p = F.col("a.n"), F.col("b.n"), percent
    need = _need(n1, n2, p)
    rest1, rest2 = n1 - F.col("a.pos") - 1, n2 - F.col("b.pos") - 1
    apart = sum(F.abs(F.shiftrightunsigned("a.suffix", 8 * k).bitwiseAND(255) - F.shiftrightunsigned("b.suffix", 8 * k).bitwiseAND(255)) for k in range(RANGES))
    odd = sum(F.bit_count(F.col(f"a.odd{k}").bitwiseXOR(F.col(f"b.odd{k}"))) for k in range(PARITIES))
    return (100 * F.least(n1, n2) >= p * F.greatest(n1, n2)) & (1 + F.least(rest1, rest2) >= need) & (2 + rest1 + rest2 - apart >= 2 * need) & (n1 + n2 - odd >= 2 * need)


def _pick(ids: DataFrame) -> bytes:
    """A bit for each hashed id, as a fixed number of bytes."""
    cell = F.pmod(F.xxhash64("id"), F.lit(1 << PICK_BITS))
    bits = np.zeros(1 << PICK_BITS - 6, np.int64)
    rows = ids.select(F.shiftright(cell, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), cell.bitwiseAND(63).cast("int")).alias("m"))
    for r in rows.groupBy("w").agg(F.bit_or("m").alias("m")).collect():  # 2**17 rows at most
        bits[r.w] = r.m
    return bits.tobytes()


def class_sets(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cls, shingles): the sets of ``classes(cls, own)``, each from a document of the class. Rows that share ``own``
    with it are read too, and left out by their class."""
    held = docs.sparkSession.sparkContext.broadcast(_pick(classes.select(F.col("own").alias("id"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.flatnonzero((bits[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1))
            keys, made, size = [], [], 0
            for hashes in shingle_sets(batch.column(1).take(pa.array(keep)), width):
                if len(hashes):
                    keys.append(set_key(hashes))
                    made.append(hashes.view(np.int64))
                    size += len(hashes)
                if size > ROWS:
                    yield batched(keys, made)
                    keys, made, size = [], [], 0
            if keys:
                yield batched(keys, made)

    def batched(keys: list[int], made: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))], ["cls", "shingles"])

    rows = docs.select(F.pmod(F.xxhash64("own"), F.lit(1 << PICK_BITS)).alias("cell"), "text")
    made = rows.mapInArrow(sets, "cls bigint, shingles array<bigint>").join(classes.select("cls"), "cls", "left_semi")
    return written(made.dropDuplicates(["cls"]), "ngram-sets")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` (classes) whose whole sets are alike. Only the sets of classes in pairs are made."""
    drawn = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "own"), "cls")
    sets = class_sets(written(drawn, "ngram-drawn"), docs, width)
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("bigint")
    out = written(both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"), "ngram-links")
    forget(sets)
    return out


def _pairs(met: DataFrame, ok: Column, known: list[DataFrame]) -> DataFrame:
    """Pairs of classes (a < b) in rows a and b that met, of different groups, that pass the filters and are not among ``known``."""
    new = met.where((F.col("a.root") != F.col("b.root")) & ok).select(F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b")).distinct()
    for before in known:
        new = new.join(before, ["a", "b"], "left_anti")
    return written(new, "ngram-pairs")


def _rooted(live: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``live`` with its classes' groups."""
    if groups is None:
        return live.withColumn("root", F.col("cls"))
    return live.join(groups.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _open(rows: DataFrame) -> DataFrame:
    """(key, main, n_rows): keys with classes of several groups, the group of most of its rows, and their number."""
    by_group = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    return by_group.groupBy("key").agg(F.max_by("root", "c").alias("main"), F.sum("c").alias("n_rows"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")


def linked(live: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, root) of the classes of ``live`` (key, cls, n, pos, suffix, parities) that have links; None without any.

    After the rounds, rows outside their key's largest group meet all rows of other groups, every block of rows every
    other block in a group of its own.
    """
    ok = _may_link(percent)
    odds = [f"odd{k}" for k in range(PARITIES)]
    links: list[DataFrame] = []
    known: list[DataFrame] = []
    groups, rows, last = None, _rooted(live, None), False
    while not last:
        last = len(known) == ROUNDS or len(known) > len(links)  # a round without links is the last one
        if not last:
            near = F.col("cls").bitwiseXOR(F.xxhash64("key", F.lit(len(known))))  # the centre is the class nearest to a number drawn for the shingle
            centre = rows.groupBy("key").agg(F.min_by(F.struct("cls", "n", "pos", "suffix", *odds, "root"), near).alias("b"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("c"))
            keys = written(centre.where("r1 <> r2").select("key", "b", "c"), "ngram-centres")
            new = _pairs(rows.alias("a").join(keys, "key"), ok, known)
        else:
            keys = written(_open(rows), "ngram-open")
            opened = rows.join(keys, "key")
            blocks = F.ceil(F.col("n_rows") / BLOCK)
            i = F.pmod(F.xxhash64("cls"), blocks)
            every = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
            apart = opened.where("root <> main").withColumn("i", i).withColumn("j", every)
            other = opened.withColumn("j", i).withColumn("i", every)
            once = (F.col("b.root") == F.col("b.main")) | (F.col("a.cls") < F.col("b.cls"))
            new = _pairs(apart.alias("a").join(other.alias("b"), ["key", "i", "j"]), ok & once, known)
        known.append(new)
        if not new.isEmpty() and not (found := verified(new, classes, docs, width, percent)).isEmpty():
            links.append(found)
            groups = components(reduce(DataFrame.union, links).select(F.col("a").alias("u"), F.col("b").alias("v")), "ngram-groups")
        if not last:  # two classes have met by now, and are done with their shingle
            was, rows = rows, written(_rooted(rows.drop("root").join(keys.where("c > 2").select("key"), "key", "left_semi"), groups), "ngram-rooted")
            forget(was if len(known) > 1 else None)
        forget(keys)
    forget(*known, *links)
    return groups


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set of ``width``-word shingles (A-Z lower-cased;
    the whole sequence as one with fewer words) and the least id that links lead to. Two rows are linked when
    100 * intersection >= percent * union.

    A text without words, or null, has no shingles and is linked with nothing; so its component is its own id. Rows of
    one id are nodes of their own, and rows without one link like others: a component is named by its least id, null
    if no row has one. Other columns are left out.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("own", F.coalesce("doc_id", F.xxhash64("text")))  # finds a class's texts again; need not be unique
    odds = [f"odd{k}" for k in range(PARITIES)]
    rows = written(profiles(docs, width), "ngram-profiles")
    nodes = rows.where("slice is null").select("doc_id", "n", "cls")
    classes = rows.where("slice is null and cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("own").alias("own"), *(F.first(o).alias(o) for o in odds))
    classes = written(classes, "ngram-classes")
    keys = written(prefixes(docs, width, percent, sketch(rows)), "ngram-prefixes")
    # keys of two classes or more, and the size of their least set
    met = keys.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.min("n").alias("least")).where("low <> high").select("key", "least")
    met = written(met, "ngram-met")
    # a row can link only if enough shingles are left for the least partner there may be
    fits = F.col("n") - F.col("pos") >= _need(F.col("n"), F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100)), percent)
    live = keys.join(met, "key").where(fits).select("key", "cls", "n", "pos", "suffix").dropDuplicates(["key", "cls"])
    live = written(live.join(classes.drop("doc_id", "own"), "cls"), "ngram-live")
    forget(keys, met)
    groups = linked(live, classes, docs, width, percent)
    forget(live)
    roots = _rooted(classes.select("cls", "doc_id"), groups)
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = roots.join(least, "root").select("cls", "component_id")
    out = nodes.where("cls is not null").join(by_class, "cls", "left").select("doc_id", "n", "component_id")
    lone = nodes.where("cls is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.union(lone).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90)
