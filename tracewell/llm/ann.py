"""Approximate nearest neighbours by an inverted multi-index.

Two codebooks quantise the two halves of every vector; a cell is a pair of centroids. For a query, pairs are taken from
a heap in order of summed nearness of the halves until the cells taken hold enough entries; queries and entries meet
by cell, entries are rescored with the original vectors, and each query keeps its best. Cells are split into blocks of
bounded size, so a value that a third of all rows share is many blocks, each answered on its own. Queries are dealt into
blocks as well, and every block of a cell meets every block of queries in a group of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE, BLOCK = 10_000, 2_000
#: Queries that meet a block of a cell at once, about.
QUERY_BLOCK = 10_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of the rows of ``x`` (at most ``k``; equal rows count once for the start)."""
    rng = np.random.default_rng(seed)
    start = np.unique(x, axis=0)
    centres = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        for c in range(len(centres)):
            if (mine := own == c).any():
                centres[c] = x[mine].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def cells_for(query: np.ndarray, first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed inner product of the halves with their centroids, until they hold ``enough`` entries.

    Both halves' centroids are sorted by nearness; the heap holds the pairs next to those taken, so that every pair
    comes after all nearer ones (ties: lower places first).
    """
    h = len(query) // 2
    a, b = first @ query[:h], second @ query[h:]
    p, q = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen, out, have = [(-(a[p[0]] + b[q[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(p[i]) * len(second) + int(q[j])
        if counts[cell]:
            out.append(cell)
            have += counts[cell]
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(p) and j2 < len(q) and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (-(a[p[i2]] + b[q[j2]]), i2, j2))
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) with v in double precision; without rows whose id or vector is null, or whose vector is empty, all
    zero or holds null or non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def search(vectors: DataFrame, is_query, k: int = 20, centroids: int = 16, share: float = 0.6, least: int = 4000, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (a Column over ``vec_id``) holds, the ``k``
    other rows of largest inner product found, nearest first, ties to the smaller id.

    The codebooks are fitted on at most ``sample`` rows (those of least hashed id); every row is indexed. A query looks
    at cells that hold ``share`` of all different vectors, and at least ``least`` of them. Rows without a usable vector take no part; a
    row with a query's own id is none of its candidates; rows of one id and vector count once. Query rows of one id
    with different vectors share one list, in which a candidate may stand once for each of them. Vectors must have one
    length; those that differ from the longest sampled take no part. Fewer candidates than ``k`` are all returned; an
    empty table gives none. Ids and the components of queries must fit their types; other columns are left out.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors, id_col, vec_col)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    if some.empty:
        return spark.createDataFrame([], schema)
    dims = max(map(len, some.v))
    x = np.stack([v for v in some.v if len(v) == dims])
    half = dims // 2
    books = kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)
    n_cells = len(books[0]) * len(books[1])

    def cell_of(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy())
        return pd.Series(nearest(m[:, :half], books[0]) * len(books[1]) + nearest(m[:, half:], books[1]))

    rows = rows.where(F.size("v") == dims).dropDuplicates(["vec_id", "v"])
    entries = rows.withColumn("cell", F.pandas_udf(cell_of, "bigint")("v"))
    counts, kinds = np.zeros(n_cells, np.int64), np.zeros(n_cells, np.int64)
    sizes = entries.groupBy("cell", F.xxhash64("v").alias("h")).agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    for r in sizes.collect():  # a row for each cell at most
        counts[r.cell], kinds[r.cell] = r.n, r.kinds
    enough = max(least, int(share * kinds.sum()))
    blocks = np.maximum(1, -(-counts // block))

    asking = rows.where(is_query)
    parts = max(1, -(-asking.count() // QUERY_BLOCK))

    def wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, at in ((f, at) for f in frames for at in range(0, len(f), 8)):
            f = whole.iloc[at : at + 8]
            out = [(q, v, c, s, p) for q, v, p in zip(f.vec_id, f.v, f.part, strict=True) for c in cells_for(np.asarray(v), *books, kinds, enough) for s in range(blocks[c])]
            yield pd.DataFrame(out, columns=["query_id", "q", "cell", "block", "part"])

    dealt = F.xxhash64("vec_id", "v")
    queries = asking.withColumn("part", F.pmod(dealt, F.lit(parts))).mapInPandas(wanted, "query_id bigint, q array<double>, cell bigint, block bigint, part bigint")
    n_blocks = F.get(F.lit(blocks.tolist()).cast("array<bigint>"), F.col("cell").cast("int"))
    entries = entries.withColumn("block", F.pmod(dealt, n_blocks)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))

    def best(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, m = held.vec_id.to_numpy(), np.stack(held.v.to_numpy())
        out = []
        for at in range(0, len(asked), 256):
            part = asked.iloc[at : at + 256]
            vectors = np.stack(part.q.to_numpy())
            for q, vector, s in zip(part.query_id, vectors, vectors @ m.T, strict=True):
                s[ids == q] = -np.inf
                near = np.flatnonzero((s >= np.partition(s, max(0, len(s) - k))[max(0, len(s) - k)] - 1e-9) & (ids != q))
                exact = (m[near] * vector).sum(axis=1)  # in one order of summing, so that equal vectors tie
                top = np.lexsort((ids[near], -exact))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near[top]], "score": exact[top]}))
        return pd.concat(out)

    found = queries.groupBy("cell", "block", "part").cogroup(entries.groupBy("cell", "block", "part")).applyInPandas(best, "query_id bigint, vec_id bigint, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
