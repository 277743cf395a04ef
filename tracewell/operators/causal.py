"""Root-cause ranking on a graph that is found from the series themselves.

Sums of products of the nodes' daily changes are taken in Spark; a run's correlations (nodes x nodes, whatever the number
of days) go to one task, which removes links by partial correlations, orients the rest and walks along it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .detect import NODE
from .rank import ranked


def changes(series: DataFrame) -> DataFrame:
    """(run_id, node_id, t, z): differences of log(max(|value|, 1e-8)) from one known value to the next, brought to mean
    0 and deviation 1 (0 where they don't vary)."""
    by, whole = Window.partitionBy(*NODE).orderBy("t"), Window.partitionBy(*NODE)
    d = series.where("value is not null").withColumn("l", F.log(F.greatest(F.abs("value"), F.lit(1e-8)))).withColumn("d", F.col("l") - F.lag("l").over(by)).where("d is not null")
    return d.select(*NODE, "t", ((F.col("d") - F.avg("d").over(whole)) / (F.stddev_pop("d").over(whole) + 1e-8)).alias("z"))


def products(change: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, n, cells): days of each run, and for each pair of nodes (by node_ord) the sum of products of their
    changes; a day without a change counts as the mean. Tasks add up their own days first."""
    placed = change.join(F.broadcast(nodes.select("node_id", "node_ord")), "node_id")
    days = placed.groupBy("run_id", "t").agg(F.collect_list("node_ord").alias("k"), F.collect_list("z").alias("z"))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for run, part in f.groupby("run_id"):
                x = np.zeros((len(part), max(int(max(k)) for k in part.k) + 1))
                for row, k, z in zip(x, part.k, part.z, strict=True):
                    row[np.asarray(k, int)] = z
                s = x.T @ x
                i, j = np.nonzero(np.triu(s))
                yield pd.DataFrame({"run_id": run, "i": i, "j": j, "s": s[i, j], "n": len(part)})

    sums = days.mapInPandas(partial, "run_id string, i int, j int, s double, n bigint").groupBy("run_id", "i", "j").agg(F.sum("s").alias("s"))
    cells = sums.groupBy("run_id").agg(F.collect_list(F.struct("i", "j", "s")).alias("cells"))
    return days.groupBy("run_id").agg(F.count("*").alias("n")).join(cells, "run_id")


def partial_correlations(r: np.ndarray, i: int, j: int, sets: np.ndarray) -> np.ndarray:
    """Correlation of i and j given each row of ``sets``; NaN where a set and the two are linearly dependent."""
    at = np.hstack([np.full((len(sets), 1), i), np.full((len(sets), 1), j), sets])
    m = r[at[:, :, None], at[:, None, :]]
    fine = np.linalg.det(m) > 1e-10
    out = np.full(len(sets), np.nan)
    if fine.any():
        inverse = np.linalg.inv(m[fine])
        out[fine] = -inverse[:, 0, 1] / np.sqrt(inverse[:, 0, 0] * inverse[:, 1, 1])
    return out


def skeleton(r: np.ndarray, n: int, alpha: float = 0.05, depth: int = 3) -> tuple[np.ndarray, dict]:
    """Links that no set of up to ``depth`` neighbours explains, and the set that explained each pair without one.
    Neighbours are those at the start of a depth, so the order of nodes does not matter to the links."""
    limit = NormalDist().inv_cdf(1 - alpha / 2)
    linked = ~np.eye(len(r), dtype=bool)
    apart: dict[tuple[int, int], tuple] = {}
    for size in range(depth + 1):
        if n - size - 3 <= 0:
            break
        near = [np.flatnonzero(row) for row in linked]
        for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
            for a, b in ((i, j), (j, i)):
                sets = list(combinations(near[a][near[a] != b].tolist(), size))
                if not linked[i, j] or not sets:
                    continue
                rho = np.clip(partial_correlations(r, i, j, np.array(sets, int).reshape(len(sets), size)), -1 + 1e-12, 1 - 1e-12)
                free = np.flatnonzero(np.abs(np.arctanh(rho)) * np.sqrt(n - size - 3) < limit)
                if len(free):
                    linked[i, j] = linked[j, i] = False
                    apart[i, j] = sets[free[0]]
    return linked, apart


def oriented(linked: np.ndarray, apart: dict, layer: np.ndarray) -> np.ndarray:
    """Edges i -> j: colliders first (none turns an edge round), then what follows without new colliders or cycles, then
    the rest from the lower layer to the higher; within one layer the rest is dropped."""
    way = linked.copy()  # both directions: not decided
    n = len(way)
    for i, j in sorted(apart):
        for k in np.flatnonzero(linked[i] & linked[j]).tolist():
            if k not in apart[i, j] and way[i, k] and way[j, k]:
                way[k, i] = way[k, j] = False
    moved = True
    while moved:
        moved = False
        one = way & ~way.T
        for i, j in np.argwhere(way & way.T).tolist():
            if not (way[i, j] and way[j, i]):
                continue
            chain = (one[:, i] & ~linked[:, j] & (np.arange(n) != j)).any()
            circle = (one[i] & one[:, j]).any()
            both = np.flatnonzero(way[i] & way[:, i] & one[:, j])
            kites = any(not linked[a, b] for a, b in combinations(both.tolist(), 2))
            if chain or circle or kites:
                way[j, i] = False
                one = way & ~way.T
                moved = True
    open_ = way & way.T
    return (way & ~open_) | (open_ & (layer[:, None] < layer[None, :]))


def walk(edges: np.ndarray, score: np.ndarray, gamma: float = 0.15, most: int = 1000, close: float = 1e-8) -> np.ndarray:
    """Walk with restart in proportion to scores (evenly where all are 0), from inputs to what uses them. The graph found
    may have cycles, so steps are taken until they change less than ``close``."""
    out = edges.sum(axis=1)
    p = edges.T / np.maximum(out, 1)[None, :]
    e = np.maximum(score, 0)
    e = e / e.sum() if e.sum() > 0 else np.full(len(e), 1 / max(len(e), 1))
    r = e
    for _ in range(most):
        new = (1 - gamma) * p @ r + gamma * e
        if np.abs(new - r).sum() < close:
            break
        r = new
    return r


def rank_causal(series: DataFrame, at: DataFrame, nodes: DataFrame, edge: DataFrame, alpha: float = 0.05, depth: int = 3, gamma: float = 0.15) -> DataFrame:
    """Ranking by a walk on the graph found in each run's series; a run without series, or in which no edge is found,
    takes the known graph ``edge``. ``at`` is rank.placed, of one topology."""
    each = at.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("node_ord", "node_id", "layer", "score"))).alias("nodes"))
    orders = nodes.select("node_id", "node_ord")
    known = edge.join(orders.select(F.col("node_id").alias("u"), F.col("node_ord").alias("a")), "u").join(orders.select(F.col("node_id").alias("v"), F.col("node_ord").alias("b")), "v")
    known = known.agg(F.collect_list(F.struct("a", "b")).alias("known"))
    rows = each.join(products(changes(series), nodes), "run_id", "left").crossJoin(F.broadcast(known))  # one row

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for run, own, n, cells, links in zip(f.run_id, f.nodes, f.n, f.cells, f.known, strict=True):
                order = np.array([x["node_ord"] for x in own])
                size = int(order.max()) + 1
                edges = np.zeros((size, size), bool)
                layer = np.zeros(size, int)
                layer[order] = [x["layer"] for x in own]
                if cells is not None:
                    s = np.zeros((size, size))
                    for c in cells:
                        if c["j"] < size:
                            s[c["i"], c["j"]] = s[c["j"], c["i"]] = c["s"]
                    dev = np.sqrt(np.maximum(np.diag(s), 0))
                    r = np.divide(s, np.outer(dev, dev), out=np.zeros_like(s), where=np.outer(dev, dev) > 1e-12)
                    np.fill_diagonal(r, 1.0)
                    edges = oriented(*skeleton(r, int(n), alpha, depth), layer)
                if not edges.any():
                    for x in links:
                        if max(x["a"], x["b"]) < size:
                            edges[x["a"], x["b"]] = True
                edges = edges[np.ix_(order, order)]
                yield pd.DataFrame({"run_id": run, "node_id": [x["node_id"] for x in own], "r": walk(edges.astype(float), np.array([x["score"] for x in own], float), gamma)})

    found = rows.repartition("run_id").mapInPandas(walked, "run_id string, node_id string, r double")
    s = at.drop("score").join(found, ["run_id", "node_id"]).where("node_id <> target")
    return ranked(s.withColumnRenamed("r", "score"), "causal")
