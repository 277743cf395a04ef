"""Anomaly scores by an isolation forest, or by a one-class boundary, over windows of series.

The model is fitted in numpy on a bounded sample of windows of clean runs and sent to the tasks; every window of every
series is scored, and a node's score is the logistic of how far the mean of its windows lies from that of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .detect import NODE

WIDTH = 20
#: Bounds of the forest: windows it is grown on, trees, windows of one tree.
SAMPLE, TREES, PER_TREE = 50_000, 100, 256


def windows(series: DataFrame, width: int = WIDTH) -> DataFrame:
    """(run_id, node_id, t, w): every ``width`` values on end of each series, brought to mean 0 and deviation 1. Missing
    values are left out before; series of a deviation up to 1e-8, or shorter than ``width``, have no windows."""
    whole = Window.partitionBy(*NODE)
    rows = series.where("value is not null").withColumn("mean", F.avg("value").over(whole)).withColumn("dev", F.stddev_pop("value").over(whole)).where("dev > 1e-8")
    rows = rows.withColumn("z", (F.col("value") - F.col("mean")) / F.col("dev"))
    last = whole.orderBy("t").rowsBetween(1 - width, 0)
    return rows.select(*NODE, "t", F.collect_list("z").over(last).alias("w")).where(F.size("w") == width)


def _mean_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of a search without success among n values."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: the value they split (-1: a leaf), where, the children's places, and a leaf's depth."""

    roots: np.ndarray
    value: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    depth: np.ndarray
    size: int

    def of(self, frame: pd.DataFrame) -> np.ndarray:
        return self.scores(np.stack(frame.w))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1) for each row of ``x``: near 1 where rows are told apart after few splits."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (open_ := np.flatnonzero(self.value[at] >= 0)).size:
                k = at[open_]
                at[open_] = self.children[k, (x[open_, self.value[k]] > self.cut[k]).astype(int)]
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / max(1.0, float(_mean_depth(self.size))))


def grow(x: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 0) -> Forest:
    """A forest over random parts of ``x``: each split takes a value at random and a place between its bounds at random,
    down to a depth of log2 of the part."""
    rng = np.random.default_rng(seed)
    size = min(per_tree, len(x))
    deepest = int(np.ceil(np.log2(max(size, 2))))
    value, cut, children, depth, roots = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        k = len(value)
        value.append(-1)
        cut.append(0.0)
        children.append((k, k))
        depth.append(level + float(_mean_depth(len(rows))))
        low, high = rows.min(axis=0), rows.max(axis=0)
        wide = np.flatnonzero(high > low)
        if level < deepest and len(rows) > 1 and len(wide):
            v = int(rng.choice(wide))
            c = min(rng.uniform(low[v], high[v]), np.nextafter(high[v], low[v]))  # a draw between neighbours may round to the upper
            right = rows[:, v] > c
            value[k], cut[k] = v, c
            children[k] = node(rows[~right], level + 1), node(rows[right], level + 1)
        return k

    for _ in range(trees):
        roots.append(node(x[rng.choice(len(x), size, replace=False)], 0))
    return Forest(np.array(roots), np.array(value), np.array(cut), np.array(children), np.array(depth), size)


def sampled(rows: DataFrame, bound: int) -> pd.DataFrame:
    """At most ``bound`` rows of windows, those of least hash."""
    return rows.orderBy(F.xxhash64(*NODE, "t"), *NODE, "t").limit(bound).toPandas()


def node_scores(series: DataFrame, rows: DataFrame, model: object, usual: np.ndarray) -> DataFrame:
    """(run_id, node_id, score) of every node of ``series`` from its windows in ``rows``: the logistic of how many
    deviations the mean of ``model.of(frame)`` lies above that of ``usual``. Nodes without windows score 0."""
    mean, dev = float(usual.mean()), max(float(usual.std()), 1e-8)
    held = series.sparkSession.sparkContext.broadcast(model)  # of a size fixed by the bounds of its fit

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"run_id": f.run_id, "node_id": f.node_id, "s": held.value.of(f)})

    each = rows.mapInPandas(scored, "run_id string, node_id string, s double")
    own = each.groupBy(*NODE).agg(F.avg("s").alias("s")).withColumn("score", 1 / (1 + F.exp(-(F.col("s") - mean) / dev)))
    return series.select(*NODE).distinct().join(own.select(*NODE, "score"), list(NODE), "left").fillna(0.0, ["score"])


def isolation_scores(series: DataFrame, clean: DataFrame, sample: int = SAMPLE, width: int = WIDTH) -> DataFrame:
    """(run_id, node_id, score) of every node of ``series``; the forest is grown on ``sample`` windows at most of
    ``clean`` (series of clean runs), those of least hash. Nodes without windows score 0."""
    some = sampled(windows(clean, width), sample)
    if some.empty:
        return series.select(*NODE).distinct().withColumn("score", F.lit(0.0))
    forest = grow(np.stack(some.w))
    return node_scores(series, windows(series, width), forest, forest.of(some))


@dataclass(frozen=True)
class Boundary:
    """A one-class boundary in the space of a kernel's landmarks."""

    mean: np.ndarray
    dev: np.ndarray
    landmarks: np.ndarray
    whiten: np.ndarray
    w: np.ndarray
    rho: float

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.dev
        apart = (z**2).sum(axis=1)[:, None] + (self.landmarks**2).sum(axis=1) - 2 * z @ self.landmarks.T
        return np.exp(-np.maximum(apart, 0) / z.shape[1]) @ self.whiten

    def of(self, frame: pd.DataFrame) -> np.ndarray:
        return self.rho - self.mapped(np.stack(frame.w)) @ self.w


def bounded(x: np.ndarray, nu: float = 0.1, landmarks: int = 100, rounds: int = 300, seed: int = 0) -> Boundary:
    """The boundary that leaves about a share ``nu`` of ``x`` outside: 1/2 |w|^2 - rho + mean(max(0, rho - w f(x))) / nu,
    descended by its subgradient, with ``rho`` at its best (the ``nu`` quantile) in each round."""
    mean, dev = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-8)
    z = (x - mean) / dev
    some = z[np.random.default_rng(seed).choice(len(z), min(landmarks, len(z)), replace=False)]
    near = np.exp(-((some[:, None] - some[None]) ** 2).sum(axis=2) / z.shape[1])
    values, vectors = np.linalg.eigh(near)
    empty = Boundary(mean, dev, some, vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T, np.zeros(len(some)), 0.0)
    f = empty.mapped(x)
    w = f.mean(axis=0)
    for k in range(1, rounds + 1):
        s = f @ w
        outside = f[s <= np.quantile(s, nu)]
        w = w - (w - outside.mean(axis=0)) / (k + 1)
    return Boundary(mean, dev, some, empty.whiten, w, float(np.quantile(f @ w, nu)))


def boundary_scores(series: DataFrame, clean: DataFrame, sample: int = 20_000, width: int = WIDTH) -> DataFrame:
    """As ``isolation_scores``, by a one-class boundary fitted to ``sample`` windows of ``clean`` at most."""
    some = sampled(windows(clean, width), sample)
    if some.empty:
        return series.select(*NODE).distinct().withColumn("score", F.lit(0.0))
    boundary = bounded(np.stack(some.w))
    return node_scores(series, windows(series, width), boundary, boundary.of(some))
