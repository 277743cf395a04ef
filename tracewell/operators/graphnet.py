"""Re-ranking of root-cause candidates by a graph network with a residual path.

A run's sample is its graph of candidates and neighbours: a row of features for each node (rank.graph_features) and a row
for each link. Nets are rows of a table: each is trained in a task of its own, in numpy, on a bounded number of labelled
runs, and each run is scored by the net that did not see its fold.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import TRANSFER, by_kind
from .networks import Adam

FEATURES = 8
HIDDEN, DROPOUT, EPOCHS, RATE, DECAY, POSITIVE = 32, 0.3, 150, 5e-3, 1e-4, 3.0
#: Labelled runs that nets are trained on at most, those of least hash.
SAMPLE = 2000
KINDS = tuple(TRANSFER)


def links(features: DataFrame, edge: DataFrame) -> DataFrame:
    """(run_id, node_id, other, edge_type, weight): for each edge from ``other`` to ``node_id`` within a run's graph, how
    much it passes on, and 1 from each node to itself (edge_type null)."""
    key = [c for c in ("topology",) if c in features.columns]
    nodes = features.select("run_id", *key, "node_id")
    passed = by_kind(F.col("edge_type"), TRANSFER, 1.0)
    inner = edge.select(*key, F.col("v").alias("node_id"), F.col("u").alias("other"), "edge_type", passed.alias("weight")).join(nodes, [*key, "node_id"])
    inner = inner.join(nodes.drop(*key).withColumnRenamed("node_id", "other"), ["run_id", "other"])
    own = nodes.select("run_id", "node_id", F.col("node_id").alias("other"), F.lit(None).cast("string").alias("edge_type"), F.lit(1.0).alias("weight"))
    return inner.select(own.columns).unionByName(own)


def adjacency(link: DataFrame) -> DataFrame:
    """(run_id, node_id, other, weight): the weights over the roots of both ends' degree, a node's sum of weights (1 at
    least)."""
    degree = link.groupBy("run_id", "node_id").agg(F.greatest(F.sum("weight"), F.lit(1.0)).alias("d"))
    two = link.join(degree, ["run_id", "node_id"]).join(degree.select("run_id", F.col("node_id").alias("other"), F.col("d").alias("e")), ["run_id", "other"])
    return two.select("run_id", "node_id", "other", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))


def samples(features: DataFrame, link: DataFrame) -> DataFrame:
    """(run_id, nodes, links): a row for each run; a run has as many as its topology gives ten candidates."""
    f = features.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("node_id", F.array(*(F.col(f"f{k}").cast("double") for k in range(FEATURES))).alias("f")))).alias("nodes"))
    return f.join(link.groupBy("run_id").agg(F.collect_list(F.struct("node_id", "other", "edge_type", "weight")).alias("links")), "run_id")


def _even(a: np.ndarray) -> np.ndarray:
    root = np.sqrt(np.maximum(a.sum(axis=1), 1.0))
    return a / root[:, None] / root[None, :]


def matrices(nodes: list, link: list, relational: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, features, matrices of the first layer (one, or one for each kind of edge) and that of the second."""
    names = [n["node_id"] for n in nodes]
    at = {n: k for k, n in enumerate(names)}
    x = np.array([n["f"] for n in nodes], float)
    whole, each = np.zeros((len(names),) * 2), np.zeros((len(KINDS), len(names), len(names)))
    for e in link:
        i, j = at[e["node_id"]], at[e["other"]]
        whole[i, j] = 1.0 if relational else e["weight"]
        if e["edge_type"] is not None and relational:
            each[KINDS.index(e["edge_type"]) if e["edge_type"] in TRANSFER else KINDS.index("direct_map"), i, j] = 1.0
    whole = _even(whole)
    return names, x, np.stack([_even(a) for a in each]) if relational else whole[None], whole


def parameters(relations: int, seed: int = 0, biased: bool = True) -> list[np.ndarray]:
    """Weights of the relations and their bias, of the residual path, scale and shift of the norm, of the output."""
    rng = np.random.default_rng(seed)
    a, b = 1 / np.sqrt(FEATURES), 1 / np.sqrt(HIDDEN)
    bias = rng.uniform(-a, a, HIDDEN) if biased else np.zeros(0)
    return [rng.uniform(-a, a, (relations, FEATURES, HIDDEN)), bias, rng.uniform(-a, a, (FEATURES, HIDDEN)), rng.uniform(-a, a, HIDDEN), np.ones(HIDDEN), np.zeros(HIDDEN), rng.uniform(-b, b, (HIDDEN, 1)), rng.uniform(-b, b, 1)]


def scores(p: list[np.ndarray], x: np.ndarray, first: np.ndarray, second: np.ndarray, keep: np.ndarray | float = 1.0) -> tuple[np.ndarray, tuple]:
    """Score of each node in (0, 1), and what the gradients need. ``keep`` are factors on the relations' messages."""
    message = x @ p[0] + p[1] if len(p[1]) else x @ p[0]
    u = ((first @ message) * keep).sum(axis=0) + x @ p[2] + p[3]
    mean, dev = u.mean(axis=1, keepdims=True), np.sqrt(u.var(axis=1, keepdims=True) + 1e-5)
    n = (u - mean) / dev
    h = np.maximum(n * p[4] + p[5], 0)
    out = 1 / (1 + np.exp(-(second @ (h @ p[6] + p[7]))))
    return out[:, 0], (n, dev, h)


def loss(p: list[np.ndarray], x: np.ndarray, first: np.ndarray, second: np.ndarray, y: np.ndarray, keep: np.ndarray | float = 1.0) -> tuple[float, list[np.ndarray]]:
    """Cross entropy, the root cause weighted by POSITIVE, and its gradients."""
    out, (n, dev, h) = scores(p, x, first, second, keep)
    weight = 1 + y * (POSITIVE - 1)
    value = -(weight * (y * np.log(out + 1e-12) + (1 - y) * np.log(1 - out + 1e-12))).mean()
    g = second.T @ (weight * (out - y) / len(y))[:, None]
    gh = (g @ p[6].T) * (h > 0)
    gn = gh * p[4]
    gu = (gn - gn.mean(axis=1, keepdims=True) - n * (gn * n).mean(axis=1, keepdims=True)) / dev
    gm = first.transpose(0, 2, 1) @ (gu * keep * np.ones_like(first[:, :, :1]))
    bias = gm.sum(axis=(0, 1)) if len(p[1]) else p[1]
    return value, [x.T @ gm, bias, x.T @ gu, gu.sum(axis=0), (gh * n).sum(axis=0), gh.sum(axis=0), h.T @ g, g.sum(axis=0)]


def trained(rows: list[tuple], relations: int, epochs: int = EPOCHS, seed: int = 0) -> list[np.ndarray]:
    """A net from (features, first, second, labels) of runs, one step a run, with gradients of norm 1 at most."""
    rng = np.random.default_rng(seed)
    p = parameters(relations, seed, biased=relations == 1)
    adam = Adam(p, RATE, DECAY)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            x, first, second, y = rows[k]
            keep = (rng.random((relations, len(x), HIDDEN)) >= DROPOUT) / (1 - DROPOUT)
            grads = loss(p, x, first, second, y, keep)[1]
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            adam.step([g / max(1.0, norm) for g in grads])
    return p


NET = "part string, relational boolean, held int, net binary"
#: Stands for the net of all labelled runs, which scores runs without a fold.
ALL = -1
#: Runs that are scored together.
BLOCK = 256


def nets(sample: DataFrame, truth: DataFrame, relational: Sequence[bool] = (False,), epochs: int = EPOCHS, bound: int = SAMPLE) -> DataFrame:
    """(part, relational, held, net): for each part of ``sample(part, run_id, nodes, links)``, each kind of net and each fold
    a net trained on the part's labelled runs of other folds (``held`` is the fold it has not seen, or ALL), each in a
    task of its own. ``truth(run_id, node_id, fold)``; a run without a label, or whose root cause lies outside its graph,
    trains none. Of a part, the ``bound`` runs of least hash count."""
    labelled = sample.join(truth.select("run_id", F.col("node_id").alias("cause"), "fold"), "run_id").where(F.exists("nodes", lambda n: n["node_id"] == F.col("cause")))
    by = Window.partitionBy("part").orderBy(F.xxhash64("run_id"), "run_id")
    labelled = labelled.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= bound)
    folds = truth.select(F.col("fold").alias("held")).where("held is not null").distinct().unionByName(truth.sparkSession.createDataFrame([(ALL,)], "held int"))
    kinds = truth.sparkSession.createDataFrame([(bool(r),) for r in relational], "relational boolean")
    rows = labelled.crossJoin(folds).where("held <> coalesce(fold, -2)").crossJoin(kinds)  # a copy for each fold and kind, of bounded rows

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        part, kind, held = frame.part.iloc[0], bool(frame.relational.iloc[0]), int(frame.held.iloc[0])
        ready = []
        for r in frame.sort_values("_k").itertuples():
            names, *arrays = matrices(r.nodes, r.links, kind)
            ready.append((*arrays, np.array([float(n == r.cause) for n in names])))
        return pd.DataFrame({"part": [part], "relational": [kind], "held": [held], "net": [pickle.dumps(trained(ready, len(KINDS) if kind else 1, epochs))]})

    return rows.select("part", "relational", "held", "_k", "nodes", "links", "cause").groupBy("part", "relational", "held").applyInPandas(fit, NET)


def scored_by(sample: DataFrame, folds: DataFrame, models: DataFrame) -> DataFrame:
    """(part, relational, run_id, node_id, score) of every node of ``sample(part, run_id, nodes, links)``'s graphs, by the nets
    that did not see the run's fold (``folds(run_id, fold)``), by those of all where it has none. Without a net, no scores."""
    blocks = max(1, -(-sample.count() // BLOCK))
    rows = sample.join(folds.select("run_id", "fold"), "run_id", "left").withColumn("held", F.coalesce("fold", F.lit(ALL))).withColumn("block", F.pmod(F.xxhash64("run_id"), F.lit(blocks)))
    each = models.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def score(runs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for kind, packed in zip(held.relational, held.net, strict=True):
            net = pickle.loads(packed)
            for r in runs.itertuples():
                names, *arrays = matrices(r.nodes, r.links, bool(kind))
                out += [(r.part, bool(kind), r.run_id, name, float(s)) for name, s in zip(names, scores(net, *arrays)[0], strict=True)]
        return pd.DataFrame(out, columns=["part", "relational", "run_id", "node_id", "score"])

    keys = ("part", "held", "block")
    return rows.drop("fold").groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(score, "part string, relational boolean, run_id string, node_id string, score double")


def network_scores(sample: DataFrame, truth: DataFrame, relational: bool = False, epochs: int = EPOCHS, bound: int = SAMPLE) -> DataFrame:
    """(run_id, node_id, score) of every node of ``sample``'s graphs, each run by the net that has not seen its fold."""
    one = sample.select(F.lit("").alias("part"), "run_id", "nodes", "links")
    return scored_by(one, truth, nets(one, truth, (relational,), epochs, bound)).select("run_id", "node_id", "score")
