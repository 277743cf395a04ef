"""Targets and rankings of root-cause candidates, for all runs at once.

Every ranking is (run_id, method, target, node_id, score, rank); ties go to the node laid down first (``node_ord``).
``scores`` is (run_id, node_id, score); ``closure`` (u, v, hops) and ``edge`` (u, v, edge_type) are those of the runs'
topology. Where scores have a ``topology``, nodes, closure and edge are keyed by it, and runs of several go together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import kept
from .lineage import PRIOR, TRANSFER, by_kind


def _by(df: DataFrame, *cols: str) -> list[str]:
    """``cols``, and the topology where there is one."""
    return [*(c for c in ("topology",) if c in df.columns), *cols]


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def select_target(scores: DataFrame, nodes: DataFrame, closure: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(run_id, target): of the risk and report nodes below the five most anomalous nodes (and the five most anomalous
    that are no sources), that of largest 10 x layer + sum of their scores; where there is none, the report of largest score + 0.1 x
    its anomalous ancestors (if its own score reaches the threshold), else the best node that is no source."""
    key = _by(scores, "node_id")
    meta = nodes.select(*key, "node_ord", "layer")
    s = scores.select("run_id", *key, "score").join(F.broadcast(meta), key)  # a row for each node of each topology
    order = [F.desc("score"), F.col("node_ord")]
    hot = s.where(F.col("score") >= threshold)
    top = hot.withColumn("a", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
    top = top.withColumn("b", F.row_number().over(Window.partitionBy("run_id", F.col("layer") > 1).orderBy(*order)))
    seeds = top.where((F.col("a") <= 5) | ((F.col("layer") > 1) & (F.col("b") <= 5))).select(*_by(s, "run_id"), F.col("node_id").alias("u"), "score")
    below = seeds.join(closure.select(*_by(s, "u"), F.col("v").alias("node_id")), _by(s, "u")).join(F.broadcast(meta.where("layer >= 4")), key)
    cover = below.groupBy("run_id", "node_id", "layer", "node_ord").agg(F.sum("score").alias("cover"))
    best = _first(cover, ["run_id"], F.desc(F.round(10 * F.col("layer") + F.col("cover"), 9)), F.col("node_ord")).select("run_id", F.col("node_id").alias("t1"))
    above = closure.select(*_by(s), F.col("u").alias("a"), F.col("v").alias("node_id")).join(hot.select(*_by(s, "run_id"), F.col("node_id").alias("a")), _by(s, "a")).groupBy("run_id", "node_id").agg(F.count("*").alias("n"))
    reports = s.where("layer = 5").join(above, ["run_id", "node_id"], "left").withColumn("c", F.col("score") + 0.1 * F.coalesce("n", F.lit(0)))
    t2 = _first(reports, ["run_id"], F.desc("c"), F.col("node_ord")).where(F.col("score") >= threshold).select("run_id", F.col("node_id").alias("t2"))
    t3 = _first(s.where("layer > 1"), ["run_id"], *order).select("run_id", F.col("node_id").alias("t3"))
    t4 = _first(s, ["run_id"], *order).select("run_id", F.col("node_id").alias("t4"))
    return t4.join(best, "run_id", "left").join(t2, "run_id", "left").join(t3, "run_id", "left").select("run_id", F.coalesce("t1", "t2", "t3", "t4").alias("target"))


def target_from_reports(scores: DataFrame, nodes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(run_id, target): the most anomalous report, or the most anomalous node if no report reaches the threshold."""
    key = _by(scores, "node_id")
    s = scores.select("run_id", *key, "score").join(F.broadcast(nodes.select(*key, "node_ord", "layer")), key)
    order = [F.desc("score"), F.col("node_ord")]
    report = _first(s.where("layer = 5"), ["run_id"], *order).where(F.col("score") >= threshold).select("run_id", F.col("node_id").alias("a"))
    return _first(s, ["run_id"], *order).select("run_id", F.col("node_id").alias("b")).join(report, "run_id", "left").select("run_id", F.coalesce("a", "b").alias("target"))


@dataclass(frozen=True)
class Walk:
    """Switches of one method."""

    method: str
    use_scores: bool = True
    use_weights: bool = True
    use_decay: bool = True
    adaptive: bool = False
    inverse: bool = True
    ancestors_only: bool = True
    transfer: bool = False
    alpha: float = 0.7
    gamma: float = 0.15


V1, V2, V3 = Walk("v1"), Walk("v2", adaptive=True), Walk("v3", adaptive=True, transfer=True)
VANILLA = Walk("vanilla", use_scores=False, use_weights=False, use_decay=False)
ABLATIONS = (
    Walk("v1 full"), Walk("v1 without weights", use_weights=False), Walk("v1 without decay", use_decay=False), Walk("v1 without scores", use_scores=False),
    Walk("v2 full", adaptive=True), Walk("v2 without adaptive"), Walk("v2 without inverse", adaptive=True, inverse=False), Walk("v2 without ancestors", adaptive=True, ancestors_only=False),
)


def placed(scores: DataFrame, targets: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """scores of every node with its target, hops up from it (null: none), the run's largest hop, and metadata."""
    key = _by(scores, "node_id")
    hops = closure.select(*_by(scores), F.col("u").alias("node_id"), F.col("v").alias("target"), "hops")
    s = scores.select("run_id", *key, "score").join(F.broadcast(nodes.select(*key, "node_ord", "layer", "transform_type")), key).join(targets, "run_id")
    s = s.join(hops, [*key, "target"], "left").withColumn("hops", F.when(F.col("node_id") == F.col("target"), 0).otherwise(F.col("hops")))
    return s.withColumn("max_hops", F.greatest(F.max("hops").over(Window.partitionBy("run_id")), F.lit(1)))


def walked(transition: DataFrame, restart: DataFrame, gamma: float, depth: int) -> DataFrame:
    """(run_id, node_id, r): the walk with restart's fixed point, sum of gamma (1 - gamma)^k P^k e. On a graph without
    cycles P^k is zero beyond the longest path's ``depth`` edges, so that many joins with the edges are all there is. Both
    tables are written once, since every step reads them; while small, Spark broadcasts the transitions."""
    transition = kept(transition, "transitions")
    start = kept(restart.select("run_id", "node_id", (F.col("e") * gamma).alias("r")), "restarts")
    r = start
    for _ in range(depth):
        moved = r.withColumnRenamed("node_id", "frm").join(transition, ["run_id", "frm"]).select("run_id", F.col("to").alias("node_id"), (F.col("r") * F.col("p") * (1 - gamma)).alias("r"))
        r = start.unionByName(moved).groupBy("run_id", "node_id").agg(F.sum("r").alias("r"))
    return r


def restarts(at: DataFrame, use_scores: bool) -> DataFrame:
    """(run_id, node_id, e): 0.7 on the target, 0.3 over other nodes above 0.3 in proportion, brought to sum 1."""
    own = F.when(F.col("node_id") == F.col("target"), 0.7).otherwise(0.0)
    if not use_scores:
        return at.where("node_id = target").select("run_id", "node_id", F.lit(0.7 / (0.7 + 1e-12)).alias("e"))
    other = F.when((F.col("node_id") != F.col("target")) & (F.col("score") > 0.3), F.col("score"))
    w = Window.partitionBy("run_id")
    e = own + F.coalesce(0.3 * other / F.sum(other).over(w), F.lit(0.0))
    out = at.withColumn("e", e)
    return out.withColumn("e", F.col("e") / (F.sum("e").over(w) + 1e-12)).where("e > 0").select("run_id", "node_id", "e")


def transitions(at: DataFrame, edge: DataFrame, walk: Walk) -> DataFrame:
    """(run_id, frm, to, p): from a node to each of its inputs, weighted and brought to sum 1."""
    a = F.greatest(F.col("score") if walk.use_scores else F.lit(1.0), F.lit(1e-4))
    decay = F.pow(F.lit(walk.alpha), F.coalesce("hops", F.lit(0)) / F.col("max_hops")) if walk.use_decay else F.lit(1.0)
    beta = F.lit(1.0)
    if walk.use_weights and (walk.transfer or not walk.adaptive):
        beta = by_kind(F.col("edge_type"), TRANSFER if walk.transfer else PRIOR, 1.0)
    w = at.select(*_by(at, "run_id"), F.col("node_id").alias("to"), (a * decay).alias("w")).join(edge.select(*_by(at), F.col("u").alias("to"), F.col("v").alias("frm"), beta.alias("b")), _by(at, "to"))
    w = w.withColumn("w", F.col("w") * F.col("b"))
    return w.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("run_id", "frm"))).select("run_id", "frm", "to", "p")


def ranked(df: DataFrame, method: str) -> DataFrame:
    by = Window.partitionBy("run_id").orderBy(F.desc(F.round("score", 12)), "node_ord")
    return df.withColumn("rank", F.row_number().over(by)).select("run_id", F.lit(method).alias("method"), "target", "node_id", "score", "rank")


def rank_walk(at: DataFrame, edge: DataFrame, walk: Walk, depth: int) -> DataFrame:
    """Ranking by one method from ``placed`` rows; ``depth`` is that of the graph (lineage.depth)."""
    r = walked(transitions(at, edge, walk), restarts(at, walk.use_scores), walk.gamma, depth)
    s = at.join(r, ["run_id", "node_id"], "left").fillna(0.0, ["r"]).where("node_id <> target")
    a = F.greatest(F.col("score") if walk.use_scores else F.lit(0.5), F.lit(0.01))
    anc = F.when(F.col("hops").isNotNull(), 1.0).otherwise(0.05) if walk.ancestors_only else F.lit(1.0)
    bonus = 1 + 0.15 * (5 - F.col("layer")) if walk.use_decay else F.lit(1.0)
    kind = by_kind(F.col("transform_type"), PRIOR, 1.0) if walk.use_weights else F.lit(1.0)
    if walk.adaptive:
        g = 0.3 + 0.4 * (1 - F.coalesce("hops", F.lit(0)) / F.col("max_hops"))
        if walk.inverse:
            kind = F.greatest(kind * (1 - 0.5 * a), F.lit(0.1))
        base = g * F.col("r") + (1 - g) * a
    else:
        base = 0.4 * F.col("r") + 0.6 * a
    return ranked(s.withColumn("score", base * anc * bonus * kind), walk.method)


def rank_structural(at: DataFrame, edge: DataFrame, depth: int, backward: bool = False, gamma: float = 0.15, method: str = "structural") -> DataFrame:
    """Uniform weights, restart in proportion to scores (all on the target where all are 0). As laid down, the walk goes
    from inputs to what uses them; ``backward`` turns it round."""
    ends = ("v", "u") if backward else ("u", "v")
    e = edge.select(*_by(at), F.col(ends[0]).alias("frm"), F.col(ends[1]).alias("to")).distinct()
    e = e.withColumn("p", 1 / F.count("*").over(Window.partitionBy(*_by(at, "frm"))))
    runs = at.select(*_by(at, "run_id")).distinct()
    t = e.join(runs, "topology") if "topology" in at.columns else e.crossJoin(F.broadcast(runs))
    w = Window.partitionBy("run_id")
    total = F.sum("score").over(w)
    restart = at.withColumn("e", F.when(total > 0, F.col("score") / F.when(total > 0, total)).otherwise((F.col("node_id") == F.col("target")).cast("double"))).where("e > 0")
    r = walked(t, restart, gamma, depth)
    s = at.drop("score").join(r, ["run_id", "node_id"], "left").fillna(0.0, ["r"]).where("node_id <> target")
    return ranked(s.withColumnRenamed("r", "score"), method)


def rank_hops(at: DataFrame) -> DataFrame:
    """Nearest inputs first, then by score; nodes out of reach last. The score is 1 - hops / (largest + 1)."""
    far = F.col("max_hops") + 1
    s = at.where("node_id <> target").withColumn("_h", F.coalesce(F.col("hops"), far))
    by = Window.partitionBy("run_id").orderBy("_h", F.desc(F.round("score", 12)), "node_ord")
    return s.withColumn("rank", F.row_number().over(by)).select("run_id", F.lit("hops").alias("method"), "target", "node_id", (1 - F.col("_h") / far).alias("score"), "rank")


def rank_scores(at: DataFrame) -> DataFrame:
    return ranked(at.where("node_id <> target"), "score")


def rank_schema(at: DataFrame, run_nodes: DataFrame) -> DataFrame:
    """Nodes with fewer inputs than expected first, by how many are missing, with score 1 - inputs / expected; then the others by score. A run without
    such a node has no ranking."""
    n = F.size("input_columns")
    bad = run_nodes.where(F.col("expected_input_count").isNotNull() & (n < F.col("expected_input_count"))).select("run_id", "node_id", (F.col("expected_input_count") - n).alias("missing"), (1 - n / F.col("expected_input_count")).alias("share"))
    s = at.join(bad.select("run_id").distinct(), "run_id", "left_semi").join(bad, ["run_id", "node_id"], "left")
    by = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("missing"), F.desc(F.round("score", 12)), "node_ord")
    return s.withColumn("rank", F.row_number().over(by)).select("run_id", F.lit("schema").alias("method"), "target", "node_id", F.coalesce("share", F.when(F.col("missing").isNull(), F.col("score"))).alias("score"), "rank")


def hybrid(schema: DataFrame, other: DataFrame) -> DataFrame:
    """The schema ranking of runs that have one, else the other."""
    rest = other.join(schema.select("run_id").distinct(), "run_id", "left_anti")
    return schema.unionByName(rest.select(schema.columns)).withColumn("method", F.lit("hybrid"))


def top(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.where(F.col("rank") <= k)


def rerank(ranking: DataFrame, learned: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ranking's nodes by ``learned(run_id, node_id, score)``; nodes without one have 0, ties keep their order."""
    s = ranking.drop("score").join(learned.select("run_id", "node_id", "score"), ["run_id", "node_id"], "left").fillna(0.0, ["score"])
    by = Window.partitionBy("run_id").orderBy(F.desc("score"), "rank")
    return s.withColumn("new", F.row_number().over(by)).select("run_id", "method", "target", "node_id", "score", F.col("new").alias("rank"))


def graph_features(ranking: DataFrame, at: DataFrame, edge: DataFrame, k: int = 10) -> DataFrame:
    """(run_id, node_id, f0..f7) of the k best candidates and their neighbours: share of the best walk score, anomaly score,
    layer, ancestor or not, in and out degree, candidate or not, hops up from the target."""
    cand = top(ranking, k).select("run_id", "node_id", F.col("score").alias("w")).join(at.select(*_by(at, "run_id", "node_id")), ["run_id", "node_id"])
    near = edge.select(*_by(at), F.col("u").alias("node_id"), F.col("v").alias("x")).union(edge.select(*_by(at), F.col("v").alias("node_id"), F.col("u").alias("x")))
    sub = cand.select("run_id", "node_id").union(cand.join(near, _by(at, "node_id")).select("run_id", F.col("x").alias("node_id"))).distinct()
    ins, outs = (edge.groupBy(*_by(at), F.col(end).alias("node_id")).agg(F.count("*").alias(name)) for end, name in (("v", "i"), ("u", "o")))
    big_in, big_out = (d.groupBy(*_by(at)).agg((F.max(c) + 1).alias(f"max_{c}")) for d, c in ((ins, "i"), (outs, "o")))
    big = big_in.join(big_out, "topology") if "topology" in at.columns else big_in.crossJoin(big_out)
    best = cand.groupBy("run_id").agg(F.max("w").alias("best"))
    s = sub.join(at, ["run_id", "node_id"]).join(cand.select("run_id", "node_id", "w"), ["run_id", "node_id"], "left").join(best, "run_id").join(ins, _by(at, "node_id"), "left").join(outs, _by(at, "node_id"), "left")
    s = s.join(big, "topology") if "topology" in at.columns else s.crossJoin(F.broadcast(big))
    far = F.col("max_hops") + 1
    return s.select(
        *_by(at, "run_id", "node_id"), (F.coalesce("w", F.lit(0.0)) / F.col("best")).alias("f0"), F.col("score").alias("f1"), (F.col("layer") / 5).alias("f2"), (F.coalesce(F.col("hops") > 0, F.lit(False))).cast("double").alias("f3"),
        (F.coalesce("i", F.lit(0)) / F.col("max_i")).alias("f4"), (F.coalesce("o", F.lit(0)) / F.col("max_o")).alias("f5"), F.col("w").isNotNull().cast("double").alias("f6"), (F.coalesce(F.col("hops"), far) / far).alias("f7"),
    )


def folds(trials: DataFrame, n: int = 5) -> DataFrame:
    """trials(run_id, anomaly_type, size, trial) with ``fold``, dealt in order of trial within (anomaly_type, size)."""
    by = Window.partitionBy("anomaly_type", "size").orderBy("trial", "run_id")
    return trials.withColumn("fold", (F.row_number().over(by) - 1) % n)
