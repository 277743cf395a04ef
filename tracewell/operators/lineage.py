"""The lineage graph: edges from node metadata, closures with hop counts, paths and summaries.

Graphs are keyed by ``topology``; runs of one topology share its closure.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: An edge's prior weight by the kind of its target.
PRIOR = {"aggregate": 1.5, "calculate": 1.2, "report": 1.3, "direct_map": 1.0, "filter": 0.8, "source": 1.0}
#: How much of an anomaly a kind of node passes on.
TRANSFER = {"source": 1.0, "direct_map": 1.0, "filter": 0.8, "calculate": 1.0, "aggregate": 0.45, "report": 0.1}


def by_kind(kind: Column, table: dict[str, float], other: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(other)


def edges(nodes: DataFrame) -> DataFrame:
    """(topology, u, v, edge_type, weight_prior, source_columns, target_columns); upstream names that are no node are skipped."""
    ends = nodes.select("topology", F.col("node_id").alias("v"), F.explode("upstream").alias("u"), F.col("transform_type").alias("edge_type"), "input_columns", F.col("output_columns").alias("target_columns"))
    starts = nodes.select("topology", F.col("node_id").alias("u"), F.col("output_columns").alias("given"))
    both = ends.join(starts, ["topology", "u"])
    return both.select("topology", "u", "v", "edge_type", by_kind(F.col("edge_type"), PRIOR, 1.0).alias("weight_prior"), F.array_intersect("given", "input_columns").alias("source_columns"), "target_columns")


def by_run(frame: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run's own rows of ``frame``, which is keyed by topology; ``runs(run_id, topology)``."""
    return frame.join(runs.select("run_id", "topology"), "topology")


def reach(edge: DataFrame) -> DataFrame:
    """(topology, u, v, hops): v can be reached from u, the shortest way taking ``hops`` edges.

    Ways of up to 2, 4, 8 ... edges are found by joining those known so far with each other, keeping the shortest, until
    a round finds no new pair: a pair that is known then has its shortest way. Cycles end it like any other graph.
    """
    known = kept(edge.select("topology", "u", "v").distinct().withColumn("hops", F.lit(1)), "closure")
    have, before = known.count(), -1
    while have > before:
        further = known.alias("a").join(known.alias("b"), (F.col("a.topology") == F.col("b.topology")) & (F.col("a.v") == F.col("b.u")))
        further = further.select("a.topology", "a.u", "b.v", (F.col("a.hops") + F.col("b.hops")).alias("hops"))
        known = kept(known.union(further).groupBy("topology", "u", "v").agg(F.min("hops").alias("hops")), "closure")
        have, before = known.count(), have
    return known


def peeled(edge: DataFrame, start: str = "u", end: str = "v") -> tuple[DataFrame, int]:
    """(edges that are left, rounds): edges of nodes without incoming ones (from ``start`` to ``end``) go, round by round,
    until none does. What is left begins in a cycle; without cycles nothing is, and there were as many rounds as the
    longest way has edges."""
    left, rounds = kept(edge.select("topology", "u", "v").distinct(), "peeled"), 0
    have = left.count()
    while have:
        entered = left.select("topology", F.col(end).alias(start)).distinct()
        left = kept(left.join(entered, ["topology", start], "left_semi"), "peeled")
        before, have = have, left.count()
        if have == before:
            break
        rounds += 1
    return left.select("topology", "u", "v"), rounds


def depth(edge: DataFrame) -> int:
    """Edges of the longest way in any of the graphs, which must have no cycles."""
    left, rounds = peeled(edge)
    if not left.isEmpty():
        raise ValueError("the graph has a cycle")
    return rounds


def cycles(edge: DataFrame) -> DataFrame:
    """(topology, node_id, part): nodes that lie on cycles, with the least name of those that they can reach and are reached
    from. Only what peeling from both sides leaves is closed."""
    left = reach(peeled(peeled(edge)[0], "v", "u")[0])
    back = left.select("topology", F.col("v").alias("u"), F.col("u").alias("v"))
    both = left.select("topology", "u", "v").join(back, ["topology", "u", "v"])
    return both.groupBy("topology", F.col("u").alias("node_id")).agg(F.min("v").alias("part"))


def faults_of(nodes: DataFrame) -> DataFrame:
    """(topology, fault, node_id, detail) of graphs as they are loaded: ``repeated`` names with how often they are laid down,
    ``dangling`` inputs that are no node, ``column`` for input columns that no input gives, ``cycle`` for nodes on cycles
    with the least name of their part. A sound graph has no rows."""
    names = nodes.groupBy("topology", "node_id").agg(F.count("*").alias("n"))
    repeated = names.where("n > 1").select("topology", F.lit("repeated").alias("fault"), "node_id", F.col("n").cast("string").alias("detail"))
    wanted = nodes.select("topology", "node_id", F.explode("upstream").alias("u")).distinct()
    dangling = wanted.join(names.select("topology", F.col("node_id").alias("u")), ["topology", "u"], "left_anti").select("topology", F.lit("dangling").alias("fault"), "node_id", F.col("u").alias("detail"))
    given = wanted.join(nodes.select("topology", F.col("node_id").alias("u"), F.explode("output_columns").alias("detail")), ["topology", "u"]).select("topology", "node_id", "detail")
    used = nodes.where("size(upstream) > 0").select("topology", "node_id", F.explode("input_columns").alias("detail")).distinct()
    column = used.join(given, ["topology", "node_id", "detail"], "left_anti").select("topology", F.lit("column").alias("fault"), "node_id", "detail")
    cycle = cycles(wanted.select("topology", "u", F.col("node_id").alias("v"))).select("topology", F.lit("cycle").alias("fault"), "node_id", F.col("part").alias("detail"))
    return repeated.unionByName(dangling).unionByName(column).unionByName(cycle)


def first_steps(edge: DataFrame, closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """(topology, u, v, hops, next): for every v that u reaches, the node after u on a shortest way, of several the one laid
    down first."""
    ahead = closure.select("topology", F.col("u").alias("next"), "v", (F.col("hops") + 1).alias("hops"))
    ahead = ahead.unionByName(edge.select("topology", F.col("v").alias("next"), "v", F.lit(1).alias("hops")).distinct())
    order = nodes.select("topology", F.col("node_id").alias("next"), "node_ord")
    met = edge.select("topology", "u", F.col("v").alias("next")).distinct().join(ahead, ["topology", "next"]).join(closure.select("topology", "u", "v", "hops"), ["topology", "u", "v", "hops"]).join(order, ["topology", "next"])
    return met.groupBy("topology", "u", "v", "hops").agg(F.min_by("next", F.struct("node_ord", "next")).alias("next"))


def shortest_paths(steps: DataFrame) -> DataFrame:
    """(topology, u, v, path) from ``first_steps``: pointers are doubled, so a way of h edges takes log2 h joins."""
    longest = steps.agg(F.max("hops")).first()[0] or 0
    paths = kept(steps.select("topology", "u", "v", "hops", F.array("u").alias("path"), "next"), "paths")
    done = 1
    while done < longest:
        rest = paths.select("topology", F.col("u").alias("next"), "v", F.col("path").alias("more"), F.col("next").alias("far"))
        moved = paths.join(rest, ["topology", "next", "v"], "left")
        paths = kept(moved.select("topology", "u", "v", "hops", F.concat("path", F.coalesce("more", F.array().cast("array<string>"))).alias("path"), F.coalesce("far", "next").alias("next")), "paths")
        done *= 2
    return paths.select("topology", "u", "v", F.concat("path", F.array("v")).alias("path"))


#: Edges of a topology up to which one task works out its closure.
ONE_TASK = 20_000


def closed(edge: DataFrame) -> tuple[DataFrame, int]:
    """(closure, edges of the longest way in any graph) in one pass: a task for each topology, if all have at most
    ONE_TASK edges, else by joins. A graph with a cycle is an error."""
    e = edge.select("topology", "u", "v").distinct()
    most = e.groupBy("topology").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > ONE_TASK:
        return reach(edge), depth(edge)

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        above: dict[str, list[str]] = {}
        below: dict[str, list[str]] = {}
        for u, v in zip(frame.u, frame.v, strict=True):
            below.setdefault(u, []).append(v)
            above.setdefault(v, []).append(u)
        waiting = {v: len(us) for v, us in above.items()}
        free = [u for u in below if u not in above]
        height = dict.fromkeys(free, 0)
        for u in free:  # grows while it is read
            for v in below.get(u, ()):
                height[v] = max(height.get(v, 0), height[u] + 1)
                waiting[v] -= 1
                if not waiting[v]:
                    free.append(v)
        if len(free) < len(above.keys() | below.keys()):
            raise ValueError(f"the graph {frame.topology.iloc[0]} has a cycle")
        out = []
        for u in below:
            hops, front = {u: 0}, [u]
            for x in front:
                for v in below.get(x, ()):
                    if v not in hops:
                        hops[v] = hops[x] + 1
                        front.append(v)
            out += [(u, v, h) for v, h in hops.items() if h]
        found = pd.DataFrame(out, columns=["u", "v", "hops"])
        found["hops"] = found["hops"].astype("int32")
        return found.assign(topology=frame.topology.iloc[0], longest=max(height.values()))[["topology", "u", "v", "hops", "longest"]]

    found = kept(e.groupBy("topology").applyInPandas(walk, "topology string, u string, v string, hops int, longest int"), "closure")
    return found.drop("longest"), found.agg(F.max("longest")).first()[0] or 0


def descendants(closure: DataFrame, node_id: str) -> DataFrame:
    return closure.where(F.col("u") == node_id).select("topology", F.col("v").alias("node_id"), "hops")


def ancestors(closure: DataFrame, node_id: str) -> DataFrame:
    return closure.where(F.col("v") == node_id).select("topology", F.col("u").alias("node_id"), "hops")


def impact(closure: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """Reports below a node, and their columns."""
    reports = nodes.where("layer = 5").select("topology", "node_id", F.explode("output_columns").alias("column"))
    return reports.join(descendants(closure, node_id).select("topology", "node_id"), ["topology", "node_id"], "left_semi")


def simple_paths(edge: DataFrame, source: str, target: str, cutoff: int = 10) -> DataFrame:
    """(topology, path) of all ways from source to target with ``cutoff`` edges at most; none for unknown names."""
    pairs = edge.select("topology").distinct().select("topology", F.lit(source).alias("u"), F.lit(target).alias("v"))
    return paths_between(edge, pairs, cutoff).select("topology", "path")


def paths_between(edge: DataFrame, pairs: DataFrame, cutoff: int = 10) -> DataFrame:
    """(topology, u, v, path) of all ways between ``pairs(topology, u, v)`` with ``cutoff`` edges at most. More
    rows than Spark's limit for recursion are an error."""
    return edge.sparkSession.sql(
        """WITH RECURSIVE c(topology, u, v, last, path, hops) AS (
             SELECT p.topology, p.u, p.v, e.v, array(e.u, e.v), 1 FROM {pairs} p JOIN {edge} e ON e.topology = p.topology AND e.u = p.u UNION ALL
             SELECT c.topology, c.u, c.v, e.v, array_append(c.path, e.v), c.hops + 1 FROM c JOIN {edge} e ON e.topology = c.topology AND e.u = c.last
             WHERE c.hops < {cutoff} AND c.last <> c.v AND NOT array_contains(c.path, e.v))
           SELECT topology, u, v, path FROM c WHERE last = v""",
        edge=edge.select("topology", "u", "v").distinct(), pairs=pairs.select("topology", "u", "v").distinct(), cutoff=cutoff,
    )


def trace_completeness(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(topology, u, v)`` with 1.0 where v can be reached from u, else 0.0."""
    hit = closure.select("topology", "u", "v", F.lit(1.0).alias("found"))
    return pairs.join(hit, ["topology", "u", "v"], "left").withColumn("completeness", F.coalesce("found", F.lit(0.0))).drop("found")


def summary(nodes: DataFrame, edge: DataFrame, closure: DataFrame) -> DataFrame:
    """A row for each topology: counts, nodes by layer, mean degrees, whether it has no cycle, longest shortest way."""
    n = nodes.groupBy("topology").agg(F.count("*").alias("n_nodes"), *(F.sum((F.col("layer") == k).cast("int")).alias(f"layer_{k}") for k in range(1, 6)))
    m = edge.groupBy("topology").agg(F.count("*").alias("n_edges"))
    loops = closure.groupBy("topology").agg(F.max((F.col("u") == F.col("v")).cast("int")).alias("loop"), F.max("hops").alias("max_hops"))
    mean = F.round(F.col("n_edges") / F.col("n_nodes"), 6)
    return n.join(m, "topology").join(loops, "topology").withColumn("avg_in_degree", mean).withColumn("avg_out_degree", mean).withColumn("is_dag", F.col("loop") == 0).drop("loop")


def with_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Nodes of each run in ``scores(run_id, node_id, score)`` with anomaly_score and is_anomalous (above 0.5); nodes
    without a score have 0."""
    every = nodes.crossJoin(scores.select("run_id").distinct())  # a graph's nodes, for each run
    out = every.join(scores.select("run_id", "node_id", F.col("score").alias("anomaly_score")), ["run_id", "node_id"], "left").fillna(0.0, ["anomaly_score"])
    return out.withColumn("is_anomalous", F.col("anomaly_score") > 0.5)
