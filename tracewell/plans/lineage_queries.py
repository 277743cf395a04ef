"""Registered lineage queries: graphs of scored runs, from their most anomalous sources, to their targets, and graphs that job
events give, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import faults, lineage, lineage_events, rank
from ..sources import market, topology
from ..sources.scratch import kept
from .catalogue import add, placed, prepared, scored
from .oracle import assembled, CTES, nodes_sql

# -- scored runs -----------------------------------------------------------------------------------------------------------


def hot_sources(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, topology, u): each run's most anomalous source."""
    s = lineage.with_scores(topology.nodes(spark, "market"), scored(spark, d)).where("layer = 1")
    best = s.groupBy("run_id", "topology").agg(F.max_by("node_id", F.struct("anomaly_score", -F.col("node_ord"))).alias("u"))
    return kept(best, "hot-sources")


def targets(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, topology, v): each run's target."""
    s = scored(spark, d)
    n, _, c, _ = prepared(spark, "market")
    return kept(rank.select_target(s, n, c).select("run_id", F.lit("market").alias("topology"), F.col("target").alias("v")), "targets")


def causes(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, topology, u, v): from each run's root cause to its target."""
    return faults.registered(spark).truth.select("run_id", F.col("node_id").alias("u")).join(targets(spark, d), "run_id")


def _closure(spark: SparkSession) -> DataFrame:
    return prepared(spark, "market")[2]


def _below(spark: SparkSession, d: str) -> DataFrame:
    return hot_sources(spark, d).join(_closure(spark), ["topology", "u"]).select("run_id", "u", F.col("v").alias("node_id"), "hops")


def _above(spark: SparkSession, d: str) -> DataFrame:
    return targets(spark, d).join(_closure(spark), ["topology", "v"]).select("run_id", F.col("v").alias("target"), F.col("u").alias("node_id"), "hops")


def _impact(spark: SparkSession, d: str) -> DataFrame:
    n = prepared(spark, "market")[0]
    reports = n.where("layer = 5").select("node_id", F.explode("output_columns").alias("column"))
    return _below(spark, d).join(reports, "node_id").select("run_id", "u", "node_id", "column")


def _between(spark: SparkSession, d: str) -> DataFrame:
    pairs = kept(causes(spark, d), "causes")
    return lineage.paths_between(prepared(spark, "market")[1], pairs).join(pairs, ["topology", "u", "v"]).select("run_id", F.array_join("path", ">").alias("path"))


def _shortest(spark: SparkSession, d: str) -> DataFrame:
    """One shortest way from each node above a run's target down to it."""
    at, n, e, _ = placed(spark, d)
    paths = lineage.shortest_paths(lineage.first_steps(e, _closure(spark), n))
    own = at.where("hops > 0").select("run_id", F.col("node_id").alias("u"), F.col("target").alias("v"), "hops")
    return own.join(paths, ["u", "v"]).select("run_id", F.col("u").alias("node_id"), F.col("v").alias("target"), "hops", F.array_join("path", ">").alias("path"))


_HOT = ("hot", "SELECT run_id, node_id AS u FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, node_ord) AS k FROM score WHERE layer = 1) WHERE k = 1")
_CAUSE = ("cause", "SELECT t.run_id, t.truth AS u, g.target AS v FROM truth t JOIN target g ON g.run_id = t.run_id")
_STEP = ("step", "SELECT u, v, hops, next FROM (SELECT e.u, c.v, c.hops, e.v AS next, row_number() OVER (PARTITION BY e.u, c.v ORDER BY n.node_ord) AS k FROM (SELECT DISTINCT u, v FROM edge) e JOIN closure c ON c.u = e.u LEFT JOIN closure r ON r.u = e.v AND r.v = c.v JOIN node n ON n.node_id = e.v WHERE c.hops = CASE WHEN e.v = c.v THEN 1 ELSE r.hops + 1 END) WHERE k = 1")


def _text(select: str, *more: tuple[str, str]) -> str:
    return assembled(CTES | dict(more), select)


add("descendants", _below, _text("SELECT h.run_id, h.u, c.v AS node_id, c.hops FROM hot h JOIN closure c ON c.u = h.u", _HOT))
add("ancestors", _above, _text("SELECT run_id, target, c.u AS node_id, c.hops FROM target t JOIN closure c ON c.v = t.target"))
add("impact", _impact, _text("SELECT h.run_id, h.u, c.v AS node_id, unnest(n.output_columns) AS \"column\" FROM hot h JOIN closure c ON c.u = h.u JOIN node n ON n.node_id = c.v WHERE n.layer = 5", _HOT))
add(
    "hop_distance", lambda spark, d: causes(spark, d).join(_closure(spark), ["topology", "u", "v"], "left").select("run_id", "u", "v", "hops"),
    _text("SELECT a.run_id, a.u, a.v, c.hops FROM cause a LEFT JOIN closure c ON c.u = a.u AND c.v = a.v", _CAUSE),
)
add("trace_completeness", lambda spark, d: lineage.trace_completeness(_closure(spark), causes(spark, d)).select("run_id", "u", "v", "completeness"), _text("SELECT a.run_id, a.u, a.v, CASE WHEN c.u IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS completeness FROM cause a LEFT JOIN closure c ON c.u = a.u AND c.v = a.v", _CAUSE))
add("simple_paths", _between, _text("SELECT run_id, path FROM (WITH RECURSIVE c AS (SELECT a.run_id, a.v AS goal, e.v, e.u || '>' || e.v AS path, 1 AS k FROM cause a JOIN edge e ON e.u = a.u UNION ALL SELECT c.run_id, c.goal, e.v, c.path || '>' || e.v, c.k + 1 FROM c JOIN edge e ON e.u = c.v WHERE c.k < 10 AND c.v <> c.goal) SELECT * FROM c) WHERE v = goal", _CAUSE))
add(
    "shortest_paths", _shortest,
    _text("SELECT run_id, node_id, target, hops, path FROM (WITH RECURSIVE w AS (SELECT p.run_id, p.node_id, p.target, p.hops, p.node_id AS here, p.node_id::VARCHAR AS path FROM placed p WHERE p.hops > 0 UNION ALL SELECT w.run_id, w.node_id, w.target, w.hops, s.next, w.path || '>' || s.next FROM w JOIN step s ON s.u = w.here AND s.v = w.target WHERE w.here <> w.target) SELECT * FROM w) WHERE here = target", _STEP),
)

# -- graphs from job events --------------------------------------------------------------------------------------------------

_SIZES = ("small", "medium", "large")


def job_events(spark: SparkSession, d: str) -> DataFrame:
    """An event of each row of the events table, for each size's graph: the row's number names the job, rows of type error
    are failed runs, and every second round of a job leaves out its last input."""
    n = topology.nodes(spark, *_SIZES)
    sizes = n.groupBy("topology").agg(F.count("*").alias("n"))
    e = market.table(spark, d, "events").select("event_id", "event_type", "ts").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    e = e.crossJoin(F.broadcast(sizes))  # every size has events of its own
    stamps = e.select(
        "topology", F.expr("cast(event_id % n as int)").alias("node_ord"), F.when(F.col("event_type") == "error", "FAIL").otherwise("COMPLETE").alias("event_type"), "ts",
        F.format_string("%010d", "event_id").alias("run_id"), F.expr("cast(floor(event_id / n) % 2 as int)").alias("without"),
    )
    return lineage_events.events(F.broadcast(n), stamps)  # as many nodes as the three sizes have


def event_nodes(spark: SparkSession, d: str) -> DataFrame:
    return kept(lineage_events.nodes_of(job_events(spark, d)), "event-nodes")


def _summed(spark: SparkSession, d: str) -> DataFrame:
    n = event_nodes(spark, d)
    e = kept(lineage.edges(n), "event-edges")
    return lineage.summary(n, e, lineage.closed(e)[0])


_OWN = {
    "topo": nodes_sql(*_SIZES), "counted": "SELECT *, count(*) OVER (PARTITION BY topology) AS n FROM topo",
    "sent": "SELECT c.* EXCLUDE (upstream, input_columns), e.event_id, floor(event_id / n) % 2 AS without, c.upstream AS u0, c.input_columns AS i0, row_number() OVER (PARTITION BY c.topology, c.node_id ORDER BY ts DESC, event_id DESC) AS k FROM counted c JOIN events e ON e.event_id % c.n = c.node_ord WHERE e.event_type IS DISTINCT FROM 'error'",
    "node": "SELECT * EXCLUDE (u0, i0), printf('%010d', event_id) AS last_run_id, u0[1:greatest(len(u0) - without, 0)::INT] AS upstream, i0[1:greatest(len(u0) - without, 0)::INT] AS input_columns FROM sent WHERE k = 1",
    "edge": CTES["edge"], "closure": "SELECT topology, u, v, min(hops) AS hops FROM (WITH RECURSIVE c AS (SELECT topology, u, v, 1 AS hops FROM edge UNION SELECT c.topology, c.u, e.v, c.hops + 1 FROM c JOIN edge e ON e.topology = c.topology AND e.u = c.v WHERE c.hops < 10) SELECT * FROM c) GROUP BY 1, 2, 3",
}
_NODE = ("topology", "node_id", "node_ord", "layer", "transform_type", "expected_input_count", "last_run_id")
add(
    "lineage_nodes", lambda spark, d: event_nodes(spark, d).select(*_NODE, F.array_join("input_columns", ",").alias("inputs"), F.array_join("output_columns", ",").alias("outputs")),
    assembled(_OWN, f"SELECT {', '.join(_NODE)}, array_to_string(input_columns, ',') AS inputs, array_to_string(output_columns, ',') AS outputs FROM node"),
)
add(
    "lineage_edges", lambda spark, d: lineage.edges(event_nodes(spark, d)).select("topology", "u", "v", "edge_type", "weight_prior", F.array_join("source_columns", ",").alias("source_columns"), F.array_join("target_columns", ",").alias("target_columns")),
    assembled(_OWN, "SELECT topology, u, v, edge_type, weight_prior, array_to_string(source_columns, ',') AS source_columns, array_to_string(target_columns, ',') AS target_columns FROM edge"),
)
_LAYERS = ", ".join(f"sum((layer = {k})::INT)::BIGINT AS layer_{k}" for k in range(1, 6))
add(
    "graph_summary", _summed,
    assembled(_OWN, f"SELECT n.*, m.n_edges, (SELECT max(hops) FROM closure c WHERE c.topology = n.topology) AS max_hops, round(m.n_edges / n.n_nodes, 6) AS avg_in_degree, round(m.n_edges / n.n_nodes, 6) AS avg_out_degree, NOT EXISTS (SELECT 1 FROM closure c WHERE c.topology = n.topology AND c.u = c.v) AS is_dag FROM (SELECT topology, count(*) AS n_nodes, {_LAYERS} FROM node GROUP BY 1) n JOIN (SELECT topology, count(*) AS n_edges FROM edge GROUP BY 1) m USING (topology)"),
)


def _reported(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the event graph, one of whose jobs in eight names a further input (a job at a later place, or an unknown one)."""
    n = event_nodes(spark, d)
    further = F.when(F.col("last_run_id").cast("long") % 16 == 0, F.concat(F.lit("LOST_"), "node_id")).when(F.col("last_run_id").cast("long") % 16 == 8, F.lit("REPORT_LIMIT"))
    return lineage.faults_of(n.withColumn("upstream", F.when(further.isNotNull(), F.array_append("upstream", further)).otherwise(F.col("upstream"))))


_BAD = _OWN | {
    "bad": "SELECT * REPLACE (CASE WHEN event_id % 16 = 0 THEN list_append(upstream, 'LOST_' || node_id) WHEN event_id % 16 = 8 THEN list_append(upstream, 'REPORT_LIMIT') ELSE upstream END AS upstream) FROM node",
    "wanted": "SELECT DISTINCT topology, node_id, unnest(upstream) AS u FROM bad", "link": "SELECT w.topology, w.u, w.node_id AS v FROM wanted w",
    "way": "SELECT DISTINCT topology, u, v FROM (WITH RECURSIVE c AS (SELECT topology, u, v FROM link UNION SELECT c.topology, c.u, e.v FROM c JOIN link e ON e.topology = c.topology AND e.u = c.v) SELECT * FROM c)",
    "cycle": "SELECT a.topology, a.u AS node_id, min(a.v) AS part FROM way a JOIN way b ON b.topology = a.topology AND b.u = a.v AND b.v = a.u GROUP BY 1, 2",
    "gives": "SELECT w.topology, w.node_id, unnest(b.output_columns) AS c FROM wanted w JOIN bad b ON b.topology = w.topology AND b.node_id = w.u",
    "takes": "SELECT DISTINCT topology, node_id, unnest(input_columns) AS c FROM bad WHERE len(upstream) > 0",
}
add(
    "graph_faults", _reported,
    assembled(_BAD, "SELECT topology, 'dangling' AS fault, node_id, u AS detail FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.topology = w.topology AND b.node_id = w.u) UNION ALL SELECT topology, 'cycle', node_id, part FROM cycle UNION ALL SELECT topology, 'column', node_id, c FROM takes t WHERE NOT EXISTS (SELECT 1 FROM gives g WHERE g.topology = t.topology AND g.node_id = t.node_id AND g.c = t.c) UNION ALL SELECT topology, 'repeated', node_id, count(*)::VARCHAR FROM bad GROUP BY 1, 3 HAVING count(*) > 1"),
)
