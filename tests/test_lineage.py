"""Goldens of the graph for each named size, and edge cases of its queries."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import lineage
from tracewell.sources import topology

#: Nodes, edges, nodes by layer, longest way, ancestors of the four reports.
GOLDEN = {"small": (43, 59, (9, 12, 12, 6, 4), (13, 18, 13, 28)), "medium": (63, 93, (15, 20, 18, 6, 4), (21, 28, 21, 44)), "large": (91, 144, (22, 32, 27, 6, 4), (33, 43, 33, 68))}
REPORTS = ("REPORT_REG_VAR", "REPORT_DASHBOARD", "REPORT_STRESS", "REPORT_LIMIT")


@pytest.fixture(scope="module")
def graph(spark):
    n = topology.nodes(spark, *GOLDEN).cache()
    e = lineage.edges(n).cache()
    return n, e, lineage.reach(e).cache()


def test_sizes(graph):
    for r in lineage.summary(*graph).collect():
        nodes, edges, layers, _ = GOLDEN[r.topology]
        assert (r.n_nodes, r.n_edges) == (nodes, edges) and r.is_dag
        assert tuple(r[f"layer_{k}"] for k in range(1, 6)) == layers


def test_ancestors(graph):
    for name, (*_, counts) in GOLDEN.items():
        got = tuple(lineage.ancestors(graph[2], r).where(F.col("topology") == name).count() for r in REPORTS)
        assert got == counts


def test_unknown_and_isolated_nodes(graph):
    assert lineage.descendants(graph[2], "NONE").count() == 0
    assert lineage.ancestors(graph[2], "SRC_RATE_SHORT").count() == lineage.descendants(graph[2], "SRC_RATE_SHORT").count() == 0
    assert lineage.simple_paths(graph[1], "NONE", "REPORT_LIMIT").count() == 0


def test_var_and_shortfall_are_peers(graph):
    keys = {r.node_id: r.peer_key for r in graph[0].where("topology = 'small'").collect()}
    assert keys["RISK_VAR95"] == keys["RISK_ES95"] != keys["RISK_VAR99"]


def test_deep_and_cyclic_graphs_are_followed_to_the_end(spark):
    deep = spark.createDataFrame([("d", f"n{k}", f"n{k + 1}") for k in range(25)] + [("d", "n0", "n20")], "topology string, u string, v string")
    hops = {(r.u, r.v): r.hops for r in lineage.reach(deep).collect()}
    assert len(hops) == 26 * 25 // 2 and hops["n0", "n20"] == 1 and hops["n0", "n25"] == 6 and hops["n1", "n25"] == 24
    assert lineage.depth(deep) == 25
    ring = spark.createDataFrame([("c", "a", "b"), ("c", "b", "c"), ("c", "c", "a")], "topology string, u string, v string")
    assert {(r.u, r.v): r.hops for r in lineage.reach(ring).collect()} == {(x, y): (ord(y) - ord(x) - 1) % 3 + 1 for x in "abc" for y in "abc"}
    with pytest.raises(ValueError):
        lineage.depth(ring)


def test_job_events_are_parsed_once_each_and_the_latest_counts(spark):
    from tracewell.operators import lineage_events

    def event(job, time, run, kind="COMPLETE", space="s"):
        where = f'"namespace": "{space}", ' if space else ""
        return (f'{{"eventType": "{kind}", "eventTime": "2024-01-0{time}T00:00:00Z", "run": {{"runId": "{run}"}}, "job": {{{where}"name": "{job}"}}}}',)

    rows = [event("a", 1, "9"), event("a", 2, "1"), event("a", 2, "3"), event("a", 2, "2"), event("a", 3, "7", "FAIL"), event("a", 1, "5", space=None), ("no json",), (None,), ('{"eventType": "COMPLETE", "job": {"name": "b"}}',)]
    raw = spark.createDataFrame(rows, "event string")
    found = lineage_events.nodes_of(raw)
    assert {(r.topology, r.node_id, r.last_run_id) for r in found.collect()} == {("s", "a", "3"), (None, "a", "5")}
    assert lineage_events.nodes_of(raw, rejected=True).count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("from_json" in line for line in plan if "Generate" not in line)  # no condition parses an event again
