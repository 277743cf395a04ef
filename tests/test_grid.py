"""Grids of runs: draws, volatilities of any width, overrides, groupings, graphs and paths against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import dataflow, evaluate, faults, grid, lineage, lineage_events
from tracewell.sources import topology


def plain_draw(seed, key, n):
    return grid.drawn_number(seed, key) % n


def test_draws_and_places(spark):
    days = spark.createDataFrame([(1000,)], "n_days int")
    rows = grid.runs(spark, days, ("small", "large"), trials=40).collect()
    assert len(rows) == 7 * 2 * 40 and len({r.run_id for r in rows}) == len(rows)
    for r in rows:
        stocks = topology.SIZES[r.topology][0]
        assert r.stock == 1 + plain_draw(r.id, 1, stocks) and r["shift"] == plain_draw(r.trial + 42, 1, 1000 - 252 + 1)
        assert r.other != r.stock and 1 <= r.other <= stocks and len({r.stock, r.second, r.third}) == 3
        assert r.half == max(1, stocks // 2) and (r.member > r.half) == r.second_sector and 1 <= r.member <= stocks
        if r.anomaly_type in ("A1", "A5", "A6", "A7"):
            assert 60 <= r.t_from < r.t_to <= 252
        if r.anomaly_type == "A1":
            assert r.t_from == 60 + plain_draw(r.id, 4, 182) and r.t_to == r.t_from + 1 + plain_draw(r.id, 5, 5)
    assert {r.stock for r in rows if r.topology == "large"} == set(range(1, 9))
    short = grid.runs(spark, spark.createDataFrame([(100,)], "n_days int"), ("small",), trials=2)
    assert short.where("shift <> 0").count() == 0


def test_volatility_of_any_width(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i, width in enumerate(range(1, 21)):
        ret = rng.normal(size=60) * 1e-3 + 5
        ret[40:45] = ret[40]
        rows += [("r", i, t, float(v), width) for t, v in enumerate(ret)]
        want |= {(i, t): ret[t + 1 - width : t + 1].std(ddof=1) if width > 1 and t + 1 >= width else None for t in range(60)}
    df = spark.createDataFrame(rows, "run_id string, i int, t int, ret double, width int")
    got = df.withColumn("v", dataflow.volatility(F.col("width"))).collect()
    assert len(got) == 1200
    for r in got:
        w = want[r.i, r.t]
        assert r.v is None if w is None else abs(r.v - w) < 1e-12


def plain_series(spark, n_stocks, overrides, days=90):
    rng = np.random.default_rng(n_stocks)
    prices = {k: 100 + np.cumsum(rng.normal(size=days)) for k in range(1, n_stocks + 1)}
    rows = [("r", f"STOCK_{k}_PRICE", t, float(v)) for k, s in prices.items() for t, v in enumerate(s)]
    rows += [("r", f"POSITION_{k}_SIZE", t, 10.0 * k) for k in prices for t in range(days)] + [("r", "USD_KRW", t, 2.0) for t in range(days)]
    source = spark.createDataFrame(rows, "run_id string, col string, t int, value double")
    runs = spark.createDataFrame([("r", "x", n_stocks)], faults.RUNS)
    single = dataflow.instruments(source, runs, spark.createDataFrame(overrides, faults.OVERRIDES)).cache()
    return single.toPandas(), dataflow.portfolio(single).toPandas().sort_values("t")


@pytest.mark.parametrize(("n", "node", "member", "left"), [(5, "FEAT_SECTOR_B", 4, [3, 5]), (5, "FEAT_SECTOR_A", 1, [2]), (3, "FEAT_SECTOR_A", 1, [1]), (1, "FEAT_SECTOR_B", 1, [1]), (8, "FEAT_SECTOR_B", 8, [5, 6, 7])])
def test_sectors_leave_a_member_out(spark, n, node, member, left):
    single, day = plain_series(spark, n, [("r", node, None, None, None, None, member)])
    column = "sector_a" if node.endswith("A") else "sector_b"
    want = single[single.i.isin(left)].groupby("t").ret.mean()
    assert np.allclose(day.set_index("t")[column], want, atol=1e-12)


def test_overrides_of_several_nodes_of_a_run(spark):
    plain = plain_series(spark, 3, [("other", "ETL_FX_STOCK_1_PRICE", 9.0, 0, 9, None, None)])[0].set_index(["i", "t"])
    single = plain_series(spark, 3, [("r", "ETL_FX_STOCK_2_PRICE", 8.0, 10, 14, None, None), ("r", "ETL_FX_STOCK_3_PRICE", 2.0, None, None, None, None), ("r", "FEAT_VOL20_STOCK_2_PRICE", 4.0, None, None, 5, None)])[0].set_index(["i", "t"])
    extra = np.where((np.arange(90) >= 10) & (np.arange(90) < 14), 3, 1)
    assert np.allclose(single.loc[2].sort_index().krw, plain.loc[2].sort_index().krw * 8 * extra)
    assert np.allclose(single.loc[3].sort_index().krw, plain.loc[3].sort_index().krw * 2 * np.where((np.arange(90) >= 30) & (np.arange(90) < 40), 3, 1))
    ret = plain.loc[2].sort_index().ret
    assert np.allclose(single.loc[2].sort_index().vol20, ret.rolling(5).std().fillna(0) * 4) and np.allclose(single.loc[1].sort_index().vol20, plain.loc[1].sort_index().vol20)


def test_groupings(spark):
    rows = [(m, a, s, k % 2, 1, 1, 0.5, 0.25) for m in ("v1", "v2") for a in ("A1", "A2") for s in ("small", None) for k in range(3)]
    m = spark.createDataFrame(rows, "method string, anomaly_type string, pipeline_size string, top1 int, top3 int, top5 int, reciprocal_rank double, false_rc_rate_k5 double")
    got = evaluate.grouped_summary(m).collect()
    assert sorted(r.grouping for r in got) == [1] * 4 + [2] * 4 + [3] * 2
    assert {(r.method, r.n_runs) for r in got if r.grouping == 3} == {("v1", 12), ("v2", 12)}
    assert {(r.method, r.anomaly_type) for r in got if r.grouping == 1} == {(a, b) for a in ("v1", "v2") for b in ("A1", "A2")}


def test_closures_of_both_kinds_agree(spark, monkeypatch):
    n = topology.nodes(spark, "small", "large")
    e = lineage.edges(n)
    one, depth = lineage.closed(e)
    monkeypatch.setattr(lineage, "ONE_TASK", 0)
    other, same = lineage.closed(e)
    cols = ("topology", "u", "v", "hops")
    assert depth == same == 7 and sorted(one.select(*cols).collect()) == sorted(other.select(*cols).collect())
    monkeypatch.setattr(lineage, "ONE_TASK", 100)
    ring = spark.createDataFrame([("c", "a", "b"), ("c", "b", "a")], "topology string, u string, v string")
    with pytest.raises(Exception, match="cycle"):
        lineage.closed(ring)


def test_shortest_paths(spark):
    rows = [("g", a, k, b) for k, (a, b) in enumerate({"a": [], "b": ["a"], "c": ["a"], "d": ["c", "b"], "e": ["d"], "f": ["e", "a"], "g": ["f"], "h": ["g", "e"], "x": []}.items())]
    n = spark.createDataFrame(rows, "topology string, node_id string, node_ord int, upstream array<string>")
    e = n.select("topology", F.explode("upstream").alias("u"), F.col("node_id").alias("v"))
    got = {(r.u, r.v): "".join(r.path) for r in lineage.shortest_paths(lineage.first_steps(e, lineage.reach(e), n)).collect()}
    assert got["a", "d"] == "abd" and got["a", "g"] == "afg" and got["b", "h"] == "bdeh" and got["a", "h"] == "afgh" and got["e", "h"] == "eh"
    assert set(got) == {(r.u, r.v) for r in lineage.reach(e).collect()}


def test_faults_of_graphs(spark):
    def node(name, upstream=(), inputs=(), outputs=None):
        return ("g", name, 1, list(inputs), [outputs or name.upper()], list(upstream))

    cols = "topology string, node_id string, layer int, input_columns array<string>, output_columns array<string>, upstream array<string>"
    sound = [node("a"), node("b", ["a"], ["A"]), node("c", ["b"], ["B"])]
    assert lineage.faults_of(spark.createDataFrame(sound, cols)).count() == 0
    bad = [*sound, node("c", ["b"], ["B"]), node("d", ["c", "lost"], ["C", "NONE"]), node("p", ["q", "d"], ["Q", "D"]), node("q", ["r"], ["R"]), node("r", ["p"], ["P"]), node("s", ["s"], ["S"]), node("t", ["r"], ["R"]), node("u", ["t"], ["T"])]
    got = sorted((r.fault, r.node_id, r.detail) for r in lineage.faults_of(spark.createDataFrame(bad, cols)).collect())
    assert got == [("column", "d", "NONE"), ("cycle", "p", "p"), ("cycle", "q", "p"), ("cycle", "r", "p"), ("cycle", "s", "s"), ("dangling", "d", "lost"), ("repeated", "c", "2")]


def test_events_give_the_graph(spark):
    n = topology.nodes(spark, "small")
    stamp = lambda ts, kind, run, without: n.select("topology", "node_ord", F.lit(kind).alias("event_type"), F.lit(ts).cast("timestamp").alias("ts"), F.lit(run).alias("run_id"), F.lit(without).alias("without"))
    old, new, failed = stamp("2024-01-01 00:00:00", "COMPLETE", "r1", 1), stamp("2024-01-02 00:00:00.000001", "COMPLETE", "r2", 0), stamp("2024-01-03 00:00:00", "FAIL", "r3", 1)
    raw = lineage_events.events(n, old.unionByName(new).unionByName(failed))
    junk = spark.createDataFrame([("{",), ("null",), ('{"eventType": "COMPLETE"}',), (None,)], "event string")
    got = lineage_events.nodes_of(raw.unionByName(junk))
    assert lineage_events.nodes_of(raw.unionByName(junk), rejected=True).count() == 4
    cols = ("topology", "node_id", "node_ord", "layer", "transform_type", "input_columns", "output_columns", "upstream", "expected_input_count")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, n.select(*cols).collect()))
    assert sorted(map(tuple, lineage.edges(got).collect())) == sorted(map(tuple, lineage.edges(n).collect()))
    before = lineage_events.nodes_of(lineage_events.events(n, old))
    assert before.where("node_id = 'FEAT_SECTOR_B'").first().upstream == ["FEAT_RETURN_STOCK_2_PRICE"]
    for a, b in ((before, got), (got, before)):
        assert sorted(map(str, lineage_events.upserted(a, b).select(*got.columns).collect())) == sorted(map(str, got.collect()))
    one = got.where("node_id = 'REPORT_LIMIT'")
    assert lineage_events.upserted(before, one).where("last_run_id = 'r2'").count() == 1 and lineage_events.upserted(before, one).count() == 43
