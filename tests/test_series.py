"""Dataflow, scores, rankings and figures against pandas on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import dataflow, detect, evaluate, rank
from tracewell.sources import market, topology


@pytest.fixture(scope="module")
def source(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in (1, 2, 3):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150)))
        for t, v in enumerate(price):
            gap = t in (0, 1) and k == 1 or t in (40, 41)
            rows.append(("r", f"STOCK_{k}_PRICE", t, None if gap else float(v * (9 if t == 100 else 1))))
            rows.append(("r", f"POSITION_{k}_SIZE", t, float(1000 + k + t)))
    rows += [("r", "USD_KRW", t, 1.0 + t / 1000) for t in range(150)]
    return spark.createDataFrame(rows, "run_id string, col string, t int, value double")


def test_dataflow_equals_pandas(source):
    frame = dataflow.instruments(source)
    got = frame.orderBy("i", "t").toPandas()
    wide = source.toPandas().pivot(index="t", columns="col", values="value")
    returns = {}
    for k in (1, 2, 3):
        own = got[got.i == k].set_index("t")
        clean = wide[f"STOCK_{k}_PRICE"].astype(float).ffill()
        mu, sd = clean.iloc[:60].mean(), max(clean.iloc[:60].std(), 1e-8)
        cut = clean.clip(mu - 4 * sd, mu + 4 * sd)
        ret = np.log(cut).diff().fillna(0)
        returns[k] = ret
        for name, want in {"clean": clean, "filtered": cut, "krw": cut * wide["USD_KRW"], "ret": ret, "vol20": ret.rolling(20).std().bfill().ffill().fillna(0), "vol60": ret.rolling(60).std().bfill().ffill().fillna(0)}.items():
            assert np.allclose(own[name].astype(float), want, equal_nan=True, atol=1e-9), name
    day = dataflow.portfolio(frame, 3).orderBy("t").toPandas().set_index("t")
    mean = sum(returns.values()) / 3
    assert np.allclose(day.var95, mean.rolling(60).quantile(0.05).fillna(0), atol=1e-9)
    tail = mean.rolling(60).apply(lambda x: x[x <= np.percentile(x, 5)].mean(), raw=True).fillna(0)
    assert np.allclose(day.es95, tail, atol=1e-9)
    assert np.allclose(day.stress, mean * (-0.2 / mean.std()), atol=1e-9)


def test_short_series_score_nothing(spark):
    rows = [("r", f"n{n}", t, float(t % 3)) for n in (4, 9, 10, 39, 40) for t in range(n)] + [("r", "flat", t, 1.0) for t in range(100)]
    rows = detect.numbered(spark.createDataFrame(rows, "run_id string, node_id string, t int, value double"))
    raw = {r.node_id: r.raw for r in detect.raw_score(rows).collect()}
    sl = {r.node_id: r.sl for r in detect.short_long(rows).collect()}
    assert raw["n4"] == raw["n9"] == 0 == raw["flat"] and sl["n39"] == 0 == sl["flat"] and raw["n10"] > 0


def test_walk_equals_its_fixed_point(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "u string, v string")
    t = edges.select(F.lit("r").alias("run_id"), F.col("v").alias("frm"), F.col("u").alias("to"), F.lit(0.5).alias("p"))
    e = spark.createDataFrame([("r", "d", 0.7), ("r", "a", 0.3)], "run_id string, node_id string, e double")
    got = {r.node_id: r.r for r in rank.walked(t, e, 0.15, 2).collect()}
    order = ["a", "b", "c", "d"]
    p = np.zeros((4, 4))
    for u, v in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")):
        p[order.index(u), order.index(v)] = 0.5
    want = 0.15 * np.linalg.inv(np.eye(4) - 0.85 * p) @ np.array([0.3, 0, 0, 0.7])
    assert np.allclose([got[x] for x in order], want)


def test_metrics_of_a_missing_truth(spark):
    ranking = spark.createDataFrame([("r", "m", "t", "a", 1.0, 1), ("r", "m", "t", "b", 0.5, 2), ("q", "m", "t", "a", 1.0, 1)], "run_id string, method string, target string, node_id string, score double, rank int")
    truth = spark.createDataFrame([("r", "A1", "b"), ("q", "A1", "zz")], "run_id string, anomaly_type string, node_id string")
    got = {r.run_id: r for r in evaluate.run_metrics(ranking, truth).collect()}
    assert (got["r"]["rank"], got["r"].top1, got["r"].top3, got["r"].reciprocal_rank) == (2, 0, 1, 0.5)
    assert (got["q"]["rank"], got["q"].top5, got["q"].reciprocal_rank, got["q"].false_rc_rate_k5) == (None, 0, 0.0, 1.0)


def test_generated_series_depend_on_seed_alone(spark):
    seeds = spark.createDataFrame([(1,), (2,)], "seed bigint")
    a = market.generated(spark, seeds, 30).orderBy("seed", "col", "t").toPandas()
    b = market.generated(spark, seeds.repartition(3), 30).orderBy("seed", "col", "t").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 2 * 30 * (5 + 3 + 2 + 5) and (a[a.col.str.startswith("RATE")].value >= 0).all()


def test_topology_rows_match_their_sql():
    assert topology.sql_values("small").count("(") == 43
