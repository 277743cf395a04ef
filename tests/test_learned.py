"""The isolation forest: its scores against a plain walk down the trees, and scores of nodes."""

import numpy as np

from tracewell.operators import learned


def test_forest_scores_equal_single_walks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    x[0] = 9.0
    forest = learned.grow(x, trees=20, per_tree=64)

    def depth(row):
        total = 0.0
        for k in forest.roots:
            while forest.value[k] >= 0:
                k = forest.children[k][int(row[forest.value[k]] > forest.cut[k])]
            total += forest.depth[k]
        return total / len(forest.roots)

    got = forest.scores(x)
    assert np.allclose(got, [2 ** (-depth(r) / float(learned._mean_depth(64))) for r in x])
    assert got.argmax() == 0 and (got > 0).all() and (got < 1).all()


def test_windows_are_standardised(spark):
    rows = [("r", "a", t, float(t % 7)) for t in range(30)] + [("r", "gap", t, None if t == 5 else float(t)) for t in range(21)] + [("r", "flat", t, 1.0) for t in range(30)] + [("r", "short", t, float(t)) for t in range(19)]
    got = learned.windows(spark.createDataFrame(rows, "run_id string, node_id string, t int, value double")).toPandas()
    assert got.groupby("node_id").size().to_dict() == {"a": 11, "gap": 1}
    v = np.array([t % 7 for t in range(30)], float)
    first = got[(got.node_id == "a") & (got.t == 19)].w.iloc[0]
    assert np.allclose(first, ((v - v.mean()) / v.std())[:20])


def test_a_jump_scores_above_clean_series(spark):
    rng = np.random.default_rng(2)
    clean = [("c", f"n{k}", t, float(v)) for k in range(4) for t, v in enumerate(rng.normal(size=200))]
    odd = [("x", "calm", t, float(v)) for t, v in enumerate(rng.normal(size=200))] + [("x", "jump", t, float(v) + (60 if 90 < t < 130 else 0)) for t, v in enumerate(rng.normal(size=200))] + [("x", "flat", t, 1.0) for t in range(200)]
    schema = "run_id string, node_id string, t int, value double"
    clean = spark.createDataFrame(clean, schema)
    got = {r.node_id: r.score for r in learned.isolation_scores(spark.createDataFrame(odd, schema), clean).collect()}
    assert set(got) == {"calm", "jump", "flat"} and got["flat"] == 0.0 and all(0 <= v <= 1 for v in got.values())
    none = learned.isolation_scores(clean.limit(0), clean.limit(0))
    assert none.count() == 0


def test_values_of_neighbouring_doubles_are_told_apart():
    x = np.array([[1.0], [np.nextafter(1.0, 2.0)]] * 50)
    forest = learned.grow(x, trees=50, per_tree=16)
    assert (forest.children[forest.value >= 0] > np.flatnonzero(forest.value >= 0)[:, None]).all() and (forest.cut[forest.value >= 0] == 1.0).all()
