"""Learned scorers and re-rankers: gradients against differences, and what they find on planted cases."""

import numpy as np

from tracewell.operators import autoencoder, causal, graphnet, learned


def slopes(value, arrays, rng, places=4):
    """(analytic place, numeric slope) at a few places of each array."""
    for k, p in enumerate(arrays):
        for _ in range(min(places, p.size)):
            at = tuple(int(rng.integers(s)) for s in p.shape)
            old = p[at]
            p[at] = old + 1e-6
            up = value()
            p[at] = old - 1e-6
            down = value()
            p[at] = old
            yield k, at, (up - down) / 2e-6


def test_autoencoder_gradients():
    rng = np.random.default_rng(3)
    for by_kind, told in ((False, True), (True, False), (True, True)):
        model = autoencoder.fitted(rng.normal(size=(8, 20)), np.eye(autoencoder.CONDITION)[:8], by_kind, told, epochs=0)
        x, c, noise = rng.normal(size=(9, 20)), np.eye(autoencoder.CONDITION)[[0, 1, 2, 3, 4, 5, 0, 1, 2]], rng.normal(size=(9, autoencoder.LATENT))
        arrays = [*model.encoder, *(p for d in model.decoders for p in d)]
        grads = autoencoder.loss(model, x, c, noise)[1]
        assert len(grads) == len(arrays)
        for k, at, slope in slopes(lambda: autoencoder.loss(model, x, c, noise)[0], arrays, rng):
            assert abs(grads[k][at] - slope) < 1e-6


def test_graph_network_gradients():
    rng = np.random.default_rng(4)
    for relations in (1, 6):
        p = graphnet.parameters(relations, biased=relations == 1)
        x, first, second = rng.normal(size=(7, 8)), rng.random((relations, 7, 7)), rng.random((7, 7))
        y, keep = np.eye(7)[2], (rng.random((relations, 7, graphnet.HIDDEN)) > 0.3) / 0.7
        grads = graphnet.loss(p, x, first, second, y, keep)[1]
        for k, at, slope in slopes(lambda: graphnet.loss(p, x, first, second, y, keep)[0], p, rng):
            assert abs(grads[k][at] - slope) < 1e-5


def test_boundary_leaves_a_share_outside():
    rng = np.random.default_rng(5)
    b = learned.bounded(rng.normal(size=(2000, 20)))
    usual, far = b.rho - b.mapped(rng.normal(size=(2000, 20))) @ b.w, b.rho - b.mapped(rng.normal(size=(50, 20)) + 4) @ b.w
    assert 0.05 < (usual > 0).mean() < 0.2 and (far > 0).all()


SERIES = "run_id string, node_id string, t int, value double"
NODES = "node_id string, node_ord int, layer int, transform_type string"


def test_scores_of_a_jump(spark):
    rng = np.random.default_rng(6)
    clean = spark.createDataFrame([("c", f"n{k}", t, float(v)) for k in range(4) for t, v in enumerate(rng.normal(size=200))], SERIES)
    odd = [("x", "calm", t, float(v)) for t, v in enumerate(rng.normal(size=200))] + [("x", "trend", t, float(v) * 0.01 + t) for t, v in enumerate(rng.normal(size=200))] + [("x", "flat", t, 1.0) for t in range(200)]
    odd = spark.createDataFrame(odd, SERIES)
    nodes = spark.createDataFrame([("calm", 0, 1, "source"), ("trend", 1, 2, "filter")], NODES)
    for got in (autoencoder.autoencoder_scores(odd, clean, nodes, epochs=5), autoencoder.autoencoder_scores(odd, clean, nodes, by_kind=True, told=False, epochs=5), learned.boundary_scores(odd, clean)):
        s = {r.node_id: r.score for r in got.collect()}
        assert set(s) == {"calm", "trend", "flat"} and s["flat"] == 0.0 and all(0 <= v <= 1 for v in s.values())
    assert autoencoder.autoencoder_scores(odd, clean.limit(0), nodes).where("score <> 0").count() == 0
    assert learned.boundary_scores(odd.limit(0), clean.limit(0)).count() == 0


def test_skeleton_and_directions_of_a_collider_and_a_chain():
    rng = np.random.default_rng(7)
    n = 5000
    a, b = rng.normal(size=n), rng.normal(size=n)
    c = a + b + 0.5 * rng.normal(size=n)
    d = c + 0.5 * rng.normal(size=n)
    r = np.corrcoef([a, b, c, d])
    linked, apart = causal.skeleton(r, n, alpha=0.001)
    assert {tuple(x) for x in np.argwhere(np.triu(linked)).tolist()} == {(0, 2), (1, 2), (2, 3)}
    got = causal.oriented(linked, apart, np.zeros(4, int))
    assert {tuple(x) for x in np.argwhere(got).tolist()} == {(0, 2), (1, 2), (2, 3)}
    x, y = np.array([a, d]), np.array([b, c])
    left = [v - np.linalg.lstsq(np.c_[y.T, np.ones(n)], v, rcond=None)[0] @ np.c_[y.T, np.ones(n)].T for v in x]
    assert abs(causal.partial_correlations(r, 0, 3, np.array([[1, 2]]))[0] - np.corrcoef(left)[0, 1]) < 1e-9


def test_sums_of_products_and_ranking(spark):
    rng = np.random.default_rng(8)
    a = np.cumsum(rng.normal(size=400)) * 0.01
    b = 0.01 * np.cumsum(rng.normal(size=400)) * 0.3 + a
    rows = [("r", n, t, float(np.exp(v))) for n, s in (("A", a), ("B", b)) for t, v in enumerate(s)]
    series = spark.createDataFrame(rows, SERIES)
    nodes = spark.createDataFrame([("A", 0, 1, "source"), ("B", 1, 2, "filter"), ("C", 2, 3, "report")], NODES)
    row = causal.products(causal.changes(series), nodes).first()
    s = {(c.i, c.j): c.s for c in row.cells}
    assert row.n == 399 and abs(s[0, 1] / np.sqrt(s[0, 0] * s[1, 1]) - np.corrcoef(np.diff(a), np.diff(b))[0, 1]) < 1e-6
    edge = spark.createDataFrame([("A", "B", "filter"), ("B", "C", "report")], "u string, v string, edge_type string")
    at = nodes.selectExpr("'r' as run_id", "node_id", "node_ord", "layer", "0.5D as score", "'C' as target").union(nodes.selectExpr("'none'", "node_id", "node_ord", "layer", "0.0D", "'C'"))
    got = {(r.run_id, r.node_id): r.score for r in causal.rank_causal(series, at, nodes, edge).collect()}
    assert set(got) == {("r", "A"), ("r", "B"), ("none", "A"), ("none", "B")} and got["r", "B"] > got["r", "A"] and got["none", "B"] > got["none", "A"]


def test_network_finds_the_marked_node(spark):
    rng = np.random.default_rng(9)
    rows, truth = [], []
    for k in range(42):
        cause = int(rng.integers(4))
        rows += [(f"r{k}", f"n{i}", *(float(v) for v in rng.random(7)), float(i == cause)) for i in range(4)]
        if k < 40:
            truth.append((f"r{k}", f"n{cause}", k % 5))
    features = spark.createDataFrame(rows, "run_id string, node_id string, " + ", ".join(f"f{k} double" for k in range(8)))
    edge = spark.createDataFrame([("n0", "n1", "filter"), ("n1", "n2", "aggregate"), ("n2", "n3", "report"), ("n0", "far", "filter")], "u string, v string, edge_type string")
    link = graphnet.links(features, edge)
    whole = {(r.node_id, r.other): r.weight for r in graphnet.adjacency(link).where("run_id = 'r0'").collect()}
    assert abs(whole["n2", "n1"] - 0.45 / np.sqrt(1.45 * 1.8)) < 1e-12 and len(whole) == 7
    sample = graphnet.samples(features, link)
    for relational in (False, True):
        got = graphnet.network_scores(sample, spark.createDataFrame(truth, "run_id string, node_id string, fold int"), relational, epochs=60).toPandas()
        best = got.loc[got.groupby("run_id").score.idxmax()].set_index("run_id").node_id
        marked = {r[0]: r[1] for r in rows if r[9] == 1.0}
        assert len(got) == 168 and sum(best[r] == n for r, n in marked.items()) >= 34
    assert graphnet.network_scores(sample, spark.createDataFrame([], "run_id string, node_id string, fold int")).count() == 0
