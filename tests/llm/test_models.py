import random
import uuid
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from tracewell.llm import ann, toxicity


def test_neighbours_are_found(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:1200] = x[3]  # one value that a third of all rows share
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(5000, None, 1), (5020, [0.0] * 16, 1), (None, [1.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [1.0] * 3, 1), (5080, [None] * 16, 1)]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int"), F.col("vec_id") % 20 == 0, centroids=6, least=400, block=100).toPandas()
    hits = 0
    for q in range(0, 1500, 20):
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        order = np.lexsort((np.arange(len(x)), -scores))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, scores[own.vec_id], atol=1e-12)
        assert (np.diff(own.score) <= 0).all()
        same = own.score.to_numpy()[1:] == own.score.to_numpy()[:-1]
        assert (np.diff(own.vec_id)[same] > 0).all()
        hits += len(set(order) & set(own.vec_id))
    assert hits / (75 * 20) >= 0.9
    assert set(got.query_id) == set(range(0, 1500, 20))


def test_few_vectors_and_none(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.5, 0.5]), (3, [0.5, 0.5])]
    got = [tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert ann.search(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0


def test_cells_come_in_order():
    rng = np.random.default_rng(1)
    a, b, q = rng.normal(size=(5, 4)), rng.normal(size=(7, 4)), rng.normal(size=8)
    cells = ann.cells_for(q, a, b, np.ones(35, int), 35)
    sums = [a[c // 7] @ q[:4] + b[c % 7] @ q[4:] for c in cells]
    assert sorted(cells) == list(range(35)) and (np.diff(sums) <= 1e-12).all()


def test_toxic_texts_are_told_apart(spark):
    rng = random.Random(0)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        text = rng.choices(words, k=rng.randint(5, 60))
        toxic = k % 8 == 0
        if toxic:
            text += rng.choices(["scum!", "Trash", "idiot"], k=3)
        rows.append((k, " ".join(text), "x"))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    rows += [(2000, "", "x"), (2001, None, "x"), (None, "scum trash idiot", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(900))
    held = [k for k in range(900) if got[k].held_out]
    assert sum(got[k].predicted == (k % 8 == 0) for k in held) / len(held) > 0.95
    assert got[2000].score == got[2001].score < 0.5 < got[None].score
    none = toxicity.score(docs, toxicity.train(docs, marks.where("toxic = 2")))
    assert none.where("score <> 0").count() == 0


def test_risk_does_not_go_below_zero():
    w, b = toxicity.fit([toxicity.features(t) for t in ["bad bad"] * 20], [toxicity.features(t) for t in ["bad good", "good"] * 20], 0.3)
    assert np.isfinite(w).all() and np.isfinite(b)


def test_groups_of_queries_and_entries_are_bounded(spark, tmp_path, monkeypatch):
    apply = PandasCogroupedOps.applyInPandas
    folder = str(tmp_path)

    def noted(self, f, schema):
        def g(key, asked, held):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(f"{len(asked)} {len(held)}")
            return f(key, asked, held)

        return apply(self, g, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", noted)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 50, raising=False)
    x = np.random.default_rng(4).normal(size=(600, 8))
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.search(docs, F.col("vec_id") % 2 == 0, k=5, centroids=2, block=60).toPandas()
    sizes = [tuple(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert max(a for a, _ in sizes) <= 100 and max(b for _, b in sizes) <= 120
    assert len(got) == 5 * 300
    for q, rows in got.groupby("query_id"):
        near = x @ x[q]
        near[q] = -np.inf
        assert rows.sort_values("rank").vec_id.tolist() == np.argsort(-near)[:5].tolist()
