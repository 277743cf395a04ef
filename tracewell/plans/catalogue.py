"""Every registered query with its SQL, over the runs clean and A1 to A6 of the market views."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import autoencoder, causal, dataflow, detect, evaluate, faults, graphnet, grid, learned, lineage, rank
from ..sources import market, topology
from ..sources.scratch import cleared, kept, new_path
from .oracle import CTES, ablation_sql, assembled, sensitivity_sql, sql

FLAGSHIP = "fused_score"
PLACES = 6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _round(c: str, places: int = PLACES) -> Column:
    """Rounded, and never minus zero."""
    return (F.round(F.col(c), places) + F.lit(0.0)).alias(c)


def _figures(c: str) -> Column:
    """Rounded to PLACES; amounts from 20,000 on to three places, which is as far as sums in another order agree."""
    return F.when(F.abs(c) >= 20000, F.round(F.col(c), 3) + F.lit(0.0)).otherwise(_round(c)).alias(c)


def _figures_sql(c: str) -> str:
    return f"CASE WHEN abs({c}) >= 20000 THEN round({c}, 3) + 0.0 ELSE round({c}, {PLACES}) + 0.0 END AS {c}"


# -- frames that queries share -----------------------------------------------------------------------------------------


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup = faults.registered(spark)
    return faults.inject(market.market(spark, sf_dir).crossJoin(F.broadcast(setup.runs.select("run_id"))), setup.actions)  # a handful of runs


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup = faults.registered(spark)
    return dataflow.instruments(source(spark, sf_dir), setup.runs, setup.overrides)


def series_of(source: DataFrame, setup: faults.Setup) -> DataFrame:
    """Every node's series, written once since each signal reads it again; so are the steps that two parts of it read."""
    source = kept(source, "source")
    single = kept(dataflow.instruments(source, setup.runs, setup.overrides), "instruments")
    return kept(dataflow.node_series(source, single, dataflow.portfolio(single)), "series")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(source(spark, sf_dir), faults.registered(spark))


_prepared: dict[tuple, tuple[DataFrame, DataFrame, DataFrame, int]] = {}


def prepared(spark: SparkSession, *names: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(nodes, edges, closure, edges of the longest way) of the named topologies, which no data change: made once in a session."""
    key = (spark.sparkContext.applicationId, cleared(), *names)
    if key not in _prepared:
        n = topology.nodes(spark, *names)
        e = kept(lineage.edges(n), "edges")
        closure, depth = lineage.closed(e)
        _prepared[key] = n, e, closure, depth
    return _prepared[key]


def graph(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return prepared(spark, "market")[:3]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = topology.nodes(spark, "market")
    return kept(detect.fused(detect.signals(series(spark, sf_dir), n), n), "scores")


def placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    n, e, c, depth = prepared(spark, "market")
    s = scored(spark, sf_dir)
    return kept(rank.placed(s, rank.select_target(s, n, c), n, c), "placed"), n, e, depth


def rankings(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    at, n, e, depth = placed(spark, sf_dir)
    return ranked_by(at, n, e, depth, faults.registered(spark))


def ranked_by(at: DataFrame, n: DataFrame, e: DataFrame, depth: int, setup: faults.Setup) -> Callable[[str], DataFrame]:
    """A method's ranking by name, made when it is asked for first."""
    walk = partial(rank.rank_walk, at, e, depth=depth)
    made: dict[str, DataFrame] = {}
    how = {
        "v1": lambda: walk(rank.V1), "v2": lambda: walk(rank.V2), "v3": lambda: walk(rank.V3), "vanilla": lambda: walk(rank.VANILLA), "structural": lambda: rank.rank_structural(at, e, depth), "hops": lambda: rank.rank_hops(at),
        "score": lambda: rank.rank_scores(at), "schema": lambda: rank.rank_schema(at, faults.dropped_inputs(n, setup.runs, setup.overrides)), "hybrid": lambda: rank.hybrid(get("schema"), get("v2")),
    }

    def get(method: str) -> DataFrame:
        if method not in made:
            made[method] = how[method]()
        return made[method]

    return get


def rank_all(at: DataFrame, n: DataFrame, e: DataFrame, depth: int, setup: faults.Setup) -> DataFrame:
    """Rankings by all methods that rank every run."""
    r, every = ranked_by(at, n, e, depth, setup), None
    for m in ("v1", "v2", "score", "hops", "vanilla", "structural", "hybrid"):
        own = r(m).withColumn("method", F.lit(m))
        every = own if every is None else every.unionByName(own)
    return every


# -- registration --------------------------------------------------------------------------------------------------------


def add(name: str, query: Query, text: str | None = None) -> None:
    QUERIES[name] = query
    if text is not None:
        SQL[name] = text


def _single(column: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruments(spark, sf_dir).select("run_id", "i", "t", _figures(column))


def _daily(column: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.portfolio(instruments(spark, sf_dir)).select("run_id", "t", _figures(column))


for _name, _column in {"ffill_prices": "clean", "clip_warmup": "filtered", "fx_join": "krw", "position_value": "worth", "log_return": "ret", "vol20": "vol20", "vol60": "vol60"}.items():
    add(_name, partial(_single, _column), sql(f"SELECT run_id, i, t::INT AS t, {_figures_sql(_column)} FROM inst"))
for _name, _column in {
    "portfolio_total": "total", "sector_mean_a": "sector_a", "sector_mean_b": "sector_b", "var95": "var95", "var99": "var99", "es95": "es95", "portfolio_vol": "vol", "stress_pnl": "stress",
    "concentration": "concentration", "report_reg_var": "reg_var", "report_dashboard": "dashboard", "report_stress": "stress_flag", "report_limit": "limit_breach",
}.items():
    add(_name, partial(_daily, _column), sql(f"SELECT run_id, t::INT AS t, {_figures_sql(_column)} FROM day"))

add("market_source", lambda spark, d: market.market(spark, d).select("col", "t", _round("value")), sql(f"SELECT col, t::INT AS t, round(value, {PLACES}) + 0.0 AS value FROM market"))
for _k in range(1, 7):
    add(f"inject_a{_k}", lambda spark, d, r=f"A{_k}": series(spark, d).where(F.col("run_id") == r).select("run_id", "node_id", "t", _figures("value")), sql(f"SELECT run_id, node_id, t::INT AS t, {_figures_sql('value')} FROM series WHERE run_id = 'A{_k}'"))


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    """A7 (and A1, A5, A6) on generated markets, places drawn from each run's seed."""
    runs = spark.range(28).select(F.concat(F.lit("run"), "id").alias("run_id"), F.element_at(F.array(*map(F.lit, ("A1", "A5", "A6", "A7"))), (F.col("id") % 4 + 1).cast("int")).alias("anomaly_type"), F.col("id").alias("seed"))
    clean = market.generated(spark, runs.select("seed"), n=252).join(F.broadcast(runs.select("seed", "run_id")), "seed").select("run_id", "col", "t", "value")
    return faults.inject(clean, faults.drawn(spark, runs, 252, 5))


add("inject_drawn", _drawn)
add("generated_market", lambda spark, d: market.generated(spark, spark.range(8).select(F.col("id").alias("seed"))))
add("normalised_prices", lambda spark, d: market.normalised(market.market(spark, d).where("col like 'STOCK%'")).select("col", "t", _round("value")), sql(f"SELECT col, t::INT AS t, round(value / first_value(value IGNORE NULLS) OVER (PARTITION BY col ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100, {PLACES}) + 0.0 AS value FROM market WHERE starts_with(col, 'STOCK')"))

# scores
_SIGNAL = {"score_zvar": ("raw", lambda s, n: detect.raw_score(detect.numbered(s))), "score_shortlong": ("sl", lambda s, n: detect.short_long(detect.numbered(s))), "score_peer": ("peer", lambda s, n: detect.peer_score(detect.numbered(s), n)), "phi_peer": ("phi", lambda s, n: detect.peer_share(detect.numbered(s), n)), "causal_excess": ("excess", lambda s, n: detect.causal_excess(detect.raw_score(detect.numbered(s)), n))}
_FROM = {"raw": "raws", "sl": "sls", "peer": "peers", "phi": "phis", "excess": "excesses"}
for _name, (_column, _f) in _SIGNAL.items():
    add(_name, lambda spark, d, c=_column, f=_f: f(series(spark, d), topology.nodes(spark, "market")).select("run_id", "node_id", _round(c)), sql(f"SELECT run_id, node_id, round({_column}, {PLACES}) + 0.0 AS {_column} FROM {_FROM[_column]}"))
add("fused_score", lambda spark, d: scored(spark, d).select("run_id", "node_id", _round("score")), sql(f"SELECT run_id, node_id, round(score, {PLACES}) + 0.0 AS score FROM score"))
add(
    "scored_nodes", lambda spark, d: lineage.with_scores(topology.nodes(spark, "market"), scored(spark, d)).select("run_id", "node_id", "layer", _round("anomaly_score"), "is_anomalous"),
    sql(f"SELECT r.run_id, n.node_id, n.layer, round(coalesce(s.score, 0.0), {PLACES}) + 0.0 AS anomaly_score, coalesce(s.score, 0.0) > 0.5 AS is_anomalous FROM node n CROSS JOIN runs r LEFT JOIN score s ON s.run_id = r.run_id AND s.node_id = n.node_id"),
)


def _changed(spark: SparkSession, d: str) -> DataFrame:
    n, s = topology.nodes(spark, "market"), series(spark, d)
    return detect.change_point(s, detect.fused(detect.signals(s, n), n)).select("run_id", "node_id", _round("score"))


_CHANGED = "SELECT s.run_id, s.node_id, greatest(score, CASE WHEN n >= 20 AND s1 > 1e-8 THEN 0.7 * least(abs(s2 - s1) / s1 / 5, 1.0) ELSE 0.0 END) AS score FROM score s LEFT JOIN halves h USING (run_id, node_id)"
add("changepoint", _changed, sql(f"SELECT run_id, node_id, round(score, {PLACES}) + 0.0 AS score FROM ({_CHANGED})"))


def _blended_scores(spark: SparkSession, d: str) -> DataFrame:
    n, s = topology.nodes(spark, "market"), series(spark, d)
    a = detect.fused(detect.signals(s, n), n)
    b = detect.short_long(detect.numbered(s)).withColumnRenamed("sl", "score")
    shares = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.5, 0.7, 1.0)], "share double")
    return detect.blend(b, a, shares)


add("blend", lambda spark, d: _blended_scores(spark, d).select("share", "run_id", "node_id", _round("score")), sql(f"SELECT x.share::DOUBLE AS share, run_id, node_id, round(x.share * coalesce(sl, 0.0) + (1 - x.share) * coalesce(score, 0.0), {PLACES}) + 0.0 AS score FROM score FULL JOIN sls USING (run_id, node_id) CROSS JOIN (VALUES (0.0), (0.3), (0.5), (0.7), (1.0)) x(share)"))


def _learned(score: Callable[..., DataFrame], spark: SparkSession, d: str) -> DataFrame:
    """Scores by a model of the clean run."""
    s = series(spark, d)
    return score(s, s.where("run_id = 'clean'"))


def _encoded(spark: SparkSession, d: str, **kind: bool) -> DataFrame:
    s = series(spark, d)
    return autoencoder.autoencoder_scores(s, s.where("run_id = 'clean'"), topology.nodes(spark, "market"), **kind)


_MODELS: dict[str, Query] = {
    "isolation_scores": partial(_learned, learned.isolation_scores), "boundary_scores": partial(_learned, learned.boundary_scores), "autoencoder_scores": _encoded,
    "autoencoder_by_kind": partial(_encoded, by_kind=True, told=False), "autoencoder_hybrid": partial(_encoded, by_kind=True),
}
for _name, _model in _MODELS.items():
    add(_name, lambda spark, d, m=_model: m(spark, d).select("run_id", "node_id", _round("score")))

# rankings
add("select_target", lambda spark, d: (lambda g, s: rank.select_target(s, g[0], g[2]))(graph(spark), scored(spark, d)), sql("SELECT run_id, target FROM target"))
add("report_target", lambda spark, d: rank.target_from_reports(scored(spark, d), topology.nodes(spark, "market")), sql("SELECT run_id, coalesce(max(node_id) FILTER (layer = 5 AND k5 = 1 AND score >= 0.3), max(node_id) FILTER (k = 1)) AS target FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, node_ord) AS k, row_number() OVER (PARTITION BY run_id, layer = 5 ORDER BY score DESC, node_ord) AS k5 FROM score) GROUP BY 1"))
for _m, _t in {"v1": "rank_v1", "v2": "rank_v2", "v3": "rank_v3", "vanilla": "rank_vanilla", "structural": "rank_structural", "hops": "rank_hops", "score": "rank_score", "schema": "rank_schema", "hybrid": "hybrid"}.items():
    _q = {"v1": "rank_rwr_v1", "v2": "rank_rwr_v2", "v3": "rank_rwr_v3", "vanilla": "rank_rwr_vanilla", "structural": "rank_rwr_structural", "hops": "rank_bfs", "score": "rank_score", "schema": "schema_violations", "hybrid": "hybrid_rank"}[_m]
    add(_q, lambda spark, d, m=_m: rankings(spark, d)(m).select("run_id", "target", "node_id", _round("score"), "rank"), sql(f"SELECT run_id, target, node_id, round(score, {PLACES}) + 0.0 AS score, rank::INT AS rank FROM {_t}"))
add("rank_top3", lambda spark, d: rank.top(rankings(spark, d)("v2"), 3).select("run_id", "node_id", "rank"), sql("SELECT run_id, node_id, rank::INT AS rank FROM rank_v2 WHERE rank <= 3"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    at, _, e, depth = placed(spark, d)
    f = rank.graph_features(rank.rank_walk(at, e, rank.V2, depth), at, e)
    return f.select("run_id", "node_id", *(_round(f"f{k}") for k in range(8)))


add(
    "gnn_features", _features,
    sql(f"""SELECT s.run_id, s.node_id, round(coalesce(c.score, 0.0) / b.best, {PLACES}) + 0.0 AS f0, round(p.score, {PLACES}) + 0.0 AS f1, round(p.layer / 5, {PLACES}) AS f2, (coalesce(p.hops, 0) > 0)::INT::DOUBLE AS f3,
 round(coalesce(i.n, 0) / (SELECT max(n) + 1 FROM (SELECT count(*) AS n FROM edge GROUP BY v)), {PLACES}) AS f4, round(coalesce(o.n, 0) / (SELECT max(n) + 1 FROM (SELECT count(*) AS n FROM edge GROUP BY u)), {PLACES}) AS f5,
 (c.node_id IS NOT NULL)::INT::DOUBLE AS f6, round(coalesce(p.hops, p.max_hops + 1) / (p.max_hops + 1), {PLACES}) + 0.0 AS f7
 FROM (SELECT run_id, node_id FROM rank_v2 WHERE rank <= 10 UNION SELECT run_id, e.v FROM rank_v2 JOIN edge e ON e.u = node_id WHERE rank <= 10 UNION SELECT run_id, e.u FROM rank_v2 JOIN edge e ON e.v = node_id WHERE rank <= 10) s
 JOIN placed p ON p.run_id = s.run_id AND p.node_id = s.node_id LEFT JOIN (SELECT * FROM rank_v2 WHERE rank <= 10) c ON c.run_id = s.run_id AND c.node_id = s.node_id
 JOIN (SELECT run_id, max(score) AS best FROM rank_v2 WHERE rank <= 10 GROUP BY 1) b ON b.run_id = s.run_id LEFT JOIN (SELECT v, count(*) AS n FROM edge GROUP BY 1) i ON i.v = s.node_id LEFT JOIN (SELECT u, count(*) AS n FROM edge GROUP BY 1) o ON o.u = s.node_id"""),
)


def _graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(v2 ranking, features, links) of every run's candidates and their neighbours."""
    at, _, e, depth = placed(spark, d)
    v2 = kept(rank.rank_walk(at, e, rank.V2, depth), "v2")
    features = kept(rank.graph_features(v2, at, e), "features")
    return v2, features, kept(graphnet.links(features, e), "links")


_SUB = "SELECT run_id, node_id FROM rank_v2 WHERE rank <= 10 UNION SELECT run_id, e.v FROM rank_v2 JOIN edge e ON e.u = node_id WHERE rank <= 10 UNION SELECT run_id, e.u FROM rank_v2 JOIN edge e ON e.v = node_id WHERE rank <= 10"
_PASSED = "CASE e.edge_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in lineage.TRANSFER.items()) + " ELSE 1.0::DOUBLE END"
_LINKED = f"SELECT b.run_id, b.node_id, a.node_id AS other, {_PASSED} AS weight FROM edge e JOIN sub b ON b.node_id = e.v JOIN sub a ON a.node_id = e.u AND a.run_id = b.run_id UNION ALL SELECT run_id, node_id, node_id, 1.0::DOUBLE FROM sub"
add(
    "gnn_adjacency", lambda spark, d: graphnet.adjacency(_graphs(spark, d)[2]).select("run_id", "node_id", "other", _round("weight")),
    sql(f"SELECT l.run_id, l.node_id, l.other, round(l.weight / sqrt(greatest(x.d, 1.0) * greatest(y.d, 1.0)), {PLACES}) + 0.0 AS weight FROM linked l JOIN degree x ON x.run_id = l.run_id AND x.node_id = l.node_id JOIN degree y ON y.run_id = l.run_id AND y.node_id = l.other", ("sub", _SUB), ("linked", _LINKED), ("degree", "SELECT run_id, node_id, sum(weight) AS d FROM linked GROUP BY 1, 2")),
)


def _by_network(relational: bool, spark: SparkSession, d: str) -> DataFrame:
    """The v2 ranking by a graph network; each run is ranked by a net that was trained on the others."""
    v2, features, link = _graphs(spark, d)
    truth = faults.registered(spark).truth.withColumn("fold", F.substring("run_id", 2, 1).cast("int"))
    found = graphnet.network_scores(graphnet.samples(features, link), truth, relational)
    return rank.rerank(v2, found, topology.nodes(spark, "market"))


for _name, _relational in {"rank_gnn": False, "rank_gnn_relational": True}.items():
    add(_name, lambda spark, d, r=_relational: _by_network(r, spark, d).select("run_id", "target", "node_id", _round("score"), "rank"))


def _causal(spark: SparkSession, d: str) -> DataFrame:
    """The series, and the scores from them, are written once."""
    n, e, c = graph(spark)
    s = series(spark, d)
    scores = kept(detect.fused(detect.signals(s, n), n), "scores")
    at = kept(rank.placed(scores, rank.select_target(scores, n, c), n, c), "placed")
    return causal.rank_causal(s, at, n, e)


add("rank_causal", lambda spark, d: _causal(spark, d).select("run_id", "target", "node_id", _round("score"), "rank"))


def _folded(spark: SparkSession, d: str) -> DataFrame:
    e = market.table(spark, d, "events").select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("anomaly_type"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("size"), F.col("event_id").alias("trial"))
    return rank.folds(e).select("run_id", "anomaly_type", "size", "fold")


add("cv_folds", _folded, "SELECT event_id::VARCHAR AS run_id, event_type AS anomaly_type, 's' || (user_id % 3) AS size, ((row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) - 1) % 5)::INT AS fold FROM events")


# evaluation
def metrics(spark: SparkSession, d: str) -> DataFrame:
    setup = faults.registered(spark)
    return evaluate.run_metrics(rank_all(*placed(spark, d), setup), setup.truth)


add("run_metrics", lambda spark, d: metrics(spark, d).select("method", "run_id", "anomaly_type", "true_root_cause", "target_node", "rank", "top1", "top3", "top5", _round("reciprocal_rank"), _round("false_rc_rate_k5")), sql(f"SELECT method, run_id, anomaly_type, true_root_cause, target_node, rank, top1, top3, top5, round(reciprocal_rank, {PLACES}) AS reciprocal_rank, round(false_rc_rate_k5, {PLACES}) AS false_rc_rate_k5 FROM metric"))
for _keys in (("method",), ("method", "anomaly_type")):
    add("summary_by_" + "_".join(_keys), lambda spark, d, k=_keys: evaluate.summary(metrics(spark, d), *k), sql(f"SELECT {', '.join(_keys)}, " + ", ".join(f"round_even(avg({c}), 4) AS {n}" for n, c in {"top1_acc": "top1", "top3_acc": "top3", "top5_acc": "top5", "mrr": "reciprocal_rank", "false_rc_rate": "false_rc_rate_k5"}.items()) + f", count(*) AS n_runs FROM metric GROUP BY {', '.join(_keys)}"))
_CI = (("top1", "top1"), ("top5", "top5"), ("reciprocal_rank", "mrr"))
_DRAWN = {
    "numbered": "SELECT *, row_number() OVER (PARTITION BY method ORDER BY run_id) - 1 AS k, count(*) OVER (PARTITION BY method) AS n FROM metric",
    "taken": f"SELECT r.method, b, {grid.draw('(b * 1048576 + r.k)', 42)} % r.n AS k FROM numbered r CROSS JOIN (SELECT range AS b FROM range(1, 1001))",
    "replicate": "SELECT t.method, t.b, avg(top1) AS top1, avg(top5) AS top5, avg(reciprocal_rank) AS reciprocal_rank FROM taken t JOIN numbered r ON r.method = t.method AND r.k = t.k GROUP BY 1, 2",
    "bounds": "SELECT method, " + ", ".join(f"round_even(quantile_cont({c}, 0.025), 4) AS {n}_ci_lo, round_even(quantile_cont({c}, 0.975), 4) AS {n}_ci_hi" for c, n in _CI) + " FROM replicate GROUP BY 1",
    "means": "SELECT method, " + ", ".join(f"round_even(avg({c}), 4) AS {n}_mean" for c, n in _CI) + ", count(*) AS n_runs FROM metric GROUP BY 1",
}
add("bootstrap_ci", lambda spark, d: evaluate.bootstrap(metrics(spark, d), "method"), assembled(CTES | _DRAWN, "SELECT * FROM means JOIN bounds USING (method)"))


def _ablated(spark: SparkSession, d: str) -> DataFrame:
    at, _, e, depth = placed(spark, d)
    return ablated(at, e, depth, faults.registered(spark).truth)


def ablated(at: DataFrame, e: DataFrame, depth: int, truth: DataFrame) -> DataFrame:
    """Figures of the walks with one part left out each."""
    every = None
    for w in rank.ABLATIONS:
        own = rank.rank_walk(at, e, w, depth)
        every = own if every is None else every.unionByName(own)
    return evaluate.summary(evaluate.run_metrics(every, truth), "method")


add("ablation", _ablated, ablation_sql())


#: Weights of the fusion in the order raw early, sl early, raw, excess, sl, peer, raw late, excess late.
WEIGHTS = (1.0, 0.5, 0.55, 0.85, 0.80, 0.90, 0.40, 0.60)
SCALES = (0.7, 0.85, 1.0, 1.15, 1.3)


def swept(signals: DataFrame, nodes: DataFrame, truth: DataFrame) -> DataFrame:
    """How top-5 accuracy and reciprocal rank of the score ranking move as one weight of the fusion is scaled."""
    spark, base = signals.sparkSession, WEIGHTS
    rows = [(f"{k + 1}|{s}", *(min(1.0, max(0.01, w * s)) if j == k else w for j, w in enumerate(base))) for k in range(8) for s in SCALES]
    weights = spark.createDataFrame(rows, "setting string, " + ", ".join(f"w{k} double" for k in range(1, 9)))
    s = detect.weighted(signals, nodes, weights).select(F.concat_ws("#", "setting", "run_id").alias("run_id"), "node_id", "node_ord", "score", F.lit("").alias("target"))
    t = truth.select("run_id", "anomaly_type", "node_id").crossJoin(F.broadcast(weights.select("setting"))).withColumn("run_id", F.concat_ws("#", "setting", "run_id"))
    m = evaluate.run_metrics(rank.ranked(s, "score"), t).withColumn("setting", F.substring_index("run_id", "#", 1))
    g = m.groupBy("setting").agg(F.avg("top5").alias("top5"), F.avg("reciprocal_rank").alias("mrr"))
    g = g.select(F.concat(F.lit("W"), F.substring_index("setting", "|", 1)).alias("weight"), F.substring_index("setting", "|", -1).cast("double").alias("scale"), "top5", "mrr")
    return evaluate.sensitivity(g).select("weight", _round("max_delta_top5"), _round("max_delta_mrr"), "sensitive")


def _swept(spark: SparkSession, d: str) -> DataFrame:
    n = topology.nodes(spark, "market")
    return swept(detect.signals(series(spark, d), n), n, faults.registered(spark).truth)


add("sensitivity", _swept, sensitivity_sql(WEIGHTS, SCALES, PLACES))


def _backward(spark: SparkSession, d: str) -> DataFrame:
    at, _, e, depth = placed(spark, d)
    return rank.rank_structural(at, e, depth, backward=True, method="backward")


_TURNED = {k.replace("st_", "tb_"): v.replace("st_", "tb_") for k, v in CTES.items() if k.startswith("st_")} | {"tb_p": "SELECT v AS frm, u AS dest, 1.0 / count(*) OVER (PARTITION BY v) AS p FROM edge", "rank_backward": CTES["rank_structural"].replace("st_r", "tb_r")}
add("rank_rwr_backward", lambda spark, d: _backward(spark, d).select("run_id", "target", "node_id", _round("score"), "rank"), assembled(CTES | _TURNED, f"SELECT run_id, target, node_id, round(score, {PLACES}) + 0.0 AS score, rank::INT AS rank FROM rank_backward"))


# tables in and out, and figures with simple inputs
def _percent_rates(spark: SparkSession, d: str) -> DataFrame:
    """The market's rates and the same in percent, as fractions."""
    rates = market.market(spark, d).where("col like 'RATE%'")
    return market.as_fractions(rates.union(rates.select(F.concat("col", F.lit("_PERCENT")), "t", F.col("value") * 100)))


add("rate_fractions", lambda spark, d: _percent_rates(spark, d).select("col", "t", _round("value")), sql(f"SELECT col, t::INT AS t, round(value, {PLACES}) + 0.0 AS value FROM (SELECT col, t, CASE WHEN quantile_cont(value, 0.5) OVER (PARTITION BY col) > 0.5 THEN value / 100 ELSE value END AS value FROM (SELECT col, t, value FROM market WHERE starts_with(col, 'RATE') UNION ALL SELECT col || '_PERCENT', t, value * 100 FROM market WHERE starts_with(col, 'RATE')))"))


def _last_year(spark: SparkSession, d: str) -> DataFrame:
    return market.last_days(market.market(spark, d), 252)


add("last_days", lambda spark, d: _last_year(spark, d).select("col", "t", _round("value")), sql(f"SELECT col, t::INT AS t, round(value, {PLACES}) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY t DESC) AS k FROM market) WHERE k <= 252"))

def _blend_table(spark: SparkSession, d: str) -> DataFrame:
    """For each share of a blend, the v2 ranking's figures in percent and its first places by kind of fault: written as CSV
    and read again under its schema."""
    n, e, c, depth = prepared(spark, "market")
    s = kept(_blended_scores(spark, d).select(F.concat_ws("#", "share", "run_id").alias("run_id"), "node_id", "score"), "blended")
    at = kept(rank.placed(s, rank.select_target(s, n, c), n, c), "placed")
    shares = s.select(F.split_part("run_id", F.lit("#"), F.lit(1)).alias("share")).distinct()
    truth = faults.registered(spark).truth.crossJoin(F.broadcast(shares)).withColumn("run_id", F.concat_ws("#", "share", "run_id")).drop("share")  # five shares
    m = evaluate.run_metrics(rank.rank_walk(at, e, rank.V2, depth), truth).withColumn("alpha", F.split_part("run_id", F.lit("#"), F.lit(1)).cast("double"))
    percent = lambda c: F.bround(100 * F.avg(c), 1)
    kinds = [F.bround(100 * F.avg(F.when(F.col("anomaly_type") == k, F.col("top1"))), 1).alias(k) for k in FAULTS]
    table = m.groupBy("alpha").agg(percent("top1").alias("top1"), percent("top3").alias("top3"), percent("top5").alias("top5"), percent("reciprocal_rank").alias("mrr"), F.count("*").alias("n"), *kinds)
    path = new_path(spark, "blend-csv")
    market.write_csv(table, path)
    return market.read_csv(spark, path, "alpha double, top1 double, top3 double, top5 double, mrr double, n bigint, " + ", ".join(f"{k} double" for k in FAULTS))


FAULTS = ("A1", "A2", "A3", "A4", "A5", "A6")
_MIXED = "SELECT share || '#' || run_id AS run_id, node_id, n.node_ord, n.layer, score FROM (SELECT x.share, run_id, node_id, x.share * coalesce(sl, 0.0) + (1 - x.share) * coalesce(score, 0.0) AS score FROM fused FULL JOIN sls USING (run_id, node_id) CROSS JOIN (VALUES ('0.0', 0.0::DOUBLE), ('0.3', 0.3::DOUBLE), ('0.5', 0.5::DOUBLE), ('0.7', 0.7::DOUBLE), ('1.0', 1.0::DOUBLE)) y(name, share)) b JOIN node n USING (node_id)"
_BLEND = {}
for _k, _v in CTES.items():
    if _k == "score":
        _BLEND |= {"fused": _v, "score": _MIXED.replace("x.share", "y.share").replace("SELECT share || '#'", "SELECT name || '#'").replace("(SELECT y.share, run_id", "(SELECT y.name, run_id")}
    elif _k == "truth":
        _BLEND |= {"truth0": _v, "truth": "SELECT DISTINCT s.run_id, t.run_id AS kind, t.truth FROM truth0 t JOIN score s ON split_part(s.run_id, '#', 2) = t.run_id"}
    elif _k == "every":
        _BLEND[_k] = "SELECT 'v2' AS method, run_id, target, node_id, score, rank FROM rank_v2"
    else:
        _BLEND[_k] = _v
add(
    "blend_csv", _blend_table,
    assembled(_BLEND, "SELECT split_part(run_id, '#', 1)::DOUBLE AS alpha, " + ", ".join(f"round_even(100 * avg({c}), 1) AS {n}" for c, n in (("top1", "top1"), ("top3", "top3"), ("top5", "top5"), ("reciprocal_rank", "mrr"))) + ", count(*) AS n, " + ", ".join(f"round_even(100 * avg(top1) FILTER (split_part(run_id, '#', 2) = '{k}'), 1) AS \"{k}\"" for k in FAULTS) + " FROM metric GROUP BY 1"),
)

METRIC_SCHEMA = "method string, run_id string, anomaly_type string, true_root_cause string, target_node string, rank int, top1 int, top3 int, top5 int, reciprocal_rank double, false_rc_rate_k5 double"


def _through_csv(spark: SparkSession, d: str) -> DataFrame:
    """Figures of all runs, written as CSV and read again under their schema."""
    path = new_path(spark, "metrics-csv")
    market.write_csv(metrics(spark, d).select(*(c.split()[0] for c in METRIC_SCHEMA.split(", "))), path)
    return market.read_csv(spark, path, METRIC_SCHEMA)


add("metrics_csv", lambda spark, d: _through_csv(spark, d).select("method", "run_id", "rank", "top5", _round("reciprocal_rank")), sql(f"SELECT method, run_id, rank, top5, round(reciprocal_rank, {PLACES}) AS reciprocal_rank FROM metric"))


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    """The v2 ranking by the raw signal in place of a learned score, 0 beyond each run's best ten."""
    at, _, e, depth = placed(spark, d)
    v2 = rank.rank_walk(at, e, rank.V2, depth)
    learned = rank.top(v2, 10).select("run_id", "node_id").join(at.select("run_id", "node_id", "score"), ["run_id", "node_id"])
    return rank.rerank(v2, learned, topology.nodes(spark, "market"))


add("rerank", lambda spark, d: _reranked(spark, d).select("run_id", "node_id", _round("score"), "rank"), sql(f"SELECT run_id, node_id, round(score, {PLACES}) + 0.0 AS score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, old)::INT AS rank FROM (SELECT v.run_id, v.node_id, v.rank AS old, CASE WHEN v.rank <= 10 THEN p.score ELSE 0.0 END AS score FROM rank_v2 v JOIN placed p ON p.run_id = v.run_id AND p.node_id = v.node_id)"))
