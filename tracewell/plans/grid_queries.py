"""Registered queries over grids of runs, with their SQL: all kinds of faults on all sizes, drawn places, one job for each."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataflow, detect, evaluate, faults, grid, lineage, rank
from ..sources import market, topology
from ..sources.scratch import kept
from .catalogue import PLACES, SCALES, WEIGHTS, _figures, _figures_sql, _round, ablated, add, prepared, rank_all, ranked_by, series_of, swept
from .oracle import ablation_sql, assembled, grid_texts, sensitivity_sql

SIZES = ("small", "medium", "large")
#: Trials of the registered grid. The full one has grid.TRIALS.
TRIALS = 3
#: The grid over tickers: three years a run.
REAL, REAL_DAYS = ("real",), 756
#: Magnitudes whose A3 widths go from 2 to 20 days.
WIDTHS = (1.0, 1.25, 1.6, 2.0, 2.5, 4.0, 6.0, 8.0)


def laid_out(spark: SparkSession, sf_dir: str, sizes: tuple[str, ...] = SIZES, trials: int = TRIALS, **how) -> tuple[DataFrame, faults.Setup, DataFrame]:
    """(grid, runs and faults, source with the faults that act on sources). The size ``real`` has the tickers' instruments."""
    cut, tickers = {n: topology.SIZES[n] for n in sizes}, None
    if sizes == REAL:
        tickers = market.ticker_map(spark, sf_dir, cut["real"][0])
        cut["real"] = (tickers.count(), *cut["real"][1:])  # positions and prices are as many as tickers
    series, n_days = market.markets(spark, sf_dir, cut, tickers)
    runs = kept(grid.runs(spark, n_days, sizes, trials, **how), "grid")
    setup = faults.Setup(runs, grid.actions(runs), grid.overrides(runs), grid.truth(runs))
    return runs, setup, faults.inject(grid.stretches(series, runs, how.get("days", grid.DAYS)), setup.actions)


def scored(spark: SparkSession, sf_dir: str, sizes: tuple[str, ...] = SIZES, trials: int = TRIALS, **how) -> tuple[DataFrame, DataFrame, faults.Setup]:
    """(scores with topology, series, runs and faults)."""
    runs, setup, source = laid_out(spark, sf_dir, sizes, trials, **how)
    s = series_of(source, setup)
    own = kept(lineage.by_run(topology.nodes(spark, *sizes), runs), "grid-nodes")
    return kept(detect.fused(detect.signals(s, own), own), "scores"), s, setup


def placed(spark: SparkSession, scores: DataFrame, sizes: tuple[str, ...] = SIZES) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(every node with its run's target, nodes, edges, depth)."""
    n, e, closure, depth = prepared(spark, *sizes)
    return kept(rank.placed(scores, rank.select_target(scores, n, closure), n, closure), "placed"), n, e, depth


def metrics(spark: SparkSession, sf_dir: str, sizes: tuple[str, ...] = SIZES, trials: int = TRIALS, **how) -> DataFrame:
    scores, _, setup = scored(spark, sf_dir, sizes, trials, **how)
    at, n, e, depth = placed(spark, scores, sizes)
    every = rank_all(at, n, e, depth, setup)
    return kept(evaluate.run_metrics(every, setup.truth), "grid-metrics")


def figures(at: DataFrame, n: DataFrame, e: DataFrame, depth: int, setup: faults.Setup, methods: tuple[str, ...]) -> DataFrame:
    """Figures of some methods; runs that a method doesn't rank are missing."""
    r, every = ranked_by(at, n, e, depth, setup), None
    for m in methods:
        own = r(m).withColumn("method", F.lit(m))
        every = own if every is None else every.unionByName(own)
    return evaluate.run_metrics(every, setup.truth)


def _sql(select: str, sizes: tuple[str, ...] = SIZES, trials: int = TRIALS, **how) -> str:
    return assembled(grid_texts(sizes, grid.runs_sql(sizes, trials, **how), how.get("days", grid.DAYS), sizes == REAL), select)


_RUN = ("anomaly_type", "topology", "trial", "n_stocks", "m", "shift", "stock", "half", "second_sector", "t_from", "other", "second", "third", "t_to", "width", "member")
add("grid_runs", lambda spark, d: laid_out(spark, d)[0].select("run_id", *_RUN), _sql(f"SELECT run_id, {', '.join(_RUN)} FROM runs"))


def _changed(kinds: tuple[str, ...], how: dict, spark: SparkSession, d: str) -> DataFrame:
    """The series of each run's faulty node."""
    _, setup, source = laid_out(spark, d, kinds=kinds, **how)
    single = kept(dataflow.instruments(source, setup.runs, setup.overrides), "instruments")
    every = dataflow.node_series(source, single, dataflow.portfolio(single))
    return every.join(setup.truth.select("run_id", "node_id"), ["run_id", "node_id"], "left_semi").select("run_id", "node_id", "t", _figures("value"))


_CHANGED = {
    "grid_sources": (("A1", "A5", "A6", "A7"), {"trials": 2}), "grid_conversions": (("A2",), {"trials": 6, "drawn_stretch": True}),
    "grid_windows": (("A3",), {"trials": 8, "magnitudes": WIDTHS}), "grid_sectors": (("A4",), {"trials": 8}),
}
for _name, (_kinds, _how) in _CHANGED.items():
    add(_name, partial(_changed, _kinds, _how), _sql(f"SELECT s.run_id, s.node_id, t::INT AS t, {_figures_sql('value')} FROM series s JOIN truth r ON r.run_id = s.run_id AND r.truth = s.node_id", kinds=_kinds, **_how))

add("grid_scores", lambda spark, d: scored(spark, d)[0].select("run_id", "topology", "node_id", _round("score")), _sql(f"SELECT run_id, split_part(run_id, '/', 1) AS topology, node_id, round(score, {PLACES}) + 0.0 AS score FROM score"))
add("grid_targets", lambda spark, d: placed(spark, scored(spark, d)[0])[0].select("run_id", "target").distinct(), _sql("SELECT DISTINCT run_id, target FROM placed"))
_METRIC = ("method", "run_id", "anomaly_type", "pipeline_size", "trial", "true_root_cause", "target_node", "rank", "top1", "top3", "top5")
add("grid_metrics", lambda spark, d: metrics(spark, d).select(*_METRIC, _round("reciprocal_rank"), _round("false_rc_rate_k5")), _sql(f"SELECT {', '.join(_METRIC)}, round(reciprocal_rank, {PLACES}) AS reciprocal_rank, round(false_rc_rate_k5, {PLACES}) AS false_rc_rate_k5 FROM metric"))

_MEANS = ", ".join(f"round_even(avg({c}), 4) AS {n}" for n, c in {"top1_acc": "top1", "top3_acc": "top3", "top5_acc": "top5", "mrr": "reciprocal_rank", "false_rc_rate": "false_rc_rate_k5"}.items())
add(
    "summary_groupings", lambda spark, d: evaluate.grouped_summary(metrics(spark, d)),
    _sql(f"SELECT method, anomaly_type, pipeline_size, grouping(method, anomaly_type, pipeline_size)::INT AS grouping, {_MEANS}, count(*) AS n_runs FROM metric GROUP BY GROUPING SETS ((method), (method, anomaly_type), (method, pipeline_size))"),
)
add(
    "summary_by_method_size", lambda spark, d: evaluate.summary(metrics(spark, d), "method", "pipeline_size").where(F.col("pipeline_size").contains("l")),
    _sql(f"SELECT method, pipeline_size, {_MEANS}, count(*) AS n_runs FROM metric WHERE contains(pipeline_size, 'l') GROUP BY 1, 2"),
)


# -- single figures over parts of the grid ------------------------------------------------------------------------------

#: Sizes and trials of the sweep, the ablation, and of walks on larger graphs (199 and 514 nodes).
SWEPT, ABLATED, LARGER = (("small", "medium"), 5), (("medium",), 3), (("s20", "s55"), 3)


def _swept(spark: SparkSession, d: str) -> DataFrame:
    (sizes, trials) = SWEPT
    runs, setup, source = laid_out(spark, d, sizes, trials)
    own = kept(lineage.by_run(topology.nodes(spark, *sizes), runs), "grid-nodes")
    return swept(detect.signals(series_of(source, setup), own), own, setup.truth)


def _ablated(spark: SparkSession, d: str) -> DataFrame:
    scores, _, setup = scored(spark, d, *ABLATED)
    at, _, e, depth = placed(spark, scores, ABLATED[0])
    return ablated(at, e, depth, setup.truth)


def _larger(spark: SparkSession, d: str) -> DataFrame:
    scores, _, setup = scored(spark, d, *LARGER, kinds=("A1",))
    return figures(*placed(spark, scores, LARGER[0]), setup, ("v2",))


def _base(sizes: tuple[str, ...], trials: int, **how) -> dict[str, str]:
    return grid_texts(sizes, grid.runs_sql(sizes, trials, **how))


add("grid_sensitivity", _swept, sensitivity_sql(WEIGHTS, SCALES, PLACES, _base(*SWEPT)))
add("grid_ablation", _ablated, ablation_sql(_base(*ABLATED)))
_V2 = {"every": "SELECT 'v2' AS method, run_id, target, node_id, score, rank FROM rank_v2"}
add("grid_larger", lambda spark, d: _larger(spark, d).select(*_METRIC, _round("reciprocal_rank")), assembled(_base(*LARGER, kinds=("A1",)) | _V2, f"SELECT {', '.join(_METRIC)}, round(reciprocal_rank, {PLACES}) AS reciprocal_rank FROM metric"))

# -- runs over tickers: three years of twelve instruments -----------------------------------------------------------------

_REAL_METHODS = ("v2", "v3", "score", "schema", "hybrid")


def _real(spark: SparkSession, d: str) -> DataFrame:
    scores, _, setup = scored(spark, d, REAL, 1, days=REAL_DAYS)
    return figures(*placed(spark, scores, REAL), setup, _REAL_METHODS)


add("ticker_map", lambda spark, d: market.ticker_map(spark, d), "SELECT n_nationkey AS nation, n_name AS ticker, i::INT AS i, 'STOCK_' || i || '_PRICE' AS price_col, 'POSITION_' || i || '_SIZE' AS position_col FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) WHERE i <= 12")
_EVERY = " UNION ALL ".join(f"SELECT '{m}' AS method, run_id, target, node_id, score, rank FROM {r}" for m, r in {"v2": "rank_v2", "v3": "rank_v3", "score": "rank_score", "schema": "rank_schema", "hybrid": "hybrid"}.items())
_REAL_TEXTS = grid_texts(REAL, grid.runs_sql(REAL, 1, days=REAL_DAYS), REAL_DAYS, True) | {"every": _EVERY}
add("real_metrics", lambda spark, d: _real(spark, d).select(*_METRIC, _round("reciprocal_rank"), _round("false_rc_rate_k5")), assembled(_REAL_TEXTS, f"SELECT {', '.join(_METRIC)}, round(reciprocal_rank, {PLACES}) AS reciprocal_rank, round(false_rc_rate_k5, {PLACES}) AS false_rc_rate_k5 FROM metric"))
