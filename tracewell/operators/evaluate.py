"""Figures of rankings against the truth, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid


def run_metrics(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """(method, run_id, anomaly_type, true_root_cause, target_node, rank, top1, top3, top5, reciprocal_rank, false_rc_rate_k5). A truth
    that isn't ranked has no rank and counts 0. ``pipeline_size`` and ``trial`` of the truth, where it has them, come too."""
    own = [c for c in ("pipeline_size", "trial") if c in truth.columns]
    t = truth.select("run_id", "anomaly_type", F.col("node_id").alias("true_root_cause"), *own)
    g = ranking.join(t, "run_id").groupBy("method", "run_id", "anomaly_type", "true_root_cause", *own).agg(
        F.first("target").alias("target_node"), F.min(F.when(F.col("node_id") == F.col("true_root_cause"), F.col("rank"))).alias("rank"),
        F.sum((F.col("rank") <= 5).cast("int")).alias("five"), F.sum(((F.col("rank") <= 5) & (F.col("node_id") != F.col("true_root_cause"))).cast("int")).alias("wrong"),
    )
    hits = [F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int").alias(f"top{k}") for k in (1, 3, 5)]
    return g.select("method", "run_id", "anomaly_type", *own, "true_root_cause", "target_node", "rank", *hits, F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("wrong") / F.nullif("five", F.lit(0)), F.lit(0.0)).alias("false_rc_rate_k5"))


def summary(metrics: DataFrame, *keys: str) -> DataFrame:
    """Means by ``keys``, to four places."""
    means = {"top1_acc": "top1", "top3_acc": "top3", "top5_acc": "top5", "mrr": "reciprocal_rank", "false_rc_rate": "false_rc_rate_k5"}
    return metrics.groupBy(*keys).agg(*(F.bround(F.avg(c), 4).alias(n) for n, c in means.items()), F.count("*").alias("n_runs"))


def grouped_summary(metrics: DataFrame) -> DataFrame:
    """The same for each method, each (method, anomaly_type) and each (method, pipeline_size), in one pass; what a row is
    not grouped by is null, and ``grouping`` tells it: method 3, method and type 1, method and size 2."""
    method, kind, size = F.col("method"), F.col("anomaly_type"), F.col("pipeline_size")
    means = {"top1_acc": "top1", "top3_acc": "top3", "top5_acc": "top5", "mrr": "reciprocal_rank", "false_rc_rate": "false_rc_rate_k5"}
    sets = metrics.groupingSets([[method], [method, kind], [method, size]], method, kind, size)
    return sets.agg(F.grouping_id().cast("int").alias("grouping"), *(F.bround(F.avg(c), 4).alias(n) for n, c in means.items()), F.count("*").alias("n_runs"))


def bootstrap(metrics: DataFrame, *keys: str, replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Means of top1, top5 and reciprocal_rank with bounds from ``replicates`` samples with replacement: draw d of replicate
    b takes the row (by run_id) of number grid.draw(b * 2**20 + d, seed) modulo their count."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys)
    rows = metrics.withColumn("k", F.row_number().over(w.orderBy("run_id")) - 1).withColumn("n", F.count("*").over(w))
    draws = rows.select(*keys, "n", F.col("k").alias("d"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    draws = draws.withColumn("k", F.expr(f"cast({grid.draw('(b * 1048576 + d)', seed)} % n as int)")).drop("n")
    what = ("top1", "top5", "reciprocal_rank")
    each = draws.join(rows.select(*keys, "k", *what), [*keys, "k"]).groupBy(*keys, "b").agg(*(F.avg(c).alias(c) for c in what))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    bounds = each.groupBy(*keys).agg(*(x for c, n in zip(what, ("top1", "top5", "mrr")) for x in (F.bround(F.percentile(c, F.lit(lo)), 4).alias(f"{n}_ci_lo"), F.bround(F.percentile(c, F.lit(hi)), 4).alias(f"{n}_ci_hi"))))
    means = rows.groupBy(*keys).agg(*(F.bround(F.avg(c), 4).alias(f"{n}_mean") for c, n in zip(what, ("top1", "top5", "mrr"))), F.count("*").alias("n_runs"))
    return means.join(bounds, list(keys))


def sensitivity(figures: DataFrame) -> DataFrame:
    """From figures(weight, scale, top5, mrr), scale 1 being the base: the largest changes by weight; above 3 points it is sensitive."""
    base = figures.where("scale = 1.0").groupBy("weight").agg(F.first("top5").alias("b5"), F.first("mrr").alias("bm"))
    g = figures.join(base, "weight").groupBy("weight").agg(F.max(F.abs(F.col("top5") - F.col("b5"))).alias("max_delta_top5"), F.max(F.abs(F.col("mrr") - F.col("bm"))).alias("max_delta_mrr"))
    return g.withColumn("sensitive", F.col("max_delta_top5") > 0.03)
