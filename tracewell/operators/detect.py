"""Anomaly scores in [0, 1] of every node's series, for all runs at once.

``series`` is node_series(run_id, node_id, t, value); missing values are null. ``nodes`` are those of one topology that
all runs share, or with a ``run_id`` each run's own (lineage.by_run). Signals: rolling z and segment variance
(raw), short against long variance, distance from peers, share of days apart from peers, and what a node's inputs
leave unexplained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.series import rolling, unit
from ..sources.scratch import kept
from .lineage import TRANSFER, by_kind

NODE = ("run_id", "node_id")


def _own(nodes: DataFrame) -> list[str]:
    """What names a node in ``nodes``."""
    return list(NODE) if "run_id" in nodes.columns else ["node_id"]


def _meta(nodes: DataFrame, *cols) -> DataFrame:
    """Columns of nodes; those of one topology are few, so they are broadcast."""
    out = nodes.select(*_own(nodes), *cols)
    return out if "run_id" in nodes.columns else F.broadcast(out)


def _most_upstream(nodes: DataFrame, values: DataFrame, value: str, out: str) -> DataFrame:
    """(run_id, node_id, out): the largest ``value`` among each node's inputs."""
    own = [c for c in _own(nodes) if c != "node_id"]
    up = nodes.select(*own, "node_id", F.explode("upstream").alias("u"))
    return up.join(values.select("run_id", F.col("node_id").alias("u"), F.col(value).alias("_v")), [*own, "u"]).groupBy(*NODE).agg(F.max("_v").alias(out))


def _by_day() -> WindowSpec:
    return Window.partitionBy(*NODE).orderBy("t")


def numbered(series: DataFrame) -> DataFrame:
    """Non-null rows with their number ``k`` from 0, their count ``n``, and the series' length ``days``."""
    w = Window.partitionBy(*NODE)
    s = series.withColumn("days", F.count("*").over(w)).where("value is not null")
    return s.withColumn("k", F.row_number().over(_by_day()) - 1).withColumn("n", F.count("*").over(w))


def stable(rows: DataFrame, slack: int) -> DataFrame:
    """Rows after the first min(60, n / 4), where more than ``slack`` rows are left; else all. ``j`` numbers them, ``m`` counts them."""
    warm = F.least(F.lit(60), F.floor(F.col("n") / 4))
    skip = F.when(F.col("n") > warm + slack, warm).otherwise(0)
    return rows.withColumn("_skip", skip).where(F.col("k") >= F.col("_skip")).withColumn("j", F.col("k") - F.col("_skip")).withColumn("m", F.col("n") - F.col("_skip")).drop("_skip")


def raw_score(rows: DataFrame, threshold: float = 2.0, width: int = 60) -> DataFrame:
    """(run_id, node_id, raw) from ``numbered``: 0.6 x share of days beyond the threshold + 0.4 x largest z / (3 x threshold), or
    0.8 x the jump of variance between quarters, whichever is more. Too short series score 0."""
    s = stable(rows, 20)
    sd = F.greatest(rolling(F.col("value"), _by_day(), width, 5, F.stddev_samp), F.lit(1e-8))
    mean = rolling(F.col("value"), _by_day(), width, 5, F.avg)
    s = s.withColumn("z", F.when(mean.isNotNull(), F.abs((F.col("value") - mean) / sd))).withColumn("q", F.greatest(F.floor(F.col("m") / 4), F.lit(5))).withColumn("seg", F.floor(F.col("j") / F.col("q")))
    part = s.groupBy(*NODE, "seg").agg(F.sum(F.coalesce((F.col("z") > threshold).cast("int"), F.lit(0))).alias("over"), F.max("z").alias("z"), F.count("*").alias("c"), F.stddev_samp("value").alias("sd"), F.first("days").alias("days"), F.first("n").alias("n"))
    use = F.when((F.col("seg") < 4) & (F.col("sd") > 1e-8), F.col("sd"))
    g = part.groupBy(*NODE).agg((F.sum("over") / F.sum("c")).alias("share"), F.max("z").alias("z"), F.max(use).alias("hi"), F.min(use).alias("lo"), F.count(use).alias("segs"), F.first("days").alias("days"), F.first("n").alias("n"))
    z = 0.6 * F.col("share") + 0.4 * F.least(F.coalesce("z", F.lit(0.0)) / (threshold * 3), F.lit(1.0))
    jump = F.when(F.col("segs") >= 2, F.least((F.col("hi") / (F.col("lo") + 1e-8) - 1) / 10.0, F.lit(1.0))).otherwise(0.0)
    return g.select(*NODE, F.when((F.col("days") < 10) | (F.col("n") < 5), 0.0).otherwise(unit(F.greatest(z, 0.8 * jump))).alias("raw"))


def short_long(rows: DataFrame) -> DataFrame:
    """(run_id, node_id, sl): 5-day against 30-day deviation."""
    s = rows.withColumn("ratio", rolling(F.col("value"), _by_day(), 5, 3, F.stddev_samp)).withColumn("long", rolling(F.col("value"), _by_day(), 30, 10, F.stddev_samp))
    ratio = F.when(F.col("long") > 1e-8, F.col("ratio") / F.when(F.col("long") > 1e-8, F.col("long")))
    g = s.groupBy(*NODE).agg(F.count(ratio).alias("c"), F.percentile(ratio, F.lit(0.5)).alias("mid"), F.percentile(ratio, F.lit(0.95)).alias("top"), F.first("n").alias("n"))
    score = 0.9 * F.greatest(F.least((F.col("mid") - 1) / 4, F.lit(1.0)), F.least((F.col("top") - 1) / 6, F.lit(1.0)))
    return g.select(*NODE, F.when((F.col("n") < 40) | (F.col("c") < 10), 0.0).otherwise(unit(score)).alias("sl"))


def level_and_spread(rows: DataFrame) -> DataFrame:
    """(run_id, node_id, n, m, mean, cv) of the stable rows."""
    g = stable(rows, 10).groupBy(*NODE).agg(F.first("n").alias("n"), F.count("*").alias("m"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return g.select(*NODE, "n", "m", "mean", (F.coalesce("sd", F.lit(float("nan"))) / (F.abs("mean") + 1e-8)).alias("cv"))


def peer_score(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, node_id, peer): how far level and relative spread are from the peers'. Figures of a node are a row each,
    so peers meet by an equi-join on their key."""
    own = level_and_spread(rows).join(_meta(nodes, "peer_key"), _own(nodes))
    other = own.where("m > 5").select("run_id", "peer_key", F.col("node_id").alias("peer_id"), F.col("mean").alias("pm"), F.col("cv").alias("pc"))
    met = own.join(other, ["run_id", "peer_key"]).where("node_id <> peer_id")
    g = met.groupBy(*NODE).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("cv").alias("cv"), F.count("*").alias("peers"), F.avg("pm").alias("pm"), F.avg("pc").alias("pc"), (F.stddev_pop("pm") + 1e-10).alias("sm"), (F.stddev_pop("pc") + 1e-10).alias("sc"))
    one = F.least(2 * F.greatest(F.abs(F.col("mean") - F.col("pm")) / (F.abs("pm") + 1e-8), F.abs(F.col("cv") - F.col("pc")) / (F.col("pc") + 1e-8)), F.lit(1.0))
    drop = F.greatest(F.lit(0.0), (F.col("pm") - F.col("mean")) / (F.col("sm") + 1e-10))
    more = F.least(F.greatest(F.abs(F.col("mean") - F.col("pm")) / F.col("sm"), F.abs(F.col("cv") - F.col("pc")) / F.col("sc"), 0.8 * drop) / 5, F.lit(1.0))
    return g.select(*NODE, F.when(F.col("n") < 10, 0.0).when(F.col("peers") == 1, unit(one)).otherwise(unit(more)).alias("peer"))


def peer_share(rows: DataFrame, nodes: DataFrame, beyond: float = 2.0) -> DataFrame:
    """(run_id, node_id, phi): share of days on which a node is more than ``beyond`` deviations from its peers' mean.

    Mean and deviation of the others come from sums over all of a key's rows of the day, so rows don't meet in pairs.
    """
    s = rows.join(_meta(nodes, "peer_key"), _own(nodes))
    day = Window.partitionBy("run_id", "peer_key", "t")
    s = s.withColumn("c", F.count("*").over(day)).withColumn("mid", F.avg("value").over(day)).withColumn("ss", F.var_pop("value").over(day) * F.count("*").over(day))
    c, off = F.col("c"), F.col("value") - F.col("mid")
    rest = F.greatest(F.col("ss") - off * off * c / (c - 1), F.lit(0.0))
    z = F.when(c > 2, F.abs(off) * c / (c - 1) / F.greatest(F.sqrt(rest / (c - 2)), F.lit(1e-8)))
    g = s.groupBy(*NODE).agg(F.avg(F.coalesce(z > beyond, F.lit(False)).cast("double")).alias("phi"), F.first("n").alias("n"))
    return g.select(*NODE, F.when(F.col("n") < 20, 0.0).otherwise(F.col("phi")).alias("phi"))


def causal_excess(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, node_id, excess): raw less what the most anomalous input passes on; sources keep raw."""
    kind = _meta(nodes, by_kind(F.col("transform_type"), TRANSFER, 0.7).alias("rho"), (F.size("upstream") == 0).alias("top"))
    both = raw.join(kind, _own(nodes)).join(_most_upstream(nodes, raw, "raw", "r"), list(NODE), "left")
    return both.select(*NODE, F.when(F.col("top"), F.col("raw")).otherwise(unit(F.col("raw") - F.col("rho") * F.coalesce("r", F.lit(0.0)))).alias("excess"))


def signals(series: DataFrame, nodes: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(run_id, node_id, raw, sl, excess, peer, phi) of every node."""
    rows = kept(numbered(series), "numbered")  # every signal reads it
    raw = kept(raw_score(rows, threshold), "raw")
    out = series.select(*NODE).distinct()
    for part in (raw, short_long(rows), causal_excess(raw, nodes), peer_score(rows, nodes), peer_share(rows, nodes)):
        out = out.join(part, list(NODE), "left")
    return kept(out.fillna(0.0), "signals")


def fused(signal: DataFrame, nodes: DataFrame) -> DataFrame:
    """signals with ``score``: by layer, how much each signal counts. With nodes by run, ``topology`` too."""
    topology = ["topology"] if "run_id" in nodes.columns else []
    meta = _meta(nodes, *topology, "node_ord", "layer", F.exists("output_columns", lambda c: c.contains("VOL")).alias("is_vol"))
    s = signal.join(meta, _own(nodes)).join(_most_upstream(nodes, signal, "peer", "up_peer"), list(NODE), "left").fillna(0.0, ["up_peer"])
    raw, sl, excess, peer = (F.col(c) for c in ("raw", "sl", "excess", "peer"))
    origin = F.when(F.col("is_vol") & (F.col("phi") > 0.5) & (peer > 0.7) & (F.col("up_peer") < 0.5), 0.85 * peer).otherwise(0.0)
    first = F.greatest(raw, 0.5 * sl, 0.75 * peer)
    third = F.greatest(0.55 * raw, 0.85 * excess, 0.80 * sl, 0.90 * peer * F.least(excess / 0.3, F.lit(1.0)), origin)
    last = F.greatest(0.40 * raw, 0.60 * excess, 0.35 * peer)
    return s.withColumn("score", unit(F.when(F.col("layer") <= 2, first).when(F.col("layer") == 3, third).otherwise(last))).drop("is_vol", "up_peer")


def weighted(signal: DataFrame, nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(setting, run_id, node_id, score) for each row of ``weights(setting, w1..w8)``; the peer signal counts as 0, so that w6 has no effect."""
    s = signal.join(_meta(nodes, "node_ord", "layer"), _own(nodes)).crossJoin(F.broadcast(weights))
    raw, sl, excess = F.col("raw"), F.col("sl"), F.col("excess")
    early = F.greatest(F.col("w1") * raw, F.col("w2") * sl)
    third = F.greatest(F.col("w3") * raw, F.col("w4") * excess, F.col("w5") * sl)
    late = F.greatest(F.col("w7") * raw, F.col("w8") * excess)
    return s.select("setting", *NODE, "node_ord", "layer", unit(F.when(F.col("layer") <= 2, early).when(F.col("layer") == 3, third).otherwise(late)).alias("score"))


def change_point(series: DataFrame, scores: DataFrame) -> DataFrame:
    """scores(run_id, node_id, score) raised to 0.7 x the relative jump of deviation between halves, over 5."""
    rows = numbered(series).withColumn("h", F.col("k") < F.floor(F.col("n") / 2))
    g = rows.groupBy(*NODE).agg(F.first("n").alias("n"), F.stddev_samp(F.when(F.col("h"), F.col("value"))).alias("s1"), F.stddev_samp(F.when(~F.col("h"), F.col("value"))).alias("s2"))
    jump = F.when((F.col("n") >= 20) & (F.col("s1") > 1e-8), 0.7 * F.least(F.abs(F.col("s2") - F.col("s1")) / F.when(F.col("s1") > 1e-8, F.col("s1")) / 5, F.lit(1.0))).otherwise(0.0)
    return scores.join(g.select(*NODE, jump.alias("jump")), list(NODE), "left").select(*NODE, F.greatest("score", F.coalesce("jump", F.lit(0.0))).alias("score"))


def blend(a: DataFrame, b: DataFrame, shares: DataFrame) -> DataFrame:
    """(share, run_id, node_id, score) = share x a + (1 - share) x b over all nodes of either; a missing score is 0."""
    both = a.select(*NODE, F.col("score").alias("x")).join(b.select(*NODE, F.col("score").alias("y")), list(NODE), "full").fillna(0.0, ["x", "y"])
    return both.crossJoin(F.broadcast(shares)).select("share", *NODE, (F.col("share") * F.col("x") + (1 - F.col("share")) * F.col("y")).alias("score"))
