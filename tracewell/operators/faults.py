"""Faults as tables of parameters: rows that act on sources, and one row of overrides for each run."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import grid
from .dataflow import OVERRIDES

RUNS = "run_id string, topology string, n_stocks int"
ACTIONS = "run_id string, col string, t_from int, t_to int, op string, amount double, seed bigint"
TRUTH = "run_id string, anomaly_type string, node_id string, magnitude double"
#: The registered runs: one for each kind of fault with fixed places, at this magnitude.
MAGNITUDE = 8.0


class Setup(NamedTuple):
    """Runs and their faults: tables by run, actions on sources, overrides of nodes, the truth."""

    runs: DataFrame
    actions: DataFrame
    overrides: DataFrame
    truth: DataFrame


def registered(spark: SparkSession, m: float = MAGNITUDE) -> Setup:
    """The runs clean and A1 to A6 on the five instruments of the market.

    A1 multiplies a few days of one source; A2 scales a currency conversion, a stretch of it more; A3 computes one
    volatility over 2 days instead of 20, times m; A4 leaves one member out of a sector; A5 sets days to mean + 3.8
    deviations x m / 8; A6 multiplies three sources by m / 2 and less.
    """
    price = "STOCK_{}_PRICE".format
    actions = [("A1", price(1), 100, 104, "times", m, None), ("A5", price(4), 200, 208, "level", 3.8 * m / 8, None)]
    actions += [("A6", price(k), 150, 155, "times", m * 0.5 * f, None) for k, f in ((1, 1.0), (2, 0.6), (3, 0.35))]
    overrides = [("A2", "ETL_FX_STOCK_2_PRICE", m, None, None, None, None), ("A3", "FEAT_VOL20_STOCK_3_PRICE", m, None, None, max(2, int(20 / m)), None), ("A4", "FEAT_SECTOR_B", None, None, None, None, 5)]
    truth = [("A1", "SRC_STOCK_1_PRICE"), ("A2", "ETL_FX_STOCK_2_PRICE"), ("A3", "FEAT_VOL20_STOCK_3_PRICE"), ("A4", "FEAT_SECTOR_B"), ("A5", "SRC_STOCK_4_PRICE"), ("A6", "SRC_STOCK_1_PRICE")]
    runs = [(r, "market", 5) for r in ("clean", "A1", "A2", "A3", "A4", "A5", "A6")]
    return Setup(spark.createDataFrame(runs, RUNS), spark.createDataFrame(actions, ACTIONS), spark.createDataFrame(overrides, OVERRIDES), spark.createDataFrame([(r, r, n, m) for r, n in truth], TRUTH))


def drawn(spark: SparkSession, runs: DataFrame, n_days: int, n_stocks: int, m: float = MAGNITUDE) -> DataFrame:
    """Actions for ``runs(run_id, anomaly_type, seed)`` of types A1, A5, A6 and A7 with places drawn from the seed.

    A7 is a spike of 2 to 5 days on one stock and noise of 0.7 m deviations on another; with one stock it is A1.
    """

    def draw(low, high, *key):
        return (F.lit(low) + F.pmod(F.xxhash64("seed", *map(F.lit, key)), F.lit(1) * (high - low))).cast("int")

    d = runs.withColumn("k", draw(1, n_stocks + 1, "stock")).withColumn("at", draw(60, max(61, n_days - 20), "start")).withColumn("days", F.when(F.col("anomaly_type") == "A7", draw(2, 6, "len")).otherwise(draw(1, 6, "len")))
    other = F.col("k") % n_stocks + 1

    def act(stock, op, amount, days):
        return F.struct(F.format_string("STOCK_%d_PRICE", stock.cast("int")).alias("col"), F.col("at").alias("t_from"), (F.col("at") + days).cast("int").alias("t_to"), F.lit(op).alias("op"), F.lit(amount).cast("double").alias("amount"))

    spike = act(F.col("k"), "times", m, F.col("days"))
    noise = F.struct(F.format_string("STOCK_%d_PRICE", other.cast("int")).alias("col"), F.lit(0).alias("t_from"), F.lit(n_days).alias("t_to"), F.lit("noise").alias("op"), F.lit(0.7 * m).alias("amount"))
    several = F.array(*(act((F.col("k") + j - 1) % n_stocks + 1, "times", m * 0.5 * f, F.lit(5)) for j, f in zip(range(min(3, n_stocks)), (1.0, 0.6, 0.35))))
    kinds = F.when(F.col("anomaly_type") == "A5", F.array(act(F.col("k"), "level", 3.8 * m / 8, F.lit(8)))).when(F.col("anomaly_type") == "A6", several)
    if n_stocks > 1:
        kinds = kinds.when(F.col("anomaly_type") == "A7", F.array(spike, noise))
    kinds = kinds.otherwise(F.array(spike))
    return d.where("anomaly_type in ('A1', 'A5', 'A6', 'A7')").select("run_id", F.explode(kinds).alias("x"), "seed").select("run_id", "x.*", "seed")


def inject(source: DataFrame, actions: DataFrame) -> DataFrame:
    """source(run_id, col, t, value) with each action's effect. ``times`` multiplies days from t_from up to t_to; ``level``
    sets them to the series' mean + amount x its deviation; ``noise`` adds a normal draw, fixed by seed and day, of amount
    x its deviation. Actions on one column must not overlap."""
    w = Window.partitionBy("run_id", "col")
    a = actions.select("run_id", "col", "t_from", "t_to", "op", "amount", "seed")
    hit = source.join(a, (source.run_id == a.run_id) & (source.col == a.col) & (source.t >= a.t_from) & (source.t < a.t_to), "left").select(source["*"], "op", "amount", "seed")
    mean, dev = F.avg("value").over(w), F.stddev_samp("value").over(w)
    value = F.when(F.col("op") == "times", F.col("value") * F.col("amount")).when(F.col("op") == "level", mean + F.col("amount") * dev)
    value = value.when(F.col("op") == "noise", F.col("value") + F.expr(grid.normal("seed * 1048576 + t", 7)) * F.col("amount") * dev).otherwise(F.col("value"))
    return hit.withColumn("value", value).drop("op", "amount", "seed")


def dropped_inputs(nodes: DataFrame, runs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each run's nodes, where a member that its sector leaves out is gone from the sector's inputs (not from its
    upstream). A sector of one input keeps it."""
    lost = overrides.where("member is not null").groupBy("run_id", "node_id").agg(F.max("member").alias("member"))
    every = nodes.join(runs.select("run_id", "topology"), "topology").join(lost, ["run_id", "node_id"], "left")
    hit = F.col("member").isNotNull() & (F.size("input_columns") > 1)
    return every.withColumn("input_columns", F.when(hit, F.array_remove("input_columns", F.format_string("STOCK_%d_PRICE_RETURN", "member"))).otherwise(F.col("input_columns"))).drop("member")
