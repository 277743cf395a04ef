"""The risk dataflow over source(run_id, col, t, value): every node's series, for all runs at once.

Two frames carry the work: one row for each (run, instrument, day) up to volatilities, and one for each (run, day) for
the portfolio; each is partitioned once and all rolling figures share that partitioning. ``runs(run_id, n_stocks)`` says
how many instruments a run has; ``overrides(run_id, node_id, factor, t_from, t_to, width, member)`` holds the faults of
single nodes (see faults.py), which the plan takes up where they act.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.series import END, START, back_filled, clipped, filled, rolling


def _stock() -> WindowSpec:
    return Window.partitionBy("run_id", "i").orderBy("t")


def _run() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("t")


def stocks(source: DataFrame) -> DataFrame:
    """(run_id, i, t, raw, size, fx): prices with their position and the currency's rate of the day."""
    price, size = r"^STOCK_(\d+)_PRICE$", r"^POSITION_(\d+)_SIZE$"
    both = source.withColumn("i", F.coalesce(F.nullif(F.regexp_extract("col", price, 1), F.lit("")), F.nullif(F.regexp_extract("col", size, 1), F.lit(""))).cast("int"))
    pairs = both.where("i is not null").groupBy("run_id", "i", "t").agg(F.max(F.when(F.col("col").startswith("STOCK"), F.col("value"))).alias("raw"), F.max(F.when(F.col("col").startswith("POSITION"), F.col("value"))).alias("size"))
    fx = source.where("col = 'USD_KRW'").select("run_id", "t", F.col("value").alias("fx"))
    return pairs.join(fx, ["run_id", "t"], "left")


def impute(frame: DataFrame) -> DataFrame:
    return frame.withColumn("clean", filled(F.col("raw"), "run_id", "i"))


def clip(frame: DataFrame, warmup: int = 60, width: float = 4.0) -> DataFrame:
    """Values beyond mean +- width deviations of the first ``warmup`` days are set to that bound."""
    w = Window.partitionBy("run_id", "i")
    head = F.when(F.col("t") < warmup, F.col("clean"))
    mean, dev = F.avg(head).over(w), F.stddev_samp(head).over(w)
    dev = F.greatest(dev, F.lit(1e-8))
    bounded = F.when(mean.isNotNull() & F.stddev_samp(head).over(w).isNotNull(), clipped(F.col("clean"), mean - width * dev, mean + width * dev)).otherwise(F.col("clean"))
    return frame.withColumn("filtered", bounded)


def _volatility(width: int) -> Column:
    return rolling(F.col("ret"), _stock(), width, width, F.stddev_samp)


#: The least number that all widths up to MOST_DAYS divide.
MOST_DAYS, _WHOLE = 20, 232_792_560


def volatility(width: Column) -> Column:
    """Deviation of ``ret`` over the last ``width`` days, a number from 1 to MOST_DAYS that may differ from series to
    series; null with fewer days. Ordered by days in units of the width, all frames have one length."""
    w = Window.partitionBy("run_id", "i").orderBy(F.col("t").cast("long") * F.floor(F.lit(_WHOLE) / width)).rangeBetween(1 - _WHOLE, 0)
    return F.when(F.count("ret").over(w) >= width, F.stddev_samp("ret").over(w))


#: Faults of single nodes: a conversion's or volatility's factor, a stretch of days, a window's width, a sector's member left out.
OVERRIDES = "run_id string, node_id string, factor double, t_from int, t_to int, width int, member int"


def by_stock(overrides: DataFrame) -> DataFrame:
    """(run_id, i, fx_factor, fx_from, fx_to, vol_factor, vol_width, lost): what acts on each instrument's conversion and
    volatility, and whether its sector leaves it out."""
    own = overrides.withColumn("i", F.coalesce("member", F.regexp_extract("node_id", r"STOCK_(\d+)_PRICE$", 1).try_cast("int")))
    at = lambda prefix, c: F.max(F.when(F.col("node_id").startswith(prefix), c))
    fx, vol = "ETL_FX_", "FEAT_VOL20_"
    return own.where("i is not null").groupBy("run_id", "i").agg(
        at(fx, F.col("factor")).alias("fx_factor"), at(fx, F.col("t_from")).alias("fx_from"), at(fx, F.col("t_to")).alias("fx_to"),
        at(vol, F.col("factor")).alias("vol_factor"), at(vol, F.col("width")).alias("vol_width"), at("FEAT_SECTOR_", F.lit(1)).alias("lost"),
    )


def _settled(frame: DataFrame, name: str) -> DataFrame:
    """Gaps of a volatility: the next value, else the last, else 0."""
    return frame.withColumn(name, F.coalesce(back_filled(F.col(name), "run_id", "i"), filled(F.col(name), "run_id", "i"), F.lit(0.0)))


def instruments(source: DataFrame, runs: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """All series of single instruments: raw, size, fx, clean, filtered, krw, worth, ret, vol20, vol60. Without ``runs`` a run
    has the instruments that ``source`` has of it; without ``overrides`` it has no faults.

    A conversion that is overridden is multiplied by its factor, its days from t_from (else a third of all) to t_to by 3
    more; a volatility that is, is over its width, 0 where that has too few days, times its factor.
    """
    prices = stocks(source)
    if runs is None:
        runs = prices.groupBy("run_id").agg(F.count_distinct("i").cast("int").alias("n_stocks"))
    if overrides is None:
        overrides = source.sparkSession.createDataFrame([], OVERRIDES)
    frame = clip(impute(prices)).join(by_stock(overrides), ["run_id", "i"], "left").join(runs.select("run_id", "n_stocks"), "run_id")
    frame = frame.withColumn("krw", F.col("filtered") * F.col("fx"))
    n = F.max("t").over(Window.partitionBy("run_id", "i")) + 1
    start = F.coalesce("fx_from", F.floor(n / 3))
    extra = F.when((F.col("t") >= start) & (F.col("t") < F.coalesce("fx_to", start + 10)), 3.0).otherwise(1.0)
    frame = frame.withColumn("krw", F.when(F.col("fx_factor").isNotNull(), F.col("krw") * F.col("fx_factor") * extra).otherwise(F.col("krw")))
    frame = frame.withColumn("worth", F.col("krw") * F.col("size"))
    frame = frame.withColumn("_ln", F.when(F.col("filtered") > 0, F.ln("filtered")))
    frame = frame.withColumn("ret", F.coalesce(F.col("_ln") - F.lag("_ln").over(_stock()), F.lit(0.0)))
    frame = frame.withColumn("vol20", volatility(F.coalesce("vol_width", F.lit(MOST_DAYS)))).withColumn("vol60", _volatility(60))
    wrong = F.coalesce("vol20", F.lit(0.0)) * F.col("vol_factor")
    frame = _settled(_settled(frame.withColumn("_wrong", wrong), "vol20"), "vol60")
    return frame.withColumn("vol20", F.coalesce("_wrong", "vol20")).drop("_ln", "_wrong")


def half(n_stocks: Column) -> Column:
    """How many instruments the first sector has; the second has the others, or the same where there is one."""
    return F.greatest(F.lit(1), F.floor(n_stocks / 2)).cast("int")


def sectors() -> tuple[Column, Column]:
    """Mean returns of both sectors, to be used in a groupBy of ``instruments``. A sector of one leaves none out."""
    first, n = half(F.col("n_stocks")), F.col("n_stocks")
    in_a = F.col("i") <= first
    in_b = F.when(n > first, ~in_a).otherwise(in_a)
    lost = F.col("lost").isNotNull()
    a = in_a & ~(lost & (first > 1))
    b = in_b & ~(lost & (F.greatest(n - first, F.lit(1)) > 1))
    return F.avg(F.when(a, F.col("ret"))).alias("sector_a"), F.avg(F.when(b, F.col("ret"))).alias("sector_b")


def _whole(c: str, what) -> Column:
    """An aggregate that is null unless all members have a value."""
    return F.when(F.count(c) == F.max("n_stocks"), what(c))


def portfolio(frame: DataFrame, n_stocks: int | None = None) -> DataFrame:
    """(run_id, t) with total, sectors, risk figures and reports, from ``instruments``; of ``n_stocks`` instruments where
    that is given, else of as many as each run has."""
    if n_stocks is not None:
        frame = frame.withColumn("n_stocks", F.lit(n_stocks))
    day = frame.groupBy("run_id", "t").agg(_whole("worth", F.sum).alias("total"), _whole("ret", F.avg).alias("ret"), _whole("vol20", F.avg).alias("vol"), F.max("worth").alias("top"), *sectors())
    last60 = _run().rowsBetween(-59, 0)
    enough = F.count("ret").over(last60) >= 60
    tail = F.collect_list("ret").over(last60)
    day = day.withColumn("q05", F.when(enough, F.percentile("ret", F.lit(0.05)).over(last60))).withColumn("q01", F.when(enough, F.percentile("ret", F.lit(0.01)).over(last60)))
    day = day.withColumn("_tail", F.when(enough, tail))
    below = F.filter("_tail", lambda x: x <= F.col("q05"))
    mean_below = F.aggregate(below, F.lit(0.0), lambda a, x: a + x) / F.size(below)
    day = day.withColumn("es95", F.coalesce(F.when(F.size(below) > 0, mean_below).otherwise(F.col("q05")), F.lit(0.0))).drop("_tail")
    day = day.withColumn("var95", F.coalesce("q05", F.lit(0.0))).withColumn("var99", F.coalesce("q01", F.lit(0.0))).drop("q05", "q01")
    day = day.withColumn("stress", F.coalesce(F.col("ret") * (-0.20 / F.greatest(F.stddev_samp("ret").over(_run().rowsBetween(START, END)), F.lit(1e-8))), F.lit(0.0)))
    day = day.withColumn("concentration", F.col("top") / clipped(F.col("total"), F.lit(1e-8), F.lit(float("inf"))))
    day = day.withColumn("dashboard", (F.abs("var95") + F.abs("es95") + F.col("vol")) / 3)

    def above(c: str, q: float) -> Column:
        return F.coalesce(F.abs(c) > F.percentile(F.abs(c), F.lit(q)).over(_run().rowsBetween(START, END)), F.lit(False)).cast("double")

    day = day.withColumn("reg_var", above("var99", 0.95)).withColumn("stress_flag", above("stress", 0.90))
    high = F.greatest("vol", F.lit(0.0))
    limit = 0.40 - 0.10 * F.least(high / (F.avg(high).over(_run().rowsBetween(START, END)) + 1e-8), F.lit(1.0))
    return day.withColumn("limit_breach", F.coalesce(F.col("concentration") > limit, F.lit(False)).cast("double"))


def node_series(source: DataFrame, frame: DataFrame, day: DataFrame) -> DataFrame:
    """(run_id, node_id, t, value) of every node."""
    price = F.format_string("STOCK_%d_PRICE", "i")
    own = {"clean": "ETL_IMPUTE_", "filtered": "ETL_CLIP_", "krw": "ETL_FX_", "ret": "FEAT_RETURN_", "vol20": "FEAT_VOL20_", "vol60": "FEAT_VOL60_"}
    cells = [F.struct(F.concat(F.lit(p), price).alias("node_id"), F.col(c).cast("double").alias("value")) for c, p in own.items()]
    cells.append(F.struct(F.format_string("ETL_JOIN_%d", "i").alias("node_id"), F.col("worth").alias("value")))
    single = frame.select("run_id", "t", F.explode(F.array(*cells)).alias("x")).select("run_id", "x.node_id", "t", "x.value")
    whole = {
        "total": "FEAT_TOTAL_VALUE", "sector_a": "FEAT_SECTOR_A", "sector_b": "FEAT_SECTOR_B", "var95": "RISK_VAR95", "var99": "RISK_VAR99", "es95": "RISK_ES95", "vol": "RISK_PORTFOLIO_VOL",
        "stress": "RISK_STRESS", "concentration": "RISK_CONCENTRATION", "reg_var": "REPORT_REG_VAR", "dashboard": "REPORT_DASHBOARD", "stress_flag": "REPORT_STRESS", "limit_breach": "REPORT_LIMIT",
    }
    cells = [F.struct(F.lit(n).alias("node_id"), F.col(c).cast("double").alias("value")) for c, n in whole.items()]
    days = day.select("run_id", "t", F.explode(F.array(*cells)).alias("x")).select("run_id", "x.node_id", "t", "x.value")
    return source.select("run_id", F.concat(F.lit("SRC_"), "col").alias("node_id"), "t", "value").unionByName(single).unionByName(days)
