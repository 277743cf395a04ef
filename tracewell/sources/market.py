"""Market series: views over order tables, and generators whose draws depend on the series and day alone."""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import both_ways
from .scratch import kept
from .topology import FX, RATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_grid(days: DataFrame, keys: Column, values: DataFrame) -> DataFrame:
    return days.withColumn("i", F.explode(keys)).join(values, ["dt", "i"], "left")


def market(spark: SparkSession, sf_dir: str, stocks: int = 5) -> DataFrame:
    """source(col, t, value): prices, positions, one currency and three rates from the order tables. Prices have gaps.

    Each order table is read once, into sums by day (and instrument and rate) that all series are made from.
    """
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    price, rate = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_linenumber") % 3
    sums = items.groupBy(F.to_date("l_shipdate").alias("dt"), (F.col("l_suppkey") % stocks + 1).cast("int").alias("i"), rate.alias("r")).agg(
        F.sum(price).alias("price"), F.count(price).alias("prices"), F.sum("l_quantity").alias("size"), F.sum("l_discount").alias("off"), F.count("l_discount").alias("offs")
    )
    sums = kept(sums, "market-sums")
    days = sums.select("dt").where("dt is not null").distinct().withColumn("t", F.row_number().over(Window.orderBy("dt")) - 1)  # one row a day
    daily = sums.groupBy("dt", "i").agg((F.sum("price") / F.nullif(F.sum("prices"), F.lit(0))).alias("price"), F.sum("size").alias("size"))
    cells = _on_grid(days, F.sequence(F.lit(1), F.lit(stocks)), daily)
    prices = cells.select(F.format_string("STOCK_%d_PRICE", "i").alias("col"), "t", F.col("price").alias("value"))
    sizes = cells.withColumn("value", both_ways(F.col("size"), "i")).select(F.format_string("POSITION_%d_SIZE", "i").alias("col"), "t", "value")
    offs = sums.groupBy("dt", F.col("r").alias("i")).agg((F.sum("off") / F.nullif(F.sum("offs"), F.lit(0))).alias("v"))
    rates = _on_grid(days, F.sequence(F.lit(0), F.lit(2)), offs).withColumn("value", both_ways(F.col("v"), "i"))
    rates = rates.select(F.element_at(F.array(F.lit("RATE_SHORT"), F.lit("RATE_MID"), F.lit("RATE_LONG")), F.col("i") + 1).alias("col"), "t", "value")
    paid = kept(orders.groupBy(F.to_date("o_orderdate").alias("dt")).agg(F.sum("o_totalprice").alias("v"), F.count("o_totalprice").alias("n")), "market-paid")
    level = paid.agg((F.sum("v") / F.sum("n")).alias("level"))
    fx = days.join(paid, "dt", "left").crossJoin(F.broadcast(level)).withColumn("v", F.col("v") / F.nullif("n", F.lit(0)) / F.col("level"))
    fx = fx.select(F.lit("USD_KRW").alias("col"), "t", both_ways(F.col("v")).alias("value"))  # one row a day
    return prices.unionByName(sizes).unionByName(rates).unionByName(fx)


def ticker_map(spark: SparkSession, sf_dir: str, n: int = 12) -> DataFrame:
    """(nation, ticker, i, price_col, position_col): the first ``n`` nations are the tickers of instruments 1, 2, ...; there
    are as many positions as tickers."""
    w = Window.orderBy("n_nationkey")  # a row for each nation
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("ticker"), F.row_number().over(w).alias("i")).where(F.col("i") <= n)
    return rows.select("*", F.format_string("STOCK_%d_PRICE", "i").alias("price_col"), F.format_string("POSITION_%d_SIZE", "i").alias("position_col"))


def markets(spark: SparkSession, sf_dir: str, sizes: dict[str, tuple[int, int, int]], tickers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(source(topology, col, t, value), days(n_days)) for sizes of (stocks, rates, currencies): suppliers are dealt to a
    size's stocks, or by ``tickers`` to one size's, line numbers to its rates, customers to its currencies. Prices have gaps.

    Each order table is read once, into sums by day and the keys that all sizes can be made from.
    """
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    size = spark.createDataFrame([(n, *s) for n, s in sizes.items()], "topology string, stocks int, rates int, currencies int")  # a row for each size
    price = F.col("l_extendedprice") / F.col("l_quantity")
    dealt = F.col("l_suppkey") % lcm(*(s[0] for s in sizes.values()))
    if tickers is not None:
        owners = table(spark, sf_dir, "supplier").join(tickers, F.col("s_nationkey") == F.col("nation")).select(F.col("s_suppkey").alias("l_suppkey"), (F.col("i") - 1).alias("own"))
        items, dealt = items.join(owners, "l_suppkey", "left"), F.col("own")
    sums = items.groupBy(F.to_date("l_shipdate").alias("dt"), dealt.alias("s"), (F.col("l_linenumber") % lcm(*(s[1] for s in sizes.values()))).alias("r")).agg(
        F.sum(price).alias("price"), F.count(price).alias("prices"), F.sum("l_quantity").alias("size"), F.sum("l_discount").alias("off"), F.count("l_discount").alias("offs")
    )
    sums = kept(sums.where("dt is not null"), "market-sums")
    days = kept(sums.select("dt").distinct().withColumn("t", F.row_number().over(Window.orderBy("dt")) - 1), "market-days")  # one row a day
    each = sums.crossJoin(F.broadcast(size))  # every size has all the sums
    daily = each.groupBy("topology", "dt", (F.col("s") % F.col("stocks") + 1).cast("int").alias("i")).agg((F.sum("price") / F.nullif(F.sum("prices"), F.lit(0))).alias("price"), F.sum("size").alias("size"))
    grid = days.crossJoin(F.broadcast(size))
    cells = grid.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("stocks")))).join(daily, ["topology", "dt", "i"], "left")
    prices = cells.select("topology", F.format_string("STOCK_%d_PRICE", "i").alias("col"), "t", F.col("price").alias("value"))
    held = cells.withColumn("value", both_ways(F.col("size"), "topology", "i")).select("topology", F.format_string("POSITION_%d_SIZE", "i").alias("col"), "t", "value")
    offs = each.groupBy("topology", "dt", (F.col("r") % F.col("rates") + 1).cast("int").alias("i")).agg((F.sum("off") / F.nullif(F.sum("offs"), F.lit(0))).alias("v"))
    rates = grid.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rates")))).join(offs, ["topology", "dt", "i"], "left").withColumn("value", both_ways(F.col("v"), "topology", "i"))
    rates = rates.select("topology", F.element_at(F.array(*map(F.lit, RATES)), F.col("i")).alias("col"), "t", "value")
    paid = orders.groupBy(F.to_date("o_orderdate").alias("dt"), (F.col("o_custkey") % lcm(*(s[2] for s in sizes.values()))).alias("c")).agg(F.sum("o_totalprice").alias("v"), F.count("o_totalprice").alias("n"))
    by_size = kept(paid, "market-paid").crossJoin(F.broadcast(size)).groupBy("topology", "dt", (F.col("c") % F.col("currencies") + 1).cast("int").alias("i")).agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    level = by_size.groupBy("topology", "i").agg((F.sum("v") / F.sum("n")).alias("level"))
    fx = grid.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("currencies")))).join(by_size, ["topology", "dt", "i"], "left").join(level, ["topology", "i"], "left")
    fx = fx.withColumn("value", both_ways(F.col("v") / F.nullif("n", F.lit(0)) / F.col("level"), "topology", "i")).select("topology", F.element_at(F.array(*map(F.lit, FX)), F.col("i")).alias("col"), "t", "value")
    return prices.unionByName(held).unionByName(rates).unionByName(fx), days.agg(F.count("*").alias("n_days"))


# -- generators --------------------------------------------------------------------------------------------------------


def uniform(*key: Column) -> Column:
    """A draw from (0, 1) that is fixed by its key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def normal(*key: Column) -> Column:
    return F.sqrt(-2 * F.ln(uniform(*key, F.lit("r")))) * F.cos(2 * 3.141592653589793 * uniform(*key, F.lit("a")))


def business_days(spark: SparkSession, seeds: DataFrame, n: int, start: str = "2023-01-02") -> DataFrame:
    """(seed, t, dt): ``n`` days from Monday to Friday for each of ``seeds(seed)``."""
    days = spark.range(n * 7 // 5 + 7).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("dt")).where("dayofweek(dt) between 2 and 6")
    days = days.withColumn("t", F.row_number().over(Window.orderBy("dt")) - 1).where(F.col("t") < n)
    return seeds.crossJoin(F.broadcast(days))


def generated(spark: SparkSession, seeds: DataFrame, n: int = 252, stocks: int = 5, rates: int = 3, currencies: int = 2) -> DataFrame:
    """source(seed, col, t, value) by geometric Brownian motion (stocks: drift .08, volatility .2 from 100; currencies:
    0, .05 from 1), a floored mean-reverting walk (rates) and a compounding 1 % walk (positions)."""
    days = business_days(spark, seeds, n).select("seed", "t")
    dt = 1 / 252

    def walk(count: int, name: Column, step: Column, start: Column) -> DataFrame:
        grid = days.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn("col", name)
        total = F.sum(step).over(Window.partitionBy("seed", "col").orderBy("t"))
        return grid.withColumn("value", start * F.exp(total)).select("seed", "col", "t", "value")

    z = normal(F.col("seed"), F.col("col"), F.col("t"))
    prices = walk(stocks, F.format_string("STOCK_%d_PRICE", "i"), (0.08 - 0.2**2 / 2) * dt + 0.2 * dt**0.5 * z, F.lit(100.0))
    names = F.array(*map(F.lit, ("USD_KRW", "EUR_KRW", "JPY_KRW", "GBP_KRW", "CNY_KRW")))
    fx = walk(currencies, F.element_at(names, F.col("i")), (0.0 - 0.05**2 / 2) * dt + 0.05 * dt**0.5 * z, F.lit(1.0))
    base = 1e5 + 9e5 * uniform(F.col("seed"), F.col("col"), F.lit("base"))
    sizes = walk(stocks, F.format_string("POSITION_%d_SIZE", "i"), F.log1p(0.01 * z), base)
    paths = days.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(rates)))).withColumn("col", F.element_at(F.array(*map(F.lit, ("RATE_SHORT", "RATE_MID", "RATE_LONG"))), F.col("i")))
    steps = paths.withColumn("z", z).groupBy("seed", "col", "i").agg(F.array_sort(F.collect_list(F.struct("t", "z"))).alias("steps"))  # n entries
    level = 0.03 * (1 + 0.5 * (F.col("i") - 1))
    path = F.aggregate("steps", F.array(F.lit(0.02)), lambda a, s: F.concat(a, F.array(F.greatest(F.lit(0.0), F.element_at(a, -1) + 0.5 * (level - F.element_at(a, -1)) * dt + 0.01 * dt**0.5 * s["z"]))))
    rate = steps.select("seed", "col", F.posexplode(F.slice(path, 2, n)).alias("t", "value"))
    return prices.unionByName(fx).unionByName(sizes).unionByName(rate)


def normalised(prices: DataFrame) -> DataFrame:
    """``prices(col, t, value)`` with each series in percent of its first value."""
    first = F.first("value", ignorenulls=True).over(Window.partitionBy("col").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return prices.withColumn("value", F.col("value") / first * 100)


def as_fractions(rates: DataFrame) -> DataFrame:
    """Series of rates whose median is above 0.5 are in percent: they are divided by 100; gaps are filled on and back."""
    value = F.when(F.percentile("value", F.lit(0.5)).over(Window.partitionBy("col")) > 0.5, F.col("value") / 100).otherwise(F.col("value"))
    return rates.withColumn("value", value).withColumn("value", both_ways(F.col("value"), "col"))


def last_days(series: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each series."""
    return series.withColumn("_k", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("t")))).where(F.col("_k") <= n).drop("_k")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
