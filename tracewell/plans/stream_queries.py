"""Registered queries over the events table read as a stream, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learned
from ..sources import market
from ..sources.scratch import new_path
from ..streaming import scores
from .catalogue import PLACES, _round, add

#: Windows that the forest is grown on at most, those of least hash.
SAMPLE = 20_000


def forest(events: DataFrame) -> learned.Forest | None:
    """A forest of windows of a table of events."""
    some = scores.table_scores(events).where("w is not null").orderBy(F.xxhash64("key", "at", "id"), "key", "at", "id").select("w").limit(SAMPLE).toPandas()
    return learned.grow(np.stack(some.w)) if len(some) else None


def replayed(spark: SparkSession, sf_dir: str, by_forest: bool) -> DataFrame:
    """The events as a stream to its end, scored into a table; ``by_forest`` also by a forest of the table's windows."""
    table = market.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be a file or a folder
    base = new_path(spark, "stream")
    out = scores.stream_scores(stream, forest=forest(table) if by_forest else None)
    out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(scores.OUT).parquet(f"{base}/out")


add(
    "stream_deviations", lambda spark, d: replayed(spark, d, False).select("key", F.col("id").alias("event_id"), F.col("at").alias("at_us"), _round("value"), _round("z")),
    f"""SELECT key, event_id, at_us, round(value, {PLACES}) + 0.0 AS value, round(CASE WHEN n >= 5 THEN abs(value - mean) / greatest(dev, 1e-8) END, {PLACES}) + 0.0 AS z FROM (
 SELECT event_type AS key, event_id, epoch_us(ts) AS at_us, value, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS dev FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL
 WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE at_us <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events)""",
)
add("stream_forest", lambda spark, d: replayed(spark, d, True).select("key", F.col("id").alias("event_id"), _round("forest")))
