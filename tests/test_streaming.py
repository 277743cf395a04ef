"""A replayed stream gives what the sorted table gives, however it is cut into batches, and after a restart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import learned
from tracewell.streaming import scores

SCHEMA = "event_id bigint, ts timestamp, event_type string, value double"


def events(spark, n=400):
    rng = random.Random(1)
    rows = [(k, 1_700_000_000.0 + 60 * k + rng.random(), rng.choice(["a", "a", "b", None]), rng.choice([None, 1.0, rng.gauss(0, 1), rng.gauss(5, 3)])) for k in range(n)]
    rows += [(n + 1, 1_700_000_000.0 + 60 * 20, "a", 7.0), (n, 1_700_000_000.0 + 60 * 20, "a", 8.0)]  # two of one time
    return spark.createDataFrame(rows, "event_id bigint, s double, event_type string, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value")


def run(spark, base, forest):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = scores.stream_scores(stream, "30 minutes", forest)
    out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(scores.OUT).parquet(f"{base}/out")


def expected(table, forest):
    limit = scores.passed(table, 30 * 60 * 1000)
    out = {}
    for r in scores.table_scores(table).where(F.col("at") <= limit).collect():
        out[r.id] = (r.key, r.value, r.z, None if r.w is None else float(forest.scores(np.array(r.w)[None])[0]))
    return out


def same(got, want):
    assert {r.id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        key, value, z, odd = want[r.id]
        assert (r.key, r.value) == (key, value) and (r.z is None) == (z is None) and (r.forest is None) == (odd is None)
        assert z is None or abs(r.z - z) < 1e-9
        assert odd is None or abs(r.forest - odd) < 1e-9


@pytest.mark.parametrize("cuts", [1, 4])
def test_any_batches_equal_the_table(spark, tmp_path, cuts):
    table = events(spark).cache()
    forest = learned.grow(np.random.default_rng(0).normal(size=(200, scores.WIDTH)), trees=10)
    start = F.floor((F.unix_seconds("ts") - 1_700_000_000) / 60)
    # neighbours in time go to different batches, 15 minutes apart at most
    part = F.least(F.lit(cuts - 1), F.greatest(F.lit(0), F.floor((start + F.pmod(F.xxhash64("event_id"), F.lit(15))) / (400 / cuts)))).cast("int")
    for k in range(cuts):
        table.where(part == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    same(run(spark, tmp_path, forest).collect(), expected(table, forest))


def test_restart_and_late_rows(spark, tmp_path):
    table = events(spark).cache()
    forest = learned.grow(np.random.default_rng(0).normal(size=(200, scores.WIDTH)), trees=10)
    first, rest = table.where("event_id < 150 or event_id >= 400"), table.where("event_id >= 150 and event_id < 400")
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path, forest)
    late = spark.createDataFrame([(9000, 1_700_000_000.0, "a", 99.0)], "event_id bigint, s double, event_type string, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value")
    rest.unionByName(late).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    same(run(spark, tmp_path, forest).collect(), expected(table, forest))


class Many:
    def scores(self, x):
        assert len(x) > 1, "one window at a time"
        return x.max(axis=1)


def test_windows_meet_the_forest_together(spark, tmp_path):
    spark.sparkContext.addPyFile(__file__)  # tasks find the class
    table = events(spark, 2000).cache()
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = {r.id: r.forest for r in run(spark, tmp_path, Many()).collect()}
    want = {r.id: r.w and max(r.w) for r in scores.table_scores(table).where(F.col("at") <= scores.passed(table, 30 * 60 * 1000)).collect()}
    assert set(got) == set(want) and all((got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-9) for k, w in want.items())


def test_rows_without_an_id_come_last_of_their_time(spark, tmp_path):
    table = events(spark).withColumn("event_id", F.when(F.col("event_id") < 400, F.col("event_id") + 2**60)).where("event_id is not null or value = 7.0").cache()
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    same(run(spark, tmp_path, None).collect(), {r.id: (r.key, r.value, r.z, None) for r in scores.table_scores(table).where(F.col("at") <= scores.passed(table, 30 * 60 * 1000)).collect()})


def test_deviations_grow_no_forest(spark, monkeypatch):
    from tracewell.plans import queries, stream_queries

    monkeypatch.setattr(stream_queries, "forest", lambda events: 1 / 0)
    assert queries.QUERIES["stream_deviations"](spark, "/root/testdata/sf0.001").where("z is not null").count() > 0
