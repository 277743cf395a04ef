"""The lineage graph from events that jobs send: JSON under a fixed schema, the latest of each job counts.

An event names a job, what it is (its kind and layer), the datasets it reads, each with the columns it takes, and those it
writes. Jobs are nodes; a job that reads what another writes has an edge from it. A later event of a job replaces the
earlier ones, also where the graph is kept and new events come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

_DATASET = "array<struct<namespace: string, name: string, facets: struct<schema: struct<fields: array<struct<name: string>>>>>>"
#: The fields of an event that are read.
SCHEMA = f"eventType string, eventTime timestamp, run struct<runId: string>, job struct<namespace: string, name: string, facets: struct<jobType: struct<jobType: string>, layer: struct<layer: int, ord: int, expected: int>>>, inputs {_DATASET}, outputs {_DATASET}"
#: Of these, the fields that tell whether an event counts.
HEAD = "eventType string, eventTime timestamp, run struct<runId: string>, job struct<namespace: string, name: string>"
NODE = ("topology", "node_id", "node_ord", "layer", "transform_type", "input_columns", "output_columns", "upstream", "expected_input_count", "last_run_id", "at")


def _datasets(names: Column, columns: Column) -> Column:
    """Dataset k with column k."""
    return F.transform(names, lambda n, k: F.struct(F.lit("tables").alias("namespace"), n.alias("name"), F.struct(F.struct(F.array(F.struct(F.get(columns, k).alias("name"))).alias("fields")).alias("schema")).alias("facets")))


def events(nodes: DataFrame, stamps: DataFrame) -> DataFrame:
    """(event string): an event of each of ``stamps(topology, node_ord, event_type, ts, run_id, without)`` for its node. A node
    reads its inputs' tables and writes its own; of its inputs the last ``without`` are left out."""
    n = nodes.join(stamps, ["topology", "node_ord"])
    have = F.greatest(F.size("upstream") - F.col("without"), F.lit(0))
    inputs, taken = F.slice("upstream", 1, have), F.slice("input_columns", 1, F.greatest(F.size("input_columns") - F.col("without"), F.lit(0)))
    body = F.struct(
        F.col("event_type").alias("eventType"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"), F.struct(F.col("run_id").alias("runId")).alias("run"),
        F.struct(F.col("topology").alias("namespace"), F.col("node_id").alias("name"), F.struct(F.struct(F.upper("transform_type").alias("jobType")).alias("jobType"), F.struct("layer", F.col("node_ord").alias("ord"), F.col("expected_input_count").alias("expected")).alias("layer")).alias("facets")).alias("job"),
        _datasets(inputs, taken).alias("inputs"), _datasets(F.array("node_id"), F.col("output_columns")).alias("outputs"),
    )
    return n.select(F.to_json(body).alias("event"))


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    """(event, fields of ``schema``); by a generator, as conditions on a column of from_json would parse each event anew."""
    return raw.select("event", F.inline(F.array(F.from_json("event", schema, {"mode": "PERMISSIVE"}))))


def nodes_of(raw: DataFrame, rejected: bool = False) -> DataFrame:
    """Nodes (see NODE) of the latest completed event of each job in ``raw(event)``; of several at one time, the one of the
    largest run id. Events that are no JSON, or name no job or time, are left out; ``rejected`` gives these instead.

    ``raw`` is gone through twice: for the latest time of each job, which is hashed and not sorted, and for the events of that
    time, which alone are parsed whole."""
    e = _parsed(raw, HEAD)
    sound = F.col("job.name").isNotNull() & F.col("eventTime").isNotNull()
    if rejected:
        return e.where(~F.coalesce(sound, F.lit(False))).select("event")
    key = (F.col("job.namespace").alias("topology"), F.col("job.name").alias("node_id"))
    done = e.where(sound & (F.col("eventType") == "COMPLETE")).select("event", *key, "eventTime")
    times = kept(done.groupBy("topology", "node_id").agg(F.max("eventTime").alias("eventTime")), "event-times")
    own = F.col("e.topology").eqNullSafe(F.col("t.topology")) & (F.col("e.node_id") == F.col("t.node_id")) & (F.col("e.eventTime") == F.col("t.eventTime"))
    few = _parsed(done.alias("e").join(times.alias("t"), own).select("e.event"), SCHEMA)
    last = few.groupBy(*key).agg(F.max_by(F.struct("job", "run", "inputs", "outputs", "eventTime"), F.struct("eventTime", "run.runId")).alias("x"))
    columns = lambda c: F.flatten(F.transform(F.coalesce(F.col(c), F.array()), lambda d: F.transform(F.coalesce(d["facets"]["schema"]["fields"], F.array()), lambda f: f["name"])))
    facets = "x.job.facets."
    return last.select(
        "topology", "node_id", F.col(facets + "layer.ord").alias("node_ord"), F.col(facets + "layer.layer").alias("layer"), F.lower(facets + "jobType.jobType").alias("transform_type"), columns("x.inputs").alias("input_columns"), columns("x.outputs").alias("output_columns"),
        F.transform(F.coalesce("x.inputs", F.array()), lambda d: d["name"]).alias("upstream"), F.col(facets + "layer.expected").alias("expected_input_count"), F.col("x.run.runId").alias("last_run_id"), F.col("x.eventTime").alias("at"),
    )


def upserted(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with those of ``new``; of a node in both, the one of the later event stays. Edges follow from nodes."""
    both = nodes.select(*NODE).unionByName(new.select(*NODE))
    key = ("topology", "node_id")
    return both.groupBy(*key).agg(F.max_by(F.struct(*(c for c in NODE if c not in key)), F.struct("at", "last_run_id")).alias("x")).select(*key, "x.*")
