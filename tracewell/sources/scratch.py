"""Tables written between the steps of a query, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_cleared = [0]


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master, as in tests. The executors of
    a cluster could not see that one, so there it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tracewell-"))
    return _own[0]


def _base(spark: SparkSession) -> str:
    """A folder of this application alone."""
    return f"{folder(spark)}/tracewell/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def cleared() -> int:
    """How often ``clear`` was called: tables kept for the session are gone after that."""
    return _cleared[0]


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows is planned on a table, and a lost executor costs
    no more than reading it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's tables of ``kept``: call it when no query that reads one is running or still to be read."""
    _cleared[0] += 1
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
