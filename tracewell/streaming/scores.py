"""Scores of series as their values arrive: rolling deviation, and an isolation forest over the last values.

A key's state is the last values that count and the rows that wait. A row waits until the watermark has passed its time,
so that rows of any order within the delay, dealt to any batches, give the same result as the table sorted by time; rows
behind the watermark are late and left out. State holds what a delay's worth of rows of a key is, and ``width`` values, as
bytes. A key's step only sorts and takes deviations; windows go on from it to tasks of any key, where the forest is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.learned import Forest

WIDTH, LEAST = 20, 5
OUT = "key string, at bigint, id bigint, value double, z double, forest double"
STATE = "tail binary, waiting binary"
#: A waiting row: its time, its id and whether that is null, its value.
_ROW = np.dtype([("at", "i8"), ("no_id", "?"), ("id", "i8"), ("value", "f8")])
#: Rows that are worked out together.
SLICE = 50_000


def micros(events: DataFrame, ts: str) -> Column:
    """A column of times in microseconds; times without a zone count as UTC."""
    if isinstance(events.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(ts)


def _rows(events: DataFrame, key: str, ts: str, row_id: str, value: str) -> DataFrame:
    """(key, ts, at, id, value); ``at`` is the time in microseconds. Rows without key, time or value are left out."""
    e = events.select(F.col(key).cast("string").alias("key"), micros(events, ts).alias("at"), F.col(row_id).cast("bigint").alias("id"), F.col(value).cast("double").alias("value"))
    return e.where("key is not null and at is not null and value is not null").withColumn("ts", F.timestamp_micros("at"))


def deviations(line: np.ndarray, start: int, width: int, least: int) -> np.ndarray:
    """How many deviations each value of ``line`` from ``start`` on lies from the mean of the last ``width``; NaN with fewer
    than ``least`` of them."""
    out = np.full(len(line) - start, np.nan)
    for k in range(start, min(len(line), width - 1)):
        w = line[: k + 1]
        if len(w) >= max(2, least):
            out[k - start] = abs(w[-1] - w.mean()) / max(w.std(ddof=1), 1e-8)
    if width >= max(2, least):
        for k in range(max(start, width - 1), len(line), SLICE):
            w = sliding_window_view(line[k + 1 - width : k + SLICE], width)
            out[k - start : k - start + len(w)] = np.abs(w[:, -1] - w.mean(axis=1)) / np.maximum(w.std(axis=1, ddof=1), 1e-8)
    return out


def packed_windows(line: np.ndarray, start: int, width: int) -> list[bytes | None]:
    """For each value of ``line`` from ``start`` on the window it ends, as doubles of mean 0 and deviation 1; none with fewer
    than ``width`` values or no deviation."""
    first = max(start, width - 1)
    out: list[bytes | None] = [None] * (min(first, len(line)) - start)
    if first < len(line):
        w = sliding_window_view(line[first + 1 - width :], width)
        dev = w.std(axis=1)
        packed = ((w - w.mean(axis=1)[:, None]) / np.where(dev > 1e-8, dev, 1.0)[:, None]).tobytes()
        out += [packed[8 * width * k : 8 * width * (k + 1)] if d else None for k, d in enumerate((dev > 1e-8).tolist())]
    return out


def _nullable(values: np.ndarray, null: np.ndarray, name: str) -> pd.Series:
    return pd.Series(pd.array(values, name)).mask(null)


def stream_scores(events: DataFrame, delay: str = "1 hour", forest: Forest | None = None, key: str = "event_type", ts: str = "ts", row_id: str = "event_id", value: str = "value", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(key, at, id, value, z, forest) of each row of the stream ``events`` once the watermark, ``delay`` behind the latest
    time, has passed it: how many deviations it lies from the mean of its key's last ``width`` values (null with fewer than
    ``least``), and the forest's score of these (null with fewer than ``width``, or without a forest)."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, waiting = state.get if state.exists else (b"", b"")
        parts = [np.frombuffer(bytes(waiting), _ROW)]
        for f in frames:
            part = np.empty(len(f), _ROW)
            for c in _ROW.names:
                part[c] = f[c]
            parts.append(part)
        rows = np.concatenate(parts)
        del parts
        rows = rows[np.lexsort((rows["id"], rows["no_id"], rows["at"]))]  # keeps the order of equal ones
        n = int(np.searchsorted(rows["at"], state.getCurrentWatermarkMs() * 1000, side="right"))
        ready, rest = rows[:n], rows[n:]
        before = np.frombuffer(bytes(tail))
        line = np.concatenate([before, ready["value"]])
        state.update((line[max(0, len(line) + 1 - width) :].tobytes(), rest.tobytes()))
        if len(rest):
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, -(-int(rest["at"][0]) // 1000)))
        for k in range(0, n, SLICE):
            some, at = ready[k : k + SLICE], len(before) + k
            own = line[max(0, at + 1 - width) : at + len(some)]
            start = len(own) - len(some)
            z = deviations(own, start, width, least)
            last = {"forest": _nullable(np.zeros(len(some)), np.ones(len(some), bool), "Float64")} if forest is None else {"w": packed_windows(own, start, width)}
            yield pd.DataFrame({"key": name[0], "at": some["at"], "id": _nullable(some["id"], some["no_id"], "Int64"), "value": some["value"], "z": _nullable(z, np.isnan(z), "Float64")} | last)

    rows = _rows(events, key, ts, row_id, value).withColumn("no_id", F.col("id").isNull()).fillna(0, ["id"]).withWatermark("ts", delay)
    schema = OUT if forest is None else OUT.replace("forest double", "w binary")
    out = rows.groupBy("key").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out if forest is None else _with_forest(out, forest, width)


def _with_forest(rows: DataFrame, forest: Forest, width: int) -> DataFrame:
    """``rows`` with the forest's score in the place of the window ``w``, their last column; they are dealt over all tasks first."""
    held = rows.sparkSession.sparkContext.broadcast(forest)  # of a size fixed by the bounds of its fit

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(b.num_columns - 1)
            full = w.is_valid().to_numpy(zero_copy_only=False)
            odd = np.zeros(len(full))
            if full.any():
                odd[full] = held.value.scores(np.frombuffer(b"".join(w.drop_null().to_pylist())).reshape(-1, width))
            yield pa.RecordBatch.from_arrays([*b.columns[1:-1], pa.array(odd, mask=~full)], [*b.schema.names[1:-1], "forest"])

    # the hash is a column, as an exchange can't take the rows of a keyed step as they are
    return rows.select(F.xxhash64("at", "id").alias("slot"), "*").repartition("slot").mapInArrow(score, OUT)


def table_scores(events: DataFrame, key: str = "event_type", ts: str = "ts", row_id: str = "event_id", value: str = "value", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(key, at, id, value, z, w) of a table: the same deviations, and the windows that forests take, evened (null with fewer
    than ``width`` values or no deviation)."""
    w = Window.partitionBy("key").orderBy("at", F.col("id").asc_nulls_last()).rowsBetween(1 - width, 0)
    rows = _rows(events, key, ts, row_id, value)
    n, mean = F.count("value").over(w), F.avg("value").over(w)
    rows = rows.withColumn("z", F.when(n >= max(2, least), F.abs(F.col("value") - mean) / F.greatest(F.stddev_samp("value").over(w), F.lit(1e-8))))
    rows = rows.withColumn("_w", F.when(n == width, F.collect_list("value").over(w))).withColumn("_mean", mean).withColumn("_dev", F.stddev_pop("value").over(w))
    return rows.select("key", "at", "id", "value", "z", F.when(F.col("_dev") > 1e-8, F.transform("_w", lambda v: (v - F.col("_mean")) / F.col("_dev"))).alias("w"))


def passed(events: DataFrame, delay_ms: int, ts: str = "ts") -> int | None:
    """The watermark, in microseconds, once all of ``events`` have been read."""
    last = events.agg(F.max(micros(events, ts)).alias("x")).first().x
    return None if last is None else (last // 1000 - delay_ms) * 1000
