"""Grids of runs: kinds of faults x sizes x trials, each run a stretch of days of one size's market with one fault.

A grid is a table with a row for each run and every drawn place in it. Draws are integer arithmetic on (number of the
run, key), the same in any SQL dialect, so a row can be worked out anywhere and no place depends on how Spark deals the
rows. All later tables are keyed by ``run_id``; runs of one size share its graph by ``topology``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.topology import SIZES

KINDS = ("A1", "A2", "A3", "A4", "A5", "A6", "A7")
#: The magnitude of experiments, days of a run, trials of a cell.
MAGNITUDE, DAYS, TRIALS = 8.0, 252, 30
_M = 2147483647


def draw(seed: str, key: int) -> str:
    """SQL of a number from 0 to 2**31 - 2 that is fixed by the SQL of a seed and by key: linear and quadratic steps in turn."""
    a = f"((CAST({seed} AS BIGINT) * 48271 + 11) % {_M})"
    b = f"(({a} * {a} + {7919 * key + 3}) % {_M})"
    c = f"(({b} * 69621 + {a}) % {_M})"
    return f"(({c} * {c} + {b}) % {_M})"


def drawn_number(seed: int, key: int) -> int:
    """What ``draw`` comes to."""
    a = (seed * 48271 + 11) % _M
    b = (a * a + 7919 * key + 3) % _M
    c = (b * 69621 + a) % _M
    return (c * c + b) % _M


def below(seed: str, key: int, n: str | int) -> str:
    return f"CAST({draw(seed, key)} % ({n}) AS INT)"


def unit(seed: str, key: int) -> str:
    """From 0 to 1, both out of reach."""
    return f"((CAST({draw(seed, key)} AS DOUBLE) + 0.5) / {_M}.0)"


def normal(seed: str, key: int) -> str:
    return f"(sqrt(-2 * ln({unit(seed, key)})) * cos(6.283185307179586 * {unit(seed, key + 1)}))"


def _case(key: str, values: Sequence, quote: bool = False) -> str:
    """The value of number ``key``."""
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {repr(v) if quote else v}" for k, v in enumerate(values)) + " END"


def columns(sizes: Sequence[str], kinds: Sequence[str] = KINDS, magnitudes: Sequence[float] = (MAGNITUDE,), days: int = DAYS, drawn_stretch: bool = False, first: int = 0) -> list[dict[str, str]]:
    """SQL of a run's columns from its number ``id`` and the calendar's length ``n_days``, in steps: each may use those before.

    Kinds change fastest, then sizes, then trials. Magnitudes go round with the trials. ``stock`` is the place of the
    fault (of A4, ``member`` of the sector), ``other`` the noisy stock of A7, and ``second`` and ``third`` those after
    the first of A6. Days of a fault go from ``t_from`` to before ``t_to``; of A2, those that are scaled once more: from
    a third of the days on, or with ``drawn_stretch`` anywhere. ``width`` is what A3's 20 days shrink to. Trials count from
    ``first``. A kind that is none of KINDS has no fault.
    """
    k, s = len(kinds), len(sizes)
    start = {"A1": f"60 + {below('id', 4, days - 70)}", "A7": f"60 + {below('id', 4, days - 70)}", "A5": f"60 + {below('id', 4, days - 80)}", "A6": f"60 + {below('id', 4, days - 75)}", "A2": below("id", 4, days - 10) if drawn_stretch else str(days // 3)}
    length = {"A1": f"1 + {below('id', 5, 5)}", "A7": f"2 + {below('id', 5, 4)}", "A5": "8", "A6": "5", "A2": "10"}

    def of_kind(table: dict[str, str], other: str) -> str:
        return "CASE anomaly_type " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in table.items()) + f" ELSE {other} END"

    return [
        {"anomaly_type": _case(f"CAST(id % {k} AS INT)", kinds, True), "topology": _case(f"CAST(floor(id / {k}) AS INT) % {s}", sizes, True), "trial": f"CAST(floor(id / {k * s}) AS INT) + {first}"},
        {"n_stocks": "CASE topology " + " ".join(f"WHEN '{n}' THEN {SIZES[n][0]}" for n in sizes) + " END", "m": f"CAST({_case(f'trial % {len(magnitudes)}', magnitudes)} AS DOUBLE)", "shift": below("trial + 42", 1, f"CASE WHEN n_days > {days} THEN n_days - {days} + 1 ELSE 1 END")},
        {"stock": f"1 + {below('id', 1, 'n_stocks')}", "half": "CASE WHEN n_stocks < 4 THEN 1 ELSE CAST(floor(n_stocks / 2) AS INT) END", "second_sector": f"{below('id', 2, 2)} = 1", "t_from": of_kind(start, "0")},
        {"other": f"(stock - 1 + 1 + {below('id', 6, 'CASE WHEN n_stocks > 1 THEN n_stocks - 1 ELSE 1 END')}) % n_stocks + 1", "second": "stock % n_stocks + 1", "third": "(stock + 1) % n_stocks + 1", "t_to": f"t_from + {of_kind(length, '0')}", "width": "CASE WHEN floor(20 / m) > 2 THEN CAST(floor(20 / m) AS INT) ELSE 2 END",
         "member": f"CASE WHEN second_sector THEN half + 1 + {below('id', 3, 'n_stocks - half')} ELSE 1 + {below('id', 3, 'half')} END"},
    ]


def runs(spark: SparkSession, n_days: DataFrame, sizes: Sequence[str], trials: int = TRIALS, **how) -> DataFrame:
    """The grid (run_id, anomaly_type, topology, trial, ...): see ``columns``. ``n_days(n_days)`` is one row."""
    steps = columns(sizes, **how)
    out = spark.range(len(how.get("kinds", KINDS)) * len(sizes) * trials).crossJoin(F.broadcast(n_days))
    for step in steps:
        out = out.withColumns({name: F.expr(text) for name, text in step.items()})
    return out.withColumn("run_id", F.concat_ws("/", "topology", "anomaly_type", "trial")).drop("n_days")


def runs_sql(sizes: Sequence[str], trials: int = TRIALS, **how) -> str:
    """The same as a query over the number of days, ``calendar(n_days)``."""
    text = f"SELECT range AS id, n_days FROM range({len(how.get('kinds', KINDS)) * len(sizes) * trials}), calendar"
    for step in columns(sizes, **how):
        text = "SELECT *, " + ", ".join(f"{e} AS {name}" for name, e in step.items()) + f" FROM ({text})"
    return f"SELECT * EXCLUDE (n_days), topology || '/' || anomaly_type || '/' || trial AS run_id FROM ({text})"


def stretches(markets: DataFrame, runs: DataFrame, days: int = DAYS) -> DataFrame:
    """source(run_id, col, t, value): for each run ``days`` days of its size's series, from its shift on."""
    own = runs.select("run_id", "topology", F.posexplode(F.sequence("shift", F.col("shift") + days - 1)).alias("t", "at"))
    return markets.withColumnRenamed("t", "at").join(own, ["topology", "at"]).select("run_id", "col", "t", "value")


def actions(runs: DataFrame) -> DataFrame:
    """What faults.inject takes, of A1, A5, A6 and A7."""

    def act(stock: str, op: str, amount, whole: bool = False):
        ends = (F.lit(0), F.lit(1 << 30)) if whole else (F.col("t_from"), F.col("t_to"))
        return F.struct(F.format_string("STOCK_%d_PRICE", F.col(stock).cast("int")).alias("col"), ends[0].alias("t_from"), ends[1].alias("t_to"), F.lit(op).alias("op"), amount.cast("double").alias("amount"))

    m, kind = F.col("m"), F.col("anomaly_type")
    several = [act(c, "times", m * 0.5 * f) for c, f in (("stock", 1.0), ("second", 0.6), ("third", 0.35))]
    spike = act("stock", "times", m)
    found = F.when(kind == "A1", F.array(spike)).when(kind == "A5", F.array(act("stock", "level", 3.8 * m / 8)))
    found = found.when(kind == "A6", F.when(F.col("n_stocks") >= 3, F.array(*several)).when(F.col("n_stocks") == 2, F.array(*several[:2])).otherwise(F.array(several[0])))
    found = found.when(kind == "A7", F.when(F.col("n_stocks") >= 2, F.array(spike, act("other", "noise", 0.7 * m, whole=True))).otherwise(F.array(spike)))
    return runs.select("run_id", F.col("id").alias("seed"), F.explode(found).alias("x")).select("run_id", "x.*", "seed")


def overrides(runs: DataFrame) -> DataFrame:
    """(run_id, node_id, factor, t_from, t_to, width, member) of A2, A3 and A4: what dataflow.instruments takes."""
    kind, none = F.col("anomaly_type"), F.lit(None)
    price = F.format_string("STOCK_%d_PRICE", "stock")
    node = F.when(kind == "A2", F.concat(F.lit("ETL_FX_"), price)).when(kind == "A3", F.concat(F.lit("FEAT_VOL20_"), price)).otherwise(F.when(F.col("second_sector"), "FEAT_SECTOR_B").otherwise("FEAT_SECTOR_A"))
    only = lambda a, c: F.when(kind == a, c).otherwise(none)
    return runs.where(kind.isin("A2", "A3", "A4")).select("run_id", node.alias("node_id"), F.when(kind != "A4", F.col("m")).alias("factor"), only("A2", F.col("t_from")).alias("t_from"), only("A2", F.col("t_to")).alias("t_to"), only("A3", F.col("width")).alias("width"), only("A4", F.col("member")).cast("int").alias("member"))


def truth(runs: DataFrame) -> DataFrame:
    """(run_id, anomaly_type, pipeline_size, trial, node_id, magnitude)."""
    kind, price = F.col("anomaly_type"), F.format_string("STOCK_%d_PRICE", "stock")
    node = F.when(kind == "A2", F.concat(F.lit("ETL_FX_"), price)).when(kind == "A3", F.concat(F.lit("FEAT_VOL20_"), price)).when(kind == "A4", F.when(F.col("second_sector"), "FEAT_SECTOR_B").otherwise("FEAT_SECTOR_A")).otherwise(F.concat(F.lit("SRC_"), price))
    return runs.select("run_id", "anomaly_type", F.col("topology").alias("pipeline_size"), "trial", node.alias("node_id"), F.col("m").alias("magnitude"))
