"""The risk dataflow's nodes and edges, as rows keyed by topology, for any number of instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "topology string, node_id string, node_ord int, layer int, transform_type string, input_columns array<string>, output_columns array<string>, upstream array<string>, expected_input_count int"
#: Names of currencies and rates, and below of families (``peer_key``), which figures depend on.
FX = ("USD_KRW", "EUR_KRW", "JPY_KRW", "GBP_KRW", "CNY_KRW")
RATES = ("RATE_SHORT", "RATE_MID", "RATE_LONG")
#: Stocks, rates, currencies of the named sizes; there are as many positions as stocks.
SIZES = {"small": (3, 2, 1), "medium": (5, 3, 2), "large": (8, 3, 3), "market": (5, 3, 1), "real": (12, 3, 3)} | {f"s{n}": (n, 3, 3) for n in (20, 55, 110)}


def rows(topology: str, stocks: int, rates: int, currencies: int) -> list[tuple]:
    """One row for each node, in the order in which they are laid down."""
    s = [f"STOCK_{k}_PRICE" for k in range(1, stocks + 1)]
    out: list[tuple] = []

    def node(node_id: str, layer: int, kind: str, inputs: list[str], output: str, upstream: list[str], expected: int | None = None) -> None:
        out.append((topology, node_id, len(out), layer, kind, inputs, [output], upstream, expected))

    for col in [*s, *RATES[:rates], *FX[:currencies], *(f"POSITION_{k}_SIZE" for k in range(1, stocks + 1))]:
        node(f"SRC_{col}", 1, "source", [], col, [])
    for c in s:
        node(f"ETL_IMPUTE_{c}", 2, "filter", [c], f"{c}_CLEAN", [f"SRC_{c}"])
    for c in s:
        node(f"ETL_CLIP_{c}", 2, "filter", [f"{c}_CLEAN"], f"{c}_FILTERED", [f"ETL_IMPUTE_{c}"])
    for c in s:
        node(f"ETL_FX_{c}", 2, "calculate", [f"{c}_FILTERED", FX[0]], f"{c}_KRW", [f"ETL_CLIP_{c}", f"SRC_{FX[0]}"])
    for k, c in enumerate(s, 1):
        node(f"ETL_JOIN_{k}", 2, "calculate", [f"{c}_KRW", f"POSITION_{k}_SIZE"], f"PORTFOLIO_{k}_VALUE", [f"ETL_FX_{c}", f"SRC_POSITION_{k}_SIZE"])
    for c in s:
        node(f"FEAT_RETURN_{c}", 3, "calculate", [f"{c}_FILTERED"], f"{c}_RETURN", [f"ETL_CLIP_{c}"])
    for width in (20, 60):
        for c in s:
            node(f"FEAT_VOL{width}_{c}", 3, "aggregate", [f"{c}_RETURN"], f"{c}_VOL{width}", [f"FEAT_RETURN_{c}"])
    values, joins = [f"PORTFOLIO_{k}_VALUE" for k in range(1, stocks + 1)], [f"ETL_JOIN_{k}" for k in range(1, stocks + 1)]
    returns, feats = [f"{c}_RETURN" for c in s], [f"FEAT_RETURN_{c}" for c in s]
    node("FEAT_TOTAL_VALUE", 3, "aggregate", values, "PORTFOLIO_TOTAL_VALUE", joins)
    half = max(1, stocks // 2)
    for name, part in (("A", slice(0, half)), ("B", slice(half, None) if stocks > half else slice(0, half))):
        node(f"FEAT_SECTOR_{name}", 3, "aggregate", returns[part], f"SECTOR_{name}_RETURN", feats[part], len(returns[part]))
    node("RISK_VAR95", 4, "aggregate", returns, "VAR_95", feats)
    node("RISK_VAR99", 4, "aggregate", returns, "VAR_99", feats)
    node("RISK_ES95", 4, "aggregate", returns, "ES_95", feats)
    node("RISK_PORTFOLIO_VOL", 4, "aggregate", [f"{c}_VOL20" for c in s], "PORTFOLIO_VOL", [f"FEAT_VOL20_{c}" for c in s])
    node("RISK_STRESS", 4, "calculate", returns, "STRESS_PNL", feats)
    node("RISK_CONCENTRATION", 4, "calculate", [*values, "PORTFOLIO_TOTAL_VALUE"], "CONCENTRATION_RISK", [*joins, "FEAT_TOTAL_VALUE"])
    node("REPORT_REG_VAR", 5, "report", ["VAR_99"], "REG_VAR_REPORT", ["RISK_VAR99"])
    node("REPORT_DASHBOARD", 5, "report", ["VAR_95", "ES_95", "PORTFOLIO_VOL"], "RISK_DASHBOARD_SCORE", ["RISK_VAR95", "RISK_ES95", "RISK_PORTFOLIO_VOL"])
    node("REPORT_STRESS", 5, "report", ["STRESS_PNL"], "STRESS_SUMMARY", ["RISK_STRESS"])
    node("REPORT_LIMIT", 5, "report", ["CONCENTRATION_RISK", "PORTFOLIO_VOL"], "LIMIT_BREACH_REPORT", ["RISK_CONCENTRATION", "RISK_PORTFOLIO_VOL"])
    return out


def peer_key(layer: Column, output: Column) -> Column:
    """Layer, last part of the output's name, and family: what peers share."""
    o = F.upper(output)

    def has(*words: str) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | o.contains(w)
        return found

    family = (
        F.when(has("SECTOR"), "SECTOR").when(has("STOCK", "PRICE"), "STOCK").when(has("RATE"), "RATE").when(has("USD", "EUR", "JPY", "GBP", "CNY", "KRW", "FX"), "FX")
        .when(has("POSITION", "SIZE"), "POSITION").when(has("VAR", "ES", "STRESS", "CONCENTRATION"), "RISK").when(has("TOTAL", "VALUE"), "PORTFOLIO").otherwise("OTHER")
    )
    return F.concat_ws("|", layer.cast("string"), F.element_at(F.split(output, "_"), -1), family)


def nodes(spark: SparkSession, *names: str) -> DataFrame:
    """Nodes of the named sizes, with their peer key."""
    found = spark.createDataFrame([r for n in names for r in rows(n, *SIZES[n])], NODE)
    return found.withColumn("peer_key", peer_key(F.col("layer"), F.col("output_columns")[0]))


def sql_values(*names: str) -> str:
    """The same rows as a SQL VALUES list."""

    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(cell, v)) + "]::VARCHAR[]"
        return f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for n in names for r in rows(n, *SIZES[n]))
