"""SQL of the registered queries: common table expressions in order, each with those before it in reach."""

from __future__ import annotations

import re

from ..operators import grid
from ..operators.lineage import PRIOR, TRANSFER
from ..sources.topology import SIZES, sql_values

_UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_DOWN = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def _case(col: str, table: dict[str, float], other: float) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {other}::DOUBLE END"


def _both(c: str, part: str) -> str:
    w = f"{part} ORDER BY t"
    return f"coalesce(last_value({c} IGNORE NULLS) OVER ({w} {_UP}), first_value({c} IGNORE NULLS) OVER ({w} {_DOWN}))"


def _unit(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


_FAMILY = """CASE WHEN contains(o, 'SECTOR') THEN 'SECTOR' WHEN contains(o, 'STOCK') OR contains(o, 'PRICE') THEN 'STOCK' WHEN contains(o, 'RATE') THEN 'RATE'
 WHEN regexp_matches(o, 'USD|EUR|JPY|GBP|CNY|KRW|FX') THEN 'FX' WHEN regexp_matches(o, 'POSITION|SIZE') THEN 'POSITION'
 WHEN regexp_matches(o, 'VAR|ES|STRESS|CONCENTRATION') THEN 'RISK' WHEN regexp_matches(o, 'TOTAL|VALUE') THEN 'PORTFOLIO' ELSE 'OTHER' END"""


def nodes_sql(*names: str) -> str:
    return f"""SELECT *, layer || '|' || regexp_extract(output_columns[1], '[^_]*$') || '|' || {_FAMILY.replace("(o,", "(upper(output_columns[1]),")} AS peer_key
 FROM (VALUES {sql_values(*names)}) x(topology, node_id, node_ord, layer, transform_type, input_columns, output_columns, upstream, expected_input_count)"""


def _walk(name: str, w: str, e: str, use_scores: bool) -> dict[str, str]:
    """Transition p, restart e, powers and sum of one method."""
    return {
        f"{name}_w": f"SELECT p.run_id, g.v AS frm, g.u AS dest, {w} AS w FROM placed p JOIN edge g ON g.u = p.node_id",
        f"{name}_p": f"SELECT run_id, frm, dest, w / sum(w) OVER (PARTITION BY run_id, frm) AS p FROM {name}_w",
        f"{name}_e0": f"SELECT p.run_id, node_id, {e} AS e FROM placed p",
        f"{name}_e": f"SELECT run_id, node_id, e / (sum(e) OVER (PARTITION BY run_id) + 1e-12) AS e FROM {name}_e0",
        f"{name}_m0": f"SELECT run_id, node_id, e AS x FROM {name}_e WHERE e > 0",
        **{f"{name}_m{k}": f"SELECT m.run_id, p.dest AS node_id, sum(m.x * p.p) AS x FROM {name}_m{k - 1} m JOIN {name}_p p ON p.run_id = m.run_id AND p.frm = m.node_id GROUP BY 1, 2" for k in range(1, 8)},
        f"{name}_r": "SELECT run_id, node_id, sum(r) AS r FROM (" + " UNION ALL ".join(f"SELECT run_id, node_id, x * 0.15 * pow(0.85, {k}) AS r FROM {name}_m{k}" for k in range(8)) + ") GROUP BY 1, 2",
    }


_E = "CASE WHEN node_id = target THEN 0.7 ELSE 0.0 END + CASE WHEN node_id <> target AND score > 0.3 THEN 0.3 * score / sum(CASE WHEN node_id <> target AND score > 0.3 THEN score END) OVER (PARTITION BY run_id) ELSE 0.0 END"
_E_PLAIN = "CASE WHEN node_id = target THEN 0.7 ELSE 0.0 END"
_DECAY = "pow(0.7, coalesce(hops, 0) / max_hops)"
_ANC = "CASE WHEN p.hops IS NOT NULL THEN 1.0 ELSE 0.05 END"
_BONUS = "(1 + 0.15 * (5 - layer))"
_KIND = _case("transform_type", PRIOR, 1.0)
_A = "greatest(score, 0.01)"
_G = "(0.3 + 0.4 * (1 - coalesce(p.hops, 0) / p.max_hops))"


def _ranked(name: str, final: str) -> str:
    return f"""SELECT run_id, target, node_id, score, row_number() OVER (PARTITION BY run_id ORDER BY round(score, 12) DESC, node_ord) AS rank FROM (
 SELECT p.run_id, p.target, p.node_id, p.node_ord, {final} AS score FROM placed p LEFT JOIN {name}_r r ON r.run_id = p.run_id AND r.node_id = p.node_id WHERE p.node_id <> p.target)"""


_PRICE = "'STOCK_' || i || '_PRICE'"
CTES: dict[str, str] = {
    "node": nodes_sql("market"),
    "edge": f"SELECT a.topology, a.node_id AS u, b.node_id AS v, b.transform_type AS edge_type, {_case('b.transform_type', PRIOR, 1.0)} AS weight_prior, list_filter(a.output_columns, lambda c: list_contains(b.input_columns, c)) AS source_columns, b.output_columns AS target_columns FROM (SELECT *, unnest(upstream) AS up FROM node) b JOIN node a ON a.topology = b.topology AND a.node_id = b.up",
    "closure": "SELECT u, v, min(hops) AS hops FROM (WITH RECURSIVE c AS (SELECT u, v, 1 AS hops FROM edge UNION SELECT c.u, e.v, c.hops + 1 FROM c JOIN edge e ON e.u = c.v WHERE c.hops < 10) SELECT * FROM c) GROUP BY 1, 2",
    "runs": "SELECT * FROM (VALUES ('clean', NULL, NULL, NULL), ('A1', NULL, NULL, NULL), ('A2', 2, NULL, NULL), ('A3', NULL, 3, NULL), ('A4', NULL, NULL, 5), ('A5', NULL, NULL, NULL), ('A6', NULL, NULL, NULL)) x(run_id, fx_stock, vol_stock, drop_stock)",
    "days": "SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS t FROM (SELECT DISTINCT l_shipdate::DATE AS dt FROM lineitem)",
    "daily": "SELECT l_shipdate::DATE AS dt, (l_suppkey % 5 + 1)::INT AS i, avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS size FROM lineitem GROUP BY 1, 2",
    "cells": "SELECT d.t, g.i::INT AS i, price, size FROM days d CROSS JOIN range(1, 6) g(i) LEFT JOIN daily y ON y.dt = d.dt AND y.i = g.i",
    "rate_cells": "SELECT d.t, g.i::INT AS i, v FROM days d CROSS JOIN range(0, 3) g(i) LEFT JOIN (SELECT l_shipdate::DATE AS dt, l_linenumber % 3 AS i, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2) y ON y.dt = d.dt AND y.i = g.i",
    "fx_days": "SELECT d.t, v / (SELECT avg(o_totalprice) FROM orders) AS v FROM days d LEFT JOIN (SELECT o_orderdate::DATE AS dt, avg(o_totalprice) AS v FROM orders GROUP BY 1) y ON y.dt = d.dt",
    "market": f"""SELECT {_PRICE} AS col, t, price AS value FROM cells
 UNION ALL SELECT 'POSITION_' || i || '_SIZE', t, {_both('size', 'PARTITION BY i')} FROM cells
 UNION ALL SELECT (['RATE_SHORT', 'RATE_MID', 'RATE_LONG'])[i + 1], t, {_both('v', 'PARTITION BY i')} FROM rate_cells
 UNION ALL SELECT 'USD_KRW', t, {_both('v', '')} FROM fx_days""",
    "source": """SELECT run_id, col, t, CASE WHEN run_id = 'A1' AND col = 'STOCK_1_PRICE' AND t >= 100 AND t < 104 THEN value * 8.0
 WHEN run_id = 'A6' AND col = 'STOCK_1_PRICE' AND t >= 150 AND t < 155 THEN value * 4.0 WHEN run_id = 'A6' AND col = 'STOCK_2_PRICE' AND t >= 150 AND t < 155 THEN value * 2.4
 WHEN run_id = 'A6' AND col = 'STOCK_3_PRICE' AND t >= 150 AND t < 155 THEN value * 1.4
 WHEN run_id = 'A5' AND col = 'STOCK_4_PRICE' AND t >= 200 AND t < 208 THEN avg(value) OVER (PARTITION BY run_id, col) + 3.8 * stddev_samp(value) OVER (PARTITION BY run_id, col)
 ELSE value END AS value FROM market CROSS JOIN runs""",
    "s0": "SELECT p.run_id, c.i, p.t, p.value AS raw, q.value AS size, f.value AS fx, r.fx_stock, r.vol_stock, r.drop_stock FROM source p JOIN (SELECT range::INT AS i FROM range(1, 6)) c ON p.col = 'STOCK_' || c.i || '_PRICE' JOIN source q ON q.run_id = p.run_id AND q.t = p.t AND q.col = 'POSITION_' || c.i || '_SIZE' JOIN source f ON f.run_id = p.run_id AND f.t = p.t AND f.col = 'USD_KRW' JOIN runs r ON r.run_id = p.run_id",
    "s1": f"SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY run_id, i ORDER BY t {_UP}) AS clean FROM s0",
    "s2": "SELECT *, avg(clean) FILTER (t < 60) OVER (PARTITION BY run_id, i) AS mu, stddev_samp(clean) FILTER (t < 60) OVER (PARTITION BY run_id, i) AS sd, max(t) OVER (PARTITION BY run_id, i) + 1 AS n FROM s1",
    "s3": "SELECT *, CASE WHEN clean IS NULL THEN NULL WHEN mu IS NULL OR sd IS NULL THEN clean ELSE greatest(least(clean, mu + 4 * greatest(sd, 1e-8)), mu - 4 * greatest(sd, 1e-8)) END AS filtered FROM s2",
    "s4": "SELECT *, filtered * fx * CASE WHEN i = fx_stock THEN 8.0 * CASE WHEN t >= n // 3 AND t < n // 3 + 10 THEN 3.0 ELSE 1.0 END ELSE 1.0 END AS krw, coalesce(CASE WHEN filtered > 0 THEN ln(filtered) END - lag(CASE WHEN filtered > 0 THEN ln(filtered) END) OVER (PARTITION BY run_id, i ORDER BY t), 0.0) AS ret FROM s3",
    "s5": "SELECT *, krw * size AS worth, " + ", ".join(f"CASE WHEN count(ret) OVER w{k} >= {k} THEN stddev_samp(ret) OVER w{k} END AS v{k}" for k in (2, 20, 60)) + " FROM s4 WINDOW " + ", ".join(f"w{k} AS (PARTITION BY run_id, i ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (2, 20, 60)),
    "inst": "SELECT run_id, i, t, raw, size, fx, clean, filtered, krw, worth, ret, drop_stock, CASE WHEN i = vol_stock THEN coalesce(v2, 0.0) * 8.0 ELSE "
    + f"coalesce(first_value(v20 IGNORE NULLS) OVER (PARTITION BY run_id, i ORDER BY t {_DOWN}), last_value(v20 IGNORE NULLS) OVER (PARTITION BY run_id, i ORDER BY t {_UP}), 0.0) END AS vol20, "
    + f"coalesce(first_value(v60 IGNORE NULLS) OVER (PARTITION BY run_id, i ORDER BY t {_DOWN}), last_value(v60 IGNORE NULLS) OVER (PARTITION BY run_id, i ORDER BY t {_UP}), 0.0) AS vol60 FROM s5",
    "d0": "SELECT run_id, t, CASE WHEN count(worth) = 5 THEN sum(worth) END AS total, avg(ret) AS ret, avg(vol20) AS vol, max(worth) AS top, avg(ret) FILTER (i <= 2) AS sector_a, avg(ret) FILTER (i > 2 AND i IS DISTINCT FROM drop_stock) AS sector_b FROM inst GROUP BY 1, 2",
    "d1": "SELECT *, CASE WHEN count(ret) OVER w >= 60 THEN quantile_cont(ret, 0.05) OVER w END AS q05, CASE WHEN count(ret) OVER w >= 60 THEN quantile_cont(ret, 0.01) OVER w END AS q01, CASE WHEN count(ret) OVER w >= 60 THEN list(ret) OVER w END AS tail FROM d0 WINDOW w AS (PARTITION BY run_id ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "d2": "SELECT * EXCLUDE (q05, q01, tail), coalesce(q05, 0.0) AS var95, coalesce(q01, 0.0) AS var99, coalesce(list_avg(list_filter(tail, lambda x: x <= q05)), 0.0) AS es95, coalesce(ret * (-0.20 / greatest(stddev_samp(ret) OVER (PARTITION BY run_id), 1e-8)), 0.0) AS stress, CASE WHEN total IS NOT NULL THEN top / greatest(total, 1e-8) END AS concentration FROM d1",
    "day": "SELECT *, (abs(var95) + abs(es95) + vol) / 3 AS dashboard, (abs(var99) > quantile_cont(abs(var99), 0.95) OVER (PARTITION BY run_id))::INT::DOUBLE AS reg_var, (abs(stress) > quantile_cont(abs(stress), 0.90) OVER (PARTITION BY run_id))::INT::DOUBLE AS stress_flag, coalesce(concentration > 0.40 - 0.10 * least(greatest(vol, 0.0) / (avg(greatest(vol, 0.0)) OVER (PARTITION BY run_id) + 1e-8), 1.0), false)::INT::DOUBLE AS limit_breach FROM d2",
    "series": "SELECT run_id, 'SRC_' || col AS node_id, t, value FROM source"
    + "".join(f" UNION ALL SELECT run_id, '{p}' || {_PRICE}, t, {c} FROM inst" for c, p in {"clean": "ETL_IMPUTE_", "filtered": "ETL_CLIP_", "krw": "ETL_FX_", "ret": "FEAT_RETURN_", "vol20": "FEAT_VOL20_", "vol60": "FEAT_VOL60_"}.items())
    + " UNION ALL SELECT run_id, 'ETL_JOIN_' || i, t, worth FROM inst"
    + "".join(
        f" UNION ALL SELECT run_id, '{n}', t, {c} FROM day"
        for c, n in {
            "total": "FEAT_TOTAL_VALUE", "sector_a": "FEAT_SECTOR_A", "sector_b": "FEAT_SECTOR_B", "var95": "RISK_VAR95", "var99": "RISK_VAR99", "es95": "RISK_ES95", "vol": "RISK_PORTFOLIO_VOL", "stress": "RISK_STRESS",
            "concentration": "RISK_CONCENTRATION", "reg_var": "REPORT_REG_VAR", "dashboard": "REPORT_DASHBOARD", "stress_flag": "REPORT_STRESS", "limit_breach": "REPORT_LIMIT",
        }.items()
    ),
    "num": "SELECT *, row_number() OVER (PARTITION BY run_id, node_id ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY run_id, node_id) AS n FROM series WHERE value IS NOT NULL",
    "stab": "SELECT run_id, node_id, t, value, n, k - skip AS j, n - skip AS m FROM (SELECT *, CASE WHEN n > least(60, n // 4) + 20 THEN least(60, n // 4) ELSE 0 END AS skip FROM num) WHERE k >= skip",
    "zs": "SELECT *, CASE WHEN count(*) OVER w >= 5 THEN abs((value - avg(value) OVER w) / greatest(stddev_samp(value) OVER w, 1e-8)) END AS z, j // greatest(m // 4, 5) AS seg FROM stab WINDOW w AS (PARTITION BY run_id, node_id ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "seg": "SELECT run_id, node_id, stddev_samp(value) AS sd FROM zs WHERE seg < 4 GROUP BY run_id, node_id, seg",
    "jump": "SELECT run_id, node_id, CASE WHEN count(*) >= 2 THEN least((max(sd) / (min(sd) + 1e-8) - 1) / 10, 1.0) ELSE 0.0 END AS jump FROM seg WHERE sd > 1e-8 GROUP BY 1, 2",
    "raw0": "SELECT run_id, node_id, 0.6 * avg(CASE WHEN z > 2 THEN 1.0 ELSE 0.0 END) + 0.4 * least(coalesce(max(z), 0.0) / 6, 1.0) AS z, any_value(n) AS n FROM zs GROUP BY 1, 2",
    "raws": f"SELECT r.run_id, r.node_id, CASE WHEN n < 10 THEN 0.0 ELSE {_unit('greatest(z, 0.8 * coalesce(jump, 0.0))')} END AS raw FROM raw0 r LEFT JOIN jump j USING (run_id, node_id)",
    "sl0": "SELECT run_id, node_id, n, CASE WHEN count(*) OVER a >= 3 THEN stddev_samp(value) OVER a END AS s, CASE WHEN count(*) OVER b >= 10 THEN stddev_samp(value) OVER b END AS l FROM num WINDOW a AS (PARTITION BY run_id, node_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY run_id, node_id ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)",
    "sls": f"SELECT run_id, node_id, CASE WHEN max(n) < 40 OR count(q) < 10 THEN 0.0 ELSE {_unit('0.9 * greatest(least((quantile_cont(q, 0.5) - 1) / 4, 1.0), least((quantile_cont(q, 0.95) - 1) / 6, 1.0))')} END AS sl FROM (SELECT *, CASE WHEN l > 1e-8 THEN s / l END AS q FROM sl0) GROUP BY 1, 2",
    "lev": "SELECT x.run_id, x.node_id, peer_key, any_value(n) AS n, count(*) AS m, avg(value) AS mean, stddev_samp(value) / (abs(avg(value)) + 1e-8) AS cv FROM (SELECT *, CASE WHEN n > least(60, n // 4) + 10 THEN least(60, n // 4) ELSE 0 END AS skip FROM num) x JOIN node USING (node_id) WHERE k >= skip GROUP BY 1, 2, 3",
    "met": "SELECT a.run_id, a.node_id, any_value(a.n) AS n, any_value(a.mean) AS mean, any_value(a.cv) AS cv, count(*) AS peers, avg(b.mean) AS pm, avg(b.cv) AS pc, stddev_pop(b.mean) + 1e-10 AS sm, stddev_pop(b.cv) + 1e-10 AS sc FROM lev a JOIN lev b ON a.run_id = b.run_id AND a.peer_key = b.peer_key AND a.node_id <> b.node_id AND b.m > 5 GROUP BY 1, 2",
    "peers": f"SELECT run_id, node_id, CASE WHEN n < 10 THEN 0.0 WHEN peers = 1 THEN {_unit('2 * greatest(abs(mean - pm) / (abs(pm) + 1e-8), abs(cv - pc) / (pc + 1e-8))')} ELSE {_unit('greatest(abs(mean - pm) / sm, abs(cv - pc) / sc, 0.8 * greatest(0.0, (pm - mean) / (sm + 1e-10))) / 5')} END AS peer FROM met",
    "apart": "SELECT a.run_id, a.node_id, a.t, any_value(a.value) AS value, any_value(a.n) AS n, avg(b.value) AS pm, stddev_samp(b.value) AS ps FROM (SELECT num.*, peer_key FROM num JOIN node USING (node_id)) a LEFT JOIN (SELECT num.*, peer_key FROM num JOIN node USING (node_id)) b ON a.run_id = b.run_id AND a.peer_key = b.peer_key AND a.t = b.t AND a.node_id <> b.node_id GROUP BY 1, 2, 3",
    "phis": "SELECT run_id, node_id, CASE WHEN max(n) < 20 THEN 0.0 ELSE avg(CASE WHEN abs(value - pm) / greatest(ps, 1e-8) > 2 AND ps IS NOT NULL THEN 1.0 ELSE 0.0 END) END AS phi FROM apart GROUP BY 1, 2",
    "excesses": f"SELECT r.run_id, r.node_id, CASE WHEN len(any_value(n.upstream)) = 0 THEN any_value(r.raw) ELSE {_unit('any_value(r.raw) - ' + _case('any_value(n.transform_type)', TRANSFER, 0.7) + ' * coalesce(max(u.raw), 0.0)')} END AS excess FROM raws r JOIN node n ON n.node_id = r.node_id LEFT JOIN edge e ON e.v = r.node_id LEFT JOIN raws u ON u.run_id = r.run_id AND u.node_id = e.u GROUP BY 1, 2",
    "signal": "SELECT b.run_id, b.node_id, coalesce(raw, 0.0) AS raw, coalesce(sl, 0.0) AS sl, coalesce(excess, 0.0) AS excess, coalesce(peer, 0.0) AS peer, coalesce(phi, 0.0) AS phi FROM (SELECT DISTINCT run_id, node_id FROM series) b LEFT JOIN raws USING (run_id, node_id) LEFT JOIN sls USING (run_id, node_id) LEFT JOIN excesses USING (run_id, node_id) LEFT JOIN peers USING (run_id, node_id) LEFT JOIN phis USING (run_id, node_id)",
    "fused0": "SELECT s.*, n.layer, n.node_ord, list_bool_or([contains(c, 'VOL') for c in n.output_columns]) AS is_vol, coalesce((SELECT max(p.peer) FROM edge e JOIN signal p ON p.node_id = e.u WHERE e.v = s.node_id AND p.run_id = s.run_id), 0.0) AS up_peer FROM signal s JOIN node n USING (node_id)",
    "score": f"SELECT run_id, node_id, node_ord, layer, {_unit('CASE WHEN layer <= 2 THEN greatest(raw, 0.5 * sl, 0.75 * peer) WHEN layer = 3 THEN greatest(0.55 * raw, 0.85 * excess, 0.80 * sl, 0.90 * peer * least(excess / 0.3, 1.0), CASE WHEN is_vol AND phi > 0.5 AND peer > 0.7 AND up_peer < 0.5 THEN 0.85 * peer ELSE 0.0 END) ELSE greatest(0.40 * raw, 0.60 * excess, 0.35 * peer) END')} AS score FROM fused0",
    "halves": "SELECT run_id, node_id, max(n) AS n, stddev_samp(value) FILTER (k < n // 2) AS s1, stddev_samp(value) FILTER (k >= n // 2) AS s2 FROM num GROUP BY 1, 2",
    "seeds": "SELECT run_id, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, node_ord) AS a, row_number() OVER (PARTITION BY run_id, layer > 1 ORDER BY score DESC, node_ord) AS b FROM score WHERE score >= 0.1) WHERE a <= 5 OR (layer > 1 AND b <= 5)",
    "cover": "SELECT s.run_id, c.v AS node_id, n.layer, n.node_ord, sum(s.score) AS cover FROM seeds s JOIN closure c ON c.u = s.node_id JOIN node n ON n.node_id = c.v WHERE n.layer >= 4 GROUP BY 1, 2, 3, 4",
    "target": "SELECT run_id, node_id AS target FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(10 * layer + cover, 9) DESC, node_ord) AS k FROM cover) WHERE k = 1",
    "placed0": "SELECT s.run_id, s.node_id, s.node_ord, s.layer, s.score, n.transform_type, t.target, CASE WHEN s.node_id = t.target THEN 0 ELSE c.hops END AS hops FROM score s JOIN node n USING (node_id) JOIN target t ON t.run_id = s.run_id LEFT JOIN closure c ON c.u = s.node_id AND c.v = t.target",
    "placed": "SELECT *, greatest(max(hops) OVER (PARTITION BY run_id), 1) AS max_hops FROM placed0",
    **_walk("v1", f"greatest(score, 1e-4) * weight_prior * {_DECAY}", _E, True),
    **_walk("v2", f"greatest(score, 1e-4) * {_DECAY}", _E, True),
    **_walk("v3", f"greatest(score, 1e-4) * {_case('edge_type', TRANSFER, 1.0)} * {_DECAY}", _E, True),
    **_walk("va", "1.0", _E_PLAIN, False),
    "rank_v1": _ranked("v1", f"(0.4 * coalesce(r, 0.0) + 0.6 * {_A}) * {_ANC} * {_BONUS} * {_KIND}"),
    "rank_v2": _ranked("v2", f"({_G} * coalesce(r, 0.0) + (1 - {_G}) * {_A}) * {_ANC} * {_BONUS} * greatest({_KIND} * (1 - 0.5 * {_A}), 0.1)"),
    "rank_v3": _ranked("v3", f"({_G} * coalesce(r, 0.0) + (1 - {_G}) * {_A}) * {_ANC} * {_BONUS} * greatest({_KIND} * (1 - 0.5 * {_A}), 0.1)"),
    "rank_vanilla": _ranked("va", f"(0.4 * coalesce(r, 0.0) + 0.6 * 0.5) * {_ANC}"),
    "st_p": "SELECT u AS frm, v AS dest, 1.0 / count(*) OVER (PARTITION BY u) AS p FROM edge",
    "st_m0": "SELECT run_id, node_id, score / sum(score) OVER (PARTITION BY run_id) AS x FROM score",
    **{f"st_m{k}": f"SELECT m.run_id, p.dest AS node_id, sum(m.x * p.p) AS x FROM st_m{k - 1} m JOIN st_p p ON p.frm = m.node_id GROUP BY 1, 2" for k in range(1, 8)},
    "st_r": "SELECT run_id, node_id, sum(r) AS r FROM (" + " UNION ALL ".join(f"SELECT run_id, node_id, x * 0.15 * pow(0.85, {k}) AS r FROM st_m{k}" for k in range(8)) + ") GROUP BY 1, 2",
    "rank_structural": _ranked("st", "coalesce(r, 0.0)"),
    "rank_hops": "SELECT run_id, target, node_id, 1 - coalesce(hops, max_hops + 1) / (max_hops + 1) AS score, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(hops, max_hops + 1), round(score, 12) DESC, node_ord) AS rank FROM placed WHERE node_id <> target",
    "rank_score": "SELECT run_id, target, node_id, score, row_number() OVER (PARTITION BY run_id ORDER BY round(score, 12) DESC, node_ord) AS rank FROM placed WHERE node_id <> target",
    "run_inputs": "SELECT r.run_id, n.node_id, n.expected_input_count AS want, len(list_filter(n.input_columns, lambda c: NOT coalesce(len(n.input_columns) > 1 AND n.node_id = CASE WHEN r.drop_stock <= 2 THEN 'FEAT_SECTOR_A' ELSE 'FEAT_SECTOR_B' END AND c = 'STOCK_' || r.drop_stock || '_PRICE_RETURN', false))) AS have FROM node n CROSS JOIN runs r",
    "short": "SELECT run_id, node_id, want - have AS missing, 1 - have / want AS share FROM run_inputs WHERE want IS NOT NULL AND have < want",
    "rank_schema": "SELECT p.run_id, p.target, p.node_id, CASE WHEN s.missing IS NULL THEN p.score ELSE s.share END AS score, row_number() OVER (PARTITION BY p.run_id ORDER BY s.missing DESC NULLS LAST, round(p.score, 12) DESC, p.node_ord) AS rank FROM placed p LEFT JOIN short s ON s.run_id = p.run_id AND s.node_id = p.node_id WHERE p.run_id IN (SELECT run_id FROM short)",
    "hybrid": "SELECT * FROM rank_schema UNION ALL SELECT * FROM rank_v2 WHERE run_id NOT IN (SELECT run_id FROM short)",
    "truth": "SELECT * FROM (VALUES ('A1', 'SRC_STOCK_1_PRICE'), ('A2', 'ETL_FX_STOCK_2_PRICE'), ('A3', 'FEAT_VOL20_STOCK_3_PRICE'), ('A4', 'FEAT_SECTOR_B'), ('A5', 'SRC_STOCK_4_PRICE'), ('A6', 'SRC_STOCK_1_PRICE')) x(run_id, truth)",
    "every": " UNION ALL ".join(f"SELECT '{m}' AS method, run_id, target, node_id, score, rank FROM {r}" for m, r in {"v1": "rank_v1", "v2": "rank_v2", "score": "rank_score", "hops": "rank_hops", "vanilla": "rank_vanilla", "structural": "rank_structural", "hybrid": "hybrid"}.items()),
    "metric0": "SELECT e.method, e.run_id, truth AS true_root_cause, any_value(target) AS target_node, min(rank) FILTER (node_id = truth) AS rank, sum((rank <= 5)::INT) AS five, sum((rank <= 5 AND node_id <> truth)::INT) AS wrong FROM every e JOIN truth USING (run_id) GROUP BY 1, 2, 3",
    "metric": "SELECT method, run_id, run_id AS anomaly_type, true_root_cause, target_node, rank::INT AS rank, coalesce(rank <= 1, false)::INT AS top1, coalesce(rank <= 3, false)::INT AS top3, coalesce(rank <= 5, false)::INT AS top5, coalesce(1 / rank, 0.0) AS reciprocal_rank, wrong / five AS false_rc_rate_k5 FROM metric0",
}


def sql(select: str, *replaced: tuple[str, str]) -> str:
    """A query over the expressions above; ``replaced`` gives some of them another text."""
    texts = {k: v for k, v in CTES.items() if k not in dict(replaced)} | dict(replaced) if len(replaced) > 2 else CTES | dict(replaced)
    return assembled(texts, select)


_MEANS = ", ".join(f"round_even(avg({c}), 4) AS {n}" for n, c in {"top1_acc": "top1", "top3_acc": "top3", "top5_acc": "top5", "mrr": "reciprocal_rank", "false_rc_rate": "false_rc_rate_k5"}.items())


def ablation_sql(base: dict[str, str] | None = None) -> str:
    """The walks with one part left out each, and their figures; ``base`` for the runs of a grid."""
    own: dict[str, str] = {}
    names: dict[str, str] = {}

    def variant(name: str, adaptive: bool = False, weights: bool = True, decay: bool = True, scores: bool = True, inverse: bool = True, ancestors: bool = True) -> None:
        k = f"ab{len(names)}"
        names[name] = f"rank_{k}"
        w = ("greatest(score, 1e-4)" if scores else "1.0") + (" * weight_prior" if weights and not adaptive else "") + (f" * {_DECAY}" if decay else "")
        own.update(_walk(k, w, _E if scores else _E_PLAIN, scores))
        a = _A if scores else "0.5"
        kind = _KIND if weights else "1.0"
        if adaptive and inverse:
            kind = f"greatest({kind} * (1 - 0.5 * {a}), 0.1)"
        base = f"{_G} * coalesce(r, 0.0) + (1 - {_G}) * {a}" if adaptive else f"0.4 * coalesce(r, 0.0) + 0.6 * {a}"
        own[f"rank_{k}"] = _ranked(k, f"({base}) * {_ANC if ancestors else '1.0'} * {_BONUS if decay else '1.0'} * {kind}")

    variant("v1 full")
    variant("v1 without weights", weights=False)
    variant("v1 without decay", decay=False)
    variant("v1 without scores", scores=False)
    variant("v2 full", adaptive=True)
    variant("v2 without adaptive")
    variant("v2 without inverse", adaptive=True, inverse=False)
    variant("v2 without ancestors", adaptive=True, ancestors=False)
    every = " UNION ALL ".join(f"SELECT '{m}' AS method, run_id, target, node_id, score, rank FROM {r}" for m, r in names.items())
    base = CTES if base is None else base
    last = {"every": every, "metric0": base["metric0"], "metric": base["metric"]}
    return assembled({k: v for k, v in base.items() if k not in last} | {k: _keyed(v) if base is not CTES else v for k, v in own.items()} | last, f"SELECT method, {_MEANS}, count(*) AS n_runs FROM metric GROUP BY 1")


def sensitivity_sql(weights: tuple, scales: tuple, places: int, base: dict[str, str] | None = None) -> str:
    """The score ranking's figures with each weight scaled in turn; ``base`` for the runs of a grid."""
    rows = ", ".join("(" + ", ".join([f"'W{k + 1}'", f"{s}::DOUBLE", *(f"{min(1.0, max(0.01, w * s)) if j == k else w}::DOUBLE" for j, w in enumerate(weights))]) + ")" for k in range(len(weights)) for s in scales)
    own = {
        "setting": f"SELECT * FROM (VALUES {rows}) x(weight, scale, {', '.join(f'w{k}' for k in range(1, 9))})",
        "swept": f"SELECT weight, scale, run_id, node_id, node_ord, {_unit('CASE WHEN layer <= 2 THEN greatest(w1 * raw, w2 * sl) WHEN layer = 3 THEN greatest(w3 * raw, w4 * excess, w5 * sl) ELSE greatest(w7 * raw, w8 * excess) END')} AS score FROM fused0 CROSS JOIN setting",
        "swept_rank": "SELECT *, row_number() OVER (PARTITION BY weight, scale, run_id ORDER BY round(score, 12) DESC, node_ord) AS rank FROM swept",
        "swept_run": "SELECT weight, scale, run_id, min(rank) FILTER (node_id = truth) AS rank FROM swept_rank JOIN truth USING (run_id) GROUP BY 1, 2, 3",
        "figure": "SELECT weight, scale, avg(coalesce(rank <= 5, false)::INT) AS top5, avg(coalesce(1 / rank, 0.0)) AS mrr FROM swept_run GROUP BY 1, 2",
    }
    return assembled((CTES if base is None else base) | own, f"SELECT f.weight, round(max(abs(f.top5 - b.top5)), {places}) + 0.0 AS max_delta_top5, round(max(abs(f.mrr - b.mrr)), {places}) + 0.0 AS max_delta_mrr, max(abs(f.top5 - b.top5)) > 0.03 AS sensitive FROM figure f JOIN figure b ON b.weight = f.weight AND b.scale = 1.0 GROUP BY 1")


# -- the grid of runs ----------------------------------------------------------------------------------------------------

def _keyed(text: str) -> str:
    """Edges of a run's own graph."""
    return text.replace("JOIN edge g ON g.u = p.node_id", "JOIN edge g ON g.run_id = p.run_id AND g.u = p.node_id")


def grid_texts(sizes: tuple[str, ...], runs: str, days: int = grid.DAYS, tickers: bool = False) -> dict[str, str]:
    """The expressions above for the runs of a grid: graphs are keyed by run, and instruments are as many as a run has.
    With ``tickers`` the first nations' suppliers are the instruments."""
    sz = ", ".join(f"('{n}', {a}, {b}, {c})" for n, (a, b, c) in ((n, SIZES[n]) for n in sizes))
    most = max(SIZES[n][0] for n in sizes)
    lost = "anomaly_type = 'A4' AND i = member AND "
    own = {
        "days": CTES["days"], "calendar": "SELECT count(*) AS n_days FROM days", "runs": runs,
        "topo": nodes_sql(*sizes), "node": "SELECT r.run_id, n.* FROM topo n JOIN runs r ON r.topology = n.topology",
        "edge": CTES["edge"].replace("SELECT a.topology", "SELECT a.run_id, a.topology").replace("ON a.topology = b.topology", "ON a.run_id = b.run_id"),
        "closure": "SELECT run_id, u, v, min(hops) AS hops FROM (WITH RECURSIVE c AS (SELECT run_id, u, v, 1 AS hops FROM edge UNION SELECT c.run_id, c.u, e.v, c.hops + 1 FROM c JOIN edge e ON e.run_id = c.run_id AND e.u = c.v WHERE c.hops < 10) SELECT * FROM c) GROUP BY 1, 2, 3",
        "sz": f"SELECT * FROM (VALUES {sz}) x(topology, stocks, rates, currencies)",
        "daily": "SELECT topology, l_shipdate::DATE AS dt, (l_suppkey % stocks + 1)::INT AS i, avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS size FROM lineitem CROSS JOIN sz GROUP BY 1, 2, 3",
        "cells": "SELECT g.topology, t, g.i::INT AS i, price, size FROM (SELECT topology, dt, t, unnest(range(1, stocks + 1)) AS i FROM days CROSS JOIN sz) g LEFT JOIN daily y ON y.topology = g.topology AND y.dt = g.dt AND y.i = g.i",
        "rate_cells": "SELECT g.topology, t, g.i::INT AS i, v FROM (SELECT topology, dt, t, unnest(range(0, rates)) AS i FROM days CROSS JOIN sz) g LEFT JOIN (SELECT topology, l_shipdate::DATE AS dt, l_linenumber % rates AS i, avg(l_discount) AS v FROM lineitem CROSS JOIN sz GROUP BY 1, 2, 3) y ON y.topology = g.topology AND y.dt = g.dt AND y.i = g.i",
        "fx_days": "SELECT g.topology, t, g.i::INT AS i, v / level AS v FROM (SELECT topology, dt, t, unnest(range(0, currencies)) AS i FROM days CROSS JOIN sz) g LEFT JOIN (SELECT topology, o_orderdate::DATE AS dt, o_custkey % currencies AS i, avg(o_totalprice) AS v FROM orders CROSS JOIN sz GROUP BY 1, 2, 3) y ON y.topology = g.topology AND y.dt = g.dt AND y.i = g.i LEFT JOIN (SELECT topology, o_custkey % currencies AS i, avg(o_totalprice) AS level FROM orders CROSS JOIN sz GROUP BY 1, 2) l ON l.topology = g.topology AND l.i = g.i",
        "market": f"""SELECT topology, {_PRICE} AS col, t, price AS value FROM cells
 UNION ALL SELECT topology, 'POSITION_' || i || '_SIZE', t, {_both('size', 'PARTITION BY topology, i')} FROM cells
 UNION ALL SELECT topology, (['RATE_SHORT', 'RATE_MID', 'RATE_LONG'])[i + 1], t, {_both('v', 'PARTITION BY topology, i')} FROM rate_cells
 UNION ALL SELECT topology, (['USD_KRW', 'EUR_KRW', 'JPY_KRW', 'GBP_KRW', 'CNY_KRW'])[i + 1], t, {_both('v', 'PARTITION BY topology, i')} FROM fx_days""",
        "stretch": f"SELECT r.*, m.col, m.t - r.shift AS t, m.value FROM runs r JOIN market m ON m.topology = r.topology AND m.t >= r.shift AND m.t < r.shift + {days}",
        "source": f"""SELECT run_id, col, t, CASE WHEN anomaly_type IN ('A1', 'A7') AND col = 'STOCK_' || stock || '_PRICE' AND t >= t_from AND t < t_to THEN value * m
 WHEN anomaly_type = 'A5' AND col = 'STOCK_' || stock || '_PRICE' AND t >= t_from AND t < t_to THEN avg(value) OVER w + 3.8 * m / 8 * stddev_samp(value) OVER w
 WHEN anomaly_type = 'A6' AND col = 'STOCK_' || stock || '_PRICE' AND t >= t_from AND t < t_to THEN value * m * 0.5 WHEN anomaly_type = 'A6' AND col = 'STOCK_' || second || '_PRICE' AND t >= t_from AND t < t_to THEN value * m * 0.3
 WHEN anomaly_type = 'A6' AND col = 'STOCK_' || third || '_PRICE' AND t >= t_from AND t < t_to THEN value * m * 0.175
 WHEN anomaly_type = 'A7' AND col = 'STOCK_' || other || '_PRICE' THEN value + {grid.normal("id * 1048576 + t", 7)} * 0.7 * m * stddev_samp(value) OVER w ELSE value END AS value FROM stretch WINDOW w AS (PARTITION BY run_id, col)""",
        "s0": f"SELECT p.run_id, c.i, p.t, p.value AS raw, q.value AS size, f.value AS fx, r.anomaly_type, r.n_stocks, r.half, r.stock, r.m, r.t_from, r.t_to, r.width, r.member, r.second_sector FROM source p JOIN (SELECT range::INT AS i FROM range(1, {most + 1})) c ON p.col = 'STOCK_' || c.i || '_PRICE' JOIN source q ON q.run_id = p.run_id AND q.t = p.t AND q.col = 'POSITION_' || c.i || '_SIZE' JOIN source f ON f.run_id = p.run_id AND f.t = p.t AND f.col = 'USD_KRW' JOIN runs r ON r.run_id = p.run_id",
        "s1": CTES["s1"], "s2": CTES["s2"], "s3": CTES["s3"],
        "s4": CTES["s4"].replace("WHEN i = fx_stock THEN 8.0 * CASE WHEN t >= n // 3 AND t < n // 3 + 10 THEN", "WHEN anomaly_type = 'A2' AND i = stock THEN m * CASE WHEN t >= t_from AND t < t_to THEN"),
        "s5": "SELECT *, krw * size AS worth, CASE WHEN count(ret) OVER wv >= width THEN stddev_samp(ret) OVER wv END AS vw, " + ", ".join(f"CASE WHEN count(ret) OVER w{k} >= {k} THEN stddev_samp(ret) OVER w{k} END AS v{k}" for k in (20, 60)) + " FROM s4 WINDOW wv AS (PARTITION BY run_id, i ORDER BY t ROWS BETWEEN (width - 1) PRECEDING AND CURRENT ROW), " + ", ".join(f"w{k} AS (PARTITION BY run_id, i ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (20, 60)),
        "inst": CTES["inst"].replace("ret, drop_stock,", "ret, anomaly_type, n_stocks, half, member, second_sector,").replace("WHEN i = vol_stock THEN coalesce(v2, 0.0) * 8.0", "WHEN anomaly_type = 'A3' AND i = stock THEN coalesce(vw, 0.0) * m"),
        "d0": f"SELECT run_id, t, CASE WHEN count(worth) = any_value(n_stocks) THEN sum(worth) END AS total, CASE WHEN count(ret) = any_value(n_stocks) THEN avg(ret) END AS ret, CASE WHEN count(vol20) = any_value(n_stocks) THEN avg(vol20) END AS vol, max(worth) AS top, avg(ret) FILTER (i <= half AND NOT ({lost} NOT second_sector AND half > 1)) AS sector_a, avg(ret) FILTER (i > half AND NOT ({lost} second_sector AND n_stocks - half > 1)) AS sector_b FROM inst GROUP BY 1, 2",
    }
    if tickers:
        own["daily"] = "SELECT topology, l_shipdate::DATE AS dt, n.i::INT AS i, avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS size FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) n ON n.n_nationkey = s_nationkey CROSS JOIN sz WHERE n.i <= stocks GROUP BY 1, 2, 3"
    for k, v in CTES.items():
        if k not in own:
            own[k] = _keyed(v)
    own |= {
        "lev": CTES["lev"].replace("USING (node_id)", "USING (run_id, node_id)"), "apart": CTES["apart"].replace("USING (node_id)", "USING (run_id, node_id)"),
        "excesses": CTES["excesses"].replace("JOIN node n ON n.node_id", "JOIN node n ON n.run_id = r.run_id AND n.node_id").replace("JOIN edge e ON e.v", "JOIN edge e ON e.run_id = r.run_id AND e.v"),
        "fused0": CTES["fused0"].replace("USING (node_id)", "USING (run_id, node_id)").replace("WHERE e.v = s.node_id", "WHERE e.run_id = s.run_id AND e.v = s.node_id"),
        "cover": CTES["cover"].replace("ON c.u = s.node_id JOIN node n ON n.node_id = c.v", "ON c.run_id = s.run_id AND c.u = s.node_id JOIN node n ON n.run_id = s.run_id AND n.node_id = c.v"),
        "placed0": CTES["placed0"].replace("USING (node_id)", "USING (run_id, node_id)").replace("ON c.u = s.node_id AND", "ON c.run_id = s.run_id AND c.u = s.node_id AND"),
        "st_p": "SELECT run_id, u AS frm, v AS dest, 1.0 / count(*) OVER (PARTITION BY run_id, u) AS p FROM edge",
        **{f"st_m{k}": CTES[f"st_m{k}"].replace("ON p.frm", "ON p.run_id = m.run_id AND p.frm") for k in range(1, 8)},
        "run_inputs": "SELECT r.run_id, n.node_id, n.expected_input_count AS want, len(list_filter(n.input_columns, lambda c: NOT (r.anomaly_type = 'A4' AND len(n.input_columns) > 1 AND n.node_id = CASE WHEN r.second_sector THEN 'FEAT_SECTOR_B' ELSE 'FEAT_SECTOR_A' END AND c = 'STOCK_' || r.member || '_PRICE_RETURN'))) AS have FROM node n JOIN runs r ON r.run_id = n.run_id",
        "truth": "SELECT run_id, anomaly_type, topology AS pipeline_size, trial, CASE anomaly_type WHEN 'A2' THEN 'ETL_FX_STOCK_' || stock || '_PRICE' WHEN 'A3' THEN 'FEAT_VOL20_STOCK_' || stock || '_PRICE' WHEN 'A4' THEN CASE WHEN second_sector THEN 'FEAT_SECTOR_B' ELSE 'FEAT_SECTOR_A' END ELSE 'SRC_STOCK_' || stock || '_PRICE' END AS truth FROM runs",
        "metric0": CTES["metric0"].replace("truth AS true_root_cause", "anomaly_type, pipeline_size, trial, truth AS true_root_cause").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2, 3, 4, 5, 6"),
        "metric": CTES["metric"].replace("run_id AS anomaly_type", "anomaly_type, pipeline_size, trial"),
    }
    return own


def assembled(texts: dict[str, str], select: str) -> str:
    """A query over those of ``texts``, each with the ones before it in reach, that it needs."""
    need, todo = set(), [select]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for w in words & set(texts) - need:
            need.add(w)
            todo.append(texts[w])
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({texts[n]})" for n in texts if n in need) + "\n" + select
