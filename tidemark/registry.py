"""Named queries over the driver's tables, and the same in DuckDB's SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.stats import describe, ordered_unique
from tidemark.operators import library as L
from tidemark.operators import validate as V
from tidemark.operators.analyze import MutualInfo, SpearmanIC, TreeR2, analyze_features, rank_features
from tidemark.operators.feature import Feature
from tidemark.operators.feature_set import FeatureSet
from tidemark.operators.sample import sample_exact
from tidemark.plans import events as E
from tidemark.plans import markout as M
from tidemark.plans import quality as Q
from tidemark.schema import EVENTS, SECOND
from tidemark.sources.events import Market, market
from tidemark.sources.files import from_arrow, sql_scan, to_arrow

P = EVENTS
SHORT, LONG, RET = P.short_us // SECOND, P.long_us // SECOND, P.ret_us // SECOND


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, without a negative zero."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class _AsOf(Feature):
    def __init__(self, name: str, series: str, offset_us: int, mode: str = "null") -> None:
        self.name, self.series, self.offset_us, self.mode = name, series, offset_us, mode

    def calculate(self, ctx):
        return ctx.asof(self.series, self.offset_us, self.mode)


class _Inclusive(Feature):
    """Reads events at t itself, past the tracked accessors: a leak on purpose."""

    name, lookback_us = "inclusive_at_t", P.short_us

    def calculate(self, ctx):
        return ctx.raw_sum("liq_combined", "notional", -P.short_us, 0)


def _features(*features: Feature) -> Callable[[Market], DataFrame]:
    return lambda m: FeatureSet(features).run(m.context()).drop("timestamp")


def _check_finite(m: Market) -> DataFrame:
    return V.check_finite(M.feature_matrix(m), M.names(m))


def _check_alignment(m: Market) -> DataFrame:
    return V.check_alignment(M.feature_matrix(m), m.context().queries)


def _damaged(m: Market) -> DataFrame:
    """The matrix with missing, repeated and foreign rows, and with values that are not finite."""
    d, r = M.feature_matrix(m), F.col("row_id")
    d = d.where(F.pmod(r, F.lit(7)) != 0)
    d = d.unionByName(d.where(F.pmod(r, F.lit(11)) == 0)).unionByName(d.where(F.pmod(r, F.lit(13)) == 0).withColumn("row_id", -1 - r))
    first = M.names(m)[0]
    r = F.col("row_id")
    bad = F.when(F.pmod(r, F.lit(5)) == 0, F.lit(float("inf"))).when(F.pmod(r, F.lit(5)) == 1, F.lit(float("-inf"))).when(F.pmod(r, F.lit(5)) == 2, F.lit(float("nan"))).otherwise(F.col(first))
    return d.withColumn(first, bad)


FORWARD = _AsOf("forward_mid", "mid", P.short_us)


def _tracked(m: Market) -> DataFrame:
    return V.check_no_lookahead_tracked([L.LiqNotional(SHORT), L.BBOSpread(), FORWARD], m.context())


def _differential(m: Market) -> DataFrame:
    return V.check_no_lookahead([L.LiqNotional(SHORT), _Inclusive()], m.context(), exhaustive_below=None)


MAKERS: dict[str, Callable[[Market], DataFrame]] = {
    "causal_window_sum": _features(L.LiqNotional(SHORT), L.LiqNotional(LONG)),
    "causal_window_count": _features(L.LiqEventCount(SHORT)),
    "side_imbalance": _features(L.LiqSideImbalance(SHORT)),
    "liq_strength": _features(L.LiqStrength(SHORT)),
    "liq_velocity": _features(L.LiqVelocity(SHORT, LONG)),
    "venue2_notional_lagged": _features(L.Exchange2LiqNotional(SHORT)),
    "time_since_event": _features(L.TimeSinceLiq()),
    "asof_backward": _features(_AsOf("mid", "mid", 0), _AsOf("spread_bps", "spread_bps", 0), _AsOf("imbalance", "imbalance", 0)),
    "asof_exclude_beyond": _features(_AsOf("mid_ahead", "mid", P.horizons_s[2] * SECOND)),
    "asof_offset_past": _features(_AsOf("mid_past", "mid", -P.ret_us)),
    "mid_return": _features(L.MidReturn(RET)),
    "feature_matrix": M.feature_matrix,
    "markout_baseline": M.markout_baseline,
    "rule_scores": M.rule_scores,
    "clusters": E.found_clusters,
    "cascades": E.found_cascades,
    "cluster_rates": E.cluster_rates,
    "cluster_sizes": E.cluster_sizes,
    "cluster_survival": E.cluster_survival,
    "overlap_shares": E.overlap_shares,
    "event_study_quintile": E.event_study_quintile,
    "event_study_membership": E.event_study_membership,
    "adverse_selection": E.adverse_selection,
    "leadlag_response": E.leadlag_response,
    "liq_quirks": Q.liq_quirks,
    "bbo_quirks": Q.bbo_quirks,
    "gap_histogram": Q.gap_histogram,
    "burst_stats": Q.burst_stats,
    "burst_histogram": Q.burst_histogram,
    "daily_price": Q.daily_price,
    "inventory": Q.inventory,
    "daily_activity": Q.daily_activity,
    "activity_ratio": Q.activity_ratio,
    "hour_share": Q.hour_share,
    "interarrival_stats": Q.interarrival_stats,
    "interarrival_survival": Q.interarrival_survival,
    "funding_clustering": Q.funding_clustering,
    "daily_net_pressure": E.daily_net_pressure,
    "spearman_ic": M.ic_table,
    "spearman_matrix": M.spearman_matrix,
    "ks_separation": M.ks_table,
    "psi": M.psi_table,
    "decile_table": M.decile_table,
    "orderflow_acf": Q.orderflow_acf,
    "return_autocorr": Q.return_autocorr,
    "imbalance_ic": M.imbalance_ic,
    "price_offset": E.price_offset,
    "conditional_ic": M.conditional_ic,
    "conditional_means": M.conditional_means,
    "check_finite": _check_finite,
    "check_alignment": _check_alignment,
    "check_finite_damaged": lambda m: V.check_finite(_damaged(m), M.names(m)),
    "check_alignment_damaged": lambda m: V.check_alignment(_damaged(m), m.context().queries),
    "check_summary": lambda m: V.check_summary(_damaged(m), M.names(m)),
    "describe_features": lambda m: describe(M.feature_matrix(m), M.names(m)),
    "price_offset_overall": E.price_offset_overall,
    "sides_by_first_trade": lambda m: ordered_unique(m.trades, "side", ["timestamp", "row_id"]),
    "feature_sample": lambda m: M.feature_sample(m, 500, 7),
    "lookahead_tracked": _tracked,
    "lookahead_differential": _differential,
    "sample_exact": lambda m: sample_exact(m.trades, 500, 7).select("row_id", "sym", "timestamp", "price", "amount"),
    "feature_ranking": lambda m: analyze_features(M.feature_sample(m), f"pnl_{P.horizons_s[1]}", [SpearmanIC()], M.names(m)),
    "feature_ranking_toxic": lambda m: rank_features(M.feature_sample(m).where(S.finite(f"pnl_{P.horizons_s[1]}")), f"pnl_{P.horizons_s[1]}", M.names(m)),
    "mutual_info": lambda m: analyze_features(M.feature_sample(m), f"pnl_{P.horizons_s[1]}", [MutualInfo()], M.names(m)),
    "tree_r2": lambda m: analyze_features(M.feature_sample(m), f"pnl_{P.horizons_s[1]}", [TreeR2()], M.names(m)),
}


def _sql_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT event_type, count(*) AS n, sum(value) AS value FROM {events} WHERE user_id % 2 = 0 GROUP BY event_type"
    return sql_scan(spark, sql, events=f"{sf_dir}/events.parquet")


def _arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result through an Arrow table and back."""
    return from_arrow(spark, to_arrow(Q.hour_share(market(spark, sf_dir))))


#: Queries that read files themselves.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"sql_scan": _sql_scan, "arrow_round_trip": _arrow}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: (lambda spark, sf_dir, f=f: rounded(f(market(spark, sf_dir)))) for k, f in MAKERS.items()}
    return own | {k: (lambda spark, sf_dir, f=f: rounded(f(spark, sf_dir))) for k, f in READERS.items()}


# ------------------------------------------------------------------ DuckDB

D = 86_400 * SECOND
BASE = f"""ev AS (SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'btc' ELSE 'eth' END AS sym, epoch_us(ts) - epoch_us(ts) % 60000000 AS t, 100.0e0 + value / 10.0e0 AS px FROM events),
trades AS (SELECT event_id AS row_id, sym, t, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, px AS price, CAST(1 + event_id % 9 AS DOUBLE) AS amount FROM ev WHERE event_type IN ('purchase', 'click')),
bbo AS (SELECT event_id AS row_id, sym, t, px - 0.05e0 * (1 + event_id % 4) AS bid_price, px + 0.05e0 * (1 + event_id % 4) AS ask_price, CAST(1 + event_id % 7 AS DOUBLE) AS bid_amount, CAST(1 + event_id % 5 AS DOUBLE) AS ask_amount FROM ev WHERE event_type = 'view'),
liq AS (SELECT CASE WHEN event_type = 'error' THEN 'exchange_1' ELSE 'exchange_2' END AS feed, event_id AS row_id, sym, t, CASE WHEN event_id % 3 = 0 THEN 'buy' ELSE 'sell' END AS side, px AS price, CAST(1 + event_id % 11 AS DOUBLE) AS amount FROM ev WHERE event_type IN ('error', 'signup')),
raw0 AS (SELECT 'liq_' || feed AS stream, row_id, sym, t, side, price, price * amount AS notional, CASE WHEN side = 'buy' THEN price * amount ELSE 0.0e0 END AS buy_n, CASE WHEN side = 'buy' THEN 0.0e0 ELSE price * amount END AS sell_n FROM liq),
e AS (SELECT * REPLACE (CASE WHEN stream = 'liq_exchange_2' THEN t + {P.lag_us} ELSE t END AS t) FROM raw0),
q AS (SELECT sym, t, arg_max((bid_price + ask_price) / 2.0e0, row_id) AS mid, arg_max((ask_price - bid_price) / ((bid_price + ask_price) / 2.0e0) * 1e4, row_id) AS spread_bps, arg_max((bid_amount - ask_amount) / (bid_amount + ask_amount), row_id) AS imbalance FROM bbo GROUP BY sym, t),
lastq AS (SELECT sym, max(t) AS qt FROM q GROUP BY sym),
tr AS (SELECT row_id, sym, t, price, side, CASE WHEN side = 'buy' THEN 1.0e0 ELSE -1.0e0 END AS s, least(price * amount, {P.weight_cap}e0) AS w, CASE WHEN t < {P.split_us} THEN 'train' ELSE 'val' END AS split FROM trades)"""


def _win(name: str, width: int, cond: str = "TRUE", upto: str = "<") -> str:
    return f"""{name} AS (SELECT tr.row_id, count(e.row_id) AS n, coalesce(CAST(sum(CAST(e.notional AS DECIMAL(38, 10))) AS DOUBLE), 0.0e0) AS notional, coalesce(CAST(sum(CAST(e.buy_n AS DECIMAL(38, 10))) AS DOUBLE), 0.0e0) AS buy_n, coalesce(CAST(sum(CAST(e.sell_n AS DECIMAL(38, 10))) AS DOUBLE), 0.0e0) AS sell_n
FROM tr LEFT JOIN e ON e.sym = tr.sym AND e.t >= tr.t - {width} AND e.t {upto} tr.t AND {cond} GROUP BY tr.row_id)"""


def _asof(name: str, rows: str, off: int, key: str = "row_id", beyond: bool | None = None) -> str:
    """mid, spread_bps and imbalance at t + off; NULL past the last quote if beyond (default: off > 0)."""
    keep = f"CASE WHEN r.t + {off} <= lastq.qt THEN q.mid END" if (off > 0 if beyond is None else beyond) else "q.mid"
    return f"{name} AS (SELECT r.{key}, {keep} AS mid, q.spread_bps, q.imbalance FROM {rows} r ASOF LEFT JOIN q ON r.sym = q.sym AND r.t + {off} >= q.t LEFT JOIN lastq ON lastq.sym = r.sym)"


FEATS = [f"liq_notional_{SHORT}s", f"liq_notional_{LONG}s", f"liq_event_count_{SHORT}s", f"liq_side_imbalance_{SHORT}s", f"exchange_2_liq_notional_{SHORT}s", "liq_velocity", "time_since_liq_s", "bbo_spread_bps", "bbo_imbalance", f"mid_ret_{RET}s"]
FEATURE_CTES = ",\n".join([
    _win("ws", P.short_us), _win("wl", P.long_us), _win("w2", P.short_us, "e.stream = 'liq_exchange_2'"),
    "ls AS (SELECT tr.row_id, max(e.t) AS last FROM tr LEFT JOIN e ON e.sym = tr.sym AND e.t < tr.t GROUP BY tr.row_id)",
    _asof("a0", "tr", 0), _asof("ar", "tr", -P.ret_us),
    f"""feat AS (SELECT tr.*, ws.notional AS {FEATS[0]}, wl.notional AS {FEATS[1]}, CAST(ws.n AS DOUBLE) AS {FEATS[2]},
 CASE WHEN ws.n > 0 THEN (ws.buy_n - ws.sell_n) / (ws.buy_n + ws.sell_n) ELSE 0.0e0 END AS {FEATS[3]}, w2.notional AS {FEATS[4]}, ws.notional / (wl.notional + 1.0e0) AS liq_velocity,
 coalesce((tr.t - ls.last) / 1e6, 1e9) AS time_since_liq_s, a0.spread_bps AS bbo_spread_bps, a0.imbalance AS bbo_imbalance, (a0.mid - ar.mid) / ar.mid * 1e4 AS {FEATS[9]}, a0.mid AS mid0
 FROM tr JOIN ws USING (row_id) JOIN wl USING (row_id) JOIN w2 USING (row_id) JOIN ls USING (row_id) JOIN a0 USING (row_id) JOIN ar USING (row_id))""",
])
PNL_CTES = ",\n".join([_asof(f"p{h}", "tr", h * SECOND) for h in P.horizons_s] + [
    "pnl AS (" + " UNION ALL ".join(f"SELECT tr.row_id, {h} AS tau, -tr.s * (p{h}.mid - tr.price) / tr.price * 1e4 + {P.rebate_bps}e0 AS pnl FROM tr JOIN p{h} USING (row_id)" for h in P.horizons_s) + ")"
])
LONG_CTE = "lf AS (" + " UNION ALL ".join(f"SELECT row_id, sym, split, s, w, '{f}' AS feature, {f} AS value FROM feat" for f in FEATS) + ")"
SPLIT = f"CASE WHEN t < {P.split_us} THEN 'train' ELSE 'val' END"


def _q(final: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE, *ctes]) + "\n" + final


def _r(final: str, cols: str) -> str:
    """final with the columns rounded as rounded() does."""
    return "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) + 0.0e0 AS {c}" for c in cols.split()) + f") FROM ({final})"


def _pear(x: str, y: str) -> str:
    return f"CASE WHEN var_pop({x}) * var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


def _spear(src: str, x: str, y: str, groups: str, min_n: int, out: str) -> str:
    """groups, out, n from the rows of src where both are given."""
    rank = lambda c: f"rank() OVER (PARTITION BY {groups} ORDER BY {c}) + (count(*) OVER (PARTITION BY {groups}, {c}) - 1) / 2.0e0"
    return f"SELECT {groups}, CASE WHEN count(*) >= {min_n} THEN {_pear('rx', 'ry')} END AS {out}, count(*) AS n FROM (SELECT {groups}, {rank(x)} AS rx, {rank(y)} AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {groups}"


def _bins(x: str, closed: str) -> str:
    return f"len(list_filter(edges, lambda z: z {closed} {x}))"


CLUSTERS = f"""cl0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sym ORDER BY t, stream, row_id) <= {P.gap_us} THEN 0 ELSE 1 END AS fresh FROM e),
cl1 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY sym ORDER BY t, stream, row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cid FROM cl0),
cl AS (SELECT sym, cid, min(t) AS t0, max(t) AS t1, count(*) AS n, sum(notional) AS notional, count(*) FILTER (WHERE stream = 'liq_exchange_1') AS n_exchange_1, count(*) FILTER (WHERE stream = 'liq_exchange_2') AS n_exchange_2,
 sum(buy_n) AS buy_notional, sum(sell_n) AS sell_notional, (max(t) - min(t)) / 1e6 AS dur_s, count(*) FILTER (WHERE stream = 'liq_exchange_1') > 0 AND count(*) FILTER (WHERE stream = 'liq_exchange_2') > 0 AS multi_ex,
 CASE WHEN sum(buy_n) + sum(sell_n) <> 0 THEN (sum(buy_n) - sum(sell_n)) / (sum(buy_n) + sum(sell_n)) END AS side_imb FROM cl1 GROUP BY sym, cid)"""
CASCADE = f"n >= {P.cascade_n} AND notional >= {P.cascade_notional} AND dur_s <= {P.cascade_s}"
STUDY = (0, *P.study_s)
MOVES = ",\n".join([
    "evk AS (SELECT row_id, sym, t, stream, cid, CASE WHEN side = 'buy' THEN 1.0e0 ELSE -1.0e0 END AS s FROM cl1)",
    *[_asof(f"m{h}", "evk", h * SECOND, beyond=True) for h in STUDY],
    "mv AS (SELECT evk.sym, evk.row_id, cl.notional AS cnotl, CASE WHEN multi_ex THEN 'both' WHEN n_exchange_2 > 0 THEN 'exchange_2_only' ELSE 'exchange_1_only' END AS membership, "
    + ", ".join(f"evk.s * (m{h}.mid - m0.mid) / m0.mid * 1e4 AS signed_{h}s" for h in P.study_s) + " FROM evk JOIN cl ON cl.sym = evk.sym AND cl.cid = evk.cid " + " ".join(f"JOIN m{h} ON m{h}.row_id = evk.row_id" for h in STUDY) + ")",
])
STUDY_COLS = " ".join(["cnotl_med", *[f"signed_{h}s" for h in P.study_s]])
STUDY_AGG = "count(*) AS n, median(cnotl) AS cnotl_med, " + ", ".join(f"avg(signed_{h}s) AS signed_{h}s" for h in P.study_s)
GAPS = "SELECT *, (t - lag(t) OVER (PARTITION BY feed, sym ORDER BY t, row_id)) / 1e6 AS gap_s FROM liq"
SOD = "(t // 1000000) % 86400"
FUND = f"least(abs({SOD}), abs({SOD} - 28800), abs({SOD} - 57600), abs({SOD} - 86400)) < 60"
N0, N1 = P.horizons_s[0], P.horizons_s[1]
LAGS = {k: f"l{str(k).replace('-', 'm')}" for k in sorted({0, *P.lags_us})}


#: n_nan counts NULL and NaN.
FINITE = "SELECT *, n_nan = 0 AND n_inf = 0 AS ok FROM (SELECT feature, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS n_nan, count(*) FILTER (WHERE isinf(value)) AS n_inf FROM {source} GROUP BY feature)"
ALIGNED = """SELECT *, n_missing = 0 AND n_extra = 0 AND n_repeated = 0 AS ok FROM (SELECT CAST(sum(m) AS BIGINT) AS n_rows, CAST(sum(q) AS BIGINT) AS n_queries, count(*) FILTER (WHERE m < q) AS n_missing, count(*) FILTER (WHERE q = 0) AS n_extra, count(*) FILTER (WHERE m > greatest(q, 1)) AS n_repeated
 FROM (SELECT coalesce(m, 0) AS m, coalesce(q, 0) AS q FROM (SELECT sym, row_id, count(*) AS m FROM {matrix} GROUP BY ALL) a FULL JOIN (SELECT sym, row_id, count(*) AS q FROM trades GROUP BY ALL) b ON a.sym = b.sym AND a.row_id = b.row_id))"""
#: dm: the matrix with rows missing, repeated and foreign; dl: its values, of the first feature some not finite.
DAMAGED = f"""d0 AS (SELECT * FROM feat WHERE row_id % 7 <> 0),
dm AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE row_id % 11 = 0 UNION ALL SELECT * REPLACE (-1 - row_id AS row_id) FROM d0 WHERE row_id % 13 = 0),
dl AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, " + (f"CASE (row_id % 5 + 5) % 5 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE ELSE {f} END" if f == FEATS[0] else f) + " AS value FROM dm" for f in FEATS) + ")"


def _rules() -> str:
    liq, imb = FEATS[0], FEATS[3]
    sym = [f"SELECT 'symmetric_notional' AS rule, {x}e0 AS param, row_id, {liq} >= {x} AS filt FROM feat" for x in P.symmetric]
    return " UNION ALL ".join(sym + [f"SELECT 'directional_adverse' AS rule, {x}e0 AS param, row_id, s * {imb} > 0 AND {liq} >= {x} AS filt FROM feat" for x in P.directional])


CONDITIONAL = f"""c0 AS (SELECT *, s * bbo_imbalance AS imb_against, s * {FEATS[3]} AS liq_against, {FEATS[0]} AS liqn FROM feat),
c1 AS (SELECT *, least(greatest(CAST(floor(row_number() OVER (PARTITION BY sym, split ORDER BY imb_against NULLS FIRST, row_id) * 10 / (count(*) OVER (PARTITION BY sym, split) + 1)) AS INT), 0), 9) AS dec,
 quantile_cont(CASE WHEN liqn > 0 THEN liqn END, 0.5) OVER (PARTITION BY sym, split) AS half FROM c0),
cb AS (SELECT c1.sym, c1.split, c1.row_id, imb_against, liq_against, liqn, dec, coalesce(liqn >= half, FALSE) AS active, tau, pnl FROM c1 JOIN pnl USING (row_id))"""
FIVE = [("ic_imb_against", "imb_against", "pnl"), ("ic_liq_against_raw", "liq_against", "pnl"), ("ic_liq_against_resid", "liq_against", "resid"), ("ic_liqn_raw", "liqn", "pnl"), ("ic_liqn_resid", "liqn", "resid")]
BINS = f"""nb AS (SELECT sym, t // {P.acf_bin_us} AS b, sum(CASE WHEN side = 'buy' THEN amount ELSE -amount END) AS net, arg_max(price, (t, row_id)) AS px, CASE WHEN t // {P.acf_bin_us} * {P.acf_bin_us} < {P.split_us} THEN 'train' ELSE 'val' END AS "window" FROM trades GROUP BY ALL)"""
STRIDE = f"""bq AS (SELECT sym, t, row_id, (bid_price + ask_price) / 2.0e0 AS m0, (bid_amount - ask_amount) / (bid_amount + ask_amount) AS imb, (ask_price * bid_amount + bid_price * ask_amount) / (bid_amount + ask_amount) - (bid_price + ask_price) / 2.0e0 AS dev,
 row_number() OVER (PARTITION BY sym ORDER BY t, row_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY sym) // {P.stride_target}) AS step FROM bbo),
bs AS (SELECT * FROM bq WHERE i % step = 0)"""


def oracle_sql() -> dict[str, str]:
    f = lambda cols, rnd: _q(_r(f"SELECT sym, row_id, {cols} FROM feat", rnd), FEATURE_CTES)
    short, long_ = FEATS[0], FEATS[1]
    split_e = SPLIT
    o = {
        "causal_window_sum": f(f"{short}, {long_}", f"{short} {long_}"),
        "causal_window_count": f(FEATS[2], FEATS[2]),
        "side_imbalance": f(FEATS[3], FEATS[3]),
        "liq_strength": _q(_r(f"SELECT sym, row_id, sign(ws.buy_n - ws.sell_n) * ln(1 + abs(ws.buy_n - ws.sell_n)) AS liq_strength_{SHORT}s FROM feat JOIN ws USING (row_id)", f"liq_strength_{SHORT}s"), FEATURE_CTES),
        "liq_velocity": f("liq_velocity", "liq_velocity"),
        "venue2_notional_lagged": f(FEATS[4], FEATS[4]),
        "time_since_event": f("time_since_liq_s", "time_since_liq_s"),
        "asof_backward": _q(_r("SELECT tr.sym, tr.row_id, mid, spread_bps, imbalance FROM tr JOIN a0 USING (row_id)", "mid spread_bps imbalance"), _asof("a0", "tr", 0)),
        "asof_exclude_beyond": _q(_r("SELECT tr.sym, tr.row_id, mid AS mid_ahead FROM tr JOIN a0 USING (row_id)", "mid_ahead"), _asof("a0", "tr", P.horizons_s[2] * SECOND)),
        "asof_offset_past": _q(_r("SELECT tr.sym, tr.row_id, mid AS mid_past FROM tr JOIN a0 USING (row_id)", "mid_past"), _asof("a0", "tr", -P.ret_us)),
        "mid_return": f(FEATS[9], FEATS[9]),
        "feature_matrix": _q(_r(f"SELECT sym, row_id, t AS timestamp, {', '.join(FEATS)} FROM feat", " ".join(FEATS)), FEATURE_CTES),
        "markout_baseline": _q(_r("SELECT sym, split, tau, count(*) AS n, sum(w) AS wsum, sum(pnl * w) / sum(w) AS pnl_all FROM pnl JOIN tr USING (row_id) WHERE pnl IS NOT NULL GROUP BY ALL", "wsum pnl_all"), PNL_CTES),
        "rule_scores": _q(
            _r("SELECT sym, rule, param, tau, split, sum(w * pnl) / sum(w) AS pnl_all, sum(w * pnl) FILTER (WHERE NOT filt) / sum(w) FILTER (WHERE NOT filt) AS pnl_kept, round(100.0e0 * count(*) FILTER (WHERE NOT filt) / count(*), 1) AS kept_pct, "
               "sum(w * pnl) FILTER (WHERE NOT filt) / sum(w) FILTER (WHERE NOT filt) - sum(w * pnl) / sum(w) AS score FROM rules JOIN pnl USING (row_id) JOIN tr USING (row_id) WHERE pnl IS NOT NULL GROUP BY ALL", "param pnl_all pnl_kept kept_pct score"),
            FEATURE_CTES, PNL_CTES, f"rules AS ({_rules()})"),
        "clusters": _q(_r("SELECT * FROM cl", "notional buy_notional sell_notional dur_s side_imb"), CLUSTERS),
        "cascades": _q(_r(f"SELECT * FROM cl WHERE {CASCADE}", "notional buy_notional sell_notional dur_s side_imb"), CLUSTERS),
        "cluster_rates": _q(_r(f"SELECT sym, CASE WHEN t0 < {P.split_us} THEN 'train' ELSE 'val' END AS split, count(*) AS clusters, count(*) FILTER (WHERE {CASCADE}) AS cascades, 100.0e0 * count(*) FILTER (WHERE multi_ex) / count(*) AS multi_ex_pct, max(n) AS size_max, quantile_cont(n, 0.99) AS size_p99, count(*) / CASE WHEN t0 < {P.split_us} THEN {P.train_days}.0e0 ELSE {P.val_days}.0e0 END AS per_day FROM cl GROUP BY ALL", "multi_ex_pct size_p99 per_day").replace("AS per_day FROM cl GROUP BY ALL", "AS per_day FROM cl GROUP BY sym, t0 < " + str(P.split_us)), CLUSTERS).replace(f"CASE WHEN t0 < {P.split_us}", f"CASE WHEN any_value(t0) < {P.split_us}"),
        "cluster_sizes": _q("SELECT sym, n AS size, count(*) AS clusters FROM cl GROUP BY ALL", CLUSTERS),
        "cluster_survival": _q(_r("SELECT sym, notional, 1 - (row_number() OVER (PARTITION BY sym ORDER BY notional) - 1) / CAST(count(*) OVER (PARTITION BY sym) AS DOUBLE) AS p FROM cl", "notional p"), CLUSTERS),
        "overlap_shares": _q(f"SELECT sym, stream AS anchor, {split_e} AS split, count(*) AS events, round(100.0e0 * count(*) FILTER (WHERE near) / count(*), 1) + 0.0e0 AS near_pct FROM (SELECT *, EXISTS (SELECT 1 FROM e o WHERE o.sym = e.sym AND o.stream <> e.stream AND o.t BETWEEN e.t - {P.near_us} AND e.t + {P.near_us}) AS near FROM e) GROUP BY ALL"),
        "event_study_quintile": _q(_r(f"""SELECT sym, 'Q' || CAST({_bins('cnotl', '<')} + 1 AS VARCHAR) AS "group", {STUDY_AGG}, 'cluster_notional_quintile' AS cut FROM mv JOIN qe USING (sym) GROUP BY ALL""", STUDY_COLS), CLUSTERS, MOVES, "qe AS (SELECT sym, quantile_cont(cnotl, [0.2, 0.4, 0.6, 0.8]) AS edges FROM mv GROUP BY sym)"),
        "event_study_membership": _q(_r(f"""SELECT sym, membership AS "group", {STUDY_AGG}, 'exchange_membership' AS cut FROM mv GROUP BY ALL""", STUDY_COLS), CLUSTERS, MOVES),
        "adverse_selection": _q(
            _r(f"SELECT sym, stream, any_value(total / (b1 - b0 + 1) * {P.post_bins}) AS baseline, avg(post) AS post_mean, median(post) AS post_median, avg(post) / any_value(total / (b1 - b0 + 1) * {P.post_bins}) AS mult_mean, median(post) / any_value(total / (b1 - b0 + 1) * {P.post_bins}) AS mult_median FROM ap GROUP BY ALL", "baseline post_mean post_median mult_mean mult_median"),
            f"tb AS (SELECT sym, t // {P.bin_us} AS b, sum(price * amount) AS notl FROM trades GROUP BY ALL), tot AS (SELECT sym, min(b) AS b0, max(b) AS b1, sum(notl) AS total FROM tb GROUP BY sym)",
            f"ap AS (SELECT x.sym, x.stream, x.row_id, b0, b1, total, coalesce(sum(tb.notl), 0.0e0) AS post FROM (SELECT raw0.*, b0, b1, total, t // {P.bin_us} AS b FROM raw0 JOIN tot USING (sym)) x LEFT JOIN tb ON tb.sym = x.sym AND tb.b >= x.b AND tb.b < x.b + {P.post_bins} WHERE x.b >= b0 AND x.b - b0 + {P.post_bins} < b1 - b0 + 12 GROUP BY ALL)"),
        "leadlag_response": _q(
            _r("""SELECT sym, venue, bucket, lag_s, avg(r) AS response_bps, count(*) AS n FROM (SELECT *, 'all' AS bucket FROM ll UNION ALL SELECT *, 'top_decile' AS bucket FROM ll WHERE notional >= top) GROUP BY ALL""", "lag_s response_bps"),
            *[_asof(n, "raw0", k, beyond=True) for k, n in LAGS.items()],
            "ll AS (" + " UNION ALL ".join(f"SELECT raw0.sym, raw0.stream AS venue, raw0.notional, quantile_cont(raw0.notional, 0.9) OVER (PARTITION BY raw0.sym, raw0.stream) AS top, {k / 1e6!r}e0 AS lag_s, CASE WHEN side = 'buy' THEN 1.0e0 ELSE -1.0e0 END * ({LAGS[k]}.mid - l0x.mid) / l0x.mid * 1e4 AS r FROM raw0 JOIN {LAGS[k]} USING (row_id) JOIN l0 l0x USING (row_id)" for k in P.lags_us) + ")"),
        "liq_quirks": _q(
            _r(f"SELECT feed, sym, count(*) AS rows, 100.0e0 * count(*) FILTER (WHERE t % 1000 = 0) / count(*) AS pct_ms_granular, 100.0e0 * count(*) FILTER (WHERE dt > 1) / count(*) AS dup_ts_pct, count(*) FILTER (WHERE dr > 1) AS exact_dup_rows, min(gap_s) AS min_gap_s, quantile_cont(gap_s, 0.01) AS p1_gap_s, median(gap_s) AS median_gap_s, 100.0e0 * count(*) FILTER (WHERE side = 'sell') / count(*) AS sell_pct, 100.0e0 * count(*) FILTER (WHERE {FUND}) / count(*) AS funding_within60_pct, 100.0e0 * count(*) FILTER (WHERE (t // {D} + 4) % 7 IN (0, 6)) / count(*) AS weekend_pct FROM (SELECT *, count(*) OVER (PARTITION BY feed, sym, t) AS dt, count(*) OVER (PARTITION BY feed, sym, t, side, price, amount) AS dr FROM ({GAPS})) GROUP BY ALL", "pct_ms_granular dup_ts_pct min_gap_s p1_gap_s median_gap_s sell_pct funding_within60_pct weekend_pct")),
        "bbo_quirks": _q(_r("SELECT sym, count(*) AS rows, count(*) FILTER (WHERE bid_price > ask_price) AS crossed, count(*) FILTER (WHERE bid_price = ask_price) AS locked, count(*) FILTER (WHERE bid_amount <= 0 OR ask_amount <= 0) AS zero_size, min(ask_price - bid_price) AS tick, 100.0e0 * count(*) FILTER (WHERE t % 1000 = 0) / count(*) AS pct_ms_granular, max(gap_s) AS max_gap_s, count(*) FILTER (WHERE gap_s >= 10) AS n_gaps_ge_10s, 100.0e0 * count(DISTINCT t) / count(*) AS distinct_ts_pct FROM (SELECT *, (t - lag(t) OVER (PARTITION BY sym ORDER BY t, row_id)) / 1e6 AS gap_s FROM bbo) GROUP BY sym", "tick pct_ms_granular max_gap_s distinct_ts_pct")),
        "gap_histogram": _q("SELECT sym, CASE WHEN ms < 1 THEN '0 <1ms' WHEN ms < 10 THEN '1 1-10ms' WHEN ms < 100 THEN '2 10-100ms' WHEN ms < 1000 THEN '3 0.1-1s' WHEN ms < 10000 THEN '4 1-10s' ELSE '5 >10s' END AS bucket, count(*) AS c FROM (SELECT sym, (t - lag(t) OVER (PARTITION BY sym ORDER BY t, row_id)) / 1e3 AS ms FROM bbo) WHERE ms IS NOT NULL GROUP BY ALL"),
        "burst_stats": _q(_r(f"SELECT a.*, max_gap_s, n_gaps_gt_10s, n_gaps_gt_5s, 100.0e0 * distinct_ts / rows AS distinct_ts_pct FROM (SELECT sym, CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_ts, max(c) AS max_fills, count(*) FILTER (WHERE c >= {P.burst}) AS ts_in_burst FROM fl GROUP BY sym) a JOIN (SELECT sym, max(s) AS max_gap_s, count(*) FILTER (WHERE s > 10) AS n_gaps_gt_10s, count(*) FILTER (WHERE s > 5) AS n_gaps_gt_5s FROM (SELECT sym, (t - lag(t) OVER (PARTITION BY sym ORDER BY t, row_id)) / 1e6 AS s FROM trades) GROUP BY sym) USING (sym)", "max_gap_s distinct_ts_pct"), "fl AS (SELECT sym, t, count(*) AS c FROM trades GROUP BY ALL)"),
        "burst_histogram": _q("SELECT sym, least(c, 60) AS fills, count(*) AS n FROM fl GROUP BY ALL", "fl AS (SELECT sym, t, count(*) AS c FROM trades GROUP BY ALL)"),
        "daily_price": _q(_r(f"SELECT sym, t // {D} AS day_idx, arg_max(price, (t, row_id)) AS last_price, min(price) AS lo, max(price) AS hi, sum(price * amount) AS notional, count(*) AS n FROM trades GROUP BY ALL", "last_price lo hi notional")),
        "inventory": _q(_r(f"SELECT feed, sym, count(*) AS rows, min(t) AS t_min, max(t) AS t_max, count(*) FILTER (WHERE t < prev) = 0 AS monotonic, round(100.0e0 * count(*) FILTER (WHERE dt > 1) / count(*), 2) AS dup_ts_pct, CAST(count(*) * 4 - count(t) - count(side) - count(price) - count(amount) AS BIGINT) AS nulls, count(*) FILTER (WHERE price <= 0) + count(*) FILTER (WHERE amount <= 0) AS nonpos, round(100.0e0 * count(*) FILTER (WHERE side = 'buy') / count(*), 1) AS buy_pct, median(price * amount) AS notl_med, quantile_cont(price * amount, 0.99) AS notl_p99, sum(price * amount) AS notl_sum, count(*) FILTER (WHERE t < {P.split_us}) AS train, count(*) FILTER (WHERE t >= {P.split_us}) AS val FROM (SELECT *, lag(t) OVER (PARTITION BY feed, sym ORDER BY row_id) AS prev, count(*) OVER (PARTITION BY feed, sym, t) AS dt FROM liq) GROUP BY ALL", "dup_ts_pct buy_pct notl_med notl_p99 notl_sum")),
        "daily_activity": _q(_r(f"SELECT feed, sym, t // {D} AS day_idx, count(*) AS events, sum(price * amount) AS notional FROM liq GROUP BY ALL", "notional")),
        "activity_ratio": _q(_r(f"SELECT feed, sym, (count(*) FILTER (WHERE t >= {P.split_us}) / {P.val_days}.0e0) / (count(*) FILTER (WHERE t < {P.split_us}) / {P.train_days}.0e0) AS events_ratio, (sum(price * amount) FILTER (WHERE t >= {P.split_us}) / {P.val_days}.0e0) / (sum(price * amount) FILTER (WHERE t < {P.split_us}) / {P.train_days}.0e0) AS notional_ratio FROM liq GROUP BY ALL", "events_ratio notional_ratio")),
        "hour_share": _q(_r(f"SELECT *, n / CAST(sum(n) OVER (PARTITION BY feed, sym) AS DOUBLE) AS share FROM (SELECT feed, sym, CAST({SOD} // 3600 AS INT) AS hour, count(*) AS n FROM liq GROUP BY ALL)", "share")),
        "interarrival_stats": _q(_r(f"SELECT feed, sym, avg(gap_s) AS mean_s, median(gap_s) AS median_s, stddev_pop(gap_s) / avg(gap_s) AS cv, 100.0e0 * count(*) FILTER (WHERE gap_s < {P.gap_us / 1e6}) / count(*) AS below_gap_pct FROM ({GAPS}) WHERE gap_s IS NOT NULL GROUP BY ALL", "mean_s median_s cv below_gap_pct")),
        "interarrival_survival": _q(_r(f"SELECT feed, sym, gap_s, 1 - (row_number() OVER (PARTITION BY feed, sym ORDER BY gap_s) - 1) / CAST(count(*) OVER (PARTITION BY feed, sym) AS DOUBLE) AS p FROM ({GAPS}) WHERE gap_s > 0", "gap_s p")),
        "funding_clustering": _q(_r(f"SELECT feed, sym, count(*) FILTER (WHERE {FUND}) / CAST(count(*) AS DOUBLE) AS share, count(*) FILTER (WHERE {FUND}) / CAST(count(*) AS DOUBLE) / (3 * 120 / 86400.0e0) AS lift FROM liq GROUP BY ALL", "share lift")),
        "daily_net_pressure": _q(_r(f"SELECT sym, t // {D} AS day_idx, sum(buy_n - sell_n) AS net FROM e GROUP BY ALL", "net")),
        "spearman_ic": _q(_r(_spear("(SELECT lf.*, tau, pnl FROM lf JOIN pnl USING (row_id))", "value", "pnl", "sym, feature, split, tau", 100, "ic"), "ic"), FEATURE_CTES, PNL_CTES, LONG_CTE),
        "spearman_matrix": _q(_r(f"SELECT sym, a, b, CASE WHEN a = b THEN 1.0e0 ELSE rho END AS rho FROM ({_spear('pp', 'x', 'y', 'sym, a, b', 100, 'rho')})", "rho"), FEATURE_CTES, LONG_CTE, "pp AS (SELECT l1.sym, l1.feature AS a, l2.feature AS b, l1.value AS x, l2.value AS y FROM lf l1 JOIN lf l2 ON l1.row_id = l2.row_id)"),
        "ks_separation": _q(_r("SELECT sym, feature, max(abs(ca / na - cb / nb)) AS ks FROM (SELECT sym, feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM kv WINDOW w AS (PARTITION BY sym, feature ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY sym, feature)) GROUP BY ALL", "ks"), FEATURE_CTES, PNL_CTES, LONG_CTE, f"kv AS (SELECT sym, feature, value, CAST(count(*) FILTER (WHERE pnl < 0) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE NOT pnl < 0) AS DOUBLE) AS b FROM lf JOIN pnl USING (row_id) WHERE tau = {N1} AND pnl IS NOT NULL AND value IS NOT NULL GROUP BY ALL)"),
        "psi": _q(
            _r("SELECT sym, feature, CASE WHEN any_value(nt) >= 100 AND any_value(nv) >= 100 THEN sum((v / nv + 1e-6 - (tt / nt + 1e-6)) * ln((v / nv + 1e-6) / (tt / nt + 1e-6))) END AS psi FROM (SELECT g.sym, g.feature, nt, nv, bin, coalesce(sum(CASE WHEN split = 'train' THEN 1.0e0 ELSE 0.0e0 END), 0.0e0) AS tt, coalesce(sum(CASE WHEN split = 'val' THEN 1.0e0 ELSE 0.0e0 END), 0.0e0) AS v FROM g LEFT JOIN pb ON pb.sym = g.sym AND pb.feature = g.feature AND pb.pbin = g.bin GROUP BY ALL) GROUP BY ALL", "psi"),
            FEATURE_CTES, LONG_CTE,
            "pe AS (SELECT sym, feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM lf WHERE split = 'train' AND value IS NOT NULL GROUP BY ALL)",
            f"pb AS (SELECT lf.sym, lf.feature, split, {_bins('value', '<=')} AS pbin FROM lf JOIN pe ON pe.sym = lf.sym AND pe.feature = lf.feature WHERE value IS NOT NULL)",
            "g AS (SELECT * FROM (SELECT sym, feature, CAST(count(*) FILTER (WHERE split = 'train') AS DOUBLE) AS nt, CAST(count(*) FILTER (WHERE split = 'val') AS DOUBLE) AS nv FROM pb GROUP BY ALL), (SELECT unnest(range(10)) AS bin))"),
        "decile_table": _q(_r(f"SELECT x.sym, x.feature, CASE WHEN value IS NOT NULL THEN CAST({_bins('value', '<')} AS INT) END AS dec, avg(pnl) AS pnl, median(value) AS fmed, count(*) AS n FROM x JOIN de ON de.sym = x.sym AND de.feature = x.feature GROUP BY ALL", "pnl fmed").replace("AS n FROM x", "AS n FROM x"), FEATURE_CTES, PNL_CTES, LONG_CTE, f"x AS (SELECT lf.*, pnl FROM lf JOIN pnl USING (row_id) WHERE tau = {N1} AND split = 'val')", "de AS (SELECT sym, feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM x WHERE value IS NOT NULL GROUP BY ALL)"),
        "orderflow_acf": _q(_r('SELECT sym, "window", lag, p / ss AS acf FROM (' + " UNION ALL ".join(f'SELECT sym, "window", {k} AS lag, sum(c * ck{k}) AS p, sum(c * c) AS ss FROM (SELECT *, lag(c, {k}) OVER (PARTITION BY sym, "window" ORDER BY b) AS ck{k} FROM sc) GROUP BY ALL' for k in P.acf_lags) + ")", "acf"), BINS, 'sc AS (SELECT *, sign(net) - avg(sign(net)) OVER (PARTITION BY sym, "window") AS c FROM nb WHERE sign(net) <> 0)'),
        "return_autocorr": _q(_r(f'SELECT sym, "window", {_pear("r1", "r")} AS lag1_autocorr FROM (SELECT *, lag(r) OVER (PARTITION BY sym, "window" ORDER BY b) AS r1 FROM rr WHERE r <> 0) WHERE r1 IS NOT NULL GROUP BY ALL', "lag1_autocorr"), BINS, 'rr AS (SELECT *, ln(px) - ln(lag(px) OVER (PARTITION BY sym, "window" ORDER BY b)) AS r FROM nb)'),
        "imbalance_ic": _q(
            _r(f"SELECT a.sym, a.horizon_s, ic_imbalance, ic_microprice FROM ({_spear('fw', 'imb', 'fwd', 'sym, horizon_s', 2, 'ic_imbalance')}) a JOIN ({_spear('fw', 'dev', 'fwd', 'sym, horizon_s', 2, 'ic_microprice')}) b ON a.sym = b.sym AND a.horizon_s = b.horizon_s", "ic_imbalance ic_microprice"),
            STRIDE, *[_asof(f"f{h}", "bs", h * SECOND) for h in P.imbalance_s],
            "fw AS (" + " UNION ALL ".join(f"SELECT sym, imb, dev, {h} AS horizon_s, (f{h}.mid - m0) / m0 * 1e4 AS fwd FROM bs JOIN f{h} USING (row_id)" for h in P.imbalance_s) + ")"),
        "price_offset": _q(
            _r("SELECT sym, side, count(*) AS n, median(o) AS median_bps, median(abs(o)) AS median_abs_bps, avg(o) AS mean_bps FROM (SELECT l.sym, side, (price - coalesce(a0.mid, fq.mid)) / coalesce(a0.mid, fq.mid) * 1e4 AS o FROM l1 l JOIN a0 USING (row_id) JOIN fq ON fq.sym = l.sym) GROUP BY ALL", "median_bps median_abs_bps mean_bps"),
            "l1 AS (SELECT * FROM liq WHERE feed = 'exchange_1')", _asof("a0", "l1", 0), "fq AS (SELECT sym, arg_min(mid, t) AS mid FROM q GROUP BY sym)"),
        "conditional_ic": _q(
            _r("SELECT i0.sym, i0.split, i0.tau, " + ", ".join(n for n, _, _ in FIVE) + " FROM " + " ".join(f"{'JOIN' if i else ''} ({_spear('rs', x, y, 'sym, split, tau', 2, n)}) i{i}" + (f" ON i{i}.sym = i0.sym AND i{i}.split = i0.split AND i{i}.tau = i0.tau" if i else "") for i, (n, x, y) in enumerate(FIVE)), " ".join(n for n, _, _ in FIVE)),
            FEATURE_CTES, PNL_CTES, CONDITIONAL, "rs AS (SELECT *, pnl - avg(pnl) OVER (PARTITION BY sym, split, tau, dec) AS resid FROM cb WHERE pnl IS NOT NULL)"),
        "conditional_means": _q(
            _r("SELECT *, against - with_push AS spread FROM (SELECT sym, split, tau, avg(pnl) AS baseline, avg(pnl) FILTER (WHERE active AND liq_against > 0.2) AS against, avg(pnl) FILTER (WHERE active AND liq_against < -0.2) AS with_push, count(*) FILTER (WHERE active AND liq_against > 0.2) AS n_against, count(*) FILTER (WHERE active AND liq_against < -0.2) AS n_with FROM cb GROUP BY ALL)", "baseline against with_push spread"),
            FEATURE_CTES, PNL_CTES, CONDITIONAL),
        "check_finite": _q(FINITE.format(source="lf"), FEATURE_CTES, LONG_CTE),
        "check_finite_damaged": _q(FINITE.format(source="dl"), FEATURE_CTES, DAMAGED),
        "check_summary": _q(_r(f"SELECT a.*, n, min, max, 100.0e0 * n_nan / n AS nan_pct FROM ({FINITE.format(source='dl').replace('n_nan = 0 AND n_inf = 0', 'n_inf = 0')}) a JOIN (SELECT feature, count(*) AS n, min(value) FILTER (WHERE isfinite(value)) AS min, max(value) FILTER (WHERE isfinite(value)) AS max FROM dl GROUP BY feature) USING (feature)", "min max nan_pct"), FEATURE_CTES, DAMAGED),
        "check_alignment": _q(ALIGNED.format(matrix="feat"), FEATURE_CTES),
        "check_alignment_damaged": _q(ALIGNED.format(matrix="dm"), FEATURE_CTES, DAMAGED),
        "describe_features": _q(_r("SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM lf GROUP BY feature", "mean std min max"), FEATURE_CTES, LONG_CTE),
        "price_offset_overall": _q(
            _r("SELECT sym, count(*) AS n, median(abs(o)) AS median_abs_bps FROM (SELECT l.sym, (price - coalesce(a0.mid, fq.mid)) / coalesce(a0.mid, fq.mid) * 1e4 AS o FROM l1 l JOIN a0 USING (row_id) JOIN fq ON fq.sym = l.sym) GROUP BY ALL", "median_abs_bps"),
            "l1 AS (SELECT * FROM liq WHERE feed = 'exchange_1')", _asof("a0", "l1", 0), "fq AS (SELECT sym, arg_min(mid, t) AS mid FROM q GROUP BY sym)"),
        "sides_by_first_trade": _q("SELECT CAST(row_number() OVER (ORDER BY t, row_id) - 1 AS INT) AS place, side FROM (SELECT side, t, row_id FROM trades QUALIFY row_number() OVER (PARTITION BY side ORDER BY t, row_id) = 1)"),
        "sql_scan": _r("SELECT event_type, count(*) AS n, sum(value) AS value FROM events WHERE user_id % 2 = 0 GROUP BY event_type", "value"),
        "arrow_round_trip": _q(_r(f"SELECT *, n / CAST(sum(n) OVER (PARTITION BY feed, sym) AS DOUBLE) AS share FROM (SELECT feed, sym, CAST({SOD} // 3600 AS INT) AS hour, count(*) AS n FROM liq GROUP BY ALL)", "share")),
        "lookahead_tracked": _q(f"""SELECT feature, count(*) FILTER (WHERE src > t) AS n_violations, count(*) FILTER (WHERE src > t) = 0 AS ok FROM (
SELECT 'forward_mid' AS feature, tr.t, q.t AS src FROM tr ASOF LEFT JOIN q ON tr.sym = q.sym AND tr.t + {P.short_us} >= q.t
UNION ALL SELECT 'bbo_spread_bps', tr.t, q.t FROM tr ASOF LEFT JOIN q ON tr.sym = q.sym AND tr.t >= q.t
UNION ALL SELECT 'liq_notional_{SHORT}s', tr.t, max(e.t) FROM tr LEFT JOIN e ON e.sym = tr.sym AND e.t >= tr.t - {P.short_us} AND e.t < tr.t GROUP BY tr.row_id, tr.t) GROUP BY feature"""),
        "lookahead_differential": _q(_r("SELECT feature, count(*) AS n_probe, count(*) FILTER (WHERE abs(a - b) > 1e-9) AS n_violations, coalesce(max(abs(a - b)) FILTER (WHERE abs(a - b) > 1e-9), 0.0e0) AS max_abs_diff, count(*) FILTER (WHERE abs(a - b) > 1e-9) = 0 AS ok FROM ("
            f"SELECT 'inclusive_at_t' AS feature, wi.notional AS a, wc.notional AS b FROM wi JOIN wc USING (row_id) UNION ALL SELECT 'liq_notional_{SHORT}s', ws.notional, wc.notional FROM ws JOIN wc USING (row_id)) GROUP BY feature", "max_abs_diff"),
            _win("ws", P.short_us), _win("wi", P.short_us, upto="<="), _win("wc", P.short_us, "e.t < tr.t", upto="<=")),
        "feature_ranking": _q(_r(f"SELECT feature, ic AS spearman_ic FROM ({_spear(f'(SELECT lf.*, pnl FROM lf JOIN pnl USING (row_id) WHERE tau = {N1})', 'value', 'pnl', 'feature', 10, 'ic')})", "spearman_ic"), FEATURE_CTES, PNL_CTES, LONG_CTE),
        "feature_ranking_toxic": _q(
            _r(f"SELECT feature, spearman_ic, ks FROM (SELECT feature, ic AS spearman_ic FROM ({_spear('rk', 'value', 'pnl', 'feature', 10, 'ic')})) JOIN (SELECT feature, max(abs(ca / na - cb / nb)) AS ks FROM (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM kr WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature)) GROUP BY ALL) USING (feature)", "spearman_ic ks"),
            FEATURE_CTES, PNL_CTES, LONG_CTE, f"rk AS (SELECT feature, value, pnl FROM lf JOIN pnl USING (row_id) WHERE tau = {N1} AND pnl IS NOT NULL)",
            "kr AS (SELECT feature, value, CAST(count(*) FILTER (WHERE pnl < 0) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE NOT pnl < 0) AS DOUBLE) AS b FROM rk WHERE value IS NOT NULL GROUP BY ALL)"),
    }
    return o
