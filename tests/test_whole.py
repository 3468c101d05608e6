"""Registered queries use all rows, features and probes that their definitions name."""

from pyspark.sql import functions as F

from tests.compare import differs, duck
from tidemark import registry
from tidemark.operators import library as L
from tidemark.operators import validate as V
from tidemark.operators.context import FeatureContext
from tidemark.operators.sample import every_nth
from tidemark.plans import markout as M
from tidemark.schema import EVENTS
from tidemark.sources.events import market


def test_imbalance_ic_reads_every_quote(spark):
    q = market(spark, "/root/testdata/sf0.1").bbo
    assert every_nth(q, ["sym"], ["timestamp", "row_id"], EVENTS.stride_target).count() == q.count()


def test_tree_r2_scores_every_feature(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(registry.TreeR2, "analyze", lambda self, long: asked.append(self.trees) or long.select("feature").distinct().withColumn("tree_r2", F.lit(0.0)))
    m = market(spark, "/root/testdata/sf0.001")
    assert {r["feature"] for r in registry.MAKERS["tree_r2"](m).collect()} == set(M.names(m)) and asked == [50]


def test_lookahead_differential_probes_every_trade(spark):
    m = market(spark, "/root/testdata/sf0.001")
    n = m.context().n_trades()
    assert n > 128 and {r["n_probe"] for r in registry.MAKERS["lookahead_differential"](m).collect()} == {n}


def test_lookahead_differential_of_many_trades_equals_sql(spark):
    sf = "/root/testdata/sf0.1"
    assert market(spark, sf).context().n_trades() > 5000
    assert differs(spark, duck(sf), registry.queries()["lookahead_differential"], registry.oracle_sql()["lookahead_differential"], sf) == ""


def test_trades_at_one_time_share_a_cut(spark):
    sec = 1_000_000
    trades = spark.createDataFrame([(i, "btc", (10 + i // 3) * sec, "buy", 100.0, 1.0) for i in range(12)], "row_id long, sym string, timestamp long, side string, price double, amount double")
    liq = spark.createDataFrame([(i, "btc", (8 + i) * sec, "sell", 100.0, 1.0) for i in range(8)], trades.schema)
    bbo = spark.createDataFrame([(i, "btc", (5 + 2 * i) * sec, 99.0 + i, 1.0, 101.0 + i, 1.0) for i in range(5)], "row_id long, sym string, timestamp long, bid_price double, bid_amount double, ask_price double, ask_amount double")
    ctx = FeatureContext.from_frames(trades, bbo, liq, liq.where("row_id < 2"), exchange_2_lag_us=0)
    features = [L.LiqNotional(2), L.TimeSinceLiq(), L.BBOSpread()]
    d = V.check_no_lookahead(features, ctx, exhaustive_below=None).collect()
    assert len(d) == 3 and all(r["n_probe"] == 12 and r["ok"] for r in d)
    full = ctx.fresh()
    for f in features:
        f.calculate(full)
    assert ctx.truncated(ctx.queries, full.requests.values()).events.select("probe_id").distinct().count() == 4


def test_feature_ranking_toxic_falls(spark):
    d = registry.queries()["feature_ranking_toxic"](spark, "/root/testdata/sf0.001")
    ic = [abs(r["spearman_ic"]) for r in d.collect()]
    assert d.columns == ["feature", "spearman_ic", "ks"] and len(ic) == 10 and ic == sorted(ic, reverse=True)


def test_ranks_do_not_depend_on_pieces(spark):
    one, many = (market(spark, "/root/testdata/sf0.001", EVENTS.but(rank_buckets=n)) for n in (1, 8))
    rows = lambda d: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in d.collect())
    for f in (M.ic_table, M.imbalance_ic, M.conditional_ic):
        assert rows(f(one)) == rows(f(many))
