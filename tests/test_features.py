"""Known answers of the primitives, contexts, features and validators; batch, bucketed and streamed."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark import DEFAULT_FEATURES, Feature, FeatureContext, FeatureSet
from tidemark.operators import library as L
from tidemark.operators import validate as V
from tidemark.operators.analyze import KSSeparation, SpearmanIC, analyze_features
from tidemark.operators.sample import sample_exact
from tidemark.streaming import stream_features

S = 1_000_000
ORDER = "row_id long, sym string, timestamp long, side string, price double, amount double"
QUOTE = "row_id long, sym string, timestamp long, bid_price double, ask_price double, bid_amount double, ask_amount double"


def orders(spark, rows):
    return spark.createDataFrame([(i, "x", t, side, 100.0, float(a)) for i, (t, side, a) in enumerate(rows)], ORDER)


def quotes(spark, rows):
    return spark.createDataFrame([(i, "x", t, float(b), float(a), float(bs), float(as_)) for i, (t, b, a, bs, as_) in enumerate(rows)], QUOTE)


def fixture_a(spark, extra=(), bucket=None):
    trades = orders(spark, [(9 * S, "buy", 1), (10 * S + 100_000, "sell", 1), (10 * S + 300_000, "buy", 1)])
    bbo = quotes(spark, [*extra, (8 * S, 99, 101, 3, 1), (9 * S, 100, 102, 1, 1), (11 * S, 100, 102, 1, 1)])
    return FeatureContext.from_frames(trades, bbo, orders(spark, [(10 * S, "sell", 10)]), orders(spark, [(10 * S, "buy", 5)]), bucket_us=bucket)


def fixture_c(spark, bucket=None):
    bid = [100, 100, 101, 100, 102, 100, 103, 104]
    bbo = quotes(spark, [(t * S, b, b + 1, 1, 1) for t, b in zip([10, 40, 55, 90, 105, 140, 155, 200], bid, strict=True)])
    trades = orders(spark, [(50 * S, "buy", 1), (100 * S, "sell", 1), (150 * S, "buy", 1)])
    return FeatureContext.from_frames(trades, bbo, orders(spark, [(45 * S, "sell", 10), (95 * S, "buy", 10), (145 * S, "sell", 10)]), orders(spark, [(48 * S, "buy", 5), (98 * S, "sell", 5)]), bucket_us=bucket)


def values(ctx, **cols):
    ctx = ctx.fresh()
    rows = ctx.evaluate({k: f(ctx) for k, f in cols.items()}).orderBy("t", "row_id").collect()
    return {k: [r[k] for r in rows] for k in cols}


@pytest.mark.parametrize("bucket", [None, 7 * S])
def test_context(spark, bucket):
    got = values(
        fixture_a(spark, bucket=bucket),
        both=lambda c: c.window_sum("liq_combined", "notional", 30 * S),
        two=lambda c: c.window_sum("liq_exchange_2", "notional", 30 * S),
        n=lambda c: c.window_count("liq_combined", 30 * S),
        imb=lambda c: c.window_side_imbalance("liq_combined", 30 * S),
        mid=lambda c: c.asof("mid"),
        since=lambda c: c.time_since_last("liq_combined"),
        past=lambda c: c.asof("mid", -5 * S),
        ahead=lambda c: c.asof("mid", 5 * S),
        clip=lambda c: c.asof("mid", -5 * S, "clip"),
    )
    assert got["both"] == [0, 1000, 1500] and got["two"] == [0, 0, 500] and got["n"] == [0, 1, 2]
    assert got["imb"][0] == 0 and got["imb"][2] == pytest.approx(-1 / 3)
    assert got["mid"] == [101, 101, 101] and got["since"][0] >= 1e8 and got["since"][2] == pytest.approx(0.1)
    assert got["past"] == [None] * 3 and got["ahead"] == [None] * 3 and got["clip"] == [100] * 3


def test_boundaries(spark):
    src = orders(spark, [(0, "buy", 1), (5 * S, "buy", 2), (10 * S, "buy", 4)])
    ask = orders(spark, [(q * S, "buy", 1) for q in (3, 6, 10, 11)])
    none = orders(spark, [(0, "buy", 1)]).limit(0)
    ctx = FeatureContext.from_frames(ask, quotes(spark, [(0, 1, 1, 1, 1)]).limit(0), src, none)
    got = values(ctx, w30=lambda c: c.window_sum("liq_exchange_1", "notional", 30 * S), w3=lambda c: c.window_sum("liq_exchange_1", "notional", 3 * S), n=lambda c: c.window_count("liq_exchange_1", 30 * S), mid=lambda c: c.asof("mid"))
    assert got["w30"] == [100, 300, 300, 700] and got["w3"] == [100, 200, 0, 400] and got["n"] == [1, 2, 2, 3] and got["mid"] == [None] * 4


def test_features(spark):
    ctx = fixture_a(spark, extra=[(3 * S, 100, 100, 1, 1)])
    m = FeatureSet([*DEFAULT_FEATURES, L.LiqStrength(30)]).run(ctx).orderBy("timestamp").collect()
    assert [r["liq_velocity"] for r in m][::2] == [0, pytest.approx(1500 / 1501)]
    assert [r["bbo_spread_bps"] for r in m] == [pytest.approx(198.01980198)] * 3 and [r["mid_ret_5s"] for r in m] == [pytest.approx(100)] * 3
    assert m[2]["liq_strength_30s"] == pytest.approx(-math.log1p(500))
    with pytest.raises(ValueError):
        FeatureSet([L.BBOSpread(), L.BBOSpread()])


class Forward(Feature):
    name = "forward"

    def calculate(self, ctx):
        return ctx.asof("mid", 30 * S)


class Inclusive(Feature):
    name, lookback_us = "inclusive", 30 * S

    def calculate(self, ctx):
        return ctx.raw_sum("liq_combined", "notional", -30 * S, 0)


def test_validators(spark):
    ctx = fixture_c(spark)
    assert {r["feature"]: r["ok"] for r in FeatureSet(DEFAULT_FEATURES).validate(ctx).collect()} == {f.name: True for f in DEFAULT_FEATURES}
    look = {r["feature"]: r for r in V.check_no_lookahead([L.LiqNotional(30), Forward()], ctx).collect()}
    assert look["liq_notional_30s"]["ok"] and look["forward"]["n_violations"] == 3
    assert V.check_no_lookahead_tracked([Forward()], ctx).first()["n_violations"] == 3
    one = FeatureContext.from_frames(orders(spark, [(100 * S, "buy", 1)]), quotes(spark, [(1, 1, 2, 1, 1)]), orders(spark, [(100 * S, "buy", 1)]), orders(spark, [(1, "buy", 1)]).limit(0))
    assert not V.check_no_lookahead([Inclusive()], one).first()["ok"]
    short = FeatureSet([L.BBOSpread()]).run(ctx).limit(2)
    bad = V.validate_feature_set([L.BBOSpread()], ctx, matrix=short).first()
    assert not bad["aligned"] and not bad["lookahead_ok"] and not bad["ok"]
    x = spark.createDataFrame([(1.0,), (math.inf,), (math.nan,), (None,)], "f double")
    r = V.check_finite(x, ["f"]).first()
    assert (r["n_nan"], r["n_inf"], r["ok"]) == (2, 1, False)


def test_stream_is_batch_is_bucketed(spark, tmp_path):
    ctx = fixture_c(spark)
    key = lambda d: sorted(map(str, d.select("row_id", "timestamp", *[f.name for f in DEFAULT_FEATURES]).collect()))
    want = key(FeatureSet(DEFAULT_FEATURES).run(ctx))
    assert key(FeatureSet(DEFAULT_FEATURES).run(fixture_c(spark, 20 * S))) == want
    trades = orders(spark, [(50 * S, "buy", 1), (100 * S, "sell", 1), (150 * S, "buy", 1)])
    trades.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(ORDER).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_features(live, ctx, DEFAULT_FEATURES, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want


def test_sample_and_analyzers(spark):
    d = spark.range(1000).withColumnRenamed("id", "row_id")
    a = {r[0] for r in sample_exact(d, 100, 7).collect()}
    assert len(a) == 100 and a == {r[0] for r in sample_exact(d.repartition(7), 100, 7).collect()} and sample_exact(d.limit(3), 100).count() == 3
    m = d.select("row_id", F.col("row_id").cast("double").alias("up"), (-F.col("row_id")).cast("double").alias("down"), (F.col("row_id") * 2.0 + 1).alias("y"))
    got = {r["feature"]: r["spearman_ic"] for r in analyze_features(m, "y", [SpearmanIC()], ["up", "down"]).collect()}
    assert got == {"up": pytest.approx(1), "down": pytest.approx(-1)}
    cut = {r["feature"]: r["spearman_ic"] for r in analyze_features(m, "y", [SpearmanIC(buckets=8)], ["up", "down"]).collect()}
    assert cut == {"up": pytest.approx(1), "down": pytest.approx(-1)}
    assert analyze_features(m.withColumn("c", (F.col("row_id") > 499).cast("double")), "c", [KSSeparation()], ["up"]).first()["ks"] == pytest.approx(1)
