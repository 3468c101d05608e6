"""Sources, sinks, artifacts, the command line, samples and streams."""

import datetime as dt
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_features import ORDER, QUOTE, S, fixture_c
from tidemark import DEFAULT_FEATURES, FeatureSet
from tidemark.functions import scalar
from tidemark.functions.stats import describe, ordered_unique
from tidemark.operators import library as L
from tidemark.operators import sessions
from tidemark.operators import validate as V
from tidemark.plans import cli
from tidemark.plans import events as E
from tidemark.plans import markout as M
from tidemark.sources import files
from tidemark.sources.events import market
from tidemark.streaming import event_time, stream_clusters, stream_window_sum

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("feed"))
    ds = files.Dataset(root)
    for name in ("trades", "liq1", "liq2"):
        rows = [(t * S, "btcusdt", "buy" if t % 2 else "sell", 100.0 + t, 1.0) for t in range(40)]
        spark.createDataFrame(rows, files.SCHEMAS[name]).coalesce(1).write.parquet(ds.path(name, "btc"))
    spark.createDataFrame([(t * S, "btcusdt", 99.0, 1.0, 101.0, 2.0) for t in range(5, 40)], files.SCHEMAS["bbo"]).repartition(3).write.parquet(ds.path("bbo", "btc"))
    return ds


def test_layout_and_frames(spark, feed):
    assert feed.path("trades", "btc").endswith("/exchange_1_trades/perp_btcusdt.parquet") and feed.path("liq2", "eth").endswith("/exchange_2_liquidations/ethusdt.parquet")
    trades, bbo, l1, l2 = files.load_frames(spark, feed.root, "btc")
    assert [d.count() for d in (trades, bbo, l1, l2)] == [40, 35, 40, 40] and {"sym", "row_id"} <= set(trades.columns)
    assert files.load_frames(spark, feed.root, "btc", trades_sample=7)[0].count() == 7
    assert files.empty(spark, "bbo").count() == 0 and set(files.empty(spark, "bbo").columns) == set(bbo.columns)


def test_row_ids_do_not_depend_on_the_plan(spark, feed):
    d = feed.scan(spark, "bbo", "btc")
    key = lambda x: {(r["row_id"], r["timestamp"]) for r in x.collect()}
    assert len({i for i, _ in key(d)}) == 35 and key(d.where("timestamp > 20000000")) < key(d) and key(feed.scan(spark, "bbo", "btc", start_us=20 * S)) < key(d)


def test_time_range_and_columns_reach_the_scan(spark, feed):
    d = feed.scan(spark, "trades", "btc", columns=["timestamp", "price"], start_us=10 * S, end_us=12 * S)
    assert sorted(r["timestamp"] for r in d.collect()) == [10 * S, 11 * S] and d.columns == ["timestamp", "price", "sym", "row_id"]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp,10000000)" in plan and "amount" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_warm_up_and_duplicates(spark, feed):
    trades, bbo, *_ = files.load_frames(spark, feed.root, "btc")
    assert files.after_warm_up(trades, bbo).agg(F.min("timestamp")).first()[0] == 10 * S
    assert files.drop_exact_duplicates(trades.unionByName(trades)).count() == 40


def test_sinks_and_artifacts(spark, feed, tmp_path):
    store, calls = files.ArtifactStore(spark, str(tmp_path)), []

    def made():
        calls.append(1)
        return spark.range(len(calls) * 3)

    assert not store.exists("a") and store.get_or_compute("a", made).count() == 3 and store.exists("a")
    assert store.get_or_compute("a", made).count() == 3 and store.get_or_compute("a", made, refresh=True).count() == 6 and len(calls) == 2
    d = spark.createDataFrame([("x", 1, 2.5)], "k string, n long, v double")
    assert files.read_json(spark, files.write_json(d, f"{tmp_path}/j"), "k string, n long, v double").collect() == d.collect()
    assert json.loads(files.report(d, "k")) == {"x": {"n": 1, "v": 2.5}}
    out = FeatureSet([L.BBOSpread()]).run_to(fixture_c(spark), f"{tmp_path}/m")
    assert spark.read.parquet(out).count() == 3


def test_sql_and_arrow(spark, feed):
    d = files.sql_scan(spark, "SELECT max(timestamp) AS t FROM {trades} WHERE side = 'buy'", trades=feed.path("trades", "btc"))
    assert d.first()["t"] == 39 * S
    t = files.to_arrow(spark.range(5))
    assert isinstance(t, pa.Table) and files.from_arrow(spark, t).count() == 5
    with pytest.raises(ValueError):
        files.to_arrow(spark.range(5), most=4)


def test_command_line(spark, tmp_path):
    done = cli.run(spark, SF, str(tmp_path), "markout")
    assert [p.rsplit("/", 1)[1] for p in done] == ["markout_baseline.parquet"] and spark.read.parquet(done[0]).count() > 0
    done = cli.run(spark, SF, str(tmp_path), "conditional")
    assert len(done) == 2 and files.ArtifactStore(spark, str(tmp_path)).exists("feature_sample")
    assert spark.read.parquet(done[1]).count() == M.conditional_means(market(spark, SF)).count()


def test_feature_sample_is_part_of_the_whole(spark):
    m = market(spark, SF)
    some, whole = M.feature_sample(m, 50, 7), M.feature_sample(m)
    assert some.count() == 50 and some.exceptAll(whole).count() == 0


def test_summaries(spark):
    d = spark.createDataFrame([(1.0, 0), (3.0, 1), (None, 2), (float("inf"), 3), (float("nan"), 4)], "f double, row_id long")
    r = V.check_summary(d, ["f"]).first()
    assert (r["n"], r["n_nan"], r["n_inf"], r["min"], r["max"], r["nan_pct"], r["ok"]) == (5, 2, 1, 1.0, 3.0, 40.0, False)
    assert V.check_summary(d.where("row_id < 3"), ["f"]).first()["ok"]
    s = describe(d, ["f"]).first()
    assert (s["n"], s["mean"], s["min"], s["max"]) == (2, 2.0, 1.0, 3.0) and s["std"] == pytest.approx(2**0.5)
    u = spark.createDataFrame([("b", 3), ("a", 5), ("b", 9), ("c", 1)], "k string, t long")
    assert [tuple(r) for r in ordered_unique(u, "k", ["t"]).orderBy("place").collect()] == [(0, "c"), (1, "b"), (2, "a")]


def test_validate_feature(spark):
    r = V.validate_feature(L.LiqNotional(30), fixture_c(spark))
    assert r["feature"] == "liq_notional_30s" and r["lookback_us"] == 30 * S and r["ok"] and r["aligned"] and (r["n_nan"], r["n_inf"], r["lookahead_violations"]) == (0, 0, 0)


def test_kinds():
    assert L.MidReturn().name == "mid_ret_5s" and L.LiqVelocity(10, 20).lookback_us == 20 * S and L.LiqNotional(window_s=7).name == "liq_notional_7s"
    assert L.MidReturn().inputs == ("bbo",) and L.Exchange2LiqNotional(3).inputs == ("liq_exchange_2",)
    for wrong in (lambda: L.LiqNotional(), lambda: L.BBOSpread(1), lambda: L.LiqNotional(other_s=1)):
        with pytest.raises(TypeError):
            wrong()


def test_times(spark):
    us = scalar.epoch_us("2024-02-03T04:05:06.000007")
    assert us == scalar.epoch_us("2024-02-03T05:05:06.000007+01:00")
    r = spark.createDataFrame([(us,)], "t long").select(scalar.to_date("t").alias("d"), scalar.to_hour("t").alias("h")).first()
    assert r["d"] == dt.date(2024, 2, 3) and r["h"] == 4


def test_overall_offset(spark):
    m = market(spark, SF)
    both = {r["sym"]: r["n"] for r in E.price_offset_overall(m).collect()}
    sides = E.price_offset(m).groupBy("sym").agg(F.sum("n")).collect()
    assert both == {r[0]: r[1] for r in sides}


# ------------------------------------------------------------------ streams


def streamed(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def collected(df, tmp_path, out):
    q = df.writeStream.format("parquet").option("path", f"{tmp_path}/{out}").option("checkpointLocation", f"{tmp_path}/cp-{out}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{out}").collect()


def order(i, t, side="buy", amount=1.0):
    return (i, "x", t * S, side, 100.0, amount)


def test_stream_windows(spark, tmp_path):
    late = 100_000  # moves the watermark past what is asked for
    trades = streamed(spark, tmp_path, "t", [order(i, t) for i, t in enumerate((50, 100, 150))], ORDER)
    events = streamed(spark, tmp_path, "e", [order(0, 45), order(1, 50), order(2, 95), order(3, 149, amount=2.0)], ORDER)
    streamed(spark, tmp_path, "t", [order(9, late)], ORDER)
    streamed(spark, tmp_path, "e", [order(9, late)], ORDER)
    got = {r["row_id"]: (r["notional"], r["events"]) for r in collected(stream_window_sum(trades, events, 30 * S), tmp_path, "w")}
    assert {k: got[k] for k in (0, 1, 2) if k in got} == {0: (100.0, 1), 1: (100.0, 1), 2: (200.0, 1)}


def test_stream_clusters(spark, tmp_path):
    rows = [order(i, t) for i, t in enumerate((10, 12, 13, 40, 41, 90))]
    events = streamed(spark, tmp_path, "e", rows, ORDER)
    streamed(spark, tmp_path, "e", [order(9, 100_000)], ORDER)
    got = sorted((r["t0"], r["t1"], r["n"]) for r in collected(stream_clusters(events, 5 * S), tmp_path, "c"))
    batch = sessions.clusters(spark.createDataFrame([(*r, "liq_exchange_1", r[2], 100.0, 100.0, 0.0) for r in rows], ORDER + ", stream string, t long, notional double, buy_notional double, sell_notional double"), 5 * S)
    assert got == sorted((r["t0"], r["t1"], r["n"]) for r in batch.collect()) == [(10 * S, 13 * S, 3), (40 * S, 41 * S, 2), (90 * S, 90 * S, 1)]


def test_lag_of_a_stream(spark, tmp_path):
    d = event_time(streamed(spark, tmp_path, "e", [order(0, 10)], ORDER), 200_000)
    assert collected(d, tmp_path, "l")[0]["ts"] == dt.datetime(1970, 1, 1, 0, 0, 10, 200_000)


def test_default_features_have_schema(spark):
    none = FeatureSet(DEFAULT_FEATURES).run(fixture_c(spark).with_queries(spark.createDataFrame([], ORDER)))
    assert none.count() == 0 and set(f.name for f in DEFAULT_FEATURES) < set(none.columns) and QUOTE
