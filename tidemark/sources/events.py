"""The ``events`` table as trades, quotes and two liquidation feeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.context import FeatureContext, combined_events, quote_series
from tidemark.schema import EVENTS, Params


@dataclass
class Market:
    trades: DataFrame
    bbo: DataFrame
    liq1: DataFrame
    liq2: DataFrame
    params: Params = EVENTS

    def context(self) -> FeatureContext:
        p = self.params
        return FeatureContext.from_frames(self.trades, self.bbo, self.liq1, self.liq2, p.lag_us, weight_cap=p.weight_cap, bucket_us=p.bucket_us)

    def events(self, lag_us: int | None = None) -> DataFrame:
        return combined_events(self.liq1, self.liq2, lag_us=self.params.lag_us if lag_us is None else lag_us)

    def quotes(self) -> DataFrame:
        return quote_series(self.bbo)


def market(spark: SparkSession, sf_dir: str, params: Params = EVENTS) -> Market:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    px, i = F.expr("100.0D + value / 10.0D"), F.col("event_id")
    d = raw.select(i.alias("row_id"), "event_type", (us - F.pmod(us, F.lit(60_000_000))).alias("timestamp"), F.when(F.col("user_id") % 2 == 0, "btc").otherwise("eth").alias("sym"), px.alias("px"))
    r = F.col("row_id")
    of = lambda *kinds: d.where(F.col("event_type").isin(*kinds))
    side = lambda k: F.when(r % k == 0, "buy").otherwise("sell").alias("side")
    size = lambda k: (1 + r % k).cast("double")
    half = F.expr("0.05D * (1 + row_id % 4)")
    orders = lambda kinds, k, n: of(*kinds).select("row_id", "sym", "timestamp", side(k), F.col("px").alias("price"), size(n).alias("amount"))
    bbo = of("view").select("row_id", "sym", "timestamp", (F.col("px") - half).alias("bid_price"), (F.col("px") + half).alias("ask_price"), size(7).alias("bid_amount"), size(5).alias("ask_amount"))
    return Market(orders(("purchase", "click"), 2, 9), bbo, orders(("error",), 3, 11), orders(("signup",), 3, 11), params)
