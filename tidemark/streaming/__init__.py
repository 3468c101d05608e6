"""The same semantics on streams of trades.

``stream_features`` keeps the batch definition: each micro-batch of trades is evaluated against the
events and quotes with the batch plan, and appended once per batch id. ``stream_window_sum`` is for
events that arrive live: a watermarked stream-stream join within symbol keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.context import FeatureContext
from tidemark.operators.feature_set import FeatureSet


def stream_features(trades: DataFrame, ctx: FeatureContext, features, out_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """trades: a streaming DataFrame with row_id. A batch that is run again replaces its own files."""
    fs = FeatureSet(features)

    def write(batch: DataFrame, batch_id: int) -> None:
        fs.run(ctx.with_queries(batch)).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")

    return trades.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_time(df: DataFrame, lag_us: int = 0, delay: str = "10 minutes", out: str = "ts") -> DataFrame:
    """timestamp (microseconds) plus the availability lag as a watermarked TIMESTAMP."""
    return df.withColumn(out, F.timestamp_micros(F.col("timestamp") + F.lit(lag_us))).withWatermark(out, delay)


def stream_window_sum(trades: DataFrame, events: DataFrame, window_us: int, lag_us: int = 0, delay: str = "10 minutes") -> DataFrame:
    """row_id, and sum and count over [t - window, t), in append mode; trades without events have 0.
    A trade's row appears once the watermark has passed it."""
    t = event_time(trades.select("sym", "row_id", "timestamp"), 0, delay, "t_ts")
    e = event_time(events.select(F.col("sym").alias("e_sym"), "timestamp", (F.col("price") * F.col("amount")).alias("notional")), lag_us, delay, "e_ts").drop("timestamp")
    width = F.expr(f"make_dt_interval(0, 0, 0, {window_us / 1e6:.6f})")
    j = t.join(e, (F.col("sym") == F.col("e_sym")) & (F.col("e_ts") < F.col("t_ts")) & (F.col("e_ts") >= F.col("t_ts") - width), "leftOuter")
    return j.groupBy(F.window("t_ts", "1 minute"), "sym", "row_id").agg(F.coalesce(F.sum("notional"), F.lit(0.0)).alias("notional"), F.count("notional").alias("events")).drop("window")


def stream_clusters(events: DataFrame, gap_us: int, delay: str = "10 minutes") -> DataFrame:
    """Gap sessions by symbol: gaps up to gap_us stay in a session, as in the batch form."""
    d = event_time(events, 0, delay)
    return d.groupBy(F.session_window("ts", f"{gap_us} microseconds"), "sym").agg(
        F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"), F.count(F.lit(1)).alias("n"), F.sum(F.col("price") * F.col("amount")).alias("notional")
    )
