"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and
of a markout over $BENCH_ROWS generated trades and as many quotes, in look-ups a second."""

import json
import os
import time

from pyspark.sql import functions as F

from tidemark import registry
from tidemark.plans.markout import markout_baseline
from tidemark.schema import SECOND, Params
from tidemark.session import build_session
from tidemark.sources.events import Market

HEADLINE = ("feature_matrix", "markout_baseline", "rule_scores", "event_study_quintile", "leadlag_response", "liq_quirks", "bbo_quirks", "spearman_ic", "psi", "conditional_ic", "orderflow_acf", "adverse_selection")
#: Symbols of the generated feeds, and the time between two trades or quotes of all of them.
SYMBOLS, STEP_US = 8, 10_000


def generated(spark, rows: int) -> Market:
    d = spark.range(rows, numPartitions=64).select(F.col("id").alias("row_id"), F.concat(F.lit("s"), F.pmod("id", F.lit(SYMBOLS)).cast("string")).alias("sym"), (F.col("id") * STEP_US).alias("timestamp"), (100 + F.sin(F.col("id") / 1e5)).alias("px"))
    side = F.when(F.pmod(F.xxhash64("row_id"), F.lit(2)) == 0, "buy").otherwise("sell").alias("side")
    trades = d.select("row_id", "sym", "timestamp", side, F.col("px").alias("price"), F.lit(2.0).alias("amount"))
    bbo = d.select("row_id", "sym", (F.col("timestamp") - F.lit(SECOND // 3)).alias("timestamp"), (F.col("px") - 0.05).alias("bid_price"), (F.col("px") + 0.05).alias("ask_price"), F.lit(3.0).alias("bid_amount"), F.lit(4.0).alias("ask_amount"))
    return Market(trades, bbo, trades.limit(0), trades.limit(0), Params(bucket_us=3_600 * SECOND, split_us=rows * STEP_US // 2))


def timed(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


if __name__ == "__main__":
    sf, cpus, rows = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_ROWS", "10000000"))
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    q = registry.queries()
    q["causal_window_sum"](spark, sf).count()  # starts the JVM's compilers
    took = {name: timed(q[name](spark, sf)) for name in HEADLINE}
    m = generated(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(max(8, rows // 500_000)))
    sec = timed(markout_baseline(m))
    large = {"trades": rows, "quotes": rows, "horizons": len(m.params.horizons_s), "sec": sec, "lookups_per_s": round(rows * len(m.params.horizons_s) / sec)}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "markout": large}))
