"""Data set layout, scans, sinks, and artifacts that are computed once."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sample import sample_exact
from tidemark.schema import BBO, LIQUIDATIONS, TRADES

FEEDS = {"trades": "exchange_1_trades/perp_{}usdt.parquet", "bbo": "exchange_1_booktickers/perp_{}usdt.parquet", "liq1": "exchange_1_liquidations/perp_{}usdt.parquet", "liq2": "exchange_2_liquidations/{}usdt.parquet"}
SCHEMAS = {"trades": TRADES, "bbo": BBO, "liq1": LIQUIDATIONS, "liq2": LIQUIDATIONS}


@dataclass(frozen=True)
class Dataset:
    """One directory per feed and one file per symbol below ``root``, on any file system Spark reads."""

    root: str

    def path(self, feed: str, sym: str) -> str:
        return f"{self.root.rstrip('/')}/{FEEDS[feed].format(sym)}"

    def scan(self, spark: SparkSession, feed: str, sym: str, columns: list[str] | None = None, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        """With a sym column; the time range is pushed down to the Parquet scan."""
        d = spark.read.schema(SCHEMAS[feed]).parquet(self.path(feed, sym))
        if start_us is not None:
            d = d.where(F.col("timestamp") >= start_us)
        if end_us is not None:
            d = d.where(F.col("timestamp") < end_us)
        # a row's place in its file, which is the same in every plan
        names = sorted({f.rsplit("/", 1)[-1] for f in d.inputFiles()})
        ordinal = F.array_position(F.array(*[F.lit(n) for n in names] or [F.lit("")]), F.col("_metadata.file_name")) - 1
        row_id = (F.shiftleft(ordinal.cast("long"), 40) + F.col("_metadata.row_index")).alias("row_id")
        return d.select(*(columns or SCHEMAS[feed].names), F.lit(sym).alias("sym"), row_id)


def empty(spark: SparkSession, feed: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[feed]).withColumn("sym", F.lit("")).withColumn("row_id", F.lit(0).cast("long"))


def load_frames(spark: SparkSession, root: str, sym: str, trades_sample: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """trades, bbo, liq1, liq2; lazily, with an exact-size sample of the trades if asked for."""
    ds = Dataset(root)
    trades, bbo, l1, l2 = (ds.scan(spark, f, sym) for f in FEEDS)
    return (sample_exact(trades, trades_sample, seed) if trades_sample else trades), bbo, l1, l2


def after_warm_up(trades: DataFrame, bbo: DataFrame, warm_us: int = 5_000_000, t: str = "timestamp") -> DataFrame:
    """Trades from warm_us after their symbol's first quote on."""
    first = bbo.groupBy("sym").agg((F.min(t) + F.lit(warm_us)).alias("__from"))
    return trades.join(first, "sym").where(F.col(t) >= F.col("__from")).drop("__from")


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Option for feeds that repeat whole rows; row_id, which is ours, does not count."""
    return df.dropDuplicates([c for c in df.columns if c != "row_id"])


class ArtifactStore:
    """Parquet results under a path; what exists is read, unless refreshed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def get_or_compute(self, name: str, fn: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        if refresh or not self.exists(name):
            fn().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))


def sql_scan(spark: SparkSession, sql: str, **paths: str) -> DataFrame:
    """A query over Parquet files, which stand in braces: sql_scan(spark, "SELECT max(t) FROM {quotes}", quotes=path).
    Filters and columns reach the scans."""
    return spark.sql(sql.format(**{k: f"parquet.`{v}`" for k, v in paths.items()}))


def to_arrow(df: DataFrame, most: int = 1_000_000):
    """A result of at most so many rows as an Arrow table; more is an error, not a cut."""
    t = df.limit(most + 1).toArrow()
    if t.num_rows > most:
        raise ValueError(f"more than {most} rows")
    return t


def from_arrow(spark: SparkSession, table) -> DataFrame:
    return spark.createDataFrame(table)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def report(df: DataFrame, key: str) -> str:
    """A small result as one JSON text keyed by a column."""
    return json.dumps({r[key]: {k: v for k, v in r.asDict(True).items() if k != key} for r in df.collect()}, indent=2, default=str)
