"""The door to data: methods return Columns for requests, which a FeatureSet fuses into one Window."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.timeline import Request, evaluate

LAG_US = 200_000
WEIGHT_CAP = 100_000.0


def keyed(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """With a row_id, and t for timestamp; a frame of one symbol gets a constant key."""
    if "t" not in df.columns:
        df = df.withColumnRenamed("timestamp", "t")
    for k in keys:
        if k not in df.columns:
            df = df.withColumn(k, F.lit(""))
    if "row_id" not in df.columns:
        df = df.withColumn("row_id", F.monotonically_increasing_id())
    return df


def event_stream(df: DataFrame, stream: str, keys: tuple[str, ...], lag_us: int = 0) -> DataFrame:
    n = S.clean(S.notional())
    df = keyed(df, keys)
    return df.select(
        *keys, (F.col("t") + F.lit(lag_us)).alias("t"), "row_id", "side", "price", "amount",
        F.lit(stream).alias("stream"), n.alias("notional"),
        F.when(F.col("side") == "buy", n).otherwise(0.0).alias("buy_notional"),
        F.when(F.col("side") == "buy", 0.0).otherwise(n).alias("sell_notional"),
    )


def combined_events(liq1: DataFrame, liq2: DataFrame, keys: tuple[str, ...] = ("sym",), lag_us: int = LAG_US) -> DataFrame:
    """Both venues; the second is shifted to the time it becomes available before the union."""
    return event_stream(liq1, "liq_exchange_1", keys).unionByName(event_stream(liq2, "liq_exchange_2", keys, lag_us))


def quote_series(bbo: DataFrame, keys: tuple[str, ...] = ("sym",)) -> DataFrame:
    d = keyed(bbo, keys)
    return d.select(*keys, "t", "row_id", S.clean(S.mid()).alias("mid"), S.clean(S.spread_bps()).alias("spread_bps"), S.clean(S.imbalance()).alias("imbalance"))


def query_stream(trades: DataFrame, keys: tuple[str, ...] = ("sym",), weight_cap: float = WEIGHT_CAP) -> DataFrame:
    d = keyed(trades, keys)
    return d.select(*keys, "t", "row_id", "side", "price", "amount", S.side_sign("side").alias("s"), F.least(S.notional(), F.lit(weight_cap)).alias("w"))


@dataclass
class FeatureContext:
    queries: DataFrame
    events: DataFrame
    quotes: DataFrame
    keys: tuple[str, ...] = ("sym",)
    bucket_us: int | None = None
    requests: dict[str, Request] = field(default_factory=dict)
    untracked: set[str] = field(default_factory=set)

    @classmethod
    def from_frames(
        cls, trades: DataFrame, bbo: DataFrame, liq_exchange_1: DataFrame, liq_exchange_2: DataFrame, exchange_2_lag_us: int = LAG_US,
        keys: tuple[str, ...] = ("sym",), weight_cap: float = WEIGHT_CAP, bucket_us: int | None = None,
    ) -> FeatureContext:
        return cls(query_stream(trades, keys, weight_cap), combined_events(liq_exchange_1, liq_exchange_2, keys, exchange_2_lag_us), quote_series(bbo, keys), keys, bucket_us)

    def fresh(self) -> FeatureContext:
        """The same data without requests."""
        return replace(self, requests={}, untracked=set())

    def with_queries(self, trades: DataFrame, weight_cap: float = WEIGHT_CAP) -> FeatureContext:
        return replace(self.fresh(), queries=query_stream(trades, self.keys, weight_cap))

    def truncated(self, probes: DataFrame, requests: Iterable[Request]) -> FeatureContext:
        """A context per cut, which probe trades of equal keys and t share: events before t, quotes up to t.
        Only what the requests can read is joined, by cells of time as long as they reach back, and the last
        event or quote before that if a request reads it. ``probes`` are rows of ``queries``, up to all."""
        requests = list(requests)
        reach = min([0, *(r.lo for r in requests if r.kind in ("sum", "count")), *(r.hi for r in requests)])
        width = max(-reach, 1)
        cell = lambda c: F.floor(c / F.lit(width)).cast("long")
        p = probes.select(*self.keys, F.col("t").alias("probe_id"), F.col("t").alias("__pt")).distinct()
        cells = p.withColumn("__cell", F.explode(F.sequence(cell(F.col("__pt") + F.lit(reach)), cell(F.col("__pt")))))

        def cut(d: DataFrame, upto: Column, by: list[str], kind: str) -> DataFrame:
            near = d.withColumn("__cell", cell(F.col("t"))).join(cells, [*self.keys, "__cell"]).where(upto & (F.col("t") >= F.col("__pt") + F.lit(reach)))
            near = near.select(*d.columns, "probe_id")
            if all(r.kind != kind for r in requests):
                return near
            rest = [c for c in d.columns if c not in {*self.keys, *by, "t"}]
            row = F.struct("t", *rest)
            group = [*self.keys, *by]
            asked = p.join(d.select(*group).distinct(), list(self.keys)) if by else p
            line = d.select(*group, "t", row.alias("__row"), F.lit(None).cast("long").alias("probe_id"))
            line = line.unionByName(asked.select(*group, (F.col("__pt") + F.lit(reach)).alias("t"), "probe_id"), allowMissingColumns=True)
            w = Window.partitionBy(*group).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
            last = line.withColumn("__row", F.max("__row").over(w)).where("probe_id IS NOT NULL AND __row IS NOT NULL").select(*group, "probe_id", "__row.*")
            return near.unionByName(last.select(*near.columns))

        return replace(
            self.fresh(), keys=(*self.keys, "probe_id"), bucket_us=None, queries=probes.withColumn("probe_id", F.col("t")),
            events=cut(self.events, F.col("t") < F.col("__pt"), ["stream"], "last_ts"), quotes=cut(self.quotes, F.col("t") <= F.col("__pt"), [], "asof"),
        )

    def n_trades(self) -> int:
        return self.queries.count()

    def _ask(self, r: Request, tracked: bool = True) -> Column:
        self.requests[r.name] = r
        if not tracked:
            self.untracked.add(r.name)
        return r.column

    def window_sum(self, stream: str, value: str, lookback_us: int) -> Column:
        """Sum over [t - lookback, t)."""
        return self._ask(Request("sum", stream, value, -lookback_us, -1))

    def window_count(self, stream: str, lookback_us: int) -> Column:
        return self._ask(Request("count", stream, "", -lookback_us, -1))

    def window_side_imbalance(self, stream: str, lookback_us: int) -> Column:
        n = self.window_count(stream, lookback_us)
        share = S.guarded_share(self.window_sum(stream, "buy_notional", lookback_us), self.window_sum(stream, "sell_notional", lookback_us))
        return F.when(n > 0, share).otherwise(F.lit(0.0))

    def time_since_last(self, stream: str, default_s: float = 1e9) -> Column:
        """Seconds since the last event before t."""
        return F.coalesce((F.col("t") - self._ask(Request("last_ts", stream, hi=-1))) / 1e6, F.lit(default_s))

    def asof(self, series: str, offset_us: int = 0, mode: str = "null") -> Column:
        """Last quote at or before t + offset; NULL before the first, and past the last if offset > 0.
        mode: "clip" takes the first or last quote there instead, "covered" gives NULL on both sides."""
        return self._ask(Request("asof", "", series, hi=offset_us, beyond_null=mode == "covered" or mode == "null" and offset_us > 0, clip_first=mode == "clip"))

    def raw_sum(self, stream: str, value: str, lo_us: int, hi_us: int) -> Column:
        """Sum over [t + lo, t + hi]: not causal by itself, and not seen by tracking."""
        return self._ask(Request("sum", stream, value, lo_us, hi_us), tracked=False)

    def evaluate(self, columns: dict[str, Column], track: bool = False) -> DataFrame:
        """keys, t, row_id, queries' columns and ``columns``, computed by one Window."""
        src = [r for n, r in self.requests.items() if n not in self.untracked]
        d = evaluate(self.queries, self.events, self.quotes, self.requests.values(), self.keys, self.bucket_us, track)
        used = [F.greatest(*[F.col(r.source) for r in src], F.lit(None).cast("long")).alias("max_used_ts") if src else F.lit(None).cast("long").alias("max_used_ts")] if track else []
        return d.select(*self.queries.columns, *[c.alias(n) for n, c in columns.items()], *used)

    def max_used_ts(self, feature) -> DataFrame:
        """keys, t, row_id, max_used_ts: the latest source time that the feature read, NULL if none."""
        ctx = self.fresh()
        return ctx.evaluate({"__v": feature.calculate(ctx)}, track=True).select(*self.keys, "t", "row_id", "max_used_ts")
