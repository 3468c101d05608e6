"""One long-format union, one Window: causal sums, counts, time since, and as-of lookups.

Every request is a range frame over integer microseconds. Sums and counts are differences of two
unbounded frames, which Spark advances in constant time per row; a bounded sliding frame is
re-aggregated for every row. Frames are of one partitioning and order, so that Catalyst plans one
exchange, one sort and one Window for any number of requests.

``bucket_us`` cuts time into buckets so that parallelism is not the number of symbols: events go
to every bucket that can see them, and each bucket gets a seed row with the last event and quote
before its reach.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of streams that are unions of others.
UNIONS = {"liq_combined": ("liq_exchange_1", "liq_exchange_2")}
VALUES = ("notional", "buy_notional", "sell_notional")
#: Values are summed as decimals: a difference of running sums is then exact, so that equal windows have
#: equal sums whatever came before them. A sum has 10 digits more, a difference 1.
EXACT = "decimal(22,10)"
EVENT, QUOTE, QUERY = 0, 1, 2


@dataclass(frozen=True)
class Request:
    """kind: sum, count (events with t + lo <= ts <= t + hi), last_ts (latest event <= t + hi), asof
    (latest quote <= t + hi). beyond/before: NULL or the last/first quote outside the quotes' range."""

    kind: str
    stream: str = ""
    value: str = ""
    lo: int = 0
    hi: int = -1
    beyond_null: bool = False
    clip_first: bool = False

    @property
    def name(self) -> str:
        f = lambda x: str(x).replace("-", "m")
        return "_".join(["r", self.kind, self.stream, self.value, f(self.lo), f(self.hi), "n" * self.beyond_null + "c" * self.clip_first])

    @property
    def column(self) -> Column:
        return F.col(self.name)

    @property
    def source(self) -> str:
        """Name of the companion column with the latest source time read."""
        return f"{self.name}_src"


def _members(stream: str) -> tuple[str, ...]:
    return UNIONS.get(stream, (stream,))


def _seeds(rows: DataFrame, queries: DataFrame, keys: list[str], shift: int, bucket_us: int, by: list[str], row: Column) -> DataFrame:
    """For each bucket that has queries: the last row of each ``by`` before the bucket's reach."""
    cell = F.floor((F.col("t") - F.lit(shift)) / F.lit(bucket_us)).cast("long")
    last = rows.groupBy(*keys, *by, cell.alias("bucket")).agg(F.max(row).alias("__row"))
    asked = queries.select(*keys, "bucket").distinct()
    if by:
        asked = asked.join(rows.select(*keys, *by).distinct(), keys)
    both = last.select(*keys, *by, "bucket", "__row", F.lit(False).alias("__ask")).unionByName(asked.select(*keys, *by, "bucket", F.lit(None).cast(last.schema["__row"].dataType).alias("__row"), F.lit(True).alias("__ask")))
    w = Window.partitionBy(*keys, *by).orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("__row", F.max("__row").over(w)).where("__ask AND __row IS NOT NULL").select(*keys, *by, "bucket", "__row")


def evaluate(
    queries: DataFrame,
    events: DataFrame,
    quotes: DataFrame,
    requests: Iterable[Request],
    keys: Sequence[str] = ("sym",),
    bucket_us: int | None = None,
    track: bool = False,
) -> DataFrame:
    """``queries`` (keys, t, row_id, ...) with a column per request, and its companion if ``track``.

    events: keys, t, stream, notional, buy_notional, sell_notional. quotes: keys, t, row_id, and any
    value columns. Sums over nothing are 0.0; of several quotes at one time the largest row_id counts.
    """
    keys, requests = list(keys), list(dict.fromkeys(requests))
    if not requests:
        return queries
    series = [c for c in quotes.columns if c not in {*keys, "t", "row_id"}]
    windowed = [r for r in requests if r.kind in ("sum", "count")]
    lo = min([0, *(r.lo for r in windowed), *(r.hi for r in requests)])
    hi = max([0, *(r.hi for r in requests)])
    need_events, need_quotes = any(r.kind != "asof" for r in requests), any(r.kind == "asof" for r in requests)
    values = [v for v in VALUES if any(r.value == v for r in windowed)]
    passed = [c for c in queries.columns if c not in {*keys, "t"}]

    quote = F.struct("t", "row_id", *series)
    q = queries
    part = list(keys)
    ev, qt = events.select(*keys, "t", "stream", *[F.col(v).cast(EXACT).alias(v) for v in values]), quotes.select(*keys, "t", quote.alias("__q"))
    if bucket_us:
        part.append("bucket")
        cell = lambda c: F.floor(c / F.lit(bucket_us)).cast("long")
        q = q.withColumn("bucket", cell(F.col("t")))
        spread = lambda d: d.withColumn("bucket", F.explode(F.sequence(cell(F.col("t") - F.lit(hi)), cell(F.col("t") - F.lit(lo)))))
        es, qs = _seeds(events, q, keys, lo, bucket_us, ["stream"], F.struct("t")), _seeds(quotes, q, keys, lo, bucket_us, [], quote)
        ev = spread(ev).withColumn("__one", F.lit(1)).unionByName(es.select(*part, F.col("__row.t").alias("t"), "stream", *[F.lit(0).cast(EXACT).alias(v) for v in values], F.lit(0).alias("__one")))
        qt = spread(qt).unionByName(qs.select(*part, F.col("__row.t").alias("t"), F.col("__row").alias("__q")))
    else:
        ev = ev.withColumn("__one", F.lit(1))
    line = q.withColumn("__kind", F.lit(QUERY))
    if need_events:
        line = line.unionByName(ev.withColumn("__kind", F.lit(EVENT)), allowMissingColumns=True)
    if need_quotes:
        line = line.unionByName(qt.withColumn("__kind", F.lit(QUOTE)), allowMissingColumns=True)

    order = Window.partitionBy(*part).orderBy("t")
    upto = lambda b: order.rangeBetween(Window.unboundedPreceding, b)
    frames: dict[tuple, Column] = {}

    def of(stream: str) -> Column:
        return F.col("stream").isin(*_members(stream))

    def frame(kind: str, stream: str, value: str, bound: int) -> Column:
        key = (kind, stream, value, bound)
        c = {
            "sum": lambda: F.coalesce(F.sum(F.when(of(stream), F.col(value))).over(upto(bound)), F.lit(0).cast(EXACT)),
            "count": lambda: F.coalesce(F.sum(F.when(of(stream), F.col("__one"))).over(upto(bound)), F.lit(0)),
            "last": lambda: F.max(F.when(of(stream) & (F.col("__kind") == EVENT), F.col("t"))).over(upto(bound)),
            "quote": lambda: F.max("__q").over(upto(bound)),
        }[kind]
        frames.setdefault(key, c())
        return F.col("__f" + str(list(frames).index(key)))

    out: list[Column] = []
    for r in requests:
        if r.kind in ("sum", "count"):
            n = frame("count", r.stream, "", r.hi) - frame("count", r.stream, "", r.lo - 1)
            if r.kind == "count":
                out.append(n.cast("double").alias(r.name))
            else:
                out.append(F.when(n > 0, (frame("sum", r.stream, r.value, r.hi) - frame("sum", r.stream, r.value, r.lo - 1)).cast("double")).otherwise(F.lit(0.0)).alias(r.name))
            if track:
                out.append(F.when(n > 0, frame("last", r.stream, "", r.hi)).alias(r.source))
        elif r.kind == "last_ts":
            c = frame("last", r.stream, "", r.hi)
            out.append(c.alias(r.name))
            if track:
                out.append(c.alias(r.source))
        elif r.kind == "asof":
            c = frame("quote", "", "", r.hi)
            v = c[r.value]
            if r.clip_first:
                v = F.when(c.isNull(), F.col("__first")[r.value]).otherwise(v)
            if r.beyond_null:
                v = F.when(F.col("t") + F.lit(r.hi) <= F.col("__last"), v)
            out.append(v.alias(r.name))
            if track:
                out.append(c["t"].alias(r.source))
        else:
            raise ValueError(f"unknown request kind {r.kind!r}")
    # frame() has filled ``frames`` by now; one projection holds every window expression.
    done = line.select(*part, "t", *passed, "__kind", *[c.alias(f"__f{i}") for i, c in enumerate(frames.values())]).where(F.col("__kind") == QUERY)
    if any(r.beyond_null or r.clip_first for r in requests):
        span = quotes.groupBy(*keys).agg(F.max("t").alias("__last"), F.min(quote).alias("__first"))
        # of several first quotes at one time the largest row_id counts, as in the frames
        first = quotes.join(span.select(*keys, F.col("__first.t").alias("__t0")), keys).where("t = __t0").groupBy(*keys).agg(F.max(quote).alias("__first"))
        done = done.join(span.select(*keys, "__last").join(first, keys), keys, "left")
    return done.select(*keys, "t", *passed, *out)
