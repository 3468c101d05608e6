"""Scalar column functions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The funding times of a day, in seconds.
FUNDING_S = (0, 28_800, 57_600, 86_400)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """NaN becomes NULL."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def side_sign(side: Column | str) -> Column:
    """+1 for buy, -1 for anything else."""
    return F.when(as_col(side) == "buy", 1.0).otherwise(-1.0)


def notional() -> Column:
    return F.col("price") * F.col("amount")


def mid() -> Column:
    return (F.col("bid_price") + F.col("ask_price")) / 2.0


def spread_bps() -> Column:
    return F.try_divide(F.col("ask_price") - F.col("bid_price"), mid()) * 1e4


def imbalance() -> Column:
    return F.try_divide(F.col("bid_amount") - F.col("ask_amount"), F.col("bid_amount") + F.col("ask_amount"))


def microprice_dev() -> Column:
    return F.try_divide(F.col("ask_price") * F.col("bid_amount") + F.col("bid_price") * F.col("ask_amount"), F.col("bid_amount") + F.col("ask_amount")) - mid()


def bps(a: Column, b: Column) -> Column:
    """(a - b) / b in basis points."""
    return F.try_divide(a - b, b) * 1e4


def markout(sign: Column, future_mid: Column, price: Column, rebate_bps: float = 0.5) -> Column:
    return -sign * bps(future_mid, price) + F.lit(rebate_bps)


def guarded_share(buy: Column, sell: Column) -> Column:
    """(buy - sell) / (buy + sell), 0 when there is nothing."""
    total = buy + sell
    return F.when(total > 0, F.try_divide(buy - sell, total)).otherwise(F.lit(0.0))


def split_label(t: Column | str, split_us: int) -> Column:
    return F.when(as_col(t) < F.lit(split_us), "train").otherwise("val")


def time_bin(t: Column | str, width_us: int) -> Column:
    t = as_col(t)
    return F.floor(t / F.lit(width_us)).cast("long") if width_us <= 0 else ((t - F.pmod(t, F.lit(width_us))) / F.lit(width_us)).cast("long")


def second_of_day(t: Column | str) -> Column:
    return F.pmod(time_bin(t, 1_000_000), F.lit(86_400))


def day_of_week(t: Column | str) -> Column:
    """0 is Sunday: the epoch was a Thursday."""
    return F.pmod(time_bin(t, 86_400_000_000) + 4, F.lit(7))


def is_weekend(t: Column | str) -> Column:
    return day_of_week(t).isin(0, 6)


def funding_distance_s(t: Column | str) -> Column:
    return F.least(*[F.abs(second_of_day(t) - F.lit(x)) for x in FUNDING_S])


def epoch_us(iso: str) -> int:
    """ISO time, taken as UTC unless it names a zone, as microseconds."""
    import datetime as dt

    t = dt.datetime.fromisoformat(iso)
    t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return int(t.timestamp() * 1e6)


def to_date(t: Column | str) -> Column:
    return F.to_date(F.timestamp_micros(as_col(t)))


def to_hour(t: Column | str) -> Column:
    return F.floor(second_of_day(t) / 3600).cast("int")
