"""Table schemas and the parameters of the analyses."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

TRADES = T.StructType(
    [T.StructField("timestamp", T.LongType()), T.StructField("ticker", T.StringType()), T.StructField("side", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("amount", T.DoubleType())]
)
LIQUIDATIONS = TRADES
BBO = T.StructType(
    [T.StructField("timestamp", T.LongType()), T.StructField("ticker", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("bid_price", "bid_amount", "ask_price", "ask_amount")]
)

SECOND = 1_000_000
DAY = 86_400 * SECOND


@dataclass(frozen=True)
class Params:
    """Defaults are those of the millisecond market feeds; EVENTS fits the sparse ``events`` table."""

    lag_us: int = 200_000
    short_us: int = 30 * SECOND
    long_us: int = 120 * SECOND
    ret_us: int = 5 * SECOND
    horizons_s: tuple[int, ...] = (30, 120, 300)
    study_s: tuple[int, ...] = (5, 30, 120, 300)
    gap_us: int = 500_000
    near_us: int = SECOND
    weight_cap: float = 100_000.0
    rebate_bps: float = 0.5
    split_us: int = 1_769_904_000_000_000
    symmetric: tuple[float, ...] = (50_000, 100_000, 200_000, 500_000, 1_000_000, 2_000_000)
    directional: tuple[float, ...] = (50_000, 100_000, 200_000, 500_000)
    cascade_n: int = 5
    cascade_notional: float = 1_000_000.0
    cascade_s: float = 30.0
    lags_us: tuple[int, ...] = (-2_000_000, -1_000_000, -500_000, -200_000, -100_000, 0, 100_000, 200_000, 500_000, 1_000_000, 2_000_000, 5_000_000)
    bin_us: int = SECOND
    post_bins: int = 5
    acf_bin_us: int = 1_000
    acf_lags: tuple[int, ...] = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
    imbalance_s: tuple[int, ...] = (1, 5, 30, 120)
    stride_target: int = 4_000_000
    burst: int = 50
    train_days: int = 62
    val_days: int = 28
    bucket_us: int | None = DAY
    #: Pieces in which a group is ranked, so that no task sorts all its rows.
    rank_buckets: int = 64

    def but(self, **kw) -> Params:
        return replace(self, **kw)


#: Scaled to the minute-level ``events`` table.
EVENTS = Params(
    lag_us=120 * SECOND, short_us=1_800 * SECOND, long_us=7_200 * SECOND, ret_us=300 * SECOND,
    horizons_s=(1_800, 7_200, 18_000), study_s=(300, 1_800, 7_200, 18_000), gap_us=300 * SECOND, near_us=300 * SECOND,
    weight_cap=500.0, split_us=1_705_795_200 * SECOND,
    symmetric=(500.0, 1_000.0, 2_000.0), directional=(500.0, 1_000.0),
    cascade_n=3, cascade_notional=1_500.0, cascade_s=1_200.0,
    lags_us=tuple(k * 60 * SECOND for k in (-30, -10, -5, -1, 0, 1, 5, 10, 30, 60)),
    bin_us=60 * SECOND, post_bins=60, acf_bin_us=60 * SECOND, acf_lags=(1, 2, 3, 5, 8, 13),
    imbalance_s=(300, 1_800, 7_200), burst=2, train_days=20, val_days=10, rank_buckets=1,
)
