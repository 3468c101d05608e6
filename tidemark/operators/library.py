"""The feature library: a catalogue of kinds, each a label, what it reads and a formula over that.

A kind is called with its windows in seconds and gives a Feature. A read names the context's request; its
window is one of the kind's, looked up when the feature is made.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import bps
from tidemark.operators.feature import Feature
from tidemark.schema import SECOND


@dataclass(frozen=True)
class Read:
    """how: "sum", "count", "imbalance" or "since" of a stream, or "quote", the as-of value of a series;
    of: the stream or series; window: whose length it looks back, "" for none."""

    how: str
    of: str
    window: str = ""
    value: str = "notional"

    def column(self, ctx, windows: Mapping[str, int]) -> Column:
        back = windows.get(self.window, 0) * SECOND
        match self.how:
            case "sum":
                return ctx.window_sum(self.of, self.value, back)
            case "count":
                return ctx.window_count(self.of, back)
            case "imbalance":
                return ctx.window_side_imbalance(self.of, back)
            case "since":
                return ctx.time_since_last(self.of)
            case "quote":
                return ctx.asof(self.of, -back)
        raise ValueError(f"unknown read {self.how!r}")


class Made(Feature):
    def __init__(self, kind: Kind, windows: Mapping[str, int]) -> None:
        self.kind, self.windows = kind, dict(windows)
        self.name = kind.label.format(**windows)
        self.lookback_us = max(windows.values(), default=0) * SECOND
        self.inputs = tuple(dict.fromkeys("bbo" if r.how == "quote" else r.of for r in kind.reads.values()))

    def calculate(self, ctx) -> Column:
        return self.kind.formula(**{k: r.column(ctx, self.windows) for k, r in self.kind.reads.items()})


@dataclass(frozen=True)
class Kind:
    label: str
    reads: Mapping[str, Read]
    formula: Callable[..., Column] = lambda x: x
    #: Windows in seconds, by name; None asks for a value.
    windows: Mapping[str, int | None] = field(default_factory=dict)

    def __call__(self, *seconds: int, **named: int) -> Feature:
        got = dict(self.windows) | dict(zip(self.windows, seconds, strict=False)) | named
        if len(seconds) > len(self.windows) or set(got) != set(self.windows) or None in got.values():
            raise TypeError(f"{self.label} takes the windows {', '.join(self.windows) or 'none'}")
        return Made(self, got)


def _signed_log(buy: Column, sell: Column) -> Column:
    return F.signum(buy - sell) * F.log1p(F.abs(buy - sell))


#: Streams: all venues together, and the second one alone.
ALL, SECOND_VENUE = "liq_combined", "liq_exchange_2"
REQUIRED = {"window_s": None}

# The public names, labels, default windows and formulas.
BBOImbalance = Kind("bbo_imbalance", {"x": Read("quote", "imbalance")})
BBOSpread = Kind("bbo_spread_bps", {"x": Read("quote", "spread_bps")})
MidReturn = Kind("mid_ret_{window_s}s", {"now": Read("quote", "mid"), "past": Read("quote", "mid", "window_s")}, lambda now, past: bps(now, past), {"window_s": 5})
TimeSinceLiq = Kind("time_since_liq_s", {"x": Read("since", ALL)})
LiqEventCount = Kind("liq_event_count_{window_s}s", {"x": Read("count", ALL, "window_s")}, windows=REQUIRED)
LiqNotional = Kind("liq_notional_{window_s}s", {"x": Read("sum", ALL, "window_s")}, windows=REQUIRED)
Exchange2LiqNotional = Kind("exchange_2_liq_notional_{window_s}s", {"x": Read("sum", SECOND_VENUE, "window_s")}, windows=REQUIRED)
LiqSideImbalance = Kind("liq_side_imbalance_{window_s}s", {"x": Read("imbalance", ALL, "window_s")}, windows=REQUIRED)
LiqStrength = Kind("liq_strength_{window_s}s", {s: Read("sum", ALL, "window_s", f"{s}_notional") for s in ("buy", "sell")}, _signed_log, {"window_s": 30})
LiqVelocity = Kind("liq_velocity", {w: Read("sum", ALL, f"{w}_s") for w in ("short", "long")}, lambda short, long: short / (long + 1.0), {"short_s": 30, "long_s": 120})


def default_features(short_s: int = 30, long_s: int = 120, ret_s: int = 5) -> list[Feature]:
    over_short = [k(short_s) for k in (LiqNotional, LiqEventCount, LiqSideImbalance, Exchange2LiqNotional)]
    return [over_short[0], LiqNotional(long_s), *over_short[1:], LiqVelocity(short_s, long_s), TimeSinceLiq(), BBOSpread(), BBOImbalance(), MidReturn(ret_s)]


DEFAULT_FEATURES = default_features()
