"""Trades to OHLCV bars."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ieee

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def interval_ms(interval: str) -> int:
    found = re.fullmatch(r"([1-9][0-9]*)(ms|s|m|h|d|w)", interval.strip().lower())
    if not found:
        raise ValueError(f"unknown interval {interval!r}")
    return int(found[1]) * _UNITS[found[2]]


def bucket(ts: Column, every: int) -> Column:
    """The start of the bucket, closed on the left; times before 1970 round down too."""
    return ts - F.pmod(ts, F.lit(every))


def split_quantities(df: DataFrame, quantity: str = "quantity", maker: str = "is_buyer_maker") -> DataFrame:
    """buy_quantity and sell_quantity: a buyer who made the market was sold to. Without the flag both are 0."""
    if maker not in df.columns:
        return df.withColumns({"buy_quantity": F.lit(0.0), "sell_quantity": F.lit(0.0)})
    return df.withColumns({
        "buy_quantity": F.when(F.col(maker), 0.0).otherwise(F.col(quantity)),
        "sell_quantity": F.when(F.col(maker), F.col(quantity)).otherwise(0.0),
    })


def bars(trades: DataFrame, interval: str = "1m", by: Sequence[str] = (), time: str = "timestamp", price: str = "price", quantity: str = "quantity", tie: Sequence[str] = ("id",)) -> DataFrame:
    """(by..., ts, open, high, low, close, volume, vwap, buy_volume, sell_volume, trade_count) of each bucket that has trades.

    First and last go by time, then by ``tie``. All aggregates combine partially, so a busy bucket is
    merged before the shuffle.
    """
    order = F.struct(time, *tie)
    split = split_quantities(trades, quantity)
    grouped = split.groupBy(*by, bucket(F.col(time), interval_ms(interval)).alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(quantity).alias("volume"), F.sum(F.col(price) * F.col(quantity)).alias("__pq"),
        F.sum("buy_quantity").alias("buy_volume"), F.sum("sell_quantity").alias("sell_volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return grouped.select(*by, "ts", "open", "high", "low", "close", "volume", ieee.divide(F.col("__pq"), F.col("volume")).alias("vwap"), "buy_volume", "sell_volume", "trade_count")
