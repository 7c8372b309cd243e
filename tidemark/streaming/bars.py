"""Bars over a stream of trades: an extension, in the batch operator's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ieee
from tidemark.operators.resample import interval_ms, split_quantities


def streaming_bars(trades: DataFrame, interval: str = "1m", late: str = "5 minutes", by: Sequence[str] = (), time: str = "event_ts", tie: Sequence[str] = ("id",)) -> DataFrame:
    """Tumbling windows over the timestamp column ``time``; rows later than ``late`` are dropped by the watermark.

    Each window's state is one row of partial aggregates, so state grows with open windows and not with trades.
    """
    order = F.struct(time, *tie)
    grouped = split_quantities(trades.withWatermark(time, late)).groupBy(*by, F.window(time, f"{interval_ms(interval)} milliseconds").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("quantity")).alias("__pq"),
        F.sum("buy_quantity").alias("buy_volume"), F.sum("sell_quantity").alias("sell_volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return grouped.select(*by, F.unix_millis("w.start").alias("ts"), "open", "high", "low", "close", "volume", ieee.divide(F.col("__pq"), F.col("volume")).alias("vwap"), "buy_volume", "sell_volume", "trade_count")
