"""Labels, folds and rank correlations of a forecasting study.

The published results say what was measured and not how; these are the usual definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ieee
from tidemark.operators import ordered


def relative_returns(bars: DataFrame, symbol: str, price: str, back: int, ahead: int, ts: str = "ts") -> DataFrame:
    """Adds signal (the return over ``back`` rows), forward (over the next ``ahead``) and label: forward less its mean over symbols."""
    w = Window.partitionBy(symbol).orderBy(ts)
    made = bars.withColumns({
        "signal": ieee.divide(F.col(price), F.lag(price, back).over(w)) - 1,
        "forward": ieee.divide(F.lead(price, ahead).over(w), F.col(price)) - 1,
    })
    return made.withColumn("label", F.col("forward") - F.avg("forward").over(Window.partitionBy(ts)))


def rank_ic(df: DataFrame, signal: str = "signal", label: str = "label", ts: str = "ts", least: int = 3) -> DataFrame:
    """(ts, rank_ic, n): correlation of average ranks across symbols at each time that has ``least`` or more."""
    known = df.where(F.col(signal).isNotNull() & F.col(label).isNotNull())

    def rank(c: str):
        return F.rank().over(Window.partitionBy(ts).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(ts, c)) - 1) / 2

    ranked = known.select(ts, rank(signal).alias("a"), rank(label).alias("b"))
    return ranked.groupBy(ts).agg(F.corr("a", "b").alias("rank_ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def walk_forward(df: DataFrame, parts: int, ts: str = "ts") -> DataFrame:
    """One row for each of ``parts`` - 1 folds: training from the start to the end of the part before, testing on the part."""
    placed, _ = ordered.number(df.select(ts), ts)
    n = placed.count()
    small, more = n // parts, n % parts  # the first parts have one row more
    edge = more * (small + 1)
    part = F.when(F.col(ordered.RN) < edge, F.floor(F.col(ordered.RN) / (small + 1))).otherwise(more + F.floor((F.col(ordered.RN) - edge) / max(1, small)))
    edges = placed.groupBy(part.cast("int").alias("part")).agg(F.min(ts).alias("test_start"), F.max(ts).alias("test_end"), F.count(F.lit(1)).alias("n_test"))
    w = Window.orderBy("part")  # one row a part
    made = edges.select(F.col("part").alias("fold"), F.first("test_start").over(w).alias("train_start"), F.lag("test_end").over(w).alias("train_end"), "test_start", "test_end", "n_test")
    return made.where("fold > 0")


def terciles(df: DataFrame, x: str, ts: str = "ts") -> DataFrame:
    """Adds regime 1 to 3 by rank of ``x``."""
    placed, _ = ordered.number(df, x, ties=[ts])
    n = placed.count()
    small, more = n // 3, n % 3
    edge = more * (small + 1)
    part = F.when(F.col(ordered.RN) < edge, F.floor(F.col(ordered.RN) / (small + 1))).otherwise(more + F.floor((F.col(ordered.RN) - edge) / max(1, small)))
    return placed.withColumn("regime", (part + 1).cast("int")).drop(ordered.RN, ordered.BLOCK)
