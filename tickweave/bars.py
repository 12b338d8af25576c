"""Price bars (symbol, ts, open, high, low, close, volume) from trades and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
BAR = ("symbol", "ts", *PRICES, "volume")


def build_bars(trades: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, order: Column) -> DataFrame:
    """One bar for each (symbol, ts): the first and last price by ``order``, the extremes, and the sum of volumes.

    All are mergeable aggregates, so trades are combined before the one shuffle. Rows without symbol, time or price are no trades.
    """
    rows = trades.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("price"), volume.alias("size"), order.alias("at"))
    rows = rows.where("symbol is not null and ts is not null and price is not null")
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum(F.coalesce("size", F.lit(0.0))).cast("double").alias("volume"),
    )


def daily_bars(lineitem: DataFrame, by: str = "supplier") -> DataFrame:
    """Daily bars of line items: a symbol is a supplier, or a pair of return flag and line status (``by="flag"``)."""
    symbol = F.col("l_suppkey").cast("string") if by == "supplier" else F.concat("l_returnflag", "l_linestatus")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return build_bars(lineitem, symbol, F.date_trunc("day", "l_shipdate").cast("timestamp_ntz"), F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")), F.col("l_quantity"), order)


def hourly_bars(events: DataFrame) -> DataFrame:
    """Hourly bars of event values: a symbol is an event type, the volume counts events."""
    return build_bars(events, F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.col("value"), F.lit(1.0), F.struct("ts", "event_id"))
