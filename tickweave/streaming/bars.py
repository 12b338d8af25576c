"""Bars of a stream of trades or events, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streaming_bars(trades: DataFrame, symbol: str, ts: str, price: str, volume: str | Column = "volume", every: str = "1 hour", late: str = "10 minutes", order: Column | None = None) -> DataFrame:
    """Bars of ``every`` from trades that come at most ``late`` behind the latest one. Works on a stream and on a table alike.

    State is one row for each open (symbol, window). In append mode a bar comes out once, when the watermark has passed its end.
    """
    size = F.col(volume) if isinstance(volume, str) else volume
    rows = trades.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("_ts"), F.col(price).cast("double").alias("_price"), size.cast("double").alias("_size"), (order if order is not None else F.col(ts)).alias("_order"))
    timed = rows.withWatermark("_ts", late) if trades.isStreaming else rows
    bars = timed.groupBy("symbol", F.window("_ts", every)).agg(
        F.min_by("_price", "_order").alias("open"), F.max("_price").alias("high"), F.min("_price").alias("low"), F.max_by("_price", "_order").alias("close"), F.sum("_size").alias("volume")
    )
    return bars.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
