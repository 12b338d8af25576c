"""Feature transforms, fractional differencing, anchored prices and bootstrap resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions import kernels as K
from tickweave.functions.columns import W, ffill, per_symbol, prev


def _all() -> WindowSpec:
    return Window.partitionBy("symbol")


def root_transform(c: Column, power: float = 2.0) -> Column:
    """Sign-preserving root."""
    return F.signum(c) * F.pow(F.abs(c), F.lit(1.0 / power))


def log_transform(c: Column, over: Window | None = None) -> Column:
    """Logarithm, after a shift by the symbol's least value where that isn't positive."""
    least = F.min(c).over(over or _all())
    return F.ln(c + F.when(least <= 0, F.abs(least) + 1).otherwise(0.0))


def tanh_transform(c: Column, centred: bool = True) -> Column:
    """Hyperbolic tangent of the value, less its median so far if ``centred``, over 1.5 times the 15 to 85 per cent range so far."""
    places = F.percentile(c, [0.15, 0.5, 0.85]).over(W().rowsBetween(Window.unboundedPreceding, 0))

    def squash(q: Column) -> Column:
        x = c - q[1] if centred else c
        wide = (q[2] - q[0]) * 1.5
        return F.coalesce(F.when(wide == 0, F.signum(x)).otherwise(F.tanh(F.try_divide(x, wide))), F.lit(0.0))

    return F.transform(F.array(places), squash)[0]  # one window for all three places


def transform_column(df: DataFrame, col: str, out: str, kind: str, **options) -> DataFrame:
    """Apply "root", "log" or "tanh"."""
    kinds = {"root": root_transform, "log": log_transform, "tanh": tanh_transform}
    if kind not in kinds:
        raise ValueError(f"unknown transform {kind!r}; there are {', '.join(kinds)}")
    return df.withColumn(out, kinds[kind](F.col(col), **options))


def smooth(df: DataFrame, col: str, out: str, span: int = 2) -> DataFrame:
    """Exponential smoothing of weight 2/(span+1), from the first value."""
    return per_symbol(df, {out: "double"}, lambda p: {out: K.ema(p[col].to_numpy(float), span)})


def frac_diff_fixed(df: DataFrame, col: str, out: str, d: float = 0.7, least: float = 1e-5) -> DataFrame:
    """Fractional difference over a fixed window: as many weights as are ``least`` or more. Null where the input is, or the window isn't full."""
    weights = K.frac_weights_above(d, least)

    def run(p: pd.DataFrame) -> dict[str, np.ndarray]:
        x = p[col].ffill().to_numpy(float)
        start = int(np.argmax(~np.isnan(x))) if (~np.isnan(x)).any() else len(x)
        made = np.full(len(x), np.nan)
        if len(x) - start >= len(weights):
            made[start + len(weights) - 1 :] = np.convolve(x[start:], weights[::-1], "valid")
        made[p[col].isna().to_numpy()] = np.nan
        return {out: made}

    return per_symbol(df, {out: "double"}, run)


def frac_diff_expanding(df: DataFrame, col: str, out: str, d: float = 0.7, threshold: float = 0.01) -> DataFrame:
    """Fractional difference over all values so far, from the bar on where the weights left out are a small share."""

    def run(p: pd.DataFrame) -> dict[str, np.ndarray]:
        n = len(p)
        w = K.frac_weights(d, n)
        share = np.cumsum(np.abs(w)) / np.abs(w).sum()
        skip = int((share > threshold).sum())
        x = p[col].ffill().to_numpy(float)
        start = int(np.argmax(~np.isnan(x))) if (~np.isnan(x)).any() else n
        made = np.full(n, np.nan)
        whole = np.convolve(x[start:], w[::-1])[: n - start] if n > start else np.zeros(0)
        made[start + skip :] = whole[skip:]
        made[p[col].isna().to_numpy()] = np.nan
        return {out: made}

    return per_symbol(df, {out: "double"}, run)


def running_vwap(price: Column, volume: Column, w: Window) -> Column:
    return F.try_divide(F.sum(price * volume).over(w), F.nullif(F.sum(volume).over(w), F.lit(0.0)))


def anchored_vwap(bars: DataFrame, lookback: int = 10, method: str = "rolling_window") -> DataFrame:
    """Volume-weighted mean prices from local bottoms and tops of the close.

    A bottom is lower than ``lookback`` closes on both sides (fewer at the ends, but at least one). Its price mean starts ``lookback`` + 1 bars later, when it
    can be known, and holds till the next one. Adds bottom_anchor, top_anchor, bottom_avwap, top_avwap.
    """
    if method == "directional_change":
        raise NotImplementedError(method)
    if method != "rolling_window":
        raise ValueError(f"unknown method {method!r}")
    before, after = W().rowsBetween(-lookback, -1), W().rowsBetween(1, lookback)
    price = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    out = bars
    for side, beyond in (("bottom", lambda c: (c < F.min("close").over(before)) & (c < F.min("close").over(after))), ("top", lambda c: (c > F.max("close").over(before)) & (c > F.max("close").over(after)))):
        out = out.withColumn(f"{side}_anchor", F.coalesce(beyond(F.col("close")).cast("int"), F.lit(0)))
        out = out.withColumn("_segment", F.sum(F.coalesce(prev(f"{side}_anchor", lookback + 1), F.lit(0))).over(W().rowsBetween(Window.unboundedPreceding, 0)))
        inside = Window.partitionBy("symbol", "_segment").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_vwap", F.when(F.col("_segment") > 0, running_vwap(price, F.col("volume"), inside)))
        out = out.withColumn(f"{side}_avwap", ffill("_vwap")).drop("_segment", "_vwap")
    return out


def _draw(n: Column, *keys: Column) -> Column:
    """A whole number from 1 to n, the same wherever it is computed."""
    return F.pmod(F.xxhash64(*keys), n) + 1


def bootstrap_bars(bars: DataFrame, seed: int = 0, replicate: int = 0) -> DataFrame:
    """Resample each symbol's bar shapes with replacement, with the same draws for all symbols, from its first bar on.

    Two draws for each step: one for the gap from close to open, one shared for high, low and close against the open. Symbols need
    equally many bars to share draws; a shorter symbol draws from its own. Closes are running sums, so no symbol is looped over.
    """
    n = F.count("*").over(_all())
    steps = bars.select("*", (F.row_number().over(W()) - 1).alias("step"), n.alias("n"), prev("close").alias("_before"), F.first("close").over(W().rowsBetween(Window.unboundedPreceding, 0)).alias("_start"))
    moves = steps.select("symbol", F.col("step").alias("_from"), (F.col("open") - F.col("_before")).alias("gap"), (F.col("high") - F.col("open")).alias("up"), (F.col("low") - F.col("open")).alias("down"), (F.col("close") - F.col("open")).alias("move"))
    draw = lambda k: F.when(F.col("n") > 1, _draw(F.greatest(F.col("n") - 1, F.lit(1)), F.lit(seed), F.lit(replicate), F.lit(k), F.col("step")))
    drawn = steps.select("symbol", "ts", "step", "volume", "_start", "open", "high", "low", "close", draw(1).alias("_a"), draw(2).alias("_b"))
    a = moves.select("symbol", F.col("_from").alias("_a"), F.col("gap").alias("_gap"))
    b = moves.select("symbol", F.col("_from").alias("_b"), F.col("up").alias("_up"), F.col("down").alias("_down"), F.col("move").alias("_move"))
    joined = drawn.join(a, ["symbol", "_a"], "left").join(b, ["symbol", "_b"], "left")
    first = F.col("step") == 0
    change = F.when(first, 0.0).otherwise(F.col("_gap") + F.col("_move"))
    closes = joined.withColumn("_close", F.col("_start") + F.sum(change).over(W().rowsBetween(Window.unboundedPreceding, 0)))
    opens = closes.withColumn("_open", prev("_close") + F.col("_gap"))
    pick = lambda old, new: F.when(first, F.col(old)).otherwise(new)
    return opens.select("symbol", "ts", pick("open", F.col("_open")).alias("open"), pick("high", F.col("_open") + F.col("_up")).alias("high"), pick("low", F.col("_open") + F.col("_down")).alias("low"), F.col("_close").alias("close"), "volume")


def bootstrap_prices(prices: DataFrame, col: str = "close", seed: int = 0, replicate: int = 0) -> DataFrame:
    """Resample each symbol's price changes with replacement, with the same draws for all symbols. Returns symbol, ts, and the price."""
    steps = prices.select("symbol", "ts", F.col(col).alias("_x"), (F.row_number().over(W()) - 1).alias("step"), F.count("*").over(_all()).alias("n"), (F.col(col) - prev(col)).alias("_change"), F.first(col).over(W().rowsBetween(Window.unboundedPreceding, 0)).alias("_start"))
    drawn = steps.withColumn("_a", F.when(F.col("n") > 1, _draw(F.greatest(F.col("n") - 1, F.lit(1)), F.lit(seed), F.lit(replicate), F.col("step"))))
    moves = steps.select("symbol", F.col("step").alias("_a"), F.col("_change").alias("_moved"))
    joined = drawn.join(moves, ["symbol", "_a"], "left")
    change = F.when(F.col("step") == 0, 0.0).otherwise(F.col("_moved"))
    return joined.select("symbol", "ts", (F.col("_start") + F.sum(change).over(W().rowsBetween(Window.unboundedPreceding, 0))).alias(col))
