"""Fifteen technical indicators and their registry.

An indicator is a function (bars, out, **parameters) -> bars with a double column ``out``, by symbol and in order of ts.
Those without a recursion are window expressions; the others run as folds by symbol.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions import kernels as K
from tickweave.functions.columns import W, expanding, ffill, per_symbol, prev, rolling, squash
from tickweave.operators.features import transform_column


class IndicatorType(str, Enum):
    RSI = "rsi"
    DETRENDED_RSI = "detrended_rsi"
    STOCHASTIC = "stochastic"
    STOCHASTIC_RSI = "stochastic_rsi"
    MACD = "macd"
    ADX = "adx"
    AROON = "aroon"
    CMMA = "cmma"
    MOVING_AVERAGE_DIFFERENCE = "moving_average_difference"
    PRICE_CHANGE_OSCILLATOR = "price_change_oscillator"
    PRICE_INTENSITY = "price_intensity"
    REGRESSION_TREND = "regression_trend"
    REGRESSION_TREND_DEVIATION = "regression_trend_deviation"
    CHAIKIN_MONEY_FLOW = "chaikin_money_flow"
    ANCHORED_VWAP = "anchored_vwap"


Builder = Callable[..., DataFrame]
_registry: dict[IndicatorType, Builder] = {}


def register_indicator(kind: IndicatorType) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        _registry[kind] = build
        return build

    return add


def get_indicator(kind: IndicatorType | str) -> Builder:
    try:
        return _registry[IndicatorType(kind)]
    except (KeyError, ValueError):
        raise KeyError(f"no indicator {kind!r}; there are {', '.join(list_indicators())}") from None


def is_registered(kind: IndicatorType | str) -> bool:
    return kind in {k.value for k in _registry} | set(_registry)


def list_indicators(verbose: bool = False) -> list[str] | dict[str, str]:
    names = sorted(k.value for k in _registry)
    return {n: (inspect.getdoc(_registry[IndicatorType(n)]) or "").split("\n")[0] for n in names} if verbose else names


def indicator_parameters(kind: IndicatorType | str) -> dict[str, object]:
    """Parameters of an indicator and their defaults."""
    sig = inspect.signature(get_indicator(kind))
    return {p.name: p.default for p in list(sig.parameters.values())[2:]}


def add_indicator(bars: DataFrame, kind: IndicatorType | str, out: str, transform: str | None = None, **parameters) -> DataFrame:
    """``bars`` with the indicator in column ``out``, and then transformed by "root", "log" or "tanh" if asked."""
    made = get_indicator(kind)(bars, out, **parameters)
    return made if transform is None else transform_column(made, out, out, transform)


def true_range() -> Column:
    """High less low, or the reach to the last known close before, if farther."""
    before = prev("_close")
    span = F.col("high") - F.col("low")
    return F.when(before.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def with_atr(bars: DataFrame, n: int, out: str = "atr", kind: str = "sma") -> DataFrame:
    """Average true range: over the last ``n`` bars ("sma"), all bars from the n-th on ("expanding"), or exponential ("ema")."""
    if n < 1:
        raise ValueError("the length must be at least 1")
    ranged = bars.withColumn("_close", ffill("close")).withColumn("_tr", true_range())
    if kind == "ema":
        ranged = per_symbol(ranged, {out: "double"}, lambda p: {out: K.ema(p["_tr"].to_numpy(float), n)})
    else:
        ranged = ranged.withColumn(out, expanding(F.avg, "_tr", n) if kind == "expanding" else rolling(F.avg, "_tr", n))
    return ranged.drop("_close", "_tr")


def _bar_number() -> Column:
    return F.row_number().over(W()) - 1


def _fold(bars: DataFrame, out: str, fn: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    return per_symbol(bars, {out: "double"}, lambda p: {out: fn(p)})


@register_indicator(IndicatorType.RSI)
def rsi(bars: DataFrame, out: str, period: int = 14) -> DataFrame:
    """Wilder's relative strength index, as (value - 50) / 10."""
    return _fold(bars, out, lambda p: K.rsi(p["close"].to_numpy(float), period))


@register_indicator(IndicatorType.DETRENDED_RSI)
def detrended_rsi(bars: DataFrame, out: str, short_period: int = 2, long_period: int = 21, regression_length: int = 120, rescale: bool = False) -> DataFrame:
    """Short RSI less its regression on the long RSI. ``rescale`` uses RSIs of 0 to 100."""
    return _fold(bars, out, lambda p: K.detrended_rsi(p["close"].to_numpy(float), short_period, long_period, regression_length, rescale))


@register_indicator(IndicatorType.STOCHASTIC)
def stochastic(bars: DataFrame, out: str, lookback: int = 14, n_smooth: int = 2) -> DataFrame:
    """Place of the close within its rolling range."""
    if n_smooth:
        return _fold(bars, out, lambda p: K.stochastic(p["close"].to_numpy(float), lookback, n_smooth))
    high, low = rolling(F.max, "close", lookback), rolling(F.min, "close", lookback)
    raw = F.try_divide(100 * (F.col("close") - low), F.nullif(high - low, F.lit(0.0)))
    return bars.withColumn(out, F.when(_bar_number() < lookback, 50.0).otherwise(F.coalesce(raw, F.lit(50.0))))


@register_indicator(IndicatorType.STOCHASTIC_RSI)
def stochastic_rsi(bars: DataFrame, out: str, rsi_period: int = 14, stochastic_period: int = 14, n_smooth: int = 2) -> DataFrame:
    """The stochastic of the RSI."""
    return _fold(bars, out, lambda p: K.stochastic(K.rsi(p["close"].to_numpy(float), rsi_period), stochastic_period, n_smooth))


def _difference_scale(short: int, long: int) -> float:
    return float(np.sqrt(0.5 * (long - 1) + short - 0.5 * (short - 1)))


def _over_range(top: Column, atr: str, factor: float) -> Column:
    return F.try_divide(top, F.nullif(F.col(atr) * factor, F.lit(0.0)))


@register_indicator(IndicatorType.MACD)
def macd(bars: DataFrame, out: str, short_period: int = 5, long_period: int = 20, smoothing_factor: int = 2, return_raw_macd: bool = False) -> DataFrame:
    """Difference of two exponential means over the range, less its own smoothed signal."""
    both = per_symbol(
        with_atr(bars, short_period + long_period, "_atr"), {"_diff": "double"},
        lambda p: {"_diff": K.ema(p["close"].to_numpy(float), short_period) - K.ema(p["close"].to_numpy(float), long_period)},
    )
    raw = both.withColumn(out, squash(_over_range(F.col("_diff"), "_atr", _difference_scale(short_period, long_period)))).drop("_diff", "_atr")
    return raw if return_raw_macd else _fold(raw.withColumnRenamed(out, "_raw"), out, lambda p: p["_raw"].to_numpy(float) - K.ema(p["_raw"].to_numpy(float), smoothing_factor)).drop("_raw")


@register_indicator(IndicatorType.ADX)
def adx(bars: DataFrame, out: str, lookback: int = 14) -> DataFrame:
    """Average directional index, with a last phase that grows to about ``lookback`` times 100."""
    return _fold(bars, out, lambda p: K.adx(p["high"].to_numpy(float), p["low"].to_numpy(float), p["close"].to_numpy(float), lookback))


@register_indicator(IndicatorType.AROON)
def aroon(bars: DataFrame, out: str, lookback: int = 25) -> DataFrame:
    """How much later the high of the ``lookback`` bars before came than their low, in per cent of them."""
    numbered = bars.withColumn("_at", _bar_number())
    w = W().rowsBetween(-lookback, -1)
    high = F.max_by("_at", F.struct("high", -F.col("_at"))).over(w)
    low = F.min_by("_at", F.struct("low", "_at")).over(w)
    return numbered.withColumn(out, F.when(F.col("_at") < lookback, 0.0).otherwise(100.0 * (high - low) / lookback)).drop("_at")


@register_indicator(IndicatorType.CMMA)
def cmma(bars: DataFrame, out: str, lookback: int = 21, atr_length: int = 21) -> DataFrame:
    """Log close less its exponential mean, over the exponential range."""

    def gap(p: pd.DataFrame) -> np.ndarray:
        logs = np.log(p["close"].to_numpy(float))
        scale = K.ema(K.true_range(*(p[c].to_numpy(float) for c in ("high", "low", "close"))), atr_length) * np.sqrt(lookback + 1)
        return np.where(scale > 0, (logs - K.ema(logs, lookback, adjust=True)) / np.where(scale > 0, scale, 1), 0.0)

    return _fold(bars, "_gap", gap).withColumn(out, squash(F.col("_gap"))).drop("_gap")


@register_indicator(IndicatorType.MOVING_AVERAGE_DIFFERENCE)
def moving_average_difference(bars: DataFrame, out: str, short_period: int = 5, long_period: int = 20) -> DataFrame:
    """Short mean less the long mean that ended before it, over the range."""
    means = with_atr(bars, short_period + long_period, "_atr").withColumn("_short", rolling(F.avg, "close", short_period)).withColumn("_long", rolling(F.avg, "close", long_period))
    diff = F.col("_short") - prev("_long", short_period)
    return means.withColumn(out, squash(_over_range(diff, "_atr", _difference_scale(short_period, long_period)), 1.5)).drop("_atr", "_short", "_long")


@register_indicator(IndicatorType.PRICE_CHANGE_OSCILLATOR)
def price_change_oscillator(bars: DataFrame, out: str, short_lookback: int = 5, long_lookback_multiplier: int = 5) -> DataFrame:
    """Mean log return of the last bars less that of more bars, both ending one bar back, over the range."""
    long = short_lookback * long_lookback_multiplier
    scale = 0.36 + 1 / short_lookback + 0.7 * float(np.log(0.5 * long_lookback_multiplier)) / 1.609
    logs = with_atr(bars, long, "_atr").withColumn("_log", F.ln("close")).withColumn("_at", _bar_number())
    last = prev("_log")
    raw = (last - prev("_log", short_lookback)) / (short_lookback - 1) - (last - prev("_log", long)) / (long - 1)
    return logs.withColumn(out, F.when(F.col("_at") < long, 0.0).otherwise(squash(raw / F.greatest(F.col("_atr") * scale, F.lit(1e-8)), 4.0))).drop("_atr", "_log", "_at")


@register_indicator(IndicatorType.PRICE_INTENSITY)
def price_intensity(bars: DataFrame, out: str, smoothing_factor: int = 2) -> DataFrame:
    """Smoothed move from open to close over the bar's reach."""
    before = prev("close")
    reach = F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.col("high") - before, before - F.col("low")))
    raw = bars.withColumn("_raw", F.try_divide(F.col("close") - F.col("open"), F.nullif(reach, F.lit(0.0))))
    return _fold(raw, "_mean", lambda p: K.ema(p["_raw"].to_numpy(float), smoothing_factor)).withColumn(out, squash(F.col("_mean"), 0.8 * float(np.sqrt(smoothing_factor)))).drop("_raw", "_mean")


def _dot(array: Column, weights: np.ndarray) -> Column:
    terms = F.zip_with(array, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


@register_indicator(IndicatorType.REGRESSION_TREND)
def regression_trend(bars: DataFrame, out: str, lookback: int = 21, atr_length_mult: int = 3, degree: int = 1) -> DataFrame:
    """Slope of log closes on a unit Legendre polynomial over the range, times the share of variance that it explains."""
    atr_length = lookback * atr_length_mult
    ranged = with_atr(bars, atr_length, "_atr") if atr_length >= 1 else with_atr(bars, lookback, "_atr", "expanding")
    front = max(lookback - 1, atr_length if atr_length >= 1 else lookback)
    weights = K.unit_legendre(lookback, degree)
    logs = ranged.withColumn("_log", F.ln("close")).withColumn("_at", _bar_number())
    w = W().rowsBetween(-(lookback - 1), 0)
    logs = logs.withColumn("_window", F.collect_list("_log").over(w))
    logs = logs.withColumn("_dot", F.when(F.size("_window") == lookback, _dot(F.col("_window"), weights))).withColumn("_mean", F.aggregate("_window", F.lit(0.0), lambda a, x: a + x) / lookback)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    centred = F.transform("_window", lambda x: x - F.col("_mean"))
    rest = F.zip_with(centred, F.array(*[F.lit(float(x)) for x in weights]), lambda d, c: d - F.col("_dot") * c)
    explained = F.greatest(1 - square(rest) / (square(centred) + 1e-60), F.lit(0.0))
    slope = F.col("_dot") * 2 / (F.col("_atr") * (2 if lookback == 2 else lookback - 1) + 1e-60)
    return logs.withColumn(out, F.when(F.col("_at") < front, 0.0).otherwise(squash(slope * explained, 1.5))).drop("_atr", "_log", "_at", "_window", "_dot", "_mean")


@register_indicator(IndicatorType.REGRESSION_TREND_DEVIATION)
def regression_trend_deviation(bars: DataFrame, out: str, lookback: int = 14, fit_degree: int = 1) -> DataFrame:
    """Last residual of the fit over the root mean square residual."""
    if fit_degree not in (1, 2, 3):
        raise ValueError("fit_degree must be 1, 2 or 3")
    return _fold(bars, "_z", lambda p: K.regression_residual(np.log(p["close"].to_numpy(float)), lookback, fit_degree)).withColumn(out, squash(F.col("_z"), 0.6)).drop("_z")


@register_indicator(IndicatorType.CHAIKIN_MONEY_FLOW)
def chaikin_money_flow(bars: DataFrame, out: str, smoothing_lookback: int = 21, volume_lookback: int = 21, return_cmf: bool = False) -> DataFrame:
    """Smoothed place of the close within the bar, by volume, over the mean volume (exponential unless ``return_cmf``)."""
    place = F.try_divide(2 * F.col("close") - F.col("high") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    flow = bars.withColumn("_flow", F.coalesce(100 * place * F.col("volume"), F.lit(0.0))).withColumn("_mean", rolling(F.avg, "_flow", smoothing_lookback))
    if return_cmf:
        flow = flow.withColumn("_volume", rolling(F.avg, "volume", volume_lookback))
    else:
        flow = _fold(flow, "_volume", lambda p: K.ema(p["volume"].to_numpy(float), volume_lookback, adjust=True))
    return flow.withColumn(out, F.coalesce(F.try_divide(F.col("_mean"), F.nullif(F.col("_volume"), F.lit(0.0))), F.lit(0.0))).drop("_flow", "_mean", "_volume")


@register_indicator(IndicatorType.ANCHORED_VWAP)
def anchored_vwap_distance(bars: DataFrame, out: str, threshold_value: float = 0.02, atr_period: int = 14, price_formula: str = "ohlc4") -> DataFrame:
    """Distance of the close from the volume-weighted mean price since the latest directional change, in ranges.

    One pass: bars after a change form a segment, with running sums. While a segment has no volume, the sums of the one before go on.
    """
    if price_formula not in ("ohlc4", "hlc3"):
        raise ValueError("price_formula must be 'ohlc4' or 'hlc3'")
    price = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4 if price_formula == "ohlc4" else (F.col("high") + F.col("low") + F.col("close")) / 3

    def changes(p: pd.DataFrame) -> dict[str, np.ndarray]:
        close = p["close"].to_numpy(float)
        flag = np.zeros(len(p), int)
        flag[K.pivots(close, np.full(len(p), abs(threshold_value)))[0]] = 1
        return {"_turn": flag}

    turned = per_symbol(with_atr(bars, atr_period, "_atr").withColumn("_pv", price * F.col("volume")), {"_turn": "int"}, changes)
    segment = F.coalesce(F.sum("_turn").over(W().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = turned.withColumn("_segment", segment)
    # a segment starts to count with its first volume; till then its bars belong to the one before
    live = F.max(F.when((F.col("volume") > 0) | (F.col("_segment") == 0), F.col("_segment"))).over(W().rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("_live", F.coalesce(live, F.lit(0)))
    inside = Window.partitionBy("symbol", "_live").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    vwap = F.try_divide(F.sum("_pv").over(inside), F.nullif(F.sum("volume").over(inside), F.lit(0.0)))
    distance = F.when(F.col("_live") == 0, 0.0).when(F.col("_atr") > 0, F.coalesce(F.abs(F.col("close") - vwap) / F.col("_atr"), F.lit(0.0))).otherwise(0.0)
    return cut.withColumn(out, distance).drop("_atr", "_pv", "_turn", "_segment", "_live")
