"""Seeded synthetic bars. Every draw is a hash of (symbol, step, seed, purpose), so results don't depend on partitions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.functions.columns import per_symbol, prev


class Distribution(str, Enum):
    NORMAL = "normal"
    LOG_NORMAL = "log_normal"
    STUDENT_T = "student_t"
    LAPLACE = "laplace"
    GBM = "geometric_brownian_motion"
    JUMP_DIFFUSION = "jump_diffusion"
    GARCH = "garch"
    REGIME_SWITCHING = "regime_switching"


@dataclass
class IntradayParams:
    gap_std: float = 0.002
    high_mean: float = 0.005
    high_std: float = 0.003
    low_mean: float = 0.005
    low_std: float = 0.003
    gamma: bool = True


@dataclass
class VolumeParams:
    base: float = 1_000_000
    std: float = 0.3
    trend: float = 0.0
    log_normal: bool = True
    weekday: bool = True


@dataclass
class MarketParams:
    open_hour: int = 9
    close_hour: int = 16


@dataclass
class ReturnParams:
    mean: float = 0.0005
    std: float = 0.02
    df: int = 5
    drift: float | None = None
    vol: float | None = None
    jump_rate: float = 0.1
    jump_mean: float = 0.0
    jump_std: float = 0.05
    omega: float = 0.00001
    alpha: float = 0.05
    beta: float = 0.9
    switch: float = 0.05
    regimes: tuple[tuple[float, float], tuple[float, float]] = ((0.001, 0.01), (-0.001, 0.03))
    extra: dict = field(default_factory=dict)


def _unit(seed: int, purpose: str, *more: object) -> Column:
    key = F.xxhash64(F.col("symbol"), F.col("step"), F.lit(seed), F.lit(purpose), *[F.lit(str(m)) for m in more])
    return (F.shiftrightunsigned(key, 11).cast("double") + 0.5) * 2.0**-53


def _normal(seed: int, purpose: str, *more: object) -> Column:
    """Standard normal, by the Box-Muller transform."""
    return F.sqrt(-2 * F.ln(_unit(seed, purpose, "r", *more))) * F.cos(2 * math.pi * _unit(seed, purpose, "a", *more))


def calendar(spark: SparkSession, symbols: list[str], periods: int, freq: str = "D", start: str = "2020-01-01", market: MarketParams | None = None) -> DataFrame:
    """(symbol, step, ts): business days ("D"), hours ("H"), or minutes within market hours ("T")."""
    market = market or MarketParams()
    ids = spark.createDataFrame([(s,) for s in symbols], "symbol string").crossJoin(F.broadcast(spark.range(periods).withColumnRenamed("id", "step")))
    day0 = F.to_date(F.lit(start))
    if freq in ("D", "T"):
        per = 1 if freq == "D" else (market.close_hour - market.open_hour) * 60
        nth = F.floor(F.col("step") / per)
        offset = F.weekday(day0)
        first = F.when(offset >= 5, F.date_add(day0, 7 - offset)).otherwise(day0)
        at = nth + F.weekday(first)
        day = F.date_add(F.date_sub(first, F.weekday(first)), (F.floor(at / 5) * 7 + at % 5).cast("int"))
        minute = (F.col("step") % per + market.open_hour * 60) if freq == "T" else F.lit(0)
        ts = F.timestamp_micros((F.unix_date(day).cast("long") * 86_400 + minute * 60) * 1_000_000)
    elif freq == "H":
        ts = F.timestamp_micros((F.unix_date(day0).cast("long") * 86_400 + F.col("step") * 3600) * 1_000_000)
    else:
        raise ValueError(f"unknown frequency {freq!r}")
    return ids.select("symbol", "step", ts.cast("timestamp_ntz").alias("ts"))


def _returns(frame: DataFrame, kind: Distribution, p: ReturnParams, seed: int) -> DataFrame:
    z = _normal(seed, "return")
    if kind == Distribution.NORMAL:
        return frame.withColumn("r", p.mean + p.std * z)
    if kind == Distribution.LOG_NORMAL:
        return frame.withColumn("r", F.exp(math.log(1 + p.mean) - p.std**2 / 2 + p.std * z) - 1)
    if kind == Distribution.STUDENT_T:
        if p.df <= 2:
            raise ValueError("df must be over 2")
        chi = sum((_normal(seed, "chi", k) ** 2 for k in range(p.df)), F.lit(0.0))
        return frame.withColumn("r", p.mean + p.std * z / F.sqrt(chi / p.df) / math.sqrt(p.df / (p.df - 2)))
    if kind == Distribution.LAPLACE:
        u = _unit(seed, "return") - 0.5
        return frame.withColumn("r", p.mean - p.std / math.sqrt(2) * F.signum(u) * F.ln(1 - 2 * F.abs(u)))
    if kind == Distribution.GBM:
        drift, vol = p.drift or p.mean, p.vol or p.std
        return frame.withColumn("r", drift - vol**2 / 2 + vol * z)
    if kind == Distribution.JUMP_DIFFUSION:
        # the number of jumps by the inverse of the Poisson distribution; k jumps sum to a normal of k times the mean and variance
        term, total, u, jumps = math.exp(-p.jump_rate), math.exp(-p.jump_rate), _unit(seed, "jumps"), F.lit(0)
        for k in range(1, int(p.jump_rate + 10 * math.sqrt(p.jump_rate) + 10)):
            jumps = jumps + (u > total).cast("int")
            term *= p.jump_rate / k
            total += term
        return frame.withColumn("_k", jumps).withColumn("r", p.mean + p.std * z + F.col("_k") * p.jump_mean + F.sqrt("_k") * p.jump_std * _normal(seed, "jump")).drop("_k")
    if kind == Distribution.GARCH:

        def fold(bars: pd.DataFrame) -> dict[str, np.ndarray]:
            v, out = p.omega / max(1 - p.alpha - p.beta, 1e-9), []
            for e in bars["_z"]:
                r = math.sqrt(v) * e
                out.append(p.mean + r)
                v = p.omega + p.alpha * r * r + p.beta * v
            return {"r": np.array(out)}

        return per_symbol(frame.withColumn("_z", z), {"r": "double"}, fold, order="step").drop("_z")
    flips = F.sum((_unit(seed, "switch") < p.switch).cast("int")).over(Window.partitionBy("symbol").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    (m0, s0), (m1, s1) = p.regimes
    return frame.withColumn("_on", flips % 2).withColumn("r", F.when(F.col("_on") == 0, m0 + s0 * z).otherwise(m1 + s1 * z)).drop("_on")


def _spread(seed: int, side: str, mean: float, std: float, gamma: bool) -> Column:
    """A positive spread: normal cut off at 0.001, or near gamma by the cube of a normal (Wilson and Hilferty 1931)."""
    z = _normal(seed, side)
    if not gamma:
        return F.greatest(mean + std * z, F.lit(0.001))
    shape = (mean / std) ** 2
    return mean * F.pow(F.greatest(1 - 1 / (9 * shape) + z / (3 * math.sqrt(shape)), F.lit(0.0)), F.lit(3.0))


def synthetic_bars(
    spark: SparkSession, symbols: list[str] | str = "SYN", distribution: Distribution | str = Distribution.NORMAL, periods: int = 252, freq: str = "D", start: str = "2020-01-01", start_price: float = 100.0,
    seed: int = 0, returns: ReturnParams | None = None, intraday: IntradayParams | None = None, volume: VolumeParams | None = None, market: MarketParams | None = None,
) -> DataFrame:
    """Bars of made-up prices: returns by ``distribution``, closes as the exponential of their sums, opens with gaps, spreads, and volumes."""
    try:
        kind = Distribution(distribution)
    except ValueError:
        raise ValueError(f"unknown distribution {distribution!r}") from None
    p, i, v = returns or ReturnParams(), intraday or IntradayParams(), volume or VolumeParams()
    frame = _returns(calendar(spark, [symbols] if isinstance(symbols, str) else symbols, periods, freq, start, market), kind, p, seed)
    so_far = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.withColumn("close", start_price * F.exp(F.sum("r").over(so_far)))
    frame = frame.withColumn("open", F.coalesce(prev("close") * (1 + i.gap_std * _normal(seed, "gap")), F.col("close")))
    frame = frame.withColumn("high", F.greatest(F.col("close") * (1 + _spread(seed, "high", i.high_mean, i.high_std, i.gamma)), "open", "close"))
    frame = frame.withColumn("low", F.least(F.col("close") * (1 - _spread(seed, "low", i.low_mean, i.low_std, i.gamma)), "open", "close"))
    base = v.base * (1 + v.trend * F.col("step") / periods)
    size = base * F.exp(v.std * _normal(seed, "volume") - v.std**2 / 2) if v.log_normal else F.greatest(base * (1 + v.std * _normal(seed, "volume")), base * 0.1)
    if v.weekday:
        size = size * F.when(F.weekday("ts").isin(0, 4), 0.8).otherwise(1.0)
    return frame.select("symbol", "ts", "open", "high", "low", "close", size.cast("long").cast("double").alias("volume"))
