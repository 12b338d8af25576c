"""Ordered window expressions, the normal distribution, and folds over a symbol's bars.

All windows share one (symbol, ts) specification, so several of them cost one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def W() -> WindowSpec:
    """A symbol's rows in order of time."""
    return Window.partitionBy("symbol").orderBy("ts")


DAY = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def roll(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or W()).rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], c: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    """The aggregate over the last ``n`` rows, null until there are ``n`` values."""
    c = col(c)
    return F.when(F.count(c).over(roll(n, w)) == n, agg(c).over(roll(n, w)))


def expanding(agg: Callable[[Column], Column], c: str | Column, at_least: int = 1, w: WindowSpec | None = None) -> Column:
    c, so_far = col(c), (w or W()).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(c).over(so_far) >= at_least, agg(c).over(so_far))


def ffill(c: str | Column, w: WindowSpec | None = None) -> Column:
    return F.last(col(c), ignorenulls=True).over((w or W()).rowsBetween(Window.unboundedPreceding, 0))


def prev(c: str | Column, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(c), n).over(w or W())


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def erf(x: Column) -> Column:
    """The error function by its series in exp(-x*x), to full precision; 1 beyond 6."""

    def step(acc: Column, k: Column) -> Column:
        term = acc["t"] * acc["q"] / (k + 1.5)
        return F.struct((acc["s"] + term).alias("s"), term.alias("t"), acc["q"].alias("q"))

    start = F.struct(x.alias("s"), x.alias("t"), (x * x).alias("q"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(119)), start, step, lambda acc: acc["s"] * F.exp(-acc["q"]) * (2 / math.sqrt(math.pi)))
    return F.when(x > 6, 1.0).when(x < -6, -1.0).when(x.isNotNull() & ~F.isnan(x), total)


def norm_cdf(z: Column) -> Column:
    return (erf(z / math.sqrt(2)) + 1) / 2


def squash(x: Column, factor: float = 1.0) -> Column:
    """100 times the normal distribution function less 50; null counts as 0."""
    return F.coalesce(100 * norm_cdf(x * factor) - 50, F.lit(0.0))


def per_symbol(df: DataFrame, out: dict[str, str], fn: Callable[[pd.DataFrame], dict[str, np.ndarray]], keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """``df`` with columns ``out`` (name: type), computed by ``fn`` from all rows of a symbol in order.

    For recursions that windows can't express. One shuffle by symbol; a task holds one symbol's rows, whose number is bounded
    by the calendar, not by the number of symbols. NaN becomes null.
    """
    kept = df.drop(*out)
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in out.items())).fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        for name, values in fn(pdf).items():
            pdf[name] = values
        return pdf

    return kept.groupBy(*keys).applyInPandas(run, schema)
