"""Recursions over one symbol's bars, as numpy arrays in, array out. NaN is missing."""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)


def ema(x: np.ndarray, span: float, adjust: bool = False) -> np.ndarray:
    """Exponential mean of weight 2/(span+1); a missing value keeps the last mean, and older weights go on decaying."""
    a = 2.0 / (span + 1.0)
    out = np.full(len(x), np.nan)
    mean, weight = np.nan, 0.0
    for i, v in enumerate(x):
        if weight:
            weight *= 1 - a
        if v == v:
            if not weight:
                mean, weight = v, 1.0
            else:
                new = 1.0 if adjust else a
                mean = (weight * mean + new * v) / (weight + new)
                weight = weight + new if adjust else 1.0
        out[i] = mean
    return out


def ewm_std(x: np.ndarray, span: float) -> np.ndarray:
    """Exponential standard deviation with bias correction, of weights that sum over all values so far."""
    keep = 1 - 2.0 / (span + 1.0)
    w = w2 = s = q = 0.0
    base = np.nan
    out = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        w, w2, s, q = w * keep, w2 * keep * keep, s * keep, q * keep
        if v == v:
            if base != base:
                base = v
            d = v - base
            w, w2, s, q = w + 1, w2 + 1, s + d, q + d * d
        free = w * w - w2
        if free > 1e-14 * max(w * w, 1e-300):
            out[i] = np.sqrt(max(q / w - (s / w) ** 2, 0.0) * w * w / free)
    return out


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    filled = close.copy()
    for i in range(1, len(filled)):
        if filled[i] != filled[i]:
            filled[i] = filled[i - 1]
    before = np.concatenate([[np.nan], filled[:-1]]) if len(filled) else filled
    return np.where(np.isnan(before), high - low, np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before))))


def rsi(close: np.ndarray, period: int = 14) -> np.ndarray:
    """Wilder's relative strength, scaled to (value - 50) / 10; 0 for the first ``period`` bars."""
    n, out = len(close), np.zeros(len(close))
    if n <= 1:
        return out
    change = np.diff(close)
    seed = change[: period - 1]
    up = float(np.sum(seed[seed > 0])) / max(period - 1, 1) + _EPS
    down = float(-np.sum(seed[seed < 0])) / max(period - 1, 1) + _EPS
    for i in range(period, n):
        d = change[i - 1]
        up, down = ((period - 1) * up + (d if d > 0 else 0.0)) / period, ((period - 1) * down - (0.0 if d > 0 else d)) / period
        out[i] = 0.0 if up + down == 0 else (100.0 * up / (up + down) - 50) / 10
    return out


def stochastic(x: np.ndarray, lookback: int = 14, smooth: int = 2) -> np.ndarray:
    """Place within the rolling range, 0 to 100; smoothed once or twice. 50 before ``lookback`` and in flat windows."""
    n, out = len(x), np.full(len(x), 50.0)
    for i in range(lookback, n):
        window = x[i - lookback + 1 : i + 1]
        high, low = window.max(), window.min()
        if high == low:
            continue
        raw = 100 * (x[i] - low) / (high - low)
        if smooth == 0 or i == lookback:
            out[i] = raw
        elif smooth == 1 or i == lookback + 1:
            out[i] = 0.33333 * raw + 0.66667 * out[i - 1]
        else:
            out[i] = 0.33333 * (0.33333 * raw + 0.66667 * out[i - 1]) + 0.66667 * out[i - 2]
    return out


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, lookback: int = 14) -> np.ndarray:
    """Directional movement in three phases: sums, Wilder sums, and a smoothed sum that isn't divided by its weights."""
    n, out, keep = len(close), np.zeros(len(close)), (lookback - 1) / lookback
    plus = minus = spread = total = 0.0
    for i in range(1, n):
        up, down = high[i] - high[i - 1], low[i - 1] - low[i]
        up, down = (max(up, 0.0), 0.0) if up >= down else (0.0, max(down, 0.0))
        reach = max(high[i] - low[i], high[i] - close[i - 1], close[i - 1] - low[i])
        decay = 1.0 if i < lookback else keep
        plus, minus, spread = decay * plus + up, decay * minus + down, decay * spread + reach
        a, b = (plus / spread, minus / spread) if spread else (0.0, 0.0)
        dx = abs(a - b) / (a + b) if a + b else 0.0
        if i < lookback:
            out[i] = 100 * dx
        elif i < 2 * lookback:
            total += dx
            out[i] = 100 * dx
            if i == 2 * lookback - 1:
                total /= lookback
        else:
            total = keep * total + dx
            out[i] = 100 * total
    return np.nan_to_num(out, nan=0.0)


def detrended_rsi(close: np.ndarray, short: int = 2, long: int = 21, length: int = 120, rescale: bool = False) -> np.ndarray:
    """Residual of the short RSI, put through a logit, on the long one, over the window that ends one bar back."""
    n, out = len(close), np.zeros(len(close))
    y, x = rsi(close, short), rsi(close, long)
    if rescale:
        y, x = 10 * y + 50, 10 * x + 50
    with np.errstate(invalid="ignore", divide="ignore"):
        y = -10 * np.log(2 / (1 + 0.00999 * (2 * y - 100)) - 1)
    for i in range(length + long - 1, n):
        a, b = x[i - length : i], y[i - length : i]
        da, db = a - a.mean(), b - b.mean()
        out[i] = db[-1] - (da @ db) / (da @ da + 1e-10) * da[-1]
    return out


def pivots(series: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directional changes: at which bar each was recognised, and the bar of its extreme. The first valid bar always is one."""
    valid = np.flatnonzero((series != 0) & ~np.isnan(series))
    if not len(series):
        return np.zeros(0, int), np.zeros(0, int)
    first = int(valid[0]) if len(valid) else 0
    known, extreme = [first], [first]
    rest = valid[valid > first]
    up, at, value = True, first, series[first]
    for i in rest:
        change = (series[i] - value) / abs(value) if abs(value) >= 1e-10 else 0.0
        if abs(change) >= threshold[i] and abs(value) >= 1e-10:
            up = change > 0
            break
    for i in rest:
        v = series[i]
        if abs(value) < 1e-10:
            at, value = i, v
            continue
        step = 1.0 if up else -1.0
        if step * (v - value) > 0:
            at, value = i, v
        elif step * (v - value) / abs(value) < -threshold[i]:
            known.append(int(i))
            extreme.append(int(at))
            up, at, value = not up, i, v
    return np.array(known), np.array(extreme)


def legendre(n: int, degree: int) -> np.ndarray:
    x = np.linspace(-1, 1, n)
    if degree not in (1, 2, 3):
        raise ValueError("degree must be 1, 2 or 3")
    return {1: x, 2: (3 * x**2 - 1) / 2, 3: (5 * x**3 - 3 * x) / 2}[degree]


def unit_legendre(n: int, degree: int) -> np.ndarray:
    """Orthonormal polynomial of the degree over ``n`` points."""
    if degree not in (1, 2, 3):
        raise ValueError("degree must be 1, 2 or 3")
    x = np.linspace(-1, 1, n) if n > 1 else np.zeros(1)
    first = x / (np.linalg.norm(x) or 1.0)
    if degree == 1:
        return first
    c = first**degree
    c = c - c.mean()
    c = c / np.linalg.norm(c)
    if degree == 3:
        c = c - (c @ first) * first
        c = c / np.linalg.norm(c)
    return c


def regression_residual(log_close: np.ndarray, lookback: int, degree: int) -> np.ndarray:
    """Last residual over the root mean square residual of a fit with raw dot products on Legendre polynomials."""
    n, out = len(log_close), np.full(len(log_close), np.nan)
    basis = np.array([legendre(lookback, k) for k in range(1, degree + 1)])
    if n < lookback:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(log_close, lookback)
    fit = windows @ basis.T @ basis + windows.mean(1, keepdims=True)
    rest = windows - fit
    with np.errstate(invalid="ignore", divide="ignore"):
        out[lookback - 1 :] = rest[:, -1] / np.sqrt((rest**2).sum(1) / lookback)
    return out


def frac_weights(d: float, size: int) -> np.ndarray:
    """Binomial weights of fractional differencing, the oldest first."""
    w = [1.0]
    for k in range(1, size):
        w.append(-w[-1] * (d - k + 1) / k)
    return np.array(w[::-1])


def frac_weights_above(d: float, least: float) -> np.ndarray:
    w = [1.0]
    while True:
        following = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(following) < least:
            return np.array(w[::-1])
        w.append(following)
