"""Statistics of series: distribution, stationarity, information, rank correlation. One row a symbol unless said otherwise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions import kernels as K
from tickweave.functions.columns import DAY, W, micros, per_symbol

#: Response surfaces for the Dickey-Fuller statistic with a constant (MacKinnon 1994 and 2010).
_P_SMALL, _P_LARGE, _P_SWITCH, _P_MIN, _P_MAX = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61, -18.83, 2.74
_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def bins_for(n: Column) -> Column:
    """Bins of a histogram, by the number of values."""
    return F.when(n >= 10_000, 20).when(n >= 1000, 10).when(n >= 100, 5).otherwise(3)


def jarque_bera(df: DataFrame, col: str, method: str = "jarque_bera", alpha: float = 0.05) -> DataFrame:
    """Test of normality, by Jarque and Bera or by D'Agostino's K2. Null statistic for fewer than 2 values or constant ones."""
    if method not in ("jarque_bera", "dagostino"):
        raise ValueError(f"unknown method {method!r}")
    x = F.when(~F.isnan(F.col(col)), F.col(col))
    m = df.groupBy("symbol").agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"), F.var_pop(x).alias("v"))
    ok = (F.col("n") >= 2) & (F.col("v") > 0)
    if method == "jarque_bera":
        stat = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4)
    else:
        n, g, b2 = F.col("n"), F.col("skew"), F.col("kurt") + 3
        div = F.try_divide
        y = g * F.sqrt(div((n + 1) * (n + 3), 6 * (n - 2)))
        beta = div(3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3), (n - 2) * (n + 5) * (n + 7) * (n + 9))
        w2 = F.sqrt(2 * (beta - 1)) - 1
        z1 = div(F.lit(1.0), F.sqrt(F.ln(w2) / 2)) * F.asinh(div(y, F.sqrt(div(F.lit(2.0), w2 - 1))))
        e = 3 * (n - 1) / (n + 1)
        v = div(24 * n * (n - 2) * (n - 3), (n + 1) ** 2 * (n + 3) * (n + 5))
        x_ = div(b2 - e, F.sqrt(v))
        root = div(6 * (n * n - 5 * n + 2), (n + 7) * (n + 9)) * F.sqrt(div(6 * (n + 3) * (n + 5), n * (n - 2) * (n - 3)))
        a = 6 + div(F.lit(8.0), root) * (div(F.lit(2.0), root) + F.sqrt(1 + div(F.lit(4.0), root * root)))
        z2 = div(1 - div(F.lit(2.0), 9 * a) - F.cbrt(div(1 - div(F.lit(2.0), a), 1 + x_ * F.sqrt(div(F.lit(2.0), a - 4)))), F.sqrt(div(F.lit(2.0), 9 * a)))
        stat, ok = z1 * z1 + z2 * z2, ok & (n >= 4)
    out = m.withColumn("statistic", F.when(ok, stat)).withColumn("p_value", F.exp(-F.col("statistic") / 2))
    return out.select("symbol", "n", "skew", F.col("kurt").alias("excess_kurtosis"), "statistic", "p_value", (F.col("p_value") > alpha).alias("is_normal"))


def relative_entropy(df: DataFrame, col: str) -> DataFrame:
    """Entropy of an equal-width histogram over that of an even one, with a quality from 1 to 4."""
    w = Window.partitionBy("symbol")
    x = F.col(col)
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select("symbol", x.alias("x"), F.min(x).over(w).alias("low"), F.max(x).over(w).alias("high"), F.count("*").over(w).alias("n"))
    rows = rows.withColumn("bins", bins_for(F.col("n")))
    place = F.least(F.floor(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")) * F.col("bins")), F.col("bins") - 1)
    counts = rows.groupBy("symbol", "n", "bins", F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count("*").alias("k"))
    p = F.col("k") / F.col("n")
    out = counts.groupBy("symbol", "n", "bins").agg((-F.sum(p * F.ln(p)) / F.ln(F.first("bins").cast("double"))).alias("entropy"))
    quality = F.when(F.col("entropy") < 0.2, "poor").when(F.col("entropy") < 0.5, "fair").when(F.col("entropy") < 0.8, "good").otherwise("excellent")
    return out.withColumn("quality", quality)


def range_iqr(df: DataFrame, col: str) -> DataFrame:
    """Range over interquartile range: up to 3 is tight, up to 5 usual, else wide. Null where the quartiles are equal."""
    out = df.groupBy("symbol").agg((F.max(col) - F.min(col)).alias("range"), F.percentile(col, [0.25, 0.75]).alias("q"), F.count(col).alias("n"))
    out = out.withColumn("iqr", F.get("q", F.lit(1)) - F.get("q", F.lit(0))).withColumn("ratio", F.try_divide(F.col("range"), F.nullif(F.col("iqr"), F.lit(0.0))))
    return out.select("symbol", "n", "range", "iqr", "ratio", F.when(F.col("ratio") <= 3, "tight").when(F.col("ratio") <= 5, "usual").when(F.col("ratio") > 5, "wide").alias("quality"))


def quantile_bands(df: DataFrame, col: str, low: float = 0.15, high: float = 0.85) -> DataFrame:
    return df.groupBy("symbol").agg(F.percentile(col, low).alias("low"), F.percentile(col, high).alias("high"))


def discretize(df: DataFrame, col: str, bins: int, out: str = "bin") -> DataFrame:
    """Bin by quantile edges of the symbol: how many edges are at most the value, less one, at most bins - 1."""
    edges = F.percentile(col, [i / bins for i in range(bins + 1)]).over(Window.partitionBy("symbol"))
    place = F.size(F.filter("_edges", lambda e: e <= F.col(col))) - 1
    return df.withColumn("_edges", edges).withColumn(out, F.when(F.col(col).isNotNull(), F.least(place, F.lit(bins - 1)))).drop("_edges")


def lagged_mutual_information(df: DataFrame, col: str, lags: int = 10, bins: int = 10) -> DataFrame:
    """Normalised mutual information between binned values and those 1 to ``lags`` bars later. Returns symbol, lag, nmi."""
    made = discretize(df.where(F.col(col).isNotNull()), col, bins, "_a")
    ahead = made.select("symbol", "_a", *[F.lead("_a", k).over(W()).alias(f"_{k}") for k in range(1, lags + 1)])
    pairs = ahead.select("symbol", "_a", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("b")) for k in range(1, lags + 1)])).alias("_to"))
    cells = pairs.where("_to.b is not null").groupBy("symbol", F.col("_to.lag").alias("lag"), F.col("_a").alias("a"), F.col("_to.b").alias("b")).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy("symbol", "lag"))
    rows = cells.withColumn("p", F.col("n") / total).withColumn("pa", F.sum("n").over(Window.partitionBy("symbol", "lag", "a")) / total).withColumn("pb", F.sum("n").over(Window.partitionBy("symbol", "lag", "b")) / total)
    # a row is one of several cells of its a; p / pa shares that a's entropy among them
    parts = rows.groupBy("symbol", "lag").agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"), (-F.sum(F.col("p") * F.ln("pa"))).alias("ha"), (-F.sum(F.col("p") * F.ln("pb"))).alias("hb"))
    return parts.select("symbol", "lag", F.when(F.col("ha") + F.col("hb") < 1e-15, 1.0).otherwise(F.greatest(F.lit(0.0), 2 * F.col("mi") / F.nullif(F.col("ha") + F.col("hb"), F.lit(0.0)))).alias("nmi"))


def _average_rank(col: str, *keys: str) -> Column:
    return F.rank().over(Window.partitionBy(*keys).orderBy(col)) + (F.count("*").over(Window.partitionBy(*keys, col)) - 1) / 2


def _corr(a: str, b: str) -> Column:
    sa, sb = F.var_pop(a), F.var_pop(b)
    return F.when((sa > 0) & (sb > 0), F.covar_pop(a, b) / F.sqrt(sa * sb))


def spearman(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rank correlation with average ranks for ties, over rows where both are known."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.withColumn("_ra", _average_rank(a, *by)).withColumn("_rb", _average_rank(b, *by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), _corr("_ra", "_rb").alias("spearman"))


def spearman_by_quartile(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation overall (quartile 0) and within each quarter of the rows by the order of ``a`` (1 to 4)."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = F.count("*").over(Window.partitionBy("symbol"))
    at = F.row_number().over(Window.partitionBy("symbol").orderBy(a, "ts")) - 1
    placed = rows.withColumn("_at", at).withColumn("_n", n)
    quarter = F.lit(1)
    for k in (1, 2, 3):
        quarter = quarter + (F.col("_at") >= F.floor(F.col("_n") * k / 4)).cast("int")
    both = placed.withColumn("quartile", F.explode(F.array(F.lit(0), quarter)))
    return spearman(both, a, b, ("symbol", "quartile"))


def daily_volatility(df: DataFrame, out: str = "vol", span: int = 100, col: str = "close") -> DataFrame:
    """Exponential standard deviation of the return against the last bar more than a day before. 0.01 where unknown."""
    day = Window.partitionBy("symbol").orderBy(micros("ts")).rangeBetween(Window.unboundedPreceding, -(DAY + 1))
    back = df.withColumn("_ret", F.try_divide(F.col(col), F.last(col).over(day)) - 1)
    made = per_symbol(back, {out: "double"}, lambda p: {out: K.ewm_std(p["_ret"].to_numpy(float), span)})
    return made.withColumn(out, F.coalesce(out, F.lit(0.01))).drop("_ret")


def adf_of(x: np.ndarray, alpha: float = 0.05) -> dict[str, object]:
    """Augmented Dickey-Fuller test with a constant; the lag of the least Akaike criterion, up to 12 (n/100)^(1/4)."""
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    n = len(x)
    none = {"statistic": None, "p_value": None, "lags": None, "n_obs": n, "critical": None, "is_stationary": None, "decision": None}
    if n < 3 or np.ptp(x) == 0:
        return none
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    dx = np.diff(x)

    def fit(lags: int, rows: int) -> tuple[float, float, int]:
        y = dx[-rows:]
        design = [x[-rows - 1 : -1], *(dx[-rows - k : len(dx) - k] for k in range(1, lags + 1)), np.ones(rows)]
        a = np.column_stack(design)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        rest = y - a @ beta
        ss, free = float(rest @ rest), rows - a.shape[1]
        if ss <= 0 or free <= 0:
            return float("nan"), float("-inf"), rows
        error = math.sqrt(max(ss / free * np.linalg.pinv(a.T @ a)[0, 0], 1e-300))
        return float(beta[0]) / error, rows * (math.log(2 * math.pi * ss / rows) + 1) + 2 * a.shape[1], rows

    common = len(dx) - most
    best = min(range(most + 1), key=lambda k: fit(k, common)[1])
    stat, _, rows = fit(best, len(dx) - best)
    if stat != stat:
        return none
    z = np.polynomial.polynomial.polyval(stat, _P_SMALL if stat <= _P_SWITCH else _P_LARGE)
    p = 1.0 if stat > _P_MAX else 0.0 if stat < _P_MIN else 0.5 * (1 + math.erf(z / math.sqrt(2)))
    critical = {k: sum(b / rows**i for i, b in enumerate(bs)) for k, bs in _CRITICAL.items()}
    decision = "strongly stationary" if p < alpha and stat < critical["1%"] else "stationary" if p < alpha else "non-stationary"
    return {"statistic": stat, "p_value": p, "lags": best, "n_obs": rows, "critical": critical, "is_stationary": p < alpha, "decision": decision}


def adf_test(df: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    """Augmented Dickey-Fuller test of each symbol's series; nulls for series that are too short or constant."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        found = adf_of(p.sort_values("ts")[col].to_numpy(float), alpha)
        return pd.DataFrame([{"symbol": p["symbol"].iloc[0], **found}])

    return df.select("symbol", "ts", col).groupBy("symbol").applyInPandas(run, "symbol string, statistic double, p_value double, lags int, n_obs int, critical map<string,double>, is_stationary boolean, decision string")


def pivots(df: DataFrame, threshold: float | None = 0.02, atr: str | None = None, col: str = "close") -> DataFrame:
    """Directional changes: symbol, ts where it was recognised, ts of its extreme. The threshold is fixed, or ``atr`` over the price."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts", kind="stable")
        x = p[col].to_numpy(float)
        if atr is None:
            limit = np.full(len(x), abs(threshold))
        else:
            with np.errstate(invalid="ignore", divide="ignore"):
                limit = np.nan_to_num(p[atr].to_numpy(float) / np.abs(x), nan=0.01, posinf=0.01, neginf=0.01)
        known, extreme = K.pivots(x, limit)
        return pd.DataFrame({"symbol": p["symbol"].to_numpy()[known], "ts": p["ts"].to_numpy()[known], "extreme_ts": p["ts"].to_numpy()[extreme]})

    kind = df.schema["ts"].dataType.simpleString()
    cols = ["symbol", "ts", col, *([atr] if atr else [])]
    return df.select(*cols).groupBy("symbol").applyInPandas(run, f"symbol string, ts {kind}, extreme_ts {kind}")


def lowess_of(x: np.ndarray, y: np.ndarray, frac: float, passes: int = 3) -> np.ndarray:
    """Locally weighted lines with tricube weights and bisquare passes (Cleveland 1979), at each x."""
    n = len(x)
    k = min(max(int(round(frac * n)), 2), n)
    order = np.argsort(x, kind="stable")
    xs, ys, fit, robust = x[order], y[order], np.zeros(n), np.ones(n)
    for turn in range(passes + 1):
        left = 0
        for i in range(n):
            while left + k < n and xs[left + k] - xs[i] < xs[i] - xs[left]:
                left += 1
            xw, yw = xs[left : left + k], ys[left : left + k]
            reach = max(xs[i] - xw[0], xw[-1] - xs[i])
            w = (np.clip(1 - (np.abs(xw - xs[i]) / reach) ** 3, 0, None) ** 3 if reach > 0 else np.ones(k)) * robust[left : left + k]
            if w.sum() <= 0:
                fit[i] = ys[i]
                continue
            mx, my = np.average(xw, weights=w), np.average(yw, weights=w)
            sxx = (w * (xw - mx) ** 2).sum()
            fit[i] = my + ((w * (xw - mx) * (yw - my)).sum() / sxx * (xs[i] - mx) if sxx > 1e-12 else 0.0)
        if turn < passes:
            rest = ys - fit
            s = np.median(np.abs(rest))
            if s == 0:
                break
            robust = np.clip(1 - (rest / (6 * s)) ** 2, 0, None) ** 2
    out = np.empty(n)
    out[order] = fit
    return out


def lowess(df: DataFrame, x: str, y: str, out: str = "lowess", smoothing: float = 3) -> DataFrame:
    """Local regression of y on x by symbol, with a share of smoothing/10 of the rows at each place."""

    def run(p: pd.DataFrame) -> dict[str, np.ndarray]:
        a, b = p[x].to_numpy(float), p[y].to_numpy(float)
        ok = ~(np.isnan(a) | np.isnan(b))
        made = np.full(len(p), np.nan)
        if ok.sum() > 1:
            made[ok] = lowess_of(a[ok], b[ok], smoothing / 10)
        return {out: made}

    return per_symbol(df, {out: "double"}, run)


def evaluation_report(df: DataFrame, col: str) -> DataFrame:
    """All diagnostics of a series in one row a symbol; mutual information as a map from lag."""
    nmi = lagged_mutual_information(df, col).groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lag", "nmi")))).alias("nmi"))
    adf = adf_test(df, col).select("symbol", F.col("p_value").alias("adf_p"), "is_stationary")
    jb = jarque_bera(df, col).select("symbol", F.col("p_value").alias("jb_p"), "is_normal")
    entropy, spread = relative_entropy(df, col).select("symbol", "entropy"), range_iqr(df, col).select("symbol", F.col("ratio").alias("range_iqr"))
    return adf.join(jb, "symbol", "left").join(entropy, "symbol", "left").join(spread, "symbol", "left").join(nmi, "symbol", "left")


