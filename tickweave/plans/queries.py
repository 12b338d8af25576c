"""One query for each operator over the test tables, and the SQL of those that SQL can express.

Doubles are rounded to six places on both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.bars import daily_bars, hourly_bars
from tickweave.functions.columns import W, norm_cdf
from tickweave.operators import evaluate as E
from tickweave.operators import features as X
from tickweave.operators import indicators as I
from tickweave.operators import labels as L
from tickweave.operators import stats as S
from tickweave.plans.recursions import recursive_sql
from tickweave.sources import catalog as C
from tickweave.sources.synthetic import Distribution, synthetic_bars

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(f.name, places) + 0.0).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(_table(spark, sf_dir, "lineitem"))


def _flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(_table(spark, sf_dir, "lineitem"), "flag")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_bars(_table(spark, sf_dir, "events"))


def _on(source: Callable, step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(step(source(spark, sf_dir)))


def _indicator(source: Callable, kind: str, **parameters) -> Query:
    return _on(source, lambda b: I.add_indicator(b, kind, "value", **parameters).select("symbol", "ts", "value"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier(spark, sf_dir).select(F.col("symbol").alias("ticker"), F.col("ts").alias("date"), "open", "high", "low", "close", "volume")


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 nations and 5 regions
    return joined.select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("n_name").alias("sector"), F.col("r_name").alias("analyst_rating"), F.col("s_acctbal").alias("market_cap"))


def _pairs(bars: DataFrame) -> DataFrame:
    return E.next_open_returns(I.add_indicator(bars, "aroon", "value"), "value")


def _labelled(bars: DataFrame) -> DataFrame:
    return L.triple_barrier(bars, scale=False, pt_sl=10.0, n_days=5)


def _study_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of hourly event bars, a label from the next bar, and when it is known."""
    bars = I.add_indicator(I.add_indicator(_events(spark, sf_dir), "aroon", "f1", lookback=10), "stochastic", "f2", lookback=10, n_smooth=0)
    following = F.lead("close").over(W())
    made = bars.withColumn("y", F.when(following.isNotNull(), (following > F.col("close")).cast("int"))).withColumn("t1", F.coalesce(F.lead("ts").over(W()), "ts"))
    return made.select("symbol", "ts", "f1", "f2", "y", "t1")


def _one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study_frame(spark, sf_dir).withColumn("symbol", F.lit("all"))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "bars_daily": _supplier,
        "bars_hourly": _events,
        "price_scan": lambda s, d: C.scan_prices(_prices(s, d), ["1", "2", "3"], "1995-01-01", "1996-12-31", ["close", "volume"]),
        "latest_prices": lambda s, d: C.latest_prices(_prices(s, d)),
        "date_range": lambda s, d: C.date_range(_prices(s, d), "1"),
        "list_tickers": lambda s, d: C.list_tickers(_prices(s, d)),
        "metadata_filter": lambda s, d: rounded(C.filter_metadata(_metadata(s, d), filters={"analyst_rating": ["ASIA", "EUROPE"]})),
        "sectors": lambda s, d: C.distinct_values(_metadata(s, d), "sector"),
        "sample_symbols": lambda s, d: C.sample_symbols(_metadata(s, d), 5, min_market_cap=1.0, seed=3),
        "atr_sma": _on(_flag, lambda b: I.with_atr(b, 14).select("symbol", "ts", "atr")),
        "atr_expanding": _on(_flag, lambda b: I.with_atr(b, 14, kind="expanding").select("symbol", "ts", "atr")),
        "atr_ema": _on(_flag, lambda b: I.with_atr(b, 14, kind="ema").select("symbol", "ts", "atr")),
        "ema": _on(_flag, lambda b: X.smooth(b, "close", "value", 5).select("symbol", "ts", "value")),
        "norm_cdf": _on(_events, lambda b: b.select("symbol", "ts", norm_cdf((F.col("close") - 50) / 20).alias("value"))),
        "daily_volatility": _on(_flag, lambda b: S.daily_volatility(b, "vol", 20).select("symbol", "ts", "vol")),
        "jarque_bera": _on(_supplier, lambda b: S.jarque_bera(b, "close")),
        "dagostino": _on(_supplier, lambda b: S.jarque_bera(b, "close", "dagostino")),
        "relative_entropy": _on(_supplier, lambda b: S.relative_entropy(b, "close")),
        "range_iqr": lambda s, d: rounded(S.range_iqr(_supplier(s, d), "close"), 8),
        "quantile_bands": lambda s, d: rounded(S.quantile_bands(_supplier(s, d), "close"), 8),
        "discretize": _on(_flag, lambda b: S.discretize(b, "close", 5).select("symbol", "ts", "bin")),
        "mutual_information": _on(_flag, lambda b: S.lagged_mutual_information(b, "close", 5, 5)),
        "spearman": _on(_supplier, lambda b: S.spearman(b, "close", "volume")),
        "spearman_by_quartile": _on(_flag, lambda b: S.spearman_by_quartile(b, "close", "volume")),
        "adf": _on(_events, lambda b: S.adf_test(b, "close").drop("critical")),
        "pivots": _on(_flag, lambda b: S.pivots(b, 0.02)),
        "pivots_by_volatility": _on(_flag, lambda b: S.pivots(I.with_atr(b, 14), atr="atr")),
        "lowess": _on(_events, lambda b: S.lowess(b.withColumn("x", F.row_number().over(W()).cast("double")), "x", "close").select("symbol", "ts", "lowess")),
        "evaluation_report": _on(_events, lambda b: S.evaluation_report(b, "close").drop("nmi")),
        "transform_root": _on(_flag, lambda b: X.transform_column(b.withColumn("d", F.col("close") - F.col("open")), "d", "value", "root").select("symbol", "ts", "value")),
        "transform_log": _on(_flag, lambda b: X.transform_column(b.withColumn("d", F.col("close") - F.col("open")), "d", "value", "log").select("symbol", "ts", "value")),
        "transform_tanh": _on(_events, lambda b: X.transform_column(b, "close", "value", "tanh").select("symbol", "ts", "value")),
        "frac_diff_fixed": _on(_flag, lambda b: X.frac_diff_fixed(b, "close", "value", 0.7, 1e-3).select("symbol", "ts", "value")),
        "frac_diff_expanding": _on(_events, lambda b: X.frac_diff_expanding(b, "close", "value").select("symbol", "ts", "value")),
        "vwap_running": _on(_flag, lambda b: b.select("symbol", "ts", X.running_vwap((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4, F.col("volume"), W().rowsBetween(Window.unboundedPreceding, 0)).alias("value"))),
        "anchored_vwap_extrema": _on(_flag, lambda b: X.anchored_vwap(b, 10).select("symbol", "ts", "bottom_anchor", "top_anchor", "bottom_avwap", "top_avwap")),
        "bootstrap_bars": _on(_flag, lambda b: X.bootstrap_bars(b, seed=1)),
        "bootstrap_prices": _on(_flag, lambda b: X.bootstrap_prices(b, seed=1)),
        "inverse_cumsum_filter": _on(_flag, lambda b: L.inverse_cumsum_filter(b, "quiet", 0.01, 2).select("symbol", "ts", "quiet")),
        "event_sampling": _on(_flag, lambda b: L.event_sampling(b, "volatility_expansion", 50, 10, 1.2).select("symbol", "ts", "event_flag")),
        "flag_share": _on(_flag, lambda b: L.flag_share(L.event_sampling(b, "volatility_expansion", 50, 10, 1.2))),
        "add_sample_weights": _on(_supplier, lambda b: L.add_sample_weights(L.add_labels(b, scale=False, pt_sl=10.0, n_days=5)).select("symbol", "ts", "sample_weight")),
        "co_distribution": _on(_flag, lambda b: E.co_distribution(b, "close", "volume")[0]),
        "vertical_barrier": _on(_supplier, lambda b: L.vertical_barrier(b, "vb", 5).select("symbol", "ts", "vb")),
        "triple_barrier": _on(_supplier, _labelled),
        "triple_barrier_scaled": _on(_flag, lambda b: L.triple_barrier(b)),
        "add_labels": _on(_events, lambda b: L.add_labels(b, scale=False, pt_sl=10.0).select("symbol", "ts", "close", "hit_date", "bin", "returns")),
        "concurrency": _on(_supplier, lambda b: L.concurrency(b, _labelled(b))),
        "average_uniqueness": _on(_supplier, lambda b: L.average_uniqueness(b, _labelled(b))),
        "sample_weights": _on(_supplier, lambda b: L.sample_weights(b, _labelled(b))),
        "purged_folds": lambda s, d: E.purged_folds(_study_frame(s, d), 3, "t1", 0.01).select("symbol", "ts", "fold", "is_train", "is_test"),
        "threshold_study": _on(_flag, lambda b: E.threshold_study(_pairs(b), E.thresholds_for(_pairs(b), "indicator", 4))),
        "pooled_threshold_study": _on(_flag, lambda b: E.pooled_threshold_study(I.add_indicator(b, "aroon", "value"), "value", 5)),
        "distribution_study": _on(_events, lambda b: E.distribution_study(b, "close")),
        "optimal_threshold": _on(_flag, lambda b: E.optimal_threshold(_pairs(b))),
        "threshold_p_value": _on(_flag, lambda b: E.threshold_p_value(_pairs(b), replicates=200)),
        "cv_scores": lambda s, d: rounded(s.createDataFrame(list(enumerate(E.cv_scores(_one_series(s, d), ["f1", "f2"], "y", trees=10))), "fold int, score double")),
        "importance_mdi": lambda s, d: rounded(E.feature_importance_mdi(_one_series(s, d), ["f1", "f2"], "y", trees=20)),
        "importance_mda": lambda s, d: rounded(E.feature_importance_mda(_one_series(s, d), ["f1", "f2"], "y", trees=10)),
        "importance_sfi": lambda s, d: rounded(E.feature_importance_sfi(_one_series(s, d), ["f1", "f2"], "y", trees=10)),
        "performance": _on(_supplier, lambda b: E.performance(b)),
        "return_correlations": _on(_flag, lambda b: E.return_correlations(b)),
    }
    for name in (k.value for k in I.IndicatorType):
        q[name] = _indicator(_flag, name)
    q["stochastic_raw"] = _indicator(_flag, "stochastic", n_smooth=0)
    q["chaikin_money_flow_sma"] = _indicator(_flag, "chaikin_money_flow", return_cmf=True)
    q["macd_raw"] = _indicator(_flag, "macd", return_raw_macd=True)
    for kind in Distribution:
        q[f"synthetic_{kind.value}"] = lambda s, d, k=kind: rounded(synthetic_bars(s, ["A", "B"], k, 500, seed=7))
    return q


_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"


def _bars_sql(symbol: str) -> str:
    return f"""
        trades AS (SELECT {symbol} AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, l_extendedprice / l_quantity AS px, * FROM lineitem WHERE l_quantity <> 0),
        bars AS MATERIALIZED (SELECT symbol, ts, first(px ORDER BY {_ORDER}) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY {_ORDER}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume
            FROM trades GROUP BY symbol, ts)"""


SUPPLIER, FLAG = _bars_sql("CAST(l_suppkey AS VARCHAR)"), _bars_sql("l_returnflag || l_linestatus")
HOURLY = """
        bars AS MATERIALIZED (SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
            last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM (SELECT event_type, ts, value, event_id FROM events WHERE value IS NOT NULL) GROUP BY event_type, date_trunc('hour', ts))"""
PRICES = SUPPLIER + ", prices AS (SELECT symbol AS ticker, ts AS date, open, high, low, close, volume FROM bars)"
METADATA = "meta AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, n_name AS sector, r_name AS analyst_rating, s_acctbal AS market_cap FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_W = "(PARTITION BY symbol ORDER BY ts)"


def _r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0e0"


def _cdf(z: str) -> str:
    x = f"(({z}) / sqrt(2e0))"
    return f"(CASE WHEN {x} > 6 THEN 1e0 WHEN {x} < -6 THEN 0e0 ELSE (1e0 + exp(-{x} * {x}) * list_sum(list_transform(range(0, 120), lambda n: pow({x}, 2 * n + 1) * exp(-lgamma(n + 1.5e0))))) / 2e0 END)"


def _squash(z: str) -> str:
    return f"coalesce(100e0 * {_cdf(z)} - 50e0, 0e0)"


def _over(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _mean(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_over(n)} = {n} THEN avg({x}) OVER {_over(n)} END"


RANGED = f", pc AS (SELECT *, lag(close) OVER {_W} AS pc, row_number() OVER {_W} AS rn FROM bars), tr AS MATERIALIZED (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM pc)"


def _fold(start: str, step: str, state: str, source: str = "tr") -> str:
    """A recursion over bars: ``state`` names the columns, ``step`` may use b (the bar) and e (the state)."""
    return f", e AS (SELECT symbol, rn, {start} FROM {source} AS b WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, {step} FROM e JOIN {source} AS b ON b.symbol = e.symbol AND b.rn = e.rn + 1), out AS (SELECT b.*, {state} FROM {source} AS b JOIN e ON e.symbol = b.symbol AND e.rn = b.rn)"


def _ema_step(x: str, name: str, span: float) -> str:
    a = 2.0 / (span + 1)
    return f"{a!r}e0 * {x} + {1 - a!r}e0 * e.{name} AS {name}"


_SCALE = repr((0.5 * 19 + 5 - 0.5 * 4) ** 0.5) + "e0"
_LABELS = f""", labels AS (SELECT a.symbol, a.ts, a.close, coalesce((SELECT min(b.ts) FROM bars b WHERE b.symbol = a.symbol AND b.ts >= a.ts + INTERVAL 5 DAY), max(a.ts) OVER (PARTITION BY a.symbol)) AS vb FROM bars a),
    hits AS (SELECT l.symbol, l.ts, any_value(l.close) AS price, any_value(l.vb) AS vb, min(CASE WHEN p.close / l.close - 1 < -0.1e0 THEN p.ts END) AS sl, min(CASE WHEN p.close / l.close - 1 > 0.1e0 THEN p.ts END) AS pt
        FROM labels l JOIN bars p ON p.symbol = l.symbol AND p.ts BETWEEN l.ts AND l.vb GROUP BY l.symbol, l.ts),
    hit AS MATERIALIZED (SELECT h.symbol, h.ts, least(vb, coalesce(sl, vb), coalesce(pt, vb)) AS hit_date, sl IS NULL AND pt IS NULL AS timed, price FROM hits h),
    done AS MATERIALIZED (SELECT h.symbol, h.ts, h.hit_date, CASE WHEN timed THEN 0e0 ELSE sign(b.close / price - 1) END AS bin, b.close / price - 1 AS returns FROM hit h JOIN bars b ON b.symbol = h.symbol AND b.ts = h.hit_date)"""
_OPEN = ", counted AS MATERIALIZED (SELECT b.symbol, b.ts, count(*) AS n_open FROM bars b JOIN done d ON d.symbol = b.symbol AND b.ts BETWEEN d.ts AND d.hit_date GROUP BY b.symbol, b.ts)"
_RANKS = "rank() OVER (PARTITION BY {k} ORDER BY {a}) + (count(*) OVER (PARTITION BY {k}, {a}) - 1) / 2e0"


def _spearman(rows: str, keys: str, a: str, b: str) -> str:
    ranks = f"SELECT {keys}, {_RANKS.format(k=keys, a=a)} AS ra, {_RANKS.format(k=keys, a=b)} AS rb FROM ({rows})"
    return f"SELECT {keys}, count(*) AS n, {_r('CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)) END')} AS spearman FROM ({ranks}) GROUP BY {keys}"


def _aroon_sql() -> str:
    at = f"row_number() OVER {_W} - 1"
    w = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING)"
    aroon = f"num AS (SELECT *, {at} AS pos FROM bars), ar AS (SELECT *, CASE WHEN pos < 25 THEN 0e0 ELSE 100e0 * (max_by(pos, (high, -pos)) OVER {w} - min_by(pos, (low, pos)) OVER {w}) / 25 END AS value FROM num)"
    return aroon


AROON = _aroon_sql()
PAIRS = f"{AROON}, pairs AS MATERIALIZED (SELECT * FROM (SELECT symbol, ts, lag(value) OVER {_W} AS indicator, lead(open) OVER {_W} / open - 1 AS ret FROM ar) WHERE indicator IS NOT NULL AND ret IS NOT NULL)"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + "".join(parts)


def oracle_sql() -> dict[str, str]:
    value = lambda x, name="value": f"SELECT symbol, ts, {_r(x)} AS {name}"
    moments = ", m AS (SELECT symbol, CAST(count(*) AS DOUBLE) AS n, avg(close) AS mu FROM bars GROUP BY symbol), c AS (SELECT b.symbol, any_value(n) AS n, avg(pow(close - mu, 2)) AS m2, avg(pow(close - mu, 3)) AS m3, avg(pow(close - mu, 4)) AS m4 FROM bars b JOIN m USING (symbol) GROUP BY b.symbol), k AS (SELECT symbol, n, m3 / pow(m2, 1.5e0) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM c)"
    normal = lambda s: f" SELECT symbol, n, {_r('skew')} AS skew, {_r('kurt')} AS excess_kurtosis, {_r('stat')} AS statistic, {_r('exp(-stat / 2)')} AS p_value, exp(-stat / 2) > 0.05 AS is_normal FROM (SELECT *, {s} AS stat FROM k)"
    unbounded = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    logs = "ln(close)"
    change = f"(lag({logs}) OVER {_W} - lag({logs}, 5) OVER {_W}) / 4 - (lag({logs}) OVER {_W} - lag({logs}, 25) OVER {_W}) / 24"
    pco = "0.36e0 + 1e0 / 5 + 0.7e0 * ln(2.5e0) / 1.609e0"
    weights = "w AS (SELECT list(w ORDER BY k DESC) AS w FROM ff)"
    edges = "quantile_cont(close, [0e0, 0.2e0, 0.4e0, 0.6e0, 0.8e0, 1e0])"
    binned = f", q AS (SELECT symbol, {edges} AS e FROM bars GROUP BY symbol), binned AS MATERIALIZED (SELECT b.symbol, ts, CAST(least(len(list_filter(e, lambda x: x <= close)) - 1, 4) AS INTEGER) AS bin FROM bars b JOIN q USING (symbol))"
    pieces = lambda n: ", ".join(f"lead(bin, {k}) OVER {_W} AS b{k}" for k in range(1, n + 1))
    lags = " UNION ALL ".join(f"SELECT symbol, {k} AS lag, bin AS a, b{k} AS b FROM moved WHERE b{k} IS NOT NULL" for k in range(1, 6))
    anchors = []
    for side, f, op in (("bottom", "min", "<"), ("top", "max", ">")):
        anchors.append(f"CASE WHEN close {op} {f}(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AND close {op} {f}(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) THEN 1 ELSE 0 END AS {side}_anchor")
    price = "(open + high + low + close) / 4"
    segment = lambda s: f"sum(coalesce(l{s}, 0)) OVER {unbounded}"
    vwap = lambda s: f"CASE WHEN seg_{s} > 0 THEN sum({price} * volume) OVER (PARTITION BY symbol, seg_{s} ORDER BY ts ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER (PARTITION BY symbol, seg_{s} ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) END"
    sums = f", line AS MATERIALIZED (SELECT b.symbol, b.ts, {logs} - lag({logs}) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS ch, n_open FROM bars b LEFT JOIN counted c ON c.symbol = b.symbol AND c.ts = b.ts)"
    study = ", lim AS (SELECT symbol, min(indicator) AS lo, max(indicator) AS hi FROM pairs GROUP BY symbol), th AS (SELECT symbol, lo + (hi - lo) * (i / 5e0) AS threshold FROM lim, range(1, 5) t(i)), sided AS MATERIALIZED (SELECT p.*, t.threshold, CASE WHEN indicator > threshold THEN 'above' WHEN indicator < threshold THEN 'below' END AS side FROM pairs p JOIN th t USING (symbol))"
    rank_rows = f", ranked AS (SELECT *, {_RANKS.format(k='symbol, threshold, side', a='indicator')} AS ri, {_RANKS.format(k='symbol, threshold, side', a='ret')} AS rr FROM sided WHERE side IS NOT NULL)"
    per = ", one AS (SELECT symbol, threshold, side, count(*) AS n, CASE WHEN var_pop(ri) > 0 AND var_pop(rr) > 0 THEN covar_pop(ri, rr) / sqrt(var_pop(ri) * var_pop(rr)) END AS spearman, avg(ret) AS mean, stddev_samp(ret) AS std, quantile_cont(ret, 0.5e0) AS median, quantile_cont(ret, 0.25e0) AS q25, quantile_cont(ret, 0.75e0) AS q75, sum(CASE WHEN ret > 0 THEN ret END) AS g, -sum(CASE WHEN ret < 0 THEN ret END) AS l FROM ranked GROUP BY ALL), al AS (SELECT symbol, threshold, count(*) AS n FROM sided GROUP BY ALL)"
    def study_cols(r: Callable[[str], str]) -> str:
        cols = []
        for s in ("above", "below"):
            cols.append(f"{r(f'100e0 * coalesce({s}.n, 0) / al.n')} AS pct_{s}")
            cols += [f"{r(f'{s}.{c}')} AS {c}_{s}" for c in ("spearman", "mean", "std", "median", "q25", "q75")]
            cols += [f"{r(f'coalesce({s}.g / nullif({s}.l, 0), 0)')} AS pf_long_{s}", f"{r(f'coalesce({s}.l / nullif({s}.g, 0), 0)')} AS pf_short_{s}"]
        return ", ".join(cols)

    beside = "FROM al LEFT JOIN one above ON above.symbol = al.symbol AND above.threshold = al.threshold AND above.side = 'above' LEFT JOIN one below ON below.symbol = al.symbol AND below.threshold = al.threshold AND below.side = 'below'"
    study_out = f" SELECT al.symbol, {_r('al.threshold')} AS threshold, {study_cols(_r)} {beside}"
    study_names = [f"{c}_{s}" for s in ("above", "below") for c in ("pct", "spearman", "mean", "std", "median", "q25", "q75", "pf_long", "pf_short")]
    shared = ", th AS (SELECT symbol, unnest(t) AS threshold FROM (SELECT DISTINCT symbol FROM pairs), (SELECT quantile_cont(indicator, [1 / 6e0, 2 / 6e0, 3 / 6e0, 4 / 6e0, 5 / 6e0]) AS t FROM pairs))" + study[study.index(", sided AS") :]
    pooled = f", per AS (SELECT al.threshold, {study_cols(str)} {beside}) SELECT {_r('threshold')} AS threshold, {', '.join(_r(f'avg({c})') + f' AS {c}' for c in study_names)} FROM per GROUP BY per.threshold"
    rho = "rho AS (SELECT symbol, covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)) AS spearman FROM (SELECT symbol, " + _RANKS.format(k="symbol", a="indicator") + " AS ra, " + _RANKS.format(k="symbol", a="ret") + " AS rb FROM pairs) GROUP BY symbol)"
    keyed = "(PARTITION BY symbol ORDER BY signal, ts"
    best = f", sig AS (SELECT p.symbol, ts, spearman, CASE WHEN spearman < 0 THEN -indicator ELSE indicator END AS signal, ret FROM pairs p JOIN rho USING (symbol)), sw AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER {keyed}) - 1 AS i, lag(signal) OVER {keyed}) AS before, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) OVER {keyed} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / (sum(CASE WHEN ret > 0 THEN 0 ELSE -ret END) OVER {keyed} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1e-30) AS lg, sum(CASE WHEN ret > 0 THEN 0 ELSE -ret END) OVER {keyed} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / (sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) OVER {keyed} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-30) AS sh FROM sig), b AS (SELECT symbol, any_value(spearman) AS spearman, max_by(signal, (lg, -i)) FILTER (WHERE i = 0 OR (signal <> before AND n - i >= greatest(floor(n * 0.1e0), 1))) AS lt, max(lg) FILTER (WHERE i = 0 OR (signal <> before AND n - i >= greatest(floor(n * 0.1e0), 1))) AS lp, max_by(signal, (sh, -i)) FILTER (WHERE i > 0 AND signal <> before AND i >= greatest(floor(n * 0.1e0), 1)) AS st, max(sh) FILTER (WHERE i > 0 AND signal <> before AND i >= greatest(floor(n * 0.1e0), 1)) AS sp, max(signal) AS top FROM sw GROUP BY symbol)"
    stoch = "CASE WHEN rn - 1 < 14 THEN 50e0 ELSE coalesce(100e0 * (close - min(close) OVER W14) / nullif(max(close) OVER W14 - min(close) OVER W14, 0), 50e0) END"
    up, down, eps = "greatest(close - pc, 0e0)", "greatest(pc - close, 0e0)", "2.220446049250313e-16"
    seeds = f", seeded AS MATERIALIZED (SELECT *, sum(CASE WHEN rn BETWEEN 2 AND 14 THEN {up} END) OVER (PARTITION BY symbol) / 13 + {eps} AS su, sum(CASE WHEN rn BETWEEN 2 AND 14 THEN {down} END) OVER (PARTITION BY symbol) / 13 + {eps} AS sd FROM tr)"
    wilder = lambda x, n, s: f"CASE WHEN b.rn <= 14 THEN b.{s} ELSE (13 * e.{n} + {x.replace('close', 'b.close').replace('pc', 'b.pc')}) / 14 END AS {n}"
    rsi = seeds + _fold("b.su AS u, b.sd AS d", f"{wilder(up, 'u', 'su')}, {wilder(down, 'd', 'sd')}", "e.u, e.d", "seeded")
    reach = "greatest(high - low, high - pc, pc - low)"
    raw_intensity = f", pi AS MATERIALIZED (SELECT *, (close - open) / nullif(CASE WHEN pc IS NULL THEN high - low ELSE {reach} END, 0) AS raw FROM tr)"
    # a null keeps the mean, and the mean's weight decays until the next value
    a, k = f"{2 / 3!r}e0", f"{1 - 2 / 3!r}e0"
    intensity = _fold("b.raw AS v, CASE WHEN b.raw IS NULL THEN 0e0 ELSE 1e0 END AS wt", f"CASE WHEN b.raw IS NULL THEN e.v WHEN e.v IS NULL THEN b.raw ELSE (e.wt * {k} * e.v + {a} * b.raw) / (e.wt * {k} + {a}) END AS v, CASE WHEN b.raw IS NULL THEN e.wt * {k} ELSE 1e0 END AS wt", "e.v", "pi")
    k21 = f"{1 - 2 / 22!r}e0"
    cmma = _fold(
        f"ln(b.close) AS num, 1e0 AS den, b.tr AS rng", f"{k21} * e.num + ln(b.close) AS num, {k21} * e.den + 1 AS den, {_ema_step('b.tr', 'rng', 21)}", "e.num / e.den AS mean, e.rng"
    )
    cmf_ema = _fold("b.volume AS num, 1e0 AS den", f"{k21} * e.num + b.volume AS num, {k21} * e.den + 1 AS den", "e.num / e.den AS vol")
    flow = "coalesce(100e0 * ((2 * close - high - low) / nullif(high - low, 0)) * volume, 0e0)"
    macd = _fold("b.close AS s, b.close AS l", f"{_ema_step('b.close', 's', 5)}, {_ema_step('b.close', 'l', 20)}", "e.s, e.l")
    macd_value = f", atr AS (SELECT *, {_mean('tr', 25)} AS atr FROM out), mraw AS MATERIALIZED (SELECT symbol, ts, rn, {_squash(f'(s - l) / nullif(atr * {_SCALE}, 0)')} AS m FROM atr)"
    signal = f", g AS (SELECT symbol, rn, m AS v FROM mraw WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, {2 / 3!r}e0 * b.m + {1 - 2 / 3!r}e0 * g.v FROM g JOIN mraw b ON b.symbol = g.symbol AND b.rn = g.rn + 1)"
    move = ", dm AS MATERIALIZED (SELECT *, high - lag(high) OVER {w} AS hu, lag(low) OVER {w} - low AS ld FROM tr)".format(w=_W)
    moved = ", dir AS MATERIALIZED (SELECT *, CASE WHEN hu >= ld THEN greatest(hu, 0e0) ELSE 0e0 END AS up, CASE WHEN hu >= ld THEN 0e0 ELSE greatest(ld, 0e0) END AS dn, greatest(high - low, high - pc, pc - low) AS reach FROM dm)"
    keep = f"(CASE WHEN b.rn <= 14 THEN 1e0 ELSE {13 / 14!r}e0 END)"
    sums_adx = _fold("0e0 AS p, 0e0 AS m, 0e0 AS t", f"{keep} * e.p + b.up AS p, {keep} * e.m + b.dn AS m, {keep} * e.t + b.reach AS t", "e.p, e.m, e.t", "dir")
    dx = ", dx AS MATERIALIZED (SELECT symbol, ts, rn, CASE WHEN t = 0 OR p + m = 0 THEN 0e0 ELSE abs(p - m) / (p + m) END AS dx FROM out), first14 AS (SELECT symbol, sum(dx) / 14 AS s FROM dx WHERE rn BETWEEN 15 AND 28 GROUP BY symbol)"
    tail = f", a AS (SELECT symbol, CAST(28 AS BIGINT) AS rn, s AS v FROM first14 UNION ALL SELECT b.symbol, b.rn, {13 / 14!r}e0 * a.v + b.dx FROM a JOIN dx b ON b.symbol = a.symbol AND b.rn = a.rn + 1)"
    made = {
        "bars_daily": _with(SUPPLIER, " SELECT * FROM bars"),
        "bars_hourly": _with(HOURLY, " SELECT * FROM bars"),
        "price_scan": _with(PRICES, " SELECT ticker, date, close, volume FROM prices WHERE ticker IN ('1', '2', '3') AND date BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"),
        "latest_prices": _with(PRICES, " SELECT ticker, max(date) AS date, max_by(close, date) AS close, max_by(volume, date) AS volume FROM prices GROUP BY ticker"),
        "date_range": _with(PRICES, " SELECT min(date) AS first_date, max(date) AS last_date FROM prices WHERE ticker = '1'"),
        "list_tickers": _with(PRICES, " SELECT DISTINCT ticker FROM prices"),
        "metadata_filter": _with(METADATA, f" SELECT symbol, sector, analyst_rating, {_r('market_cap')} AS market_cap FROM meta WHERE analyst_rating IN ('ASIA', 'EUROPE')"),
        "sectors": _with(METADATA, " SELECT DISTINCT sector FROM meta WHERE sector IS NOT NULL"),
        "atr_sma": _with(FLAG, RANGED, f" {value(_mean('tr', 14), 'atr')} FROM tr"),
        "atr_expanding": _with(FLAG, RANGED, f" {value(f'CASE WHEN rn >= 14 THEN avg(tr) OVER {unbounded} END', 'atr')} FROM tr"),
        "atr_ema": _with(FLAG, RANGED, _fold("b.tr AS v", _ema_step("b.tr", "v", 14), "e.v"), f" {value('v', 'atr')} FROM out", recursive=True),
        "ema": _with(FLAG, RANGED, _fold("b.close AS v", _ema_step("b.close", "v", 5), "e.v"), f" {value('v')} FROM out", recursive=True),
        "norm_cdf": _with(HOURLY, f" {value(_cdf('(close - 50) / 20'))} FROM bars"),
        "jarque_bera": _with(SUPPLIER, moments, normal("n / 6 * (skew * skew + kurt * kurt / 4)")),
        "relative_entropy": _with(SUPPLIER, ", s AS (SELECT symbol, close AS x, min(close) OVER (PARTITION BY symbol) AS lo, max(close) OVER (PARTITION BY symbol) AS hi, count(*) OVER (PARTITION BY symbol) AS n FROM bars), t AS (SELECT *, CASE WHEN n >= 10000 THEN 20 WHEN n >= 1000 THEN 10 WHEN n >= 100 THEN 5 ELSE 3 END AS bins FROM s), c AS (SELECT symbol, n, bins, coalesce(least(floor((x - lo) / nullif(hi - lo, 0) * bins), bins - 1), 0) AS b, count(*) AS k FROM t GROUP BY 1, 2, 3, 4), e AS (SELECT symbol, n, bins, -sum(k / n * ln(k / n)) / ln(any_value(bins)) AS entropy FROM c GROUP BY symbol, n, bins)", f" SELECT symbol, n, bins, {_r('entropy')} AS entropy, CASE WHEN entropy < 0.2 THEN 'poor' WHEN entropy < 0.5 THEN 'fair' WHEN entropy < 0.8 THEN 'good' ELSE 'excellent' END AS quality FROM e"),
        "range_iqr": _with(SUPPLIER, ", s AS (SELECT symbol, count(close) AS n, max(close) - min(close) AS rng, quantile_cont(close, 0.75e0) - quantile_cont(close, 0.25e0) AS iqr FROM bars GROUP BY symbol)", f" SELECT symbol, n, {_r('rng', 8)} AS range, {_r('iqr', 8)} AS iqr, {_r('rng / nullif(iqr, 0)', 8)} AS ratio, CASE WHEN rng / nullif(iqr, 0) <= 3 THEN 'tight' WHEN rng / nullif(iqr, 0) <= 5 THEN 'usual' WHEN rng / nullif(iqr, 0) > 5 THEN 'wide' END AS quality FROM s"),
        "quantile_bands": _with(SUPPLIER, f" SELECT symbol, {_r('quantile_cont(close, 0.15e0)', 8)} AS low, {_r('quantile_cont(close, 0.85e0)', 8)} AS high FROM bars GROUP BY symbol"),
        "discretize": _with(FLAG, binned, " SELECT symbol, ts, bin FROM binned"),
        "mutual_information": _with(FLAG, binned, f", moved AS (SELECT symbol, ts, bin, {pieces(5)} FROM binned), pr AS ({lags}), c AS (SELECT symbol, lag, a, b, count(*) / sum(count(*)) OVER (PARTITION BY symbol, lag) AS p FROM pr GROUP BY symbol, lag, a, b), mg AS (SELECT *, sum(p) OVER (PARTITION BY symbol, lag, a) AS pa, sum(p) OVER (PARTITION BY symbol, lag, b) AS pb FROM c)", f" SELECT symbol, lag, {_r('greatest(0, 2 * sum(p * ln(p / (pa * pb))) / (-sum(p * ln(pa)) - sum(p * ln(pb))))')} AS nmi FROM mg GROUP BY symbol, lag"),
        "spearman": _with(SUPPLIER, " ", _spearman("SELECT * FROM bars", "symbol", "close", "volume")),
        "spearman_by_quartile": _with(FLAG, ", placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY close, ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars), q AS (SELECT *, 1 + CAST(pos >= n * 1 // 4 AS INT) + CAST(pos >= n * 2 // 4 AS INT) + CAST(pos >= n * 3 // 4 AS INT) AS quartile FROM placed), b AS (SELECT symbol, quartile, close, volume FROM q UNION ALL SELECT symbol, 0, close, volume FROM q) ", _spearman("SELECT * FROM b", "symbol, quartile", "close", "volume")),
        "transform_root": _with(FLAG, f" {value('sign(close - open) * pow(abs(close - open), 0.5e0)')} FROM bars"),
        "transform_log": _with(FLAG, f", d AS (SELECT *, close - open AS d, min(close - open) OVER (PARTITION BY symbol) AS m FROM bars) {value('ln(d + CASE WHEN m <= 0 THEN abs(m) + 1 ELSE 0 END)')} FROM d"),
        "transform_tanh": _with(HOURLY, f", d AS (SELECT *, quantile_cont(close, 0.5e0) OVER {unbounded} AS q5, quantile_cont(close, 0.85e0) OVER {unbounded} - quantile_cont(close, 0.15e0) OVER {unbounded} AS w FROM bars) {value('coalesce(CASE WHEN w = 0 THEN sign(close - q5) ELSE tanh((close - q5) / (w * 1.5e0)) END, 0)')} FROM d"),
        "frac_diff_fixed": _with("ff AS (SELECT 0 AS k, 1e0 AS w UNION ALL SELECT k + 1, -w * (0.7e0 - k) / (k + 1) FROM ff WHERE abs(w * (0.7e0 - k) / (k + 1)) >= 1e-3), ", weights + ", ", FLAG, f", l AS (SELECT symbol, ts, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN (SELECT len(w) - 1 FROM w) PRECEDING AND CURRENT ROW) AS x FROM bars) {value('CASE WHEN len(x) = len(w) THEN list_dot_product(x, w) END')} FROM l, w", recursive=True),
        "vwap_running": _with(FLAG, f" {value(f'sum({price} * volume) OVER {unbounded} / nullif(sum(volume) OVER {unbounded}, 0)')} FROM bars"),
        "anchored_vwap_extrema": _with(FLAG, f", a AS (SELECT *, {', '.join(anchors)} FROM bars), l AS (SELECT *, lag(bottom_anchor, 11) OVER {_W} AS lbottom, lag(top_anchor, 11) OVER {_W} AS ltop FROM a), s AS (SELECT *, {segment('bottom')} AS seg_bottom, {segment('top')} AS seg_top FROM l) SELECT symbol, ts, bottom_anchor, top_anchor, {_r(vwap('bottom'))} AS bottom_avwap, {_r(vwap('top'))} AS top_avwap FROM s"),
        "inverse_cumsum_filter": _with(FLAG, f" SELECT symbol, ts, coalesce(abs(close / lag(close, 2) OVER {_W} - 1) < 0.01e0, false) AS quiet FROM bars"),
        "vertical_barrier": _with(SUPPLIER, " SELECT symbol, ts, min(ts) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 5 DAY FOLLOWING AND UNBOUNDED FOLLOWING) AS vb FROM bars"),
        "triple_barrier": _with(SUPPLIER, _LABELS, f" SELECT symbol, ts, hit_date, {_r('bin')} AS bin, {_r('returns')} AS returns FROM done"),
        "concurrency": _with(SUPPLIER, _LABELS, _OPEN, " SELECT symbol, ts, n_open FROM counted"),
        "average_uniqueness": _with(SUPPLIER, _LABELS, _OPEN, f" SELECT d.symbol, d.ts, {_r('avg(1e0 / n_open)')} AS uniqueness FROM done d JOIN counted c ON c.symbol = d.symbol AND c.ts BETWEEN d.ts AND d.hit_date GROUP BY d.symbol, d.ts"),
        "sample_weights": _with(SUPPLIER, _LABELS, _OPEN, sums, f" SELECT d.symbol, d.ts, {_r('abs(sum(coalesce(ch, 0) / n_open))')} AS sample_weight FROM done d JOIN line c ON c.symbol = d.symbol AND c.ts BETWEEN d.ts AND d.hit_date GROUP BY d.symbol, d.ts"),
        "add_sample_weights": _with(SUPPLIER, _LABELS, _OPEN, sums, f", sw AS (SELECT d.symbol, d.ts, abs(sum(coalesce(ch, 0) / n_open)) AS w FROM done d JOIN line c ON c.symbol = d.symbol AND c.ts BETWEEN d.ts AND d.hit_date GROUP BY d.symbol, d.ts) SELECT b.symbol, b.ts, {_r('w')} AS sample_weight FROM bars b LEFT JOIN sw ON sw.symbol = b.symbol AND sw.ts = b.ts"),
        "purged_folds": _with(
            HOURLY, f", placed AS (SELECT symbol, ts, coalesce(lead(ts) OVER {_W}, ts) AS t1, row_number() OVER {_W} - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars)",
            ", rows3 AS MATERIALIZED (SELECT *, CAST(CASE WHEN pos < n % 3 * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE n % 3 + (pos - n % 3 * (n // 3 + 1)) // greatest(n // 3, 1) END AS INTEGER) AS mine FROM placed)",
            ", edges AS (SELECT symbol, mine AS fold, min(ts) AS s, max(t1) AS e, any_value(n) AS n FROM rows3 GROUP BY symbol, mine)",
            ", cut AS (SELECT *, coalesce((SELECT min(pos) FROM rows3 r WHERE r.symbol = edges.symbol AND r.ts >= edges.e), n) + floor(n * 0.01e0) AS again FROM edges)",
            ", used AS (SELECT r.symbol, r.ts, c.fold, mine <> c.fold AND (t1 <= c.s OR pos >= c.again) AS is_train, mine = c.fold AS is_test FROM rows3 r JOIN cut c ON c.symbol = r.symbol) SELECT * FROM used WHERE is_train OR is_test",
        ),
        "threshold_study": _with(FLAG, ", ", PAIRS, study, rank_rows, per, study_out),
        "pooled_threshold_study": _with(FLAG, ", ", PAIRS, shared, rank_rows, per, pooled),
        "optimal_threshold": _with(FLAG, ", ", PAIRS, ", ", rho, best, f" SELECT symbol, {_r('spearman')} AS spearman, {_r('lt')} AS long_threshold, {_r('lp')} AS long_pf, {_r('coalesce(st, top)')} AS short_threshold, {_r('coalesce(sp, -1)')} AS short_pf, {_r('greatest(lp, coalesce(sp, -1))')} AS best_pf FROM b"),
        "performance": _with(SUPPLIER, f", p AS (SELECT symbol, ts, close, close / lag(close) OVER {_W} - 1 AS r, close / max(close) OVER {unbounded} - 1 AS d FROM bars) SELECT symbol, {_r('max_by(close, ts) / min_by(close, ts) - 1')} AS total_return, {_r('stddev_samp(r) * sqrt(252e0)')} AS volatility, {_r('avg(r) * sqrt(252e0) / nullif(stddev_samp(r), 0)')} AS sharpe, {_r('min(d)')} AS max_drawdown FROM p GROUP BY symbol"),
        "return_correlations": _with(FLAG, f", r AS (SELECT * FROM (SELECT symbol, ts, close / lag(close) OVER {_W} - 1 AS r FROM bars) WHERE r IS NOT NULL) SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, {_r('covar_pop(x.r, y.r) / sqrt(var_pop(x.r) * var_pop(y.r))')} AS corr FROM r x JOIN r y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY ALL"),
        "rsi": _with(FLAG, RANGED, rsi, f" {value('CASE WHEN rn <= 14 THEN 0e0 WHEN u + d = 0 THEN 0e0 ELSE (100 * u / (u + d) - 50) / 10 END')} FROM out", recursive=True),
        "stochastic_raw": _with(FLAG, RANGED, f" {value(stoch)} FROM tr WINDOW W14 AS {_over(14)}"),
        "macd": _with(FLAG, RANGED, macd, macd_value, signal, f" SELECT r.symbol, r.ts, {_r('m - v')} AS value FROM mraw r JOIN g ON g.symbol = r.symbol AND g.rn = r.rn", recursive=True),
        "macd_raw": _with(FLAG, RANGED, macd, macd_value, f" {value('m')} FROM mraw", recursive=True),
        "adx": _with(FLAG, RANGED, move, moved, sums_adx, dx, tail, f" SELECT d.symbol, d.ts, {_r('CASE WHEN d.rn <= 28 THEN 100 * dx ELSE 100 * v END')} AS value FROM dx d LEFT JOIN a ON a.symbol = d.symbol AND a.rn = d.rn", recursive=True),
        "aroon": _with(FLAG, ", ", AROON, f" {value('value')} FROM ar"),
        "cmma": _with(FLAG, RANGED, cmma, f" {value(_squash('CASE WHEN rng > 0 THEN (ln(close) - mean) / (rng * sqrt(22e0)) ELSE 0 END'))} FROM out", recursive=True),
        "moving_average_difference": _with(FLAG, RANGED, f", ma AS (SELECT *, {_mean('close', 5)} AS s, {_mean('close', 20)} AS l, {_mean('tr', 25)} AS atr FROM tr), d AS (SELECT *, s - lag(l, 5) OVER {_W} AS d FROM ma) {value(_squash(f'1.5e0 * (d / nullif(atr * {_SCALE}, 0))'))} FROM d"),
        "price_change_oscillator": _with(FLAG, RANGED, f", c AS (SELECT *, {change} AS raw, {_mean('tr', 25)} AS atr FROM tr) {value(f'CASE WHEN rn - 1 < 25 THEN 0e0 ELSE ' + _squash(f'4e0 * raw / greatest(atr * ({pco}), 1e-8)') + ' END')} FROM c"),
        "price_intensity": _with(FLAG, RANGED, raw_intensity, intensity, f" {value(_squash('0.8e0 * sqrt(2e0) * v'))} FROM out", recursive=True),
        "chaikin_money_flow_sma": _with(FLAG, RANGED, f", f AS (SELECT *, {flow} AS fl FROM tr), g AS (SELECT *, {_mean('fl', 21)} AS a, {_mean('volume', 21)} AS v FROM f) {value('coalesce(a / nullif(v, 0), 0)')} FROM g"),
        "chaikin_money_flow": _with(FLAG, RANGED, cmf_ema, f", f AS (SELECT *, {flow} AS fl FROM out), g AS (SELECT *, {_mean('fl', 21)} AS a FROM f) {value('coalesce(a / nullif(vol, 0), 0)')} FROM g", recursive=True),
    }
    made["co_distribution"] = made["spearman_by_quartile"]
    return made | recursive_sql(FLAG, HOURLY, SUPPLIER, RANGED, _LABELS, moments, _r, _squash, _mean)
