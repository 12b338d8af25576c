"""Operators against straight-line re-derivations, and their edge cases."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.facade import Study
from tickweave.functions import kernels as K
from tickweave.functions.columns import erf
from tickweave.operators import evaluate as E
from tickweave.operators import features as X
from tickweave.operators import indicators as I
from tickweave.operators import labels as L
from tickweave.operators import stats as S

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def frame(symbols=("A", "B"), n=160, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0.001, 0.02, n)))
        open_ = np.concatenate([[100], close[:-1]]) * (1 + rng.normal(0, 0.003, n))
        high, low = np.maximum(open_, close) * (1 + rng.random(n) * 0.01), np.minimum(open_, close) * (1 - rng.random(n) * 0.01)
        for i in range(n):
            out.append((s, datetime(2023, 1, 2) + timedelta(days=i), open_[i], high[i], low[i], close[i], float(rng.integers(1000, 9000))))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    rows = frame()
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([tuple(x if not isinstance(x, np.generic) else x.item() for x in r) for r in rows], SCHEMA).repartition(3).cache()


def series(df, col, symbol="A"):
    return df.where(F.col("symbol") == symbol).toPandas().sort_values("ts").reset_index(drop=True)[col]


def test_erf(spark):
    import math

    for x in (0.0, 0.5, -1.3, 2.0, 5.5, 7.0, -9.0):
        assert abs(spark.range(1).select(erf(F.lit(x))).first()[0] - math.erf(x)) < 1e-12


def test_exponential_means_match_pandas():
    x = np.array([np.nan, 1.0, 4.0, np.nan, np.nan, 2.0, 8.0, 5.0])
    for adjust in (True, False):
        want = pd.Series(x).ewm(span=4, adjust=adjust).mean().to_numpy()
        assert np.allclose(K.ema(x, 4, adjust), want, equal_nan=True)
    assert np.allclose(K.ewm_std(x, 4), pd.Series(x).ewm(span=4).std().to_numpy(), equal_nan=True)


@pytest.mark.parametrize("kind", [k.value for k in I.IndicatorType])
def test_every_indicator_by_symbol(bars, kind):
    made = I.add_indicator(bars, kind, "value")
    both = series(made, "value")
    alone = series(I.add_indicator(bars.where("symbol = 'A'").repartition(1), kind, "value"), "value")
    assert len(both) == 160 and np.allclose(both, alone, equal_nan=True)
    if kind not in ("adx", "anchored_vwap", "chaikin_money_flow", "detrended_rsi", "macd"):
        assert both.abs().max() <= 100
    causal = I.add_indicator(bars.where(F.col("ts") < datetime(2023, 5, 1)), kind, "value")
    early = series(causal, "value")
    assert np.allclose(early, both[: len(early)], equal_nan=True)


def test_indicator_values(bars):
    p = bars.where("symbol = 'A'").toPandas().sort_values("ts").reset_index(drop=True)
    weights, logs = K.unit_legendre(21, 1), np.log(p.close.to_numpy())
    assert abs(np.linalg.norm(weights) - 1) < 1e-12
    tr = K.true_range(*(p[c].to_numpy() for c in ("high", "low", "close")))
    i = 100
    w = logs[i - 20 : i + 1]
    dot = w @ weights
    share = max(0, 1 - ((w - w.mean() - dot * weights) ** 2).sum() / ((w - w.mean()) ** 2).sum())
    from math import erf as exact

    want = 100 * (1 + exact(1.5 * dot * 2 / (tr[i - 62 : i + 1].mean() * 20) * share / 2**0.5)) / 2 - 50
    assert abs(series(I.add_indicator(bars, "regression_trend", "v"), "v")[i] - want) < 1e-8
    aroon = series(I.add_indicator(bars, "aroon", "v", lookback=10), "v")
    h, low = p.high[i - 10 : i].to_numpy(), p.low[i - 10 : i].to_numpy()
    assert aroon[i] == 100 * (h.argmax() - low.argmin()) / 10
    sto = K.stochastic(p.close.to_numpy(), 14, 0)
    assert np.allclose(series(I.add_indicator(bars, "stochastic", "v", n_smooth=0), "v"), sto)


def test_anchored_vwap_against_all_anchors(bars):
    p = bars.where("symbol = 'A'").toPandas().sort_values("ts").reset_index(drop=True)
    p.loc[40:60, "volume"] = 0.0
    spark = bars.sparkSession
    close, vol = p.close.to_numpy(), p.volume.to_numpy()
    price = ((p.open + p.high + p.low + p.close) / 4).to_numpy()
    atr = pd.Series(K.true_range(p.high.to_numpy(), p.low.to_numpy(), close)).rolling(14).mean().to_numpy()
    want = np.zeros(len(p))
    for a in K.pivots(close, np.full(len(p), 0.02))[0]:
        pv = v = 0.0
        for j in range(a + 1, len(p)):
            pv, v = pv + price[j] * vol[j], v + vol[j]
            if v > 0:
                want[j] = abs(close[j] - pv / v) / atr[j] if atr[j] > 0 else 0.0
    got = series(I.add_indicator(spark.createDataFrame(p, SCHEMA), "anchored_vwap", "v"), "v")
    assert np.allclose(got, want, atol=1e-9)


def test_registry(bars):
    assert len(I.list_indicators()) == 15 and I.is_registered("rsi") and not I.is_registered("nothing")
    with pytest.raises(KeyError):
        I.get_indicator("nothing")
    assert I.indicator_parameters("macd")["long_period"] == 20
    study = Study(bars)
    assert "x" in study.add_indicator("rsi", "x", period=5).columns
    study.df = bars.limit(0)
    with pytest.raises(ValueError):
        study.add_indicator("rsi", "x")
    with pytest.raises(TypeError):
        study.df = 3


def test_pivots_alternate_and_constant():
    x = np.array([100, 110, 99, 108.9, 98.01, 107.811] * 3)
    assert len(K.pivots(x, np.full(len(x), 0.05))[0]) >= 10
    assert K.pivots(np.full(5, 5.0), np.full(5, 0.01))[0].tolist() == [0]
    known, extreme = K.pivots(np.array([100, np.nan, 105, 0, 90, 101.0]), np.full(6, 0.05))
    assert known.tolist() == [0, 4, 5] and extreme.tolist() == [0, 2, 4]


def test_fractional_differences(bars):
    got = series(X.frac_diff_fixed(bars, "close", "v", 0.7, 1e-2), "v")
    w, p = K.frac_weights_above(0.7, 1e-2), series(bars, "close").to_numpy()
    assert got[: len(w) - 1].isna().all() and abs(got[len(w) + 5] - w @ p[6 : len(w) + 6]) < 1e-9
    wide = series(X.frac_diff_expanding(bars, "close", "v"), "v")
    full = K.frac_weights(0.7, len(p))
    assert abs(wide.iloc[-1] - full @ p) < 1e-9
    with pytest.raises(ValueError):
        X.transform_column(bars, "close", "v", "cube")


def test_bootstrap(bars):
    a, b = X.bootstrap_bars(bars, seed=5).cache(), X.bootstrap_bars(bars.repartition(5), seed=5)
    assert a.exceptAll(b).isEmpty() and a.count() == 320
    assert series(a, "close")[0] == series(bars, "close")[0]
    moved, real = np.diff(series(X.bootstrap_prices(bars, seed=5), "close")), np.diff(series(bars, "close"))
    assert all(np.abs(real - m).min() < 1e-9 for m in moved)


def test_triple_barrier_and_weights(bars):
    rows = bars.where("symbol = 'A'").toPandas().sort_values("ts").reset_index(drop=True)
    got = L.triple_barrier(bars, scale=False, pt_sl=2.0, n_days=3).where("symbol = 'A'").toPandas().sort_values("ts").reset_index(drop=True)
    for i in (0, 10, 77, 155, 158, 159):
        end = min(i + 3, 159)
        path = rows.close[i : end + 1] / rows.close[i] - 1
        over = path[(path > 0.02) | (path < -0.02)]
        hit = over.index[0] if len(over) else end
        assert got.hit_date[i] == rows.ts[hit] and abs(got.returns[i] - path[hit]) < 1e-12
        assert got.bin[i] == (np.sign(path[hit]) if len(over) else 0)
    events = L.triple_barrier(bars, scale=False, pt_sl=2.0, n_days=3)
    counts = series(L.concurrency(bars, events), "n_open")
    assert counts.sum() == sum((got.hit_date - got.ts).dt.days + 1)
    weight = L.sample_weights(bars, events).where("symbol = 'A'").toPandas().sort_values("ts").reset_index(drop=True)
    r = np.log(rows.close).diff().fillna(0)
    j = int((got.hit_date[20] - got.ts[20]).days)
    assert abs(weight.sample_weight[20] - abs((r[20 : 21 + j] / counts[20 : 21 + j]).sum())) < 1e-9
    labelled = L.add_sample_weights(L.add_labels(bars, scale=True))
    assert labelled.count() == 320 and {"bin", "sample_weight"} <= set(labelled.columns)
    with pytest.raises(ValueError):
        L.add_sample_weights(bars)
    with pytest.raises(ValueError):
        L.event_sampling(bars, "nothing")


def test_volatility_uses_the_bar_before_yesterday(bars):
    p = series(bars, "close")
    want = (p / p.shift(2) - 1).ewm(span=10).std().fillna(0.01)
    assert np.allclose(series(S.daily_volatility(bars, "v", 10), "v"), want)


def test_statistics(spark, bars):
    rng = np.random.default_rng(1)
    walk = np.cumsum(rng.normal(size=400))
    assert S.adf_of(walk)["p_value"] > 0.05 and S.adf_of(rng.normal(size=400))["p_value"] < 0.01
    assert S.adf_of(np.full(10, 2.0))["p_value"] is None and S.adf_of(np.array([1.0]))["p_value"] is None
    t0 = datetime(2024, 1, 1)
    flat = spark.createDataFrame([("C", t0 + timedelta(days=i), 5.0, float(i)) for i in range(30)] + [("D", t0, 1.0, None)], "symbol string, ts timestamp_ntz, x double, y double")
    jb = {r["symbol"]: r for r in S.jarque_bera(flat, "x").collect()}
    assert jb["C"]["statistic"] is None and jb["D"]["p_value"] is None
    assert S.range_iqr(flat, "x").where("symbol = 'C'").first()["ratio"] is None
    assert S.relative_entropy(flat, "x").where("symbol = 'C'").first()["entropy"] == 0
    assert S.spearman(flat, "y", "y").first()["spearman"] == pytest.approx(1.0)
    assert S.lagged_mutual_information(flat, "y", 2, 3).count() == 4 - 2
    x = np.linspace(0, 10, 60)
    assert np.allclose(S.lowess_of(x, 2 * x + 1, 0.3), 2 * x + 1)
    assert S.jarque_bera(bars, "close", "dagostino").count() == 2
    with pytest.raises(ValueError):
        S.jarque_bera(bars, "close", "nothing")
    report = S.evaluation_report(I.add_indicator(bars, "rsi", "v"), "v").collect()
    assert len(report) == 2 and set(report[0]["nmi"]) == set(range(1, 11))


def test_thresholds(spark, bars):
    pairs = E.next_open_returns(I.add_indicator(bars, "aroon", "v"), "v")
    study = E.threshold_study(pairs, E.thresholds_for(pairs, "indicator", 3, "percentile")).toPandas()
    assert len(study) == 6 and len(study.columns) == 20 and (study.pct_above + study.pct_below <= 100 + 1e-9).all()
    with pytest.raises(ValueError):
        E.thresholds_for(pairs, "indicator", 3, "nothing")
    t0 = datetime(2024, 1, 1)
    data = [("A", t0 + timedelta(days=i), float(s), float(r)) for i, (s, r) in enumerate([(1, -1), (2, -2), (3, 1), (4, 3), (5, 2), (5, -1)])]
    best = E.optimal_threshold(spark.createDataFrame(data, "symbol string, ts timestamp_ntz, indicator double, ret double"), min_kept=0.2).first()
    assert best["long_threshold"] == 3 and best["long_pf"] == pytest.approx(6.0)
    assert best["short_threshold"] == 2 or best["short_threshold"] == 3
    p = E.threshold_p_value(pairs, replicates=20).toPandas()
    assert p.p_value.between(0, 1).all()


def test_purged_folds_do_not_overlap(bars):
    rows = bars.where("symbol = 'A'").withColumn("t1", F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    folds = E.purged_folds(rows, 4, "t1", 0.02).toPandas()
    assert folds.is_test.sum() == 160
    for _, g in folds.groupby("fold"):
        test, train = g[g.is_test], g[g.is_train]
        clash = train[(train.ts < test.t1.max()) & (train.t1 > test.ts.min())]
        assert clash.empty
    with pytest.raises(ValueError):
        E.purged_folds(rows, 1)


def test_importance(bars):
    made = I.add_indicator(bars, "stochastic", "f1", n_smooth=0).withColumn("f2", (F.xxhash64("ts") % 100).cast("double"))
    made = made.withColumn("y", (F.col("f1") > 50).cast("int")).withColumn("t1", F.col("ts")).where("symbol = 'A'")
    mdi = {r["feature"]: r["mean"] for r in E.feature_importance_mdi(made, ["f1", "f2"], "y", trees=5).collect()}
    assert mdi["f1"] > (mdi["f2"] or 0) and sum(v or 0 for v in mdi.values()) == pytest.approx(1)
    mda = {r["feature"]: r["mean"] for r in E.feature_importance_mda(made, ["f1", "f2"], "y", scoring="accuracy", n_splits=2, trees=5).collect()}
    assert mda["f1"] > mda["f2"]
    scores = E.cv_scores(made, ["f1"], "y", scoring="accuracy", n_splits=2, trees=5)
    assert len(scores) == 2 and min(scores) > 0.8
    with pytest.raises(ValueError):
        E.cv_scores(made, ["f1"], "y", scoring="nothing")


def test_short_empty_and_flat_input(spark):
    t0 = datetime(2024, 1, 1)
    empty = spark.createDataFrame([], SCHEMA)
    flat = spark.createDataFrame([("A", t0 + timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(40)] + [("B", t0, 1.0, 1.0, 1.0, 1.0, 1.0)], SCHEMA)
    for kind in I.list_indicators():
        assert I.add_indicator(empty, kind, "v").count() == 0
        assert I.add_indicator(flat, kind, "v").count() == 41
    assert L.triple_barrier(empty).count() == 0 and L.triple_barrier(flat, scale=False).count() == 41
