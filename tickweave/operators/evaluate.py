"""Evaluation of features: purged folds, importance, threshold studies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.columns import W, prev
from tickweave.operators import stats

_EPS = 1e-30


def purged_folds(df: DataFrame, n_splits: int = 3, t1: str = "t1", embargo: float = 0.0) -> DataFrame:
    """Rows with a fold as test set, and the train sets of all folds: columns fold, is_train, is_test, one row for each fold and row it uses.

    Folds are runs of rows in order of ts, the first n % k of them longer by one. A fold trains on rows that end (t1) by its start, and on rows from
    the place of its last end on, plus the embargo.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    n = F.count("*").over(Window.partitionBy("symbol"))
    rows = df.withColumn("_at", F.row_number().over(W()) - 1).withColumn("_n", n)
    size, more = F.floor(F.col("_n") / n_splits), F.col("_n") % n_splits
    fold = F.when(F.col("_at") < more * (size + 1), F.floor(F.try_divide(F.col("_at"), size + 1))).otherwise(more + F.floor(F.try_divide(F.col("_at") - more * (size + 1), F.greatest(size, F.lit(1)))))
    rows = rows.withColumn("_fold", fold.cast("int"))
    edges = rows.groupBy("symbol", "_fold").agg(F.min("ts").alias("_start"), F.max(t1).alias("_end"), F.max("_n").alias("_all"))
    # the place of the first row at or after the last end of the fold
    ends = edges.join(rows.select("symbol", F.col("ts").alias("_ts"), F.col("_at").alias("_place")), "symbol").where("_ts >= _end").groupBy("symbol", F.col("_fold").alias("fold")).agg(F.min("_place").alias("_from"))
    edges = edges.select("symbol", F.col("_fold").alias("fold"), "_start", "_all").join(ends, ["symbol", "fold"], "left").withColumn("_from", F.coalesce("_from", "_all") + F.floor(F.col("_all") * embargo))
    both = rows.join(edges, "symbol")
    test = F.col("_fold") == F.col("fold")
    train = ~test & ((F.col(t1) <= F.col("_start")) | (F.col("_at") >= F.col("_from")))
    return both.withColumn("is_test", test).withColumn("is_train", train).where("is_test or is_train").drop("_at", "_n", "_fold", "_start", "_all", "_from")


def _forest(trees: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, featureSubsetStrategy="sqrt", seed=seed, maxDepth=8)


def _prepared(df: DataFrame, features: list[str], label: str, weight: str | None) -> DataFrame:
    rows = df.where(F.col(label).isNotNull()).na.drop(subset=features)
    rows = rows.withColumn("_y", F.col(label).cast("double")).withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
    return VectorAssembler(inputCols=features, outputCol="_x").transform(rows)


def _score(model, rows: DataFrame, scoring: str) -> float:
    made = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="prediction", probabilityCol="probability", weightCol="_w", metricName="logLoss" if scoring == "neg_log_loss" else "accuracy")
    value = made.evaluate(model.transform(rows))
    return -value if scoring == "neg_log_loss" else value


def _check_scoring(scoring: str) -> None:
    if scoring not in ("neg_log_loss", "accuracy"):
        raise ValueError(f"unknown scoring {scoring!r}")


def cv_scores(df: DataFrame, features: list[str], label: str, weight: str | None = None, scoring: str = "neg_log_loss", n_splits: int = 3, t1: str = "t1", embargo: float = 0.0, trees: int = 100, seed: int = 42) -> list[float]:
    """Score of a random forest for each purged fold. A label is a class number from 0 on."""
    _check_scoring(scoring)
    folds = purged_folds(_prepared(df, features, label, weight), n_splits, t1, embargo).persist()
    out = []
    for k in range(n_splits):
        model = _forest(trees, seed).fit(folds.where((F.col("fold") == k) & F.col("is_train")))
        out.append(_score(model, folds.where((F.col("fold") == k) & F.col("is_test")), scoring))
    folds.unpersist()
    return out


def mean_decrease_impurity(model, features: list[str]) -> pd.DataFrame:
    """Mean and error of the trees' importances; a feature that a tree doesn't use isn't counted there; means sum to one."""
    raw = np.array([t.featureImportances.toArray() for t in model.trees])
    raw[raw == 0] = np.nan
    table = pd.DataFrame(raw, columns=features)
    out = pd.DataFrame({"feature": features, "mean": table.mean().to_numpy(), "std": (table.std() * len(table) ** -0.5).to_numpy()})
    out["mean"] /= out["mean"].sum()
    return out


def feature_importance_mdi(df: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 100, seed: int = 42) -> DataFrame:
    model = _forest(trees, seed).fit(_prepared(df, features, label, weight))
    return df.sparkSession.createDataFrame(mean_decrease_impurity(model, features), "feature string, mean double, std double")


def feature_importance_mda(df: DataFrame, features: list[str], label: str, weight: str | None = None, scoring: str = "neg_log_loss", n_splits: int = 3, t1: str = "t1", embargo: float = 0.0, trees: int = 100, seed: int = 42) -> DataFrame:
    """Loss of score when a feature's values are shuffled within the test set, as a share of the score there is to lose."""
    _check_scoring(scoring)
    folds = purged_folds(df.where(F.col(label).isNotNull()).na.drop(subset=features), n_splits, t1, embargo).persist()
    rows = []
    for k in range(n_splits):
        train = _prepared(folds.where((F.col("fold") == k) & F.col("is_train")), features, label, weight)
        test = folds.where((F.col("fold") == k) & F.col("is_test"))
        model = _forest(trees, seed).fit(train)
        base = _score(model, _prepared(test, features, label, weight), scoring)
        for f in features:
            w0, w1 = Window.partitionBy("symbol").orderBy("ts"), Window.partitionBy("symbol").orderBy(F.xxhash64(F.lit(seed), F.lit(f), "ts"), "ts")
            other = test.select("symbol", F.row_number().over(w1).alias("_k"), F.col(f).alias("_other"))
            mixed = test.withColumn("_k", F.row_number().over(w0)).join(other, ["symbol", "_k"]).withColumn(f, F.col("_other")).drop("_k", "_other")
            now = _score(model, _prepared(mixed, features, label, weight), scoring)
            lost = (base - now) / (-now if scoring == "neg_log_loss" else 1 - now) if (now if scoring == "neg_log_loss" else 1 - now) else 0.0
            rows.append((f, lost, base))
    folds.unpersist()
    table = pd.DataFrame(rows, columns=["feature", "lost", "base"])
    out = table.groupby("feature").agg(mean=("lost", "mean"), std=("lost", "std"), base_score=("base", "mean")).reset_index()
    out["std"] *= n_splits**-0.5
    return df.sparkSession.createDataFrame(out, "feature string, mean double, std double, base_score double")


def feature_importance_sfi(df: DataFrame, features: list[str], label: str, **options) -> DataFrame:
    """Cross-validated score of each feature alone: mean and population deviation."""
    rows = [(f, float(np.mean(s)), float(np.std(s))) for f in features for s in [cv_scores(df, [f], label, **options)]]
    return df.sparkSession.createDataFrame(rows, "feature string, mean double, std double")


def next_open_returns(df: DataFrame, indicator: str) -> DataFrame:
    """Pairs of last bar's indicator and the return from this open to the next; rows without one of them are left out."""
    ret = F.try_divide(F.lead("open").over(W()), F.col("open")) - 1
    return df.select("symbol", "ts", prev(indicator).alias("indicator"), ret.alias("ret")).na.drop(subset=["indicator", "ret"])


def thresholds_for(df: DataFrame, col: str, n: int, option: str = "linear", by: str = "symbol") -> DataFrame:
    """``n`` thresholds a group: inside the range at even steps, or at even percentiles."""
    if option not in ("linear", "percentile"):
        raise ValueError("option must be 'linear' or 'percentile'")
    places = [(i + 1) / (n + 1) for i in range(n)]
    if option == "percentile":
        made = df.groupBy(by).agg(F.percentile(col, places).alias("_t"))
    else:
        low, high = F.min(col), F.max(col)
        made = df.groupBy(by).agg(F.array(*[low + (high - low) * p for p in places]).alias("_t"))
    return made.select(by, F.explode("_t").alias("threshold"))


def _profit(gain: Column, loss: Column) -> Column:
    return F.coalesce(F.try_divide(gain, F.nullif(loss, F.lit(0.0))), F.lit(0.0))


def threshold_study(df: DataFrame, thresholds: DataFrame, indicator: str = "indicator", ret: str = "ret", by: str = "symbol") -> DataFrame:
    """For each threshold, and the rows over and under it: share, rank correlation, moments, quartiles, and profit factors.

    Rows meet the thresholds of their group in an equi-join, so the work is rows times thresholds; aggregates are combined before the shuffle.
    """
    rows = df.select(by, F.col(indicator).alias("_i"), F.col(ret).alias("_r")).join(F.broadcast(thresholds), by)
    side = F.when(F.col("_i") > F.col("threshold"), "above").when(F.col("_i") < F.col("threshold"), "below")
    keys = [by, "threshold", "_side"]
    ranked = rows.withColumn("_side", side)
    total = ranked.groupBy(by, "threshold").agg(F.count("*").alias("_all"))
    ranked = ranked.where("_side is not null").withColumn("_ri", stats._average_rank("_i", *keys)).withColumn("_rr", stats._average_rank("_r", *keys))
    gain, loss = F.sum(F.when(F.col("_r") > 0, F.col("_r"))), -F.sum(F.when(F.col("_r") < 0, F.col("_r")))
    q = F.percentile("_r", [0.25, 0.5, 0.75])
    one = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), stats._corr("_ri", "_rr").alias("spearman"), F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("std"),
        F.get(q, F.lit(1)).alias("median"), F.get(q, F.lit(0)).alias("q25"), F.get(q, F.lit(2)).alias("q75"), _profit(gain, loss).alias("pf_long"), _profit(loss, gain).alias("pf_short"),
    )
    out = total
    for s in ("above", "below"):
        part = one.where(F.col("_side") == s).drop("_side")
        out = out.join(part.select(by, "threshold", *[F.col(c).alias(f"{c}_{s}") for c in part.columns if c not in (by, "threshold")]), [by, "threshold"], "left")
    names = ["spearman", "mean", "std", "median", "q25", "q75", "pf_long", "pf_short"]
    cols = []
    for s in ("above", "below"):
        cols.append((100 * F.coalesce(f"n_{s}", F.lit(0)) / F.col("_all")).alias(f"pct_{s}"))
        cols += [F.coalesce(f"{c}_{s}", F.lit(0.0)).alias(f"{c}_{s}") if c.startswith("pf") else F.col(f"{c}_{s}") for c in names]
    return out.select(by, "threshold", *cols)


def pooled_threshold_study(df: DataFrame, indicator: str, n: int = 10) -> DataFrame:
    """Study of each symbol at percentile thresholds of all symbols together, then means by threshold."""
    pairs = next_open_returns(df, indicator)
    shared = thresholds_for(pairs.withColumn("_all", F.lit(0)), "indicator", n, "percentile", "_all").select("threshold")
    per = pairs.select("symbol").distinct().crossJoin(F.broadcast(shared))  # n thresholds for each symbol
    study = threshold_study(pairs, per)
    return study.groupBy("threshold").agg(*[F.avg(c).alias(c) for c in study.columns if c not in ("symbol", "threshold")])


def distribution_study(df: DataFrame, col: str) -> DataFrame:
    """Means over symbols of stationarity, normality, entropy and range over quartiles, to two places; unknown ones don't count."""
    report = stats.evaluation_report(df, col)
    mean = lambda c: F.round(F.avg(F.when(~F.isnan(c.cast("double")), c.cast("double"))), 2)
    return report.agg(mean(F.col("is_stationary").cast("int")).alias("adf"), mean(F.col("is_normal").cast("int")).alias("jb"), mean(F.col("entropy")).alias("entropy"), mean(F.col("range_iqr")).alias("range_iqr"))


def signed_pairs(df: DataFrame, indicator: str = "indicator", ret: str = "ret", flip: bool = False) -> DataFrame:
    """Pairs with the indicator's sign turned to agree with its rank correlation (or against it, with ``flip``)."""
    rho = stats.spearman(df, indicator, ret).select("symbol", "spearman")
    sign = F.when(F.coalesce("spearman", F.lit(0.0)) < 0, -1.0).otherwise(1.0) * (-1.0 if flip else 1.0)
    return df.join(F.broadcast(rho), "symbol").select("symbol", "ts", "spearman", (sign * F.col(indicator)).alias("signal"), F.col(ret).alias("ret"))


def optimal_threshold(df: DataFrame, indicator: str = "indicator", ret: str = "ret", min_kept: float = 0.1, flip: bool = False) -> DataFrame:
    """Thresholds of the best profit factors: long for signals from the threshold on, short for those under it.

    Running sums from both ends of the sorted signals give all profit factors in one pass. Equal signals are one threshold. Rows without
    a value don't count, but the least number kept is a share of all rows. Long begins with all rows; ties go to the lowest threshold.
    """
    rows = signed_pairs(df, indicator, ret, flip).withColumn("_all", F.count("*").over(Window.partitionBy("symbol")))
    rows = rows.withColumn("_least", F.greatest(F.floor(F.col("_all") * min_kept), F.lit(1))).na.drop(subset=["signal", "ret"])
    keys = Window.partitionBy("symbol").orderBy("signal", "ts")
    gain, loss = F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0), F.when(F.col("ret") > 0, 0.0).otherwise(-F.col("ret"))
    after = Window.partitionBy("symbol").orderBy(F.desc("signal"), F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)  # a frame to the end would be summed anew at each row
    before = keys.rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(Window.partitionBy("symbol"))
    swept = rows.select(
        "symbol", "spearman", "signal", "_least", n.alias("_n"), (F.row_number().over(keys) - 1).alias("_i"), F.lag("signal").over(keys).alias("_before"),
        (F.sum(gain).over(after) / (F.sum(loss).over(after) + _EPS)).alias("_long"), (F.sum(loss).over(before) / (F.sum(gain).over(before) + _EPS)).alias("_short"),
    )
    change = F.col("_i").cast("int") > 0
    new = change & (F.col("signal") != F.col("_before"))
    long_ok = (F.col("_i") == 0) | (new & (F.col("_n") - F.col("_i") >= F.col("_least")))
    short_ok = new & (F.col("_i") >= F.col("_least"))
    best = swept.groupBy("symbol").agg(
        F.first("spearman").alias("spearman"),
        F.max(F.when(long_ok, F.struct(F.col("_long").alias("pf"), (-F.col("_i")).alias("i"), "signal"))).alias("_l"),
        F.max(F.when(short_ok, F.struct(F.col("_short").alias("pf"), (-F.col("_i")).alias("i"), "signal"))).alias("_s"),
        F.max("signal").alias("_top"),
    )
    out = best.select("symbol", "spearman", F.col("_l.signal").alias("long_threshold"), F.col("_l.pf").alias("long_pf"), F.coalesce("_s.signal", "_top").alias("short_threshold"), F.coalesce("_s.pf", F.lit(-1.0)).alias("short_pf"))
    return out.withColumn("best_pf", F.greatest("long_pf", "short_pf"))


def _best_factor(signal: np.ndarray, ret: np.ndarray, least: int) -> float:
    n = len(ret)
    gain, loss = np.where(ret > 0, ret, 0), np.where(ret > 0, 0, -ret)
    up = np.cumsum(gain[::-1])[::-1] / (np.cumsum(loss[::-1])[::-1] + _EPS)
    down = np.concatenate([[0], np.cumsum(loss)[:-1]]) / (np.concatenate([[0], np.cumsum(gain)[:-1]]) + _EPS)
    at = np.arange(n)
    new = np.concatenate([[False], signal[1:] != signal[:-1]])
    long = up[(at == 0) | new & (n - at >= least)].max(initial=-1)
    return max(long, down[new & (at >= least)].max(initial=-1))


def threshold_p_value(df: DataFrame, indicator: str = "indicator", ret: str = "ret", min_kept: float = 0.1, flip: bool = False, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """Share of bootstrapped return series whose best profit factor is as good as the real one."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        name, least = p["symbol"].iloc[0], max(int(len(p) * min_kept), 1)
        p = p.dropna(subset=["signal", "ret"]).sort_values(["signal", "ts"], kind="stable")
        if not len(p):
            return pd.DataFrame({"symbol": [name], "p_value": [None]})
        s, r = p["signal"].to_numpy(float), p["ret"].to_numpy(float)
        rng, best = np.random.default_rng(seed), _best_factor(s, r, least)
        hits = sum(_best_factor(s, rng.choice(r, len(r)), least) >= best for _ in range(replicates))
        return pd.DataFrame({"symbol": [name], "p_value": [hits / replicates]})

    return signed_pairs(df, indicator, ret, flip).groupBy("symbol").applyInPandas(run, "symbol string, p_value double")


def co_distribution(df: DataFrame, a: str, b: str, smoothing: float = 3) -> tuple[DataFrame, DataFrame]:
    """Rank correlations by quartile, and the local regression of b on a."""
    return stats.spearman_by_quartile(df, a, b), stats.lowess(df, a, b, "lowess", smoothing)


def performance(df: DataFrame, col: str = "close", periods: int = 252) -> DataFrame:
    """Total return, annual volatility, Sharpe ratio and greatest drawdown of each symbol."""
    peak = F.max(col).over(W().rowsBetween(Window.unboundedPreceding, 0))
    rows = df.select("symbol", "ts", F.col(col).alias("x"), (F.try_divide(F.col(col), prev(col)) - 1).alias("r"), (F.try_divide(F.col(col), peak) - 1).alias("down"))
    year = math.sqrt(periods)
    return rows.groupBy("symbol").agg(
        (F.try_divide(F.max_by("x", "ts"), F.min_by("x", "ts")) - 1).alias("total_return"), (F.stddev_samp("r") * year).alias("volatility"),
        F.try_divide(F.avg("r") * year, F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("sharpe"), F.min("down").alias("max_drawdown"),
    )


def return_correlations(df: DataFrame, col: str = "close") -> DataFrame:
    """Correlation of returns for each pair of symbols, over the times that both have; symbols are few against bars."""
    r = df.select("symbol", "ts", (F.try_divide(F.col(col), prev(col)) - 1).alias("r")).na.drop()
    pairs = r.select(F.col("symbol").alias("a"), "ts", F.col("r").alias("x")).join(r.select(F.col("symbol").alias("b"), "ts", F.col("r").alias("y")), "ts").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), stats._corr("x", "y").alias("corr"))


