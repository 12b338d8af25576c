"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import discard, materialize, unit_hash
from tickweave.llm.topics import fit_topics, topic_column, with_profiles

#: Above this many cells (combinations that occur of the dimensions' values) the fitting runs on the cluster.
DRIVER_CELLS = 100_000
#: A target share is, unless given, the present share to this power, made to sum to one. Rounds and tolerance of the fitting.
TEMPER, ROUNDS, TOLERANCE, SEED = 0.9, 200, 1e-9, 4


@dataclass
class Fit:
    """A table of cells with their dimension values, ``tokens``, ``docs`` and raking ``factor``, and the largest error of a marginal share."""

    cells: DataFrame
    error: float
    n_cells: int


def _targets(dim: str, values: list[str], mass: np.ndarray, targets: dict, temper: float) -> np.ndarray:
    if dim in targets:
        goal = np.array([float(targets[dim].get(v, 0.0)) for v in values])
    else:
        goal = np.where(mass > 0, np.maximum(mass, 1e-300) ** temper, 0.0)
    return goal / goal.sum() if goal.sum() > 0 else goal


def rake(mass: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], float]:
    """Factors for each dimension's values, such that mass times factors has the goals as marginal shares."""
    factors = [np.ones(len(g)) for g in goals]
    total, error = mass.sum(), 0.0
    for _ in range(rounds):
        error = 0.0
        for d, goal in enumerate(goals):
            now = np.bincount(codes[d], mass * np.prod([f[c] for f, c in zip(factors, codes, strict=True)], axis=0), len(goal))
            error = max(error, float(np.abs(now / max(total, 1e-300) - goal).max(initial=0)))
            factors[d] *= np.where(now > 0, goal * total / np.where(now > 0, now, 1), 1.0)
        if error < tolerance:
            break
    return factors, error


def _fit_here(cells: DataFrame, dims: list[str], targets: dict, temper: float) -> tuple[DataFrame, float]:
    rows = cells.orderBy(*dims).collect()
    mass = np.array([float(r["tokens"]) for r in rows])
    codes, goals = [], []
    for d in dims:
        values, code = np.unique([r[d] for r in rows], return_inverse=True)
        codes.append(code)
        goals.append(_targets(d, list(values), np.bincount(code, mass, len(values)), targets, temper))
    factors, error = rake(mass, codes, goals)
    factor = np.prod([f[c] for f, c in zip(factors, codes, strict=True)], axis=0)
    fitted = [(*(r[c] for c in cells.columns), float(f)) for r, f in zip(rows, factor, strict=True)]
    return cells.sparkSession.createDataFrame(fitted, cells.select("*", F.lit(1.0).alias("factor")).schema), error


def _fit_there(cells: DataFrame, dims: list[str], targets: dict, temper: float) -> tuple[DataFrame, float]:
    """As ``_fit_here``, with each marginal an aggregate and each round a written table."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals = []
    for d in dims:
        margin = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("mass"))
        if d in targets:
            given = spark.createDataFrame([(str(k), float(v)) for k, v in targets[d].items()], f"{d} string, raw double")
            margin = margin.join(given, d, "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
        else:
            margin = margin.withColumn("raw", F.when(F.col("mass") > 0, F.pow("mass", F.lit(temper))).otherwise(0.0))
        whole = float(margin.agg(F.sum("raw")).first()[0] or 0) or 1.0
        goals.append(materialize(margin.select(d, (F.col("raw") / whole).alias("goal")), "rake-goal"))
    fitted, error = cells.withColumn("factor", F.lit(1.0)), 0.0
    for _ in range(ROUNDS):
        errors, used = [], [fitted]
        for d, goal in zip(dims, goals, strict=True):
            margin = fitted.groupBy(d).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now")).join(goal, d)
            margin = margin.select(d, "goal", "now", F.when(F.col("now") > 0, F.col("goal") * total / F.col("now")).otherwise(1.0).alias("by"))
            margin = materialize(margin, "rake-margin")
            used.append(margin)
            errors.append(float(margin.agg(F.max(F.abs(F.col("now") / (total or 1.0) - F.col("goal")))).first()[0] or 0))
            fitted = fitted.join(margin.select(d, "by"), d).withColumn("factor", F.col("factor") * F.col("by")).drop("by")
        fitted, error = materialize(fitted, "rake-cells"), max(errors)
        for table in used:
            discard(table)
        if error < TOLERANCE:
            break
    return fitted, error


def fit_mixture(rows: DataFrame, dims: list[str], targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, driver_cells: int = DRIVER_CELLS) -> Fit:
    cells = materialize(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mix-cells")
    n = cells.count()
    fitted, error = (_fit_here if n <= driver_cells else _fit_there)(cells, dims, targets or {}, temper)
    return Fit(fitted, error, n)


#: What a row brings to its cell: the default dimensions besides topic, which comes from the text.
DIMENSIONS = {"source": "source", "language": "lang"}


def _cells_of_rows(docs: DataFrame, dims: dict[str, Column] | None, targets: dict | None, temper: float, seed: int, id_col: str, text_col: str, driver_cells: int, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns ``keep`` of each row, with its dimensions' values, tokens, weight, probability, fit_error and whether it is drawn."""
    topical = dims is None
    dims = {n: F.col(c) for n, c in DIMENSIONS.items()} if topical else dims
    names = [f"_tw_{n}" for n in dims]
    drawn = unit_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed))
    made = docs.withColumns({f"_tw_{n}": F.coalesce(c.cast("string"), F.lit("(none)")) for n, c in dims.items()} | {"_tw_u": drawn})
    made = with_profiles(made, text_col, [*keep, *names, "_tw_u"]).withColumnRenamed("tokens", "_tw_tokens")
    rows = materialize(made.withColumnRenamed("profile", "_tw_profile") if topical else made.drop("profile"), "mix-rows")
    centers = fit_topics(rows, "_tw_profile") if topical else None
    label = lambda df: topic_column(df, centers, "_tw_profile", "_tw_topic") if topical else df
    narrow = label(rows.select(*names, F.col("_tw_tokens").alias("tokens"), *(["_tw_profile"] if topical else [])))
    names = [*names, "_tw_topic"] if topical else names
    fit = fit_mixture(narrow, names, {f"_tw_{k}": v for k, v in (targets or {}).items()}, temper, driver_cells)
    top = fit.cells.where("tokens > 0").agg(F.max("factor")).first()[0] or 1.0
    by_cell = fit.cells.select(*names, F.col("factor").alias("_tw_weight"), F.least(F.col("factor") / top, F.lit(1.0)).alias("_tw_probability"))
    joined = label(rows).join(F.broadcast(by_cell) if fit.n_cells <= driver_cells else by_cell, names)
    return joined.withColumns({"_tw_kept": F.col("_tw_u") < F.col("_tw_probability"), "_tw_fit_error": F.lit(float(fit.error))}), names


def mix_documents(
    docs: DataFrame,
    dims: dict[str, Column] | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = TEMPER,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """Rake token counts to marginal targets, and sample documents by the calibrated probabilities.

    A row's tokens are its words. ``dims`` (default: source, language, and topic, a cluster of the texts' terms, see ``topics``) name the
    dimensions; ``targets`` gives shares of tokens by value (a value that isn't named: none), else present shares are tempered. Iterative
    proportional fitting multiplies the cells' token counts until all marginals meet their targets, for ROUNDS rounds at most;
    fit_error is the largest difference that is left of a marginal's share. A cell's
    sampling probability is its factor over the largest factor of a cell with tokens, so no probability is over one and
    the expected tokens have the target shares. A row stays if a hash of (seed, id) is under its probability.

    Cells are aggregated before the shuffle. Up to ``driver_cells`` they are fitted on the driver and joined by broadcast,
    beyond that on the cluster.

    Nulls: a null value of a dimension is the value "(none)"; a null text has no tokens; null ids share one draw.
    A row without tokens has its cell's probability. Repeated rows share their fate. An empty table gives no rows.

    Returns doc_id, source, language, topic (or the names of ``dims``), tokens, weight, probability, fit_error, kept.
    """
    rows, names = _cells_of_rows(docs, dims, targets, temper, seed, id_col, text_col, driver_cells, [id_col])
    cols = [*names, "_tw_tokens", "_tw_weight", "_tw_probability", "_tw_fit_error", "_tw_kept"]
    return rows.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(c.removeprefix("_tw_")) for c in cols])


def sample_mixture(
    docs: DataFrame,
    dims: dict[str, Column] | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = TEMPER,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """``docs`` with only the rows that ``mix_documents`` keeps; columns stay as they are.

    Each row is drawn by its own cell's probability, so rows that share an id or have none can differ. Rows with their texts are
    written once and never shuffled. Columns whose names begin with _tw_ must not exist.
    """
    rows, _ = _cells_of_rows(docs, dims, targets, temper, seed, id_col, text_col, driver_cells, docs.columns)
    return rows.where("_tw_kept").select(docs.columns)
