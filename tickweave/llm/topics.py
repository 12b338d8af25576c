"""Topics of documents: clusters of hashed term profiles, fitted on all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.llm.common import in_lots, materialize, text_of
from tickweave.llm.stopwords import STOP_WORDS
from tickweave.llm.textnum import word_hashes

#: Topics, places of a term profile, rounds of the clustering, its seed, and the length that profiles are scaled to.
TOPICS, SIZE, ROUNDS, SEED, SCALE = 8, 128, 3, 9, 1000
_STOPS = np.unique(word_hashes(pa.array(sorted({w for words in STOP_WORDS.values() for w in words})))[0])


def profiles(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's terms counted by hash, as square roots scaled to the length SCALE and rounded; and its words. Function words don't count as terms."""
    hashes, at = word_hashes(column)
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    term = _STOPS[np.minimum(np.searchsorted(_STOPS, hashes), len(_STOPS) - 1)] != hashes
    counts = np.bincount(text[term] * SIZE + (hashes[term] % np.uint64(SIZE)).astype(np.int64), minlength=n * SIZE).reshape(n, SIZE)
    length = np.sqrt(np.maximum(counts.sum(1, keepdims=True), 1))
    return np.round(np.sqrt(counts) * (SCALE / length)).astype(np.int16), np.diff(at)


def nearest(found: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center's number; of centers as near, the first."""
    return (found @ centers.T - (centers**2).sum(1) / 2).argmax(1)


def fit_topics(rows: DataFrame, profile_col: str = "profile", topics: int = TOPICS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centers of ``topics`` clusters of all rows' profiles.

    Rows first go to that of some random directions from the mean in which they lie farthest; then each round moves a center to
    the mean of its rows, and rows to their nearest center. Sums are of whole numbers, so the order of rows doesn't matter. A task
    sends one row for each center and place. A center without rows stays where it is; without any rows all are zero.
    """

    def sums(assign) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((topics, SIZE + 1), np.int64)
            for b in batches:
                p = b.column(0).flatten().to_numpy().reshape(b.num_rows, SIZE).astype(np.int64)
                k = assign(p.astype(np.float64))
                for j in np.unique(k):
                    total[j, :SIZE] += p[k == j].sum(0)
                    total[j, SIZE] += np.count_nonzero(k == j)
            cell = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.reshape(-1))], names=["cell", "n"])

        out = np.zeros(topics * (SIZE + 1))
        for r in rows.select(profile_col).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r["cell"]] = r["n"]
        return out.reshape(topics, SIZE + 1)

    whole = sums(lambda p: np.zeros(len(p), np.int64))[0]
    mean = whole[:SIZE] / max(whole[SIZE], 1)
    directions = np.random.default_rng(seed).normal(0, 1, (SIZE, topics))
    found = sums(lambda p: ((p - mean) @ directions).argmax(1))
    centers = np.tile(mean, (topics, 1))
    for left in range(rounds, -1, -1):
        has = found[:, SIZE] > 0
        centers[has] = found[has, :SIZE] / found[has, SIZE:]
        if left:
            found = sums(lambda p, c=centers.copy(): nearest(p, c))
    return centers


def with_profiles(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the profile and the number of words of each whole text; a null text counts as empty and has a profile of zeros."""
    base = docs.select(text_of(text_col).alias("_tw_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_lots(batches, 0):
            found, words = profiles(b.column(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * SIZE, pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], lists, pa.array(words, pa.int64())], names=[*b.schema.names[1:], "profile", "tokens"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields[1:], T.StructField("profile", T.ArrayType(T.ShortType())), T.StructField("tokens", T.LongType())]))


def topic_column(rows: DataFrame, centers: np.ndarray, profile_col: str = "profile", out: str = "topic") -> DataFrame:
    """``rows`` with the topic of each profile instead of the profile: t0, t1, ..."""
    i = rows.columns.index(profile_col)
    fields = [f for f in rows.schema.fields if f.name != profile_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = nearest(b.column(i).flatten().to_numpy().reshape(b.num_rows, SIZE).astype(np.float64), centers)
            rest = [c for j, c in enumerate(b.columns) if j != i]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([f"t{x}" for x in k], pa.string())], names=[f.name for f in fields] + [out])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))


def document_topics(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", topics: int = TOPICS) -> DataFrame:
    """(id, tokens, topic) of each row: clusters of its terms. Repeated rows have one topic; an empty table gives no rows."""
    rows = materialize(with_profiles(docs, text_col, [id_col]), "topic-profiles")
    return topic_column(rows, fit_topics(rows, topics=topics))
