"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import range_index, text_of
from tickweave.llm.textnum import shingle_hashes, word_hashes

#: Hashes kept in a sketch, words in a shingle, and bytes of each hash in the printed form.
K, WIDTH, BYTES = 128, 5, 6
_SPAN = 2.0 ** (8 * BYTES)


def sketches(texts: Iterable[str] | pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The ``k`` smallest different shingle hashes of each text, ascending."""
    column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
    hashes, at = shingle_hashes(*word_hashes(column), width)
    hashes = hashes >> np.uint64(64 - 8 * BYTES)
    return [np.unique(hashes[a:b])[:k] for a, b in zip(at[:-1], at[1:], strict=True)]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BYTES :] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def merge(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of several parts' shingles together."""
    parts = [p for p in parts if len(p)]
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in all shingles of both; exact while both sketches hold all of theirs."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])
    place = np.cumsum(first)
    size = min(k, int(place[-1]))
    return float(np.count_nonzero(place[1:][twice] <= size)) / size


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of different shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPAN / max(float(a[-1]), 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merge([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


def fingerprint_column(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", k: int = K, width: int = WIDTH) -> DataFrame:
    """``docs`` with a fingerprint of each whole text. A null text counts as empty; an empty text has an empty fingerprint.

    A column that has the name ``out`` is replaced; other columns and repeated rows stay as they are; an empty table gives no rows.
    """
    docs = docs.drop(out)
    i = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([encode(s) for s in sketches(b.column(i), k, width)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, prints], names=[*b.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit("")).schema)


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Each text's fingerprint, that of its edited form, and its likeness to both that and the next text.

    The next text is that of the next lower id; after the lowest id comes the highest. Rows are dealt to ranges
    of ids whose upper ends are ids of the table, so the row after a range's last one is known beforehand: it is
    copied to that range. One shuffle moves each text once; a task holds one Arrow batch.

    Ids are numbers; other ids are an error. Nulls: a null text counts as empty; null ids come last. Rows with one id are ordered by a hash of their text.
    An empty text is like another empty text (1.0) and unlike any other (0.0). An empty table gives no rows.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ranges = min(3 * parts, 10_000)
    q = [i / ranges for i in range(1, ranges)]
    found, top = base.select(key.alias("k")).agg(F.percentile_approx("k", q, 10 * ranges), F.max("k")).first()
    if top is None:
        ends = [0]
    else:
        ends = sorted({*(found or []), top})
    literal = lambda x: f"{x}L" if x > -(2**63) else "(-9223372036854775807L - 1L)"
    r = F.when(key == F.lit(-(2**63)).cast("long"), 0).otherwise(range_index(key - 1, ends, literal))
    flat = F.expr("array(" + ", ".join(map(literal, ends)) + ")")
    dealt = base.withColumn("r", r).withColumn("is_end", F.get(flat, F.col("r")) == key)
    copy = F.when(F.col("r") == len(ends) - 1, F.lit(0)).otherwise(F.col("r") + 1)
    place = lambda where, extra: F.struct(where.alias("r"), F.lit(extra).alias("extra"))
    both = dealt.withColumn("at", F.explode(F.when(F.col("is_end"), F.array(place(F.col("r"), False), place(copy, True))).otherwise(F.array(place(F.col("r"), False)))))
    rows = both.select("doc_id", "text", F.col("at.r").alias("r"), F.col("at.extra").alias("extra"))
    rows = rows.repartition(parts, "r").sortWithinPartitions("r", "extra", key.desc(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            n = t.num_rows - 1
            held = t.slice(n)
            own = np.flatnonzero(~np.asarray(t.column("extra").slice(0, n).combine_chunks().to_numpy(zero_copy_only=False), bool)) if n else []
            if not len(own):
                continue
            texts = t.column("text").to_pylist()
            edited = [edit(texts[i], texts[i + 1]) for i in own]
            plain, changed = sketches(t.column("text"), k, width), sketches(edited, k, width)
            prints = [encode(s) for s in plain]
            columns = {
                "doc_id": t.column("doc_id").take(pa.array(own)).combine_chunks(),
                "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array([prints[i] for i in own], pa.string()),
                "edited_fingerprint": pa.array([encode(s) for s in changed], pa.string()),
                "near_edited": pa.array([resemblance(plain[i], s, k) for i, s in zip(own, changed, strict=True)], pa.float64()),
                "near_next": pa.array([resemblance(plain[i], plain[i + 1], k) for i in own], pa.float64()),
            }
            yield from pa.table(columns).combine_chunks().to_batches()

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
