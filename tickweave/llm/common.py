"""Helpers shared by the corpus operators: shared tables, range lookup, expressions."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys with at least 1/HOT of all rows are joined by broadcast: there can be no more than HOT of them.
HOT = 1024
#: Parts that a hot key's rows are dealt to where they can't be joined by broadcast.
SALTS = 256
#: Bytes of texts that a Python function looks at in one go.
TEXT_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and the session runs in one JVM (``local[...]``), a temporary folder
    is made and set; on a cluster an absent setting is an error, since a local folder would lose data.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tickweave_dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark._tickweave_dir = "file://" + tempfile.mkdtemp(prefix="tickweave-")
    return spark._tickweave_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the shared folder's owner clears it
            return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickweave/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tickweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_tickweave_path", None)
    if path is not None:
        _delete(spark, path)
        _written[:] = [w for w in _written if w[1] != path]


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of queries that are done and that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def return_memory() -> None:
    """Give the operating system back what this process has freed: Arrow and the C library keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's C library only
    if trim is not None:
        trim(0)


def in_lots(batches: Iterator[pa.RecordBatch], column: int, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches``, in order, in batches of at most ``limit`` bytes of texts in ``column``, or of one row.

    After the last one the worker's freed memory goes back to the system, so idle workers don't keep what a task has needed.
    """
    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy()), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield b.slice(at, end - at)
            at = end
    return_memory()


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], heavy: Column, spread: list[str], how: str = "left") -> DataFrame:
    """``rows`` with the other columns of ``table``, in which each of the ``keys`` occurs once.

    Entries for which ``heavy`` holds are broadcast: the caller sees to it that there are few, such as those with at least
    1/HOT of all rows. Rows that have found theirs are dealt by a hash of ``spread``, so no key's rows come together in one task.
    """
    payload = [c for c in table.columns if c not in keys]
    hot = table.where(heavy).select(*keys, F.struct(*payload).alias("_hot"))
    cold = table.where(~heavy).select(*keys, F.struct(*payload).alias("_cold"), F.lit(0).alias("_salt"))
    salt = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(F.lit(0)).cast("int")
    both = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    if how == "inner":
        both = both.where(F.col("_found").isNotNull())
    return both.select(*rows.columns, *[F.col("_found")[c].alias(c) for c in payload])


def join_salted(rows: DataFrame, table: DataFrame, key: str, hot: list, spread: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with the other columns of their entry in ``table``, where they have one; in ``table`` each ``key`` occurs once.

    The keys in ``hot``, which the caller bounds, get ``salts`` copies of their entry, and their rows are dealt to these by a hash of
    ``spread``. As an inner join it makes a row for each row that has an entry, and none for others.
    """
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    mine = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return mine.join(copies, [key, "_salt"]).drop("_salt")


def range_index(key: Column, bounds: list, literal) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``: a two-level search over constant arrays.

    ``literal`` turns a bound into SQL text. Cost per row is about twice the square root of the number of bounds.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    arrays = F.expr("array(" + ", ".join("array(" + ", ".join(map(literal, g)) + ")" for g in groups) + ")")
    tops = F.expr("array(" + ", ".join(literal(g[-1]) for g in groups) + ")")
    whole = F.size(F.filter(tops, lambda b: b <= key))
    part = F.coalesce(F.size(F.filter(F.get(arrays, whole), lambda b: b <= key)), F.lit(0))
    return (F.least(whole * width, F.lit(len(bounds))) + F.when(whole < len(groups), part).otherwise(0)).cast("int")


def unit_hash(*cols: Column) -> Column:
    """A double in (0, 1) that depends on the columns' values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) * F.lit(2.0**-53)


