"""Exact dedup through an extendible-hash index in shared files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import HOT, WHITE_SPACE, join_hot, materialize, text_of

#: A bucket with more different keys than this splits, until the directory is 2**MAX_DEPTH long.
CAPACITY, MAX_DEPTH = 1 << 11, 16


def build_directory(counts: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Directory of an extendible hash table from the number of keys under each ``max_depth``-bit prefix.

    Starts with one bucket of depth 0. While a bucket is overfull it splits on its next bit; when its depth is
    the directory's, the directory doubles first. Returns the directory's depth and the bucket of each slot;
    buckets are numbered in prefix order, so a run of buckets is a range of hash values.
    """
    below = [0]
    for p in range(1 << max_depth):
        below.append(below[-1] + counts.get(p, 0))
    depth, todo, leaves = 0, [(0, 0)], []
    while todo:
        prefix, local = todo.pop()
        shift = max_depth - local
        if local < max_depth and below[(prefix + 1) << shift] - below[prefix << shift] > capacity:
            if local == depth:
                depth += 1
            todo += [(prefix * 2 + 1, local + 1), (prefix * 2, local + 1)]
        else:
            leaves.append((prefix, local))
    return depth, [k for k, (_, local) in enumerate(leaves) for _ in range(1 << (depth - local))]


def normalized(col: str | Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_of(col), WHITE_SPACE, " ")


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int | None = None,
    max_depth: int = MAX_DEPTH,
    hash_of: Callable[[Column], Column] = F.xxhash64,
    digest_of: Callable[[Column], Column] = lambda t: F.sha2(t, 256),
) -> DataFrame:
    """Groups of rows whose texts are equal after each run of white space became one space.

    1. Every row's hash goes to a shared table. The numbers of different hashes by prefix (2**max_depth at most) give the
       directory, which doubles as overfull buckets split. ``capacity`` is how many keys a bucket holds; by default CAPACITY, or as
       many as let the directory have half of its slots to spare. A hash that is so uneven that a bucket stays overfull at
       ``max_depth`` makes that owner's work longer, not wrong.
    2. Texts go to the task that owns their bucket; a hash that at least 1/HOT of all rows have is collapsed by bytes before
       that. Owners compare bytes: different texts with one hash are entries of a chain. They write the index sorted by
       bucket and hash, with the texts of chains of several entries.
    3. Rows look up their slot's bucket in the directory, there the hash, and in chains of several entries compare bytes. Groups
       with at least 1/HOT of the rows are looked up by broadcast.

    Nulls: a null text counts as empty; a null id never is the one that stays unless all ids of the group are
    null. Of repeated rows (same id and text) one stays. Ids may be of any type that can be ordered. An empty table gives no rows. Other columns are ignored.

    Returns doc_id, keep_id, group_size, kept, text_sha256: one row for each input row.
    """
    base = docs.select(F.col(id_col).alias("id"), normalized(text_col).alias("t"))
    base = base.select("id", "t", hash_of(F.col("t")).alias("h"))
    rows = materialize(base.select("id", "h"), "exact-rows")
    n = rows.count()
    heavy = max(2, -(-n // HOT))
    per = rows.groupBy("h").agg(F.count("*").alias("n"))
    counts = {r["p"]: r["n"] for r in per.groupBy(_prefix(max_depth).alias("p")).agg(F.count("*").alias("n")).collect()}
    depth, slots = build_directory(counts, capacity or max(CAPACITY, n >> (max_depth - 1)), max_depth)
    directory = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(slots)), "slot int, bucket int"))
    to_bucket = lambda df: df.withColumn("slot", _prefix(depth)).join(directory, "slot").drop("slot")

    hot = F.broadcast(per.where(F.col("n") >= heavy).select("h"))
    once = base.join(hot, "h", "left_anti").select("h", "t", F.col("id").alias("least"), F.lit(1).cast("long").alias("n"))
    collapsed = base.join(hot, "h", "left_semi").groupBy("h", "t").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    owned = to_bucket(once.unionByName(collapsed)).repartition("bucket")
    owned = owned.groupBy("bucket", "h", "t").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = Window.partitionBy("bucket", "h")
    entries = owned.withColumn("chain", F.count("*").over(chain)).withColumn("link", F.row_number().over(chain.orderBy("t")))
    entries = entries.select("bucket", "h", "link", "chain", digest_of(F.col("t")).alias("digest"), "keep_id", "group_size", F.when(F.col("chain") > 1, F.col("t")).alias("t"))
    index = materialize(entries, "exact-index")

    payload = ["digest", "keep_id", "group_size"]
    same = to_bucket(rows.groupBy("id", "h").agg(F.count("*").alias("copies")))
    large = F.col("group_size") >= heavy
    cols = ["id", "copies", *payload]
    matched = join_hot(same, index.where("chain = 1").select("bucket", "h", *payload), ["bucket", "h"], large, ["id"], "inner").select(cols)
    chained = index.where("chain > 1").select("bucket", "h", "t", *payload)
    if not chained.isEmpty():
        texts = base.join(chained.select("h").distinct(), "h", "left_semi").groupBy("id", "h", "t").agg(F.count("*").alias("copies"))
        matched = matched.unionByName(join_hot(to_bucket(texts), chained, ["bucket", "h", "t"], large, ["id"], "inner").select(cols))
    each = matched.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` doesn't keep; columns stay as they are.

    Nulls, repeated rows and empty tables are as there; a column named _tw_digest must not exist.
    """
    found = exact_duplicates(docs, id_col, text_col)
    kept = found.where("kept").select(F.col("doc_id").alias("_tw_id"), F.col("text_sha256").alias("_tw_sha"))
    marked = docs.withColumn("_tw_digest", F.sha2(normalized(text_col), 256))
    out = marked.join(kept, F.col(id_col).eqNullSafe(F.col("_tw_id")) & (F.col("_tw_digest") == F.col("_tw_sha")), "left_semi")
    repeated = found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates([id_col, "_tw_digest"])
    return out.drop("_tw_digest")
