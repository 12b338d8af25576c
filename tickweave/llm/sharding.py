"""Sharding by sampled splitters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import materialize, range_index, sql_string, text_of, unit_hash

#: Ranges at first: so many a shard, and so many more that a range holds about ROWS_PER_RANGE rows, MAX_RANGES at most.
RANGES_PER_SHARD, MAX_RANGES, ROWS_PER_RANGE = 4, 4096, 500_000
#: Key samples drawn for each range that is wanted, and parts that an overfull range is subdivided into.
SAMPLES_PER_RANGE, PARTS = 16, 16
#: A range with more than this many times the mean bytes is overfull; so is one at a shard's end with over this share of a shard's bytes.
OVERFULL, TOLERANCE = 2.0, 1 / 512


def _sample(rows: DataFrame, n: int, total: int, seed: int) -> list[str]:
    """About ``n`` different keys, drawn with a chance in proportion to their size."""
    chance = F.col("size") * (float(n) / max(total, 1))
    return sorted(r["key"] for r in rows.where(unit_hash(F.col("key"), F.lit(seed)) < chance).select("key").distinct().collect())


def _quantiles(sample: list[str], parts: int) -> set[str]:
    return {sample[len(sample) * i // parts] for i in range(1, parts)} if sample else set()


def _shards_of(sums: list, n_shards: int, total: int) -> tuple[list[int], list[bool]]:
    """Each range's shard, that in which the middle of its bytes lies, and whether a shard's end lies within it."""
    shards, cut, at = [], [], 0
    for size in sums:
        shards.append(min(n_shards - 1, int((2 * at + size) * n_shards // (2 * max(total, 1)))))
        first, last = at * n_shards // max(total, 1), (at + size - 1) * n_shards // max(total, 1)
        cut.append(size > 0 and first != last)
        at += size
    return shards, cut


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, seed: int = 7) -> DataFrame:
    """Put each row into one of ``n_shards`` shards of near equal bytes.

    Rows are ordered by (hash of the text, id), so that equal texts are neighbours. A size-weighted sample of
    these keys gives splitters at its quantiles, and rows are dealt to the ranges between splitters. A range is overfull if it has over
    OVERFULL times the mean bytes, or if a shard's end lies within it and it has over TOLERANCE of a shard's bytes: it is sampled
    anew and subdivided, until no range is overfull that has two rows. Whole ranges in order make up the shards, so a shard's
    bytes differ from the mean by TOLERANCE of it or by one row's size at either end. Rows that share a key (same id and text) are
    subdivided by quantiles of their place in the table.

    Only key, id, size and checksum are shuffled, never texts. Nulls: a null text has no bytes and the
    checksum of the empty text; a null id is allowed. Ids may be of any type that has a text form. Ties are repeated rows and get neighbouring slots.
    An empty table gives no rows. Other columns of ``docs`` are ignored, whatever their names.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = text_of(text_col)
    padded = lambda c: F.lpad(F.hex(c), 16, "0")
    made = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        (F.octet_length("t").cast("long") + overhead).alias("size"),
        F.crc32(F.encode("t", "UTF-8")).alias("text_crc32"),
        F.concat(padded(F.xxhash64("t")), F.coalesce(padded(F.xxhash64(F.col("doc_id").cast("string"))), F.lit("-" * 16))).alias("key"),
        padded(F.monotonically_increasing_id()).alias("place"),
    )
    rows = materialize(made, "shard-rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    ranges = max(RANGES_PER_SHARD * n_shards, min(MAX_RANGES, n // ROWS_PER_RANGE))
    bounds = sorted(_quantiles(_sample(rows, ranges * SAMPLES_PER_RANGE, total, seed), ranges))
    whole = F.concat("key", "place")
    while True:
        dealt = rows.withColumn("range", range_index(whole, bounds, sql_string))
        found = {r["range"]: r for r in dealt.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        sizes = [found[k]["size"] if k in found else 0 for k in range(len(bounds) + 1)]
        shards, cut = _shards_of(sizes, n_shards, total)
        over = [k for k, r in found.items() if r["n"] > 1 and (r["size"] > OVERFULL * total / ranges or cut[k] and r["size"] > TOLERANCE * total / n_shards)]
        if not over:
            break
        grown = set(bounds)
        several = [k for k in over if found[k]["low"] != found[k]["high"]]
        if several:
            grown.update(found[k]["high"] for k in several)  # so that each of them is split, whatever is drawn
            size = sum(sizes[k] for k in several)
            sample = _sample(dealt.where(F.col("range").isin(several)), len(several) * PARTS * SAMPLES_PER_RANGE, size, seed + len(bounds))
            grown |= _quantiles(sample, len(several) * PARTS)
        same = [k for k in over if found[k]["low"] == found[k]["high"]]
        if same:
            at = [i / PARTS for i in range(1, PARTS)]
            place = F.conv("place", 16, 10).cast("long")
            for r in dealt.where(F.col("range").isin(same)).groupBy("range").agg(F.percentile_approx(place, at, 10_000).alias("q"), F.max(place).alias("top")).collect():
                grown.update(f"{found[r['range']]['low']}{q:016X}" for q in {*r["q"], r["top"]})
        bounds = sorted(grown)
    listed = lambda xs: F.expr("array(" + ", ".join(map(str, xs)) + ")")
    first_row, held = [], [0] * n_shards
    for k, shard in enumerate(shards):
        first_row.append(f"{held[shard]}L")
        held[shard] += found[k]["n"] if k in found else 0
    w = Window.partitionBy("range").orderBy("key", "place")
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.get(listed(shards), F.col("range")).alias("shard"),
        (F.get(listed(first_row), F.col("range")) + F.row_number().over(w) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
