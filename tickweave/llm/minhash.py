"""Near-duplicate classes through DartMinHash signatures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import HOT, in_lots, join_hot, join_salted, materialize, text_of
from tickweave.llm.components import components
from tickweave.llm.textnum import buffers, mix, shingle_hashes, word_hashes

#: Words in a shingle, the least similarity of a link, bands and signature coordinates in a band.
WIDTH, SIMILAR, BANDS, ROWS = 5, 0.8, 26, 5
#: The first strip of ranks is [0, FIRST); each next one doubles the rank. Regions looked at in one go.
FIRST, REGIONS = 2.0**-8, 1 << 18
#: About so many nodes with a common difference are compared with others in one go.
CHUNK = 1024
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _poisson(mean: float) -> np.ndarray:
    """Cumulated probabilities of 0, 1, 2, ... darts."""
    n = int(mean + 12 * math.sqrt(mean) + 12)
    return np.cumsum([math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(n)])


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def weigh(shingles: np.ndarray, at: np.ndarray, weight: str = "set") -> tuple[np.ndarray, np.ndarray]:
    """Each text's weighted shingles as different unit regions, ascending by text, and the text of each.

    A shingle's weight, in regions: 1 ("set"), 1 and one more for each doubling of its count ("log"), or its count ("count").
    The similarity of two texts is the share of common regions in all regions of both.
    """
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((shingles, text))
    s, t = shingles[order], text[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(s)))
    size = {"set": np.ones_like(times), "log": np.frexp(times.astype(float))[1].astype(np.int64), "count": times}[weight]
    layer = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return mix(np.repeat(s[first], size) + layer.astype(np.uint64) * _A), np.repeat(t[first], size)


def signatures(regions: np.ndarray, text: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash: for each text and coordinate, the rank of the earliest dart.

    Each unit region of an element's weight gets darts as a Poisson process along the rank, the same wherever the
    element occurs: in each strip of ranks a hash gives their number, and further hashes their ranks and
    coordinates. Strips are thrown in order until all coordinates of a text have a dart, so a text costs about
    k ln k darts and a hash for each region and strip. Two texts agree in a coordinate with the probability of their
    weighted Jaccard similarity. A text without regions keeps infinite ranks.
    """
    out = np.full(n * k, np.inf)
    active = np.arange(len(regions))
    low, high, strip = 0.0, FIRST, 0
    while len(active):
        salt = mix(np.array([strip + 1], np.uint64) * _C)[0]
        r = mix(regions[active] ^ salt)
        darts = np.searchsorted(_poisson(high - low), _unit(r), side="right")
        hit = np.repeat(active, darts)
        number = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
        h = mix(np.repeat(r, darts) * _A + (number.astype(np.uint64) + np.uint64(1)) * _B)
        coordinate = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        rank = low + (high - low) * _unit(mix(h ^ _C))
        np.minimum.at(out, text[hit] * k + coordinate.astype(np.int64), rank)
        open_texts = np.isinf(out.reshape(n, k)).any(1)
        active = active[open_texts[text[active]]]
        low, high, strip = high, 2 * high, strip + 1
    return out.reshape(n, k)


def band_keys(ranks: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of ``rows`` coordinates, that differs from band to band."""
    bits = ranks.view(np.uint64).reshape(len(ranks), -1, rows)
    h = np.broadcast_to((np.arange(bits.shape[1], dtype=np.uint64) + np.uint64(1)) * _B, bits.shape[:2]).copy()
    for j in range(rows):
        h = mix(h * _A + bits[:, :, j])
    return h.view(np.int64)


_LOWER = bytes([32 if chr(c) in "\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)])


def content_digests(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A 128-bit BLAKE2 digest of each text's words, as two numbers: equal for texts that differ in white space and A-Z case only."""
    data, at = buffers(column)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        raw = data[a:b].tobytes().translate(_LOWER).strip(b" ")
        while b"  " in raw:
            raw = raw.replace(b"  ", b" ")
        out.append(hashlib.blake2b(raw, digest_size=16).digest())
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _lots(sat: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most REGIONS shingles together, or one text."""
    i = 0
    while i < len(sat) - 1:
        j = i + 1
        while j < len(sat) - 1 and sat[j + 1] - sat[i] <= REGIONS:
            j += 1
        yield i, j
        i = j


def _sign(column: pa.Array, width: int, bands: int, rows: int, weight: str) -> list:
    words, at = word_hashes(column)
    shingles, sat = shingle_hashes(words, at, width)
    found: list = [None] * (len(at) - 1)
    for i, j in _lots(sat):
        some = np.flatnonzero(np.diff(sat[i : j + 1]) > 0)
        if len(some):
            regions, text = weigh(shingles[sat[i] : sat[j]], sat[i : j + 1] - sat[i], weight)
            keys = band_keys(signatures(regions, text, j - i, bands * rows), rows)
            for m in some:
                found[i + m] = keys[m]
    return found


def _sets(column: pa.Array, width: int, weight: str) -> list[bytes]:
    """Each text's regions, ascending, as bytes."""
    words, at = word_hashes(column)
    shingles, sat = shingle_hashes(words, at, width)
    found = []
    for i, j in _lots(sat):
        regions, text = weigh(shingles[sat[i] : sat[j]], sat[i : j + 1] - sat[i], weight)
        ends = np.searchsorted(text, np.arange(j - i + 1))
        found += [np.sort(regions[x:y]).tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
    return found


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    common = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return common / (len(x) + len(y) - common)


def _nodes(base: DataFrame, width: int, bands: int, rows: int, weight: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, node, check) of each row, and each node's copy_id, first row (id, h), number of rows, and band keys.

    A node is half of the digest of a text's words, check the other half; where two digests share a node, their nodes are
    hashed anew from both halves.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_lots(batches, 2):
            digest = content_digests(b.column(2))
            keys = pa.array(_sign(b.column(2), width, bands, rows, weight), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), keys], names=["doc_id", "h", "node", "check", "bands"])

    id_type = base.schema["doc_id"].dataType.simpleString()
    signed = materialize(base.mapInArrow(sign, f"doc_id {id_type}, h long, node long, check long, bands array<long>"), "near-signed")
    while True:
        first = F.min(F.struct("doc_id", "h"))
        nodes = signed.groupBy("node").agg(F.min("doc_id").alias("copy_id"), first.alias("row"), F.count("*").alias("n"), F.min("check").alias("check"), F.max("check").alias("most"), F.first("bands").alias("bands"))
        nodes = materialize(nodes, "near-nodes")
        shared = nodes.where("check <> most").select("node", F.lit(True).alias("shared"))
        if shared.isEmpty():
            return signed.drop("bands"), nodes.drop("most")
        again = F.when(F.col("shared"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        signed = materialize(signed.join(shared, "node", "left").withColumn("node", again).drop("shared"), "near-signed")


def _classes(base: DataFrame, similar: float, width: int, bands: int, rows: int, weight: str) -> DataFrame:
    """Of each (doc_id, node) of ``base`` (doc_id, h, text): class_id, copy_id, class_size, n_links, first (whether its class keeps it), times and the least h."""
    signed, nodes = _nodes(base, width, bands, rows, weight)
    n_nodes, n_rows = nodes.count(), signed.count()
    member = nodes.where("bands is not null").select("node", F.explode("bands").alias("key"))
    buckets = member.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(buckets, "near-buckets")
    hot = [r["key"] for r in buckets.where(F.col("n") >= max(2, -(-n_nodes * bands // HOT))).select("key").collect()]  # HOT at most
    members = materialize(join_salted(member, buckets, "key", hot, "node").select("key", "node", "least"), "near-members")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_lots(batches, 0):
            mine = np.flatnonzero(content_digests(b.column(0))[:, 1] == b.column(2).to_numpy())
            b = b.take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(_sets(b.column(0), width, weight), pa.binary())], names=["node", "set"])

    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "check", F.col("row.doc_id").alias("_id"), F.col("row.h").alias("h"))
    texts = base.join(wanted, (base.h == wanted.h) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "node", "check")
    sets = materialize(texts.mapInArrow(shingles, "node long, set binary").dropDuplicates(["node"]), "near-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("set_a"), b.column("set_b")
            ok = [jaccard(x[i].as_py(), y[i].as_py()) >= similar for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "link"])

    def checked(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        return materialize(two.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long, link boolean"), "near-checked")

    stars = checked(members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    links = stars.where("link").select("a", "b")
    comps = materialize(components(links, least=False), "near-components")
    place = members.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rest = materialize(_several(place, members.count()), "near-rest")
    if not rest.isEmpty():
        names, deltas = _deltas(rest, sets)
        sure = checked(_sure_pairs(names, similar)).where("link").select("a", "b")
        names = materialize(_merged(names, sure), "near-names")
        more = checked(_left_pairs(names, deltas, similar).join(stars.select("a", "b"), ["a", "b"], "left_anti")).where("link").select("a", "b")
        ends = [names.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}")) for side in "ab"]
        over = components(more.join(ends[0], "a").join(ends[1], "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), least=False)
        last = names.select("old", "comp").distinct().join(over.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp", "left").select(F.col("old").alias("comp"), F.coalesce("far", "comp").alias("far"))
        comps = nodes.select("node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        comps = comps.join(last, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"))
        links = links.unionByName(sure).unionByName(more)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    whole = nodes.select("node", "copy_id", "n").join(comps, "node", "left").join(degree, "node", "left")
    whole = materialize(whole.select("node", "copy_id", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "near-comps")
    order = F.struct(F.col("copy_id").isNull().alias("without"), "copy_id", "node")
    sizes = whole.groupBy("comp").agg(F.min(order).alias("top"), F.sum("n").alias("class_size"), F.count("*").alias("k"))
    sizes = sizes.select("comp", F.col("top.copy_id").alias("class_id"), F.col("top.node").alias("top"), "class_size", "k")
    classes = join_hot(whole, sizes, ["comp"], F.col("k") >= max(2, -(-n_nodes // HOT)), ["node"]).select("node", "copy_id", "n", "class_id", "class_size", "n_links", (F.col("node") == F.col("top")).alias("first"))
    each = signed.groupBy("doc_id", "node").agg(F.count("*").alias("times"), F.min("h").alias("h"))
    found = join_hot(each, classes, ["node"], F.col("n") >= max(2, -(-n_rows // HOT)), ["doc_id"])
    return found.withColumn("first", F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id")))


def _several(place: DataFrame, total: int) -> DataFrame:
    """The rows (key, node, comp), ``total`` at most, of keys that hold several components, with c0, the key's least component."""
    keys = place.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).where("c0 <> c1").select("key", "c0", "n")
    return join_hot(place, keys, ["key"], F.col("n") >= max(2, -(-total // HOT)), ["node"], "inner").select("key", "node", "comp", "c0")


def _deltas(rest: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bundles of the nodes in ``rest``, and how each node differs from its bundle: the regions that more than half of its nodes have.

    A bundle is all that buckets in ``rest`` join, so nodes of one bucket, or one component, are in one bundle. Returns names (node,
    comp, k: the component's nodes, bundle, n: the bundle's nodes, size: the node's regions, d: its differences), and (node, key) for
    each difference: a region that only the node or only the bundle has. In near copies these are few where their regions are many.
    """

    def spread_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_lots(batches, 1):
            each = [np.frombuffer(x.as_py(), np.int64) for x in b.column(1)]
            bundle = np.repeat(b.column(0).to_numpy(), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([pa.array(bundle), pa.array(np.concatenate([*each, np.zeros(0, np.int64)]))], names=["bundle", "region"])

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_lots(batches, 2):
            mine = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(2)]
            usual = [x.values.to_numpy().view(np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in b.column(3)]
            salts = mix(b.column(1).to_numpy().view(np.uint64) ^ _B)
            keys = [mix(np.setxor1d(x, y) ^ salt).view(np.int64) for x, y, salt in zip(mine, usual, salts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in mine], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "size", "keys"])

    of_comp = components(rest.where("comp <> c0").select(F.col("c0").alias("a"), F.col("comp").alias("b")), least=False).select(F.col("node").alias("comp"), F.col("comp").alias("bundle"))
    names = materialize(rest.select("node", "comp").distinct(), "near-names")
    most = max(2, -(-names.count() // HOT))
    table = materialize(names.groupBy("comp").agg(F.count("*").alias("k")).join(of_comp, "comp"), "near-bundles")
    bundles = table.groupBy("bundle").agg(F.sum("k").alias("n"))
    names = join_hot(names, table, ["comp"], F.col("k") >= most, ["node"], "inner")
    names = materialize(join_hot(names, bundles, ["bundle"], F.col("n") >= most, ["node"], "inner"), "near-names")
    held = sets.join(names, "node").select("bundle", "set").mapInArrow(spread_sets, "bundle long, region long").groupBy("bundle", "region").agg(F.count("*").alias("times")).where("times > 1")
    held = join_hot(held, bundles, ["bundle"], F.col("n") >= most, ["region"], "inner").where(2 * F.col("times") > F.col("n"))
    usual = held.groupBy("bundle").agg(F.collect_list("region").alias("usual"), F.first("n").alias("of"))
    with_usual = join_hot(names.select("node", "bundle"), usual, ["bundle"], F.col("of") >= most, ["node"]).join(sets, "node")
    found = materialize(with_usual.select("node", "bundle", "set", "usual").mapInArrow(differences, "node long, size long, keys array<long>"), "near-deltas")
    names = materialize(names.join(found.select("node", "size", F.size("keys").alias("d")), "node"), "near-names")
    return names, found.select("node", F.explode("keys").alias("key"))


def _slack(similar: float) -> Column:
    """Two nodes of a bundle are similar if and only if their slacks and twice the number of their common differences make up 0 or more.

    For a similarity of s, the regions that only one of two sets has are at most (1 - s) / (1 + s) of both sizes.
    """
    return F.col("size") * ((1 - similar) / (1 + similar)) - F.col("d")


def _tops(names: DataFrame, similar: float) -> DataFrame:
    """``names`` with slack and top: the slack, node and comp of the bundle's node of the most slack."""
    own = names.withColumn("slack", _slack(similar))
    tops = own.groupBy("bundle").agg(F.max(F.struct("slack", "node", "comp")).alias("top"), F.count("*").alias("of"))
    return join_hot(own, tops, ["bundle"], F.col("of") >= max(2, -(-names.count() // HOT)), ["node"], "inner").drop("of")


def _sure_pairs(names: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b), a the top of b's bundle, of different components, that are similar even without common differences.

    Nodes that are similar to each other for their slacks alone are both similar to the top, so a bundle needs a pair a node.
    """
    sure = _tops(names, similar).where((F.col("slack") + F.col("top.slack") >= -1e-9) & (F.col("comp") != F.col("top.comp")))
    return sure.select(F.col("top.node").alias("a"), F.col("node").alias("b"))


def _merged(names: DataFrame, sure: DataFrame) -> DataFrame:
    """``names`` where the components of each b in ``sure`` (a, b) have become part of a's, the same for all of a bundle; old: comp as it was."""
    ends = [names.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"), F.col("k").alias(f"k_{side}")) for side in "ab"]
    over = sure.join(ends[0], "a").join(ends[1], "b").groupBy(F.col("comp_b").alias("comp")).agg(F.min("comp_a").alias("into"), F.min("k_b").alias("all"))
    out = join_hot(names, over, ["comp"], F.col("all") >= max(2, -(-names.count() // HOT)), ["node"])
    return out.withColumn("old", F.col("comp")).withColumn("comp", F.coalesce("into", "comp")).drop("into", "all")


def _left_pairs(names: DataFrame, deltas: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of a bundle but of different components, as far as their first common difference allows ``similar``.

    A node's differences are put in order, first those that only one component has, then the rarer ones. Where two nodes' first common
    one is at places p and q, at most the lesser of d - p of one and d - q of the other are common. So a pair is looked for by
    differences that come early, most of them rare. Of the nodes that have one, those outside of its largest component are paired with
    all of other components: they are dealt to chunks of about CHUNK, so a frequent difference is many tasks' work. All bounds are exact.
    """
    own = _tops(names, similar).select("node", "comp", "size", "d", "slack", F.col("top.slack").alias("top"))
    each = materialize(deltas.join(own, "node"), "near-differences")
    most = max(2, -(-each.count() // HOT))
    common = each.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("times")).where("c0 <> c1").select("key", "times")
    each = join_hot(each, common, ["key"], F.col("times") >= most, ["node"])
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("times", F.lit(0)), "key")) - 1
    early = each.withColumn("left", F.col("d") - place).where(F.col("times").isNotNull() & (2 * F.col("left") + F.col("slack") + F.col("top") >= -1e-9))
    early = materialize(early.select("key", "node", "comp", "size", "slack", "left"), "near-early")
    per = early.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key")
    per = per.agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.sum("k").alias("n"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    early = join_hot(early, per, ["key"], F.col("n") >= most, ["node"], "inner").withColumn("chunks", (1 + F.floor(F.col("n") / CHUNK)).cast("int")).withColumn("outer", F.col("comp") != F.col("main"))
    cols = ["node", "comp", "size", "slack", "left", "outer"]
    named = lambda df, side: df.select("key", "chunk", *[F.col(c).alias(f"{c}_{side}") for c in cols])
    a = named(early.where("outer").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))), "a")
    b = named(early.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "b")
    once = ~F.col("outer_b") | (F.col("node_a") < F.col("node_b"))
    enough = 2 * F.least("left_a", "left_b") + F.col("slack_a") + F.col("slack_b") >= -1e-9
    sized = F.least("size_a", "size_b") >= similar * F.greatest("size_a", "size_b") - 1e-9
    pairs = a.join(b, ["key", "chunk"]).where((F.col("comp_a") != F.col("comp_b")) & once & enough & sized)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, weight: str = "set") -> DataFrame:
    """Classes of near-duplicate texts: connected components of links between texts of Jaccard similarity ``similar`` or more over ``width``-word shingles.

    1. Texts with the same words (by a 128-bit digest) are one node, however many copies there are.
    2. Each node's DartMinHash signature of its weighted shingles gives ``bands`` keys; a pair at 0.8 shares a key with
       probability 1 - (1 - 0.8**rows)**bands, over 0.9999. ``weight`` says what a shingle weighs (see ``weigh``); signatures and
       the similarity of links go by the same weights. "set": each different shingle weighs one, so it is the sets' similarity.
    3. In each bucket every member is compared with the least one by the exact similarity, and links join nodes to components.
       In buckets that still hold several components, all pairs between components that exact bounds allow are compared too.

    Large groups of near copies cost about a row a member, keys and classes with at least 1/HOT of all rows are joined by broadcast,
    and no link between different components of a bucket is passed over.

    Nulls: a null text counts as empty; a null id is allowed and never the class's id unless all are null. Texts without words are
    copies of each other. A text with fewer than ``width`` words has one shingle. Of repeated rows one is kept, of each class one.
    Ids may be of any type that can be ordered. An empty table gives no rows. Other columns are ignored.

    Returns doc_id, class_id (the least id of the class), copy_id (the least id with the same words), class_size, n_links (links
    that were found from the row's text to different texts: enough to hold the class together, not all), kept, content_key.
    """
    out = _classes(_base(docs, id_col, text_col), similar, width, bands, rows, weight).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time"))
    return out.select("doc_id", "class_id", "copy_id", "class_size", "n_links", (F.col("first") & (F.col("time") == 1)).alias("kept"), F.col("node").alias("content_key"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, weight: str = "set") -> DataFrame:
    """``docs`` with one row of each class of near duplicates, one with the least id; columns stay as they are.

    A row goes by its id and a hash of its text; where the row that stays is repeated, any one of these rows stays. Nulls, ties and
    empty tables are as in ``near_duplicates``; a column named _tw_own must not exist.
    """
    found = _classes(_base(docs, id_col, text_col), similar, width, bands, rows, weight).where("first")
    stay = materialize(found.select(F.col("doc_id").alias("_tw_id"), F.col("h").alias("_tw_h"), "times"), "near-kept")
    same = F.col(id_col).eqNullSafe(F.col("_tw_id")) & (F.col("_tw_own") == F.col("_tw_h"))
    out = docs.withColumn("_tw_own", F.xxhash64(text_of(text_col))).join(stay.drop("times"), same, "left_semi")
    if not stay.where("times > 1").isEmpty():
        out = out.dropDuplicates([id_col, "_tw_own"])
    return out.drop("_tw_own")
