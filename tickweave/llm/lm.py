"""Language-model scoring: a bigram model with deleted interpolation."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import materialize, release_shuffles, text_of
from tickweave.llm.textnum import mix, word_hashes

#: Bytes of text counted together, and the most ranges of n-gram hashes that owners hold.
BLOCK_BYTES, MAX_OWNERS = 6 << 20, 1 << 18
#: The token that ends each text; also the context of its first token.
END = np.uint64(0x5851F42D4C957F2D)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Steps of log2 probability in the table that expectation-maximisation runs on, its rounds, and pseudo-tokens of the pooled weights.
STEPS, ROUNDS, PRIOR = 8, 200, 20.0
FOLDS, TUNE_FOLD = 7, 3


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte over all of them: the high bytes, mostly zero, compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens and of all bigrams that end in them, and where each text's begin. Each text has its words, then END."""
    words, at = word_hashes(texts)
    n = len(at) - 1
    starts = at + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    last = starts[1:] - 1
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner], out[last] = words, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    if len(out):
        before[0] = END  # and each later text follows an END
    return out, mix(before * _LEFT + out * _RIGHT), starts


@dataclass
class Interpolation:
    """Mixture weights (bigram, unigram, uniform) for each bucket of the context's frequency, and the counts' totals."""

    vocabulary: int
    total: int
    weights: dict[int, tuple[float, float, float]] = field(default_factory=dict)

    def table(self) -> np.ndarray:
        """Weights for buckets 0 to 64; a bucket without held-out tokens takes those of the nearest one."""
        known = sorted(self.weights) or [0]
        near = [min(known, key=lambda k: (abs(k - b), k)) for b in range(65)]
        return np.array([self.weights.get(k, (0.0, 0.5, 0.5)) for k in near])


def bucket(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(np.float64))[1]


def estimates(pair: np.ndarray, one: np.ndarray, context: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of each token: after its context, and alone."""
    return np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0), one / max(total, 1)


def learn_weights(cells: list[tuple], vocabulary: int, rounds: int = ROUNDS, prior: float = PRIOR) -> dict[int, tuple[float, float, float]]:
    """Expectation-maximisation over held-out tokens: (bucket, tokens, sum of log p(bigram) or None, sum of log p(unigram) or None)."""
    flat = 1.0 / (vocabulary + 1)
    b = np.array([c[0] for c in cells], int)
    n = np.array([c[1] for c in cells], float)
    p = np.array([[0.0 if c[2] is None else np.exp(c[2] / c[1]), 0.0 if c[3] is None else np.exp(c[3] / c[1]), flat] for c in cells]).reshape(-1, 3)

    def run(at: np.ndarray, base: np.ndarray, strength: float) -> np.ndarray:
        w = base.copy()
        for _ in range(rounds):
            mass = p[at] * w
            shared = mass / mass.sum(1, keepdims=True) * n[at, None]
            new = shared.sum(0) + strength * base
            new /= new.sum()
            if np.abs(new - w).max() < 1e-10:
                return new
            w = new
        return w

    if not len(b):
        return {}
    pooled = run(np.arange(len(b)), np.full(3, 1 / 3), 1.0)
    pooled = np.maximum(pooled, 1e-6) / np.maximum(pooled, 1e-6).sum()
    return {int(k): tuple(run(np.flatnonzero(b == k), pooled, prior)) for k in np.unique(b)}


def _kind(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("tune").combine_chunks().to_numpy(zero_copy_only=False), bool)


def _aligned(response: pa.Table, tune: bool, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All counts and retained counts of a block's different n-grams, in the order of their hashes."""
    rows = [(r["owner"], r["counts"], r["kept"]) for r in response.to_pylist() if r["tune"] == tune and r["order"] == order]
    rows.sort(key=lambda r: r[0])
    parts = [[_numbers(r[i]) for r in rows] for i in (1, 2)]
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in parts)


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: Column | None = None,
    tune: Column | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Score every text by a bigram model that is learnt from all rows that aren't ``held_out``.

    Texts are dealt to blocks by hash. A block counts its different words and bigrams and sends hashes and
    counts, packed by range of hash, to the ranges' owners; so a frequent word reaches its owner once a
    block. Owners add up and answer with corpus counts in the order asked. Rows in fold ``tune`` (of the
    training rows) are the deleted part: with their counts taken off, the model is estimated, and for each
    bucket of the context's frequency (powers of two) expectation-maximisation finds the weights of bigram,
    unigram and uniform estimates that make the deleted part likeliest. It runs on a table of token counts by
    bucket and rounded log probabilities, which holds mean logs and is bounded by the rounding (STEPS an
    octave). Scores then use the counts of all training rows. No count is dropped or capped.

    By default a row is held out if crc32 of its id as text is 2 modulo 7, and tunes if it is 3.

    Nulls: a null text counts as empty; a null id as the empty string. An empty text has the one token END.
    Repeated rows count each time. An empty table gives no rows. Other columns are ignored.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS
    held_out = fold == 2 if held_out is None else held_out
    tune = fold == TUNE_FOLD if tune is None else tune
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), held_out.alias("held_out"), (tune & ~held_out).alias("tune"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    owners = min(MAX_OWNERS, 1 << max(3, (2 * blocks - 1).bit_length()))
    shift = np.uint64(64 - (owners.bit_length() - 1))
    base = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def count(block: pa.Table) -> pa.Table:
        where, kinds, out = block.column("block")[0].as_py(), _kind(block), []
        for kind in (False, True):
            part = block.filter(pa.array(kinds == kind))
            if not part.num_rows:
                continue
            ones, pairs, starts = tokens(part.column("text"))
            learnt = np.repeat(~np.asarray(part.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool), np.diff(starts))
            for order, grams in ((1, ones), (2, pairs)):
                keys, inverse = np.unique(grams, return_inverse=True)
                counts = np.bincount(inverse, learnt, len(keys)).astype(np.uint64)
                cuts = np.searchsorted(keys >> shift, np.arange(owners + 1, dtype=np.uint64))
                for o in np.flatnonzero(np.diff(cuts)):
                    k, c = keys[cuts[o] : cuts[o + 1]], counts[cuts[o] : cuts[o + 1]]
                    out.append((int(o), where, kind, order, _planes(np.diff(k, prepend=np.uint64(0))), _planes(c)))
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(asked)})

    def add(owner: pa.Table) -> pa.Table:
        out, me = [], owner.column("owner")[0].as_py()
        rows = owner.to_pylist()
        for order in (1, 2):
            mine = [r for r in rows if r["order"] == order]
            if not mine:
                continue
            keys = [np.cumsum(_numbers(r["keys"]), dtype=np.uint64) for r in mine]
            counts = np.concatenate([_numbers(r["counts"]) for r in mine]).astype(np.float64)
            tuned = np.repeat([r["tune"] for r in mine], [len(k) for k in keys])
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, counts, len(unique)).astype(np.int64)
            kept = total - np.bincount(inverse, counts * tuned, len(unique)).astype(np.int64)
            at = 0
            for r, k in zip(mine, keys, strict=True):
                here = inverse[at : at + len(k)]
                at += len(k)
                out.append((me, r["block"], r["tune"], order, _planes(total[here]), _planes(kept[here] if r["tune"] else np.zeros(0))))
            if order == 1:
                sums = np.array([np.count_nonzero(total), total.sum(), np.count_nonzero(kept), kept.sum()])
                out.append((me, -1, False, 0, _planes(sums), b""))
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(answered)})

    asked = [("owner", pa.int32()), ("block", pa.int32()), ("tune", pa.bool_()), ("order", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
    answered = [*asked[:4], ("counts", pa.binary()), ("kept", pa.binary())]
    requests = base.groupBy("block").applyInArrow(count, "owner int, block int, tune boolean, order int, keys binary, counts binary")
    answers = requests.groupBy("owner").applyInArrow(add, "owner int, block int, tune boolean, order int, counts binary, kept binary")
    answers = materialize(answers, "lm-counts")
    del requests
    release_shuffles(spark)

    sums = [int(s) for s in np.sum([_numbers(bytes(r["counts"])) for r in answers.where("block = -1").select("counts").collect()] or [np.zeros(4)], axis=0)]
    vocabulary, total, kept_vocabulary, kept_total = sums
    answers = answers.where("block >= 0")

    def looked_up(part: pa.Table, response: pa.Table, kind: bool) -> tuple:
        ones, pairs, starts = tokens(part.column("text"))
        both = []
        for order, grams in ((1, ones), (2, pairs)):
            keys, inverse = np.unique(grams, return_inverse=True)
            found = _aligned(response, kind, order)
            both.append([x[inverse] if len(x) == len(keys) else None for x in found])
        return both, starts

    def context(one: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The count of what stands before each token; before a text's first token, its END."""
        c = np.empty_like(one)
        c[1:] = one[:-1]
        c[starts[:-1]] = one[starts[1:] - 1]
        return c

    def deleted(key: tuple, block: pa.Table, response: pa.Table) -> pa.Table:
        names = ["bucket", "q2", "q1", "n", "l2", "l1"]
        if not block.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, [pa.int32()] * 3 + [pa.int64()] + [pa.float64()] * 2, strict=True)})
        ((_, one), (_, pair)), starts = looked_up(block, response, True)
        before = context(one, starts)
        p2, p1 = estimates(pair, one, before, kept_total)
        with np.errstate(divide="ignore"):
            l2, l1 = np.log(p2), np.log(p1)
        q = [np.where(np.isfinite(x), np.round(STEPS * np.maximum(x, -500) / np.log(2)), 1).astype(np.int64) for x in (l2, l1)]
        code = (bucket(before).astype(np.int64) * (1 << 20) + q[0] + (1 << 19)) * (1 << 20) + q[1] + (1 << 19)
        cells, first, inverse, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        logs = [np.bincount(inverse, np.where(np.isfinite(x), x, 0), len(cells)) for x in (l2, l1)]
        cols = [bucket(before)[first].astype(np.int32), q[0][first].astype(np.int32), q[1][first].astype(np.int32), n.astype(np.int64), *logs]
        return pa.table(dict(zip(names, map(pa.array, cols), strict=True)))

    tuned = base.where("tune").groupBy("block").cogroup(answers.where("tune").groupBy("block")).applyInArrow(deleted, "bucket int, q2 int, q1 int, n long, l2 double, l1 double")
    cells = tuned.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n"), F.sum("l2").alias("l2"), F.sum("l1").alias("l1")).orderBy("bucket", "q2", "q1").collect()
    model = Interpolation(vocabulary, total)
    model.weights = learn_weights([(r["bucket"], r["n"], None if r["q2"] > 0 else r["l2"], None if r["q1"] > 0 else r["l1"]) for r in cells], kept_vocabulary)
    weights = model.table()

    def score(key: tuple, block: pa.Table, response: pa.Table) -> pa.Table:
        kinds, out = _kind(block) if block.num_rows else np.zeros(0, bool), []
        for kind in (False, True):
            part = block.filter(pa.array(kinds == kind)) if block.num_rows else block
            if not part.num_rows:
                continue
            ((one, _), (pair, _)), starts = looked_up(part, response, kind)
            before = context(one, starts)
            p2, p1 = estimates(pair, one, before, total)
            w = weights[np.minimum(bucket(before), 64)]
            p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (vocabulary + 1)
            add_up = lambda x, s=starts: np.add.reduceat(x, s[:-1])
            out.append(
                pa.table(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "n_tokens": pa.array(np.diff(starts), pa.int64()),
                        "n_known": pa.array(add_up((one > 0).astype(np.int64)), pa.int64()),
                        "train_tokens": pa.array(np.full(part.num_rows, total), pa.int64()),
                        "base_score": pa.array(add_up(np.log10((one + 1) / (total + vocabulary + 1)))),
                        "score": pa.array(add_up(np.log10(p))),
                    }
                )
            )
        if out:
            return pa.concat_tables(out)
        return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    kind_of_id = base.schema["doc_id"].dataType.simpleString()
    return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind_of_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
