"""Toxicity: a convolutional text classifier trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import in_lots, return_memory, text_of
from tickweave.llm.stopwords import LANGUAGES, STOP_WORDS
from tickweave.llm.textnum import word_hashes

#: Embedding rows for words and for word beginnings (of HEAD bytes), embedding size, filter widths, filters of each width.
WORD_ROWS, HEAD_ROWS, HEAD, SIZE, WIDTHS, FILTERS = 1 << 17, 1 << 14, 4, 16, (1, 2, 3), 8
#: Labelled rows to fit on, at most: with label 1 and with label 0, the first by a hash of their id.
MAX_TOXIC, MAX_CLEAN = 3000, 5000
#: Bytes of their texts at most: rows in that order as long as they fit.
MAX_BYTES = 256 << 20
EPOCHS, BATCH, RATE, CALIBRATE = 6, 32, 0.05, 4
#: Words looked at in one go, and training texts hashed in one go.
CHUNK, LOT = 1 << 17, 256
_PAD = max(WIDTHS) - 1


def _stops() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words that are in one language's list alone, and the language of each."""
    seen: dict[str, list[int]] = {}
    for k, lang in enumerate(LANGUAGES):
        for w in STOP_WORDS[lang]:
            seen.setdefault(w, []).append(k)
    own = [(w, ks[0]) for w, ks in seen.items() if len(ks) == 1]
    hashes = word_hashes(pa.array([w for w, _ in own]))[0]
    order = np.argsort(hashes)
    return hashes[order], np.array([k for _, k in own])[order]


_STOP_HASHES, _STOP_LANG = _stops()


@dataclass
class Texts:
    """Embedding rows of all words, where each text's begin, and each text's language by its function words (the last: unknown)."""

    words: np.ndarray
    heads: np.ndarray
    at: np.ndarray
    lang: np.ndarray


def read_texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    hashes, at, heads = word_hashes(column, prefix=HEAD)
    n = len(at) - 1
    place = np.minimum(np.searchsorted(_STOP_HASHES, hashes), len(_STOP_HASHES) - 1)
    hit = np.flatnonzero(_STOP_HASHES[place] == hashes)
    text = np.searchsorted(at, hit, side="right") - 1
    votes = np.bincount(text * len(LANGUAGES) + _STOP_LANG[place[hit]], minlength=n * len(LANGUAGES)).reshape(n, len(LANGUAGES))
    lang = np.where(votes.max(1, initial=0) > 0, votes.argmax(1) if n else 0, len(LANGUAGES))
    return Texts((hashes % np.uint64(WORD_ROWS)).astype(np.int32), (heads % np.uint64(HEAD_ROWS)).astype(np.int32), at, lang)


def read_in_lots(column: pa.ChunkedArray, lot: int = LOT) -> Texts:
    """As ``read_texts``, with hashes of only ``lot`` texts at a time in memory."""
    parts = [read_texts(column.slice(i, lot)) for i in range(0, max(1, len(column)), lot)]
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.at) for p in parts]))])
    return Texts(np.concatenate([p.words for p in parts]), np.concatenate([p.heads for p in parts]), at, np.concatenate([p.lang for p in parts]))


@dataclass
class ToxicModel:
    """words, heads: embedding rows, a last row of zeros for padding. filters: for each width, (width * SIZE, FILTERS). shift: by language."""

    words: np.ndarray
    heads: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: np.ndarray

    def embed(self, words: np.ndarray, heads: np.ndarray) -> np.ndarray:
        return self.words[words] + self.heads[heads]

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """All filters at all places of the embedded words ``x``; _PAD rows at its end aren't starts."""
        n = len(x) - _PAD
        parts = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            y = x[:n] @ f[:SIZE]
            for j in range(1, w):
                y += x[j : j + n] @ f[j * SIZE : (j + 1) * SIZE]
            parts.append(y)
        return np.concatenate(parts, 1) + self.bias

    def pool(self, t: Texts) -> np.ndarray:
        """Each text's features: the largest output of each filter over the whole text, at least 0."""
        n = len(t.at) - 1
        features = np.zeros((n, len(self.bias)), np.float32)
        i, begin = 0, 0
        while i < n:
            if t.at[i + 1] - begin > CHUNK:  # a long text goes in parts that overlap
                end = begin + CHUNK
                part = self._flat(t, [(begin, end + _PAD)])
                features[i] = np.maximum(features[i], part[0])
                begin = end
                continue
            j, spans = i, []
            while j < n and t.at[j + 1] - begin <= CHUNK:
                spans.append((int(begin) if j == i else int(t.at[j]), int(t.at[j + 1])))
                j += 1
            features[i:j] = np.maximum(features[i:j], self._flat(t, spans))
            i, begin = j, t.at[j]
        return features

    def _flat(self, t: Texts, spans: list[tuple[int, int]]) -> np.ndarray:
        lens = np.array([b - a for a, b in spans]) + _PAD
        starts = np.cumsum(lens) - lens
        words = np.full(int(lens.sum()) + _PAD, WORD_ROWS)
        heads = np.full(len(words), HEAD_ROWS)
        real = np.zeros(len(words) - _PAD, bool)
        for (a, b), s in zip(spans, starts, strict=True):
            b = min(b, len(t.words))
            words[s : s + b - a], heads[s : s + b - a] = t.words[a:b], t.heads[a:b]
            real[s : s + b - a] = True
        y = self.convolve(self.embed(words, heads))
        y[~real] = 0
        return np.maximum(np.maximum.reduceat(y, starts), 0)

    def logits(self, t: Texts) -> np.ndarray:
        return self.pool(t) @ self.out + self.out_bias

    def scores(self, t: Texts) -> np.ndarray:
        z = self.logits(t) - self.shift[t.lang]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500)))


def _standing(ids: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """For each embedding row, how far the label's share among texts with it is from the usual, in standard deviations."""
    key = np.repeat(np.arange(len(label), dtype=np.int64) * rows, np.diff(at))
    key += ids
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    pairs = key[new]
    del key, new
    texts, row = pairs // rows, pairs % rows
    share = float(np.average(label, weights=weight))
    n, k = np.bincount(row, weight[texts], rows), np.bincount(row, (weight * label)[texts], rows)
    z = (k - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9) + 1e-6)
    return np.clip(np.where(n > 0, z, 0), -4, 10) / 4


def fit(texts: Texts, label: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> ToxicModel:
    """Train on most texts by Adagrad on the logistic loss; each CALIBRATE-th text is left out for the thresholds.

    The first two embedding columns begin as the standing of a word and of its beginning among labels, all
    else at random; two filters of width 1 begin as these columns. Gradients reach, through the max
    pooling, the places that gave each feature.
    """
    rng = np.random.default_rng(seed)
    n_features = FILTERS * len(WIDTHS)
    draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    model = ToxicModel(
        np.concatenate([draw(WORD_ROWS, SIZE), np.zeros((1, SIZE), np.float32)]),
        np.concatenate([draw(HEAD_ROWS, SIZE), np.zeros((1, SIZE), np.float32)]),
        [draw(w * SIZE, FILTERS) * 1.0 for w in WIDTHS], np.zeros(n_features, np.float32),
        draw(n_features), 0.0, np.zeros(len(LANGUAGES) + 1, np.float32),
    )
    n = len(label)
    if n == 0 or label.min() == label.max():
        model.out[:], model.out_bias = 0, (-4.0 if n == 0 or label.max() == 0 else 4.0)
        return model
    order = rng.permutation(n)
    left_out, used = order[::CALIBRATE], np.setdiff1d(order, order[::CALIBRATE])
    if len(left_out) < 40 or label[left_out].sum() < 5:
        left_out = used = np.sort(order)
    is_used = np.zeros(n, bool)
    is_used[used] = True  # in ascending order
    at = np.concatenate([[0], np.cumsum(np.diff(texts.at)[used])])
    flat = np.repeat(is_used, np.diff(texts.at))
    weight = np.where(label == 1, 0.5 / label[used].mean(), 0.5 / (1 - label[used].mean())) if 0 < label[used].mean() < 1 else np.ones(n)
    model.words[:-1, 0] = _standing(texts.words[flat], at, label[used], np.ones(len(used)), WORD_ROWS)
    model.heads[:-1, 0] = 0
    model.heads[:-1, 1] = _standing(texts.heads[flat], at, label[used], np.ones(len(used)), HEAD_ROWS)
    model.words[:-1, 1] = 0
    for k in (0, 1):
        model.filters[0][:, k] = 0
        model.filters[0][k, k] = 1
        model.out[k] = 1
    squares = [np.full_like(x, 0.1) for x in (model.words, model.heads, *model.filters, model.bias, model.out)]
    out_square = 0.1
    for _ in range(epochs):
        for b in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            g_filters = [np.zeros_like(f) for f in model.filters]
            g_bias, g_out, g_one = np.zeros_like(model.bias), np.zeros_like(model.out), 0.0
            touched: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i in b:
                a, e = texts.at[i], texts.at[i + 1]
                words = np.append(texts.words[a:e], [WORD_ROWS] * _PAD)
                heads = np.append(texts.heads[a:e], [HEAD_ROWS] * _PAD)
                if e == a:
                    f, best, x = np.zeros(n_features, np.float32), None, None
                else:
                    x = model.embed(words, heads)
                    y = model.convolve(x)
                    best = y.argmax(0)
                    f = np.maximum(y[best, np.arange(n_features)], 0)
                p = 1 / (1 + np.exp(-np.clip(float(f @ model.out + model.out_bias), -30, 30)))
                d = (p - label[i]) * weight[i] / len(b)
                g_out += d * f
                g_one += d
                if best is None:
                    continue
                df = np.where(f > 0, d * model.out, 0).astype(np.float32)
                g_bias += df
                for w_i, w in enumerate(WIDTHS):
                    cols = slice(w_i * FILTERS, (w_i + 1) * FILTERS)
                    for j in range(w):
                        rows = best[cols] + j
                        g_filters[w_i][j * SIZE : (j + 1) * SIZE] += x[rows].T * df[cols]
                        touched.append((words[rows], heads[rows], (model.filters[w_i][j * SIZE : (j + 1) * SIZE] * df[cols]).T))
            if touched:
                grads = np.concatenate([g for _, _, g in touched])
                for table, square, ids, pad in ((model.words, squares[0], [w for w, _, _ in touched], WORD_ROWS), (model.heads, squares[1], [h for _, h, _ in touched], HEAD_ROWS)):
                    rows, inverse = np.unique(np.concatenate(ids), return_inverse=True)
                    total = np.zeros((len(rows), SIZE), np.float32)
                    np.add.at(total, inverse, grads)
                    total[rows == pad] = 0
                    square[rows] += total**2
                    table[rows] -= RATE * total / np.sqrt(square[rows])
            for value, square, g in zip((*model.filters, model.bias, model.out), squares[2:], (*g_filters, g_bias, g_out), strict=True):
                square += g**2
                value -= RATE * g / np.sqrt(square)
            out_square += g_one**2
            model.out_bias -= RATE * g_one / out_square**0.5
    logits, lang = [], []
    for i in left_out:
        one = Texts(texts.words[texts.at[i] : texts.at[i + 1]], texts.heads[texts.at[i] : texts.at[i + 1]], np.array([0, texts.at[i + 1] - texts.at[i]]), texts.lang[i : i + 1])
        logits.append(float(model.logits(one)[0]))
        lang.append(int(texts.lang[i]))
    logits, lang, truth = np.array(logits), np.array(lang), label[left_out]
    every = threshold(logits, truth)
    model.shift[:] = every
    for k in range(len(LANGUAGES)):
        mine = lang == k
        if truth[mine].sum() >= 5 and (1 - truth[mine]).sum() >= 5:
            model.shift[k] = threshold(logits[mine], truth[mine])
    return model


def threshold(logits: np.ndarray, label: np.ndarray) -> float:
    """The cut with the best F1; of cuts as good, the middle of the widest gap between neighbouring logits."""
    order = np.argsort(logits)
    z, y = logits[order], label[order]
    total = y.sum()
    above = total - np.concatenate([[0], np.cumsum(y)])
    called = len(y) - np.arange(len(y) + 1)
    f1 = 2 * above / np.maximum(called + total, 1)
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = edges[1:] - edges[:-1]
    ok = np.flatnonzero((f1 >= f1.max() - 1e-12) & (gap > 0))
    k = ok[np.argmax(gap[ok])]
    return float((edges[k] + edges[k + 1]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> tuple[pa.Table, np.ndarray]:
    """Whole texts and labels of at most ``max_toxic`` and ``max_clean`` labelled rows for which ``use`` holds, the first by a hash of their ids.

    With more than ``max_bytes`` of texts, the first of both kinds together that fit. Rows without id or label don't count; an id with
    several labels is toxic if one says so; of several texts of an id the least one is taken. Repeats go before anything is collected.
    """
    known = labels.where(use & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    order = [F.xxhash64("id", F.lit(5)), "id"]
    drawn = known.where("label = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("label = 0").orderBy(*order).limit(max_clean))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    sizes = texts.select("id", F.octet_length("text").alias("size")).join(F.broadcast(drawn), "id").groupBy("id").agg(F.max("size").alias("size"))
    fits, used = [], 0
    for r in sorted(sizes.select("id", "size", F.xxhash64("id", F.lit(5)).alias("h")).collect(), key=lambda r: (r["h"], r["id"])):
        used += r["size"]
        if used > max_bytes:
            break
        fits.append((r["id"],))
    if used > max_bytes:
        drawn = drawn.join(docs.sparkSession.createDataFrame(fits, sizes.select("id").schema), "id")
    found = texts.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).toArrow().sort_by("id")
    return found.column("text"), found.column("label").to_numpy().astype(np.float64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column | None = None, **names) -> ToxicModel:
    """Fit on labelled rows whose id's crc32 as text isn't 0 modulo 5, or for which ``use`` (on ``labels``) holds."""
    use = F.crc32(F.col(names.get("id_col", "doc_id")).cast("string")) % 5 != 0 if use is None else use
    texts, label = training_rows(docs, labels, use, **names)
    words = read_in_lots(texts)
    del texts
    return_memory()
    model = fit(words, label)
    del words
    return_memory()
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of each whole text, 0 to 1; 0.5 is its language's threshold.

    The language comes from the text's function words, never from a column. A null text counts as empty and
    gets the score of a text without words. Row order, repeated rows and other columns don't matter; a column that has the
    name ``out`` is replaced. An empty table gives no rows.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    i, text = docs.columns.index(text_col), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_lots(batches, i):
            scores = pa.array(shared.value.scores(read_texts(b.column(i))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, text])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)


def drop_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; columns stay as they are.

    A null text counts as empty; repeated rows share their fate; an empty table gives no rows. A column named _tw_toxicity must not exist.
    """
    return score_toxicity(docs, model, text_col, "_tw_toxicity").where(F.col("_tw_toxicity") < 0.5).drop("_tw_toxicity")
