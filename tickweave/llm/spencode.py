"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.llm.common import in_lots, return_memory
from tickweave.llm.textnum import WINDOW, buffers, mix, span_hashes

#: Where the tokenizer file is, in the driver's file system; executors get its pieces by broadcast.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Probability that a candidate merge is skipped, and the seed.
DROPOUT, SEED = 0.1, 20
#: Segmentations without skips that a worker remembers, words that are segmented at once, and bytes of texts that are encoded at once.
REMEMBERED, MANY, TEXTS = 1_000_000, 20_000, 2 << 20
#: Ids that are decoded at once.
IDS = 1 << 20
#: Longer words have an agenda of their own, and aren't remembered.
LONG = 64
_NEVER = np.int32(2**31 - 1)
SPACE = "▁"
_MASK = (1 << 64) - 1


@dataclass
class Pieces:
    """What is needed of a model.

    rank: of the pieces that merges may make, 0 first; ids: of normal pieces; raw: each id's bytes; first_byte: id of <0x00>.
    pairs: left id * 2**32 + right id of all pairs that make a piece, ascending, with the piece's id and rank.
    chars: each code point's id, or the number of ids plus the code point where it has none.
    """

    rank: dict[str, int]
    ids: dict[str, int]
    raw: list[bytes]
    first_byte: int
    pairs: np.ndarray
    pair_id: np.ndarray
    pair_rank: np.ndarray
    chars: np.ndarray


def load_pieces(path: str = MODEL) -> Pieces:
    import sentencepiece

    with open(path, "rb") as f:
        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    places = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
    ids = {sp.id_to_piece(i): i for i in normal}
    rank = {p: places[sp.get_score(i)] for p, i in ids.items()}
    raw = [b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
    first_byte = next(i for i in range(n) if sp.is_byte(i))
    for b in range(256):
        raw[first_byte + b] = bytes([b])
    made = sorted((ids[p[:k]] << 32 | ids[p[k:]], i, rank[p]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
    chars = np.arange(0x110000, dtype=np.int32) + n
    for p, i in ids.items():
        if len(p) == 1 and p != SPACE:
            chars[ord(p)] = i
    chars[ord(" ")] = ids.get(SPACE, n + ord(" "))
    pairs, pair_id, pair_rank = (np.array(x) for x in zip(*made, strict=True))
    return Pieces(rank, ids, raw, first_byte, pairs, pair_id.astype(np.int32), pair_rank.astype(np.int32), chars)


def merge_symbols(symbols: list[str], rank: dict[str, int], salt: int = 0, skip_below: int = 0) -> list[str]:
    """Merge neighbours, best rank first, then leftmost, till the agenda is empty.

    A candidate that comes up is skipped for good where its keyed hash (of ``salt``, its place and its rank) is
    under ``skip_below`` (of 2**32); a merge beside it makes new candidates.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int]] = []
    for i in range(n - 1):
        r = rank.get(symbols[i] + symbols[i + 1])
        if r is not None:
            agenda.append((r, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
    heapq.heapify(agenda)
    while agenda:
        r, i, j, size = heapq.heappop(agenda)
        a, b = symbols[i], symbols[j]
        if not a or not b or len(a) + len(b) != size:
            continue
        if skip_below:
            h = ((salt ^ (r * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F + j * 0x165667B19E3779F9)) * 0xBF58476D1CE4E5B9) & _MASK
            if (((h ^ (h >> 29)) * 0x94D049BB133111EB) & _MASK) >> 32 < skip_below:
                continue
        symbols[i], symbols[j] = a + b, ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = rank.get(symbols[i] + symbols[k])
            if r is not None:
                heapq.heappush(agenda, (r, i, k, len(symbols[i]) + len(symbols[k])))
        k = before[i]
        if k >= 0:
            r = rank.get(symbols[k] + symbols[i])
            if r is not None:
                heapq.heappush(agenda, (r, k, i, len(symbols[k]) + len(symbols[i])))
    return [s for s in symbols if s]


def run(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, and so on."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def spread(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return values[run(first, size)]


class Encoder:
    """Encodes texts to ids and back.

    A text gets a space in front; spaces become U+2581. No piece has that mark after another character, so
    the text is cut before each run of spaces, and each part is segmented alone. A U+2581 of the text itself goes as bytes,
    as does any character without a piece, so that decoding gives back every text.

    The word at place i of a text with key k skips merges by a hash of (seed, k, i, word, place, merge), so each occurrence
    of a word has skips of its own. A word's segmentation without skips is remembered with its merges, those of the last lot of texts
    for the next one; an occurrence that skips none of these merges has it, and each other one is segmented anew.
    """

    def __init__(self, pieces: Pieces, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces, self.seed = pieces, seed
        self.skip_below = int(dropout * 2**32)
        self._forget()
        self.sizes = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Remembered words' hashes, and where their ids and merges begin, with these."""
        self.known = (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, "<i4"), np.zeros(1, np.int64), np.zeros(0, np.uint64))

    def _salts(self, hashes: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
        return mix(hashes ^ np.uint64((self.seed << 40) & _MASK) ^ (occurrences.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def _skips(self, salt: np.ndarray, merges: np.ndarray) -> np.ndarray:
        h = (salt ^ merges) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32) < np.uint64(self.skip_below)

    def word(self, word: str, occurrence: int = 0) -> np.ndarray:
        """Ids of one word, by an agenda of its own."""
        p, data = self.pieces, np.frombuffer(word.encode(), np.uint8)
        salt = int(self._salts(span_hashes(data, np.array([0]), np.array([len(data)]), lower=False), np.array([occurrence]))[0])
        symbols = [SPACE if c == " " else "\0" + SPACE if c == SPACE else c for c in word]
        out: list[int] = []
        for s in merge_symbols(symbols, p.rank, salt, self.skip_below):
            i = p.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out += [p.first_byte + b for b in (s[1:] if len(s) > 1 else s).encode()]
        return np.array(out, "<i4")

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pieces.pairs, key), len(self.pieces.pairs) - 1)
        hit = self.pieces.pairs[at] == key
        return np.where(hit, self.pieces.pair_rank[at], _NEVER), self.pieces.pair_id[at]

    def _merge_rows(self, sym: np.ndarray, salt: np.ndarray, trace: list | None = None) -> np.ndarray:
        """As ``merge_symbols`` for each row of ids; a row ends with -1s. Merged-away places become -1.

        With a ``trace`` nothing is skipped, and it gets the rows and their merges.
        """
        n, width = sym.shape
        ranks = np.full((n, width), _NEVER, np.int32)
        made = np.zeros((n, width), np.int32)
        if width > 1:
            ranks[:, :-1], made[:, :-1] = self._look(sym[:, :-1], sym[:, 1:])
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
        rows = np.arange(n)
        while len(rows):
            i = ranks[rows].argmin(1)
            r = ranks[rows, i]
            live = r < _NEVER
            rows, i, r = rows[live], i[live], r[live]
            go = rows
            if self.skip_below and len(rows):
                j = after[rows, i]
                merges = r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + i.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + j.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
                if trace is not None:
                    trace.append((rows, merges))
                else:
                    skip = self._skips(salt[rows], merges)
                    ranks[rows[skip], i[skip]] = _NEVER
                    go, i = rows[~skip], i[~skip]
            j = after[go, i]
            sym[go, i] = made[go, i]
            sym[go, j] = -1
            ranks[go, j] = _NEVER
            k = after[go, j]
            after[go, i] = k
            inside = k < width
            before[go[inside], k[inside]] = i[inside]
            right = sym[go, np.minimum(k, width - 1)]
            found, piece = self._look(sym[go, i], np.where(inside, right, -1))
            ranks[go, i], made[go, i] = found, piece
            k = before[go, i]
            has = k >= 0
            g, k, i = go[has], k[has], i[has]
            found, piece = self._look(sym[g, k], sym[g, i])
            ranks[g, k], made[g, k] = found, piece
        return sym

    def words(self, data: bytes, sizes: np.ndarray, salt: np.ndarray, occurrences: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, given as UTF-8 bytes one after another, and how many each has.

        With a ``trace`` nothing is skipped, and it gets words' numbers and merges; no word is over LONG then.
        """
        text = data.decode()
        ids = self.pieces.chars[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        heads = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        lens = np.add.reduceat(heads.astype(np.int64), np.cumsum(sizes) - sizes)
        first = np.cumsum(lens) - lens
        n, low, raw = len(sizes), 0, len(self.pieces.raw)
        counts, parts, owners = np.zeros(n, np.int64), [], []
        for width in (4, 6, 8, 10, 12, 16, 24, 40, LONG):
            mine = np.flatnonzero((lens > low) & (lens <= width))
            low = width
            if not len(mine):
                continue
            sym = np.full((len(mine), width), -1, np.int32)
            inside = np.arange(width) < lens[mine, None]
            sym[inside] = ids[(first[mine, None] + np.arange(width))[inside]]
            steps: list | None = None if trace is None else []
            sym = self._merge_rows(sym, salt[mine], steps)
            if steps:
                trace += [(mine[rows], merges) for rows, merges in steps]
            alive = sym >= 0
            flat, who = sym[alive], np.repeat(mine, alive.sum(1))
            odd = np.flatnonzero(flat >= raw)
            if len(odd):  # characters without a piece become their bytes
                points = flat[odd] - raw
                size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
                times = np.ones(len(flat), np.int64)
                times[odd] = size
                coded = np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8).astype(np.int32) + self.pieces.first_byte
                is_odd = np.repeat(flat >= raw, times)
                flat, who = np.repeat(flat, times), np.repeat(who, times)
                flat[is_odd] = coded
            np.add.at(counts, who, 1)
            parts.append(flat)
            owners.append(who)
        for m in np.flatnonzero(lens > LONG):
            found = self.word(text[first[m] : first[m] + lens[m]], int(occurrences[m]))
            counts[m] = len(found)
            parts.append(found)
            owners.append(np.full(len(found), m))
        flat, who = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (parts, owners))
        return flat[np.argsort(who, kind="stable")].astype("<i4"), counts

    def encode_column(self, column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after another, and where each text's begin."""
        data, at = buffers(column)
        full = np.diff(at) > 0
        data = np.insert(data, at[:-1][full], 32)
        at = at + np.concatenate([[0], np.cumsum(full)])
        if not len(data):
            return np.zeros(0, "<i4"), np.zeros(len(at), np.int64)
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[at[:-1][full]] = True
        starts = np.flatnonzero(start)
        lens = np.diff(np.append(starts, len(data)))
        hashes, k = np.empty(len(starts), np.uint64), 0
        while k < len(starts):
            j = max(k + 1, int(np.searchsorted(starts, starts[k] + WINDOW)))
            hashes[k:j] = span_hashes(data, starts[k:j], lens[k:j], lower=False)
            k = j
        word_at = np.searchsorted(starts, at)
        per = np.diff(word_at)
        place = np.arange(len(starts)) - np.repeat(word_at[:-1], per)
        own = mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64((self.seed * 0xC2B2AE3D27D4EB4F) & _MASK))
        occurrence = mix(np.repeat(own, per) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        salts = self._salts(hashes, occurrence)
        short = np.flatnonzero(lens <= LONG)
        unique, where, inverse = np.unique(hashes[short], return_index=True, return_inverse=True)
        where = short[where]
        known, known_at, known_ids, steps_at, known_steps = self.known
        near = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
        old = known[near] == unique if len(known) else np.zeros(len(unique), bool)
        counts, steps = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        near = near[old]
        counts[old], steps[old] = known_at[near + 1] - known_at[near], steps_at[near + 1] - steps_at[near]
        found = [(np.flatnonzero(old), spread(known_ids, known_at[near], counts[old]), spread(known_steps, steps_at[near], steps[old]))]
        new = np.flatnonzero(~old)
        for k in range(0, len(new), MANY):
            mine = new[k : k + MANY]
            first, size = starts[where[mine]], lens[where[mine]]
            trace: list = []
            ids, counts[mine] = self.words(spread(data, first, size).tobytes(), size, salts[where[mine]], occurrence[where[mine]], trace)
            who, merges = (np.concatenate(x) for x in zip(*trace, strict=True)) if trace else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            steps[mine] = np.bincount(who, minlength=len(mine))
            found.append((mine, ids, merges[np.argsort(who, kind="stable")]))
        each, step = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, steps))
        table, merges = np.empty(int(each[-1]), "<i4"), np.empty(int(step[-1]), np.uint64)
        for mine, ids, made in found:
            table[run(each[mine], counts[mine])] = ids
            merges[run(step[mine], steps[mine])] = made
        self.known = (unique, each, table, step, merges)
        if len(unique) > REMEMBERED:
            self._forget()
        anew = lens > LONG
        if self.skip_below:
            times = steps[inverse]
            skips = self._skips(np.repeat(salts[short], times), spread(merges, step[inverse], times))
            anew[np.repeat(short, times)[skips]] = True
        size = np.zeros(len(starts), np.int64)
        size[short] = counts[inverse]
        fresh, parts = np.flatnonzero(anew), []
        for k in range(0, len(fresh), MANY):
            mine = fresh[k : k + MANY]
            ids, size[mine] = self.words(spread(data, starts[mine], lens[mine]).tobytes(), lens[mine], salts[mine], occurrence[mine])
            parts.append((mine, ids))
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(int(ends[-1]), "<i4")
        same = ~anew[short]
        stay, source = short[same], inverse[same]
        flat[run(ends[stay], size[stay])] = spread(table, each[source], size[stay])
        for mine, ids in parts:
            flat[run(ends[mine], size[mine])] = ids
        return flat, ends[word_at]

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.large_string()), np.array([key]))[0]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.pieces.raw
        return b"".join([raw[i] for i in ids.tolist()])[1:].decode()

    def decode_column(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of lists of ids, that lie one after another and begin at ``at``."""
        if not len(self.sizes):
            self.sizes = np.array([len(r) for r in self.pieces.raw])
            self.first = np.cumsum(self.sizes) - self.sizes
            self.bytes = np.frombuffer(b"".join(self.pieces.raw), np.uint8)
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        data = np.empty(int(ends[-1] - ends[0]), np.uint8) if len(ends) else np.zeros(0, np.uint8)
        to = 0
        for k in range(0, len(ids), 1 << 19):
            part = slice(k, k + (1 << 19))
            piece = spread(self.bytes, self.first[ids[part]], size[part])
            data[to : to + len(piece)] = piece
            to += len(piece)
        full = np.diff(ends) > 0  # each text that isn't empty has the space in front
        keep = np.ones(len(data), bool)
        keep[ends[:-1][full]] = False
        ends = ends - np.concatenate([[0], np.cumsum(full)])
        return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[keep])])


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text in a column ``out``, and, if ``decoded`` is named, the text that these ids stand for.

    The hash that picks what a word skips is keyed by the row's id (null: 0), so a row's ids depend on its id, its
    text and ``seed`` alone. Null and empty texts have no ids, and an empty decoded text. Other columns stay as they are;
    a column that has the name of a new one is replaced. Decoding in the same pass saves each task a second Python worker.
    """
    new = [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    docs = docs.drop("_tw_key", *[f.name for f in new])
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model))
    keyed = docs.withColumn("_tw_key", F.coalesce(F.xxhash64(F.when(F.col(id_col).isNotNull(), F.col(id_col).cast("string"))), F.lit(0)))
    i, k = docs.columns.index(text_col), len(docs.columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces.value, dropout, seed)
        for b in in_lots(batches, i, TEXTS):
            flat, offsets = encoder.encode_column(b.column(i), b.column(k).to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            made = [lists, encoder.decode_column(flat, offsets)] if decoded else [lists]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *made], names=[*b.schema.names[:k], *[f.name for f in new]])
        encoder = None
        return_memory()

    return keyed.mapInArrow(each, T.StructType([*docs.schema.fields, *new]))


def decode_documents(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for; null ids give an empty text. A column named ``out`` is replaced."""
    encoded = encoded.drop(out)
    pieces = encoded.sparkSession.sparkContext.broadcast(load_pieces(model))
    i = encoded.columns.index(ids_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces.value, 0)
        for b in batches:
            lens, at = np.cumsum(pc.fill_null(pc.list_value_length(b.column(i)), 0).to_numpy()), 0
            while at < b.num_rows:
                before = lens[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(lens, before + IDS, side="right")))
                part = b.slice(at, end - at)
                texts = encoder.decode_column(part.column(i).flatten().to_numpy(), np.concatenate([[before], lens[at:end]]) - before)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*b.schema.names, out])
                at = end

    return encoded.mapInArrow(each, T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())]))
