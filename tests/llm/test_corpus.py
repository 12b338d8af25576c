"""Corpus operators against brute force on small tables, with nulls, ties, empty tables and clashing names."""

import hashlib
import html
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickweave.llm import exact_dedup, fingerprint, html_extract, lm, minhash, mixing, quotes, sharding, spencode, textnum, topics, toxicity
from tickweave.llm.components import components
from tickweave.llm.queries import op5_exact_dedup, oracle_sql, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, node long, block int"
ODD = [(900, None), (901, ""), (902, "a"), (903, "  a\n"), (904, "b" * 5000), (905, "Ünï ▁ cödé \x00 é"), (None, "x y"), (906, "x y"), (907, "x  y"), (907, "x  y")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 120").collect()]
    rows += [(i, t, None, None, None) for i, t in ODD]
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_words():
    x = ["Aa b\tc", "", None, "é\x0bÉ  é", "x" * 300, "\n"]
    old = textnum.WINDOW
    for window in (7, old):
        textnum.WINDOW = window
        hashes, at = textnum.word_hashes(pa.array(x))
        assert np.diff(at).tolist() == [3, 0, 0, 3, 1, 0] and hashes[3] == hashes[5] != hashes[4]
    textnum.WINDOW = old
    assert textnum.word_hashes(pa.array(["AA"]))[0] == textnum.word_hashes(pa.array(["aa"]))[0]
    assert len(textnum.word_hashes(pa.array([], pa.string()))[1]) == 1


def test_sharding(docs, texts):
    out = sharding.shard_documents(docs, 7).toPandas()
    assert len(out) == len(texts) and (out.law == "bytes").all()
    assert sorted(zip(out["size"], out.text_crc32)) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in texts)
    g = out.groupby("shard")
    assert all(sorted(s) == list(range(len(s))) for _, s in g.slot)
    mean = out["size"].sum() / 7
    assert (g["size"].sum() - mean).abs().max() <= out["size"].max() + 2 * sharding.TOLERANCE * mean
    same = sharding.shard_documents(docs.repartition(5), 7).toPandas()
    assert Counter(zip(out.doc_id.fillna(-1), out.shard, out["size"])) == Counter(zip(same.doc_id.fillna(-1), same.shard, same["size"]))
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    spark = docs.sparkSession
    hot = spark.range(30000).select(F.lit("one").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.range(20000).select(F.col("id").cast("string").alias("doc_id"), F.lit("same").alias("text")))
    out = sharding.shard_documents(hot.unionByName(spark.createDataFrame([(None, "y" * 9)] * 3, "doc_id string, text string")), 8).toPandas()
    assert (out.groupby("shard").size() - len(out) / 8).abs().max() <= 1 + 3 * sharding.TOLERANCE * len(out) / 8
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard").slot)


def test_sharding_goes_by_its_ranges(docs, texts, monkeypatch):
    """A shard is a run of whole ranges between splitters, found again here from the splitters; without splitters there is one range."""
    seen = []
    real = sharding.range_index
    monkeypatch.setattr(sharding, "range_index", lambda key, bounds, literal: seen.append(bounds) or real(key, bounds, literal))
    out = sharding.shard_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), 5)
    keys = out.join(docs.dropDuplicates(["doc_id"]), "doc_id").select("shard", "slot", "size", F.concat(F.lpad(F.hex(F.xxhash64(F.coalesce("text", F.lit("")))), 16, "0"), F.lpad(F.hex(F.xxhash64(F.col("doc_id").cast("string"))), 16, "0")).alias("k")).collect()
    bounds, total = seen[-1], sum(r["size"] for r in keys)
    assert len(seen) > 1 and set(seen[0]) < set(bounds)
    ranges = {}
    for r in keys:
        ranges.setdefault(sum(b <= r["k"] + "0" * 16 for b in bounds), []).append(r)
    at, line = 0, []
    for _, rs in sorted(ranges.items()):
        size = sum(r["size"] for r in rs)
        assert {r["shard"] for r in rs} == {min(4, int((at + size / 2) * 5 / total))}
        at += size
        line += sorted(rs, key=lambda r: r["k"])
    assert [(r["shard"], r["slot"]) for r in line] == sorted((r["shard"], r["slot"]) for r in line)
    monkeypatch.setattr(sharding, "_quantiles", lambda sample, parts: set())
    monkeypatch.setattr(sharding, "TOLERANCE", 9.0)
    monkeypatch.setattr(sharding, "OVERFULL", 1e9)
    assert sharding.shard_documents(docs, 5).select("shard").distinct().count() == 1


def test_exact_dedup(docs, texts):
    import re

    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in texts]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    want = Counter((i, min([x for x in groups[t] if x is not None], default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    weak = [{}, {"hash_of": lambda t: F.length(t).cast("long")}, {"hash_of": lambda t: F.lit(1).cast("long"), "digest_of": lambda t: F.length(t).cast("string")}, {"capacity": 4, "max_depth": 6}]
    for options in weak:
        out = exact_dedup.exact_duplicates(docs, **options).collect()
        if "digest_of" not in options:
            assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == Counter(k[:3] for k in want.elements())
        assert sum(r["kept"] for r in out) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.count() == len(groups) and kept.columns == docs.columns
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_exact_dedup_by_buckets(spark, tmp_path, monkeypatch):
    """A third of all rows are copies, many hashes collide: the index is laid out by bucket, and each bucket is one owner's."""
    rows = [(k, "hot" if k % 3 == 0 else f"t{k % 300}") for k in range(3000)] + [(None, "hot"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    real = exact_dedup.materialize
    monkeypatch.setattr(exact_dedup, "materialize", lambda d, tag: kept.append((tag, real(d, tag))) or kept[-1][1])
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for hash_of in (F.xxhash64, lambda t: F.shiftleft(F.pmod(F.xxhash64(t), F.lit(40)), 57)):
        kept.clear()
        out = exact_dedup.exact_duplicates(df, capacity=8, hash_of=hash_of).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == Counter((i, min(x for x in g if x is not None), len(g)) for g in groups.values() for i in g)
        index = dict(kept)["exact-index"]
        assert index.select("bucket", F.input_file_name()).distinct().groupBy("bucket").count().where("count > 1").isEmpty()
        assert index.select("bucket").distinct().count() >= 5 and index.count() == len(groups)


def test_directory():
    rng = random.Random(1)
    counts = {p: rng.choice([0, 1, 50]) for p in range(256)} | {7: 1000}
    depth, slots = exact_dedup.build_directory(counts, 100, 8)
    assert len(slots) == 1 << depth and slots == sorted(slots)
    held = Counter()
    for p, n in counts.items():
        held[slots[p >> (8 - depth)]] += n
    assert all(n <= 100 or n >= 1000 for n in held.values())
    assert exact_dedup.build_directory({}, 10, 4) == (0, [0])


def test_fingerprints(docs, texts):
    out = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in fingerprint.fingerprint_neighbours(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    order = sorted({i: t for i, t in texts if i is not None}.items(), reverse=True)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = out[i, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        for other, near in ((edited, r["near_edited"]), (following, r["near_next"])):
            a, b = shingles(t), shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - exact) <= (0.2 if len(a | b) > fingerprint.K else 1e-12)
        assert abs(fingerprint.distinct_shingles(fingerprint.decode(r["fingerprint"])) - len(shingles(t))) <= 0.4 * len(shingles(t))
    a, b = fingerprint.sketches(["one two three four five six seven", "five six seven eight nine ten"])
    assert (fingerprint.merge([a, b]) == np.unique(np.concatenate([a, b]))).all()
    assert fingerprint.containment(a, fingerprint.merge([a, b])) == 1.0
    assert fingerprint.fingerprint_neighbours(docs.limit(0)).count() == 0
    assert fingerprint.fingerprint_neighbours(docs).count() == len(texts)
    assert fingerprint.fingerprint_column(docs).columns == [*docs.columns, "fingerprint"]


def test_sentencepiece(docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spencode.MODEL)
    pieces = spencode.load_pieces()
    plain, varied = spencode.Encoder(pieces, 0), spencode.Encoder(pieces, 0.2, seed=1)
    for _, t in texts[:60]:
        if "▁" not in t:
            assert plain.encode(t).tolist() == sp.encode(t)
    for t in (" ", "  a  b ", "a▁b", "\0▁", "é你🎉", "x" * 200 + " y", ""):
        for e in (plain, varied):
            assert e.decode(e.encode(t, 5)) == t
    words = [" " + w for w in " ".join(t for _, t in texts[:20]).split(" ") if w][:300]
    raw = [w.encode() for w in words]
    sizes = np.array([len(r) for r in raw])
    hashes = textnum.span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes, lower=False)
    ids, counts = varied.words(b"".join(raw), sizes, varied._salts(hashes, np.full(len(words), 3)), np.full(len(words), 3))
    assert ids.tolist() == [x for w in words for x in varied.word(w, 3).tolist()]
    assert len({tuple(varied.encode(" information international", k)) for k in range(20)}) > 3
    out = spencode.decode_documents(spencode.encode_documents(docs))
    assert out.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0 and out.columns == [*docs.columns, "ids", "decoded"]
    again = spencode.encode_documents(docs.repartition(4))
    assert spencode.encode_documents(docs).select("doc_id", "ids").exceptAll(again.select("doc_id", "ids")).isEmpty()
    assert spencode.encode_documents(docs.limit(0)).count() == 0


def test_sentencepiece_skips_by_occurrence():
    """Each occurrence of a word skips a merge with the stated probability, whether the word is met often or in one text."""
    pieces = spencode.load_pieces()
    varied = spencode.Encoder(pieces, 0.1, seed=1)
    words = [" of", " xa", " le", " information", " international"]
    for w in (" " + p[1:] for p in pieces.ids if len(p) == 2 and p[0] == spencode.SPACE and p[1].isalpha() and p[1].isascii()):
        flat = varied.encode(" ".join([w[1:]] * 4000), 3)
        assert abs((len(flat) - 4000) / 4000 - 0.1) < 0.025, w
    texts = [" ".join(random.Random(k).choices([w[1:] for w in words] + ["é🎉", "x" * 200], k=50)) for k in range(20)]
    keys = np.arange(20) * 7919
    flat, at = varied.encode_column(pa.array(texts), keys)
    again = [spencode.Encoder(pieces, 0.1, seed=1).encode(t, k) for t, k in zip(texts, keys, strict=True)]
    assert all(flat[at[k] : at[k + 1]].tolist() == x.tolist() for k, x in enumerate(again))
    own = textnum.mix(keys[:1].view(np.uint64) ^ np.uint64((1 * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)))
    occurrences = textnum.mix(np.repeat(own, 50) + np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert flat[: at[1]].tolist() == [x for w, o in zip(texts[0].split(" "), occurrences, strict=True) for x in varied.word(" " + w, int(o)).tolist()]


def test_mixing(docs, spark):
    assert mixing.mix_documents(docs).count() == docs.count()
    # "(none)" is one cell of source and language, whose two targets can't both be met: it is left out here
    docs = docs.where("source is not null")
    out = mixing.mix_documents(docs).toPandas()
    assert len(out) == docs.count() and out.probability.between(0, 1).all()
    mass = out.tokens * out.probability
    for d in ("source", "language", "topic"):
        now = out.groupby(d).tokens.sum() / out.tokens.sum()
        goal = now.where(now > 0) ** mixing.TEMPER
        assert (mass.groupby(out[d]).sum() / mass.sum() - (goal / goal.sum()).fillna(0)).abs().max() < 1e-6
    there = mixing.mix_documents(docs, driver_cells=0).toPandas()
    assert np.allclose(sorted(out.probability), sorted(there.probability), atol=1e-9)
    given = mixing.mix_documents(docs, {"language": F.col("lang")}, {"language": {"en": 0.5, "fr": 0.5}}).toPandas()
    share = (given.tokens * given.probability).groupby(given.language).sum()
    assert share["en"] / share.sum() == pytest.approx(0.5) and share["de"] == 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.sample_mixture(docs).columns == docs.columns
    assert out.tokens.tolist() and dict(zip(out.doc_id, out.tokens)) == {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}


def naive_raking(cells, targets, dims):
    """Multiply, one dimension after the other, by target share over present share, cell by cell."""
    total = sum(cells.values())
    mass = dict(cells)
    for _ in range(400):
        for d in range(dims):
            now = Counter()
            for c, m in mass.items():
                now[c[d]] += m
            mass = {c: m * targets[d][c[d]] * total / now[c[d]] if now[c[d]] else m for c, m in mass.items()}
    return {c: mass[c] / cells[c] for c in cells if cells[c]}


def test_mixing_against_naive_raking(spark):
    rng = random.Random(9)
    rows = [(k % 900, " ".join(["w"] * rng.randrange(1, 9)), rng.choice("abc"), rng.choice("xy")) for k in range(1200)] + [(None, "w w", c, "x") for c in "abc" * 20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s string, l string")
    targets = {"s": {"a": 0.2, "b": 0.5, "c": 0.3}, "l": {"x": 0.7, "y": 0.3}}
    cells = Counter()
    for _, t, s, l in rows:
        cells[s, l] += len(t.split())
    factor = naive_raking(cells, [targets["s"], targets["l"]], 2)
    top = max(factor.values())
    out = mixing.mix_documents(docs, {"s": F.col("s"), "l": F.col("l")}, targets).collect()
    assert all(r["weight"] == pytest.approx(factor[r["s"], r["l"]], rel=1e-6) and r["probability"] == pytest.approx(factor[r["s"], r["l"]] / top, rel=1e-6) and r["fit_error"] < 1e-8 for r in out)
    kept = mixing.sample_mixture(docs, {"s": F.col("s"), "l": F.col("l")}, targets).collect()
    assert Counter((r["doc_id"], r["s"], r["l"]) for r in kept) == Counter((r["doc_id"], r["s"], r["l"]) for r in out if r["kept"])
    odds = sum(r["probability"] for r in out)
    assert abs(len(kept) - odds) < 5 * odds**0.5 + 20


def test_topics(spark):
    """Texts of one vocabulary come together, whatever the order of rows; a fit of brute force has the same centers."""
    rng = random.Random(10)
    fields = [[f"{f}{k}" for k in range(6)] for f in ("bond", "goal", "cell")]
    rows = [(k, " ".join(rng.choice(fields[k % 3]) if rng.random() < 0.6 else rng.choice(["the", "and", "of"]) for _ in range(40))) for k in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["topic"] for r in topics.document_topics(docs, topics=6).collect()}
    again = {r["doc_id"]: r["topic"] for r in topics.document_topics(docs.repartition(7), topics=6).collect()}
    assert out == again and out[300] == out[301]
    by_field = [Counter(out[k] for k in range(f, 300, 3)) for f in range(3)]
    assert all(not (set(a) & set(b)) for a, b in itertools.combinations(by_field, 2))
    found = topics.profiles(pa.array([t for _, t in rows]))[0].astype(float)
    directions = np.random.default_rng(topics.SEED).normal(0, 1, (topics.SIZE, 6))
    k, centers = ((found - found.mean(0)) @ directions).argmax(1), np.tile(found.mean(0), (6, 1))
    for _ in range(topics.ROUNDS + 1):
        for j in set(k):
            centers[j] = found[k == j].mean(0)
        k = np.array([min(range(6), key=lambda j: ((x - centers[j]) ** 2).sum()) for x in found])
    assert [out[i] for i, _ in rows] == [f"t{x}" for x in k]
    assert topics.document_topics(docs.limit(0)).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you today?"), (1, 1, "assistant", "On Monday, Ann wrote:\n> How are  you TODAY?\nI am fine"), (1, 2, "user", "> I am fine\n>> How are you today?\nGood"),
        (1, 3, "assistant", "no quote"), (2, 0, "user", "> Good\nelsewhere"), (2, 1, "user", None), (None, 1, "user", "> Hello there\nx"), (3, 0, "user", "a > b"), (1, 1, "assistant", "On Monday, Ann wrote:\n> How are  you TODAY?\nI am fine"), (4, 0, "u", "> unknown\nreply"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, h long")
    out = quotes.link_quotes(df).orderBy("root_conv", "root_turn", "depth", "conv_id", "turn").collect()
    at = {(r["conv_id"], r["turn"]): r for r in out}
    assert len(out) == 10 and at[1, 1]["text"] == "I am fine" and at[1, 2]["text"] == "Good" and at[2, 1]["text"] == ""
    assert (at[1, 1]["parent_turn"], at[1, 2]["parent_turn"], at[1, 3]["parent_turn"]) == (0, 1, None)
    assert (at[2, 0]["parent_conv"], at[2, 0]["parent_turn"], at[2, 0]["root_turn"], at[2, 0]["depth"]) == (1, 2, 0, 3)
    assert at[1, 2]["max_level"] == 2 and at[1, 1]["n_quoted"] == 1 and at[4, 0]["n_linked"] == 0
    places = [(r["conv_id"], r["turn"]) for r in out]
    assert all(r["parent_turn"] is None or places.index((r["parent_conv"], r["parent_turn"])) < places.index((r["conv_id"], r["turn"])) for r in out)
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_quotes_of_passages(spark):
    """Quotes that are wrapped anew, joined, cut out of a line, or stand in a conversation of a higher id; answers in a circle."""
    long = "The first part of this message is a long line that mail programs wrap at some place. It also has a second sentence in it. Yes."
    rows = [
        (1, 0, long), (1, 1, "> The first part of this message is a long\n> line that mail programs wrap at\n> some place. It also has\nI see"), (1, 2, "> it also has a second sentence in it.\nTrue"), (1, 3, "> Yes.\nNo"),
        (2, 0, "one short line\nand then another one"), (2, 1, "> one short line and then another one\nok"), (2, 2, "> one short line\n> of something else that nobody says\nhm"), (2, 3, "> part of this message is not a long line\nwhat"),
        (3, 0, "> words that only a later conversation has\nmine"), (9, 0, "Here are words that only a later conversation has"),
        (5, 0, "> six says these four words\nfive says these four words"), (6, 0, "> five says these four words\nsix says these four words"),
    ]
    out = quotes.link_quotes(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    at = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"], r["n_quoted"], r["n_linked"], r["depth"]) for r in out}
    assert at[1, 1] == (1, 0, 3, 3, 1) and at[1, 2] == (1, 0, 1, 1, 1) and at[1, 3] == (1, 0, 1, 1, 1)
    assert at[2, 1] == (2, 0, 1, 1, 1) and at[2, 2] == (2, 0, 2, 1, 1) and at[2, 3] == (None, None, 1, 0, 0)
    assert at[3, 0] == (9, 0, 1, 1, 1) and at[5, 0] == (None, None, 1, 1, 0) and at[6, 0] == (5, 0, 1, 1, 1)


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site, and it is what you have to know of it.</p></div><div class="ad">Buy it.</div>
    <article><h1>A &amp; B</h1><p><b>It was the best<br>of&nbsp;times.<p>Short.</p><!-- no --><p>caf&eacute; &#8212; x</p><aside>Aside</aside><form><p>Name</p></form></article>
    <section id="comments"><p>I think that this is the best of all that I have read.</p></section><footer>&copy; 2020</footer>"""
    assert html_extract.main_text(page) == "A & B\n\nIt was the best of times.\n\nShort.\n\ncafé — x"
    soup = "<div class=sidebar>More</div><div><p>" + "It was the best of times and it was the worst of times. " * 5 + "</p><p>Yes.</p><p><a href=x>Link to it</a></p></div>"
    assert html_extract.main_text(soup).endswith("\n\nYes.") and "More" not in html_extract.main_text(soup)
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (None, "v", "", 1), (3, "w", "<<>>< p", 1), (4, "x", "<p>" + "the word is of it " * 5000, 1)], "page_id long, url string, html string, text int")
    out = {r["page_id"]: r for r in html_extract.extract_pages(df).collect()}
    assert out[2]["text"] == "" and out[1]["n_chars"] == len(out[1]["text"]) and out[4]["n_chars"] == 5000 * 18 - 1 and len(out) == 5
    assert html.unescape("&eacute;") in out[1]["text"] and html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_prose_overrules_names():
    """Articles in wrappers with boilerplate names or forms, and bodies beside a good name, aren't lost; comments still are."""
    said = "It was the best of times and it was the worst of times, and this is what we have to say of it. "
    body, nav = f"<p>{said * 4}</p><p>{said * 3}</p>", "<nav><a href=/>Home</a></nav>"
    want = "\n\n".join([(said * 4).strip(), (said * 3).strip()])
    wraps = ["<form id=aspnetForm>%s</form>", "<div class='layout has-sidebar'>%s</div>", "<div class=content-with-ads>%s</div>", "<div id=search-results>%s</div>"]
    for w in wraps:
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
            assert html_extract.main_text(nav + w % inner) == want, (w, inner)
    assert html_extract.main_text(f"{nav}<h1 class='post-title'>T</h1><div class='text'>{body}</div>") == "T\n\n" + want
    comments = f"<div id=comments>{body * 5}</div><aside>{body}</aside><div style='display:none'>{body}</div>"
    assert html_extract.main_text(f"<article>{body}</article>{comments}") == want
    assert html_extract.main_text(f"<div style='display:none'><article>{body}</article></div>") == ""


def test_html_names_of_layout_and_odd_markup():
    said = "It was the best of times and it was the worst of times, and this is what we have to say of it. "
    odd = "Zzyx qwv plok mnbt rrty, ghjk vbnm tyui opas dfgh jklz xcvb nmqw erty. " * 4
    for text in (said * 4, odd):
        text = text.strip()
        for start, end in (("<main class='page with-sidebar'>", "</main>"), ("<div class='post has-comments'>", "</div>"), ("<article class=no-sidebar>", "</article>"), ("<article>", "</article>")):
            assert html_extract.main_text(f"<nav><a href=x>A</a></nav>{start}<p title=it's>{text}</p>{end}<footer>f</footer>") == text
    assert html_extract.main_text(f"<article><p>{said}Now <span class=ad>these</span> words<span hidden> not</span>.</p><article class=comment><p>{said}</p></article></article>") == said + "Now these words."
    assert html_extract.main_text("<p>" + said * 3 + '<a title="a > b" href=x>y</a></p>') == said * 3 + "y"
    began = time.time()
    deep = "<div>" * 20000 + said * 3 + "</p></section>" * 20000
    assert html_extract.main_text(deep) == (said * 3).strip()
    assert html_extract.main_text("<svg><span hidden><b>" * 20000 + said * 3) and html_extract.main_text("<p>a " * 30000) == ""
    assert time.time() - began < 20


def test_html_densities_decide(spark):
    """Without marks, and under them: labels come from densities, ambiguous blocks from a second pass as brute force does it."""
    words, rng = ["the", "and", "of", "was"], random.Random(6)
    for mark in (False, True):
        for _ in range(300):
            page, kinds = [], []
            for k in range(rng.randrange(1, 12)):
                kind = rng.choice(["prose", "short", "links", "names", "middling"])
                n, stop = {"prose": (40, 0.5), "short": (4, 0.5), "links": (20, 0.3), "names": (40, 0.0), "middling": (20, 0.2)}[kind]
                text = " ".join(words[j % 4] if j < n * stop else f"Nm{k}x{j}" for j in range(n))
                kinds.append((kind, text))
                page.append(f"<p>{'<a href=u>' if kind == 'links' else ''}{text}{'</a>' if kind == 'links' else ''}</p>")
            first = [{"prose": True, "links": False, "names": None if mark else False}.get(kind) for kind, _ in kinds]
            if mark and True not in first:
                want = [x is None for x in first]
            else:
                want = []
                for i, x in enumerate(first):
                    near = sorted((abs(i - j), not y) for j, y in enumerate(first) if y is not None)
                    want.append(x if x is not None else bool(near) and not near[0][1])
            if mark or True in first:
                text = ("<article>%s</article>" if mark else "<div>%s</div>") % "".join(page)
                assert html_extract.main_text(text) == "\n\n".join(t for (_, t), w in zip(kinds, want) if w), (mark, kinds)


def test_lm(docs, texts):
    out = lm.score_documents(docs, block_bytes=1 << 14).collect()
    words = [(i, t.encode().lower().split() + [None]) for i, t in texts]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    train = [w for i, w in words if fold(i) != 2]
    ones, pairs = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([None, *w[:-1]], w))
    total, kinds = sum(ones.values()), len(ones)
    want = Counter()
    for i, w in words:
        base = sum(math.log10((ones[x] + 1) / (total + kinds + 1)) for x in w)
        want[i, fold(i) == 2, len(w), sum(ones[x] > 0 for x in w), total, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] <= 0 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert pairs and lm.score_documents(docs.limit(0)).count() == 0
    rng = np.random.default_rng(0)
    p2, p1 = rng.random(500), rng.random(500)
    w = lm.learn_weights([(3, 1, math.log(a), math.log(b)) for a, b in zip(p2, p1)], 99, prior=0.0)[3]
    like = lambda v: np.log(v[0] * p2 + v[1] * p1 + v[2] / 100).sum()
    assert all(like(w) >= like(v) - 1e-3 for v in rng.dirichlet([1, 1, 1], 200))


def test_near_duplicates(spark, docs, texts):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    made, at = [], 1000
    for _ in range(15):
        words = [rng.choice(vocabulary) for _ in range(120)]
        for edits in (0, 0, 1, 2, 4, 8):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(120)] = rng.choice(vocabulary)
            made.append((at, " ".join(w), *[None] * 7))
            at += 1
    both = docs.unionByName(spark.createDataFrame(made, SCHEMA))
    rows = [(i, t) for i, t in texts] + [(m[0], m[1]) for m in made]
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            same = rows[a][1].encode().lower().split() == rows[b][1].encode().lower().split()
            if same or (x and y and len(x & y) / len(x | y) >= 0.8):
                parent[find(a)] = find(b)
    classes = {}
    for k, (i, _) in enumerate(rows):
        classes.setdefault(find(k), []).append(i)
    want = Counter((i, min((x for x in c if x is not None), default=None), len(c)) for c in classes.values() for i in c)
    out = minhash.near_duplicates(both).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(classes)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Repeated rows, an id with several texts, null ids and texts, a clashing column: one row of each class stays."""
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one, "x"), (1, one, "x"), (1, other, "y"), (0, other, "z"), (2, one + " end", "w"), (3, None, "n"), (3, None, "n"), (None, "alone", "q"), (None, "alone", "q"), (4, "five words only in here", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = sorted(map(tuple, minhash.drop_near_duplicates(docs).collect()), key=str)
    assert out == sorted([(1, one, "x"), (0, other, "z"), (3, None, "n"), (None, "alone", "q"), (4, "five words only in here", "k")], key=str)
    assert sorted(map(tuple, minhash.drop_near_duplicates(docs.where("doc_id in (0, 2, 4)")).collect()))[0] == (0, other, "z")
    assert minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_with_repeated_blocks(spark):
    """Texts that differ in how often a passage recurs: the sets are alike, so each group is one class."""
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for times in (1, 2, 4, 16):
            rows.append((at, " ".join(words * times)))
            at += 1
        rows.append((at, " ".join(words[:150] + words[100:150] * 8 + words[150:])))
        at += 1
    sets = [shingles(t) for _, t in rows]
    assert all((len(x & y) / len(x | y) >= 0.8) == (a // 5 == b // 5) for a, x in enumerate(sets) for b, y in enumerate(sets))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in out} == {i: (i // 5 * 5, 5) for i, _ in rows}


def components_of(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


def test_near_duplicates_recall(spark):
    """All links that brute force finds in a table of the test data are found: the classes are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    sets, holders = [shingles(t) for _, t in rows], {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    common = Counter(p for ks in holders.values() for p in itertools.combinations(ks, 2))
    links = [(a, b) for (a, b), n in common.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    assert sum(sets[a] != sets[b] for a, b in links) > 10
    empty = [k for k, s in enumerate(sets) if not s]
    comp = components_of(links + [(empty[0], k) for k in empty], len(rows))
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, i), i)
    out = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: out[i]["class_id"] for i, _ in rows} == {i: least[c] for (i, _), c in zip(rows, comp)}
    linked = {rows[k][0] for a, b in links for k in (a, b) if sets[a] != sets[b]}
    assert {i for i, r in out.items() if r["n_links"]} == linked


def test_near_duplicates_left_over(spark):
    """Texts of one bucket that aren't like its least member: chains, groups, and strangers that share most of their shingles."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(100)]
    texts = []
    for start in range(0, 60, 3):  # a chain: only near ones are alike
        texts.append([f"x{k}" if k < start else w for k, w in enumerate(words)])
    for _ in range(30):  # a passage that all share, and words of their own
        texts.append(words[:70] + [f"y{rng.randrange(10**6)}" for _ in range(30)])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    comp = components_of(links, len(rows))
    least = {c: min(k for k in range(len(rows)) if comp[k] == c) for c in comp}
    old = minhash.CHUNK
    for chunk in (4, old):
        minhash.CHUNK = chunk
        for bands in (26, 200):  # with many bands all are in common buckets
            out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=bands, rows=5 if bands == 26 else 2).collect()
            assert {r["doc_id"]: r["class_id"] for r in out} == {k: least[c] for k, c in enumerate(comp)}
    minhash.CHUNK = old
    words = " ".join(words)
    named = spark.createDataFrame([("b", words), ("a", words + " z"), (None, words), (None, None), ("c", words + (" " + words) * 3)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["class_id"] or "", r["class_size"], r["kept"]) for r in minhash.near_duplicates(named).collect()) == [("", "", 1, True), ("", "a", 4, False), ("a", "a", 4, True), ("b", "a", 4, False), ("c", "a", 4, False)]
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(named, weight="count").where("doc_id is not null").collect()} == {"a": "a", "b": "a", "c": "c"}
    null = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit(words), F.col("id")).alias("text"))
    out = minhash.near_duplicates(null.unionByName(null.limit(50)))
    assert out.count() == 3050 and out.where("kept").count() == 1 and minhash.drop_near_duplicates(null).count() == 1


def test_near_duplicates_pairs_of_a_large_group(spark, monkeypatch):
    """Near copies of a text that isn't in the table, one class in many components at first: fewer pairs are left to compare than texts."""
    rng, n = random.Random(4), 250
    words, rows = [f"w{k}" for k in range(150)], []
    for k in range(n):
        text = list(words)
        for at in rng.sample(range(150), 2):
            text[at] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    sets = [shingles(t) for _, t in rows]
    comp = components_of([(a, b) for a in range(n) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8], n)
    least, real, made = {c: min(k for k in range(n) if comp[k] == c) for c in comp}, minhash._left_pairs, []

    def counted(*args):
        pairs = real(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_left_pairs", counted)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == {k: least[c] for k, c in enumerate(comp)}
    assert made and made[0] < n, made


def test_nodes_that_share_half_a_digest(spark, monkeypatch):
    real = minhash.content_digests
    monkeypatch.setattr(minhash, "content_digests", lambda c: np.stack([real(c)[:, 0] & 3, real(c)[:, 1]], 1))
    rows = [(k, f"text of number {k // 2} and no other text") for k in range(40)]
    base = minhash._base(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    signed, nodes = minhash._nodes(base, 5, 26, 5, "set")
    assert nodes.count() == 20 and signed.select("node").distinct().count() == 20


def test_dart_signatures_estimate_weighted_similarity():
    a = np.arange(1, 301, dtype=np.uint64) * np.uint64(7919)
    b = np.concatenate([a[60:], np.arange(9000, 9060, dtype=np.uint64)])
    flat, at = np.concatenate([a, a[:50], a[:50], b]), np.array([0, 400, 700])
    regions, text = minhash.weigh(flat, at, "log")
    s = minhash.signatures(regions, text, 2, 3000)
    assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - 240 / (300 + 50 + 60)) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100 and set(got) == {*range(41), 100, 101, 103}
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(None, 1)]
    want = components_of(links[:-1], 300)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: min(k for k in got if want[k] == want[n]) for n in got} == got and components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    plain = ["the and of is it that was for on are with as this".split(), "der die und das ist nicht von mit auch sich".split()]
    rows, labels = [], []
    for i in range(600):
        lang = i % 2
        w = [rng.choice(plain[lang]) if rng.random() < 0.5 else f"w{rng.randrange(3000)}" for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(60)] = rng.choice([["scum", "idiot"], ["loweiab", "loweicd"]][lang])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (9001, "")], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels + [(None, 1), (5, None), (77777, 1)], "doc_id long, toxic int"))
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == bool(y) for i, y in held]) > 0.97 and out[9001] < 0.5
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    big = " ".join(f"w{k}" for k in range(toxicity.CHUNK + 50))
    whole = toxicity.read_texts(pa.array([big, big + " scum", ""]))
    assert model.scores(whole).shape == (3,) and model.logits(whole)[1] > model.logits(whole)[0]
    assert toxicity.score_toxicity(docs.withColumn("score", F.lit("x")), model).columns == ["doc_id", "text", "score"]
    assert fingerprint.fingerprint_column(docs.withColumn("fingerprint", F.lit(1))).columns == ["doc_id", "text", "fingerprint"]
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    some, label = toxicity.training_rows(docs.unionByName(docs), labelled, F.lit(True), max_toxic=7, max_clean=9)
    assert len(some) == 16 and label.sum() == 7
    few, _ = toxicity.training_rows(docs, labelled, F.lit(True), max_toxic=7, max_clean=9, max_bytes=1200)
    assert 0 < sum(len(x.as_py().encode()) for x in few) <= 1200 and set(few.to_pylist()) < set(some.to_pylist())
    none = toxicity.fit(toxicity.read_texts(pa.array([], pa.string())), np.zeros(0))
    assert none.scores(toxicity.read_texts(pa.array(["x"])))[0] < 0.5
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_convolution_and_pooling_by_brute_force():
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{rng.integers(50)}" for _ in range(n)) for n in (1, 2, 3, 17, 0)]
    t = toxicity.read_texts(pa.array(texts))
    model = toxicity.fit(toxicity.read_texts(pa.array([f"w{k} w{k + 1}" for k in range(60)])), np.arange(60) % 2.0, epochs=1)
    model.bias = rng.normal(0, 0.1, len(model.bias)).astype(np.float32)
    got = model.pool(t)
    for i in range(len(texts)):
        x = [model.words[t.words[j]] + model.heads[t.heads[j]] for j in range(t.at[i], t.at[i + 1])]
        for w_i, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for start in range(len(x)):
                    y = model.bias[w_i * toxicity.FILTERS + f]
                    for j in range(w):
                        if start + j < len(x):
                            y += float(x[start + j] @ model.filters[w_i][j * toxicity.SIZE : (j + 1) * toxicity.SIZE, f])
                    best = max(best, y)
                assert got[i, w_i * toxicity.FILTERS + f] == pytest.approx(best, abs=1e-4)


def test_training_lowers_the_loss():
    """Phrases of two words that are clean alone: what the embeddings begin with can't tell them, training does."""
    rng = random.Random(12)
    texts, label = [], []
    for k in range(1200):
        w = [f"w{rng.randrange(30)}" for _ in range(12)]
        at = rng.randrange(11)
        w[at : at + 2] = [["red", "cat"], ["cat", "red"]][k % 2]
        texts.append(" ".join(w))
        label.append(float(k % 2))
    read, y = toxicity.read_texts(pa.array(texts)), np.array(label)
    loss = []
    for epochs in (0, toxicity.EPOCHS):
        z = toxicity.fit(read, y, epochs=epochs).logits(read)
        loss.append(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))
    assert loss[1] < 0.7 * loss[0]


def test_lm_score_by_brute_force(docs, texts):
    """Counts, buckets, deleted part and expectation-maximisation token by token, without hashes, blocks or rounding."""
    out = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in lm.score_documents(docs, block_bytes=1 << 14).collect()}
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    seqs = [(fold(i), i, t.encode().lower().split() + [None]) for i, t in texts]

    def counted(rows):
        return Counter(x for w in rows for x in w), Counter(p for w in rows for p in zip([None, *w[:-1]], w))

    whole, rest = counted([w for f, _, w in seqs if f != 2]), counted([w for f, _, w in seqs if f not in (2, 3)])

    def ps(model, before, x):
        ones, pairs = model
        c = ones[before]
        return c.bit_length(), np.array([pairs[before, x] / c if c else 0.0, ones[x] / sum(ones.values()), 1 / (len(ones) + 1)])

    found = [ps(rest, b, x) for f, _, w in seqs if f == 3 for b, x in zip([None, *w[:-1]], w)]

    def mixture(rows, base, strength):
        p, w = np.array(rows), base.copy()
        for _ in range(lm.ROUNDS):
            part = p * w
            new = (part / part.sum(1, keepdims=True)).sum(0) + strength * base
            w = new / new.sum()
        return w

    pooled = np.maximum(mixture([p for _, p in found], np.full(3, 1 / 3), 1.0), 1e-6)
    pooled /= pooled.sum()
    weights = {b: mixture([p for k, p in found if k == b], pooled, lm.PRIOR) for b in {b for b, _ in found}}
    total = {}
    for _, i, w in seqs:
        score = base = 0.0
        for b, x in zip([None, *w[:-1]], w):
            k, p = ps(whole, b, x)
            near = min(sorted(weights), key=lambda j: (abs(j - k), j))
            score += math.log10(float(weights[near] @ p))
            base += math.log10((whole[0][x] + 1) / (sum(whole[0].values()) + len(whole[0]) + 1))
        total[i, len(w), round(base, 6)] = score
    assert set(total) == set(out)
    assert all(out[k] == pytest.approx(v, rel=5e-3, abs=5e-3) for k, v in total.items())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, DATA).cache()
        assert left.columns == docs.columns and left.join(before, "doc_id", "left_anti").isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() == left.count() and out.where("text_sha256 <> decoded_sha256").isEmpty()


def test_registered(spark):
    import duckdb

    assert len(queries()) == 11
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = sorted(map(tuple, con.execute(oracle_sql()["op5_exact_dedup"]).fetchall()))
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in op5_exact_dedup(spark, DATA).collect())
    assert got == want


def test_lots_of_texts():
    from tickweave.llm.common import in_lots

    texts = ["ab", None, "", "x" * 50, "é" * 4, "abc", "d"]
    batches = [pa.RecordBatch.from_pydict({"n": list(range(7)), "text": texts}), pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64()), "text": pa.array([], pa.string())})]
    lots = [b.column("text").to_pylist() for b in in_lots(iter(batches), 1, 10)]
    assert lots == [["ab", None, ""], ["x" * 50], ["é" * 4], ["abc", "d"]]
