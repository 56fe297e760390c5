"""Encoding, lexical search and importance resampling against plain versions, and on odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import byte_bpe, importance, licenses, search, secrets

from .conftest import DOCS, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(byte_bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


# ---------------------------------------------------------------- byte-level BPE


def test_perfect_hash_is_a_bijection(bpe):
    h = np.unique(np.random.default_rng(1).integers(1, 2**63, 5000, dtype=np.uint64))
    assert sorted(byte_bpe.PerfectHash(h)(h).tolist()) == list(range(len(h)))
    assert len(byte_bpe.PerfectHash(h[:0])(h)) == len(h) and len(bpe.token) == len(bpe.ranks)
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash(np.array([7, 7], np.uint64))
    assert all(bpe.ranks[t] == i for t, i in zip(bpe.token.to_pylist(), bpe.id.tolist(), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_any_text_is_encoded_as_by_the_library(bpe, plain, texts):
    assert bpe(texts).to_pylist() == [plain.encode_ordinary(t) for t in texts]


def test_every_character_has_the_class_of_the_library(bpe, plain):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"{c}a{c}1{c} {c}" for c in every[i : i + 40_000]) for i in range(0, len(every), 40_000)]
    assert all(a == plain.encode_ordinary(t) for a, t in zip(bpe(texts).to_pylist(), texts, strict=True))


def test_long_runs_and_windows(bpe, plain, monkeypatch):
    texts = ["ab" * 40_000, "x" * 5000 + "  y\n\n z " * 3000, " \t " * 9000 + "end", "a b " * 9000 + "!" * 9000, ""]
    want = [plain.encode_ordinary(t) for t in texts]
    assert bpe(texts).to_pylist() == want
    monkeypatch.setattr(byte_bpe, "WINDOW", 50)
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 3)
    bpe.cache.clear()
    assert bpe(texts).to_pylist() == want and len(bpe.cache) <= 3
    assert "".join(bpe.split.windows(texts[1])) == texts[1] and len(list(bpe.split.windows(texts[1]))) > 100


def test_decoding(spark):
    rows = spark.createDataFrame([(1, [15496, 995]), (2, []), (3, None)], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] if r["decoded"] is None else bytes(r["decoded"]) for r in byte_bpe.decode(rows, RANKS).collect()} == {1: b"Hello world", 2: b"", 3: None}
    for bad in ([60_000], [-1], [None]):
        with pytest.raises(Exception, match="vocabulary|null among ids"):
            byte_bpe.decode(spark.createDataFrame([(1, bad)], rows.schema), RANKS).collect()
    with pytest.raises(ValueError):
        byte_bpe.decode(rows.withColumn("decoded", F.lit(1)), RANKS)


def test_encoding_of_odd_rows(spark, make_docs, odd_texts, plain):
    got = byte_bpe.encode(make_docs(odd_texts), RANKS, public_tokenizers.PATTERN, decoded=True).collect()
    want = Counter((i, tuple(plain.encode_ordinary(t or "")), (t or "").encode()) for i, t in odd_texts)
    assert Counter((r["key"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert byte_bpe.encode(spark.createDataFrame([], DOCS), RANKS, public_tokenizers.PATTERN).count() == 0
    by_name = byte_bpe.encode(make_docs(odd_texts), RANKS, public_tokenizers.PATTERN, key="key", text="row").collect()
    assert {(r["key"], tuple(r["ids"])) for r in by_name} == {("k", tuple(plain.encode_ordinary("r")))}


# ---------------------------------------------------------------- search


def ranking(docs, items, k):
    """The stated formula over all pairs of queries and documents."""
    terms = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (t or "")).translate({c: c + 32 for c in range(65, 91)}).split(" ")
    own = [(key, Counter(x for x in terms(t) if x)) for key, t in docs]
    own = [(key, c) for key, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked = Counter(x for x in terms(text) if x)
        found = []
        for key, c in own:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                found.append((-s, key is None, key if key is not None else 0, key))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize("s", [search.Settings(), search.Settings(block=1, first=1), search.Settings(block=3, first=2, part_items=2), search.Settings(block=7, part_bytes=40)])
def test_search_is_that_of_all_pairs(spark, make_docs, odd_texts, s):
    rng = random.Random(9)
    pool = words(rng, 60)
    docs = odd_texts + [(100 + i, " ".join(rng.choices(pool, k=rng.randint(1, 30)))) for i in range(150)] + [(300 + i, "copied text of " + pool[0]) for i in range(40)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(8)] + [(8, None), (9, ""), (10, "Copied copied TEXT"), (10, "word"), (None, "same text"), (11, "nowhere found")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    index = search.build(make_docs(docs).repartition(3), s=s)
    got = Counter((r["item"], r["rank"], r["key"], r["score"]) for r in search.search(index, queries, k=5, s=s).collect())
    assert got == ranking(docs, items, 5) and sum(got.values()) > 45


def test_search_of_nothing(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    empty = search.build(spark.createDataFrame([], DOCS))
    assert search.search(empty, spark.createDataFrame([(1, "a b")], none.schema)).count() == 0
    index = search.build(make_docs([(1, "a b"), (2, "b c")]))
    assert search.search(index, none).count() == 0 and (index.n, index.total) == (2, 4)
    index.discard()


def test_scores_beyond_doubles_are_summed_as_integers(spark, make_docs):
    docs = [(1, "rare word"), (2, "rare " * 9)]
    items = [(1, "rare " * 400_000 + "word " * 3)]
    q = search.Queries([items[0][1]])
    q.weigh(np.array([0, 0]), 10**12)
    assert not q.exact
    index = search.build(make_docs(docs))
    got = Counter((r["item"], r["rank"], r["key"], r["score"]) for r in search.search(index, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == ranking(docs, items, 20)


# ---------------------------------------------------------------- importance resampling


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 2), (2, 5), (3, 3)])
def test_runs_of_suffixes_give_all_features(low, high):
    rng = random.Random(high)
    texts = [" ".join(rng.choices(["a", "B", "cc", "d1", "é"], k=rng.randint(0, 40))).encode() for _ in range(30)] + [b"", b"...", b"a" * 9000, b"x y " * 500]
    s = importance.Settings(shortest=low, longest=high, buckets=997)
    flat, sizes, counts = importance.bucket_ids(texts, s)
    want, at = [], 0
    for t, n, k in zip(texts, sizes.tolist(), counts.tolist(), strict=True):
        ws = [w.encode() for w in t.decode().lower().replace(".", " ").split()]
        want = Counter(zlib.crc32(b" ".join(ws[i : i + m])) % 997 for m in range(low, high + 1) for i in range(len(ws) - m + 1))
        assert Counter(flat[at : at + n].tolist()) == want and k == len(ws)
        at += n
    assert at == len(flat)


def test_suffixes_are_in_order():
    rng = np.random.default_rng(3)
    ids, counts = rng.integers(0, 4, 200), np.array([50, 0, 149, 1])
    ends = np.repeat(np.cumsum(counts), counts)
    order, shared = importance.suffixes(ids, counts, 6)
    suffix = [tuple(ids[p : min(ends[p], p + 6)].tolist()) for p in order.tolist()]
    assert suffix == sorted(suffix) and sorted(order.tolist()) == list(range(200))
    for k in range(1, 200):
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(suffix[k - 1], suffix[k], strict=False)) if x != y), min(len(suffix[k - 1]), len(suffix[k])))


def test_draw_of_ties(spark, tmp_path):
    """A third of all rows are one row over and over; ranks are gapless, by score and then by key, nulls last."""
    rows = [(i % 50 if i % 3 else 7, 100 if i % 3 == 0 else i % 11, i % 5 > 0) for i in range(600)] + [(None, 100, True)] * 3
    spark.createDataFrame(rows, "key long, score long, able boolean").repartition(4).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    order = sorted(((-s, k is None, k or 0) for k, s, able in rows if able))
    for n in (0, 1, 100, 170, 10_000):
        out = importance.draw(t, n).collect()
        ranked = sorted((r["rank"], -r["score"], r["key"] is None, r["key"] or 0) for r in out if r["rank"])
        assert len(out) == len(rows) and [r[1:] for r in ranked] == order[:n] and [r[0] for r in ranked] == list(range(1, len(ranked) + 1))


def test_resampling_odd_rows(spark, make_docs, odd_texts):
    target = spark.createDataFrame([("same text",), (None,), ("",)], "text string")
    out = importance.resample(make_docs(odd_texts), target, importance.Settings(percent=100)).collect()
    assert Counter(r["key"] for r in out) == Counter(i for i, _ in odd_texts)
    assert all((r["n_features"], r["weight"]) == (0, 0) for r in out if r["key"] in (0, 1, 2, 4)) and [r["rank"] for r in out if r["rank"]] == [1]
    assert importance.resample(spark.createDataFrame([], DOCS), target).count() == 0
    more = importance.resample(make_docs([(1, "same text"), (2, "other words")]), target.limit(0), importance.Settings(least_words=1, percent=50))
    assert sorted(r["rank"] or 0 for r in more.collect()) == [0, 1]


# ---------------------------------------------------------------- license labels and many secrets


def test_a_place_has_the_label_of_one_license(make_docs):
    texts = {
        "Released under the terms of the GNU General Public License.": "",
        "Released under the terms of the Apache License": "",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "You may use it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    } | {x.phrase: x.label for x in licenses.TEMPLATES}
    out = licenses.scan(make_docs(list(enumerate(texts)))).collect()
    assert {r["key"]: r["labels"] for r in out} == dict(enumerate(texts.values()))
    two = licenses.TEMPLATES[3].phrase + " and so on then " + licenses.TEMPLATES[6].phrase
    assert licenses.scan(make_docs([(1, two)])).first()["labels"] == ",".join(sorted({licenses.TEMPLATES[3].label, licenses.TEMPLATES[6].label}))


def test_secrets_of_a_text_with_very_many(make_docs):
    text = " ".join(f"é token={i:08d}ab" + (" AKIA" + "Q" * 20 if i % 7 == 0 else "") for i in range(30_000))
    spans = secrets.scan(make_docs([(1, text)])).first()["spans"]
    assert len(spans) == 30_000 + 4286 and all(text[s["start"] : s["end"]].startswith("AKIA" if s["kind"] == "access" else "token=") for s in spans)
    assert [s["start"] for s in spans] == sorted(s["start"] for s in spans)
