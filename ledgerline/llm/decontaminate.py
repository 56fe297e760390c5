"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND with every passage."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.6  # of the BM25 score that an item has against itself
    overlap: float = 0.8  # share of the question's and of the answer's shingles that a passage must have
    shingle: int = 5
    block: int = 4  # items of a block, for each of which a term has its maximum
    shard_items: int = 20_000  # items of one index, the bound on what is broadcast
    shard_bytes: int = 16_000_000


_MARK = re.compile(r"(?:^|\s)(?:answer|a)\s*:\s*(?=\S)", re.IGNORECASE)
_SENTENCE = re.compile(r"[.?!\n]+\s*(?=\S)")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: what follows the last "Answer:", else the last sentence, else the last quarter of the words."""
    for marks in (list(_MARK.finditer(text)), list(_SENTENCE.finditer(text))):
        if marks and text[: marks[-1].start()].strip():
            return text[: marks[-1].start()], text[marks[-1].end() :]
    words = text.split()
    k = max(1, len(words) // 4)
    return " ".join(words[:-k]), " ".join(words[-k:])


class Corpus:
    """Statistics of all items: their number and mean length, and in how many of them a term is. The latter stay a table,
    of which each index asks for its own terms."""

    def __init__(self, items: DataFrame, text: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in C.blocks(batch, "text"):
                    parts = [split_item(t.decode()) for t in texts]
                    _, _, h, first = C.hash_words([f"{q} {a}".encode() for q, a in parts], C.NOT_ALNUM)
                    own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.diff(first), pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["size", "terms"])

        rows = C.materialise(items.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(run, "size long, terms array<long>").where("size > 0"), "items")
        r = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
        self.n, self.mean = r["n"], r["mean"] or 1.0
        self.table = C.materialise(rows.select(F.explode("terms").alias("h")).groupBy("h").agg(F.count("*").alias("df")), "items-with-term")

    def df(self, terms: np.ndarray) -> np.ndarray:
        spark = self.table.sparkSession
        asked = spark.createDataFrame(pa.table({"h": terms.view(np.int64)}))
        got = dict(self.table.join(asked, "h").toPandas().itertuples(index=False, name=None))
        return np.array([got[h] for h in terms.view(np.int64).tolist()], np.int64)


class Index:
    """Postings by term, in order of items: impacts are BM25 contributions divided by the item's score against itself."""

    def __init__(self, items: list[tuple[object, str]], s: Settings, corpus: Corpus | None = None):
        self.s, self.ids = s, [i for i, _ in items]
        parts = [split_item(t) for _, t in items]
        _, _, h, first = C.hash_words([f"{q} {a}".encode() for q, a in parts], C.NOT_ALNUM)
        n_question = [len(C.hash_words([q.encode()], C.NOT_ALNUM)[2]) for q, _ in parts]
        sizes = np.diff(first)
        self.longest = int(sizes.max(initial=1))
        item = np.repeat(np.arange(len(items)), sizes)
        self.terms, code = np.unique(h, return_inverse=True)
        pair, tf = np.unique(code.astype(np.int64) * len(items) + item, return_counts=True) if len(h) else (np.zeros(0, np.int64), np.zeros(0))
        term, at = (pair // max(1, len(items)), pair % max(1, len(items)))
        df = corpus.df(self.terms) if corpus else np.bincount(term, minlength=len(self.terms))
        n, mean = (corpus.n, corpus.mean) if corpus else (len(items), sizes.mean() if len(sizes) else 1)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1e-9, mean))
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[at])
        own = np.bincount(at, impact, minlength=len(items))
        impact = impact / own[at]
        heads = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(impact, heads[:-1]) if len(impact) else np.zeros(0)
        self.lists, self.tops = [], []
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            of, place = np.unique(at[a:b] // s.block, return_index=True)
            self.tops.append((of, np.maximum.reduceat(impact[a:b], place)))
            self.lists.append((at[a:b].tolist(), impact[a:b].tolist()))
        self.blocks = -(-len(items) // s.block)
        self.shingles = []
        for a, b, q in zip(first[:-1].tolist(), first[1:].tolist(), n_question, strict=True):
            g = lambda x: (k := min(s.shingle, len(x)), np.unique(C.grams(x, k)) if k else np.zeros(0, np.uint64))
            self.shingles.append((g(h[a : a + q]), g(h[a + q : b])))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score for these distinct terms reaches the threshold, by block-max WAND.

        The terms' maxima are added up block by block. Lists are walked in step: the pivot is the first item that the
        lists before it could lift over the threshold; where its block can't reach that, all lists go on to the next
        block that can.
        """
        theta, block = self.s.threshold - 1e-9, self.s.block
        tops = [self.tops[t] for t in terms]
        bounds = np.bincount(np.concatenate([x for x, _ in tops]), np.concatenate([y for _, y in tops]), self.blocks)
        able = np.flatnonzero(bounds >= theta)
        if not len(able):
            return []
        found = []
        live = [[self.lists[t][0][0], 0, t] for t in terms]  # item, place, term
        while live:
            live.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(live):
                bound += self.most[t]
                if bound >= theta:
                    pivot = k
                    break
            if pivot < 0:
                break
            p = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == p:
                pivot += 1
            if bounds[p // block] < theta:
                nxt = able[np.searchsorted(able, p // block) :]
                if not len(nxt):
                    break
                to, moved = int(nxt[0]) * block, len(live)
            elif live[0][0] == p:
                score = sum(self.lists[t][1][i] for _, i, t in live[: pivot + 1])
                if score >= theta:
                    found.append((p, score))
                to, moved = p + 1, pivot + 1
            else:
                to, moved = p, pivot + 1
            rest = []
            for k, (item, i, t) in enumerate(live):
                if k < moved and item < to:
                    items = self.lists[t][0]
                    i = bisect.bisect_left(items, to, i)
                    if i == len(items):
                        continue
                    item = items[i]
                rest.append([item, i, t])
            live = rest
        return found

    def match(self, texts: list[bytes]) -> list[dict[int, tuple[float, float, float, int, int]]]:
        """Verified items of each text: (score, question overlap, answer overlap, first and last word of the passage).

        Passages: windows of twice the longest item, every one of its length, so a copied item lies whole in one. A
        passage whose terms' maxima can't reach the threshold isn't searched; that drops nothing.
        """
        _, _, h, first = C.hash_words(texts, C.NOT_ALNUM)
        out: list[dict] = [{} for _ in texts]
        if not len(h) or not len(self.terms):
            return out
        code = np.searchsorted(self.terms, h).clip(max=len(self.terms) - 1)
        known = self.terms[code] == h
        value = np.where(known, self.most[code], 0.0)
        step, sizes = self.longest, np.diff(first)
        n = np.maximum(1, -(-sizes // step) - 1)
        doc = np.repeat(np.arange(len(texts)), n)
        begin = first[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(begin + 2 * step, first[doc + 1])
        order = np.flatnonzero(known)  # where a known word stood before, so that a passage counts it once
        order = order[np.argsort(code[order], kind="stable")]
        same = code[order[1:]] == code[order[:-1]]
        before = np.full(len(h), -1)
        before[order[1:][same]] = order[:-1][same]
        bound = np.empty(len(doc))
        for k in range(0, len(doc), 2048):
            at = begin[k : k + 2048, None] + np.arange(2 * step)[None, :]
            inside = at < end[k : k + 2048, None]
            at = np.where(inside, at, 0)
            bound[k : k + 2048] = (value[at] * (inside & (before[at] < begin[k : k + 2048, None]))).sum(1)
        for w in np.flatnonzero(bound >= self.s.threshold - 1e-6).tolist():
            a, b, d = int(begin[w]), int(end[w]), int(doc[w])
            terms = np.unique(code[a:b][known[a:b]])
            for item, score in self.search(terms.tolist()):
                lo, hi = max(int(first[d]), a - step), min(int(first[d + 1]), b + step)
                shares = [float(np.isin(g, C.grams(h[lo:hi], k)).mean()) if k else 1.0 for k, g in self.shingles[item]]
                if min(shares) >= self.s.overlap and (item not in out[d] or out[d][item][0] < score):
                    out[d][item] = (score, *shares, a - int(first[d]), b - int(first[d]))
        return out


def indexes(items: DataFrame, item: str = "item_id", text: str = "text", s: Settings | None = None) -> Iterator[Index]:
    """Indexes of bounded parts of the items, one after another, with the statistics of all: an item's scores don't depend
    on its part. Null and wordless items are left out."""
    s = s or Settings()
    corpus = Corpus(items, text)
    part, size = [], 0
    for r in items.where(F.col(text).isNotNull()).select(item, text).orderBy(item, text).toLocalIterator():
        if not len(C.hash_words([r[1].encode()], C.NOT_ALNUM)[2]):
            continue
        if part and (len(part) >= s.shard_items or size + len(r[1]) > s.shard_bytes):
            yield Index(part, s, corpus)
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    if part:
        yield Index(part, s, corpus)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", s: Settings | None = None) -> DataFrame:
    """(key, item, score, question_overlap, answer_overlap, first_word, last_word): every item that a text holds.

    Every passage of every text is a query. One index at a time is broadcast, of bounded size; more items mean more
    passes over the texts, not a larger broadcast. Null and empty texts, and empty tables, give no rows.
    Null keys are reported as such; very long texts are searched whole, passage by passage; ties in score all count. Repeated rows
    of docs give their rows again; equal items each have their own.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType
    schema = f"key {kind}, item {item_kind.simpleString()}, score double, question_overlap double, answer_overlap double, first_word long, last_word long"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)
    for index in indexes(items, item, item_text, s):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids = pa.array(shared.value.ids)
            for batch in batches:
                for part, texts in C.blocks(batch, "text"):
                    hits = [(i, x, *v) for i, found in enumerate(shared.value.match(texts)) for x, v in sorted(found.items())]
                    cols = list(zip(*hits, strict=True)) or [()] * 7
                    take = lambda a, i: a.take(pa.array(i, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [take(part.column(0), cols[0]), take(ids, cols[1]), *(pa.array(c, pa.float64()) for c in cols[2:5]), *(pa.array(c, pa.int64()) for c in cols[5:7])],
                        names=["key", "item", "score", "question_overlap", "answer_overlap", "first_word", "last_word"],
                    )

        out = out.union(rows.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", s: Settings | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text holds none of the items. No shuffle: each row is judged where it is read."""
    spark = docs.sparkSession
    C.small_batches(spark)
    out = docs
    for index in indexes(items, item, item_text, s):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in C.blocks(batch, text):
                    yield part.filter(pa.array([not x for x in shared.value.match(texts)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
