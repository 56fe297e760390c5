"""Ranked lexical search by block-max pruning: blocks of neighbouring documents hold each term's highest impact and a
forward index; a query's blocks are taken by bound, and those that can't reach its k-th score are never scored."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C


#: Bytes of a row group of the index, which bound what a task holds while it writes or reads.
ROW_GROUP = 4 << 20


@dataclass(frozen=True)
class Settings:
    block: int = 32  # documents of a block
    first: int = 8  # a query's blocks of highest bound, which set its first threshold
    part_items: int = 4096  # queries searched at once, the bound on what is broadcast
    part_bytes: int = 4_000_000


class Index:
    """Blocks of all documents in a written table, and the corpus's counts: n documents with terms, `total` terms.

    A block: keys and term counts by document; its distinct terms (64-bit hashes, ascending) with highest impact and
    number of documents; its postings, document by document, as (place among the block's terms, impact).
    """

    def __init__(self, rows: DataFrame, n: int, total: int):
        self.rows, self.n, self.total = rows, n, total

    def discard(self) -> None:
        C.discard(self.rows)


def _words(texts: list[bytes]) -> np.ndarray:
    """How many terms each text has."""
    inside = np.concatenate([[False], ~C.NOT_ALNUM[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]])
    begins = np.flatnonzero(inside[1:] & ~inside[:-1])
    return np.diff(np.searchsorted(begins, np.cumsum([0] + [len(t) + 1 for t in texts])))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings | None = None) -> Index:
    """The index of every row of docs. Two passes over the texts: lengths first, as an impact depends on their mean.

    Null, empty and wordless texts are in no count and are never found. Rows of one key, repeated ones included, are
    documents of their own. Very long texts are indexed whole, in a block of few documents. Other columns aren't read.
    """
    s, spark = s or Settings(), docs.sparkSession
    C.small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for _, texts in C.blocks(batch, "text"):
                sizes = _words(texts)
                n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    r = rows.select("text").mapInArrow(lengths, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n, total = r[0] or 0, r[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in C.blocks(batch, "text"):
                _, _, h, first = C.hash_words(texts, C.NOT_ALNUM)
                sizes = np.diff(first).astype(np.int64)
                m = 100 - 25 + (25 * sizes * n) // max(1, total)
                out: list[list] = [[] for _ in range(7)]
                cuts = list(range(0, len(texts), s.block))
                for a in cuts:
                    b = min(len(texts), a + s.block)
                    terms, code = np.unique(h[first[a] : first[b]], return_inverse=True)
                    pair, tf = np.unique(np.repeat(np.arange(b - a), sizes[a:b]) * max(1, len(terms)) + code, return_counts=True)
                    doc, term = pair // max(1, len(terms)), pair % max(1, len(terms))
                    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[a:b][doc])
                    most = np.zeros(len(terms), np.int64)
                    np.maximum.at(most, term, impact)
                    for column, v in zip(out, (at + a, np.bincount(doc, minlength=b - a), terms.view(np.int64), most, np.bincount(term, minlength=len(terms)), term, impact), strict=True):
                        column.append(v)
                at += len(texts)
                listed = lambda x, t: pa.ListArray.from_arrays(np.cumsum([0] + [len(y) for y in x]).astype(np.int32), pa.array(np.concatenate(x).astype(t)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.ListArray.from_arrays(pa.array([*cuts, len(texts)], pa.int32()), part.column(0)), listed(out[1], np.int32), listed(out[2], np.int64), *(listed(x, np.int32) for x in out[3:])],
                    names=["block", "keys", "sizes", "terms", "most", "df", "term", "impact"],
                )

    kind = docs.schema[key].dataType.simpleString()
    lists = "sizes array<int>, terms array<long>, most array<int>, df array<int>, term array<int>, impact array<int>"
    # a reader's batch ends with its row group: some thousand blocks of one would be held at once
    return Index(C.materialise(rows.mapInArrow(run, f"block long, keys array<{kind}>, {lists}"), "blocks", ROW_GROUP), n, total)


class Queries:
    """Terms of a bounded number of queries, ascending, and for each its (query, weight) entries."""

    def __init__(self, texts: list[str]):
        _, _, h, first = C.hash_words([t.encode() for t in texts], C.NOT_ALNUM)
        self.n, self.terms = len(texts), np.unique(h).view(np.int64)
        self.terms.sort()
        code = np.searchsorted(self.terms, h.view(np.int64))
        pair, self.times = np.unique(code * max(1, self.n) + np.repeat(np.arange(self.n), np.diff(first)), return_counts=True)
        self.of = pair % max(1, self.n)
        self.head = np.searchsorted(pair // max(1, self.n), np.arange(len(self.terms) + 1))

    def weigh(self, df: np.ndarray, n: int) -> None:
        w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.weight = self.times * np.repeat(w, np.diff(self.head))
        #: Sums of doubles are exact where no query's score can reach 2**53.
        self.exact = int(np.bincount(self.of, self.weight, 1).max()) * 1_000_000 < 2**53 if len(self.of) else True

    def codes(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term among the queries' terms, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.searchsorted(self.terms, terms).clip(max=len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def sums(self, row: np.ndarray, code: np.ndarray, impact: np.ndarray, rows: int, need: np.ndarray | None = None) -> np.ndarray:
        """For each row and query, the sum of weight times impact over the row's entries (row, code, impact)."""
        n = self.head[code + 1] - self.head[code]
        at = np.arange(int(n.sum())) + np.repeat(self.head[code] - (np.cumsum(n) - n), n)
        of = self.of[at]
        cell, value = np.repeat(row, n) * self.n + of, self.weight[at] * np.repeat(impact, n)
        if need is not None:
            keep = need[of]
            cell, value = cell[keep], value[keep]
        if self.exact:
            out = np.bincount(cell, value, rows * self.n).astype(np.int64)
        else:
            out = np.zeros(rows * self.n, np.int64)
            np.add.at(out, cell, value)
        return out.reshape(rows, self.n)


def _parts(items: DataFrame, item: str, text: str, s: Settings) -> Iterator[list[tuple[object, str]]]:
    part, size = [], 0
    for i, t in items.where(F.col(text).isNotNull()).select(item, text).orderBy(item, text).toLocalIterator():
        if part and (len(part) >= s.part_items or size + len(t) > s.part_bytes):
            yield part
            part, size = [], 0
        part.append((i, t))
        size += len(t)
    if part:
        yield part


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(batch.schema.get_field_index(name))
    return x.offsets.to_numpy() - x.offsets[0].as_py(), x.flatten().to_numpy(zero_copy_only=False)


def search(index: Index, items: DataFrame, k: int = 20, item: str = "item_id", text: str = "text", s: Settings | None = None) -> DataFrame:
    """(item, rank, key, score): the k documents of highest score above 0 for each query, ties by ascending key, null keys last.

    Queries are searched some thousands at a time. Bounds of all blocks are read off the terms' maxima; the documents of
    each query's few best blocks give a threshold; then every block whose bound reaches the threshold, or the k-th score
    that its task has found since, is scored. Nothing is shuffled but each task's k best. Null and wordless queries find
    nothing; repeated queries are each answered; an empty index or no queries give no rows.
    """
    s, spark = s or Settings(), items.sparkSession
    C.small_batches(spark, 64)
    kind, item_kind = index.rows.schema["keys"].dataType.elementType.simpleString(), items.schema[item].dataType.simpleString()
    out = spark.createDataFrame([], f"item {item_kind}, rank int, key {kind}, score long")
    for part in _parts(items, item, text, s):
        q = Queries([t for _, t in part])
        q.weigh(_document_frequencies(index, q), index.n)
        floor = np.ones(q.n, np.int64)
        best = _best_blocks(index, q, s.first)
        seeds = {r["block"] for r in best}
        if seeds:
            rows = _scored(index.rows.where(F.col("block").isin(sorted(seeds))), q, floor, k, kind)
            for r in _ranked(rows, k).where(F.col("rank") == k).collect():
                floor[r["q"]] = max(1, r["score"])
        found = _ranked(_scored(index.rows, q, floor, k, kind), k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(part)], f"q int, item {item_kind}")
        out = out.union(found.join(F.broadcast(names), "q").select("item", "rank", "key", "score"))
    return out


def _document_frequencies(index: Index, q: Queries) -> np.ndarray:
    shared = index.rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        df = np.zeros(len(q.terms), np.int64)
        for batch in batches:
            code, own = q.codes(_lists(batch, "terms")[1]), _lists(batch, "df")[1]
            df += np.bincount(code[code >= 0], own[code >= 0], len(df)).astype(np.int64)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], names=["code", "df"])

    out = np.zeros(len(q.terms), np.int64)
    if len(out):
        for r in index.rows.select("terms", "df").mapInArrow(run, "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():
            out[r["code"]] = r["df"]
    return out


def _best_blocks(index: Index, q: Queries, first: int) -> list:
    """(q, block): each query's `first` blocks of highest bound. A task hands on its own best ones."""
    shared = index.rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        ids, tops = np.zeros((0, q.n), np.int64), np.zeros((0, q.n), np.int64)
        for batch in batches:
            off, terms = _lists(batch, "terms")
            most, code = _lists(batch, "most")[1], q.codes(terms)
            hit = code >= 0
            row = np.repeat(np.arange(len(batch)), np.diff(off))
            bound = q.sums(row[hit], code[hit], most[hit].astype(np.int64), len(batch))
            blocks = batch.column(0).to_numpy()
            ids = np.concatenate([ids, np.broadcast_to(blocks[:, None], bound.shape)])
            tops = np.concatenate([tops, bound])
            order = np.argsort(-tops, 0, kind="stable")[:first]
            ids, tops = np.take_along_axis(ids, order, 0), np.take_along_axis(tops, order, 0)
        r, c = np.nonzero(tops)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(ids[r, c]), pa.array(tops[r, c])], names=["q", "block", "bound"])

    rows = index.rows.select("block", "terms", "most").mapInArrow(run, "q int, block long, bound long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= first).select("q", "block").collect()


def _scored(blocks: DataFrame, q: Queries, floor: np.ndarray, k: int, kind: str) -> DataFrame:
    """(q, key, score): of each task, every query's k best documents that score `floor` or more."""
    shared = blocks.sparkSession.sparkContext.broadcast((q, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = shared.value
        least, best = floor.copy(), [[] for _ in range(q.n)]
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("keys"))
            (t_off, terms), (d_off, sizes), (p_off, term) = (_lists(batch, x) for x in ("terms", "sizes", "term"))
            most, impact, code = _lists(batch, "most")[1].astype(np.int64), _lists(batch, "impact")[1].astype(np.int64), q.codes(terms)
            hit = code >= 0
            row = np.repeat(np.arange(len(batch)), np.diff(t_off))
            bounds = q.sums(row[hit], code[hit], most[hit], len(batch))
            for i in np.argsort(-(bounds / least).max(1), kind="stable").tolist():
                need = bounds[i] >= least
                if not need.any():
                    continue
                own = code[t_off[i] : t_off[i + 1]][term[p_off[i] : p_off[i + 1]]]
                docs = sizes[d_off[i] : d_off[i + 1]]
                doc, some = np.repeat(np.arange(len(docs)), docs), own >= 0
                score = q.sums(doc[some], own[some], impact[p_off[i] : p_off[i + 1]][some], len(docs), need)
                d, which = np.nonzero(score >= least)
                names = keys[i].values.take(pa.array(d)).to_pylist()
                for name, j, v in zip(names, which.tolist(), score[d, which].tolist(), strict=True):
                    if v >= least[j]:
                        bisect.insort(best[j], (-v, name is None, name))
                        if len(best[j]) > k:
                            best[j].pop()
                        if len(best[j]) == k:
                            least[j] = max(least[j], -best[j][-1][0])
        rows = [(j, x[2], -x[0]) for j, b in enumerate(best) for x in b]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], keys_type), pa.array(cols[2], pa.int64())], names=["q", "key", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    keys_type = to_arrow_type(blocks.schema["keys"].dataType.elementType)
    return blocks.drop("block", "df").mapInArrow(run, f"q int, key {kind}, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("key").asc_nulls_last()))
    return rows.withColumn("rank", nth).where(F.col("rank") <= k)
