"""Packing token sequences by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .bpe import WordMerger

END_ID = 1
LENGTH = 2048

#: What a worker's cache holds at most; it is emptied beyond that.
CACHE_WORDS = 500_000

# Pre-tokens of word_bpe in texts of Latin letters, as that file's own pattern splits them (fixed values).
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# Characters for which re's classes or str.lower might differ from the tokenizer's: such texts go to it whole.
_ODD = re.compile("[^\\x00-\\x1b\\x20-\\x7e\\xa0\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\xffŒœ‐-‧€]|<\\|")


class WordTokenizer:
    """ids of word_bpe_49k as little-endian uint32 bytes.

    That tokenizer never joins what white space parts, and a pre-token's ids don't depend on its neighbours. So texts
    are split at white space, and what stands between is cached; new pre-tokens are merged all at once. Texts with
    characters for which Python's classes might differ from the tokenizer's go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.merge, self.cache = Tokenizer.from_file(path), WordMerger(path), {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        parts = [_PLAIN.findall(x) for x in new]
        words = list({w for ws in parts for w in ws})
        ids = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        for w, b in ids.items():
            if b is None:
                ids[w] = self._whole(w)
        for x, ws in zip(new, parts, strict=True):
            self.cache[x] = ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for t in texts:
            if not t.isascii() and not unicodedata.is_normalized("NFC", t):
                t = unicodedata.normalize("NFC", t)
            split.append(None if _ODD.search(t) else t.lower().split())
        seen = set().union(*(x for x in split if x))
        new = [x for x in seen if x not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(seen)
        self._learn(new)
        return [self._whole(t) if x is None else b"".join(map(self.cache.__getitem__, x)) for t, x in zip(texts, split, strict=True)]


def cut(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of at most `length` ids: (key, start, length, ids, doc_tokens); ids: little-endian uint32 bytes.

    Every text's ids are followed by id 1, so an empty or null text is one piece of one id. A long text is cut every
    `length` ids; its rest is the last piece.
    """
    C.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = WordTokenizer(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            keys, out = batch.column(0), [[], [], [], [], []]
            for i, b in enumerate(tok([x or "" for x in batch.column(1).to_pylist()])):
                b += end
                n = len(b) // 4
                for s in range(0, n, length):
                    p = b[4 * s : 4 * (s + length)]
                    for column, v in zip(out, (i, s, len(p) // 4, p, n), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64())],
                names=["key", "start", "length", "ids", "doc_tokens"],
            )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, start long, length long, ids binary, doc_tokens long")


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order, count) from counts by length.

    Lengths are placed longest first, each into the packs with the most room (the shortest packs); only where even
    these have none, new packs are opened. Packs of one pattern are handled together, so the work depends on the
    number of different lengths and not on the number of pieces.
    """
    heap: list[tuple[int, tuple[int, ...], int]] = []
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            if heap and heap[0][0] + size <= length:
                used, parts, count = heapq.heappop(heap)
                take = min(n, count)
                if take < count:
                    heapq.heappush(heap, (used, parts, count - take))
                heapq.heappush(heap, (used + size, (*parts, size), take))
                n -= take
            else:
                fit = min(length // size, n)
                take = n // fit
                heapq.heappush(heap, (size * fit, (size,) * fit, take))
                n -= take * fit
    return [(parts, count) for _, parts, count in heap]


def pack(pieces: DataFrame, length: int = LENGTH, key: tuple[str, ...] = ("key", "start")) -> DataFrame:
    """Give every piece a sequence and an offset: pieces plus (sequence_id, offset); `length` is the pieces' size column.

    The histogram of lengths (at most `length` rows) is packed on the driver. Pieces of one length are told apart by
    rank. A length may hold a third of all pieces, so rows are numbered within (length, one of many hash parts), and
    the parts' counts are added up to ranks. The pieces are read three times: hand in a materialised table.
    """
    spark = pieces.sparkSession
    parts = max(32, C.width(spark))
    rows = pieces.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    counts = rows.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}

    runs: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    rank, sequence = dict.fromkeys(histogram, 0), 0
    for lengths, count in patterns(histogram, length):
        offset = 0
        for size in lengths:
            runs.append((size, rank[size], sequence, offset))
            rank[size] += count
            offset += size
        sequence += count
    runs.sort()
    of, first, seq, off = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else ([], [], [], [])))
    heads = {int(s): (int(a), int(b)) for s, a, b in zip(np.unique(of), np.searchsorted(of, np.unique(of)), np.searchsorted(of, np.unique(of), "right"), strict=True)}
    shared = spark.sparkContext.broadcast((heads, first, seq, off))

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, nth: pd.Series) -> pd.DataFrame:
        heads, first, seq, off = shared.value
        sizes, ranks = size.to_numpy(), nth.to_numpy()
        s, o = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for v in np.unique(sizes):
            a, b = heads[int(v)]
            m = sizes == v
            i = a + np.searchsorted(first[a:b], ranks[m], "right") - 1
            s[m], o[m] = seq[i] + ranks[m] - first[i], off[i]
        return pd.DataFrame({"sequence_id": s, "offset": o})

    before = counts.selectExpr("length", "_part", "coalesce(sum(_n) over (partition by length order by _part rows between unbounded preceding and 1 preceding), 0) as _before")
    numbered = rows.selectExpr("*", f"row_number() over (partition by length, _part order by {', '.join(key)}) - 1 as _nth")
    ranked = numbered.join(before, ["length", "_part"]).withColumn("_at", place("length", F.col("_before") + F.col("_nth")))
    return ranked.select(*pieces.columns, "_at.sequence_id", "_at.offset")
