"""Importance resampling towards a target distribution over hashed n-grams, read off word-id suffix arrays."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


@dataclass(frozen=True)
class Settings:
    shortest: int = 1  # words of a feature
    longest: int = 2
    buckets: int = 10_000
    least_words: int = 20  # a document with fewer is never drawn
    percent: int = 10  # of the documents with enough words
    seed: str = "2024"


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """All texts' words as ids, each id's word, and how many words each text has. A-Z are lower-cased; words end at all of
    ASCII but letters and digits."""
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = ~C.NOT_ALNUM[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    counts = np.diff(np.searchsorted(begin, np.cumsum([0] + [len(t) + 1 for t in texts])))
    offsets = np.append(0, np.cumsum(end - begin))
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(buf[inside].tobytes())])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), counts


def suffixes(ids: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a block of texts, and how many words each suffix shares with the one before it.

    Suffixes end with their text and are ordered by their first `depth` words, beyond which no feature looks; the shared
    length counts up to `depth`. Ranks by the first 1, 2, 4... words are doubled until they cover the depth.
    """
    n = len(ids)
    last = np.repeat(np.cumsum(counts), counts)  # where each position's text ends
    rank, span, at = ids + 1, 1, np.arange(n)
    while span < depth:
        step = min(span, depth - span)
        after = np.where(at + step < last, np.append(rank, 0)[np.minimum(at + step, n)], 0)
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1
        span += step
    order = np.argsort(rank, kind="stable")
    shared, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    a, b = order[:-1], order[1:]
    for k in range(depth):
        x, y = a + k, b + k
        same &= (x < last[a]) & (y < last[b])
        same[same] = ids[x[same]] == ids[y[same]]
        shared[1:] += same
    return order, shared


def bucket_ids(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature of every text, text by text; how many features each text has; and how many words.

    A run of suffixes that share n words is one n-gram: its bytes are hashed once and its bucket is handed to all places
    of the run.
    """
    ids, words, counts = word_ids(texts)
    order, shared = suffixes(ids, counts, s.longest)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(ids))  # words from each place to its text's end
    lengths = range(s.shortest, s.longest + 1)
    out = np.full((len(ids), len(lengths)), -1, np.int32)
    for j, n in enumerate(lengths):
        able = left[order] >= n
        place, new = order[able], (shared < n)[able]  # what shares n words with the one before goes on its run
        run = np.cumsum(new) - 1
        heads = place[new]
        if n == 1:
            texts_of = (words[i] for i in ids[heads].tolist())
        else:
            texts_of = (b" ".join([words[i] for i in ids[p : p + n].tolist()]) for p in heads.tolist())
        bucket = np.fromiter((zlib.crc32(x) % s.buckets for x in texts_of), np.int32, len(heads))
        out[place, j] = bucket[run]
    sizes = sum((np.maximum(0, counts - n + 1) for n in lengths), np.zeros(len(texts), np.int64))
    return out[out >= 0], sizes, counts


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings | None = None) -> DataFrame:
    """(key, n_words, buckets): a suffix array for each bounded part of a partition; no shuffle."""
    s = s or Settings()
    C.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in C.blocks(batch, "text"):
                flat, sizes, words = bucket_ids(texts, s)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), lists], names=["key", "n_words", "buckets"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_words long, buckets array<int>")


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features are in each bucket: a task hands on at most one count for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for b, n in rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares in target and source, in thousandths, floored."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean of the gains of a document's features; 0 without any."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            total = np.append(0, np.cumsum(shared.value[lists.flatten().to_numpy()]))
            n = np.diff(ends)
            weight = (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["key", "n_words", "n_features", "weight"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def draw(rows: DataFrame, n: int, key: str = "key", score: str = "score", able: str = "able") -> DataFrame:
    """rows, a written table, with `rank` from 1 for the n rows of highest score among the able ones, ties by ascending key.

    The lowest score drawn is found in the counts by score, which are integers of bounded range. Rows from there up are
    dealt by ranges of (score, key, row), so that no value, however common, is one task's, and numbered within a
    range from the counts of the ranges before; no window spans ranges.
    """
    if n <= 0:
        return rows.drop(able).withColumn("rank", F.lit(None).cast("long"))
    seen, lowest = 0, None
    for v, c in rows.where(able).groupBy(score).count().orderBy(F.desc(score)).toLocalIterator():
        seen, lowest = seen + c, v
        if seen >= n:
            break
    high = F.col(able) & (F.col(score) >= lowest)
    order = [F.desc(score), F.asc_nulls_last(key), F.asc("_row")]
    dealt = rows.where(high).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(C.width(rows.sparkSession), *order)
    dealt = C.materialise(dealt.withColumn("_part", F.spark_partition_id()), "drawn")
    before, so_far = {}, 0
    for p, c in sorted(dealt.groupBy("_part").count().collect()):
        before[p], so_far = so_far, so_far + c
    heads = rows.sparkSession.createDataFrame(list(before.items()), "_part int, _before long")
    within = F.expr(f"row_number() over (partition by _part order by `{score}` desc, `{key}` asc nulls last, _row)")
    ranked = dealt.withColumn("_nth", within).join(F.broadcast(heads), "_part").withColumn("rank", F.col("_before") + F.col("_nth"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    rest = rows.where(~high).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(rest.columns).union(rest).drop(able)


def resample(docs: DataFrame, target: DataFrame, s: Settings | None = None, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(key, n_features, weight, score, rank) for every row of docs; rank is null where the row isn't drawn.

    score: the weight plus Gumbel noise that the key alone decides, so the highest scores are a sample without
    replacement with odds by weight, and another run draws the same. Null and empty texts have no features and weight 0; a
    null key takes the noise of an empty one and stands after others of its score. Rows of one key are rows of their own and
    may all be drawn; among equal ones the order is that of the table. Very long texts are a part of their own. Empty tables: no
    rows, or a flat target. Other columns aren't read.
    """
    s = s or Settings()
    rows = C.materialise(features(docs, key, text, s), "buckets")
    gain = gains(histogram(rows, s.buckets), histogram(features(target.select(F.lit(0).alias("key"), F.col(target_text).alias("text")), "key", "text", s), s.buckets))
    name = F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights(rows, gain).withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= s.least_words)
    scored = C.materialise(scored.drop("n_words"), "scores")
    C.discard(rows)
    n = scored.where("able").count() * s.percent // 100
    return draw(scored, n)
