"""Shared pieces of the corpus operators: scratch tables, word hashing and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.ship import ship

#: Texts are hashed in blocks of about this many bytes, so a worker's arrays stay small.
BLOCK_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; an own one on one machine only (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "LEDGERLINE_SCRATCH" not in os.environ:
        os.environ["LEDGERLINE_SCRATCH"] = tempfile.mkdtemp(prefix="ledgerline-")
    return "file://" + os.environ["LEDGERLINE_SCRATCH"]


def materialise(df: DataFrame, tag: str, row_group: int | None = None) -> DataFrame:
    """Write df as a table of the shared folder and read it back: lineage is cut, and a lost executor costs a reread.
    row_group: the bytes of its row groups, for rows of long lists."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    # sizes are looked at after every tenth row instead of every hundredth
    (writer.option("parquet.block.size", row_group).option("parquet.page.size.row.check.min", 10) if row_group else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables whose readers are all written."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: long texts then never add up to much memory in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- words

_RNG = np.random.default_rng(20240229)
POW = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]  # A-Z hash as a-z
_U33, _U29 = np.uint64(33), np.uint64(29)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

#: Bytes that end a word: white space only, or all of ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NOT_ALNUM[_a:_b] = False


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U33)) * _C1
    h = (h ^ (h >> _U29)) * _C2
    return h ^ (h >> _U33)


def _hash_block(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~ends[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return start, stop, np.zeros(0, np.uint64)
    at = np.arange(len(buf)) - np.repeat(start, np.diff(np.append(start, len(buf)))) if start[0] == 0 else None
    if at is None:
        at = np.arange(len(buf)) - np.repeat(np.append(0, start), np.diff(np.concatenate(([0], start, [len(buf)]))))
    value = BYTE[buf] * POW[at & 4095] * inside
    if at.max() > 4095:
        value *= (at >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.add.reduceat(value, start)
    return start, stop, mix(h + (stop - start).astype(np.uint64))


def hash_words(texts: list[bytes], ends: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: start and stop byte (in the texts joined by one byte), hash; and, for each text, its first word's index (one more at the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    heads = np.cumsum([0] + [len(t) + 1 for t in texts])
    parts, i = [], 0
    while i < len(buf):
        j = min(len(buf), i + 4 * BLOCK_BYTES)
        while j < len(buf) and not ends[buf[j - 1]]:  # blocks end where a word ends
            nxt = np.flatnonzero(ends[buf[j : j + BLOCK_BYTES]])
            j = j + int(nxt[0]) + 1 if len(nxt) else min(len(buf), j + BLOCK_BYTES)
        s, e, h = _hash_block(buf[i:j], ends)
        parts.append((s + i, e + i, h))
        i = j
    start, stop, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return start, stop, h, np.searchsorted(start, heads)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _STEP[0]
    for j in range(1, k):
        out += h[j : n + j] * _STEP[j]
    return mix(out)


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose texts have about BLOCK_BYTES together; null texts count as empty."""
    values = batch.column(text).cast(pa.binary()).to_pylist()
    i = size = 0
    for j, v in enumerate(values):
        size += len(v or b"")
        if size >= BLOCK_BYTES or j + 1 == len(values):
            yield batch.slice(i, j + 1 - i), [x or b"" for x in values[i : j + 1]]
            i, size = j + 1, 0


# ---------------------------------------------------------------- components


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that the links (a, b) reach, for every linked node but the smallest ones.

    Large-star and small-star rounds: each node hands its smallest neighbour on until every edge points at its
    component's smallest node. Minima are pre-aggregated, so a hub costs one row a task; edges never leave the
    executors. Each round's tables are written, which cuts lineage and leaves joins whose hot keys Spark can split.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, before = materialise(edges, "edges"), None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        old, first = edges, materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "low")
        large = both.where("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct(), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old, first, large, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def looked_up(left: DataFrame, names: DataFrame, on: str, value: str, weight: str, salt: str, most: int = 1024) -> DataFrame:
    """left with names' `value` for its binary column `on`, or null. names: a written table of (on, value, weight), a row for
    each key, weight being its rows in left. Keys with more than 1 / most of all rows, thus at most `most`, are broadcast;
    their rows, and those without a key, are dealt by `salt` instead."""
    total = names.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(names.where(F.col(weight) > total / most).select(on, F.col(value).alias("_hot")))
    rest = names.select(F.col(on).alias("_at"), F.col(value).alias("_value"))
    at = F.coalesce(F.when(F.col("_hot").isNull(), F.col(on)), F.unhex(F.md5(F.xxhash64(salt).cast("string").cast("binary"))))
    out = left.join(hot, on, "left").withColumn("_at", at).join(rest, "_at", "left")
    return out.withColumn(value, F.coalesce("_hot", "_value")).drop("_at", "_hot", "_value")


def by_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 16_384) -> DataFrame:
    """Apply run to frames that hold whole groups, about `rows` rows at once: one shuffle, then a stream of sorted rows.

    Cheaper than one call for each group. A group is held in memory, so groups must be bounded by construction.
    """

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, least = 0, rows

        def done(whole: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            out = run(whole)
            if len(out):
                yield from pa.Table.from_pandas(out[fields.names], fields, preserve_index=False).to_batches()

        for batch in batches:  # batches may be small: they become a frame together
            held.append(batch)
            size += batch.num_rows
            if size < least:
                continue
            whole = pa.Table.from_batches(held)
            last = whole.slice(size - 1)
            other = np.zeros(size, bool)
            for k in keys:
                other |= ~whole[k].to_pandas().eq(last[k][0].as_py()).to_numpy()
            begin = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # the last group may go on
            if begin:
                yield from done(whole.slice(0, begin).to_pandas())
            held, size = whole.slice(begin).to_batches(), size - begin
            least = max(rows, 2 * size)
        if size:
            yield from done(pa.Table.from_batches(held).to_pandas())

    dealt = df.repartition(width(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(stream, schema)
