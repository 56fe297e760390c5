"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ring positions. A key's position is its hash modulo this, so the ring's plan has at most as many rows, however large the table is.
POSITIONS = 1 << 16


def _point(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big") % POSITIONS


class Ring:
    """Virtual nodes of shards 0..n-1 around POSITIONS positions."""

    def __init__(self, shards: int, virtual: int = 128):
        self.shards = shards
        nodes = sorted((_point(f"shard-{s}#{v}"), s) for s in range(shards) for v in range(virtual))
        self.at, self.owner = [p for p, _ in nodes], [s for _, s in nodes]

    def assign(self, positions: np.ndarray, loads: np.ndarray, slack: float = 0.002) -> dict[int, int]:
        """Shard of each position. One with more load than its shard has room for continues clockwise.

        The bound is (1 + slack) times the mean load. Positions are placed by the power of two of their load, heavy
        ones first, then in a fixed order: more rows or one more shard then move few of them, and light positions are
        left to fill the room. Should no shard have room (one position heavier than that), the emptiest takes it.
        """
        total = int(loads.sum()) if len(loads) else 0
        left, out = [math.ceil((1 + slack) * total / self.shards)] * self.shards, {}
        scatter = (positions.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        for i in np.lexsort((scatter, -np.floor(np.log2(np.maximum(loads, 1))))):
            p, load = int(positions[i]), int(loads[i])
            k = bisect.bisect_left(self.at, p)
            for step in range(len(self.owner)):
                s = self.owner[(k + step) % len(self.owner)]
                if left[s] >= load:
                    break
            else:
                s = max(range(self.shards), key=left.__getitem__)
            left[s] -= load
            out[p] = s
        return out


def position(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(-1).cast("long"))), F.lit(POSITIONS)).cast("int")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", slack: float = 0.002, virtual: int = 128) -> DataFrame:
    """Put every row into one of `shards` shards: (key, text_crc32, size, position, shard, slot).

    size: UTF-8 bytes of the text plus 1. Two passes: the loads of the ring's positions are summed on the executors (at
    most POSITIONS rows reach the driver, whatever the table's size), the ring is filled there, and its plan, of as many
    rows, is broadcast back. slot numbers a shard's rows from 0 without a gap: the rows before a position are known from
    the plan, and only rows of one position are ordered together.

    Null text: size 1 and CRC 0. Null key: one position for all of them. Repeated rows: each gets a slot of its own.
    Empty table: no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        position(key).alias("position"),
    )
    loads = rows.groupBy("position").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas()
    at = Ring(shards, virtual).assign(loads["position"].to_numpy(), loads["size"].to_numpy().astype(np.int64), slack)
    loads["shard"] = [at[p] for p in loads["position"]]
    loads = loads.sort_values(["shard", "position"])
    loads["before"] = loads.groupby("shard")["n"].cumsum() - loads["n"] if len(loads) else []
    plan = spark.createDataFrame([(int(p), int(s), int(b)) for p, s, b in zip(loads["position"], loads["shard"], loads["before"], strict=True)], "position int, shard int, before long")
    ordered = rows.selectExpr("*", "row_number() over (partition by position order by key, text_crc32, size) - 1 as nth")
    return ordered.join(F.broadcast(plan), "position").select("key", "text_crc32", "size", "position", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"))
