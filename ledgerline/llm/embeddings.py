"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with the original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.93
    sample: int = 10_000  # vectors that the rotations are learned on, at most
    rounds: int = 30
    bits: int = 64  # of one code
    miss: float = 0.002  # how often a pair at the threshold may share no table
    per_bucket: int = 20  # vectors of the largest group that a table's bucket has on average
    block: int = 512  # rows of a bucket that are compared with as many at once


@dataclass
class Quantiser:
    """rotations[dim]: (mean, matrix of dim x codes * bits); chunks of `chunk` bits make up `tables` Hamming tables."""

    chunk: int
    tables: int
    bits: int
    rotations: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @property
    def codes(self) -> int:
        return math.ceil(self.tables / (self.bits // self.chunk))

    def rotation(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        if dim not in self.rotations:  # no vector of this size in the sample: random directions
            rng = np.random.default_rng(dim)
            self.rotations[dim] = (np.zeros(dim), rng.normal(size=(dim, self.codes * self.bits)))
        return self.rotations[dim]

    def keys(self, units: np.ndarray) -> np.ndarray:
        """The chunk of each table, for each row of unit vectors."""
        mean, m = self.rotation(units.shape[1])
        on = ((units - mean) @ m > 0).reshape(len(units), self.codes, self.bits)
        each = self.bits // self.chunk
        on = on[:, :, : each * self.chunk].reshape(len(units), self.codes * each, self.chunk)[:, : self.tables]
        return (on @ (1 << np.arange(self.chunk))).astype(np.int64)


def learn(units: np.ndarray, bits: int, codes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions, then for each code a rotation that brings the sample nearest to its own signs (iterative quantisation).
    Hyperplanes go through the origin: the number of tables counts on angles there, and a mean would follow a hot vector."""
    dim = units.shape[1]
    mean = np.zeros(dim)
    x = units
    _, vectors = np.linalg.eigh(x.T @ x)
    base = vectors[:, ::-1][:, : min(bits, dim)]
    p, out = x @ base, []
    for c in range(codes):
        rng = np.random.default_rng(1000 + c)
        r = np.linalg.qr(rng.normal(size=(p.shape[1], p.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
            r = (u @ vt).T
        m = base @ r
        if m.shape[1] < bits:  # fewer dimensions than bits: random directions fill up
            m = np.concatenate([m, rng.normal(size=(dim, bits - m.shape[1]))], 1)
        out.append(m)
    return mean, np.concatenate(out, 1)


def _unit(v: object) -> np.ndarray | None:
    """v as a unit vector in double precision; None for vectors that link with nothing."""
    if v is None:
        return None
    x = np.array([np.nan if y is None else y for y in v] if not isinstance(v, np.ndarray) or v.dtype == object else v, np.float64)
    n = np.sqrt((x * x).sum()) if len(x) else 0.0
    if not np.isfinite(n) and len(x) and np.isfinite(x).all():  # squares overflow
        x = x / np.abs(x).max()
        n = np.sqrt((x * x).sum())
    if not np.isfinite(n) or n == 0:
        return None
    return x / n


def fit(vectors: DataFrame, largest: int, s: Settings) -> Quantiser:
    """Learn on at most `sample` distinct vectors: copies would be in the sample all at once or not at all. A chunk has about log2 of the largest group's size bits, and there are as many tables
    as a pair at the threshold needs to share one, so recall stays as it is when the table grows."""
    chunk = int(min(16, max(8, round(math.log2(max(1, largest) / s.per_bucket)))))
    apart = math.acos(s.cosine) / math.pi  # how often a bit differs
    tables = math.ceil(math.log(s.miss) / math.log(1 - (1 - apart) ** chunk))
    q = Quantiser(chunk, tables, s.bits)
    got = vectors.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(s.sample).select("vec").toPandas()["vec"]
    units = [u for u in map(_unit, got) if u is not None]
    for dim in {len(u) for u in units}:
        own = np.stack([u for u in units if len(u) == dim])
        if len(own) >= 2:
            q.rotations[dim] = learn(own, s.bits, q.codes, s.rounds)
    return q


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of n nodes that links (i, j) reach."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == old).all():
            return root


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", s: Settings | None = None) -> DataFrame:
    """(key, n_links, component, kept), one row for each key; component: the smallest key that links reach, itself included.

    Pairs of one group with a cosine of at least s.cosine link. Candidates share a chunk of their codes in some table;
    each is reranked with the original vectors in double precision, at the first table it shares. A bucket's rows are
    dealt to blocks of about `block`, each pair of blocks is a group of its own, and only counts and a spanning forest
    leave it: no list of pairs is ever made, however large a group of copies is.

    Vectors that are null, empty or zero or hold a null or non-finite component, and rows without group or key, link with
    nothing. Of several rows of one key the smallest (group, vector) counts. Empty table: no rows.
    """
    s = s or Settings()
    spark = table.sparkSession
    kind = table.schema[key].dataType.simpleString()
    rows = table.groupBy(F.col(key).alias("key")).agg(F.min(F.struct(F.col(group).alias("group"), F.col(vector).alias("vec"))).alias("r"))
    rows = C.materialise(rows.select("key", "r.group", "r.vec"), "vectors")
    able = rows.where("key is not null and `group` is not null and vec is not null")
    largest = able.groupBy("group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shared = spark.sparkContext.broadcast(fit(able, largest, s))

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for pdf in parts:
            units = [_unit(v) for v in pdf["vec"]]
            dims = np.array([0 if u is None else len(u) for u in units])
            for dim in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == dim)
                x = np.stack([units[i] for i in at])
                keys = q.keys(x)
                yield pd.DataFrame({"key": pdf["key"].to_numpy()[at], "kin": pdf["kin"].to_numpy()[at] ^ int(dim), "unit": [v.tobytes() for v in x], "chunks": list(keys)})

    kin = able.select("key", F.xxhash64("group").alias("kin"), "vec")
    codes = C.materialise(kin.mapInPandas(encode, f"key {kind}, kin long, unit binary, chunks array<long>"), "codes")
    spread = codes.select("key", F.posexplode("chunks").alias("table", "chunk"), "kin").select("key", "table", F.xxhash64("kin", "table", "chunk").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = spread.join(sizes, "bucket").select("key", F.struct("bucket", "table", F.ceil(F.col("n") / s.block).cast("int").alias("g")).alias("m"))
    met = met.groupBy("key").agg(F.collect_list("m").alias("ms"))  # one for each table
    # vectors join once, by key, and are shuffled once more, with all their buckets
    dealt = codes.join(met, "key").select("key", "unit", "chunks", "kin", F.explode("ms").alias("m")).select("key", "unit", "chunks", "kin", "m.*")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key", "bucket"), F.col("g")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "table", "kin", "key", "unit", "chunks")
    least = s.cosine

    def links(g: pd.DataFrame) -> pd.DataFrame:
        """The links of one pair of blocks of a bucket."""
        ids, own, kins = g["key"].to_numpy(), g["own"].to_numpy(), g["kin"].to_numpy()
        x, y, table = int(g["x"].iloc[0]), int(g["y"].iloc[0]), int(g["table"].iloc[0])
        units = np.frombuffer(b"".join(g["unit"]), np.float64).reshape(len(g), -1)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        i, j = np.nonzero(units[left] @ units[right].T >= least)
        i, j = left[i], right[j]
        ok = (i < j if x == y else np.ones(len(i), bool)) & (kins[i] == kins[j])
        i, j = i[ok], j[ok]
        if not len(i):
            return g.iloc[:0]
        chunks = np.stack(g["chunks"].to_list())
        same = (chunks[i, :table] != chunks[j, :table]).all(1)  # a pair counts at the first table that it shares
        i, j = i[same], j[same]
        n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        hit = np.flatnonzero(n)
        return pd.DataFrame({"a": ids[hit], "b": ids[_roots(len(ids), i, j)][hit], "n": n[hit]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["bucket", "x", "y"]].to_numpy(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]).any(1), [True])))
        out = [r for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if b - a > 1 and len(r := links(pdf.iloc[a:b]))]
        return pd.concat(out, ignore_index=True) if out else pdf.iloc[:0]

    found = C.materialise(C.by_groups(dealt, ["bucket", "x", "y"], [], compare, f"a {kind}, b {kind}, n long", rows=2048), "links")
    label = C.components(found.select("a", "b").where("a != b"))
    counted = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    out = rows.select("key").join(counted, "key", "left").join(label.withColumnRenamed("node", "key"), "key", "left")
    component = F.coalesce("label", "key")
    return out.select("key", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
