"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 25
    rows: int = 5  # a pair at 0.8 has no band in common once in 20,000 times
    batch: int = 25  # hashes compared before each look at the posterior
    miss: float = 1e-6  # a pair is dropped when its similarity is high enough with less than this probability
    block: int = 256  # rows of a bucket that are compared with as many at once
    cells: int = 4_000_000  # shingles of these rows together

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


_SEEDS = np.random.default_rng(41).integers(1, 2**63, (2, 512), dtype=np.uint64) | np.uint64(1)


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(hashes compared, matches below which a pair is dropped), for each batch.

    With a uniform prior the similarity's posterior after m of n matches is Beta(m + 1, n - m + 1); it exceeds t with
    the probability that n + 1 tosses of a coin of bias t give at most m heads.
    """
    out, t = [], s.similarity
    for n in range(s.batch, s.hashes + 1, s.batch):
        p, m = 0.0, 0
        while True:
            p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if p >= s.miss:
                break
            m += 1
        out.append((n, m))
    return out


def plausible(a: np.ndarray, b: np.ndarray, s: Settings, looks: list[tuple[int, int]]) -> np.ndarray:
    """Of pairs of signatures (rows of a and b), which survive every look; later batches see survivors only."""
    live, matches, begin = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in looks:
        matches = matches + (a[live, begin:n] == b[live, begin:n]).sum(1)
        keep = matches >= least
        live, matches, begin = live[keep], matches[keep], n
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def sets_of(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words part at ASCII white space, A-Z count as a-z.

    With fewer than k words, all of them are one shingle; without words there is none.
    """
    _, _, h, first = C.hash_words(texts)
    g = C.grams(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(C.grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def digest(cell: bytes) -> bytes | None:
    """The name of a set; none for the empty one."""
    return hashlib.blake2b(cell, digest_size=16).digest() if cell else None


def signature(x: np.ndarray, n: int) -> bytes:
    out = np.full(n, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 4096):
        y = (x[i : i + 4096, None] * _SEEDS[0, :n] + _SEEDS[1, :n]) >> np.uint64(32)
        np.minimum(out, y.min(0).astype(np.uint32), out=out)
    return out.tobytes()


def profiles(docs: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """(key, n_shingles, class, sig) for every row: class is a digest of the set; both are null for texts without words."""
    C.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in C.blocks(batch, "text"):
                sets = sets_of(texts, s.shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([digest(x.tobytes()) for x in sets], pa.binary()),
                        pa.array([signature(x, s.hashes) if len(x) else None for x in sets], pa.binary()),
                    ],
                    names=["key", "n_shingles", "class", "sig"],
                )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_shingles long, class binary, sig binary")


def _banded(members: DataFrame, s: Settings) -> DataFrame:
    """(bucket, node, n, cells, head): the classes of each bucket with several; head: the one with the most copies.

    Counts are written before they are joined back: both sides of the join are then plain shuffles, of which Spark can
    split a hot bucket's.
    """
    each = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("sig", 1 + 4 * s.rows * i, 4 * s.rows)).alias("bucket")) for i in range(s.bands)]
    spread = members.select(F.explode(F.array(*each)).alias("e"), "node", "copies", "n_shingles").select("e.band", "e.bucket", "node", "copies", "n_shingles")
    spread = C.materialise(spread, "bands")
    heads = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("cells"), F.max_by("node", F.struct("copies", F.xxhash64("node"))).alias("head")).where("n > 1")
    heads = C.materialise(heads, "heads")
    out = C.materialise(spread.select("band", "bucket", "node").join(heads, "bucket"), "buckets")
    C.discard(spread, heads)
    return out


def _sets(docs: DataFrame, named: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """(node, set): shingle sets of the classes (node, id) in `named`, from the whole texts of their smallest key."""
    ids = named.select("id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in C.blocks(batch, "text"):
                cells = [x.tobytes() for x in sets_of(texts, s.shingle)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(digest, cells)), pa.binary()), pa.array(cells, pa.binary())], names=["node", "set"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids.hint("shuffle_hash"), "id", "left_semi")
    return rows.select("text").mapInArrow(run, "node binary, set binary").where("node is not null").dropDuplicates(["node"])


def _verified(pairs: DataFrame, members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: signatures first, batch by batch, then the survivors' sets."""
    looks, t = least_matches(s), s.similarity
    num, den = (round(t * 100), 100)

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), np.uint32).reshape(len(v), -1) for v in (a, b))
        return pd.Series(plausible(x, y, s, looks))

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(den * both >= num * (len(u) + len(v) - both))
        return pd.Series(out, dtype=bool)

    side = lambda df, of, to: df.select(F.col("node").alias(to), F.col(of).alias(f"{of}_{to}"))
    kept = pairs.join(side(members, "sig", "a"), "a").join(side(members, "sig", "b"), "b").where(likely("sig_a", "sig_b")).select("a", "b")
    return kept.join(side(sets, "set", "a"), "a").join(side(sets, "set", "b"), "b").where(similar("set_a", "set_b")).select("a", "b")


def _across(banded: DataFrame, members: DataFrame, sets: DataFrame, label: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links between classes that share a bucket and aren't connected yet.

    Only buckets with several components are left, and not those of two classes, which were held against each other
    before. A bucket's rows are dealt to blocks of about `block` rows and `cells` shingles; each pair of blocks is one
    group, so no group grows with the bucket. Within it, pairs that survive the looks at their signatures are verified on
    their sets, at the first band they share; a link joins two components, whose other pairs then need no look. So links
    come out, and no lists of pairs, however large a group of near copies is.
    """
    looks, num = least_matches(s), round(s.similarity * 100)
    named = banded.where("n > 2").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    split = F.greatest(F.ceil(F.col("n") / s.block), F.ceil(F.col("cells") / s.cells)).cast("int")
    rows = named.join(C.materialise(mixed, "mixed"), "bucket").withColumn("g", split)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("g")).cast("int"))
    rows = rows.join(members.select("node", "sig"), "node").join(sets, "node")
    rows = rows.select("band", "bucket", "node", "label", "sig", "set", "own", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    rows = rows.select("band", "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label", "sig", "set")
    width = s.rows

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
        ids, own, sets, band = pdf["node"].to_list(), pdf["own"].to_numpy(), pdf["set"].to_list(), int(pdf["band"].iloc[0])
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        group = pd.factorize(pdf["label"])[0]
        before = sig[:, : band * width].reshape(len(sig), band, width)
        found = []
        for i in left.tolist():
            js = right[right > i] if x == y else right
            js = js[group[js] != group[i]]
            if band and len(js):
                js = js[~(before[js] == before[i]).all(2).any(1)]
            if len(js):
                js = js[plausible(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js], s, looks)]
            if not len(js):
                continue
            u = np.frombuffer(sets[i], np.uint64)
            for j in js[np.argsort(-(sig[js] == sig[i]).sum(1), kind="stable")].tolist():
                if group[j] == group[i]:
                    continue
                v = np.frombuffer(sets[j], np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * both >= num * (len(u) + len(v) - both):
                    group[group == group[j]] = group[i]
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("bucket", "x", "y").applyInPandas(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings | None = None) -> DataFrame:
    """(key, n_shingles, component, kept) for every row; component: the smallest key that links reach, itself included.

    Rows whose shingle sets are equal are one class, named by a digest of the set, so copies never meet in pairs.
    Classes that share a band are candidates. First each is held against one leader of its bucket, the class with the
    most copies: linear work, which joins most of a large group. What shares a bucket but is still apart is then compared
    in blocks, so that no link between different texts is lost. Links are confirmed on the full sets.

    Null, empty and blank texts: no shingles, linked with nothing. Null keys: component null, not kept. Rows of one key
    are one document, which links through each of its texts; of repeated rows all have the same result. Very long texts:
    whole sets, in blocks bounded by their size. Empty table: no rows.
    """
    s = s or Settings()
    rows = C.materialise(profiles(docs, key, text, s), "profiles")
    able = rows.where("class is not null and key is not null").withColumnRenamed("class", "node")
    own = able.groupBy("node").agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    members = C.materialise(own, "classes")
    banded = _banded(members, s)
    sets = C.materialise(_sets(docs, members.join(banded.select("node").distinct(), "node", "left_semi"), key, text, s), "sets")

    star = banded.where("node != head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    links = C.materialise(_verified(star, members, sets, s), "links")
    label = C.components(links)
    found = C.materialise(_across(banded, members, sets, label, s), "across")
    # texts of one key belong together
    several = able.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z")
    same = able.join(several, "key").where("a != node").select("a", F.col("node").alias("b")).distinct()
    label = C.components(links.union(found).union(same))

    # classes that need a name other than their row's key: joined or with copies
    named = members.select("node", "id", "copies").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("classes"), F.sum("copies").alias("n")).where("n > 1")
    least = C.materialise(least, "components")
    named = C.looked_up(named, least, "label", "component", "classes", "node").where("component is not null")
    named = C.materialise(named.select(F.col("node").alias("class"), "component", "copies"), "names")
    out = C.looked_up(rows.select("key", "n_shingles", "class"), named, "class", "component", "copies", "key")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    C.discard(banded, sets, links, found, least)
    return out.select("key", "n_shingles", component.alias("component"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
