"""Token counts by source, language and tokenizer version, maintained from signed deltas."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

BY = ("source", "language", "version")
DELTA = "source string, language string, version string, docs long, tokens long"


def byte_bpe(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """A maker of counters over a rank file of byte-level BPE; special tokens' strings are ordinary text."""

    def make() -> Callable[[list[str]], list[int]]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]

    return make


def counts(docs: DataFrame, make: Callable, version: str, key: str = "doc_id", text: str = "text", source: str = "source", language: str = "lang") -> DataFrame:
    """(key, source, language, version, tokens) for every row. Null and empty text: 0 tokens. Null source
    or language: a group of its own. Repeated rows and null keys count each. Empty table: no rows."""
    C.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make()
        for batch in batches:
            n = count([x or "" for x in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["key", "source", "language", "version", "tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(language).cast("string").alias("language"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, source string, language string, version string, tokens long")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Inserts (sign 1) or deletes (sign -1) of counted documents."""
    return rows.select(*BY, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changes when counts, sources or languages of documents are revised: each old row out, each new row in.

    Equal old and new rows cancel out when the batch is summed, so no join is needed.
    """
    return signed(before, -1).unionByName(signed(after, 1))


class Rollup:
    """Committed batches under a path that all executors share.

    A batch is the sum of its signed rows by group, written to a folder named after it; it counts once Spark's _SUCCESS
    file is there. Committing a batch again does nothing, and a batch that broke off is overwritten by the next try: a
    retry never counts twice. Totals are sums over batches, so their order doesn't matter. compact() writes the total
    of all batches and their names; totals() then reads that and the batches since.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _done(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        return [n for n in names if fs.exists(self._fs(f"{self.path}/{folder}/{n}/_SUCCESS")[1])]

    def batches(self) -> list[str]:
        return self._done("batches")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False if a batch of this name is committed already."""
        if not re.fullmatch(r"[\w.-]+", batch) or batch.startswith((".", "_")):
            raise ValueError(f"a batch can't be named {batch!r}")
        if batch in self.batches() or batch in self._base()[1]:
            return False
        total = changes.groupBy(*BY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")
        total.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _base(self) -> tuple[str | None, list[str]]:
        done = [x for x in self._done("bases") if not x.endswith("-names")]
        if not done:
            return None, []
        path = f"{self.path}/bases/{done[-1]}"
        return path, [r[0] for r in self.spark.read.schema("batch string").parquet(f"{path}-names").collect()]

    def compact(self) -> None:
        """Write all batches so far as one total. Its names and its sums come from one listing, so a batch committed in the
        meantime is in neither."""
        names, (base, old) = self.batches(), self._base()
        total = self._sum(base, [b for b in names if b not in old])
        n = f"{self.path}/bases/{len([x for x in self._done('bases') if not x.endswith('-names')]):08d}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(x,) for x in sorted({*names, *old})], "batch string").write.parquet(f"{n}-names")
        total.coalesce(1).write.parquet(n)

    def _sum(self, base: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{b}" for b in batches] + ([base] if base else [])
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*BY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def totals(self) -> DataFrame:
        """(source, language, version, docs, tokens); groups whose documents are all gone are absent. No batches: no rows."""
        base, held = self._base()
        return self._sum(base, [b for b in self.batches() if b not in held])
