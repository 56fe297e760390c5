"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; an own one on one machine only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "LEDGERLINE_SCRATCH" not in os.environ:
        os.environ["LEDGERLINE_SCRATCH"] = tempfile.mkdtemp(prefix="ledgerline-")
    return "file://" + os.environ["LEDGERLINE_SCRATCH"]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table written once: lineage is cut, and losing an executor costs a reread."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def ranked(df: DataFrame, order: Column, key: str = "row_idx") -> DataFrame:
    """(key, rank): ranks in a total order, dealt by range, with gaps between the parts. Parts are numbered in order of their
    ranges, and rows in order within."""
    spread = df.select(key, order.alias("o")).repartitionByRange(F.col("o")).sortWithinPartitions("o")
    return written(spread.select(key, F.monotonically_increasing_id().alias("rank")), "ranks")


def places(df: DataFrame, order: Column, key: str = "row_idx") -> DataFrame:
    """(key, place): 1, 2, ... in a total order. Only the sizes of the parts meet in one task."""
    own = ranked(df, order, key).select(key, F.shiftright("rank", 33).alias("part"), F.col("rank").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    before = own.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return own.join(F.broadcast(before), "part").select(key, (F.col("before") + F.col("at") + 1).alias("place"))  # one row a part


def unsent(df: DataFrame) -> DataFrame:
    """df as the side of a join that is shuffled and never broadcast: it grows with the input, and what is broadcast passes
    through the driver, even where its file is small."""
    return df.hint("merge")


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders, wherever they lie, that nothing reads any more; those that aren't there are passed over."""
    sc = spark.sparkContext
    for name in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables whose readers are all written."""
    for df in tables:
        remove(df.sparkSession, df._scratch)
