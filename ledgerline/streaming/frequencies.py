"""Document frequencies of terms, kept up by signed batches, for weights of texts that arrive over time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import discard, written
from ..functions.similarity import terms

TOTAL = ""  # counts texts themselves; no term is empty
_COUNTS = "term string, n long"


def commit(changes: DataFrame, folder: str, number: int, stop_words: frozenset[str] = frozenset()) -> None:
    """Write what a batch changes: (text, sign) with sign 1 for a text that comes and -1 for one that goes; a revised text is both.

    Equal texts count each; null texts and texts without terms count as texts only. Signs add up in any order of batches, and a
    batch that is run again overwrites its own folder. Extra columns are left alone; an empty batch changes nothing.
    """
    own = changes.select(F.monotonically_increasing_id().alias("_at"), F.col("text"), F.col("sign").cast("long").alias("sign"))
    kept = written(own, "changes")  # numbers of rows hold only for rows that are written
    of = terms(kept, stop_words, "_at", "text").distinct().join(kept.select(F.col("_at").alias("key"), "sign"), "key")
    counted = of.groupBy("term").agg(F.sum("sign").alias("n")).unionByName(kept.agg(F.lit(TOTAL).alias("term"), F.coalesce(F.sum("sign"), F.lit(0)).alias("n")))
    counted.where("n != 0").select("term", F.col("n").cast("long").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
    discard(kept)


def _read(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    """(term, n, at): what the folders `kind`=... hold; None without any."""
    try:
        return spark.read.schema(f"{_COUNTS}, {kind} long").option("basePath", folder).parquet(f"{folder}/{kind}=*").withColumnRenamed(kind, "at")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def totals(spark: SparkSession, folder: str, until: int | None = None) -> DataFrame:
    """(term, n) after the batches up to `until`, or all; from the latest base at or before it and the batches behind that."""
    upto = F.lit(True) if until is None else F.col("at") <= until
    bases, batches = _read(spark, folder, "base"), _read(spark, folder, "batch")
    parts, begun = [spark.createDataFrame([], _COUNTS)], None
    if bases is not None and (begun := bases.where(upto).agg(F.max("at")).first()[0]) is not None:
        parts.append(bases.where(F.col("at") == begun).select("term", "n"))
    if batches is not None:
        parts.append(batches.where(upto & (F.lit(True) if begun is None else F.col("at") > begun)).select("term", "n"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("term").agg(F.sum("n").alias("n")).where("n != 0")


def compact(spark: SparkSession, folder: str, until: int) -> None:
    """Sum up batches to `until` as a base, which readers take from then on. No batch up to it may come after; one that is run
    again isn't counted again."""
    totals(spark, folder, until).write.mode("overwrite").parquet(f"{folder}/base={until}")


def fitted(spark: SparkSession, folder: str, until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, df) and one row (n), for `tfidf(..., fit=)`: the weights of a version, which never change."""
    every = totals(spark, folder, until)
    n = every.where(F.col("term") == TOTAL).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return every.where(F.col("term") != TOTAL).withColumnRenamed("n", "df"), n
