"""The article table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions.scratch import written

_S, _TS, _I, _L = T.StringType(), T.TimestampType(), T.IntegerType(), T.ArrayType(T.StringType())

#: What sources deliver.
RAW = T.StructType(
    [T.StructField(n, t) for n, t in (("article_id", _S), ("title", _S), ("snippet", _S), ("url", _S), ("source_name", _S), ("domain", _S), ("published_at", _TS), ("retrieved_at", _TS), ("source_api", _S), ("query", _S), ("is_sample", T.BooleanType()), ("row_idx", T.LongType()))]
)

#: Columns of a processed article, in order.
ARTICLE = (
    "article_id", "title", "snippet", "url", "canonical_url", "source_name", "domain", "published_at", "retrieved_at", "source_api", "query", "is_sample",
    "normalized_title", "duplicate_of", "dedupe_status", "dedupe_reason", "relevance_score", "relevance_reasons", "credibility_score", "credibility_tier",
    "cluster_id", "status", "credibility_reasons",
)


def empty_articles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW)


def _nth(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with a number for each row among those of one `by`, from 0."""
    counts = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(by).orderBy("_part"))  # as many rows as parts
    before = counts.select(by, "_part", (total - F.col("_n")).alias("_before"))
    order = ("query", "retrieved_at", "snippet", "published_at", "source_name", "domain", "is_sample")
    place = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1
    return rows.withColumn("_place", place).join(before, [by, "_part"]).withColumn(name, F.col("_place") + F.col("_before")).drop("_place", "_before")


def numbered(df: DataFrame) -> DataFrame:
    """Aligned rows with ids of their own. One article that two queries return has equal digests: all but one of these
    rows get a number. Rows of one title and address at two times share an article_id but no row_idx, so each is numbered
    by itself. Rows are counted by the part they were written in, so an article that a third of all rows repeat is numbered
    by many tasks."""
    rows = written(df.withColumn("_part", F.spark_partition_id()), "raw")
    out = _nth(_nth(rows, "row_idx", "_nth"), "article_id", "_nth_id")
    new = {
        "article_id": F.when(F.col("_nth_id") == 0, F.col("article_id")).otherwise(F.concat_ws("-", "article_id", "_nth_id")),
        "row_idx": F.when(F.col("_nth") == 0, F.col("row_idx")).otherwise(F.xxhash64("row_idx", "_nth")),
    }
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in df.columns))


def align(df: DataFrame) -> DataFrame:
    """df with the raw columns, each of its type; missing ones are null. article_id is a digest of the row's content, which
    repeated rows share until they are numbered.

    row_idx stands for the order of rows, which decides ties: connectors set it; otherwise rows are ranked by content.
    """
    own = {f.name: F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in RAW}
    digest = F.substring(F.sha2(F.concat_ws("\u0001", own["source_api"], own["url"], own["title"]), 256), 1, 12)
    own["article_id"] = F.coalesce(own["article_id"], digest)
    own["row_idx"] = F.coalesce(own["row_idx"], F.xxhash64(own["source_api"], own["url"], own["title"], own["published_at"]))
    return df.select(*(c.alias(n) for n, c in own.items()))
