"""State of the event stream: versions by batch of open articles, and a history of events that have ended.

A batch reads the version before it and writes its own, so a batch that is run again finds the same state and writes the
same rows. What has ended leaves the state, which therefore holds some two windows of articles however long a stream runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scratch import discard, remove, written
from ..operators.clustering import candidates, cluster_deals
from ..operators.dedupe import dedupe
from ..operators.scoring import score_articles

KEPT = 3  # versions that are left to readers


def moment() -> Column:
    """An article's time in the life of a stream: when it was published, at most a day after it was retrieved; else when it
    was retrieved. Null if neither is known."""
    return F.least(F.coalesce("published_at", "retrieved_at"), F.col("retrieved_at") + F.expr("interval 1 day"))


def _before(spark: SparkSession, state: str, number: int, like: DataFrame) -> tuple[DataFrame, int | None]:
    """The version before a batch: its open articles with their events, and the stream's time in microseconds."""
    if number == 0:
        return like.withColumn("event_id", F.lit(None).cast("string")).limit(0), None
    clock = spark.read.parquet(f"{state}/clock/batch={number - 1}").first()[0]
    return spark.read.parquet(f"{state}/open/batch={number - 1}"), clock


def _carried(members: DataFrame, number: int) -> DataFrame:
    """(cluster_id, event_id): an event keeps the id of the one that most of its articles had. Where an event falls apart,
    the part with most of its articles keeps the id; where events merge, the oldest id stays; what is new gets an id from
    the batch and its smallest article."""
    shared = members.where("event_id is not null").groupBy("event_id", "cluster_id").agg(F.count("*").alias("n"))
    heir = shared.groupBy("event_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster_id")).alias("best"))
    won = heir.groupBy(F.col("best.cluster_id").alias("cluster_id")).agg(F.min("event_id").alias("old"))
    new = members.groupBy("cluster_id").agg(F.min("article_id").alias("first"))
    own = F.concat(F.lit(f"{number:09d}-"), "first")
    return new.join(won, "cluster_id", "left").select("cluster_id", F.coalesce("old", own).alias("event_id"))


def _repeat(spark: SparkSession, state: str, events: str, number: int) -> None:
    """The version before, as this batch's."""
    for part in (f"{state}/open", f"{state}/clock", f"{events}/open"):
        spark.read.parquet(f"{part}/batch={number - 1}").write.mode("overwrite").parquet(f"{part}/batch={number}")
    spark.read.parquet(f"{events}/ended/batch={number - 1}").limit(0).write.mode("overwrite").parquet(f"{events}/ended/batch={number}")
    _forget(spark, state, events, number)


def _forget(spark: SparkSession, state: str, events: str, number: int) -> None:
    if number >= KEPT:
        remove(spark, *(f"{part}/batch={number - KEPT}" for part in (f"{state}/open", f"{state}/clock", f"{events}/open")))


def advance(batch: DataFrame, number: int, state: str, events: str, config: Config | None = None, days: int = 30) -> None:
    """One batch of scored articles: events of the open articles and these are formed anew, as in a run over a table.

    An event whose newest article is more than `days` older than the stream's time has ended: it goes to the history, where
    it stays as it is, and its articles leave the state. So do articles of that age that no open event has. The stream's
    time is the latest of all articles' and never goes back; an article that is late joins what is still open. Articles
    without any time take part in their own batch only. Rows that the state already has (by row_idx) count once. An empty
    batch's version is that of the batch before.
    """
    c, spark = config or Config(), batch.sparkSession
    old, clock = _before(spark, state, number, batch)
    fresh = batch.dropDuplicates(["row_idx"]).join(old.select("row_idx"), "row_idx", "left_anti")
    if number and fresh.isEmpty():
        _repeat(spark, state, events, number)
        return
    rows = written(old.unionByName(fresh.withColumn("event_id", F.lit(None).cast("string"))), "open")
    latest = rows.agg(F.max(F.unix_micros(moment()))).first()[0]
    clock = max((t for t in (clock, latest) if t is not None), default=None)
    ended = F.coalesce(F.unix_micros(moment()) < (clock or 0) - days * 86_400_000_000, F.lit(True))  # without a time: at once

    scored = written(score_articles(dedupe(rows.drop("event_id"), c), c), "scored")
    ids, records = cluster_deals(candidates(scored, c.min_relevance, c.min_credibility), c)
    members = written(rows.join(ids, "row_idx").select("row_idx", "article_id", "event_id", "cluster_id", ended.alias("ended")), "members")
    named = _carried(members, number).join(members.groupBy("cluster_id").agg(F.bool_and("ended").alias("ended")), "cluster_id")
    named = written(named, "named")
    told = written(records.join(named, "cluster_id").drop("cluster_id"), "told")

    held = members.select("row_idx", "cluster_id").join(named, "cluster_id").select("row_idx", F.col("event_id").alias("_event"), F.col("ended").alias("_ended"))
    left = rows.join(held, "row_idx", "left").where(~F.coalesce("_ended", ended))
    left = left.withColumn("event_id", F.col("_event")).drop("_event", "_ended")
    told.where("ended").drop("ended").write.mode("overwrite").parquet(f"{events}/ended/batch={number}")
    told.where("not ended").drop("ended").write.mode("overwrite").parquet(f"{events}/open/batch={number}")
    left.write.mode("overwrite").parquet(f"{state}/open/batch={number}")
    spark.createDataFrame([(clock,)], "clock long").coalesce(1).write.mode("overwrite").parquet(f"{state}/clock/batch={number}")
    _forget(spark, state, events, number)
    discard(rows, scored, members, named, told)


def event_history(spark: SparkSession, events: str) -> DataFrame:
    """All events of a stream, each once: those that have ended, and the latest version of the open ones. `ended` tells them apart."""
    done = spark.read.parquet(f"{events}/ended").withColumn("ended", F.lit(True))
    live = spark.read.parquet(f"{events}/open").withColumn("ended", F.lit(False))
    last = live.agg(F.max("batch")).first()[0]
    done = done.where(F.col("batch") <= F.lit(last))  # a batch that is being written hasn't told its open events yet
    return done.unionByName(live.where(F.col("batch") == F.lit(last))).drop("batch")
