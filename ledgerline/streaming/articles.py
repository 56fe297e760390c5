"""The article pipeline over a stream of raw articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.cleaning import apply_cleaning, present
from ..operators.scoring import score_articles
from ..schema import align
from .state import advance


def scored_stream(raw: DataFrame, config: Config | None = None, late: str = "14 days") -> DataFrame:
    """Clean and score a stream; of articles with one address within `late` of each other the first to arrive stays."""
    clean = apply_cleaning(align(present(raw)), (config or Config()).suffixes)
    once = clean.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["canonical_url"])
    return score_articles(once, config)


def event_stream(raw: DataFrame, table: str, state: str, events: str, checkpoint: str, config: Config | None = None, days: int = 30) -> StreamingQuery:
    """Log each micro-batch's articles under `table`, and carry the events on; `event_history` reads them.

    A batch reads the state that the batch before left, and never the log. Duplicates and events depend on the order of
    articles over all keys, so state kept by key can't hold them: it is kept as versions by batch (`state.advance`). A batch
    overwrites its own folders, so one that is run again counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        log = f"{table}/batch={number}"
        batch.write.mode("overwrite").parquet(log)
        advance(batch.sparkSession.read.schema(batch.schema).parquet(log), number, state, events, config, days)

    return scored_stream(raw, config).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(raw: DataFrame, at: str = "published_at", late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Articles by source and time window, for a stream or a table."""
    return raw.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), "source_api").agg(F.count("*").alias("n")).select("w.start", "w.end", "source_api", "n")
