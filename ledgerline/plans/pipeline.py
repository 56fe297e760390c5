"""A run: raw articles to processed articles, events and a brief."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scratch import written
from ..operators.brief import make_brief
from ..operators.cleaning import apply_cleaning, in_timespan, timespan_label
from ..operators.clustering import candidates, cluster_deals
from ..operators.dedupe import dedupe
from ..operators.polish import Polished
from ..operators.scoring import score_articles
from ..schema import ARTICLE, align, empty_articles, numbered
from ..sources.parsers import KEYED


@dataclass(frozen=True)
class Run:
    raw: DataFrame
    processed: DataFrame
    events: DataFrame
    markdown: str
    brief: dict
    metadata: dict


def process(raw: DataFrame, config: Config | None = None) -> DataFrame:
    """Clean, flag duplicates, score: every row stays. Written once, as clustering and sinks both read it."""
    clean = written(apply_cleaning(numbered(align(raw)), (config or Config()).suffixes), "clean")
    return written(score_articles(dedupe(clean, config), config), "processed")


def status_counts(processed: DataFrame) -> DataFrame:
    """One row: all rows, duplicates, and included canonical ones."""
    twice, included = F.col("dedupe_status") == "duplicate", (F.col("dedupe_status") == "canonical") & (F.col("status") == "include")
    return processed.agg(F.count("*").alias("all_rows"), F.count_if(twice).alias("duplicates"), F.count_if(included).alias("included"))


def include_count(processed: DataFrame) -> int:
    return status_counts(processed).first()["included"]


def visible(events: DataFrame, min_relevance: int, min_credibility: int) -> DataFrame:
    return events.where((F.col("relevance_score") >= min_relevance) & ((F.col("credibility_score") >= min_credibility) | (F.col("max_article_credibility") >= min_credibility)))


def with_cluster_ids(processed: DataFrame, ids: DataFrame, events: DataFrame) -> DataFrame:
    """cluster_id of rows whose event is shown; else empty."""
    shown = ids.join(events.select("cluster_id"), "cluster_id", "left_semi")
    return processed.join(shown, "row_idx", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(""))).select(*ARTICLE, "row_idx")


def counts_by_source(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source_api").agg(F.count("*").alias("n"))


def source_counts(raw: DataFrame) -> dict[str, int]:
    """By the name of the connector, of which there are few; the most frequent first."""
    return {r["source_api"]: r["n"] for r in counts_by_source(raw).orderBy(F.desc("n"), "source_api").collect()}


def source_warning(counts: dict[str, int]) -> str:
    if not counts:
        return "No live source rows matched the selected date range."
    if counts.get("gdelt") or any(counts.get(k) for k in KEYED):
        return ""
    return "Primary source GDELT returned no rows for this run; results rely on RSS sources."


def run(
    spark: SparkSession,
    source: Callable[[str], DataFrame | None],
    now: datetime,
    timespan: str = "7d",
    sample: DataFrame | None = None,
    config: Config | None = None,
    fallback: bool = True,
    run_at: datetime | None = None,
    polish: Callable[[dict], Polished] | None = None,
) -> Run:
    """source(timespan) gives raw articles; where it fails, the run goes on without rows and says so.

    With too few included articles and a sample at hand, the sample takes the place of all rows; they are never mixed.
    polish: rewords the brief, as a `Polisher` does; what it returns goes to the outputs, and its status to the metadata.
    """
    c = config or Config()
    warning = ""
    try:  # a source's rows are read here, so that one that fails while it is read is caught too
        got = source(timespan)
        live = written(numbered(in_timespan(align(got) if got is not None else empty_articles(spark), timespan, now)), "live")
    except Exception as e:  # a source is foreign code: whatever it raises is reported
        live, warning = written(empty_articles(spark), "live"), f"Live fetch failed: {e}"
    processed = process(live, c)
    live_included = include_count(processed)
    used, reason, raw = False, "", live
    if fallback and sample is not None and live_included < c.fallback_below:
        used, reason, raw = True, f"{live_included} included canonical articles, fewer than {c.fallback_below}", written(numbered(align(sample)), "sample")
        processed = process(raw, c)
    ids, events = cluster_deals(candidates(processed, c.min_relevance, c.min_credibility), c)
    shown = visible(events, c.min_relevance, c.min_credibility)
    out = written(with_cluster_ids(processed, ids, shown), "articles")
    text, brief = make_brief(shown, timespan_label(timespan), run_at or now, used or None)
    worded = polish(brief) if polish else Polished(text, brief, False, "off")
    counts = source_counts(live)
    n = status_counts(out).first()
    mix = brief["snapshot"]["confidence_counts"]
    metadata = {
        "timespan": timespan, "date_range_label": timespan_label(timespan), "min_relevance": c.min_relevance, "min_credibility": c.min_credibility,
        "use_sample_fallback": fallback, "used_sample": used, "fallback_reason": reason, "fetch_warning": warning, "source_warning": source_warning(counts),
        "source_counts": counts, "live_raw_rows": sum(counts.values()), "raw_rows": raw.count(), "processed_rows": n["all_rows"], "live_include_count": live_included,
        "include_count": n["included"], "duplicate_count": n["duplicates"], "cluster_count": brief["snapshot"]["deal_events"], "high_confidence_count": mix.get("High", 0),
        "highlight_count": mix.get("High", 0) + mix.get("Medium", 0), "use_ai_polish": polish is not None, "ai_polish_used": worded.used, "ai_polish_status": worded.status, "ai_polish_warning": worded.warning,
    }
    return Run(raw, out, shown, worded.markdown, worded.brief, metadata)
