"""Parsers of landed payloads: a DataFrame of (payload, query, retrieved_at) in, raw articles out.

Fetching is not done here: payloads land as files or a table, one row for each response, and a parser is a projection
over them. A payload that isn't what its source promises (an HTML page, a missing list, items that aren't objects) gives
no rows and never fails a run.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..functions.text import without_tags
from ..operators.cleaning import in_timespan, present
from ..schema import align, empty_articles

log = logging.getLogger(__name__)

_ITEM = "array<map<string,string>>"


def _time(c: Column, *formats: str) -> Column:
    """The first format that fits, in UTC; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def feed_time(c: Column) -> Column:
    """RFC 822 dates, with or without a weekday."""
    return _time(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,},\s*", ""), "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss")


def iso_time(c: Column) -> Column:
    return _time(c, "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def _items(landed: DataFrame, at: str) -> DataFrame:
    """A row for each object of the payload's list `at`: (item, ordinal) as JSON text, with query and retrieved_at."""
    listed = F.from_json(F.get_json_object("payload", f"$.{at}"), "array<string>", {"mode": "PERMISSIVE"})
    rows = landed.select("*", F.posexplode(listed).alias("ordinal", "item"))
    return rows.where(F.col("item").startswith("{"))


def _field(path: str) -> Column:
    return F.coalesce(F.get_json_object("item", f"$.{path}"), F.lit(""))


def _first(*paths: str) -> Column:
    return F.coalesce(*(F.nullif(_field(p), F.lit("")) for p in paths), F.lit(""))


def _rows(df: DataFrame, api: str, **columns: Column) -> DataFrame:
    keep = {"query": F.col("query"), "retrieved_at": F.col("retrieved_at"), "source_api": F.lit(api), "is_sample": F.lit(False)}
    return align(df.select(*(c.alias(n) for n, c in (keep | columns).items())))


def parse_gdelt(landed: DataFrame) -> DataFrame:
    """articles[]: no snippet; the domain stands for the publisher."""
    at = _time(_field("seendate"), "yyyyMMdd'T'HHmmss'Z'")
    return _rows(_items(landed, "articles"), "gdelt", title=_field("title"), snippet=F.lit(""), url=_field("url"), source_name=_field("domain"), domain=_field("domain"), published_at=at)


def parse_alpha_vantage(landed: DataFrame) -> DataFrame:
    at = _time(_field("time_published"), "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmm")
    return _rows(_items(landed, "feed"), "alpha_vantage", title=_field("title"), snippet=_field("summary"), url=_field("url"), source_name=_field("source"), domain=F.lit(""), published_at=at)


def parse_marketaux(landed: DataFrame) -> DataFrame:
    """data[]: the source is a name or an object with one."""
    source = F.when(_field("source").startswith("{"), _first("source.name", "source.domain")).otherwise(_field("source"))
    return _rows(
        _items(landed, "data"), "marketaux", title=_field("title"), snippet=_first("description", "snippet"), url=_field("url"), source_name=source, domain=F.lit(""), published_at=iso_time(_field("published_at"))
    )


def parse_newsdata(landed: DataFrame) -> DataFrame:
    """results[] of payloads whose status is success. A query's payloads from its first refusal (HTTP 429) on are left out by whoever lands them."""
    ok = landed.where(F.get_json_object("payload", "$.status") == "success")
    return _rows(
        _items(ok, "results"), "newsdata", title=_field("title"), snippet=_first("description", "content"), url=_field("link"), source_name=_first("source_name", "source_id"), domain=F.lit(""), published_at=iso_time(_field("pubDate"))
    )


def parse_newsapi(landed: DataFrame) -> DataFrame:
    return _rows(
        _items(landed, "articles"), "newsapi", title=_field("title"), snippet=_first("description", "content"), url=_field("url"), source_name=_field("source.name"), domain=F.lit(""), published_at=iso_time(_field("publishedAt"))
    )


_FEED = "struct<channel:struct<item:array<struct<title:string,link:string,description:string,pubDate:string,source:struct<_VALUE:string,_url:string>>>>>"


def _entries(landed: DataFrame) -> DataFrame:
    xml = F.when(F.col("payload").rlike(r"(?is)<rss[\s>]"), F.col("payload"))
    feed = F.from_xml(xml, _FEED[7:-1].replace("channel:", "channel ", 1), {"mode": "PERMISSIVE"})
    return landed.select("*", F.posexplode(feed["channel"]["item"]).alias("ordinal", "e"))


def parse_google_news(landed: DataFrame, most: int = 50) -> DataFrame:
    """The first `most` entries of each response."""
    e = _entries(landed).where(F.col("ordinal") < most)
    name = F.coalesce(F.nullif(F.trim(F.col("e.source._VALUE")), F.lit("")), F.lit("Google News"))
    return _rows(
        e, "google_news_rss", title=F.coalesce("e.title", F.lit("")), snippet=without_tags("e.description"), url=F.coalesce("e.link", F.lit("")), source_name=name, domain=F.lit(""), published_at=feed_time(F.col("e.pubDate"))
    )


def parse_wires(landed: DataFrame) -> DataFrame:
    """Feeds of press releases; the landed query is the feed's label."""
    e = _entries(landed)
    return _rows(
        e, "pr_wire_rss", title=F.coalesce("e.title", F.lit("")), snippet=without_tags("e.description"), url=F.coalesce("e.link", F.lit("")), source_name=F.col("query"),
        domain=F.lit(""), published_at=feed_time(F.col("e.pubDate")), query=F.concat(F.lit("feed:"), F.col("query")),
    )


PARSERS = {
    "gdelt": parse_gdelt,
    "google_news_rss": parse_google_news,
    "pr_wire_rss": parse_wires,
    "alpha_vantage": parse_alpha_vantage,
    "marketaux": parse_marketaux,
    "newsdata": parse_newsdata,
    "newsapi": parse_newsapi,
}
KEYED = ("alpha_vantage", "marketaux", "newsapi", "newsdata")


def enabled(keys: dict[str, str], gdelt: bool | None = None) -> list[str]:
    """Sources of a run: feeds always, keyed ones with a key, gdelt where no key is set or it is asked for."""
    keyed = [s for s in KEYED if keys.get(s)]
    use = gdelt if gdelt is not None else not keyed
    return [*(["gdelt"] if use else []), "google_news_rss", "pr_wire_rss", *keyed]


def fan_in(spark: SparkSession, landed: dict[str, DataFrame | Callable[[], DataFrame]], timespan: str, now: datetime, failed: dict[str, str] | None = None) -> DataFrame:
    """All sources' articles of the timespan that have a title and an address; landed: payloads by source, or what reads them.

    Each source is parsed and written by itself: one that can't be read gives no rows and leaves its error in `failed`.
    Without any source there are no rows.
    """
    parts = [empty_articles(spark)]
    for name, df in landed.items():
        try:
            rows = PARSERS[name](df() if callable(df) else df)
            parts.append(written(present(in_timespan(rows, timespan, now)), name))
        except Exception as e:  # a source is foreign: whatever is wrong with it stays its own
            log.warning("source %s failed: %s", name, e)
            if failed is not None:
                failed[name] = str(e)
    return reduce(DataFrame.unionByName, parts)


def cached(spark: SparkSession, table: str, key: str, fetch: Callable[[], DataFrame], now: datetime, seconds: int = 1800) -> DataFrame:
    """fetch()'s rows, landed under `table`; the key's latest landing is read instead while it is younger than `seconds`.

    Landings are folders by key and time and are never overwritten, so a reader keeps the one that it began with.
    """
    at = int(now.timestamp())
    try:
        seen = spark.read.parquet(table).where(F.col("landed_key") == key).agg(F.max("landed_at")).first()[0]
    except AnalysisException:  # nothing has landed yet
        seen = None
    if seen is None or not 0 <= at - seen < seconds:
        fetch().withColumns({"landed_key": F.lit(key), "landed_at": F.lit(at).cast("long")}).write.partitionBy("landed_key", "landed_at").mode("append").parquet(table)
        seen = at
    return spark.read.parquet(table).where((F.col("landed_key") == key) & (F.col("landed_at") == seen)).drop("landed_key", "landed_at")


SAMPLE = "days_ago int, title string, snippet string, url string, source_name string, query string"


def load_sample(spark: SparkSession, path: str, now: datetime) -> DataFrame:
    """A CSV of example articles; row i was published days_ago days and (i mod 12) hours before now."""
    rows = spark.read.csv(path, header=True, schema=SAMPLE, quote='"', escape='"')
    return sample_rows(rows.withColumn("row_idx", F.monotonically_increasing_id()), now)


def sample_rows(rows: DataFrame, now: datetime) -> DataFrame:
    at = F.lit(now) - F.make_dt_interval(F.col("days_ago"), F.pmod("row_idx", F.lit(12)).cast("int"))
    out = rows.withColumns({"published_at": at, "retrieved_at": F.lit(now), "source_api": F.lit("sample"), "is_sample": F.lit(True), "article_id": F.format_string("sample-%03d", F.col("row_idx") + 1)})
    return align(out)
