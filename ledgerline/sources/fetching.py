"""A Python data source that asks news services and gives their payloads, as a table or as a stream.

    register(spark)
    landed = fetched(spark, "newsdata", queries, key=key)     # payloads for parsers.parse_newsdata
    landed = stream(spark, "gdelt", queries, since=at)        # the same for each span of time, by Structured Streaming
"""

from __future__ import annotations

import json
import logging
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.ship import ship

log = logging.getLogger(__name__)

SCHEMA = "payload string, query string, retrieved_at timestamp, error string"
REFUSED = 429

#: Addresses of the services (fixed values): {query}, {key} and times are filled in. Feeds are addresses themselves.
ADDRESSES = {
    "gdelt": "https://api.gdeltproject.org/api/v2/doc/doc?query={query}&mode=artlist&format=json&maxrecords={most}&startdatetime={since}&enddatetime={until}&sort=datedesc",
    "google_news_rss": "https://news.google.com/rss/search?q={query}&hl=en-US&gl=US&ceid=US:en",
    "alpha_vantage": "https://www.alphavantage.co/query?function=NEWS_SENTIMENT&topics={query}&sort=LATEST&limit={most}&apikey={key}",
    "marketaux": "https://api.marketaux.com/v1/news/all?api_token={key}&search={query}&language=en&limit={most}",
    "newsapi": "https://newsapi.org/v2/everything?q={query}&from={since}&language=en&pageSize={most}&apiKey={key}",
    "newsdata": "https://newsdata.io/api/1/latest?apikey={key}&qInTitle={query}&language=en&size={most}",
}
#: How a service writes times (the others take none), and services that are asked one query after another.
TIMES = {"gdelt": "%Y%m%d%H%M%S", "newsapi": "%Y-%m-%d"}
ONE_LANE = ("gdelt", "newsdata")


@dataclass
class Lane(InputPartition):
    """Queries that are asked one after another, for articles of a span of seconds."""

    queries: tuple[str, ...]
    since: int
    until: int


class Asker:
    """Asks a lane's queries. An answer that isn't there is a row with an error and no payload, and the next query is asked; a
    refusal (429) ends the lane, whose other queries would be refused too. Errors never hold an address, as it has the key."""

    def __init__(self, options: dict[str, str]):
        own = dict(options)  # names come in lower case
        self.address, self.key, self.most = own["address"], own.get("key", ""), own.get("most", "100")
        self.queries = tuple(json.loads(own["queries"]))
        self.headers = json.loads(own.get("headers", "{}"))
        self.lanes = int(own.get("lanes") or len(self.queries) or 1)
        self.pause, self.timeout = float(own.get("pause", 0)), float(own.get("timeout", 10))
        self.form = own.get("times", "%Y-%m-%dT%H:%M:%SZ")

    def split(self, since: int, until: int) -> list[Lane]:
        dealt = (self.queries[i :: self.lanes] for i in range(self.lanes))
        return [Lane(q, since, until) for q in dealt if q] or [Lane((), since, until)]  # Spark reads a source without parts too

    def ask(self, lane: Lane) -> Iterator[tuple]:
        at = lambda t: datetime.fromtimestamp(t, UTC).strftime(self.form)
        for n, query in enumerate(lane.queries):
            if n:
                time.sleep(self.pause)
            filled = {"query": query, "key": self.key, "most": self.most, "since": at(lane.since), "until": at(lane.until)}
            whole = query if self.address == "{query}" else self.address.format(**{k: urllib.parse.quote(v, safe="") for k, v in filled.items()})
            code, payload, error = self._get(whole)
            yield payload, query, datetime.now(UTC), error
            if code == REFUSED:
                log.warning("refused; %d queries of this lane are left out", len(lane.queries) - n - 1)
                return

    def _get(self, address: str) -> tuple[int | None, str | None, str | None]:
        if urllib.parse.urlsplit(address).scheme not in ("http", "https"):
            return None, None, "not a web address"
        try:
            with urllib.request.urlopen(urllib.request.Request(address, headers=self.headers), timeout=self.timeout) as got:
                return got.status, got.read().decode(got.headers.get_content_charset() or "utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            return e.code, None, f"status {e.code}"
        except (OSError, ValueError, LookupError) as e:  # no connection, no answer in time, or one that can't be read
            return None, None, type(e).__name__


class Payloads(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.asker, self.since, self.until = Asker(options), int(options.get("since", 0)), int(options.get("until") or time.time())

    def partitions(self) -> list[Lane]:
        return self.asker.split(self.since, self.until)

    def read(self, partition: Lane) -> Iterator[tuple]:
        return self.asker.ask(partition)


class PayloadStream(DataSourceStreamReader):
    """Offsets are times: a batch has the span from one to the next, and asks for the same span when it is run again."""

    def __init__(self, options: dict[str, str]):
        self.asker, self.since, self.every = Asker(options), int(options["since"]), int(options.get("every", 900))

    def initialOffset(self) -> dict:
        return {"at": self.since}

    def latestOffset(self) -> dict:
        """The end of the last whole span; `every` seconds bound how often a service is asked."""
        return {"at": self.since + max(0, int(time.time()) - self.since) // self.every * self.every}

    def partitions(self, start: dict, end: dict) -> list[Lane]:
        return self.asker.split(start["at"], end["at"])

    def read(self, partition: Lane) -> Iterator[tuple]:
        return self.asker.ask(partition)


class NewsSource(DataSource):
    """Options: address ("{query}" where queries are addresses), queries (a JSON list), key, most, headers (JSON), lanes (a lane
    a query if absent), pause and timeout (seconds), times (a format), since and until (seconds), every (streams)."""

    @classmethod
    def name(cls) -> str:
        return "ledgerline_news"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Payloads:
        return Payloads(self.options)

    def streamReader(self, schema) -> PayloadStream:
        return PayloadStream(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(NewsSource)


def _options(name: str, queries: list[str], options: dict) -> dict[str, str]:
    own = {"address": ADDRESSES.get(name, "{query}"), "queries": json.dumps(queries)}
    own |= {"times": TIMES[name]} if name in TIMES else {}
    own |= {"lanes": 1} if name in ONE_LANE else {}
    return {k: str(v) for k, v in (own | options).items()}


def fetched(spark: SparkSession, name: str, queries: list[str], **options) -> DataFrame:
    """Payloads of a service, read anew by whatever reads the table: write it, or read it through `parsers.cached`. No queries: no rows."""
    return spark.read.format(NewsSource.name()).options(**_options(name, queries, options)).load()


def stream(spark: SparkSession, name: str, queries: list[str], since: int, **options) -> DataFrame:
    return spark.readStream.format(NewsSource.name()).options(**_options(name, queries, {"since": since} | options)).load()
