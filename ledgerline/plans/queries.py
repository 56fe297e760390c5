"""Registered queries: each operator of the engine over the driver's tables.

Those tables hold no news, so an article view is laid over documents, pages and events, and the word lists are frequent
words of the texts. The operators are the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions.scratch import scratch_dir, written
from ..functions.similarity import cosine_pairs, fuzzy_pairs, label_cosines, tfidf
from ..functions.suffixes import suffix_domain
from ..operators import clustering, dedupe, scoring
from ..operators.brief import appendix, brief_order, confidence_mix, top_categories
from ..operators.cleaning import apply_cleaning, in_timespan, present
from ..schema import align, numbered
from ..sources.parsers import PARSERS, enabled, fan_in, sample_rows
from ..sources.sinks import brief_rows, cells, clusters_flat, evidence, rejected_or_duplicate, search
from ..streaming.articles import windowed_counts
from ..streaming.frequencies import commit, compact, fitted
from .pipeline import counts_by_source, status_counts, visible, with_cluster_ids

#: Word lists and weights for the driver's texts.
DEMO = Config(
    strong=("with", "ver mit"), soft=("from", "raises"), fmcg=("this", "las de"), categories=(("by", "By"), ("was", "Was"), ("das", "Das"), ("les", "Les")),
    watchlist=("for", "pour"), earnings=("are",), launch=("is",), market=("that",), transaction=("as",), off_topic=("src3",), service=("be",), funding_context=("on",),
    targeted=("keyed_news",), keyed_queries=("en", "fr"),
)
DEAL_TYPES = (("merger", ("with", "this")), ("funding", ("from",)), ("stake", ("les", "das")))


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _ts(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names})


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw articles: first line and text, the page's address and the event's time where ids agree."""
    docs, pages, events = (_read(spark, sf, t) for t in ("documents", "pages", "events"))
    last = events.agg(F.max("ts").cast("timestamp").alias("retrieved_at"))
    when = events.select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("published_at"))
    rows = docs.join(pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left").join(when, "doc_id", "left").crossJoin(F.broadcast(last))  # last is one row
    return rows.select(
        F.col("doc_id").cast("string").alias("article_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("snippet"), F.coalesce("url", F.lit("")).alias("url"),
        F.col("source").alias("source_name"), F.lit("").alias("domain"), "published_at", "retrieved_at", F.concat(F.lit("api_"), "lang").alias("source_api"), F.col("lang").alias("query"),
        (F.col("doc_id") % 2 == 0).alias("is_sample"), F.col("doc_id").alias("row_idx"),
    )


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned articles as a written table: passes read them again and again, and each reading would shuffle all documents."""
    return written(apply_cleaning(articles(spark, sf)), "clean")


def page_articles(spark: SparkSession, sf: str) -> DataFrame:
    pages, events = _read(spark, sf, "pages"), _read(spark, sf, "events")
    when = events.select(F.col("event_id").alias("page_id"), F.col("ts").cast("timestamp").alias("published_at"))
    return pages.join(when, "page_id", "left").select(
        F.col("page_id").cast("string").alias("article_id"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("snippet"), "url",
        F.lit("page").alias("source_name"), F.lit("").alias("domain"), "published_at", F.lit(None).cast("timestamp").alias("retrieved_at"), F.lit("pages").alias("source_api"),
        F.lit("").alias("query"), F.lit(False).alias("is_sample"), F.col("page_id").alias("row_idx"),
    )


def deal_events(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: articles cleaned, flagged, scored and grouped into events."""
    done = scoring.score_articles(dedupe.dedupe(cleaned(spark, sf), DEMO), DEMO)
    _, records = clustering.cluster_deals(done, DEMO)
    return brief_order(records).withColumn("sources", F.size("sources"))


def url_canonical(spark, sf):
    return _read(spark, sf, "pages").select("page_id", T.canonical_url("url").alias("canonical_url"))


def url_domain(spark, sf):
    return _read(spark, sf, "pages").select("page_id", T.registered_domain("url").alias("domain"))


#: A small table of suffixes with each kind of rule, for the pages' hosts.
SUFFIXES = ("com", "org", "net", "io", "example", "*.example", "!www.example", "co.uk", "*.test", "!first.test", "example.com", "example.org")


def url_suffix_domain(spark, sf):
    """The pages' hosts, and hosts that each kind of rule is about, under a table of suffixes."""
    of = suffix_domain(spark, SUFFIXES)
    page = F.col("page_id").cast("string")
    kinds = {"url": F.col("url"), "deep": F.concat(F.lit("http://a.p"), page, F.lit(".co.uk/x")), "any": F.concat(F.lit("b.c.z"), page, F.lit(".test")), "first": F.lit("x.first.test")}
    return _read(spark, sf, "pages").select("page_id", *(of(c).alias(k) for k, c in kinds.items()))


def kept_up_frequencies(spark, sf):
    """Document frequencies after signed batches: documents arrive by language, latest first, and those of one source go again."""
    docs, folder = _read(spark, sf, "documents"), f"{scratch_dir(spark)}/frequencies-{uuid.uuid4().hex}"
    arrive = docs.select("text", F.lit(1).alias("sign"), "lang")
    langs = [r[0] for r in docs.select("lang").distinct().orderBy(F.desc("lang")).collect()]
    for n, lang in enumerate(langs):
        commit(arrive.where(F.col("lang").eqNullSafe(lang)), folder, len(langs) - n)
    compact(spark, folder, len(langs))
    commit(docs.where("source = 'src3'").select("text", F.lit(-1).alias("sign")), folder, len(langs) + 1)
    found, n = fitted(spark, folder)
    return found.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))  # n is one row


def title_normalize(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.normalized_title(F.substring_index("text", "\n", 1)).alias("normalized_title"))


def title_display(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.display_title(F.concat("text", F.lit(" | "), "source")).alias("display_title"))


def snippet_clean(spark, sf):
    return _read(spark, sf, "pages").select("page_id", T.clean_snippet("html").alias("snippet"))


def accent_fold(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.md5(T.accent_fold("text")).alias("folded_md5"))


def word_counts(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.word_count("text").alias("n_words"))


def lookback_filter(spark, sf):
    e = _read(spark, sf, "events").withColumn("published_at", F.col("ts").cast("timestamp"))
    return in_timespan(e, "7d", e.agg(F.max("published_at")).first()[0]).select("event_id", "event_type")


def present_rows(spark, sf):
    """Articles with a title and an address; every third title and fourth address is blank."""
    n = F.col("row_idx")
    blank = {"title": F.when(n % 3 == 0, "  ").otherwise(F.col("title")), "url": F.when(n % 4 == 0, None).otherwise(F.concat(F.lit("https://e.com/"), n))}
    return present(articles(spark, sf).withColumns(blank)).select("article_id")


def _landed(spark, sf, payload: Column) -> DataFrame:
    """Documents as landed responses, one for each; `at` is the event's time to the second."""
    events = _read(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    rows = _read(spark, sf, "documents").join(events, "doc_id", "left").withColumns({"title": F.substring_index("text", "\n", 1), "address": F.concat(F.lit("https://e.com/"), "doc_id")})
    return rows.select("doc_id", payload.alias("payload"), F.lit("general_fmcg").alias("query"), F.lit(None).cast("timestamp").alias("retrieved_at"))


def json_sources(spark, sf):
    """Each JSON source's parser over all documents in that source's form."""
    at = lambda form: F.date_format("at", form)
    c, iso, name = F.col, "yyyy-MM-dd'T'HH:mm:ssXXX", F.struct(F.col("source").alias("name"))
    item = {
        "gdelt": ("articles", F.struct("title", c("address").alias("url"), c("source").alias("domain"), at("yyyyMMdd'T'HHmmss'Z'").alias("seendate"))),
        "alpha_vantage": ("feed", F.struct("title", c("text").alias("summary"), c("address").alias("url"), "source", at("yyyyMMdd'T'HHmmss").alias("time_published"))),
        "marketaux": ("data", F.struct("title", F.lit("").alias("description"), c("text").alias("snippet"), c("address").alias("url"), name.alias("source"), at(iso).alias("published_at"))),
        "newsdata": ("results", F.struct("title", c("text").alias("content"), c("address").alias("link"), c("source").alias("source_id"), at("yyyy-MM-dd HH:mm:ss").alias("pubDate"))),
        "newsapi": ("articles", F.struct("title", c("text").alias("description"), c("address").alias("url"), name.alias("source"), at(iso).alias("publishedAt"))),
    }
    parts = []
    for source, (field, made) in item.items():
        payload = F.to_json(F.struct(F.when(c("doc_id") % 7 == 0, "error").otherwise("success").alias("status"), F.array(made).alias(field)))
        parts.append(PARSERS[source](_landed(spark, sf, payload)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("source_api", "url", F.md5("title").alias("title_md5"), F.md5("snippet").alias("snippet_md5"), "source_name", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


def rss_sources(spark, sf):
    """Both feeds' parsers over responses of 60 entries each: a document an entry, its language in markup."""
    d, shown = F.col("doc_id").cast("string"), F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    entry = F.concat(
        F.lit("<item><title>Deal "), d, F.lit(" &amp; more</title><link>https://e.com/"), d, F.lit("</link><description>&lt;b&gt;"), "lang", F.lit("&lt;/b&gt; note</description>"),
        F.coalesce(F.concat(F.lit("<pubDate>"), shown, F.lit("</pubDate>")), F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<source url='https://p.com'>"), "source", F.lit("</source>"))).otherwise(""), F.lit("</item>"),
    )
    entries = F.expr("array_join(transform(array_sort(collect_list(struct(doc_id, payload))), x -> x.payload), '')")
    feeds = _landed(spark, sf, entry).groupBy(F.floor(F.col("doc_id") / 60).alias("page"), "query", "retrieved_at").agg(F.concat(F.lit('<rss version="2.0"><channel>'), entries, F.lit("</channel></rss>")).alias("payload"))
    out = PARSERS["google_news_rss"](feeds).unionByName(PARSERS["pr_wire_rss"](feeds))
    return out.select("source_api", "query", "title", "url", "snippet", "source_name", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


def sample_dates(spark, sf):
    """Orders as example articles: published some days and hours before a fixed time."""
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_idx"), (F.col("o_orderkey") % 30).cast("int").alias("days_ago"), F.lit("t").alias("title"), F.lit("u").alias("url"))
    return sample_rows(o, datetime(2024, 6, 12)).select("row_idx", "article_id", "is_sample", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


def preferred_rows(spark, sf):
    """The row of each source that duplicates would be dropped for: tier of the domain, length, date, order."""
    n = F.col("row_idx")
    a = articles(spark, sf).withColumn("domain", F.when(n % 7 == 0, "bbc.com").when(n % 7 == 1, "FoodDive.com").when(n % 7 == 2, "businesswire.com").otherwise("e.com"))
    return a.groupBy("source_name").agg(F.min_by("article_id", dedupe.preference()).alias("article_id"))


def shown_clusters(spark, sf):
    """Events past the thresholds, and the cluster numbers that articles keep: those of events that are shown."""
    done = scoring.score_articles(dedupe.fresh(apply_cleaning(articles(spark, sf))), DEMO)
    ids = done.select("row_idx", F.format_string("C%03d", F.floor(F.col("row_idx") / 3)).alias("cluster_id"))
    score = lambda k: F.col("doc_id") * k % 101
    events = _read(spark, sf, "documents").select(F.format_string("C%03d", "doc_id").alias("cluster_id"), score(7).alias("relevance_score"), score(11).alias("credibility_score"), score(13).alias("max_article_credibility"))
    return with_cluster_ids(done, ids, visible(events, 40, 50)).select("article_id", "cluster_id")


def seed_groups(spark, sf):
    """Events as articles that join the first near seed: newest first, companies by type, pairs within ten minutes."""
    e = _read(spark, sf, "events").select(F.col("event_id").alias("row_idx"), F.array(F.col("event_type")).alias("keys"), F.col("ts").cast("timestamp").alias("published_at"))
    rows = e.join(dedupe.ranked(e, clustering.newest_first()), "row_idx")
    pairs = interval_pairs(spark, sf).withColumn("cos", ((F.col("i") * 7 + F.col("j") * 13) % 100 / 100.0).cast("double"))
    return clustering.seed_clusters(rows, pairs).select("row_idx", "seed")


def company_groups(spark, sf):
    """Orders as seeds whose companies are a customer and three customers' owner: what either connects is one group."""
    o = _read(spark, sf, "orders")
    keys = F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("k"), F.floor(F.col("o_custkey") / 3)))
    return clustering.connected(o.select(F.col("o_orderkey").alias("seed"), keys.alias("keys")))


def event_records(spark, sf):
    """One record for each customer, whose orders stand for articles: best row first, union of companies, counts, dates."""
    n = F.col("o_orderkey")
    members = _read(spark, sf, "orders").select(
        F.col("o_custkey").alias("cluster"), n.alias("ord"), F.concat(F.lit("t"), n).alias("title"), F.lit("acquires").alias("snippet"), F.concat(F.lit("http://x/"), n).alias("url"),
        F.concat(F.lit("d"), n % 4, F.lit(".com")).alias("domain"), F.lit("").alias("source_name"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.concat(F.lit("tier_"), n % 4 + 1).alias("credibility_tier"),
        (n % 61 + 35).cast("int").alias("credibility_score"), (n * 7 % 101).cast("int").alias("relevance_score"), F.array(F.concat(F.lit("Maker"), n % 7), F.concat(F.lit("Trader"), n % 5)).alias("companies"),
        F.lit("x").alias("source_api"), (n % 3 > 0).alias("is_sample"),
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return clustering.cluster_records(members).select(
        "cluster", F.col("cluster_id"), "canonical_headline", "deal_type", "relevance_score", "max_article_credibility", "credibility_score", "confidence", "article_count", "source_count", "is_sample", "why_it_matters",
        F.array_join("companies", "|").alias("companies"), F.expr("array_join(transform(sources, s -> s.title), '|')").alias("titles"), day("earliest_published_at").alias("earliest"), day("latest_published_at").alias("latest"),
    )


def _brief_records(spark, sf):
    n = F.col("c_custkey")
    return _read(spark, sf, "customer").select(
        F.format_string("C%06d", n).alias("cluster_id"), F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), (n % 3 + 1).cast("int")).alias("confidence"), (n % 11).alias("relevance_score"), (n % 7).alias("credibility_score"),
        F.when(n % 5 > 0, F.timestamp_seconds(n % 13)).alias("latest_published_at"), F.array(F.struct(F.concat(F.lit("t"), n).alias("title"), F.concat(F.lit("u"), n % 50).alias("url"), F.col("c_mktsegment").alias("source_name"), F.lit("").alias("domain"))).alias("sources"),
        F.concat(F.lit("h"), n).alias("canonical_headline"), F.lit("stake").alias("deal_type"), F.array(F.lit("A")).alias("companies"), F.lit("UK").alias("geography"), F.lit("Other").alias("category"),
        F.lit("undisclosed").alias("deal_value"), F.lit(1).alias("source_count"), F.lit("why").alias("why_it_matters"),
    )


def brief_ranks(spark, sf):
    return brief_order(_brief_records(spark, sf)).select("cluster_id", "brief_rank")


def brief_appendix(spark, sf):
    """Addresses in the brief's order, each once."""
    return appendix(brief_order(_brief_records(spark, sf))).select("url", "cluster_id", "label", "title")


def brief_tables(spark, sf):
    """Highlights and watchlist as rows of their sheets."""
    r = _brief_records(spark, sf)
    return brief_rows(r, False).withColumn("watch", F.lit(False)).unionByName(brief_rows(r, True).withColumn("watch", F.lit(True))).select("cluster_id", "canonical_headline", "companies", "confidence", "watch")


def dedupe_exact_url(spark, sf):
    out = dedupe.exact_url(dedupe.fresh(apply_cleaning(page_articles(spark, sf))))
    return out.select("article_id", "dedupe_status", "dedupe_reason", "duplicate_of")


def dedupe_exact_title(spark, sf):
    out = dedupe.exact_title(dedupe.fresh(apply_cleaning(articles(spark, sf))))
    return out.select("article_id", "dedupe_status", "dedupe_reason", "duplicate_of")


def dedupe_repeated(spark, sf):
    """Articles that three queries return, without ids: one row of each address stays canonical."""
    once = page_articles(spark, sf).withColumns({"article_id": F.lit(None).cast("string"), "row_idx": F.lit(None).cast("long")})
    rows = once.withColumn("query", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("b"))))
    out = dedupe.exact_url(dedupe.fresh(apply_cleaning(numbered(align(rows)))))
    live = F.col("dedupe_status") == "canonical"
    by = out.groupBy("canonical_url").agg(F.count("*").alias("n"), F.count_if(live).alias("n_canonical"), F.count_distinct("article_id").alias("n_ids"))
    return by.where("canonical_url != ''")


def dedupe_fuzzy_title(spark, sf):
    out = dedupe.fuzzy_title(dedupe.fresh(cleaned(spark, sf)))
    return out.select("article_id", "dedupe_status", "dedupe_reason", "duplicate_of")


def dedupe_similar_text(spark, sf):
    out = dedupe.similar_text(dedupe.fresh(cleaned(spark, sf)))
    return out.select("article_id", "dedupe_status", "dedupe_reason", "duplicate_of")


def dedupe_all(spark, sf):
    out = dedupe.dedupe(cleaned(spark, sf))
    return out.select("article_id", "dedupe_status", "dedupe_reason", "duplicate_of")


def fuzzy_title_pairs(spark, sf):
    return fuzzy_pairs(apply_cleaning(articles(spark, sf)), 90.0, 14)


def relevance(spark, sf):
    a = articles(spark, sf)
    priced = F.when(F.col("row_idx") % 5 == 0, F.concat("title", F.lit(" at $"), "row_idx", F.lit(" million"))).otherwise(F.col("title"))
    out = scoring.score_relevance(a.withColumn("title", priced), DEMO)
    return out.select("article_id", "relevance_score", F.array_join("relevance_reasons", ",").alias("reasons"), "status")


def credibility(spark, sf):
    a = articles(spark, sf)
    named = {"src0": "Reuters", "src1": "  food dive ", "src2": "GlobeNewswire"}
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in named.items() for x in kv)), F.col("source_name")), "source_name")
    dom = F.when(F.col("row_idx") % 7 == 0, "bbc.com").when(F.col("row_idx") % 7 == 1, "businesswire.com").otherwise("")
    out = scoring.score_credibility(a.withColumns({"source_name": name, "domain": dom}))
    return out.select("article_id", "credibility_score", "credibility_tier", F.array_join("credibility_reasons", ",").alias("reasons"))


def group_credibility(spark, sf):
    """Orders of a customer as articles of an event: prices for scores, clerks' days for sources."""
    o = _read(spark, sf, "orders")
    g = o.groupBy("o_custkey").agg(
        F.collect_list((F.col("o_orderkey") % 61 + 35).cast("double")).alias("s"), F.collect_list(F.concat(F.lit("k"), F.col("o_orderkey") % 4)).alias("k"), F.collect_list(F.concat(F.lit("tier_"), F.col("o_orderkey") % 4 + 1)).alias("t")
    )
    return g.select("o_custkey", scoring.cluster_credibility(F.col("s"), F.col("k"), F.col("t")).alias("credibility"))


def confidence_labels(spark, sf):
    o = _read(spark, sf, "orders")
    n = F.col("o_orderkey")
    return o.select("o_orderkey", scoring.confidence(n % 101, n * 7 % 101, n % 3 + 1, n % 5 == 0).alias("confidence"))


def detect_deal_type(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.deal_type(F.lower("text"), DEAL_TYPES).alias("deal_type"))


def detect_category(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.category(F.lower("text"), DEMO.categories).alias("category"))


def detect_geography(spark, sf):
    place = F.element_at(F.array(*(F.lit(x) for x in ("in the US.", "the U.S. said", "us only", "Latin America", "South Korea and EU", "nowhere"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return _read(spark, sf, "orders").select("o_orderkey", T.geography(place).alias("geography"))


def extract_value(spark, sf):
    n = F.col("o_orderkey")
    one = F.element_at(F.array(F.concat(F.lit("worth $"), n, F.lit(" million today")), F.concat(F.lit("about "), n, F.lit(" crore")), F.concat(F.lit("USD "), n, F.lit(" paid")), F.lit("no figure")), (n % 4 + 1).cast("int"))
    return _read(spark, sf, "orders").select("o_orderkey", T.deal_value(F.array(F.lit("first text"), one)).alias("deal_value"))


def extract_companies(spark, sf):
    names = T.companies(F.concat(F.lit("Unilever and "), F.initcap(F.substring_index("p_name", " ", 2)), F.lit(" Says New Deal - Wire")), "p_name")
    return _read(spark, sf, "part").select("p_partkey", F.array_join(names, "|").alias("companies"))


def best_turn(spark, sf):
    """The best row of a group, ties by order: the longest turn of each conversation."""
    c = _read(spark, sf, "conversations")
    best = c.groupBy("conv_id").agg(F.min(F.struct((-F.length("text")).alias("a"), F.col("turn").alias("t"), F.col("role").alias("r"))).alias("b"))
    return best.select("conv_id", F.col("b.t").alias("turn"), F.col("b.r").alias("role"))


def ordered_roles(spark, sf):
    c = _read(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(turn, role))), x -> x.role)"), ",").alias("roles"))


def source_counts(spark, sf):
    return _read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.bool_and(F.col("n_chars") > 10).alias("all_long"))


def top_three(spark, sf):
    d = _read(spark, sf, "documents").select(F.col("source").alias("category"), F.format_string("C%09d", "doc_id").alias("cluster_id"))
    return top_categories(d).select("category", "n")


def latest_span(spark, sf):
    e = _read(spark, sf, "events")
    return e.groupBy("user_id").agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count("*").alias("n"))


def embedding_cosines(spark, sf):
    """Cosines of at least 0.3 among vectors of one label, block by block."""
    return label_cosines(_read(spark, sf, "embeddings"), 0.3).select("i", "j", F.round("cos", 6).alias("cosine"))


def interval_pairs(spark, sf):
    """Events of one user within ten minutes of each other, met in buckets of that width."""
    e = _read(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).withColumn("b", F.floor(F.col("t") / 600_000_000))
    left = e.withColumn("b", F.explode(F.array("b", F.col("b") + 1))).alias("x")
    right = e.alias("y")
    met = left.join(right, (F.col("x.user_id") == F.col("y.user_id")) & (F.col("x.b") == F.col("y.b")) & (F.abs(F.col("x.t") - F.col("y.t")) <= 600_000_000))
    return met.where("x.event_id != y.event_id").select(F.least("x.event_id", "y.event_id").alias("i"), F.greatest("x.event_id", "y.event_id").alias("j")).distinct()


def text_pairs(spark, sf):
    rows = _read(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    return cosine_pairs(tfidf(rows, DEMO.stop_words), 0.82).select("i", "j", F.round("cos", 6).alias("cosine"))


def _events_of_orders(spark, sf):
    o = _read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    src = F.struct(F.concat(F.lit("t"), "o_orderkey").alias("title"), F.concat(F.lit("http://x/"), "o_orderkey").alias("url"), F.col("o_orderpriority").alias("source_name"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(src)).alias("sources"))
    return g.select(
        F.format_string("C%06d", "o_custkey").alias("cluster_id"), F.concat(F.lit("h"), "o_custkey").alias("canonical_headline"),
        F.when(F.col("o_custkey") % 3 > 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("companies"), "sources",
    )


def evidence_rows(spark, sf):
    return evidence(_events_of_orders(spark, sf))


def flat_events(spark, sf):
    return clusters_flat(_events_of_orders(spark, sf))


def sheet_cells(spark, sf):
    rows = _read(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("tags"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("maybe"))
    return cells(rows, ["doc_id", "tags", "maybe", "absent"])


def rejected_rows(spark, sf):
    out = dedupe.exact_title(dedupe.fresh(apply_cleaning(articles(spark, sf))))
    scored = scoring.score_relevance(out, DEMO).select("article_id", "status", "dedupe_status")
    return rejected_or_duplicate(written(scored, "scored"))  # as a condition, the score would be worked out twice, term by term


def table_search(spark, sf):
    return search(_read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "BUILD").select("c_custkey")


def counts_by_window(spark, sf):
    e = _read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("published_at"), F.col("event_type").alias("source_api"))
    return windowed_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "source_api", "n")


def source_rows(spark, sf):
    """Articles by connector, as a run reports them."""
    return counts_by_source(articles(spark, sf))


def run_counts(spark, sf):
    """All, duplicate and included rows of scored articles."""
    return status_counts(scoring.score_relevance(dedupe.exact_title(dedupe.fresh(apply_cleaning(articles(spark, sf)))), DEMO))


def event_candidates(spark, sf):
    """Orders as scored articles: which of them may become events at given thresholds."""
    n = F.col("o_orderkey")
    status = F.element_at(F.array(F.lit("include"), F.lit("watchlist"), F.lit("reject")), (n % 3 + 1).cast("int"))
    rows = _read(spark, sf, "orders").select(
        n, F.when(n % 5 == 0, "duplicate").otherwise("canonical").alias("dedupe_status"), status.alias("status"), (n % 101).cast("int").alias("relevance_score"), (n * 7 % 101).cast("int").alias("credibility_score")
    )
    return clustering.candidates(rows, 55, 50).select("o_orderkey")


def confidence_levels(spark, sf):
    return confidence_mix(_brief_records(spark, sf)).select("confidence", "n", "seen")


def gathered_articles(spark, sf):
    """A run's connectors, one of which can't be read: what the others have of the last thirty days, in one table."""
    c, at = F.col, lambda form: F.date_format("at", form)
    wire = F.concat(F.lit("<rss version='2.0'><channel><item><title>Deal "), c("doc_id").cast("string"), F.lit("</title><link>"), c("address"), F.lit("</link>"), F.coalesce(F.concat(F.lit("<pubDate>"), at("EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate>")), F.lit("")), F.lit("</item></channel></rss>"))
    made = {
        "newsapi": F.to_json(F.struct(F.array(F.struct("title", c("text").alias("description"), c("address").alias("url"), at("yyyy-MM-dd'T'HH:mm:ssXXX").alias("publishedAt"))).alias("articles"))),
        "gdelt": F.to_json(F.struct(F.array(F.struct("title", c("address").alias("url"), at("yyyyMMdd'T'HHmmss'Z'").alias("seendate"))).alias("articles"))),
        "pr_wire_rss": wire,
    }
    now = _read(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    names = enabled({"newsapi": "key"}, gdelt=True)
    landed = {n: (lambda n=n: _landed(spark, sf, made[n])) for n in names}  # google_news_rss has nothing landed and fails by itself
    return fan_in(spark, landed, "30d", now).select("source_api", "url")


def merged_groups(spark, sf):
    """Customers as groups of one article: neighbours are similar, four in a row share a company. Contracted in rounds."""
    n = F.col("c_custkey")
    rows = _read(spark, sf, "customer")
    members = rows.select(n.alias("row_idx"), n.alias("rank"), n.alias("seed"), F.array(F.concat(F.lit("k"), F.floor(n / 4))).alias("keys"), F.timestamp_seconds(n % 4 * 86_400).alias("published_at"))
    pairs = rows.select(n.alias("i"), (n + 1).alias("j"), F.lit(0.3).alias("cos"))
    return clustering.merge_clusters(members, pairs, most_rows=0).select(F.col("row_idx").alias("c_custkey"), "cluster", "ord")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (
        deal_events, dedupe_repeated, url_canonical, url_domain, title_normalize, title_display, snippet_clean, accent_fold, word_counts, lookback_filter, dedupe_exact_url, dedupe_exact_title,
        dedupe_fuzzy_title, dedupe_similar_text, dedupe_all, fuzzy_title_pairs, relevance, credibility, group_credibility, confidence_labels, detect_deal_type, detect_category,
        detect_geography, extract_value, extract_companies, best_turn, ordered_roles, source_counts, top_three, latest_span, embedding_cosines, interval_pairs, text_pairs,
        evidence_rows, flat_events, sheet_cells, rejected_rows, table_search, counts_by_window,
        present_rows, json_sources, rss_sources, sample_dates, preferred_rows, shown_clusters, seed_groups, company_groups, event_records, brief_ranks, brief_appendix, brief_tables,
        source_rows, run_counts, event_candidates, confidence_levels, gathered_articles, merged_groups,
        url_suffix_domain, kept_up_frequencies,
    )
    return {f.__name__: f for f in fs}
