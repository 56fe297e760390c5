"""Relevance and credibility of articles, and credibility and confidence of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import REDIRECTORS, VALUE_SHOWN, Config
from ..functions.text import has_any

_DAY = 86_400_000_000


def query_family(query: Column, config: Config | None = None) -> Column:
    pairs = (config or Config()).family_of().items()
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in pairs for x in kv)), F.coalesce(query, F.lit(""))), F.lit(""))


def value_shown(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in VALUE_SHOWN])


def score_relevance(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Add relevance_score (0 to 100), relevance_reasons (in the order of the rules) and status. One pass, no shuffle."""
    c = config or Config()
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    flags = {
        "value": value_shown(text),
        "strong": has_any(text, c.strong),
        "soft_other": has_any(text, [t for t in c.soft if t != "raises"]),
        "raises": has_any(text, [t for t in c.soft if t == "raises"]) if "raises" in c.soft else F.lit(False),
        "funding": has_any(text, c.funding_context),
        "fmcg": has_any(text, c.fmcg),
        "category": has_any(text, [t for t, _ in c.categories]),
        "watch": has_any(text, c.watchlist),
        "earnings": has_any(text, c.earnings),
        "launch": has_any(text, c.launch),
        "market": has_any(text, c.market),
        "transaction": has_any(text, c.transaction),
        "off_topic": has_any("source_name", c.off_topic),
        "service": has_any(text, c.service),
        "family": query_family(F.col("query"), c),
        "age": F.unix_micros("retrieved_at") - F.unix_micros("published_at"),
    }
    f = {k: F.col(f"_f.{k}") for k in flags}
    soft = f["soft_other"] | (f["raises"] & (f["funding"] | f["value"]))
    topical = f["fmcg"] | f["category"] | f["watch"]
    rules = [
        ("strong_deal_term", c.strong_points, f["strong"]),
        ("soft_deal_term", c.soft_points, soft & ~f["strong"]),
        ("fmcg_term", c.fmcg_points, f["fmcg"]),
        ("category_term", c.category_points, f["category"] & ~f["fmcg"]),
        ("watchlist_company", c.watchlist_points, f["watch"]),
        ("recent_7d", c.week_points, F.coalesce(f["age"] <= 7 * _DAY, F.lit(False))),
        ("recent_30d", c.month_points, F.coalesce((f["age"] > 7 * _DAY) & (f["age"] <= 30 * _DAY), F.lit(False))),
        ("deal_value_visible", c.value_points, f["value"]),
        ("source_query_context", c.context_points, f["family"].isin(*c.targeted) & topical),
        ("earnings_noise", c.earnings_points, f["earnings"] & ~f["strong"]),
        ("launch_noise", c.launch_points, f["launch"] & ~f["strong"] & ~soft),
        ("market_noise", c.market_points, f["market"] & ~f["transaction"]),
        ("off_topic_source", c.off_topic_points, f["off_topic"]),
        ("service_noise", c.service_points, f["service"]),
    ]
    none = ~f["strong"] & ~soft
    total = reduce(lambda a, b: a + b, [F.when(when, F.lit(points)).otherwise(0) for _, points, when in rules])
    total = F.when(none, F.least(total, F.lit(c.no_deal_cap))).otherwise(total)
    reasons = F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, _, when in rules), F.when(none, F.lit("no_deal_term"))))
    out = df.withColumn("_f", F.struct(*(v.alias(k) for k, v in flags.items())))
    out = out.withColumn("relevance_score", F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("int")).withColumn("relevance_reasons", reasons).drop("_f")
    return out.withColumn("status", status("relevance_score", c))


def status(score: str, config: Config | None = None) -> Column:
    c = config or Config()
    return F.when(F.col(score) >= c.include_at, "include").when(F.col(score) >= c.watch_at, "watchlist").otherwise("reject")


def _lookup(pairs: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _tier_of(column: Column, kind: int, config: Config | None) -> Column:
    """Tier by the listed domains (0) or names (1), which are a constant of the plan; null for unlisted ones."""
    tiers = (config or Config()).tiers
    table = {x.lower(): t for t in sorted(tiers, reverse=True) for x in tiers[t][kind]}
    return F.element_at(_lookup(table), F.lower(F.coalesce(column, F.lit("")))) if table else F.lit(None).cast("int")


def domain_tier(domain: Column, config: Config | None = None) -> Column:
    """Tier by domain alone, 4 for unlisted ones."""
    return F.coalesce(_tier_of(domain, 0, config), F.lit(4))


def tier(domain: Column, name: Column, config: Config | None = None) -> Column:
    """Tier by domain, else by publisher's name, else 4."""
    return F.coalesce(_tier_of(domain, 0, config), _tier_of(F.trim(name), 1, config), F.lit(4))


def score_credibility(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Add credibility_score, credibility_tier and credibility_reasons."""
    c = config or Config()
    points = F.element_at(_lookup({str(k): v for k, v in c.tier_points}), F.col("_tier").cast("string"))
    dated, named = F.col("published_at").isNotNull(), F.coalesce("source_name", F.lit("")) != ""
    total = points + F.when(dated & named, c.complete_points).when(~dated, c.undated_points).otherwise(0)
    reasons = F.array_compact(
        F.array(F.format_string("tier_%d_base_%d", F.col("_tier"), points), F.when(dated & named, F.lit("metadata_complete")), F.when(~dated, F.lit("no_published_date")))
    )
    out = df.withColumn("_tier", tier(F.col("domain"), F.col("source_name"), c))
    out = out.withColumn("credibility_score", F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("int")).withColumn("credibility_reasons", reasons)
    return out.withColumn("credibility_tier", F.format_string("tier_%d", F.col("_tier"))).drop("_tier")


def score_articles(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Both scores, for every row, duplicates and rejects too."""
    return score_credibility(score_relevance(df, config), config)


def source_key(domain: str = "domain", name: str = "source_name", api: str = "source_api") -> Column:
    """What tells independent sources apart: the publisher's name where the domain is a redirector's, else the domain."""
    d, n = F.lower(F.trim(F.coalesce(domain, F.lit("")))), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    blank = lambda x: F.when(x != "", x)
    return F.when((F.col(api) == "google_news_rss") | d.isin(*REDIRECTORS), F.coalesce(blank(n), blank(d), F.lit(""))).otherwise(F.coalesce(blank(d), blank(n), F.lit("")))


def cluster_credibility(scores: Column, sources: Column, tiers: Column, config: Config | None = None) -> Column:
    """Credibility of a group from arrays of its members' scores, source keys and tiers; rounded half to even."""
    c = config or Config()
    top = F.slice(F.sort_array(scores, asc=False), 1, 3)
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    n = F.size(F.array_distinct(F.filter(sources, lambda s: s.isNotNull() & (s != ""))))
    extra = F.when(n >= 3, c.three_sources).when(n >= 2, c.two_sources).otherwise(0)
    mix = F.when(F.array_contains(tiers, "tier_1") & F.array_contains(tiers, "tier_3"), c.official_mix).otherwise(0)
    total = F.lit(c.top_share) * F.array_max(scores) + F.lit(c.three_share) * mean + extra + mix
    return F.when(F.size(scores) == 0, F.lit(0)).otherwise(F.least(F.lit(100), F.bround(total, 0).cast("int")))


def confidence(relevance: Column, credibility: Column, sources: Column, official: Column, config: Config | None = None) -> Column:
    c = config or Config()
    high = (relevance >= c.high[0]) & (credibility >= c.high[1]) & ((sources >= 2) | official)
    return F.when(high, "High").when((relevance >= c.medium[0]) & (credibility >= c.medium[1]), "Medium").otherwise("Low")
