"""The whole run over the example articles, against expected values worked out by hand from the rules."""

from datetime import timedelta

import pytest
from sample import NOW, write_csv

from ledgerline.plans.pipeline import run
from ledgerline.schema import empty_articles
from ledgerline.sources.parsers import load_sample

SCORES = [75, 90, 90, 80, 80, 90, 75, 75, 80, 0, 0, 70, 35, 75]
REASONS = {1: ["strong_deal_term", "fmcg_term", "recent_7d", "deal_value_visible"], 10: ["recent_30d", "earnings_noise", "market_noise", "no_deal_term"]}
REASONS[11] = ["category_term", "recent_30d", "source_query_context", "launch_noise", "service_noise", "no_deal_term"]
DUPLICATES = {1: (14, "fuzzy_title_90"), 8: (14, "exact_title_14d"), 9: (4, "exact_title_14d")}


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    sample = load_sample(spark, write_csv(tmp_path_factory.mktemp("sample") / "sample.csv"), NOW)
    return run(spark, lambda span: empty_articles(spark), NOW, sample=sample)


def test_scores_and_duplicates(result):
    rows = {int(r["article_id"][-3:]): r for r in result.processed.collect()}
    assert [rows[i]["relevance_score"] for i in range(1, 15)] == SCORES
    assert {i: rows[i]["relevance_reasons"] for i in REASONS} == REASONS
    assert all(r["credibility_score"] == 50 and r["credibility_reasons"] == ["tier_4_base_45", "metadata_complete"] for r in rows.values())
    found = {i: (int(r["duplicate_of"][-3:]), r["dedupe_reason"]) for i, r in rows.items() if r["dedupe_status"] == "duplicate"}
    assert found == DUPLICATES


def test_events(result):
    events = {r["cluster_id"]: r for r in result.events.collect()}
    assert sorted(events) == ["C001", "C002", "C003", "C004"]
    about = {k: (e["deal_type"], e["category"], e["deal_value"], e["companies"], e["relevance_score"], e["credibility_score"], e["confidence"], e["source_count"]) for k, e in events.items()}
    assert about == {
        "C001": ("acquisition", "Snacks & Packaged Foods", "$120 million", ["Sample Snacks Co", "Example Foods"], 90, 58, "Medium", 4),
        "C002": ("joint venture", "Food & Beverage", "$50 million", ["Sample Beverage Co", "Demo Dairy"], 90, 42, "Low", 1),
        "C003": ("funding", "Beauty & Personal Care", "$40M", ["Demo Beauty Brands", "Example Capital"], 80, 52, "Low", 2),
        "C004": ("divestment", "Dairy", "undisclosed", ["Example Foods"], 70, 42, "Low", 1),
    }
    assert {e["geography"] for e in events.values()} == {"Not specified"}
    assert {e["max_article_credibility"] for e in events.values()} == {50}
    members = {}
    for r in result.processed.where("cluster_id != ''").collect():
        members.setdefault(r["cluster_id"], set()).add(int(r["article_id"][-3:]))
    assert members == {"C001": {7, 2, 14, 3}, "C002": {6}, "C003": {4, 5}, "C004": {12}}


def test_brief_and_metadata(result):
    order = [e["cluster_id"] for e in result.brief["highlights"] + result.brief["watchlist"]]
    assert order == ["C001", "C002", "C003", "C004"]
    assert "\\$120 million" in result.markdown and "$120 million" not in result.markdown.replace("\\$120 million", "")
    assert "No cited URLs." in result.markdown and "SAMPLE DATA" in result.markdown
    m = result.metadata
    assert (m["used_sample"], m["processed_rows"], m["duplicate_count"], m["cluster_count"], m["highlight_count"]) == (True, 14, 3, 4, 1)
    assert m["source_warning"] == "No live source rows matched the selected date range."


def test_a_failing_source_is_reported(spark):
    def broken(span):
        raise OSError("no network")

    out = run(spark, broken, NOW + timedelta(days=1))
    assert "no network" in out.metadata["fetch_warning"] and out.metadata["cluster_count"] == 0
    assert "No deal clusters identified" in out.markdown


def test_a_source_that_fails_while_it_is_read(spark):
    from pyspark.sql import functions as F

    from ledgerline.schema import ARTICLE

    def late(span):
        broken = spark.range(3).select(F.raise_error(F.lit("connection reset")).cast("string").alias("title"), F.lit(NOW).alias("published_at"))
        return empty_articles(spark).unionByName(broken, allowMissingColumns=True)

    out = run(spark, late, NOW)
    assert "connection reset" in out.metadata["fetch_warning"] and out.metadata["raw_rows"] == 0 and set(out.processed.columns) >= set(ARTICLE)


def test_raw_articles_have_the_ids_of_the_processed(result):
    assert sorted(r["article_id"] for r in result.raw.collect()) == sorted(r["article_id"] for r in result.processed.collect())
