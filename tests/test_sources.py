import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.config import search_query
from ledgerline.sources import parsers as P

NOW = datetime(2024, 6, 12)
RSS = """<rss version="2.0"><channel><item><title>X acquires Y</title><link>https://n.com/1</link><description>&lt;b&gt;Deal&lt;/b&gt; done</description>
<pubDate>Mon, 10 Jun 2024 10:11:12 GMT</pubDate><source url="https://p.com">Publisher</source></item>
<item><title>Second</title><link>https://n.com/2</link><pubDate>bad date</pubDate></item></channel></rss>"""
PAYLOADS = {
    "gdelt": {"articles": [{"title": "T", "url": "https://a.com/1", "domain": "a.com", "seendate": "20240610T101112Z"}, "odd"]},
    "alpha_vantage": {"feed": [{"title": "T", "summary": "S", "url": "https://a.com/1", "source": "N", "time_published": "20240610T101112"}]},
    "marketaux": {"data": [{"title": "T", "description": "", "snippet": "S", "url": "https://a.com/1", "source": {"name": "N"}, "published_at": "2024-06-10T10:11:12.000000Z"}]},
    "newsdata": {"status": "success", "results": [{"title": "T", "content": "S", "link": "https://a.com/1", "source_id": "N", "pubDate": "2024-06-10 10:11:12"}]},
    "newsapi": {"articles": [{"title": "T", "description": "S", "url": "https://a.com/1", "source": {"name": "N"}, "publishedAt": "2024-06-10T10:11:12Z"}]},
}


def landed(spark, *payloads):
    return spark.createDataFrame([(p, "general_fmcg", NOW) for p in payloads], "payload string, query string, retrieved_at timestamp")


@pytest.mark.parametrize("name", list(PAYLOADS))
def test_json_sources(spark, name):
    df = landed(spark, json.dumps(PAYLOADS[name]), "<html>error</html>", "{}", json.dumps({k: None for k in PAYLOADS[name]}))
    rows = P.PARSERS[name](df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["title"], r["url"], r["source_api"], r["published_at"]) == ("T", "https://a.com/1", name, datetime(2024, 6, 10, 10, 11, 12))
    assert r["snippet"] == ("" if name == "gdelt" else "S") and r["source_name"] == ("a.com" if name == "gdelt" else "N") and len(r["article_id"]) == 12


def test_feeds(spark):
    rows = P.parse_google_news(landed(spark, RSS, "not xml")).orderBy("url").collect()
    assert [(r["title"], r["source_name"], r["snippet"]) for r in rows] == [("X acquires Y", "Publisher", "Deal done"), ("Second", "Google News", "")]
    assert rows[0]["published_at"] == datetime(2024, 6, 10, 10, 11, 12) and rows[1]["published_at"] is None
    assert P.parse_wires(landed(spark, RSS)).first()["query"] == "feed:general_fmcg"
    failed = {}
    both = P.fan_in(spark, {"google_news_rss": landed(spark, RSS), "gdelt": landed(spark, json.dumps(PAYLOADS["gdelt"])), "newsapi": lambda: spark.read.parquet("/nowhere/landed")}, "7d", NOW, failed)
    assert sorted(r["title"] for r in both.collect()) == ["T", "X acquires Y"] and list(failed) == ["newsapi"]
    assert P.fan_in(spark, {}, "7d", NOW).count() == 0


def test_landed_rows_are_read_while_young(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return landed(spark, "{}", f"call {len(calls)}")

    get = lambda key, minutes: P.cached(spark, str(tmp_path / "landed"), key, fetch, NOW + timedelta(minutes=minutes))
    assert get("7d", 0).count() == 2 and get("7d", 29).where("payload = 'call 1'").count() == 1 and len(calls) == 1
    assert get("1d", 1).where("payload = 'call 2'").count() == 1
    assert get("7d", 31).where("payload = 'call 3'").count() == 1 and get("7d", 40).count() == 2 and len(calls) == 3


def test_tiers_from_a_file(spark, tmp_path):
    from ledgerline.config import Config, load_tiers
    from ledgerline.operators.scoring import score_credibility

    (tmp_path / "tiers.yaml").write_text("tier_1:\n  domains: [Own.com]\ntier_3:\n  names: [Some Wire]\n")
    rows = spark.createDataFrame([("own.com", "x"), ("", " some wire "), ("reuters.com", "Reuters")], "domain string, source_name string").withColumn("published_at", F.lit(NOW))
    got = score_credibility(rows, Config(tiers=load_tiers(str(tmp_path / "tiers.yaml")))).select("credibility_tier").collect()
    assert [r[0] for r in got] == ["tier_1", "tier_3", "tier_4"]


def test_gates():
    assert P.enabled({}) == ["gdelt", "google_news_rss", "pr_wire_rss"]
    assert P.enabled({"newsapi": "k"}) == ["google_news_rss", "pr_wire_rss", "newsapi"] and "gdelt" in P.enabled({"newsapi": "k"}, gdelt=True)
    assert search_query("food_beverage").endswith("(food OR beverage OR dairy OR snacks) sourcelang:english") and '"stake sale"' in search_query("food_beverage")


def test_outputs(spark, tmp_path):
    from sample import NOW as now
    from sample import write_csv

    from ledgerline.operators.polish import Polisher
    from ledgerline.plans.pipeline import run
    from ledgerline.schema import empty_articles
    from ledgerline.sources.sinks import write_all

    sample = P.load_sample(spark, write_csv(tmp_path / "s.csv"), now)
    done = run(spark, lambda span: empty_articles(spark), now, sample=sample)
    out = write_all(done, str(tmp_path / "out"))
    assert len(out) == 8
    assert spark.read.option("header", True).csv(out["processed_articles.csv"]).count() == 14
    assert [e["cluster_id"] for e in json.load(open(out["deal_clusters.json"]))] == ["C001", "C002", "C003", "C004"]
    with zipfile.ZipFile(out["newsletter.xlsx"]) as z:
        assert sum(n.startswith("xl/worksheets/") for n in z.namelist()) == 7
    assert zipfile.ZipFile(out["newsletter.docx"]).testzip() is None

    events = done.brief["highlights"] + done.brief["watchlist"]
    answer = {"executive_summary": "Deal activity in snacks.", "clusters": [{"cluster_id": e["cluster_id"], "headline": e["canonical_headline"], "takeaway": "Deal activity."} for e in events]}
    calls = []

    def ask(request):
        calls.append(request)
        return {"choices": [{"message": {"content": "```json\n" + json.dumps(answer) + "\n```"}}]}

    whole = run(spark, lambda span: empty_articles(spark), now, sample=sample, polish=Polisher(ask))
    assert whole.metadata["ai_polish_used"] and "Deal activity in snacks." in whole.markdown and whole.brief["ai_polished"]
    assert "Deal activity in snacks." in open(write_all(whole, str(tmp_path / "worded"))["newsletter.md"]).read()
    calls.clear()
    polish = Polisher(ask)
    assert polish(done.brief).used and polish(done.brief).used and len(calls) == 1
    assert not Polisher(None)(done.brief).used
    for change, reason in (
        ({"cluster_id": "C999"}, "unknown cluster_id"),
        ({"takeaway": "Worth $999 million."}, "money"),
        ({"takeaway": "See www.x.com now"}, "link"),
        ({"takeaway": "In 2031 activity"}, "date"),
        ({"takeaway": "Grew 55%"}, "percentage"),
        ({"takeaway": "Has 7 items"}, "number"),
        ({"takeaway": "Unilever activity"}, "term"),
        ({"takeaway": "deal – activity"}, "dash"),
        ({"takeaway": "deal " * 40}, "too long"),
    ):
        bad = {**answer, "clusters": [answer["clusters"][0] | change, *answer["clusters"][1:]]}
        got = Polisher(lambda r, bad=bad: json.dumps(bad))(done.brief)
        assert not got.used and reason in got.warning, (change, got.warning)
    assert "missing cluster_id" in Polisher(lambda r: json.dumps({**answer, "clusters": []}))(done.brief).warning


def test_stream(spark, tmp_path):
    from sample import NOW as now
    from sample import write_csv

    from ledgerline.schema import RAW
    from ledgerline.streaming.articles import event_stream
    from ledgerline.streaming.state import event_history

    rows = P.load_sample(spark, write_csv(tmp_path / "s.csv"), now)
    from pyspark.sql import functions as F

    rows.withColumn("url", F.concat(F.lit("https://e.com/"), F.col("row_idx") % 10)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RAW).parquet(str(tmp_path / "in"))
    q = event_stream(stream, *(str(tmp_path / x) for x in ("table", "state", "events", "ck")))
    q.awaitTermination(300)
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "table")).count() == 10 and event_history(spark, str(tmp_path / "events")).count() >= 2
