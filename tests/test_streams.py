"""Events carried from batch to batch: history, identity, replay, and what the state holds."""

from datetime import timedelta

from sample import NOW

from ledgerline.config import Config
from ledgerline.functions.similarity import tfidf
from ledgerline.operators.cleaning import apply_cleaning
from ledgerline.operators.scoring import score_articles
from ledgerline.schema import align
from ledgerline.streaming import frequencies as F_
from ledgerline.streaming.state import advance, event_history

ALL = Config(min_relevance=0, min_credibility=0, include_at=0, watch_at=0)
SNACKS = "Alpha Snacks acquires Beta Foods for $5 million, consumer goods deal"
MILK = "Gamma Dairy forms joint venture with Delta Beverage, a milk merger"


def _raw(spark, rows):
    """rows: (number, title, days after the beginning or None)."""
    made = [(f"a{n:02d}", t, f"{t} in full, part {n}", f"https://e{n}.com/{n}", f"source {n}", None if d is None else NOW + timedelta(days=d), NOW + timedelta(days=200), n) for n, t, d in rows]
    return align(spark.createDataFrame(made, "article_id string, title string, snippet string, url string, source_name string, published_at timestamp, retrieved_at timestamp, row_idx long"))


def _batch(spark, rows):
    return score_articles(apply_cleaning(_raw(spark, rows)), ALL)


def _events(spark, tmp):
    rows = event_history(spark, f"{tmp}/events").collect()
    return {r["event_id"]: (sorted(s["url"][-1] for s in r["sources"]), r["ended"]) for r in rows}


def _advance(spark, tmp, number, rows):
    advance(_batch(spark, rows), number, f"{tmp}/state", f"{tmp}/events", ALL)
    return _events(spark, tmp)


def test_events_are_carried_on_and_end(spark, tmp_path):
    """Each batch takes a while, so one story has it all: a repeated row, an article without a date (it was retrieved on day
    200, so it counts from then), an empty batch, an event that goes on, one that ends, and a batch that is run again."""
    first = _advance(spark, tmp_path, 0, [(1, SNACKS, 0), (1, SNACKS, 0), (2, MILK, 3)])
    assert sorted(first.values()) == [(["1"], False), (["2"], False)]
    snacks = next(k for k, v in first.items() if v[0] == ["1"])
    assert _advance(spark, tmp_path, 1, []) == first == _advance(spark, tmp_path, 1, [])
    # 37 days after the milk event: it has ended and stays; a new source joins the other event, which keeps its id
    third = _advance(spark, tmp_path, 2, [(3, SNACKS + " confirmed by both firms today after talks", 20), (4, "Epsilon Beauty raises funding from Zeta Capital", 40)])
    assert third[snacks] == (["1", "3"], False) and sorted(v for k, v in third.items() if k != snacks) == [(["2"], True), (["4"], False)]
    held = spark.read.parquet(f"{tmp_path}/state/open/batch=2")
    assert sorted(r["row_idx"] for r in held.collect()) == [1, 3, 4]
    # far later: everything before has ended and is still told; run again, as after a lost driver, it gives the same rows
    again = [_advance(spark, tmp_path, 3, [(5, "Eta Pet Food merges with Theta Care", None)]) for _ in range(2)]
    assert again[0] == again[1] and again[0][snacks] == (["1", "3"], True)
    assert sum(ended for _, ended in again[0].values()) == 3 and len(again[0]) == 4
    assert [r["row_idx"] for r in spark.read.parquet(f"{tmp_path}/state/open/batch=3").collect()] == [5]


def _weights(vectors):
    return sorted((r["key"], r["term"], round(r["w"], 9), r["df"]) for r in vectors.collect())


def test_maintained_frequencies_equal_a_refit(spark, tmp_path):
    texts = {1: "snacks and foods", 2: "snacks merge again, snacks", 3: None, 4: "", 5: "foods of élan", 6: "snacks and foods", 7: "gone later"}
    rows = lambda ids, sign: [(i, texts[i], sign, "x") for i in ids]
    batch = lambda made: spark.createDataFrame(made, "id int, text string, sign int, term string")  # noqa: E731  (a clashing name)
    changes = {2: rows([7, 5], 1), 0: rows([1, 2, 3], 1), 3: [*rows([7], -1), (2, "old words", 1, "x"), (2, "old words", -1, "x")], 1: rows([4, 6], 1), 4: []}
    for number, made in changes.items():  # out of order
        F_.commit(batch(made), str(tmp_path), number, frozenset({"of"}))
    F_.commit(batch(changes[3]), str(tmp_path), 3, frozenset({"of"}))  # run again
    now = spark.createDataFrame([(i, t) for i, t in texts.items() if i != 7], "row_idx int, text string")
    refit = _weights(tfidf(now, frozenset({"of"})))
    assert _weights(tfidf(now, frozenset({"of"}), fit=F_.fitted(spark, str(tmp_path)))) == refit
    F_.compact(spark, str(tmp_path), 2)
    assert _weights(tfidf(now, frozenset({"of"}), fit=F_.fitted(spark, str(tmp_path)))) == refit
    early = {r["term"]: r["df"] for r in F_.fitted(spark, str(tmp_path), 2)[0].collect()}
    assert early["gone"] == 1 and F_.fitted(spark, str(tmp_path), 2)[1].first()[0] == 7  # a version of before
    new = spark.createDataFrame([(9, "snacks unseen")], "row_idx int, text string")
    assert {r["term"]: r["df"] for r in tfidf(new, frozenset(), fit=F_.fitted(spark, str(tmp_path))).collect()} == {"snacks": 3, "unseen": 0}


def test_no_frequencies_yet(spark, tmp_path):
    found, n = F_.fitted(spark, str(tmp_path / "none"))
    assert found.count() == 0 and n.first()[0] == 0
