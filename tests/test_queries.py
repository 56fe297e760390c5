"""Registered queries against their SQL, on the smallest tables."""

import glob
import math
import re
from datetime import timedelta
from pathlib import Path

import pytest

from ledgerline.plans.oracles import oracle_sql
from ledgerline.plans.queries import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the tables")


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None).map(lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, int | str | type(None)) else str(v))
    return sorted(map(tuple, pdf.values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {Path(f).stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, duck, name):
    ours, theirs = queries()[name](spark, SF).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_similar_titles_are_those_of_all_pairs(spark):
    """The documents' titles, which SQL is too slow for: all pairs, and the walk over them in order of preference."""
    from ledgerline.functions.similarity import token_set_ratio
    from ledgerline.operators.cleaning import apply_cleaning
    from ledgerline.operators.dedupe import preference
    from ledgerline.plans.queries import articles

    rows = apply_cleaning(articles(spark, SF)).select("row_idx", "article_id", "normalized_title", "published_at", preference().alias("p")).orderBy("p").collect()
    near = lambda a, b: a["published_at"] and b["published_at"] and abs(a["published_at"] - b["published_at"]) <= timedelta(days=14)
    pairs = {frozenset((a["row_idx"], b["row_idx"])) for n, a in enumerate(rows) for b in rows[:n] if near(a, b) and token_set_ratio(a["normalized_title"], b["normalized_title"]) >= 90}
    got = queries()["fuzzy_title_pairs"](spark, SF).collect()
    assert {frozenset((r["i"], r["j"])) for r in got} == pairs and len(got) == len(pairs)
    kept, leader = [], {}
    for r in rows:
        to = next((k for k in kept if frozenset((k["row_idx"], r["row_idx"])) in pairs), None)
        if to:
            leader[r["article_id"]] = to["article_id"]
        else:
            kept.append(r)
    flagged = queries()["dedupe_fuzzy_title"](spark, SF).where("dedupe_status = 'duplicate'").collect()
    assert {r["article_id"]: r["duplicate_of"] for r in flagged} == leader


def test_all_duplicates_are_those_of_four_walks(spark):
    """dedupe_all over the documents, pass by pass as the rules say, with all pairs and no index."""
    from collections import Counter

    from ledgerline.config import Config
    from ledgerline.functions.similarity import token_set_ratio
    from ledgerline.operators.cleaning import apply_cleaning
    from ledgerline.operators.dedupe import preference
    from ledgerline.plans.queries import articles

    c = Config()
    rows = [r.asDict() for r in apply_cleaning(articles(spark, SF)).withColumn("p", preference()).orderBy("p").collect()]
    near = lambda a, b: a["published_at"] and b["published_at"] and abs(a["published_at"] - b["published_at"]) <= timedelta(days=14)
    to = {}
    for key, reason in (("canonical_url", "exact_url"), ("normalized_title", "exact_title_14d")):
        best = {}
        for r in rows:
            if r["article_id"] not in to and r[key]:
                first = best.setdefault(r[key], r)
                if first is not r and (key == "canonical_url" or near(first, r)):
                    to[r["article_id"]] = (first["article_id"], reason)

    def walk(alike, reason):
        kept = []
        for r in [x for x in rows if x["article_id"] not in to]:
            first = next((k for k in kept if near(k, r) and alike(k, r)), None)
            if first:
                to[r["article_id"]] = (first["article_id"], reason)
            else:
                kept.append(r)

    walk(lambda a, b: a["normalized_title"] and b["normalized_title"] and token_set_ratio(a["normalized_title"], b["normalized_title"]) >= 90, "fuzzy_title_90")
    live = [r for r in rows if r["article_id"] not in to]
    words = {r["article_id"]: Counter(w for w in re.findall(r"\b\w\w+\b", f"{r['normalized_title']} {r['snippet']}".lower()) if w not in c.stop_words) for r in live}
    df = Counter(w for v in words.values() for w in v)
    vec = {}
    for i, v in words.items():
        w = {t: n * (math.log((1 + len(live)) / (1 + df[t])) + 1) for t, n in v.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1
        vec[i] = {t: x / norm for t, x in w.items()}
    walk(lambda a, b: sum(x * vec[b["article_id"]].get(t, 0) for t, x in vec[a["article_id"]].items()) >= 0.82, "tfidf_similarity_82")
    end = lambda i: end(to[i][0]) if i in to else i
    want = {r["article_id"]: (end(r["article_id"]) if r["article_id"] in to else "", to.get(r["article_id"], ("", ""))[1]) for r in rows}
    got = {r["article_id"]: (r["duplicate_of"], r["dedupe_reason"]) for r in queries()["dedupe_all"](spark, SF).collect()}
    assert got == want and len({v[1] for v in want.values()}) >= 3


def test_entry_imports_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(queries()) and set(entry.oracle_sql()) <= set(queries())


def test_rejected_rows_are_scored_once(spark, capsys):
    """The condition reads what was scored and doesn't look for the terms again."""
    from ledgerline.plans.queries import rejected_rows

    rejected_rows(spark, "/root/testdata/sf0.001").explain(True)
    assert "RLIKE" not in capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].upper()
