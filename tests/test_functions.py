import random
import re
import unicodedata
from datetime import datetime
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.config import Config, search_query
from ledgerline.functions import text as T
from ledgerline.functions.similarity import both_ways, class_cosines, cosine_pairs, fuzzy_pairs, label_cosines, ratio_bound, ratio_bounds, shared_ratio, tfidf, token_set_ratio, vector_classes
from ledgerline.operators.cleaning import timespan, with_when
from ledgerline.operators.scoring import cluster_credibility, confidence, query_family, tier


def _one(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(make(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_addresses(spark):
    urls = ["https://www.Site.com/a/?utm_source=x&b=2&a=1#frag", "", None, "HTTPS://News.Example.co.uk:8080/A//?ref=1&q=a b&q=", "not a url?x=%zz", "//host/p?UTM_Medium=1&fbclid=2"]
    got = _one(spark, urls, T.canonical_url)
    assert got[:3] == ["https://site.com/a?a=1&b=2", "", ""]
    assert got[3] == "https://news.example.co.uk:8080/A?q=&q=a+b" and got[5] == "//host/p"
    assert _one(spark, [g for g in got if g], T.canonical_url) == [g for g in got if g]
    assert all("utm_" not in urlsplit(g).query.lower() for g in got)
    domains = _one(spark, ["https://www.insidefmcg.com.au/x", "http://a.b.thegrocer.co.uk", "reuters.com", "http://10.1.2.3/x", ""], T.registered_domain)
    assert domains == ["insidefmcg.com.au", "thegrocer.co.uk", "reuters.com", "10.1.2.3", ""]


def test_titles_and_snippets(spark):
    a, b, c = _one(spark, ["BREAKING: X Acquires Y - Reuters", "X acquires Y", "A - B story - Reuters"], T.normalized_title)
    assert a == b == "x acquires y" and c == "a b story"
    assert _one(spark, ["A - B story - Reuters", "Long | " + "x" * 46], T.display_title) == ["A", "Long | " + "x" * 46]
    assert _one(spark, ["<p>a &amp;\n b</p>" + "x" * 600, None], T.clean_snippet) == [("a &amp; b " + "x" * 600)[:500], ""]
    assert _one(spark, ["NESTLÉ and L'Oréal", None], T.accent_fold) == ["NESTLE and L'Oreal", ""]


def test_detection(spark):
    assert _one(spark, ["$120 mln deal", "valued at $120.", "USD 5,000 x", "paid $5B, said", "none"], lambda v: T.deal_value(F.array(v))) == ["$120", "$120.", "USD 5,000", "$5B", "undisclosed"]
    assert _one(spark, ["in Latin America", "us", "the US market", "U.S. firm in India", "EU.x"], T.geography) == ["US", "Not specified", "US", "US", "Not specified"]
    kinds = Config().deal_types
    assert _one(spark, ["sale of a stake", "merger and sale", "nothing"], lambda v: T.deal_type(v, kinds)) == ["divestment", "merger", "unknown"]
    title = "Elida Beauty Secures Billion Debt Financing to Support Suave Brands - Business Wire"
    names = _one(spark, [title, "NESTLÉ buys It - and Nestle"], T.companies)
    assert "Elida Beauty" in names[0] and not {"Billion Debt Financing", "Support Suave Brands", "Business Wire"} & set(names[0])
    assert names[1] == ["Nestlé"]


def test_scores_of_groups(spark):
    cases = [(35, 30), (45, 38), (50, 42), (60, 51), (65, 55), (75, 64), (80, 68), (90, 76), (95, 81)]
    df = spark.createDataFrame([([float(a)], ["k"], ["tier_4"], b) for a, b in cases] + [([], [], [], 0)], "s array<double>, k array<string>, t array<string>, want int")
    assert df.where(cluster_credibility(F.col("s"), F.col("k"), F.col("t")) != F.col("want")).count() == 0
    row = spark.range(1).select(
        tier(F.lit("reuters.com"), F.lit("")), tier(F.lit(""), F.lit("Inside FMCG")), tier(F.lit("unknownblog.net"), F.lit(None).cast("string")), tier(F.lit("news.google.com"), F.lit("Reuters")),
        confidence(F.lit(60), F.lit(56), F.lit(1), F.lit(True)), confidence(F.lit(75), F.lit(75), F.lit(1), F.lit(True)), query_family(F.lit(search_query("watchlist"))), query_family(F.lit("feed:x")),
    ).first()
    assert list(row) == [1, 2, 4, 1, "Medium", "High", "watchlist", ""]


def test_timespans():
    assert timespan("36h").total_seconds() == 36 * 3600 and timespan("nonsense").days == 7
    assert with_when("a", "7d") == "a when:7d" and with_when("a", "12h") == "a when:12h" and with_when("a when:1d", "7d") == "a when:1d"


def _lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc é", max_size=25), st.text("abc é", max_size=25))
def test_token_set_ratio(a, b):
    left, right = set(a.split()), set(b.split())
    got = token_set_ratio(a, b)
    assert got == token_set_ratio(b, a) and 0 <= got <= 100
    if left and right and not left & right:
        x, y = " ".join(sorted(left)), " ".join(sorted(right))
        assert abs(got - 200 * _lcs(x, y) / (len(x) + len(y))) < 1e-9
    if left & right and (left <= right or right <= left):
        assert got == 100


def test_token_set_ratio_of_the_example():
    a, b = "example foods acquires sample snacks co for 120 million", "example foods acquires sample snacks co for 120 mln"
    assert round(token_set_ratio(a, b), 2) == 96.23 and token_set_ratio("", "x") == 0


def test_cosine_pairs_are_all_pairs(spark):
    import math
    from collections import Counter

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"]) for _ in range(rng.randint(0, 7))) for _ in range(40)]
    n, df = len(texts), Counter(w for t in texts for w in set(t.split()))
    vec = []
    for t in texts:
        v = {w: k * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in Counter(t.split()).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vec.append({w: x / norm for w, x in v.items()})
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if sum(x * vec[j].get(w, 0) for w, x in vec[i].items()) >= 0.6}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_idx long, text string")
    assert {(r["i"], r["j"]) for r in cosine_pairs(tfidf(rows, frozenset()), 0.6).collect()} == want


def test_classes_of_near_copies(spark):
    """2,000 near copies of one text, most of them exact: classes are met, and not their members."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: 57 + i % 4]) if i % 50 else " ".join([*base[:50], *(f"x{i}.{j}" for j in range(10))]) for i in range(2000)]
    texts += [" ".join(f"y{rng.randrange(300)}" for _ in range(40)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_idx long, text string").repartition(4)
    vectors = tfidf(rows, frozenset()).cache()
    classes = vector_classes(vectors)
    by_text = {}
    for i, t in enumerate(texts):
        by_text.setdefault(tuple(sorted(t.split())), []).append(i)
    assert {r["key"]: r["rep"] for r in classes.collect()} == {i: min(v) for v in by_text.values() for i in v}
    own = {}
    for r in vectors.collect():
        own.setdefault(r["key"], {})[r["term"]] = r["w"]
    reps = sorted(min(v) for v in by_text.values())
    want = {(a, b) for n, b in enumerate(reps) for a in reps[:n] if sum(w * own[b].get(t, 0) for t, w in own[a].items()) >= 0.82}
    got = {(r["i"], r["j"]) for r in class_cosines(vectors, classes, 0.82).collect()}
    assert got == want and len(reps) < 350 and len(got) >= 6


def test_vectors_meet_within_their_blocks(spark):
    """What two heads share is no row of a join: the pairs come from one scan. Slices and chunks of any size find the same."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    vectors = tfidf(spark.createDataFrame(list(enumerate(texts)), "row_idx long, text string"), frozenset())
    classes = vector_classes(vectors)
    pairs = class_cosines(vectors, classes, 0.7)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    from ledgerline.functions import similarity

    own = {}
    for r in vectors.join(classes.where("key = rep"), "key").collect():
        own.setdefault(r["key"], {})[r["term"]] = r["w"]
    want = {(a, b) for a in own for b in own if a < b and sum(w * own[b].get(t, 0) for t, w in own[a].items()) >= 0.7}
    assert {(r["i"], r["j"]) for r in pairs.collect()} == want
    code = {t: n for n, t in enumerate(sorted({t for v in own.values() for t in v}))}
    one = {"key": np.array(list(own)), "end": np.full(len(own), 99), "tail": np.zeros(len(own), np.float32), "first": np.cumsum([0, *map(len, own.values())])}
    flat = [(code[t], n, w) for n, v in enumerate(own.values()) for t, w in sorted(v.items())]
    one |= {"code": np.array([x[0] for x in flat]), "v": np.array([x[2] for x in flat])}
    flat.sort(key=lambda x: x[0])
    one |= {"place": np.array([x[0] for x in flat]), "row": np.array([x[1] for x in flat], np.int32), "w": np.array([x[2] for x in flat], np.float32), "after": np.ones(len(flat), np.float32)}
    for cells in (1, 7, 300, 1 << 20):
        i, j, _ = similarity._alike(one, one, True, 0.7, cells)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_fuzzy_pairs_lose_no_match(spark):
    """At any ratio, the pairs are those of all pairs; titles of few letters, of one long word, and of shared words."""
    rng = random.Random(2)
    titles = ["ha" * 30, "ha" * 29 + "hx", "a b", "b a", "the", "the quick brown fox acquires a hen", "acquires hen", "a b c d e f g h i", "a b c d e f g h j", "ab c d e f g h i", "aquires hens", "alfa betas acqires", "alpha beta acquires"]
    for _ in range(60):
        ws = [rng.choice(["alpha", "beta", "acquires", "acquired", "stake", "stakes", "group", "of", "in", "x1"]) for _ in range(rng.randint(1, 8))]
        titles.append(" ".join(ws))
    df = spark.createDataFrame([(i, t, datetime(2024, 1, 1 + i % 20)) for i, t in enumerate(titles)], "row_idx long, normalized_title string, published_at timestamp")
    for least in (60.0, 70.0, 80.0, 85.0, 90.0, 95.0, 100.0):
        want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if abs(i % 20 - j % 20) <= 14 and token_set_ratio(titles[i], titles[j]) >= least}
        assert {(r["i"], r["j"]) for r in fuzzy_pairs(df, least, 14).collect()} == want and want


def test_bound_of_the_ratio():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    text = lambda: " ".join(sorted({word() for _ in range(rng.randint(1, 6))}))
    x, y = pd.Series([text() for _ in range(3000)]), pd.Series([text() for _ in range(3000)])
    ratios = np.array([token_set_ratio(a, b) for a, b in zip(x, y, strict=True)])
    shared = np.array([shared_ratio(a, b) for a, b in zip(x, y, strict=True)])
    whole_bound, shared_bound = ratio_bounds(x, y)
    assert (np.maximum(whole_bound, shared_bound) + 1e-9 >= ratios).all() and (ratio_bound(x, y) + 1e-9 >= ratios).all()
    assert (shared <= ratios + 1e-9).all() and (shared_bound + 1e-9 >= shared).all() and (np.where(ratios > shared + 1e-9, whole_bound, 100) + 1e-9 >= ratios).all()


def test_folding_is_that_of_decomposition(spark):
    """Every character, alone and within a text, against NFKD."""
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["x".join(every[i : i + 5000]) for i in range(0, len(every), 5000)] + ["ﬁne ½ ㎏ [Ǆ] \\^-& ﬃ", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    got = {r["i"]: r["f"] for r in rows.select("i", T.accent_fold("t").alias("f")).collect()}
    assert all(got[i] == unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode() for i, t in enumerate(texts))


def test_public_suffixes(spark, tmp_path):
    from ledgerline.functions.suffixes import read_rules, suffix_domain
    from ledgerline.operators.cleaning import apply_cleaning
    from ledgerline.schema import align

    (tmp_path / "rules.dat").write_text("// kinds of rules\ncom\nuk\nco.uk  a remark\n*.ck\n!www.ck\n\nшоп.ex\njp\n*.kawasaki.jp\n!city.kawasaki.jp\nb.c.kawasaki.jp\n")
    rules = read_rules(spark, str(tmp_path / "rules.dat"))
    expected = {
        "http://a.b.site.co.uk/x": "site.co.uk", "co.uk": "co.uk", "www.site.com.": "site.com", "x.y.ck": "x.y.ck", "w.x.y.ck": "x.y.ck", "a.www.ck": "www.ck", "x.unknown": "x.unknown",
        "a.x.unknown": "x.unknown", "a.xn--n1acz.ex": "a.xn--n1acz.ex", "b.a.шоп.ex": "a.шоп.ex", "a.city.kawasaki.jp": "city.kawasaki.jp", "z.a.b.kawasaki.jp": "a.b.kawasaki.jp",
        "z.a.b.c.kawasaki.jp": "a.b.c.kawasaki.jp", "10.1.2.3": "10.1.2.3", "": "", "ck": "ck", "a..com": ".com", None: "", "x" * 70 + ".é.com": "é.com",
    }
    assert dict(zip(expected, _one(spark, list(expected), suffix_domain(spark, rules)), strict=True)) == expected
    rows = align(spark.createDataFrame([("https://news.site.co.uk/1", "t")], "url string, title string"))
    assert apply_cleaning(rows, str(tmp_path / "rules.dat")).first()["domain"] == "site.co.uk"


def test_pairs_in_either_order(spark):
    """Each pair comes in both orders, repeated ones as often as they are there; none without pairs; its pairs are worked out once."""
    df = spark.createDataFrame([("p", "q", 1), ("p", "q", 2), ("r", None, 3)], "a string, b string, n int")
    got = sorted(map(tuple, both_ways(df, "x", "y").collect()), key=str)
    assert got == sorted([("p", "q"), ("q", "p")] * 2 + [("r", None), (None, "r")], key=str)
    assert both_ways(df.limit(0), "x", "y").columns == ["x", "y"] and both_ways(df.limit(0), "x", "y").isEmpty()
    plan = both_ways(df.distinct(), "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_similar_titles_of_one_text_in_many_buckets(spark):
    """Units of equal texts, of hashes that meet and of texts that no one shares, at either end of a bucket."""
    titles = ["acme buys a mill in the north of town", "acme buys a mill in the north of towns", "nothing like it"] * 12
    df = spark.createDataFrame([(i, t, datetime(2024, 1, 1 + 2 * (i // 3))) for i, t in enumerate(titles)], "row_idx long, normalized_title string, published_at timestamp")
    near = lambda i, j: abs(i // 3 - j // 3) * 2 <= 14
    want = {(i, j) for i in range(36) for j in range(i + 1, 36) if near(i, j) and token_set_ratio(titles[i], titles[j]) >= 90}
    got = [(r["i"], r["j"]) for r in fuzzy_pairs(df, 90.0, 14).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_titles_meet_within_their_blocks(spark):
    """Texts of two syllables share nearly all runs: no row of a join for them; tiles of any size find the same pairs."""
    from ledgerline.functions import similarity

    rng = random.Random(4)
    texts = sorted({" ".join(sorted({"".join(rng.choice(["en", "er"]) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 9))})) for _ in range(70)}, key=len)
    one = {"unit": np.arange(len(texts)), "b": np.array([i % 3 for i in range(len(texts))]), "l": np.array([len(t) for t in texts]), "text": np.array(texts, object)}
    whole = lambda i, j: token_set_ratio(texts[i], texts[j]) >= 90 and shared_ratio(texts[i], texts[j]) < 90
    want = {(i, j) for j in range(len(texts)) for i in range(j) if abs(i % 3 - j % 3) <= 1 and whole(i, j)}
    for cells in (1, 200, 1 << 16):
        x, y = similarity._whole_alike(one, one, True, 90.0, cells)
        got = set(zip(x.tolist(), y.tolist(), strict=True))
        assert want <= got and all(token_set_ratio(texts[i], texts[j]) >= 90 for i, j in got)
    rows = spark.createDataFrame([(i, t, datetime(2024, 1, 1)) for i, t in enumerate(texts)], "row_idx long, normalized_title string, published_at timestamp")
    every = {(i, j) for j in range(len(texts)) for i in range(j) if token_set_ratio(texts[i], texts[j]) >= 90}
    assert {(r["i"], r["j"]) for r in fuzzy_pairs(rows, 90.0, 14).collect()} == every


def test_vectors_of_a_label_meet_without_a_join(spark):
    """Zero and null vectors and a null label meet nothing; a missing component counts as 0; no component is a row."""
    vectors = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 1.0]), (2, 1, [0.0, 1.0]), (3, 2, [1.0, 0.0]), (4, 1, [0.0, 0.0]), (5, 1, None), (6, None, [1.0, 0.0]), (7, 1, [2.0, None])]
    got = label_cosines(spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>"), 0.3)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["i"], r["j"]): round(r["cos"], 6) for r in got.collect()} == {(0, 1): 0.707107, (1, 2): 0.707107, (0, 7): 1.0, (1, 7): 0.707107}


def test_characters_that_stand_for_several_are_met_as_ranges(spark):
    """One alternative for each of them costs every character of a text as many questions."""
    assert T._ANY_MORE.count("-") < 60
    more = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), T._ANY_MORE))
    assert all(more.fullmatch(c) for c in T._MORE) and not any(more.search(c) for c in (*T._ONE, *map(chr, range(128))))
    mixed = "".join(T._MORE) + "é" + "".join(T._ONE) + "日x"
    assert _one(spark, [mixed], T.accent_fold) == [T.fold(mixed)]


def test_names_of_companies_are_worked_out_once(spark, capsys):
    df = spark.range(1).select(T.companies(F.lit("Unilever Buys Nestlé")))
    df.explain(True)
    assert capsys.readouterr().out.split("== Analyzed")[0].count("regexp_extract_all") == 4  # known names, phrases, and folding of the text and of keys
    assert df.first()[0][0] == "Unilever"
