"""Near-duplicates, embeddings, decontamination, passages, toxicity, pipeline: against brute force, and on odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import decontaminate, embeddings, minhash, search, substrings, toxicity
from ledgerline.llm import _common as C

from .conftest import words


def _roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_word_hashes_follow_words():
    texts = ["a Bc  d", "", "\t x\x0by ", "é" * 5000 + " z", "bC"]
    start, stop, h, first = C.hash_words([t.encode() for t in texts])
    assert list(np.diff(first)) == [len(re.findall(r"[^ \t-\r]+", t)) for t in texts]
    assert h[1] == h[first[4]] and len(set(h.tolist())) == len(h) - 1
    assert (stop > start).all()


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    want = _roots({x for p in links for x in p}, links)
    got = {r["node"]: r["label"] for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = "edit" + str(rng.random())[2:8]
    return ws


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_are_those_of_full_sets(make_docs, odd_texts, k):
    rng = random.Random(k)
    base = words(rng, 120)
    rows = [r for r in odd_texts if r[0] is not None] + [(50 + i, " ".join(_edited(rng, base, rng.randint(0, 16)))) for i in range(60)]
    rows += [(200 + i, " ".join(words(rng, 30))) for i in range(20)] + [(300, " ".join(base)), (301, " ".join(base).upper()), (302, "WORD")]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _roots(ids, links)
    for block in (256, 8):
        out = minhash.near_duplicates(make_docs(rows), s=minhash.Settings(shingle=k, block=block)).collect()
        assert len(out) == len(rows)
        assert {(r["key"], r["n_shingles"], r["component"], r["kept"]) for r in out} == {(i, len(sets[i]), want[i], want[i] == i) for i in ids}
    a, b = words(rng, 100), words(rng, 100)  # one key with two texts links through both
    two = [(8, " ".join(a)), (8, " ".join(b)), (8, " ".join(b)), (20, " ".join(_edited(rng, a, 1))), (30, " ".join(_edited(rng, b, 1))), (40, " ".join(words(rng, 50)))]
    assert {(r["key"], r["component"]) for r in minhash.near_duplicates(make_docs(two), s=minhash.Settings(shingle=k)).collect()} == {(8, 8), (20, 8), (30, 8), (40, 40)}
    none = minhash.near_duplicates(make_docs([(None, "no key")])).collect()
    assert [(r["component"], r["kept"]) for r in none] == [(None, False)] and minhash.near_duplicates(make_docs([])).count() == 0


def test_pairs_are_dropped_at_the_chosen_rate():
    s = minhash.Settings()
    looks = minhash.least_matches(s)
    rng = np.random.default_rng(0)
    same = rng.random((20_000, s.hashes)) < 0.8
    a = np.zeros((20_000, s.hashes), np.uint32)
    assert minhash.plausible(a, np.where(same, 0, 1).astype(np.uint32), s, looks).mean() > 0.999
    assert minhash.plausible(a, (rng.random((20_000, s.hashes)) > 0.4).astype(np.uint32), s, looks).mean() < 0.05


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("group", T.StringType())])


def test_embedding_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(30):
        c = rng.normal(size=32)
        for _ in range(rng.integers(1, 12)):
            rows.append((n, (c + rng.normal(size=32) * rng.choice([0.0, 0.15, 0.25, 0.35])).astype(np.float32), int(rng.integers(0, 2))))
            n += 1
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 32, 0), (903, [float("nan")] + [1.0] * 31, 0), (904, [None] + [1.0] * 31, 1), (905, rows[0][1], None), (906, [float("inf")] * 32, 1), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (None, [1.0, 2.0], 0)]
    every = [(i, None if v is None else [None if x is None else float(x) for x in v], g, "k", "g") for i, v, g in [*rows, *odd, rows[0]]]
    unit = {i: np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) for i, v, _ in rows}
    label = {i: g for i, _, g in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93] + [(907, 908)]
    ids = [*unit, *range(900, 909)]
    want = _roots(ids, links)
    for block in (512, 4):
        out = embeddings.near_duplicates(spark.createDataFrame(every, VECTORS), s=embeddings.Settings(block=block)).collect()
        assert len(out) == len(ids) + 1
        found = {r["key"]: (r["n_links"], r["component"], r["kept"]) for r in out}
        assert found.pop(None) == (0, None, False)
        n_links = {i: sum(i in p for p in links) for i in ids}
        assert sum(v[0] for v in found.values()) >= 0.98 * sum(n_links.values())
        assert all(found[i][0] <= n_links[i] for i in ids) and sum(found[i][1] == want[i] for i in ids) >= len(ids) - 2
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_sample_with_a_third_of_all_rows_equal(spark):
    """Near copies of a hot vector share a table, though its copies come first in the order of the sample."""
    rng = np.random.default_rng(17)
    able = spark.createDataFrame([(v.tolist(),) for v in rng.normal(size=(2000, 32))], "vec array<double>")
    hot = able.selectExpr("vec").orderBy(F.xxhash64("vec")).first()["vec"]
    table = able.union(spark.createDataFrame([(hot,)] * 1000, "vec array<double>"))
    c = np.array(hot) / np.linalg.norm(hot)
    e = rng.normal(size=(400, 32))
    e -= np.outer(e @ c, c)
    near = 0.94 * c + np.sqrt(1 - 0.94**2) * e / np.linalg.norm(e, axis=1)[:, None]
    q = embeddings.fit(table, 20_000, embeddings.Settings(sample=1050))
    assert (q.keys(near) == q.keys(c[None])).any(1).mean() >= 0.98
    mostly = np.concatenate([near, rng.normal(size=(40, 32)) / np.sqrt(32)])  # near copies, all distinct, may fill a sample too
    q.rotations[32] = embeddings.learn(mostly, q.bits, q.codes, 30)
    assert (q.keys(near) == q.keys(c[None])).any(1).mean() >= 0.98


def _scores(index, terms):
    total = np.zeros(len(index.ids))
    for t in terms:
        for i, x in zip(*index.lists[t], strict=True):
            total[i] += x
    return total


def test_search_finds_every_item_over_the_threshold():
    rng = random.Random(9)
    vocabulary = words(rng, 60)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 12)))) for i in range(70)]
    for block in (1, 4, 16):
        index = decontaminate.Index(items, decontaminate.Settings(threshold=0.5, block=block))
        for _ in range(60):
            terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 25)))
            total = _scores(index, terms)
            assert dict(index.search(terms)) == pytest.approx({i: x for i, x in enumerate(total) if x >= 0.5 - 1e-9})


def test_leaks_are_those_of_the_shingles(spark, make_docs, odd_texts):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, rng.randint(12, 50))) + ". " + " ".join(words(rng, 7)) + ".") for i in range(40)] + [(90, None), (91, ""), (92, "?!")]
    rows = list(odd_texts)
    for i in range(60):
        ws = " ".join(words(rng, rng.randint(0, 300)))
        if i < 20:
            ws += " " + items[i][1].upper() + " " + " ".join(words(rng, 100))
        elif i < 30:
            ws += " " + items[i][1].rsplit(". ", 1)[0]  # the question alone
        rows.append((1000 + i, ws))
    table = spark.createDataFrame(items, "item_id long, text string")
    for most in (20_000, 7):
        s = decontaminate.Settings(shard_items=most)
        assert {(r["key"], r["item"]) for r in decontaminate.leaks(make_docs(rows), table, s=s).collect()} == {(1000 + i, i) for i in range(20)}
    kept = decontaminate.without_leaks(make_docs(rows), table).collect()
    assert len(kept) == len(rows) - 20 and kept[0].asDict().keys() == {"doc_id", "text", "key", "size", "row"}
    assert decontaminate.leaks(make_docs([]), table).count() == 0 and decontaminate.leaks(make_docs(rows), table.limit(0)).count() == 0
    assert decontaminate.split_item("Q: what? Answer: this one") == ("Q: what?", "this one")


def test_one_item_among_unknown_words():
    """The bound counts each known word of a passage, whatever unknown words stand before it."""
    rng = random.Random(13)
    for _ in range(600):
        item = " ".join(words(rng, rng.randint(4, 8))) + ". " + " ".join(words(rng, 3)) + "."
        index = decontaminate.Index([(0, item)], decontaminate.Settings())
        text = " ".join([*words(rng, rng.randint(20, 60)), item, *words(rng, 40)])
        assert list(index.match([text.encode()])[0]) == [0]


def test_windows_hold_every_run():
    s, rng = substrings.Settings(words=12, hashes=3), np.random.default_rng(1)
    sizes = [0, 3, 8, 9, 40, 200]
    g = rng.integers(0, 50, sum(sizes)).astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    d, f, w, lo, hi, at = substrings.windows(C.mix(g), first, s)
    assert set(d) == {2, 3, 4, 5} and ((lo <= at) & (at < hi)).all() and (hi - lo >= s.run).all() and (hi <= np.array(sizes)[d]).all()
    for t in (4, 5):
        for h in range(3):
            m = (d == t) & (f == h)
            covered = set()
            for a, b in zip(lo[m], hi[m], strict=True):
                covered |= set(range(a, b - s.run + 1))
            assert covered == set(range(sizes[t] - s.run + 1))


def test_repeated_passages(make_docs, odd_texts):
    rng = random.Random(21)
    passage, other = words(rng, 60), words(rng, 70)
    rows = list(odd_texts[:7]) + [(100 + i, " ".join(words(rng, rng.randint(0, 200)) + passage + words(rng, rng.randint(0, 200)))) for i in range(12)]
    rows += [(200, " ".join(words(rng, 90) + other + words(rng, 40))), (201, " ".join(words(rng, 10) + _edited(rng, other, 1) + words(rng, 40)).upper())]
    rows += [(300 + i, " ".join(words(rng, 150) + passage[:30] + words(rng, 20))) for i in range(10)] + [(400, " ".join(passage * 2))]
    out = substrings.repeats(make_docs(rows)).toPandas()
    assert set(out["key"]) == {*range(100, 112), 200, 201, 400}
    text = dict(rows)
    for r in out[(out["key"] < 112) & ~out["kept"]].itertuples():
        assert " ".join(passage).startswith(" ".join(text[r.key].split()[r.begin : r.end])[:100]) and r.first == 100 and r.end - r.begin == 60
    kept = out[out["kept"] & (out["key"] == 100)].iloc[0]
    assert text[100].split()[kept["begin"] : kept["end"]] == passage
    assert substrings.repeats(make_docs([])).count() == 0


def test_repeats_of_sentences_that_earlier_texts_hold_apart(make_docs):
    """Every name of such a passage can be first in a text that holds one of its sentences only."""
    rng, rows, n = random.Random(5), [], 30
    noise = lambda: words(rng, rng.randint(200, 250))
    passages = [(words(rng, 26), words(rng, 26)) for _ in range(n)]
    for k, (x, y) in enumerate(passages):
        rows += [(k, " ".join(noise() + x + noise() + y + noise()))]
        for b in (100, 200):
            rows.append((b + k, " ".join(noise() + x + y + noise())))
    for k in range(n):  # the first text has a sentence first, and later the passage
        x, y = words(rng, 26), words(rng, 26)
        rows.append((300 + k, " ".join(noise() + x + noise() + y + noise() + x + y + noise())))
        rows.append((400 + k, " ".join(noise() + x + y + noise())))
    for k in range(n):  # with an edit in the second text
        x, y = words(rng, 45), words(rng, 45)
        rows.append((500 + k, " ".join(noise() + x[:30] + noise() + x[15:] + noise() + y[:30] + noise() + y[15:])))
        rows.append((600 + k, " ".join(noise() + x + y + noise())))
        rows.append((700 + k, " ".join(noise() + _edited(rng, x + y, 2) + noise())))
    out = substrings.repeats(make_docs(rows)).toPandas()
    got = {(r.key, r.first) for r in out[~out["kept"]].itertuples()}
    want = {(200 + k, 100 + k) for k in range(n)} | {(400 + k, 300 + k) for k in range(n)}
    assert want <= got and got - want <= {(700 + k, 600 + k) for k in range(n)}
    assert len(got - want) >= 0.9 * n


def test_segments():
    hit = np.array([0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0, 0, 1, 0], bool)
    assert substrings.segments(hit, 0.8, 5) == [(1, 10, 8 / 9)] and substrings.segments(hit, 0.95, 5) == []


def _toxic(rng, bad):
    ws = words(rng, rng.randint(5, 200))
    for _ in range(rng.randint(2, 5)) if bad else ():
        ws[rng.randrange(len(ws))] = rng.choice(["idiot", "moron", "vequa" + rng.choice(words(rng, 1))])
    return " ".join(ws)


def test_toxicity_on_held_out_rows(spark, make_docs, odd_texts):
    rng = random.Random(8)
    rows = [(1000 + i, _toxic(rng, i % 4 == 0)) for i in range(1200)]
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i, _ in rows if i % 5] + [(1, None), (None, 1), (77777, 1), (rows[1][0], 0)], "doc_id long, toxic int")
    docs = make_docs(odd_texts + rows)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).toPandas()
    assert len(out) == len(rows) + len(odd_texts) and out["score"].between(0, 1).all()
    held = out[(out["key"] >= 1000) & (out["key"] % 5 == 0)]
    assert (held["toxic"] == (held["key"] % 4 == 0)).mean() > 0.95
    assert out[out["key"] == 8]["score"].nunique() == 1
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == (~out["toxic"]).sum()
    flat = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, flat).where("toxic").count() == 0
    assert toxicity.score(make_docs([]), flat).count() == 0


def test_a_labelled_text_beyond_the_bytes_is_passed_over(make_docs):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 30) + (["idiot"] if i % 2 else []))) for i in range(120)]
    few = toxicity.Settings(sample_bytes=100_000, epochs=2)
    labels = make_docs([]).sparkSession.createDataFrame([(i, i % 2) for i in range(121)], "doc_id long, toxic int")
    long = [(120, "x" * 200_000)]
    models = [toxicity.fit(make_docs(r), labels, settings=few) for r in (rows, rows + long, rows + long + rows)]
    assert models[0].thresholds == models[1].thresholds == models[2].thresholds


def test_toxicity_learns_from_every_labelled_text(spark, make_docs):
    """Toxic words that 75 of 9000 toxic texts have each: 2000 texts of a label would show each in 17."""
    rng = random.Random(10)
    rows = [(i, " ".join([*words(rng, 12), *(["moron"] if i % 2 else [])])) for i in range(12_000)]
    rows += [(20_000 + i, " ".join([*words(rng, 12), f"late{i % 40}vequa"])) for i in range(4_000)]
    labels = spark.createDataFrame([(i, int(i >= 20_000 or i % 2)) for i, _ in rows if i < 23_000], "doc_id long, toxic int")
    docs = make_docs(rows)
    model = toxicity.fit(docs, labels, settings=toxicity.Settings(part_bytes=200_000, epochs=4))
    assert sum(b in set(model.buckets) for b in {int(toxicity.features([f"late{i}vequa".encode()], model.settings.buckets)[0][0, 0]) for i in range(40)}) == 40
    out = toxicity.score(docs.where("doc_id >= 23000 or doc_id < 500"), model).toPandas()
    assert (out["toxic"] == ((out["key"] >= 20_000) | (out["key"] % 2 == 1))).mean() > 0.95


def test_toxicity_shuffles_a_row_a_file_and_not_a_part(spark, make_docs, monkeypatch):
    """The parts of a file are summed before they are shuffled, and the outcome is the mean of what each part makes of the model."""
    rng = random.Random(11)
    rows = [(i, " ".join([*words(rng, 20), *(["moron"] if i % 2 else [])])) for i in range(3_000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    by_groups, shuffled, told = C.by_groups, [], []

    def counted(df, keys, *more, **named):
        shuffled.append(df.groupBy("chunk").count().agg(F.max("count")).first()[0])
        return by_groups(df, keys, *more, **named)

    def plain(words, t, epoch, files):
        kept, before, after = words.toPandas().sort_values("part", kind="stable"), t.copy(), []
        for part, g in kept.groupby("part"):
            own = t.copy()
            ids = [np.frombuffer(x, np.int32).reshape(-1, 1 + len(toxicity.PREFIXES)) for x in g["words"]]
            after.append((own, toxicity.pass_over(own, ids, g["label"].to_numpy(np.float64), np.random.default_rng([t.m.settings.seed, epoch, part]))))
        told.append((len(after), files))
        once(words, t, epoch, files)
        n = sum(seen.astype(int) for _, seen in after)
        mean = lambda f: f(before) + sum((f(own) - f(before)) * seen[:, None] for own, seen in after) / np.maximum(n, 1)[:, None]
        assert np.allclose(t.m.embedding, mean(lambda x: x.m.embedding), atol=1e-5) and np.allclose(t.gain[0], mean(lambda x: x.gain[0]), atol=1e-5)
        assert np.allclose(t.dense(), np.mean([own.dense() for own, _ in after], 0), atol=1e-5)

    once = toxicity._round
    monkeypatch.setattr(C, "by_groups", counted)
    monkeypatch.setattr(toxicity, "_round", plain)
    toxicity.fit(make_docs(rows), labels, settings=toxicity.Settings(part_bytes=12_000, epochs=1))
    (parts, files), = told
    assert parts > 30 and files == -(-parts // 4) and shuffled == [files]


def test_thresholds_by_ranges(spark):
    rng = np.random.default_rng(3)
    z, y, g = rng.normal(0, 1, 3000).round(2), rng.integers(0, 2, 3000), rng.choice(["", "en", "de"], 3000)
    z += y
    got = toxicity.thresholds(spark.createDataFrame([(a, float(b), int(c)) for a, b, c in zip(g.tolist(), z, y)], "language string, z double, label int"))

    def best(z, y):
        at = sorted(set(z), reverse=True)
        f1 = [2 * y[z >= a].sum() / ((z >= a).sum() + y.sum()) for a in at]
        i = int(np.argmax(f1))
        return (at[i] + at[i + 1]) / 2

    assert got == {"": best(z, y)} | {x: best(z[g == x], y[g == x]) for x in ("en", "de")}


def test_languages():
    texts = [b"the cat and the dog of it", "der Hund und die Katze für".encode(), b"les chats et des chiens pour", b"los gatos y el perro con una", b"xyz"]
    _, _, h, first = C.hash_words(texts, C.NOT_ALNUM)
    assert list(toxicity.languages(h, first)) == ["en", "de", "fr", "es", ""]


def test_index_has_small_row_groups(spark):
    """A reader's batch ends with its row group, so however many blocks a task writes, few are read at once."""
    import glob

    import pyarrow.parquet as pq

    texts = F.transform(F.sequence(F.lit(1), F.lit(120)), lambda i: F.md5(F.concat_ws(" ", "id", i)))
    index = search.build(spark.range(0, 6400, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(texts, " ").alias("text")))
    files = [pq.ParquetFile(f).metadata for f in glob.glob(index.rows._scratch.removeprefix("file://") + "/*.parquet")]
    assert sum(m.num_rows for m in files) >= 200 and max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= 100
