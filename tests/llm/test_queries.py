"""The registered corpus queries, over small tables with odd rows, against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from ledgerline.llm import decontaminate, licenses, queries, secrets
from ledgerline.llm.oracles import oracle_sql

from .conftest import words
from .test_lexical import ranking
from .test_search import _edited, _roots
from .test_small import BASE, SECRETS


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, odd_texts):
    """A folder of tables; the documents' odd rows are all there: null key, repeated rows, one key with two texts."""
    rng = random.Random(77)
    path = str(tmp_path_factory.mktemp("tables"))
    base, passage = words(rng, 80), words(rng, 60)
    items = [(i, " ".join(words(rng, 20)) + ". " + " ".join(words(rng, 6)) + ".") for i in range(12)] + [(50, None), (51, "")]
    texts = list(odd_texts) + [(8, "another text of key eight " + " ".join(words(rng, 9)))]
    texts += [(100 + i, " ".join(_edited(rng, base, i % 4))) for i in range(12)]
    texts += [(200 + i, " ".join(words(rng, 30 + i) + passage + words(rng, 20))) for i in range(5)]
    texts += [(300 + i, " ".join(words(rng, 50)) + " " + items[i][1] + " " + " ".join(words(rng, 30))) for i in range(6)]
    texts += [(400 + i, t) for i, t in enumerate(SECRETS)] + [(420, "Under the MIT License and under the terms " * 4), (421, "under the terms " * 4), (422, licenses.TEMPLATES[3].phrase)]
    texts += [(500 + i, " ".join(words(rng, 40) + (["idiot", "moron"] if i % 3 == 0 else []))) for i in range(150)]
    docs = [(i, t, ["en", "de", None][n % 3], "src0" if n % 3 else None, len(t or "")) for n, (i, t) in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 500 % 3)) for i in range(500, 650)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    v = np.random.default_rng(5)
    centres = v.normal(size=(12, 32))
    vectors = [(i, (centres[i % 12] + v.normal(size=32) * 0.12).astype(np.float32).tolist(), i % 2) for i in range(150)]
    vectors += [(200 + i, vectors[0][1], 0) for i in range(40)] + [(300, None, 0), (301, [0.0] * 32, 0), (302, vectors[0][1], None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def _rows(spark, sf, name):
    return queries.queries()[name](spark, sf).collect()


def test_names():
    assert sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))[0].startswith("op1_") and len(queries.queries()) == 13
    assert set(oracle_sql()) <= set(queries.queries())


def test_op1(spark, sf, docs):
    out = _rows(spark, sf, "op1_bounded_ring")
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    load, largest = Counter(), max(size(t) for _, t, *_ in docs)
    for r in out:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.002 * sum(load.values()) / 16 + largest


def test_op2(spark, sf, docs):
    got = {(r["doc_id"], r["item_id"]) for r in _rows(spark, sf, "op2_wand_decontamination")}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r["text"]}
    tokens = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for i, t, *_ in docs:
        for item, x in items.items():
            parts = [tokens(p) for p in decontaminate.split_item(x)]
            shares = [len(g & grams(tokens(t or ""), min(5, len(p)))) / len(g) for p in parts if (g := grams(p, min(5, len(p))))]
            if min(shares) >= 0.8:
                want.add((i, item))
    assert got == want and len(want) == 6


def test_op2_scores_do_not_depend_on_the_index_size(spark, sf):
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark")]
    scores = [{(r["key"], r["item"]): round(r["score"], 9) for r in decontaminate.leaks(*tables, s=decontaminate.Settings(shard_items=n)).collect()} for n in (20_000, 5)]
    assert scores[0] == scores[1] and len(scores[0]) == 6


def test_op3(spark, sf, docs):
    every = [(r.kind, re.compile(r.pattern, re.A), r.group, r.least) for r in secrets.RULES]

    def spans(t, rules):
        found = sorted((m.start(), o, kind, m.end()) for o, (kind, rx, g, least) in enumerate(rules) for m in rx.finditer(t or "") if len(m.group(g)) >= least)
        return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)

    want = Counter()
    for i, t, *_ in docs:
        own = spans(t, BASE)
        want[(i, *(len(re.findall(rf"{k}:", own)) for k in ("assign", "access", "hex")), hashlib.sha256(own.encode()).hexdigest(), spans(t, every))] += 1
    assert Counter(tuple(r) for r in _rows(spark, sf, "op3_trigram_secrets")) == want


def test_op4(spark, sf):
    rows = {r["vec_id"]: r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    unit = {i: np.array(r["embedding"], float) / n for i, r in rows.items() if r["embedding"] and r["label"] is not None and (n := np.linalg.norm(np.array(r["embedding"], float)))}
    links = [(a, b) for a in unit for b in unit if a < b and rows[a]["label"] == rows[b]["label"] and unit[a] @ unit[b] >= 0.93]
    root, n = _roots(rows, links), Counter(x for p in links for x in p)
    assert len(links) > 500
    assert {tuple(r) for r in _rows(spark, sf, "op4_quantised_embeddings")} == {(i, n[i], root[i], root[i] == i) for i in rows}


def test_op5(spark, sf, docs):
    sets = []
    for _, t, *_ in docs:
        w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + 2]) for j in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} - {()})
    links = [(docs[a][0], docs[b][0]) for a in range(len(docs)) for b in range(a) if None not in (docs[a][0], docs[b][0]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = _roots({d[0] for d in docs if d[0] is not None}, links)
    want = Counter((d[0], len(x), root.get(d[0]), d[0] is not None and root[d[0]] == d[0]) for d, x in zip(docs, sets, strict=True))
    assert Counter(tuple(r) for r in _rows(spark, sf, "op5_bayesian_minhash")) == want


def test_op6(spark, sf, docs):
    out = defaultdict(list)
    for r in _rows(spark, sf, "op6_diagonal_licenses"):
        out[r["doc_id"]].append(r)
    assert sum(map(len, out.values())) == len(docs)
    for i, t, *_ in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, x.label) for x in licenses.TEMPLATES[:3] for k in range(len(w)) if w[k : k + len(x.phrase.split())] == x.phrase.split()]
        places = sorted(k for k, _ in at)
        want = (len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted({n for _, n in at})))
        assert want in [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out[i]]
        assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in out[i])
    assert out[420][0]["n_base"] == 4 and out[421][0]["labels"] == "" and out[421][0]["score"] < 0.3 and out[422][0]["labels"] == "mit"


def test_op7(spark, sf, docs):
    tiktoken = pytest.importorskip("tiktoken")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = defaultdict(lambda: [0, 0])
    for _, t, lang, source in docs:
        want[(source, lang)][0] += 1
        want[(source, lang)][1] += len(enc.encode_ordinary(t or ""))
    got = _rows(spark, sf, "op7_token_rollup")
    assert {(r["source"], r["lang"]): [r["docs"], r["tokens"]] for r in got} == dict(want)


def test_op8(spark, sf, docs):
    out = _rows(spark, sf, "op8_convolutional_toxicity")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert Counter((r["doc_id"], r["held_out"]) for r in out) == Counter((i, held(i)) for i, *_ in docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    test = [r for r in out if r["doc_id"] is not None and r["doc_id"] >= 500 and r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 500 % 3) for r in test) >= 0.9 * len(test)


def test_op9(spark, sf, docs):
    out = _rows(spark, sf, "op9_compact_windows")
    tokens = {}
    for i, t, *_ in docs:
        if i is not None:
            tokens.setdefault(i, []).append(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()))
    where = defaultdict(set)
    for i, parts in tokens.items():
        for w in parts:
            for k in range(len(w) - 49):
                where[tuple(w[k : k + 50])].add(i)
    exact = {i for ids in where.values() if len(ids) > 1 for i in ids}
    near = {*range(100, 112), *range(200, 205)}
    assert exact <= {r["doc_id"] for r in out} <= near and near - exact <= {r["doc_id"] for r in out}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for r in out:
        if not r["kept"]:
            own = tokens[r["doc_id"]][0][r["first_word"] : r["end_word"]]
            assert len(own) >= 50 and len(grams(own) & grams(tokens[r["first_doc_id"]][0])) >= 0.75 * len(grams(own)) and r["first_doc_id"] < r["doc_id"]


def test_op10(spark, sf, docs):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = _rows(spark, sf, "op10_histogram_packing")
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t, *_ in docs]
    of = defaultdict(list)
    for i, x in ids:
        of[(i, len(x))].append(x)
    for r in out:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in of[(r["doc_id"], r["doc_tokens"])]) and 0 < r["length"] <= 2048
    assert sum(r["length"] for r in out) == sum(len(x) for _, x in ids)
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 2048
    fill = sum(n for s in seqs.values() for _, n in s) / (2048 * len(seqs))
    assert fill >= 0.95 or len(seqs) == -(-sum(len(x) for _, x in ids) // 2048)


def test_op11(spark, sf, docs):
    tiktoken = pytest.importorskip("tiktoken")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, *_ in docs:
        ids = enc.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in _rows(spark, sf, "op11_two_tier_bpe")) == want


def test_op12(spark, sf, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = ranking([(i, t) for i, t, *_ in docs], items, 20)
    assert Counter(tuple(r) for r in _rows(spark, sf, "op12_block_max_search")) == want and sum(want.values()) > 100


def test_op13(spark, sf, docs):
    def buckets(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return [zlib.crc32(w.encode()) % 10_000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]

    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = [(i, buckets(t)) for i, t, *_ in docs]
    s, t = Counter(b for _, x in own for b in x), Counter(b for x in items for b in buckets(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)}
    want = []
    for i, x in own:
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted(((-r[3], r[0] is None, r[0] or 0) for r in want if r[1] >= 20))
    out = _rows(spark, sf, "op13_importance_resampling")
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in out) == Counter(want)
    drawn = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in out if r["rank"])
    assert [r[1:] for r in drawn] == able[: 10 * len(able) // 100] and [r[0] for r in drawn] == list(range(1, len(drawn) + 1)) and len(drawn) > 10
