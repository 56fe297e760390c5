"""A convolutional text classifier: hashed word embeddings, filters of several widths and max pooling, trained part by part on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: Frequent words by which a text's language is told, so that thresholds need no language column (fixed values).
LANGUAGE_WORDS = {
    "en": "the of and to in is that it was for on are with as be at this by from not".split(),
    "de": "der die und das den ist von zu mit sich auf für nicht ein eine dem im es auch".split(),
    "fr": "le les et des est que une dans qui pour pas au sur avec ce il par plus ne".split(),
    "es": "el los del que y en un por con para una las su al lo como más pero sus".split(),
}


@dataclass
class Settings:
    buckets: int = 1 << 22
    min_docs: int = 15  # features of fewer training texts keep the embedding of unknown ones, zero; for under 3000 texts, a 200th of them
    share: int = 200  # and so do those in under a 200th of the texts of either label, which bounds the model whatever the number of texts
    size: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 10
    rate: float = 0.1
    decay: float = 1e-3
    seed: int = 7
    sample_bytes: int = 16_000_000  # a single text beyond it isn't fitted on
    part_bytes: int = 8_000_000  # of the texts that are fitted on one after the other, about
    together: int = 4  # parts of one file, whose outcomes are summed before they are shuffled; up to 8 parts lie in files of their own
    steps: int = 500  # of 32 texts in every part, after which further epochs (three at least) are left out


@dataclass
class Model:
    """rows: bucket of each embedding; w[i]: (width, size, filters); thresholds: logit by language, "" for others."""

    settings: Settings
    buckets: np.ndarray
    embedding: np.ndarray
    w: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def table(self) -> np.ndarray:
        t = np.zeros(self.settings.buckets + 1, np.int32)
        t[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return t


#: Bytes of the prefixes that stand for a word beside the word itself, so that inflected forms share embeddings.
PREFIXES = (2, 3, 4, 5, 6, 7)


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the buckets of each word and its prefixes (a row for each word; `buckets`: none), word hashes, each text's first word."""
    start, stop, h, first = C.hash_words(texts, C.NOT_ALNUM)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    out = np.full((len(h), 1 + len(PREFIXES)), buckets, np.int32)
    out[:, 0] = h % np.uint64(buckets)
    total = np.zeros(len(h), np.uint64)
    for j in range(max(PREFIXES)):
        inside = start + j < stop
        total += C.BYTE[buf[np.minimum(start + j, len(buf) - 1)]] * C.POW[j]
        if j + 1 in PREFIXES:
            out[inside, 1 + PREFIXES.index(j + 1)] = (C.mix(total[inside] + C.POW[100 + j]) % np.uint64(buckets)).astype(np.int32)
    return out, h, first


def _embed(m: Model, ids: np.ndarray) -> np.ndarray:
    e = m.embedding[ids[:, 0]]
    for j in range(1, ids.shape[1]):
        e += m.embedding[ids[:, j]]
    return e


def _pad(rows: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' rows in one array with `pad` unknown words after each; where windows of each text begin, and where they stop.

    A text's windows begin at its words and at its first padding word, so an empty text has one too and none reaches
    into the next text.
    """
    sizes = np.diff(first)
    starts = first[:-1] + pad * np.arange(len(sizes))
    out = np.zeros((len(rows) + pad * len(sizes), rows.shape[1]), rows.dtype)
    out[np.arange(len(rows)) + pad * np.repeat(np.arange(len(sizes)), sizes)] = rows
    return out, starts, starts + sizes + 1


def _responses(m: Model, e: np.ndarray) -> list[np.ndarray]:
    out = []
    for w in m.w:
        n = len(e) - len(w) + 1
        y = e[:n] @ w[0]
        for j in range(1, len(w)):
            y += e[j : n + j] @ w[j]
        out.append(y)
    return out


def logits(m: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each text, weighed."""
    ids, starts, stops = _pad(rows, first, max(m.settings.widths))
    tops = []
    for y, b in zip(_responses(m, _embed(m, ids)), m.b, strict=True):
        edges = np.stack([starts, stops], 1).ravel()
        if edges[-1] == len(y):
            edges = edges[:-1]
        tops.append(np.maximum.reduceat(y, edges, axis=0)[::2] + b)
    x = np.concatenate(tops, 1)
    return np.maximum(x, 0.01 * x) @ m.out + m.bias


@dataclass
class Training:
    """A model and its sums of squared gradients, as they are handed from round to round."""

    m: Model
    gain: list[np.ndarray]
    weight: tuple[float, float]  # of a text, by its label

    def params(self) -> list[np.ndarray]:
        return [self.m.embedding, self.m.out, *self.m.w, *self.m.b]

    def copy(self) -> Training:
        m = self.m
        own = Model(m.settings, m.buckets, m.embedding.copy(), [w.copy() for w in m.w], [b.copy() for b in m.b], m.out.copy(), m.bias)
        return Training(own, [g.copy() for g in self.gain], self.weight)

    def dense(self) -> np.ndarray:
        """All but the embedding: the parameters and their gains, in one row."""
        return np.concatenate([[self.m.bias], *(x.ravel() for x in (*self.params()[1:], *self.gain[1:]))]).astype(np.float64)

    def set_dense(self, row: np.ndarray) -> None:
        self.m.bias, at = float(row[0]), 1
        for x in (*self.params()[1:], *self.gain[1:]):
            x[...] = row[at : at + x.size].reshape(x.shape)
            at += x.size


def begin(kept: np.ndarray, n: tuple[int, int], s: Settings) -> Training:
    """An untrained model of the kept buckets; n: training texts by label. With texts of one label only, none is toxic."""
    rng = np.random.default_rng(s.seed)
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    emb = f32(len(kept) + 1, s.size, scale=0.3)
    emb[0] = 0
    m = Model(s, kept, emb, [f32(k, s.size, s.filters, scale=0.3) for k in s.widths], [np.zeros(s.filters, np.float32) for _ in s.widths], f32(s.filters * len(s.widths), scale=0.3), 0.0)
    if not all(n):
        m.out[:], m.bias = 0, -4.0
        m.thresholds = {"": 0.0}
    t = Training(m, [], tuple(0.5 * sum(n) / max(x, 1) for x in n))
    t.gain = [np.full(p.shape, 1e-3, np.float32) for p in t.params()] + [np.full(1, 1e-3)]
    return t


#: Windows whose responses are worked out at once, however long a text is.
_WINDOWS = 1 << 15


def _peaks(m: Model, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each width: where each text's filters respond most, (texts, filters); and those responses, biases added, side by side."""
    deep, n = max(m.settings.widths), int(stops[-1])
    at = [np.zeros((len(starts), m.settings.filters), np.int64) for _ in m.w]
    top = [np.full((len(starts), m.settings.filters), -np.inf, np.float32) for _ in m.w]
    for a in range(0, n, _WINDOWS):
        b = min(n, a + _WINDOWS)
        ys = _responses(m, _embed(m, ids[a : b + deep - 1]))
        for d in range(np.searchsorted(stops, a, "right"), np.searchsorted(starts, b)):
            lo, hi = max(starts[d], a), min(stops[d], b)
            if lo >= hi:
                continue
            for k, y in enumerate(ys):
                part = y[lo - a : hi - a]
                peak = part.argmax(0)
                value = part[peak, np.arange(part.shape[1])]
                more = value > top[k][d]
                at[k][d, more], top[k][d, more] = lo + peak[more], value[more]
    return at, np.concatenate([t + b for t, b in zip(top, m.b, strict=True)], 1)


def pass_over(t: Training, rows: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One epoch over some texts (the model's rows of each word), in place; which rows of the embedding it touched."""
    m, s = t.m, t.m.settings
    params, weight, deep = t.params(), np.array(t.weight)[labels.astype(int)], max(s.widths)
    seen = np.zeros(len(m.embedding), bool)

    def step(i: int, g: np.ndarray, at: np.ndarray | None = None) -> None:
        p, q = params[i], t.gain[i]
        if at is None:
            q += g * g
            p -= s.rate * (g / np.sqrt(q) + s.decay * p)
        else:
            u, inv = np.unique(at, return_inverse=True)
            total = np.zeros((len(u), g.shape[1]), np.float32)
            np.add.at(total, inv, g)
            q[u] += total * total
            p[u] -= s.rate * (total / np.sqrt(q[u]) + s.decay * p[u])
            p[0] = 0
            seen[u] = True

    order = rng.permutation(len(rows))
    for k in range(0, len(order), 32):
        part = order[k : k + 32]
        first = np.cumsum([0] + [len(rows[i]) for i in part])
        ids, starts, stops = _pad(np.concatenate([rows[i] for i in part]), first, deep)
        peaks, x = _peaks(m, ids, starts, stops)
        act = np.maximum(x, 0.01 * x)
        z = np.clip(act @ m.out + m.bias, -30, 30)
        g = ((1 / (1 + np.exp(-z)) - labels[part]) * weight[part] / len(part)).astype(np.float32)
        back = g[:, None] * m.out[None, :] * np.where(x > 0, 1, 0.01).astype(np.float32)
        touched, moved = [], []
        for i, (w, peak) in enumerate(zip(m.w, peaks, strict=True)):
            own = back[:, i * s.filters : (i + 1) * s.filters]
            dw = np.zeros_like(w)
            for j in range(len(w)):
                at = ids[peak + j]
                dw[j] = np.einsum("df,dfs->sf", own, _embed(m, at.reshape(-1, at.shape[-1])).reshape(*peak.shape, s.size))
                touched.append(at.ravel())
                moved.append(np.repeat((own[:, :, None] * w[j].T[None]).reshape(-1, s.size), ids.shape[1], 0))
            step(2 + i, dw)
            step(2 + len(m.w) + i, own.sum(0))
        step(1, act.T @ g)
        t.gain[-1] += float(g.sum()) ** 2
        m.bias -= s.rate * float(g.sum()) / float(t.gain[-1][0]) ** 0.5
        step(0, np.concatenate(moved), np.concatenate(touched))
    seen[0] = False
    return seen


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """The words and labels of one part after the other; a part's rows lie together in one file, and so come together."""
    now, texts, labels = None, [], []
    for batch in batches:
        for p, y, x in zip(*(batch.column(c).to_pylist() for c in ("part", "label", "words")), strict=True):
            if p != now and texts:
                yield now, texts, np.array(labels, np.float64)
                texts, labels = [], []
            now = p
            texts.append(x)
            labels.append(y)
    if texts:
        yield now, texts, np.array(labels, np.float64)


#: Embedding rows that are averaged together.
_CHUNK = 256


def _moves(words: DataFrame, t: Training, epoch: int, files: int) -> DataFrame:
    """(chunk, file, at, n, moved): what one pass over each part, all from the same model, does to the parameters.

    Summed over the parts of a file, so what is shuffled grows with the files; n: how many of the parts touched each row. Which
    parts a file has depends on their number only, so sums don't depend on how files are dealt to tasks.
    """
    shared = words.sparkSession.sparkContext.broadcast(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = shared.value
        s = old.m.settings
        for file, parts in groupby(_by_part(batches), lambda x: x[0] % files):
            total, n = np.zeros((len(old.m.embedding), 2 * s.size), np.float32), np.zeros(len(old.m.embedding), np.int32)
            dense, passed = 0.0, 0
            for part, texts, labels in parts:
                own = old.copy()
                rows = [np.frombuffer(x, np.int32).reshape(-1, 1 + len(PREFIXES)) for x in texts]
                at = np.flatnonzero(pass_over(own, rows, labels, np.random.default_rng([s.seed, epoch, part])))
                total[at] += np.concatenate([own.m.embedding[at] - old.m.embedding[at], own.gain[0][at] - old.gain[0][at]], 1)
                n[at] += 1
                dense, passed = dense + own.dense(), passed + 1
            at = np.flatnonzero(n)
            cut = np.flatnonzero(np.diff(at // _CHUNK, prepend=-1))
            chunks = [(int(a[0]) // _CHUNK, a.astype(np.int32).tobytes(), n[a].tobytes(), total[a].tobytes()) for a in np.split(at, cut[1:]) if len(a)]
            chunks.append((-1, b"", np.array([passed], np.int32).tobytes(), dense.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([x[0] for x in chunks], [file] * len(chunks), *([x[i] for x in chunks] for i in (1, 2, 3)))], names=["chunk", "file", "at", "n", "moved"])

    out = words.mapInArrow(run, "chunk long, file long, at binary, n binary, moved binary")
    out._shared = shared
    return out


def _round(words: DataFrame, t: Training, epoch: int, files: int) -> None:
    """Every part is passed over once; then parameters become the mean of what the parts made of them. A row of the embedding
    is averaged over the parts that touched it, by chunks of rows on the executors."""
    size = 2 * t.m.settings.size

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, g in pdf.groupby("chunk", sort=False):
            if chunk < 0:
                dense = np.sum([np.frombuffer(x) for x in g["moved"]], 0) / sum(int(np.frombuffer(x, np.int32)[0]) for x in g["n"])
                out.append((chunk, b"", dense.tobytes()))
                continue
            total, n = np.zeros((_CHUNK, size)), np.zeros(_CHUNK)
            for at, k, x in zip(g["at"], g["n"], g["moved"], strict=True):
                i = np.frombuffer(at, np.int32) - chunk * _CHUNK
                total[i] += np.frombuffer(x, np.float32).reshape(-1, size)
                n[i] += np.frombuffer(k, np.int32)
            i = np.flatnonzero(n)
            out.append((chunk, (i + chunk * _CHUNK).astype(np.int32).tobytes(), (total[i] / n[i, None]).astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "at", "moved"])

    moves = _moves(words, t, epoch, files)
    # the model comes to the driver once a round; its size is bounded by Settings.share
    for r in C.by_groups(moves, ["chunk"], ["file"], mean, "chunk long, at binary, moved binary", rows=64).collect():
        if r["chunk"] < 0:
            t.set_dense(np.frombuffer(r["moved"]))
            continue
        at, moved = np.frombuffer(r["at"], np.int32), np.frombuffer(r["moved"], np.float32).reshape(-1, size)
        t.m.embedding[at] += moved[:, : size // 2]
        t.gain[0][at] += moved[:, size // 2 :]
    moves._shared.destroy()


def _kept(sample: DataFrame, n: tuple[int, int], s: Settings) -> np.ndarray:
    """The features that get an embedding, from counts over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, s.buckets), np.int32)
        for batch in batches:
            for y, x in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = np.unique(features([x], s.buckets)[0])
                count[y, found[found < s.buckets]] += 1
        at = np.flatnonzero(count.any(0))
        for i in range(0, len(at), 1 << 16):
            b = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(b), *(pa.array(c[b].astype(np.int64)) for c in count)], names=["bucket", "n0", "n1"])

    found = sample.where("not held").select("label", "text").mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    often = (F.col("n0") + F.col("n1") >= min(s.min_docs, max(4, sum(n) // 200))) & ((F.col("n0") * s.share >= max(n[0], 1)) | (F.col("n1") * s.share >= max(n[1], 1)))
    return np.sort(found.where(often).select("bucket").toPandas()["bucket"].to_numpy(np.int64))


def _words(sample: DataFrame, m: Model) -> DataFrame:
    """(part, label, words): the training texts, written as the model's rows of each word."""
    shared = sample.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, table = shared.value.settings, shared.value.table()
        for batch in batches:
            for part, texts in C.blocks(batch, "text"):
                rows = pa.array([table[features([x], s.buckets)[0]].tobytes() for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows], names=["part", "label", "words"])

    # files keep whole parts in one row group, one after the other, as above
    return C.materialise(sample.where("not held").select("part", "label", "text").mapInArrow(run, "part long, label int, words binary"), "toxic-words", 1 << 30)


def thresholds(rows: DataFrame) -> dict[str, float]:
    """By language, and "" for all: the logit that parts the labels with the highest F1, half-way to the next lower one.

    rows: (language, z, label). A language with under 10 texts of a label takes the common one. Rows are ranked by
    ranges of logits, so no task and no driver holds all of them.
    """
    spark = rows.sparkSession
    every = rows.select(F.explode(F.array_distinct(F.array(F.lit(""), "language"))).alias("g"), "z", F.col("label").cast("long").alias("y"))
    every = every.groupBy("g", "z").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    every = C.materialise(every.repartitionByRange(C.width(spark), "g", F.desc("z")).withColumn("p", F.spark_partition_id()), "toxic-logits")
    total = every.groupBy("g").agg(F.sum("n").alias("all_n"), F.sum("y").alias("all_y"), F.min("z").alias("least"))
    before = every.groupBy("g", "p").agg(F.sum("n").alias("pn"), F.sum("y").alias("py"))
    w = Window.partitionBy("g").orderBy("p")  # a row for each language and range
    before = before.select("g", "p", (F.sum("pn").over(w) - F.col("pn")).alias("pn"), (F.sum("py").over(w) - F.col("py")).alias("py"))
    w = Window.partitionBy("g", "p").orderBy(F.desc("z"))
    rank = every.select("g", "p", "z", F.sum("n").over(w).alias("n"), F.sum("y").over(w).alias("y"))
    rank = rank.join(F.broadcast(before), ["g", "p"]).join(F.broadcast(total), "g")  # languages times ranges
    f1 = 2 * (F.col("y") + F.col("py")) / (F.col("n") + F.col("pn") + F.col("all_y"))
    enough = F.when(F.col("g") == "", 1).otherwise(10)
    best = rank.where((F.col("all_y") >= enough) & (F.col("all_n") - F.col("all_y") >= enough)).groupBy("g").agg(F.max(F.struct(f1.alias("f1"), "z")).alias("best"))
    best = best.select("g", F.col("best.z").alias("top"))
    lower = every.join(F.broadcast(best), "g").groupBy("g", "top").agg(F.max(F.when(F.col("z") < F.col("top"), F.col("z"))).alias("next"))
    out = {"": 0.0} | {r["g"]: (r["top"] + r["next"]) / 2 if r["next"] is not None else r["top"] - 1 for r in lower.collect()}
    C.discard(every)
    return out


def _language_rows() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, i) for i, ws in enumerate(LANGUAGE_WORDS.values()) for w in ws]
    h = C.hash_words([w.encode() for w, _ in words], C.NOT_ALNUM)[2]
    order = np.argsort(h)
    return h[order], np.array([i for _, i in words])[order]


def languages(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The language with the most frequent words in each text; "" without any."""
    known, code = _language_rows()
    at = np.searchsorted(known, h).clip(max=len(known) - 1)
    hit = np.flatnonzero(known[at] == h)
    doc = np.searchsorted(first, hit, "right") - 1
    k = len(LANGUAGE_WORDS)
    votes = np.bincount(doc * k + code[at[hit]], minlength=(len(first) - 1) * k).reshape(-1, k)
    return np.where(votes.sum(1) > 0, np.array(list(LANGUAGE_WORDS))[votes.argmax(1)], "")


#: Labelled keys up to which they are broadcast; beyond, texts meet their labels by a shuffle.
_BROADCAST = 1_000_000


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings | None = None) -> Model:
    """Train on all labelled texts.

    A key's label is its largest one and its text its smallest one, so repeated rows count once; null labels and keys that
    docs lack don't count, nor does a single text of more than `sample_bytes`. Texts are dealt by their keys' hashes into
    parts of about `part_bytes`, and those into files that tasks fit on side by side, epoch by epoch (`_round`). The texts of a fifth of the
    keys aren't fitted on but set the thresholds. Without labelled texts of both labels, no text is toxic.
    """
    s = settings or Settings()
    C.small_batches(docs.sparkSession)
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label")).where("label in (0, 1)")
    own = C.materialise(own, "toxic-labels")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.join(F.broadcast(own) if own.count() <= _BROADCAST else own, "key").withColumn("h", F.xxhash64("key"))
    size = F.octet_length("text")
    total = rows.agg(F.sum(F.when(size <= s.sample_bytes, size))).first()[0] or 0
    parts = 1 + total // s.part_bytes
    files = max(min(parts, 8), -(-parts // s.together))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts))).withColumn("file", (F.col("part") % files).cast("int"))
    dealt = dealt.repartitionById(files, "file").groupBy("file", "part", "h", "key", "label").agg(F.min("text").alias("text")).where(size <= s.sample_bytes)
    held = F.pmod(F.shiftright(F.xxhash64("h", F.lit(1)), 8), F.lit(5)) == 0
    # a file's rows are in one row group, so a task has all of its parts
    sample = C.materialise(dealt.select("part", "h", "label", held.alias("held"), "text").sortWithinPartitions("part", "h", "label"), "toxic-texts", 1 << 30)
    n = {r["label"]: r["n"] for r in sample.where("not held").groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = n.get(0, 0), n.get(1, 0)
    t = begin(_kept(sample, n, s) if all(n) else np.zeros(0, np.int64), n, s)
    if all(n):
        words, each = _words(sample, t.m), -(-sum(n) // (32 * parts))
        for epoch in range(min(s.epochs, max(3, -(-s.steps // each)))):
            _round(words, t, epoch, files)
        t.m.thresholds = thresholds(_scores(sample.where("held"), t.m, ["label"]).select("language", F.col("logit").alias("z"), "label"))
        C.discard(words)
    C.discard(sample, own)
    return t.m


def _scores(rows: DataFrame, m: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns to keep, each text's language and its logit."""
    shared = rows.sparkSession.sparkContext.broadcast(m)  # its size is bounded by Settings.share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.table()
        for batch in batches:
            for part, texts in C.blocks(batch, text):
                ids, h, first = features(texts, m.settings.buckets)
                z = logits(m, table[ids], first).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(languages(h, first), pa.string()), pa.array(z)], names=[*keep, "language", "logit"])

    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(*keep, text).mapInArrow(run, f"{kept}language string, logit double")


def score(docs: DataFrame, m: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, logit, score, toxic) for every row. score is 0.5 at the threshold of the text's language.

    Null and empty texts are scored as texts without words. Equal texts have equal scores. Other columns are ignored.
    """
    C.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(m)  # its size is bounded by Settings.share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.table()
        for batch in batches:
            for part, texts in C.blocks(batch, "text"):
                ids, h, first = features(texts, m.settings.buckets)
                lang = languages(h, first)
                z = logits(m, table[ids], first).astype(np.float64)
                by = np.array([m.thresholds.get(x, m.thresholds[""]) for x in lang])
                p = 1 / (1 + np.exp(-np.clip(z - by, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(z), pa.array(p), pa.array(p >= 0.5)], names=["key", "language", "logit", "score", "toxic"]
                )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, language string, logit double, score double, toxic boolean")


def without_toxic(docs: DataFrame, m: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores under 0.5. No shuffle: each row is judged where it is read."""
    C.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.table()
        for batch in batches:
            for part, texts in C.blocks(batch, text):
                ids, h, first = features(texts, m.settings.buckets)
                by = np.array([m.thresholds.get(x, m.thresholds[""]) for x in languages(h, first)])
                yield part.filter(pa.array(logits(m, table[ids], first) < by, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
