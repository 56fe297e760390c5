"""Near-duplicate passages by compact windows over min-hashed shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    words: int = 50  # the shortest passage
    similarity: float = 0.8
    variety: int = 23  # distinct shingles that a passage needs, half of a run: a word said fifty times is no passage
    hashes: int = 4
    enough: int = 2  # hash functions that must agree on a run; at 0.8 they don't once in 37 times, for exact repeats never
    closer: int = 5  # hash functions whose pairs name the runs of a text once more, see closer
    settled: float = 0.9  # passages confirmed so well are followed by exact names only
    drift: int = 32  # words by which matches of one passage may be shifted against each other
    grid: int = 64
    together: int = 1024  # spans that are held against one copy of a first text's cut

    @property
    def run(self) -> int:
        return self.words - self.shingle + 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_A = np.random.default_rng(97).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 20) - 1)


def _sliding_min(v: np.ndarray, t: int) -> np.ndarray:
    """The minimum of each t neighbours: prefix and suffix minima of chunks of t."""
    n = len(v)
    padded = np.full(-(-n // t) * t, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    chunks = padded.reshape(-1, t)
    left = np.minimum.accumulate(chunks, 1).ravel()
    right = np.minimum.accumulate(chunks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - t + 1], left[t - 1 : n])


def windows(g: np.ndarray, first: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Compact windows of all texts: (text, function, key, begin, end, at), in shingles of the text.

    A node of the Cartesian tree over a text's hashes rules the runs of s.run shingles of which it is the minimum. These
    runs' starts are neighbours, so they are one window, named by the node's hash: two texts with a run in common have
    windows of that name around it. Nodes that rule no run of this length can't be needed, and the others are found as
    minima of sliding runs, without the tree. Ties go to the leftmost.
    """
    t, out = s.run, []
    sizes = np.diff(first)
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(g)) - first[doc_of] if len(g) else np.zeros(0, np.int64)
    if len(g) < t:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    low = place.astype(np.uint64) & _LOW
    whole = doc_of[: len(g) - t + 1] == doc_of[t - 1 :]
    for h in range(s.hashes):
        value = C.mix(g * _A[h])
        m = _sliding_min((value & ~_LOW) | low, t)
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (doc_of[1 : len(m)] != doc_of[: len(m) - 1])
        head = np.flatnonzero(new)
        stop = np.append(head[1:], len(m))
        # a text's last starts have runs that reach into the next text: cut them off
        ends = first[1:][doc_of[head]] - t + 1
        stop = np.minimum(stop, ends)
        ok = whole[head] & (stop > head)
        head, stop = head[ok], stop[ok]
        d = doc_of[head]
        at = head + (((m[head] & _LOW) - low[head]) & _LOW).astype(np.int64)
        out.append((d, np.full(len(d), h), (value[at] ^ _A[h]).view(np.int64), head - first[d], stop - 1 + t - first[d], at - first[d]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in one array, and each text's first."""
    _, _, h, first = C.hash_words(texts, C.NOT_ALNUM)
    g = C.grams(h, k)
    keep = np.ones(len(g), bool)
    for b in first[1:-1].tolist():
        keep[max(0, b - k + 1) : b] = False
    counts = np.maximum(np.diff(first) - k + 1, 0)
    heads = np.concatenate(([0], np.cumsum(counts)))
    return g[keep][: heads[-1]], heads


def _windows(docs: DataFrame, s: Settings) -> DataFrame:
    """docs: (id, text). (w, f, id, lo, hi, at) for each compact window."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in C.blocks(batch, "text"):
                d, f, w, lo, hi, at = windows(*_shingles(texts, s.shingle), s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w, pa.int64()), pa.array(f, pa.int32()), part.column(0).take(pa.array(d)), *(pa.array(x, pa.int32()) for x in (lo, hi, at))],
                    names=["w", "f", "id", "lo", "hi", "at"],
                )

    return docs.mapInArrow(run, f"w long, f int, id {kind}, lo int, hi int, at int")


def closer(g: np.ndarray, first: np.ndarray, live: np.ndarray, fresh: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Longer names for the runs that start where `live` is set: (text, name, begin, end, at), as `windows` gives them.

    A run is named by all of its shingles, so an exact repeat can't meet a text that holds only a part of it, and, where
    `fresh` is set too, by the minima of each two of s.closer hash functions together, for repeats with edits:
    neighbouring runs of one such pair are one window.
    """
    t, out = s.run, []
    idx = np.flatnonzero(live[: max(0, len(g) - t + 1)])
    if not len(idx):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    doc = np.searchsorted(first, idx, side="right") - 1
    place = (np.arange(len(g)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64) & _LOW
    step = np.full(len(g), _BASE, np.uint64)
    step[0] = 1
    power = np.cumprod(step)
    step[1:] = _BACK
    back = np.cumprod(step)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mix(g) * power)))
    out.append((doc, C.mix((sums[idx + t] - sums[idx]) * back[idx]).view(np.int64), idx - first[doc], idx - first[doc] + t, idx - first[doc]))
    idx = idx[fresh[idx]]
    doc = np.searchsorted(first, idx, side="right") - 1
    names, ats = [], []
    for h in range(s.closer if len(idx) else 0):
        value = C.mix(g * _A[h])
        m = _sliding_min((value & ~_LOW) | place, t)[idx]
        at = idx + (((m & _LOW) - place[idx]) & _LOW).astype(np.int64)
        names.append(value[at] ^ _A[h])
        ats.append(at)
    gap = np.ones(len(idx), bool)
    gap[1:] = (np.diff(idx) != 1) | (doc[1:] != doc[:-1])
    for h in range(len(names)):
        for j in range(h + 1, len(names)):
            new = gap.copy()
            new[1:] |= (ats[h][1:] != ats[h][:-1]) | (ats[j][1:] != ats[j][:-1])
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(idx)) - 1
            d = doc[head]
            out.append((d, C.mix(names[h][head] + C.mix(names[j][head])).view(np.int64), idx[head] - first[d], idx[last] + t - first[d], ats[h][head] - first[d]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _closer(left: DataFrame, s: Settings) -> DataFrame:
    """left: (id, base, grams, open), open: ranges (lo, hi) of starts of runs that are shared (n = 0), confirmed nearly
    (n = 1) or confirmed whole (n = 2). (w, id, lo, hi, at) for each longer name of a run that is open."""
    kind = left.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in C.blocks(batch, "grams"):
                own = [np.frombuffer(c, "<u4") for c in cells]
                first = np.concatenate(([0], np.cumsum([len(c) for c in own])))
                base = part.column(1).to_numpy()
                at = np.zeros((3, first[-1] + 1), np.int64)
                for i, ranges in enumerate(part.column(3).to_pylist()):
                    n = len(own[i]) - s.run + 1
                    for x in ranges:
                        lo, hi = (max(0, min(n, x[e] - int(base[i]))) for e in ("lo", "hi"))
                        if lo < hi:
                            at[x["n"], first[i] + lo] += 1
                            at[x["n"], first[i] + hi] -= 1
                live, near, whole = np.cumsum(at, 1)[:, :-1] > 0
                d, w, lo, hi, at = closer(C.mix(np.concatenate([*own, np.zeros(0, "<u4")]).astype(np.uint64)), first, live & ~whole, ~near, s)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), part.column(0).take(pa.array(d)), *(pa.array(x + base[d], pa.int32()) for x in (lo, hi, at))], names=["w", "id", "lo", "hi", "at"])

    return left.mapInArrow(run, f"w long, id {kind}, lo int, hi int, at int")


def _live(pdf: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Ranges (lo, hi) of starts of runs that `enough` hash functions share, with no `first`; many texts at once.
    Texts never touch in the row: each ends with a start that nothing covers."""
    code, ids = pd.factorize(pdf["id"])
    size = np.zeros(len(ids), np.int64)
    lo, hi = pdf["lo"].to_numpy(np.int64), pdf["hi"].to_numpy(np.int64) - s.run + 1  # starts of runs
    np.maximum.at(size, code, hi + 1)
    base = np.concatenate(([0], np.cumsum(size)))
    f, cover = pdf["f"].to_numpy(), np.zeros(base[-1] + 1, np.int32)
    for h in np.unique(f):
        edge = np.zeros(base[-1] + 1, np.int32)
        np.add.at(edge, (lo + base[code])[f == h], 1)
        np.add.at(edge, (hi + base[code])[f == h], -1)
        cover += np.cumsum(edge) > 0
    edge = np.diff(np.concatenate(([False], cover >= s.enough, [False])).view(np.int8))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    d = np.searchsorted(base, lo, side="right") - 1
    return pd.DataFrame({"id": np.asarray(ids)[d], "lo": lo - base[d], "hi": hi - base[d], "first": None, "lo2": 0, "hi2": 0, "low": 0, "high": 0})


def _merged(pdf: pd.DataFrame, s: Settings, enough: int) -> pd.DataFrame:
    """The interval join of each pair of texts: windows that overlap at about the same shift are one span, if `enough`
    hash functions are among them. (low, high): the span's least and greatest shift."""
    (code, ids), (code2, firsts) = pd.factorize(pdf["id"]), pd.factorize(pdf["first"])
    pair = code * (len(firsts) + 1) + code2
    lo, hi, lo2, hi2, f = (pdf[c].to_numpy(np.int64) for c in ("lo", "hi", "lo2", "hi2", "f"))
    shift = pdf["at"].to_numpy(np.int64) - pdf["at2"].to_numpy(np.int64)
    order = np.lexsort((shift, pair))
    line = np.zeros(len(pdf), np.int64)
    line[order] = np.cumsum(np.concatenate(([True], (np.diff(pair[order]) != 0) | (np.diff(shift[order]) > s.drift))))
    wide = hi.max() + 1
    order = np.argsort(line * wide + lo)
    begin, end = (line * wide + lo)[order], (line * wide + hi)[order]
    head = np.flatnonzero(np.concatenate(([True], (begin[1:] > np.maximum.accumulate(end)[:-1]) | (np.diff(line[order]) != 0))))
    of, low, high = order[head], np.minimum.reduceat, np.maximum.reduceat
    each = {
        "id": np.asarray(ids)[code[of]], "lo": lo[of], "hi": high(hi[order], head), "first": np.asarray(firsts)[code2[of]],
        "lo2": low(lo2[order], head), "hi2": high(hi2[order], head), "low": low(shift[order], head), "high": high(shift[order], head),
    }
    seen = np.bitwise_or.reduceat((1 << f)[order], head)
    return pd.DataFrame(each)[np.array([int(x).bit_count() for x in seen]) >= enough]


def aligned(u: np.ndarray, v: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each shingle of u the place in v that it is matched with, or -1: equal shingles, shifted (place in u minus place
    in v) by low to high, nearest to the middle of these; no place of v is taken twice."""
    if not len(u) or not len(v):
        return np.full(len(u), -1)
    code = np.unique(np.concatenate((u, v)), return_inverse=True)[1].astype(np.int64)
    wide, place = np.int64(len(u) + len(v) + high - low + 4), np.arange(len(v))
    have = np.sort(code[len(u) :] * wide + place)
    p, own = np.arange(len(u)), code[: len(u)] * wide
    want = p - (low + high) // 2
    after = np.searchsorted(have, own + np.clip(want, 0, len(v)))
    best = np.full(len(u), -1)
    for at in (after - 1, after):
        q = have[at.clip(0, len(v) - 1)] - own
        ok = (at >= 0) & (at < len(v)) & (q >= 0) & (q < len(v)) & (p - q >= low) & (p - q <= high)
        best = np.where(ok & ((best < 0) | (np.abs(q - want) < np.abs(best - want))), q, best)
    hit = np.flatnonzero(best >= 0)
    once = np.zeros(len(u), bool)
    once[hit[np.unique(best[hit], return_index=True)[1]]] = True
    return np.where(once, best, -1)


def segments(hit: np.ndarray, share: float, least: int) -> list[tuple[int, int, float]]:
    """Stretches (begin, end, share of hits) of at least `least` places that begin and end with hits: runs of hits are
    joined to the stretch before while its share stays high enough."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8)))
    out: list[list[int]] = []  # begin, end, hits
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append([a, b, b - a])
        while len(out) > 1 and out[-2][2] + out[-1][2] >= share * (out[-1][1] - out[-2][0]):
            _, end, n = out.pop()
            out[-1][1], out[-1][2] = end, out[-1][2] + n
    return [(a, b, n / (b - a)) for a, b, n in out if b - a >= least]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings | None = None) -> DataFrame:
    """(key, begin, end, first, similarity, kept): passages, in words, that repeat across texts.

    A passage of at least s.words words whose shingles occur, for the most part (s.similarity), in another text and in
    about the same order, is reported with that text (`first`, the smallest key among those it was confirmed with) and
    kept false; the other text's passage is reported once itself, with kept true. So every text with a repeated passage
    has a row, and clean texts have none.

    Two rounds, each of which holds windows of one name against the name's first occurrence only: a passage that is in
    thousands of texts gives as many rows, not their pairs. In the first, names are single min-hashes, and a pair of
    texts needs `enough` functions on one span. A name's first occurrence may hold only a common sentence of the
    passage, so runs that several functions share with any text and that weren't confirmed shingle by shingle are named
    again by all they hold (see `closer`). Equal runs are equal to their first occurrence: no exact repeat is lost.

    Texts are read once to find shared windows, once more to make them again next to the shared names, and once to cut
    out what is verified; later steps read these cuts.

    A passage has at least s.variety distinct shingles: one word or short line over and over repeats within its text.

    Words are of letters and digits. Null and empty texts and null keys: no rows. Rows of one key are one document, whose
    texts are verified one by one; repeats within a document don't count. Ties go to the smallest key and place. Empty
    table: no rows.
    """
    s = s or Settings()
    spark = docs.sparkSession
    C.small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    named = _windows(rows, s).groupBy("w").agg(F.min(F.struct("id", "at", "lo", "hi")).alias("x"), F.max("id").alias("last"), F.count("*").alias("n")).where("x.id != last")
    shared = C.materialise(named.selectExpr("w", "n", *_FIRST), "names")
    cands = _met(_windows(rows, s), shared).withColumn("many", F.col("n") > 2).select("id", "f", "lo", "hi", "at", "first", "lo2", "hi2", "at2", "many").where("many or id != first")
    schema = f"id {kind}, lo int, hi int, first {kind}, lo2 int, hi2 int, low int, high int"

    def held(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, many = pdf[pdf["id"] != pdf["first"]], pdf[pdf["many"]]  # a name of two windows has met already
        out = [_merged(pairs, s, s.enough)] if len(pairs) else []
        out += [_live(many, s)] if len(many) else []
        return pd.concat(out, ignore_index=True)

    both = C.materialise(C.by_groups(cands, ["id"], ["first", "lo"], held, schema), "held")
    spans = _on_grid(both.where("first is not null"), s)
    live = both.where("first is null").select("id", "lo", "hi")
    wanted = spans.select("id", "lo", "hi").union(spans.select("first", "lo2", "hi2")).union(live.select("id", "lo", F.col("hi") + s.run))
    cuts = C.materialise(_cuts(rows, wanted.distinct(), s), "cuts")
    found = _confirmed(cuts, spans, s)
    # runs that several functions share and that weren't confirmed whole, by longer names
    whole = found.select("id", F.explode("whole").alias("w")).select("id", F.col("w.a").alias("lo"), (F.col("w.b") - s.run + 1).alias("hi"), F.lit(2).alias("n"))
    near = found.where(F.col("share") >= s.settled).select("id", F.col("a").alias("lo"), (F.col("b") - s.words + 1).alias("hi"), F.lit(1).alias("n"))
    open_ = live.withColumn("n", F.lit(0)).unionByName(whole.union(near).distinct()).groupBy("id").agg(F.collect_list(F.struct("lo", "hi", "n")).alias("open"))  # bounded by the text's length
    left = C.materialise(cuts.join(open_.where("exists(open, x -> x.n = 0)").hint("shuffle_hash"), "id"), "open")
    named = _closer(left, s).groupBy("w").agg(F.min(F.struct("id", "at", "lo", "hi")).alias("x"), F.max("id").alias("last"), F.count("*").alias("n")).where("x.id != last")
    longer = C.materialise(named.selectExpr("w", "n", *_FIRST), "longer-names")
    cands = _met(_closer(left, s), longer).where("id != first").select("id", F.lit(0).alias("f"), "lo", "hi", "at", "first", "lo2", "hi2", "at2")
    again = C.materialise(C.by_groups(cands, ["id"], ["first", "lo"], lambda pdf: _merged(pdf, s, 1), schema), "again")
    more = _confirmed(cuts, _on_grid(again, s), s)
    # windows that reach beyond a passage can have a later first occurrence: the earliest one counts
    best = found.union(more).groupBy("id", "a", "b").agg(F.min(F.struct("first", (-F.col("share")).alias("s"), "c", "d")).alias("x"))
    best = C.materialise(best.select("id", "a", "b", "x.*"), "best")
    C.discard(shared, both, cuts, left, longer, again, found, more)
    later = best.select(F.col("id").alias("key"), F.col("a").alias("begin"), F.col("b").alias("end"), "first", (-F.col("s")).alias("similarity"), F.lit(False).alias("kept"))
    origin = best.select(F.col("first").alias("key"), F.col("c").alias("begin"), F.col("d").alias("end")).distinct()
    return later.union(origin.select("key", "begin", "end", F.col("key").alias("first"), F.lit(1.0).alias("similarity"), F.lit(True).alias("kept")))


_FIRST = ("x.id as first", "x.at as at2", "x.lo as lo2", "x.hi as hi2")


def _met(windows: DataFrame, names: DataFrame, most: int = 1024, parts: int = 64) -> DataFrame:
    """Windows joined to their names. Names with more than 1 / most of all windows, thus at most `most`, are broadcast to
    the windows, which deals their rows to several tasks."""
    total = names.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(names.where(F.col("n") > total / most).select("w", F.lit(True).alias("hot")))
    left = windows.join(hot, "w", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).otherwise(0)).drop("hot")
    each = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(names.join(hot, "w", "left").select("*", F.explode(each).alias("part")).drop("hot"), ["w", "part"])


def _on_grid(spans: DataFrame, s: Settings) -> DataFrame:
    """The first text's side on a grid, so that a passage that many texts repeat is cut out a few times only."""
    grid = F.lit(s.grid)
    return spans.withColumns({"lo2": (F.floor(F.col("lo2") / grid) * grid).cast("int"), "hi2": (F.ceil(F.col("hi2") / grid) * grid).cast("int")})


def _cuts(rows: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(id, base, grams): the shingles of each stretch that the ranges of a text cover, `base` being its first one's place.

    32 bits of each hash are kept; places are compared along a diagonal, so equal ones by chance don't matter.
    """
    kind = rows.schema["id"].dataType.simpleString()
    asked = wanted.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("asked"))  # distinct: bounded by the text's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in C.blocks(batch, "text"):
                g, heads = _shingles(texts, s.shingle)
                small = (g >> np.uint64(32)).astype("<u4")
                ids, base, cells = [], [], []
                for i, ask in enumerate(part.column(2).to_pylist()):
                    end, n = 0, int(heads[i + 1] - heads[i])
                    for x in sorted(ask, key=lambda x: (x["lo"], x["hi"])):
                        lo, hi = min(x["lo"], n), min(x["hi"], n)
                        if cells and ids[-1] == i and lo <= end:
                            end = max(end, hi)
                            cells[-1] = (base[-1], end)
                        elif lo < hi:
                            ids.append(i)
                            base.append(lo)
                            cells.append((lo, hi))
                            end = hi
                grams = [small[heads[i] + a : heads[i] + b].tobytes() for i, (a, b) in zip(ids, cells, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids, pa.int64())), pa.array(base, pa.int32()), pa.array(grams, pa.binary())], names=["id", "base", "grams"])

    return rows.join(asked.hint("shuffle_hash"), "id").mapInArrow(run, f"id {kind}, base int, grams binary")


def _confirmed(cuts: DataFrame, spans: DataFrame, s: Settings) -> DataFrame:
    """(id, a, b, first, c, d, share, whole) for each stretch of a span that the texts' shingles confirm, in words; whole:
    stretches (a, b), in shingles, without a gap or a change of shift.

    Cuts of a text that thousands of others are held against are dealt to as many parts as its spans need.
    """
    kind = cuts.schema["id"].dataType.simpleString()
    mine = spans.select("id", "lo", "hi").distinct().withColumn("parts", F.lit(1))
    theirs = spans.groupBy("first", "lo2", "hi2").agg(F.ceil(F.count("*") / s.together).cast("int").alias("parts"))
    asked = mine.union(theirs).groupBy("id", "lo", "hi").agg(F.max("parts").alias("parts"))
    asked = asked.groupBy("id").agg(F.collect_list(F.struct("lo", "hi", "parts")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols, cells = [], [], []
            bases, grams, asks = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, (base, cell, ask) in enumerate(zip(bases, grams, asks, strict=True)):
                n = len(cell) // 4
                for x in ask:
                    if base <= (x["lo"] + x["hi"]) // 2 < base + n:
                        lo, hi = max(x["lo"], base), min(x["hi"], base + n)
                        ids.append(i)
                        cols.append((x["lo"], x["hi"], x["parts"], lo))
                        cells.append(cell[4 * (lo - base) : 4 * (hi - base)])
            ints = [pa.array([c[k] for c in cols], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *ints, pa.array(cells, pa.binary())], names=["id", "lo", "hi", "parts", "at", "grams"])

    pieces = C.materialise(cuts.join(asked.hint("shuffle_hash"), "id").mapInArrow(run, f"id {kind}, lo int, hi int, parts int, at int, grams binary"), "pieces")
    k, share, least, variety, drift = s.shingle, s.similarity, s.run, s.variety, s.drift

    @F.pandas_udf("array<struct<a:int,b:int,c:int,d:int,share:double,whole:array<struct<a:int,b:int>>>>")
    def confirmed(x: pd.Series, y: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = []
        for u, v, lo, hi in zip(x, y, low, high, strict=True):
            cell = np.frombuffer(u, "<u4")
            to = aligned(cell, np.frombuffer(v, "<u4"), int(lo) - drift, int(hi) + drift)
            hit, found = to >= 0, []
            for a, b, p in segments(hit, share, least):
                if len(np.unique(cell[a:b])) < variety:
                    continue
                where = to[a:b][hit[a:b]]
                step = (np.diff(to[a:b]) != 1) | ~hit[a + 1 : b] | ~hit[a : b - 1]
                edge = np.concatenate(([0], np.flatnonzero(step) + 1, [b - a]))
                whole = [{"a": a + int(i), "b": a + int(j)} for i, j in zip(edge[:-1], edge[1:], strict=True) if j - i >= least]
                found.append({"a": a, "b": b + k - 1, "c": int(where.min()), "d": int(where.max()) + k, "share": float(p), "whole": whole})
            out.append(found)
        return pd.Series(out)

    hot = theirs.where("parts > 1")
    dealt = spans.join(hot, ["first", "lo2", "hi2"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "lo"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    x = pieces.select("id", "lo", "hi", F.col("at").alias("at1"), F.col("grams").alias("x"))
    y = pieces.select(F.col("id").alias("first"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("at").alias("at2"), F.col("grams").alias("y"))
    both = dealt.join(x, ["id", "lo", "hi"]).join(y, ["first", "lo2", "hi2", "part"])
    off = F.col("at1") - F.col("at2")
    found = both.select("id", "at1", "first", "at2", F.explode(confirmed("x", "y", F.col("low") - off, F.col("high") - off)).alias("s"))
    whole = F.transform("s.whole", lambda w: F.struct((w["a"] + F.col("at1")).alias("a"), (w["b"] + F.col("at1")).alias("b")))
    found = C.materialise(found.select("id", (F.col("at1") + F.col("s.a")).alias("a"), (F.col("at1") + F.col("s.b")).alias("b"), "first", (F.col("at2") + F.col("s.c")).alias("c"), (F.col("at2") + F.col("s.d")).alias("d"), "s.share", whole.alias("whole")), "repeats")
    C.discard(pieces)
    return found
