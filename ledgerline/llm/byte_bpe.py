"""Byte-level BPE by a two-tier lookup: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Texts are split in windows of about this many characters, so that a long text's pre-tokens are never all held.
WINDOW = 1 << 19
#: Merged pre-tokens that a worker keeps; the cache is emptied beyond that.
CACHE_WORDS = 400_000

_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)

# A letter, a number and another sign, for characters that are newer than the splitter's tables.
_STAND_IN = ("ƻ", "²", "¦")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def hash_bytes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a binary array; values may have up to 4,096 bytes."""
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    size = np.diff(off)
    buf = np.frombuffer(words.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(words) else np.zeros(0, np.uint8)
    h = np.zeros(len(words), np.uint64)
    if len(buf):
        some = size > 0
        at = np.arange(len(buf)) - np.repeat(off[:-1] - off[0], size)
        h[some] = np.add.reduceat(_BYTE[buf] * _PLACE[at], (off[:-1] - off[0])[some])
    return C.mix(h + size.astype(np.uint64))


class PerfectHash:
    """A bijection from n distinct 64-bit hashes to 0..n-1. Each level gives a slot to the hashes that meet no other there
    and leaves the others to the next; slots in use are numbered on."""

    def __init__(self, hashes: np.ndarray, room: int = 3):
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("hashes of the vocabulary aren't distinct")
        self.levels: list[np.ndarray] = []
        left, base = hashes, 0
        while len(left):
            at = self._at(left, len(self.levels), room * len(left))
            alone = np.bincount(at, minlength=room * len(left)) == 1
            number = np.where(alone, np.cumsum(alone) - 1 + base, -1)
            self.levels.append(number.astype(np.int32))
            left, base = left[~alone[at]], base + int(alone.sum())

    @staticmethod
    def _at(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (C.mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each member; what isn't a member gets any slot or -1, so slots must be compared with the key."""
        out = np.full(len(hashes), -1, np.int64)
        rest = np.arange(len(hashes))
        for level, number in enumerate(self.levels):
            got = number[self._at(hashes[rest], level, len(number))]
            out[rest] = got
            rest = rest[got < 0]
        return out


class Splitter:
    """Matches of a pattern, with the character classes of the library whose ids are wanted.

    Characters that this Python's tables don't know yet may be letters or numbers to one library and nothing to another;
    for those alone the library is asked, once a character in a worker, and a character of the same class stands in while splitting.
    """

    def __init__(self, pattern: str):
        import regex

        self.pattern, self.match = pattern, regex.compile(pattern)
        self.gap = regex.compile(r"(?<=\S)\s")
        self.class_of: dict[str, str] = {}

    def _ask(self, new: set[str]) -> None:
        import tiktoken

        single = {bytes([b]): b for b in range(256)}
        for lead, stand_in in zip("a1!", _STAND_IN, strict=True):
            left = [c for c in new if c not in self.class_of]
            pairs = {(lead + c).encode(): 256 + i for i, c in enumerate(left)}
            enc = tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=single | pairs, special_tokens={})
            self.class_of |= {c: stand_in for i, c in enumerate(left) if enc.encode_ordinary(lead + c) == [256 + i]}
        self.class_of |= {c: c for c in new if c not in self.class_of}

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            new = {c for c in set(text) if c > "ͷ" and unicodedata.category(c) == "Cn"}
            if new:
                if unknown := new - self.class_of.keys():
                    self._ask(unknown)
                out, at = [], 0
                for x in self.match.findall(text.translate({ord(c): self.class_of[c] for c in new})):
                    out.append(text[at : at + len(x)])
                    at += len(x)
                return out
        return self.match.findall(text)

    def windows(self, text: str) -> Iterator[str]:
        """The text in parts; they end where white space follows another character, which no match spans."""
        at = 0
        while len(text) - at > WINDOW:
            gap = self.gap.search(text, at + WINDOW)
            if not gap:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:] if at else text


class ByteBPE:
    """ids of texts under ranks by byte string. Whole pre-tokens of the vocabulary are resolved a block at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.cache = ranks, Splitter(pattern), {}
        self.longest = max(map(len, ranks), default=0)
        if self.longest > len(_PLACE):
            raise ValueError(f"tokens have at most {len(_PLACE)} bytes")
        tokens = pa.array(list(ranks), pa.binary())
        h = hash_bytes(tokens)
        self.find = PerfectHash(h)
        order = np.argsort(self.find(h))
        self.token = tokens.take(pa.array(order))  # by slot
        self.id = np.fromiter(ranks.values(), np.int32, len(ranks))[order]

    def merge(self, word: bytes) -> list[int]:
        """Pairs of neighbouring parts are merged by rank, leftmost first. Parts are linked by where they end, so each merge
        costs a heap operation and not a pass over the word; pairs whose parts have changed are passed over."""
        n, rank = len(word), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [rank(word[i : i + 2], -1) for i in range(n - 1)]  # the rank of the part that begins here with the next one
        shift = n.bit_length()
        heap, low = [r << shift | i for i, r in enumerate(pair) if r >= 0], (1 << shift) - 1
        pair.append(-1)
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & low
            if pair[i] != x >> shift:
                continue
            mid = after[i]
            end = after[i] = after[mid]
            pair[mid] = pair[i] = -1
            if end < n:
                before[end] = i
                r = rank(word[i : after[end]], -1)
                if r >= 0:
                    pair[i] = r
                    heappush(heap, r << shift | i)
            if i:
                left = before[i]
                pair[left] = r = rank(word[left:end], -1)
                if r >= 0:
                    heappush(heap, r << shift | left)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pre-tokens, one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        which, own = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())
        short = pc.less_equal(pc.binary_length(own), self.longest)
        slot = np.full(len(own), -1, np.int64)
        at = np.flatnonzero(short.to_numpy(zero_copy_only=False))
        some = own.take(pa.array(at)).cast(pa.binary())
        slot[at] = self.find(hash_bytes(some))
        known = pc.equal(self.token.take(pa.array(slot[at].clip(0))), some).to_numpy(zero_copy_only=False)
        slot[at[~known]] = -1
        size, missed = np.ones(len(own), np.int64), np.flatnonzero(slot < 0)
        merged = []
        for w in own.take(pa.array(missed)).to_pylist():
            ids = self.cache.get(w)
            if ids is None:
                ids = array("i", self.merge(w)).tobytes()
                if len(w) <= 64:
                    if len(self.cache) >= CACHE_WORDS:
                        self.cache.clear()
                    self.cache[w] = ids
            merged.append(ids)
        size[missed] = [len(x) // 4 for x in merged]
        flat, of_missed = np.empty(int(size.sum()), np.int32), np.repeat(slot < 0, size)
        flat[of_missed] = np.frombuffer(b"".join(merged), np.int32)
        flat[~of_missed] = self.id[slot[slot >= 0]]
        offsets = pa.array(np.append(0, np.cumsum(size)), pa.int64())
        return pa.LargeListArray.from_arrays(offsets, pa.array(flat)).take(pa.array(which)).flatten().to_numpy(), size[which]

    def __call__(self, texts: list[str]) -> pa.ListArray:
        counts, parts = np.zeros(len(texts), np.int64), []
        held, owner, chars = [], [], 0

        def done() -> None:
            ids, size = self.words(list(chain.from_iterable(held)))
            np.add.at(counts, np.repeat(owner, [len(x) for x in held]), size)
            parts.append(ids)

        for i, t in enumerate(texts):
            for w in self.split.windows(t):
                held.append(self.split(w))
                owner.append(i)
                chars += len(w)
                if chars >= WINDOW:
                    done()
                    held, owner, chars = [], [], 0
        if held:
            done()
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat, pa.int32()))


class Decoder:
    """Bytes of lists of ids: all ids of a batch are looked up at once, and the lists' ends cut what comes out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.place = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        self.place[np.fromiter(ranks.values(), np.int64, len(ranks))] = np.arange(len(ranks))
        self.tokens = pa.array(list(ranks), pa.binary())

    def __call__(self, lists: pa.ListArray) -> pa.Array:
        at = lists.flatten()
        if at.null_count:
            raise ValueError("null among ids")
        x = at.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(x) and (x.min() < 0 or x.max() >= len(self.place) or self.place[x].min() < 0):
            raise ValueError("an id isn't in the vocabulary")
        size = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
        flat = self.tokens.take(pa.array(self.place[x]))
        ends = np.frombuffer(flat.buffers()[1], np.int32)[: len(x) + 1] if len(x) else np.zeros(1, np.int32)
        whole = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends[size].astype(np.int32).tobytes()), flat.buffers()[2] or pa.py_buffer(b"")])
        return pc.if_else(pc.is_null(lists), pa.scalar(None, pa.binary()), whole)


@lru_cache(maxsize=1)
def _coder(path: str, pattern: str) -> tuple[ByteBPE, Decoder]:
    """Built once a worker, and not once a task."""
    ranks = load_ranks(path)
    return ByteBPE(ranks, pattern), Decoder(ranks)


@lru_cache(maxsize=1)
def _decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids): each whole text's ids under the rank file `ranks`, a file that every machine has at that path. With
    `decoded`, also the bytes that the ids stand for, decoded from the ids by the same worker.

    Null and empty texts have an empty list. Very long texts are split window by window; a pre-token of any length is merged
    in n log n. Repeated rows, null keys and equal keys each give their own row; an empty table gives none. Other columns
    aren't read, so their names can't clash. Bytes that aren't UTF-8 are read as U+FFFD. No shuffle.
    """
    C.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, back = _coder(ranks, pattern)
        for batch in batches:
            for part, texts in C.blocks(batch, "text"):
                ids = bpe([t.decode("utf-8", "replace") for t in texts])
                more = {"decoded": back(ids)} if decoded else {}
                yield pa.RecordBatch.from_pydict({"key": part.column(0), "ids": ids} | more)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>" + (", decoded binary" if decoded else ""))


def decode(rows: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows and their ids' bytes, in the binary column `out` (which must not be a column yet). A null list gives null, an
    empty one no bytes; an id that isn't in the file, or a null one, is an error. No shuffle."""
    if out in rows.columns:
        raise ValueError(f"there is a column {out} already")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _decoder(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, back(batch.column(batch.schema.get_field_index(ids)))], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)
