"""Byte-pair merges of many words at once, in numpy, from the file of a word-end BPE tokenizer."""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(2**31 - 1)
_SLOTS = 18


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, other bytes for 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b], n = chr(n), n + 1
    return out


class WordMerger:
    """ids of whole words (pre-tokens): the pair of lowest rank is merged, leftmost first, until no pair has a rank.

    All words of about one length are a matrix; each round merges one pair in every row. Pairs are found in two hash
    tables of which one holds a pair.
    """

    WIDTHS = (4, 6, 8, 10, 12, 16, 20, 26, 34)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, tail = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + tail] for b in range(256)], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.made = made
        for seed in range(1, 100):
            if self._fill(keys, seed):
                break

    def _slot(self, key: np.ndarray, table: int) -> np.ndarray:
        return ((key * self.mult[table]) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _fill(self, keys: np.ndarray, seed: int) -> bool:
        self.mult = np.random.default_rng(seed).integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.keys = np.full((2, 1 << _SLOTS), 2**63, np.uint64)
        self.rank = np.full((2, 1 << _SLOTS), _NONE, np.int32)
        a, b = self._slot(keys, 0).tolist(), self._slot(keys, 1).tolist()
        tables: list[dict[int, int]] = [{}, {}]
        for i in range(len(keys)):
            at, table = i, 0
            for _ in range(200):
                slot = (a, b)[table][at]
                at, tables[table][slot] = tables[table].get(slot, -1), at
                if at < 0:
                    break
                table = 1 - table
            else:
                return False
        for t in (0, 1):
            s, i = np.fromiter(tables[t].keys(), np.int64), np.fromiter(tables[t].values(), np.int64)
            self.keys[t, s], self.rank[t, s] = keys[i], i
        return True

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(16)) | b.astype(np.uint64)
        s, t = self._slot(key, 0), self._slot(key, 1)
        out = np.where(self.keys[0, s] == key, self.rank[0, s], _NONE)
        out = np.where(self.keys[1, t] == key, self.rank[1, t], out)
        return np.where((a < 0) | (b < 0), _NONE, out).astype(np.int32)

    def _merge(self, ids: np.ndarray, count: np.ndarray) -> None:
        """ids: a row of byte ids for each word, filled up with -1; merged in place, with count."""
        n, w = ids.shape
        live, cur = np.arange(n), ids.copy()
        ranks = self._ranks(cur[:, :-1], cur[:, 1:])
        columns = np.arange(w)
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            done = best == _NONE
            if done.any():
                ids[live[done]] = cur[done]
                keep = ~done
                live, cur, ranks, at, best = live[keep], cur[keep], ranks[keep], at[keep], best[keep]
                if not len(live):
                    break
            rows = np.arange(len(live))
            shift = columns[None, :] + (columns[None, :] > at[:, None])
            np.minimum(shift, w - 1, out=shift)
            cur[rows, at] = self.made[best]
            cur = np.take_along_axis(cur, shift, 1)
            count[live] -= 1
            cur[rows, count[live]] = -1
            ranks = np.take_along_axis(ranks, shift[:, : w - 1].clip(max=w - 2), 1)
            ranks[rows, np.minimum(count[live] - 1, w - 2)] = _NONE
            ranks[:, -1] = _NONE
            left = np.maximum(at - 1, 0)
            m = at > 0
            ranks[rows[m], left[m]] = self._ranks(cur[rows[m], left[m]], cur[rows[m], at[m]])
            m = at + 1 < count[live]
            ranks[rows[m], at[m]] = self._ranks(cur[rows[m], at[m]], cur[rows[m], at[m] + 1])

    def __call__(self, words: list[bytes]) -> list[bytes | None]:
        """Little-endian uint32 ids of each word; None for words longer than the widest matrix."""
        out: list[bytes | None] = [None] * len(words)
        sizes = np.array([len(x) for x in words])
        low = 0
        for w in self.WIDTHS:
            pick = np.flatnonzero((sizes > low) & (sizes <= w))
            low = w
            for k in range(0, len(pick), 20_000):
                part = pick[k : k + 20_000]
                own = [words[i] for i in part.tolist()]
                count = sizes[part].copy()
                raw = np.frombuffer(b"".join(x.ljust(w, b"\0") for x in own), np.uint8).reshape(len(own), w)
                ids = self.inner[raw]
                rows = np.arange(len(own))
                ids[rows, count - 1] = self.last[raw[rows, count - 1]]
                ids[np.arange(w)[None, :] >= count[:, None]] = -1
                if w > 1:
                    self._merge(ids, count)
                flat = ids[np.arange(w)[None, :] < count[:, None]].astype("<u4").tobytes()
                ends = np.cumsum(count) * 4
                begin = 0
                for i, e in zip(part.tolist(), ends.tolist(), strict=True):
                    out[i], begin = flat[begin:e], e
        return out
