"""A two-level n-gram trie in Elias-Fano form, on memory-mapped files."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_BYTE = np.array([bin(i).count("1") for i in range(256)], np.int64)


class EliasFano:
    """A monotone sequence of numbers from 0: low bits as they are, high bits in unary in a bit vector, with the number of ones before each
    eighth byte. `arrays` may be replaced by memory-mapped copies."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if self.low_bits <= np.dtype(t).itemsize * 8)
        bits = np.zeros((top >> self.low_bits) + self.n + 1, np.uint8)
        bits[(values >> self.low_bits) + np.arange(self.n)] = 1
        high = np.packbits(bits)
        high = np.r_[high, np.zeros(-len(high) % 8, np.uint8)]
        ones = np.r_[0, np.cumsum(_BYTE[high].reshape(-1, 8).sum(axis=1))]
        self.arrays = {"low": (values & ((1 << self.low_bits) - 1)).astype(width), "high": high, "ones": ones.astype(np.int64)}

    def decode(self, first: int, last: int) -> np.ndarray:
        """Elements first to last - 1: the words of the bit vector that hold them, unpacked."""
        if last <= first:
            return np.zeros(0, np.int64)
        ones = self.arrays["ones"]
        a = int(np.searchsorted(ones, first, "right")) - 1
        b = int(np.searchsorted(ones, last - 1, "right"))
        at = np.flatnonzero(np.unpackbits(np.asarray(self.arrays["high"][8 * a : 8 * b]))) + 64 * a
        at = at[first - int(ones[a]) :][: last - first]
        return (at - np.arange(first, last)) << self.low_bits | self.arrays["low"][first:last].astype(np.int64)


class Trie:
    """Contexts and, for each, its next words in order, with quantised log-probabilities.

    Next words are numbered in the order of their keys; in a context their numbers ascend, and the sequence of all contexts is made
    monotone by adding the last element of the context before. Pointers to a context's first word ascend as well. Both are in Elias-Fano form,
    probabilities are bytes, and all levels lie in one memory-mapped file that close() removes.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, level: np.ndarray, backoff: np.ndarray):
        """Pairs sorted by (context, word), distinct; level: a number for each; backoff: one for each distinct context."""
        self.contexts, first = np.unique(context, return_index=True)
        self.words, number = np.unique(word, return_inverse=True)
        bounds = np.r_[first, len(context)].astype(np.int64)
        ends = number[bounds[1:] - 1] if len(context) else np.zeros(0, np.int64)
        base = np.r_[0, np.cumsum(ends)[:-1]] if len(ends) else ends
        self.pointers = EliasFano(bounds)
        self.children = EliasFano(number + np.repeat(base, np.diff(bounds)))
        self.base = EliasFano(base)
        parts = {"level": level, "backoff": backoff, "contexts": self.contexts, "words": self.words}
        for name, x in (("pointers", self.pointers), ("children", self.children), ("base", self.base)):
            parts |= {f"{name}.{k}": v for k, v in x.arrays.items()}
        fd, self.path = tempfile.mkstemp(prefix="trie-")
        at, places = 0, {}
        with os.fdopen(fd, "wb") as f:
            for name, v in parts.items():
                f.write(b"\0" * (-at % 8))
                at += -at % 8
                places[name] = at, v.dtype, len(v)
                f.write(np.ascontiguousarray(v).tobytes())
                at += v.nbytes
        mapped = {n: np.memmap(self.path, t, "r", o, (k,)) if k else np.zeros(0, t) for n, (o, t, k) in places.items()}
        self.level, self.backoff, self.contexts, self.words = (mapped[k] for k in ("level", "backoff", "contexts", "words"))
        for name, x in (("pointers", self.pointers), ("children", self.children), ("base", self.base)):
            x.arrays = {k: mapped[f"{name}.{k}"] for k in x.arrays}

    def close(self) -> None:
        os.unlink(self.path)

    def look_up(self, context: np.ndarray, word: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """For pairs sorted by context: the context's rank or -1, and the pair's place or -1. Children of the contexts asked for are decoded in
        runs of bounded length; the place is that of the successor of the word among its context's children, if equal."""
        rank = np.minimum(np.searchsorted(self.contexts, context), max(len(self.contexts) - 1, 0))
        rank = np.where(self.contexts[rank] == context, rank, -1) if len(self.contexts) else np.full(len(context), -1)
        number = np.minimum(np.searchsorted(self.words, word), max(len(self.words) - 1, 0))
        number = np.where(self.words[number] == word, number, -1) if len(self.words) else np.full(len(word), -1)
        place = np.full(len(context), -1, np.int64)
        live = np.flatnonzero((rank >= 0) & (number >= 0))
        bounds = self.pointers.decode(0, self.pointers.n)
        base = self.base.decode(0, self.base.n)
        while len(live):
            r = int(rank[live[0]])
            to = max(r + 1, int(np.searchsorted(bounds, bounds[r] + at_once, "right")) - 1)
            some = live[: np.searchsorted(rank[live], to)]
            a, b = int(bounds[r]), int(bounds[to])
            of = np.repeat(np.arange(r, to), np.diff(bounds[r : to + 1]))
            key = of * len(self.words) + self.children.decode(a, b) - base[of]
            asked = rank[some] * len(self.words) + number[some]
            i = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            place[some] = np.where(key[i] == asked, a + i, -1)
            live = live[len(some) :]
        return rank, place
