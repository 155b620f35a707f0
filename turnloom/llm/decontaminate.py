"""Benchmark decontamination: an FM-index of each training shard, searched backward for the benchmark's phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm._arrow import ALNUM_BYTES, LOWER_BYTES, chunks, hashes, lists, spans, window_hashes
from turnloom.llm._spark import settle

WINDOW = 10
#: Bytes of benchmark text that go to the tasks at once, as an index of about five times the size. A larger benchmark is searched in several
#: blocks, one after another.
BLOCK_BYTES = 8 << 20
#: Every so manieth suffix position is kept.
SAMPLE = 16


def suffix_order(t: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of t (symbols under 2**bits): first by as many symbols as fit a key, then by doubling where still tied."""
    n = len(t)
    width = max(1, 62 // bits)
    padded = np.r_[t, np.zeros(width, t.dtype)].astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        rows = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(rows):
            return order
        at = order[rows]
        key = (rank[at] << 32) | (rank[np.minimum(at + width, n)] + 1)
        again = np.argsort(key)
        at, key = at[again], key[again]
        fresh = np.r_[True, key[1:] != key[:-1]]
        order[rows], new[rows] = at, fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, rows, 0))
        width *= 2


class FMIndex:
    """Burrows-Wheeler transform of a sequence in a wavelet tree (as a matrix: a bit vector with ranks for each bit of the
    symbols), with sampled suffix positions. Symbol 0 is the end alone."""

    def __init__(self, t: np.ndarray, bits: int):
        t = np.r_[t, 0]
        order = suffix_order(t, bits)
        last = t[order - 1]  # the symbol before each suffix; index -1 is the end symbol, as it must be
        self.n, self.bits = len(t), bits
        self.first = np.r_[0, np.cumsum(np.bincount(t, minlength=1 << bits))]
        self.zeros, self.rank0 = [], []
        for b in range(bits - 1, -1, -1):
            one = (last >> b & 1).astype(bool)
            rank = np.zeros(self.n + 1, np.int32)
            np.cumsum(~one, out=rank[1:])
            self.rank0.append(rank)
            self.zeros.append(int(rank[-1]))
            last = np.r_[last[~one], last[one]]
        self.base = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))
        marked = order % SAMPLE == 0
        self.marks = np.r_[0, np.cumsum(marked)].astype(np.int32)
        self.sampled = order[marked]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            r = self.rank0[level][i]
            i = np.where(symbol >> b & 1, self.zeros[level] + i - r, r)
        return i

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows before which the suffixes with one more symbol in front begin."""
        return self.first[symbol] + self._down(symbol, i) - self.base[symbol]

    def search(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases (places in symbols, and lengths): (phrase, low, high) of those that occur."""
        live = np.arange(len(start))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for j in range(int(length.max(initial=0))):
            more = j < length[live]
            symbol = symbols[np.where(more, start[live] + length[live] - 1 - j, 0)].astype(np.int64)
            low = np.where(more, self.step(symbol, low), low)
            high = np.where(more, self.step(symbol, high), high)
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
        return live, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of rows: back, symbol by symbol, to a sampled suffix."""
        row, steps, out = row.copy(), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        live = np.arange(len(row))
        while len(live):
            i = row[live]
            done = self.marks[i + 1] > self.marks[i]
            out[live[done]] = self.sampled[self.marks[i[done]]] + steps[live[done]]
            live, i = live[~done], i[~done]
            symbol, k = np.zeros(len(live), np.int64), i
            for level in range(self.bits):
                r = self.rank0[level][k]
                one = self.rank0[level][k + 1] == r
                symbol = symbol << 1 | one
                k = np.where(one, self.zeros[level] + k - r, r)
            row[live] = self.first[symbol] + k - self.base[symbol]
            steps[live] += 1
        return out


class Phrases:
    """The windows of benchmark items: the items' words as one sequence of symbols, the place and length of each distinct window in it, and the
    items that hold each. About 30 bytes for each word, whatever the windows overlap."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.names = [str(i) for i, _ in items]
        table = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in items], pa.string())})
        words, rows, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for part, data, offsets in chunks(iter([table])):
            start, end, row = spans(ALNUM_BYTES[data], offsets)
            words.append(hashes(LOWER_BYTES[data], start, end))
            rows.append(row + before)
            before += part.num_rows
        h, row = np.concatenate(words), np.concatenate(rows)
        self.vocabulary = np.unique(h)
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.symbols = (np.searchsorted(self.vocabulary, h) + 2).astype(np.int32)
        # Windows by their hash; an item of fewer words is one window of all of them.
        keys, at = window_hashes(h, row, WINDOW)
        keys, starts, lengths = [keys], [at], [np.full(len(at), WINDOW)]
        held = np.bincount(row, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        first = np.r_[0, np.cumsum(held)]
        for k in range(1, WINDOW):
            short = np.flatnonzero(held == k)
            if len(short):
                found, _ = window_hashes(h[np.concatenate([np.arange(first[i], first[i] + k) for i in short])], np.repeat(short, k), k)
                keys.append(found)
                starts.append(first[short])
                lengths.append(np.full(len(short), k))
        keys, starts, lengths = (np.concatenate(x) for x in (keys, starts, lengths))
        order = np.lexsort((starts, keys, lengths))
        keys, starts, lengths = keys[order], starts[order], lengths[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (lengths[1:] != lengths[:-1])][: len(keys)]
        line = np.cumsum(new) - 1
        self.start, self.length = starts[new].astype(np.int32), lengths[new].astype(np.int64)
        pairs = np.unique(np.c_[line, row[starts]], axis=0) if len(line) else np.zeros((0, 2), np.int64)
        self.owner = pairs[:, 1].astype(np.int32)
        self.owners = np.searchsorted(pairs[:, 0], np.arange(len(self.start) + 1))

    def hits(self, h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """For words h of rows: which words are hit, and (row, item) pairs, distinct and in order."""
        none = np.zeros(len(h), bool), np.zeros((0, 2), np.int64)
        if not len(h) or not len(self.start):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == h, at + 2, 1)
        # Phrases with a word that the shard has not are not searched for.
        here = np.zeros(len(self.vocabulary) + 2, bool)
        here[symbol] = True
        missing = np.r_[0, np.cumsum(~here[self.symbols])]
        asked = np.flatnonzero(missing[self.start + self.length] == missing[self.start])
        if not len(asked):
            return none
        # A separator goes before each row, and runs of words that no phrase holds count as one: no phrase spans them.
        place = np.arange(len(h)) + row + 1
        t, word = np.ones(len(h) + n_rows, np.int64), np.full(len(h) + n_rows, -1, np.int64)
        t[place], word[place] = symbol, np.arange(len(h))
        keep = (t != 1) | np.r_[True, t[:-1] != 1]
        t, word = t[keep], word[keep]
        index = FMIndex(t, self.bits)
        line, low, high = index.search(self.symbols, self.start[asked], self.length[asked])
        if not len(line):
            return none
        line = asked[line]
        many = high - low
        rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        line = np.repeat(line, many)
        first = word[index.locate(rows)]
        change = np.bincount(first, minlength=len(h) + 1) - np.bincount(first + self.length[line], minlength=len(h) + 1)
        # A row and a phrase once, however often it stands there, before the phrase's items.
        met = np.unique(np.c_[row[first], line], axis=0)
        owners = self.owners[met[:, 1] + 1] - self.owners[met[:, 1]]
        item = self.owner[np.repeat(self.owners[met[:, 1]], owners) + np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners)]
        return np.cumsum(change[:-1]) > 0, np.unique(np.c_[np.repeat(met[:, 0], owners), item], axis=0)


def _search(phrases: Phrases, out: pa.Schema, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            n = rows.num_rows
            start, end, row = spans(ALNUM_BYTES[data], offsets)
            hit, pairs = phrases.hits(hashes(LOWER_BYTES[data], start, end), row, n)
            columns = {f.name: rows.column(rows.schema.get_field_index(f.name)) for f in out if f.name in rows.schema.names}
            edges = lists(row, n)
            # Runs of hit words: joined with what the blocks before have found.
            where = np.flatnonzero(hit)
            own = np.split(where - edges[row[where]], lists(row[where], n)[1:-1])
            items = np.split(pairs[:, 1], lists(pairs[:, 0], n)[1:-1])
            names = [[phrases.names[i] for i in x] for x in items]
            if "__hit" in rows.schema.names:
                own = [np.union1d(a, np.array(b, np.int64)) for a, b in zip(own, rows.column("__hit").to_pylist(), strict=True)]
                names = [a + b for a, b in zip(names, rows.column("__items").to_pylist(), strict=True)]
            if not last:
                columns |= {"__hit": pa.array([x.tolist() for x in own], pa.list_(pa.int64())), "__items": pa.array(names, pa.list_(pa.string()))}
            else:
                names = [sorted(set(x)) for x in names]
                merged = [_runs(x) for x in own]
                columns |= {
                    "n_words": pa.array(np.diff(edges), pa.int64()),
                    "n_hit": pa.array([len(x) for x in own], pa.int64()),
                    "n_items": pa.array([len(x) for x in names], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                    "contaminated": pa.array([len(x) > 0 for x in own], pa.bool_()),
                    "hit_spans": pa.array(merged, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                }
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in out], schema=out)

    return run


def _runs(words: np.ndarray) -> list[dict]:
    if not len(words):
        return []
    cut = np.flatnonzero(np.diff(words) > 1)
    return [{"first": int(a), "last": int(b)} for a, b in zip(words[np.r_[0, cut + 1]], words[np.r_[cut, len(words) - 1]], strict=True)]


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<first:long,last:long>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all by default) with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (runs of hit
    words, first and last).

    Words are runs of letters and digits, lower-cased in A-Z. A window is WINDOW words one after another of an item; an item of
    fewer words is one window. A training shard is a slice of a partition (about 4 MB of text): no shuffle. The benchmark goes
    to the tasks in blocks of at most BLOCK_BYTES of text (an item that is longer alone), so what a task gets is bounded.
    Nulls: a null text has no words; null items none; null item_ids are named None. Repeated rows pass through. Empty
    tables: no rows, or nothing found. Columns of docs named as the new ones are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = [f.name for f in StructType.fromDDL(FOUND)]
    kept = [c for c in (keep or docs.columns) if c not in new]
    out = docs.select(*dict.fromkeys([*kept, "text"]))
    blocks = _blocks(benchmark)
    items = next(blocks, [])
    while True:
        following = next(blocks, None)
        last = following is None
        have = StructType([f for f in out.schema if f.name in (kept if last else [*kept, "text"])])
        to = StructType([*have, *StructType.fromDDL(FOUND if last else "__hit array<long>, __items array<string>")])
        out = out.mapInArrow(_search(Phrases(items), to_arrow_schema(to), last), to)
        if last:
            return out
        # Each block's index goes when its pass is done.
        out, items = settle(out, "benchmark-block"), following


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """Items in blocks of bounded size. The driver holds two blocks at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; other columns and rows as they are."""
    return find_contamination(docs, benchmark).where(~F.col("contaminated")).select(*docs.columns)
