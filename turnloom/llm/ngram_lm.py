"""LM scoring: a bigram model in Elias-Fano tries, one for each shard of contexts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm._arrow import LOWER_BYTES, SPACE_BYTES, chunks, hashes, mix, spans
from turnloom.llm._spark import settle
from turnloom.llm.elias_fano import Trie

#: Bytes of text for each shard of contexts; there are LEAST_SHARDS at least.
SHARD_BYTES, LEAST_SHARDS = 12 << 20, 32
#: A word with this share of all tokens is hot: its pairs are dealt by both words. There are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1024
#: Absolute discount; steps of a quantised probability to a factor of ten.
DISCOUNT, STEPS = 0.75, 32
BEGIN, END = np.uint64(1), np.uint64(2)
_KEY48 = np.uint64((1 << 48) - 1)


def quantise(log10: np.ndarray) -> np.ndarray:
    """Steps below 1 in 16 bits: down to 1e-2047, so no count of a context is too large."""
    return np.clip(np.rint(-log10 * STEPS), 0, 65535).astype(np.uint16)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of each row and then END."""
    start, end, row = spans(SPACE_BYTES[data], offsets)
    h = hashes(LOWER_BYTES[data], start, end)
    h = np.where(h <= END, h + np.uint64(3), h)
    n = len(offsets) - 1
    at = np.arange(len(h)) + row
    tokens, rows = np.full(len(h) + n, END), np.repeat(np.arange(n), np.bincount(row, minlength=n) + 1)
    tokens[at] = h
    return tokens, rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches):
        word, n = np.unique(_tokens(data, offsets)[0], return_counts=True)
        yield pa.RecordBatch.from_pydict({"word": word.view(np.int64), "n": n.astype(np.int64)})


_BLOB = ["ctx", "runs", "low", "high", "idx", "many", "train"]
_BLOBS = "kind int, shard long, chunk long, " + ", ".join(f"{c} binary" for c in _BLOB)
_BLOB_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in _BLOB]])


class Known:
    """What every task knows: totals and the hot words with their counts."""

    def __init__(self, tokens: int, distinct: int, hot: list[tuple[int, int]], documents: int):
        self.tokens, self.distinct, self.documents = tokens, distinct, documents
        pairs = dict(hot) | {int(BEGIN): documents, int(END): documents}
        words = np.array(list(pairs), np.int64).view(np.uint64)
        order = np.argsort(words)
        self.hot, self.hot_n = words[order], np.array(list(pairs.values()), np.int64)[order]

    def place(self, word: np.ndarray) -> np.ndarray:
        """Number among the hot words, or -1."""
        i = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
        return np.where(self.hot[i] == word, i, -1)


def _dealt(known: Known, bits: int):
    """Pairs of a slice of documents, dealt to shards by context (hot contexts: by both words), and the slice's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 32
        for rows, data, offsets in chunks(batches):
            n = rows.num_rows
            word, row = _tokens(data, offsets)
            context = np.r_[BEGIN, word[:-1]]
            context[np.r_[True, row[1:] != row[:-1]]] = BEGIN
            held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            ids = rows.column("doc_id")
            hot = known.place(word)
            seen = (hot >= 0) & (known.hot_n[hot] > 0)
            base = np.bincount(row[hot >= 0], np.log10(known.hot_n[hot[hot >= 0]] + 1.0), minlength=n)
            docs = [
                ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                np.bincount(row, minlength=n).astype(np.int64).tobytes(), base.tobytes(), np.bincount(row[seen], minlength=n).astype(np.int64).tobytes(), b"", held.tobytes(),
            ]
            out = [(1, -1 - chunk % (1 << bits), chunk, *docs)]
            word = word & _KEY48
            with np.errstate(over="ignore"):
                by = np.where(known.place(context) >= 0, mix(context + word * np.uint64(0x9E3779B97F4A7C15)), mix(context))
            shard = (by >> np.uint64(64 - bits)).astype(np.int64)
            order = np.lexsort((row, word, context, shard))
            shard, context, word, row = shard[order], context[order], word[order], row[order]
            new = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (context[1:] != context[:-1]) | (word[1:] != word[:-1]) | (row[1:] != row[:-1])])
            many = np.diff(np.r_[new, len(row)])
            # A byte for how often; what does not fit goes on in further entries.
            more = -(-many // 255)
            new, rest = np.repeat(new, more), np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            many = np.minimum(np.repeat(many, more) - 255 * rest, 255)
            shard, context, word, row = shard[new], context[new], word[new], row[new]
            edges = np.searchsorted(shard, np.arange((1 << bits) + 1))
            for s in range(1 << bits):
                i, j = edges[s], edges[s + 1]
                if i < j:
                    c, at = np.unique(context[i:j], return_index=True)
                    w = word[i:j]
                    out.append((
                        0, s, chunk, c.tobytes(), np.diff(np.r_[at, j - i]).astype(np.uint32).tobytes(), w.astype(np.uint32).tobytes(), (w >> np.uint64(32)).astype(np.uint16).tobytes(),
                        row[i:j].astype(np.uint16).tobytes(), many[i:j].astype(np.uint8).tobytes(), np.packbits(~held[row[i:j]]).tobytes(),
                    ))
            chunk += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _BLOB_SCHEMA, strict=True)], schema=_BLOB_SCHEMA)

    return run


_PART = ["idx", "base", "known", "score", "un_word", "un_idx", "un_many", "hot", "hot_idx", "hot_many"]
_PARTS = "kind int, chunk long, " + ", ".join(f"{c} binary" for c in _PART)
_PART_SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in _PART]])


def _scored(known: Known):
    """For a shard: counts of the training pairs, their trie, and what it says of the pairs of each slice."""
    def run(table: pa.Table) -> pa.Table:
        out = []
        if table.column("kind")[0].as_py() == 1:
            for r in table.to_pylist():
                out.append((1, r["chunk"], r["high"], r["ctx"], r["runs"], r["low"], r["idx"], r["train"], b"", b"", b"", b""))
            return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PART_SCHEMA, strict=True)], schema=_PART_SCHEMA)
        blobs = table.to_pylist()
        get = lambda c, t: [np.frombuffer(b[c], t) for b in blobs]
        context = np.concatenate([np.repeat(c, r) for c, r in zip(get("ctx", np.uint64), get("runs", np.uint32), strict=True)])
        word = np.concatenate(get("high", np.uint16)).astype(np.uint64) << np.uint64(32) | np.concatenate(get("low", np.uint32))
        idx = np.concatenate(get("idx", np.uint16))
        many = np.concatenate(get("many", np.uint8)).astype(np.int64)
        sizes = [len(x) for x in get("idx", np.uint16)]
        train = np.concatenate([np.unpackbits(x)[:k] for x, k in zip(get("train", np.uint8), sizes, strict=True)]).astype(bool)
        blob = np.repeat(np.arange(len(blobs)), sizes)

        order = np.lexsort((word, context))
        context, word, idx, many, train, blob = (x[order] for x in (context, word, idx, many, train, blob))
        first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
        pair = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(word)]))
        count = np.bincount(pair, np.where(train, many, 0), minlength=len(first)).astype(np.int64)
        pair_context, pair_word = context[first], word[first]
        own, at = np.unique(pair_context, return_index=True)
        total = np.add.reduceat(count, at) if len(at) else count
        kinds = np.add.reduceat((count > 0).astype(np.int64), at) if len(at) else count
        hot = known.place(own)
        total = np.where(hot >= 0, known.hot_n[hot], total)
        of = np.repeat(np.arange(len(own)), np.diff(np.r_[at, len(pair_context)]))
        kept = count > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            level = quantise(np.log10((count[kept] - DISCOUNT) / total[of[kept]]))
            backoff = quantise(np.log10(DISCOUNT * kinds / total))
        trie = Trie(pair_context[kept], pair_word[kept], level, backoff[np.unique(of[kept])])
        try:
            rank, place = trie.look_up(pair_context, pair_word)
            value = np.where(place >= 0, (trie.level[np.maximum(place, 0)] if len(trie.level) else 0) / -STEPS, 0.0)
            # A pair that training has not seen: the back-off weight of its context (later, where that is hot), times the word's probability.
            weight = np.where(rank >= 0, (trie.backoff[np.maximum(rank, 0)] if len(trie.backoff) else 0) / -STEPS, 0.0)
        finally:
            trie.close()
        unseen = place < 0
        hot_context = hot[of]
        value = np.where(unseen & (hot_context < 0), weight, value)
        hot_word = _hot48(known, pair_word)
        uniform = math.log10(known.tokens + known.distinct + 1)
        value = np.where(unseen & (hot_word >= 0), value + np.log10(known.hot_n[hot_word] + 1.0) - uniform, value)
        # Tokens are counted where they are contexts; BEGIN is none, and hot ones were counted on the way.
        base = np.where(hot_context < 0, np.log10(total[of] + 1.0), 0.0)
        is_known = (hot_context < 0) & (total[of] > 0)

        order = np.lexsort((idx, blob))
        pair, idx, many, blob = pair[order], idx[order], many[order], blob[order]
        new = np.flatnonzero(np.r_[True, (blob[1:] != blob[:-1]) | (idx[1:] != idx[:-1])])
        sums = lambda x: np.add.reduceat(x, new)
        per = {"idx": idx[new].astype(np.uint16), "base": sums(base[pair] * many), "known": sums(is_known[pair] * many), "score": sums(value[pair] * many)}
        far = np.flatnonzero(unseen[pair] & (hot_word[pair] < 0))
        late = np.flatnonzero(unseen[pair] & (hot_context[pair] >= 0))
        entries = {"un_word": pair_word[pair[far]].view(np.int64), "un_idx": idx[far], "un_many": many[far]}
        lates = {"hot": hot_context[pair[late]], "hot_idx": idx[late], "hot_many": many[late]}
        ends = [np.searchsorted(x, np.arange(len(blobs) + 1)) for x in (blob[new], blob[far], blob[late])]
        for b, r in enumerate(blobs):
            cut = [
                *[v[ends[0][b] : ends[0][b + 1]] for v in per.values()], *[v[ends[1][b] : ends[1][b + 1]] for v in entries.values()],
                *[v[ends[2][b] : ends[2][b + 1]] for v in lates.values()],
            ]
            out.append((0, r["chunk"], *[np.ascontiguousarray(v).tobytes() for v in cut]))
        told = np.flatnonzero((hot >= 0) & (kinds > 0))
        out.append((2, 0, hot[told].astype(np.int64).tobytes(), kinds[told].astype(np.int64).tobytes(), *[b""] * 8))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PART_SCHEMA, strict=True)], schema=_PART_SCHEMA)

    return run


def _hot48(known: Known, word: np.ndarray) -> np.ndarray:
    """Number among the hot words by the 48 bits that pairs keep, or -1."""
    short = known.hot & _KEY48
    order = np.argsort(short)
    i = np.minimum(np.searchsorted(short[order], word), len(short) - 1)
    return np.where(short[order][i] == word, order[i], -1)


def _hot_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [np.concatenate([*(np.frombuffer(x, np.int64) for x in b.column(c).to_pylist()), np.zeros(0, np.int64)]) for c in ("idx", "base")]
        yield pa.RecordBatch.from_pydict({"hot": got[0], "kinds": got[1]})


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for chunk, word, idx, many in zip(*(b.column(c).to_pylist() for c in ("chunk", "un_word", "un_idx", "un_many")), strict=True):
            word = np.frombuffer(word, np.int64)
            if len(word):
                yield pa.RecordBatch.from_pydict({
                    "key": word, "chunk": np.full(len(word), chunk), "idx": np.frombuffer(idx, np.uint16).astype(np.int32), "many": np.frombuffer(many, np.int64),
                })


_DOCS = "chunk long, idx int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _gathered(known: Known, weights: np.ndarray):
    """For a slice of documents: sums over all shards. weights: log10 of the back-off weights of the hot words."""
    uniform = math.log10(known.tokens + known.distinct + 1)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs = next(r for r in rows if r["kind"] == 1)
        n_tokens = np.frombuffer(docs["score"], np.int64)
        n = len(n_tokens)
        base, n_known, score = np.frombuffer(docs["idx"], np.float64).copy(), np.frombuffer(docs["un_word"], np.int64).copy(), np.zeros(n)
        for r in rows:
            if r["kind"] == 0:
                i = np.frombuffer(r["idx"], np.uint16)
                base[i] += np.frombuffer(r["base"], np.float64)
                n_known[i] += np.frombuffer(r["known"], np.int64)
                score[i] += np.frombuffer(r["score"], np.float64)
                late = np.frombuffer(r["hot_many"], np.int64) * weights[np.frombuffer(r["hot"], np.int64)]
                score += np.bincount(np.frombuffer(r["hot_idx"], np.uint16), late, minlength=n)
        ids = pa.array(np.frombuffer(docs["known"], np.int64), mask=~np.frombuffer(docs["base"], bool))
        return pa.table({
            "chunk": np.full(n, docs["chunk"]), "idx": np.arange(n, dtype=np.int32), "doc_id": ids, "held_out": np.frombuffer(docs["un_idx"], bool),
            "n_tokens": n_tokens, "n_known": n_known, "base": base - n_tokens * uniform, "score": score,
        })

    return run


def held_out(doc_id: str = "doc_id"):
    """The documents that the model does not learn from: crc32 of doc_id as text, modulo 7, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    The model: P(w | v) = (c(vw) - DISCOUNT) / c(v) for pairs seen in training, else DISCOUNT * kinds(v) / c(v) * (c(w) + 1) / (N + V + 1),
    and the last factor alone after a v never seen; c, N and V as in the base score, kinds(v) the distinct words after v. The first two
    are kept as bytes. A shard of contexts has all pairs of its contexts, of all documents: it counts those of training, writes a trie of them,
    and looks up each. Hot words, at most 1 / HOT_SHARE, are dealt by both words; what a pair needs of other shards is small or added by a
    join on the word. Words are told apart by 64 bits as contexts and by 48 as next words.

    Nulls and empty texts are the end token alone; documents without doc_id are learnt from. Repeated rows count as often as they
    are. Empty table: no rows. Other columns are ignored; texts are read whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), held_out().alias("held_out"))
    words = rows.where(~F.col("held_out")).mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = settle(words, "lm-words")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens, distinct, documents = words.agg(F.sum("n"), F.count("*"), F.max(F.when(F.col("word") == int(END), F.col("n")))).first()
    tokens, documents = tokens or 0, documents or 0
    hot = words.where(F.col("n") >= max(1, math.ceil(tokens * HOT_SHARE))).collect()  # at most 1 / HOT_SHARE rows
    known = Known(tokens, distinct, [(r["word"], r["n"]) for r in hot], documents)

    bits = max(int(math.log2(LEAST_SHARDS)), math.ceil(math.log2(max(1, size / SHARD_BYTES))))
    parts = settle(rows.mapInArrow(_dealt(known, bits), _BLOBS).groupBy("shard").applyInArrow(_scored(known), _PARTS), "lm-parts")
    kinds = parts.where("kind = 2").mapInArrow(_hot_kinds, "hot long, kinds long").groupBy("hot").agg(F.sum("kinds").alias("kinds")).collect()
    weights = np.zeros(len(known.hot))
    for r in kinds:
        weights[r["hot"]] = quantise(np.log10(DISCOUNT * r["kinds"] / known.hot_n[r["hot"]])) / -STEPS
    short = words.select(F.col("word").bitwiseAND(F.lit(int(_KEY48))).alias("word48"), "n").groupBy("word48").agg(F.sum("n").alias("n"))
    far = parts.where("kind = 0").mapInArrow(_unseen, "key long, chunk long, idx int, many long").join(short, F.col("key") == F.col("word48"), "left")
    value = F.col("many") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - math.log10(tokens + distinct + 1))
    far = far.groupBy("chunk", "idx").agg(F.sum(value).alias("far")).select(F.col("chunk").alias("c"), F.col("idx").alias("i"), "far")
    near = parts.where("kind != 2").groupBy("chunk").applyInArrow(_gathered(known, weights), _DOCS)
    out = near.join(far, (F.col("chunk") == F.col("c")) & (F.col("idx") == F.col("i")), "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
        (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"),
    )
