"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with its transpose."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm._arrow import LOWER_BYTES, SPACE_BYTES, chunks, hashes, lists, mix, spans, window_hashes
from turnloom.llm._spark import settle
from turnloom.operators.components import components

SHINGLE, PERCENT = 5, 75
#: Bytes of text for each block of columns (n-grams); there are LEAST_BLOCKS at least.
BLOCK_BYTES, LEAST_BLOCKS = 12 << 20, 32
#: Texts of a column that all others are compared with, before all pairs that are still apart are.
HUBS = 3

#: An n-gram of so many texts of a slice is common: its texts go past the block of columns, which only learns how many there are.
COMMON = 8
#: Keys (8 bytes) that a step of the product takes at once, and its blocks of columns.
PRODUCT_KEYS, PRODUCT_BLOCKS = 1 << 20, 8

# Rows of packed arrays: entries by node (kind 0), documents of a slice (1), texts of a common n-gram in a slice (2), how many there are (3),
# levels of common n-grams (4).
_BLOCKS = "kind int, block long, nodes binary, sizes binary, counts binary, low binary, high binary, levels binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("nodes", "sizes", "counts", "low", "high", "levels")]])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each row, by row and hash. A text of fewer words has them all as one shingle."""
    n = len(offsets) - 1
    start, end, row = spans(SPACE_BYTES[data], offsets)
    words = hashes(LOWER_BYTES[data], start, end)
    key, at = window_hashes(words, row, SHINGLE)
    keys, rows = [key], [row[at]]
    held = np.bincount(row, minlength=n)
    first = lists(row, n)
    for k in range(1, SHINGLE):
        short = np.flatnonzero(held == k)
        h = np.full(len(short), k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = mix(h * np.uint64(0xA0761D6478BD642F) + words[first[short] + j])
        keys.append(h)
        rows.append(short)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(key)
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    key, row = key[order], row[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])][: len(key)]
    return key[new], row[new]


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _runs(block: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of the runs of a sorted array."""
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
    yield from zip(block[first].tolist(), first.tolist(), [*first[1:].tolist(), len(block)][: len(first)], strict=True)


def _split(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            n = rows.num_rows
            node = rows.column("node").to_numpy(zero_copy_only=False)
            key, row = shingle_sets(data, offsets)
            sizes = np.bincount(row, minlength=n).astype(np.int32)
            ids = rows.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            # The rows of the slice go along as one row, so that texts are cut into shingles once.
            apart = -1 - int(node[0]) % (1 << bits)
            out = [(1, apart, node.tobytes(), sizes.tobytes(), known.tobytes(), ids.astype(np.int64).tobytes(), b"", b"")]
            # Copies of a text in the slice count once.
            once = np.zeros(n, bool)
            once[np.unique(node, return_index=True)[1]] = True
            key, row = key[once[row]], row[once[row]]
            ordered = np.sort(key)
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
            many = np.diff(np.r_[first, len(ordered)])
            common, many = ordered[first[many >= COMMON]], many[many >= COMMON]
            if len(common):
                at = np.minimum(np.searchsorted(common, key), len(common) - 1)
                hot = common[at] == key
                held = row[hot][np.argsort(at[hot], kind="stable")]
                ends = np.cumsum(many)
                for k, i, j in zip(common.view(np.int64).tolist(), (ends - many).tolist(), ends.tolist(), strict=True):
                    out.append((2, apart, node[held[i:j]].tobytes(), sizes[held[i:j]].tobytes(), b"", k.to_bytes(8, "little", signed=True), b"", b""))
                for b, i, j in _runs((common >> np.uint64(64 - bits)).astype(np.int64)):
                    out.append((3, b, b"", b"", many[i:j].astype(np.int64).tobytes(), common[i:j].tobytes(), b"", b""))
                key, row = key[~hot], row[~hot]
            block = (key >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            low, high = key.astype(np.uint32)[order], (key >> np.uint64(32)).astype(np.uint16)[order]
            row = row[order]
            for b, i, j in _runs(block[order]):
                own, counts = np.unique(row[i:j], return_counts=True)
                out.append((0, b, node[own].tobytes(), sizes[own].tobytes(), counts.astype(np.uint32).tobytes(), low[i:j].tobytes(), high[i:j].tobytes(), b""))
            yield _pack(out)

    return run


def _joined(table: pa.Table, kind: int, **types: type) -> dict[str, np.ndarray]:
    """The packed arrays of the rows of a kind, one after another."""
    mine = table.filter(pc.equal(table.column("kind"), kind))
    return {c: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in mine.column(c).to_pylist())]) for c, t in types.items()}


def _level(many: np.ndarray) -> np.ndarray:
    """How common an n-gram is, in eighths of a power of two."""
    return np.minimum(255, 8 * np.log2(np.maximum(many, 1))).astype(np.uint8)


def _dealt(key: np.ndarray, node: np.ndarray, size: np.ndarray, level: np.ndarray, groups: int) -> list[tuple]:
    """Entries as rows for the blocks of rows."""
    group = (node.view(np.uint64) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((node, group))
    key, node, size, level, group = (x[order] for x in (key, node, size, level, group))
    out = []
    for g, i, j in _runs(group):
        own, at, counts = np.unique(node[i:j], return_index=True, return_counts=True)
        k = key[i:j]
        out.append((0, g, own.tobytes(), size[i:j][at].tobytes(), counts.astype(np.uint32).tobytes(), k.astype(np.uint32).tobytes(), (k >> np.uint64(32)).astype(np.uint32).tobytes(), level[i:j].tobytes()))
    return out


def _shared(bits: int):
    """For a block of columns: the entries in columns with two nodes at least, dealt to blocks of rows, and levels of the common n-grams."""
    def run(table: pa.Table) -> pa.Table:
        if table.column("block")[0].as_py() < 0:
            return table
        block = np.uint64(table.column("block")[0].as_py()) << np.uint64(64 - bits)
        told = _joined(table, 3, low=np.uint64, counts=np.int64)
        got = _joined(table, 0, nodes=np.int64, sizes=np.int32, counts=np.uint32, low=np.uint32, high=np.uint16)
        del table
        many = got["counts"].astype(np.int64)
        node, size = np.repeat(got["nodes"], many), np.repeat(got["sizes"], many)
        # What is kept of a key: its low 48 bits and, by the block, its first ones.
        key = got["high"].astype(np.uint64) << np.uint64(32) | got["low"]
        del got
        common, at = np.unique(told["low"], return_inverse=True)
        common_many = np.bincount(at, told["counts"], minlength=len(common)).astype(np.int64)
        common = common & np.uint64((1 << 48) - 1)
        # Copies of a text are one node: their entries fall together.
        order = np.lexsort((node, key))
        key, node, size = key[order], node[order], size[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]
        key, node, size = key[new], node[new], size[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        many = np.diff(np.r_[first, len(key)])
        # Columns that are common in some slices have both kinds of entries.
        order = np.argsort(common)
        common, common_many = common[order], common_many[order]
        both = np.zeros(len(first), np.int64)
        if len(common) and len(first):
            i = np.minimum(np.searchsorted(common, key[first]), len(common) - 1)
            same = common[i] == key[first]
            both[same] = common_many[i[same]]
            common_many[i[same]] += many[same]
        level = np.repeat(_level(many + both), many)
        keep = np.repeat(many + both > 1, many)
        out = _dealt(key[keep] | block, node[keep], size[keep], level[keep], 1 << bits)
        if len(common):
            out.append((4, 0, b"", b"", b"", (common | block).tobytes(), b"", _level(common_many).tobytes()))
        return pa.Table.from_batches([_pack(out)] if out else [], schema=_SCHEMA)

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low, level in zip(b.column("low").to_pylist(), b.column("levels").to_pylist(), strict=True):
            yield pa.RecordBatch.from_pydict({"common": np.frombuffer(low, np.int64), "level": np.frombuffer(level, np.uint8).astype(np.int32)})


def _common_keys(bits: int):
    """Texts of the common n-grams, with the key as _shared() names it."""
    mask = (1 << 64) - (1 << (64 - bits)) | (1 << 48) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array([int.from_bytes(x, "little") & mask for x in b.column("low").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"key": keys, "nodes": b.column("nodes"), "sizes": b.column("sizes")})

    return run


def _common_entries(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes = ([np.frombuffer(x, t) for x in b.column(c).to_pylist()] for c, t in (("nodes", np.int64), ("sizes", np.int32)))
            many = [len(x) for x in nodes]
            key, level = b.column("key").to_numpy().view(np.uint64), b.column("level").to_numpy().astype(np.uint8)
            if sum(many):
                yield _pack(_dealt(np.repeat(key, many), np.concatenate(nodes), np.concatenate(sizes), np.repeat(level, many), groups))

    return run


_CANDIDATES = "node long, n int, s int, central int, shingles binary"


def _candidates(table: pa.Table) -> pa.Table:
    """For a block of rows: nodes of which enough n-grams are shared for any link, with these n-grams, rarest first, and how central they are:
    the mean level of their n-grams, where unshared ones count 0. In a group of near copies it is highest for the text that the others come from."""
    got = _joined(table, 0, nodes=np.int64, sizes=np.int32, counts=np.uint32, low=np.uint32, high=np.uint32, levels=np.uint8)
    many = got["counts"].astype(np.int64)
    node, size = np.repeat(got["nodes"], many), np.repeat(got["sizes"], many)
    key = got["high"].astype(np.int64) << 32 | got["low"]
    order = np.lexsort((key, got["levels"], node))
    node, size, key, level = node[order], size[order], key[order], got["levels"][order]
    # A text of several slices comes with a common n-gram once for each.
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]
    node, size, key, level = node[new], size[new], key[new], level[new]
    own, first, shared = np.unique(node, return_index=True, return_counts=True)
    n = size[first]
    keep = 100 * shared >= PERCENT * n
    central = np.add.reduceat(level.astype(np.int64), first) * 256 // n if len(first) else n
    sets = [key[a : a + s].tobytes() for a, s in zip(first[keep], shared[keep], strict=True)]
    return pa.table({
        "node": own[keep], "n": n[keep].astype(np.int32), "s": shared[keep].astype(np.int32), "central": central[keep].astype(np.int32), "shingles": pa.array(sets, pa.binary()),
    })


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, node, n, s, central, at): the n-grams of which linked nodes share one. Both of a pair share at least the bound of either, so
    none can hide behind the first s - bound + 1."""
    for b in batches:
        n, s = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "s"))
        many = s - (PERCENT * n + 99) // 100 + 1
        keys = [np.frombuffer(x, np.int64)[:m] for x, m in zip(b.column("shingles").to_pylist(), many, strict=True)]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield pa.RecordBatch.from_pydict({
            "h": np.concatenate([*keys, np.zeros(0, np.int64)]),
            "node": np.repeat(b.column("node").to_numpy(), many),
            "n": np.repeat(n, many).astype(np.int32),
            "s": np.repeat(s, many).astype(np.int32),
            "central": np.repeat(b.column("central").to_numpy(), many),
            "at": at.astype(np.int32),
        })


def product(left: list[np.ndarray], right: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Which pairs of rows of the incidence matrix (the distinct n-grams of each) share at least need[i] columns.

    The product is taken block of columns by block: each adds to the overlap counts of the pairs that are left, and a pair goes as
    soon as its count and what either row has in the blocks to come cannot reach the bound.
    """
    n = len(need)
    pair = np.repeat(np.tile(np.arange(n), 2), [len(x) for x in (*left, *right)])
    key = np.concatenate([*left, *right, np.zeros(0, np.int64)])
    side = np.arange(len(key)) >= sum(map(len, left))
    block = (key % PRODUCT_BLOCKS).astype(np.int8)
    count, live = np.zeros(n, np.int64), np.ones(n, bool)
    rest = np.stack([np.bincount(pair[~side], minlength=n), np.bincount(pair[side], minlength=n)])
    for b in range(PRODUCT_BLOCKS):
        live &= count + rest.min(axis=0) >= need
        mine = np.flatnonzero((block == b) & live[pair])
        p, k = pair[mine], key[mine]
        rest[0] -= np.bincount(p[~side[mine]], minlength=n)
        rest[1] -= np.bincount(p[side[mine]], minlength=n)
        order = np.lexsort((k, p))
        p, k = p[order], k[order]
        count += np.bincount(p[1:][(p[1:] == p[:-1]) & (k[1:] == k[:-1])], minlength=n)
    return live & (count >= need)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose intersection reaches the threshold."""
    for whole in batches:
        i = 0
        size = np.cumsum(whole.column("s_a").to_numpy().astype(np.int64) + whole.column("s_b").to_numpy())
        while i < whole.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PRODUCT_KEYS, "right")))
            b, i = whole.slice(i, j - i), j
            left, right = ([np.frombuffer(x, np.int64) for x in b.column(c).to_pylist()] for c in ("set_a", "set_b"))
            n = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            keep = product(left, right, -(-PERCENT * n // (100 + PERCENT)))
            yield pa.RecordBatch.from_pydict({"a": b.column("a").to_numpy()[keep], "b": b.column("b").to_numpy()[keep]})


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"), F.col("shingles").alias("set_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"), F.col("shingles").alias("set_b"))
    return settle(pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_overlaps, "a long, b long"), "jaccard-links")


def _possible(x: str, y: str) -> object:
    """Size and position bounds of a pair that meets in a column: what can be shared at most reaches what has to be."""
    need = F.ceil(F.lit(PERCENT) * (F.col(f"{x}.n") + F.col(f"{y}.n")) / F.lit(100.0 + PERCENT) - 1e-9)
    return 1 + F.least(F.col(f"{x}.s") - F.col(f"{x}.at") - 1, F.col(f"{y}.s") - F.col(f"{y}.at") - 1) >= need


def _stars(prefixes: DataFrame, hubs: int) -> DataFrame:
    """Pairs of each node with some nodes of each of its columns: the most central one, and others by as many hashes as hubs are left."""
    told = ["node", "n", "s", "at"]
    by = [F.max(F.struct(F.col("central").cast("long").alias("by"), *told))]
    by += [F.max(F.struct(F.xxhash64("node", F.lit(k)).alias("by"), *told)) for k in range(1, hubs)]
    hub = prefixes.groupBy("h").agg(F.array_distinct(F.array(*by)).alias("hubs"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    hub = hub.where("c0 != c1").select(F.col("h").alias("hub_h"), F.explode("hubs").alias("hub"))
    met = prefixes.alias("p").join(hub, F.col("h") == F.col("hub_h")).where(F.col("p.node") != F.col("hub.node")).where(_possible("p", "hub"))
    return met.select(F.least("p.node", "hub.node").alias("a"), F.greatest("p.node", "hub.node").alias("b")).distinct()


def _merged(prefixes: DataFrame) -> DataFrame:
    """Columns that hold the same nodes as one, at each node's least place in them: its bound is then that of the first they meet in."""
    same = prefixes.groupBy("h").agg(F.struct(F.count("*"), F.sum(F.xxhash64("node").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("node", F.lit(1)))).alias("same"))
    same = same.select(F.col("h").alias("same_h"), F.xxhash64("same").alias("same"))
    out = prefixes.join(same, F.col("h") == F.col("same_h"))
    return out.groupBy("same", "node", "n", "s", "central", "comp").agg(F.min("at").alias("at")).withColumnRenamed("same", "h")


def _mixed(prefixes: DataFrame, known: DataFrame) -> DataFrame:
    """The columns that have nodes of several components."""
    left = _labelled(prefixes.select("h", "node", "n", "s", "central", "at"), known)
    mixed = left.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("h")
    return settle(left.join(mixed, "h"), "jaccard-left")


def _labelled(prefixes: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return prefixes.withColumn("comp", F.col("node"))
    found = known.select(F.col("a").alias("known"), F.col("b").alias("root"))
    return prefixes.join(found, F.col("node") == F.col("known"), "left").withColumn("comp", F.coalesce("root", "node")).drop("known", "root")


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    The incidence matrix is cut into blocks of columns: a task has all entries of its n-grams and drops those of one text only.
    An n-gram of COMMON texts of a slice or more is shared anyway: the block learns only how many texts have it there, so what a column brings to one
    task is bounded by the slices and not by its texts. Blocks of rows then gather what is left of each text; a text of which less than 75 % of its
    n-grams is shared has no link.

    The product of the rows is masked: a pair is multiplied out where it first meets, at one of the rarest n-grams up to the size bound, if the size and
    position bounds leave it possible. First each text with the most central text of each of its columns, then, where a column still has several
    components, with HUBS texts of it, and then, exactly, all pairs of a column that are not yet in one component. So a large group of
    near copies costs pairs in proportion to its texts, and no link between components is lost.

    n-grams are told apart by 48 bits and those of the block's number (53 at least), texts by 64. Copies of a text are one
    node. Nulls and empty texts have no n-grams and link with nothing; null doc_ids are left alone with component null.
    Repeated rows come as often as they are; rows of one doc_id with several texts count as linked through it. Empty table: no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(int(math.log2(LEAST_BLOCKS)), math.ceil(math.log2(max(1, total / BLOCK_BYTES))))
    blocks = rows.mapInArrow(_split(bits), _BLOCKS)
    shared = settle(blocks.groupBy("block").applyInArrow(_shared(bits), _BLOCKS), "jaccard-shared")
    levels = shared.where("kind = 4").mapInArrow(_levels, "common long, level int")
    common = shared.where("kind = 2").mapInArrow(_common_keys(bits), "key long, nodes binary, sizes binary")
    common = common.join(levels, F.col("key") == F.col("common")).select("key", "nodes", "sizes", "level").mapInArrow(_common_entries(1 << bits), _BLOCKS)
    entries = shared.where("kind = 0").unionByName(common)
    nodes = settle(entries.groupBy("block").applyInArrow(_candidates, _CANDIDATES), "jaccard-nodes")
    members = shared.where("kind = 1").mapInArrow(_members, "doc_id long, node long, n_shingles long")
    prefixes = settle(nodes.mapInArrow(_prefixes, "h long, node long, n int, s int, central int, at int"), "jaccard-prefixes")

    known = components(_verified(_stars(_labelled(prefixes, None), 1), nodes))
    left = _merged(_mixed(prefixes, known))
    known = components(known.unionByName(_verified(_stars(left, HUBS), nodes)))
    left = _mixed(left, known)
    pairs = left.alias("x").join(left.alias("y"), "h").where("x.node < y.node AND x.comp != y.comp").where(_possible("x", "y"))
    pairs = settle(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "jaccard-pairs")
    known = components(known.unionByName(_verified(pairs, nodes)))

    # Components of texts become components of doc_ids: the least doc_id of each.
    found = known.select(F.col("a").alias("known"), F.col("b").alias("root"))
    rooted = members.join(found, F.col("node") == F.col("known"), "left").withColumn("root", F.coalesce("root", "node"))
    rooted = settle(rooted.select("doc_id", "n_shingles", "root"), "jaccard-members")
    least = rooted.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"))
    least = least.where("many > 1").select(F.col("root").alias("r"), "least")
    return rooted.join(least, (F.col("root") == F.col("r")) & (F.col("n_shingles") > 0), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for node, size, known, ids in zip(*(b.column(c).to_pylist() for c in ("nodes", "sizes", "counts", "low")), strict=True):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool)),
                "node": np.frombuffer(node, np.int64),
                "n_shingles": np.frombuffer(size, np.int32).astype(np.int64),
            })


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one with the least doc_id. Documents without words, and those without
    doc_id, all stay; of repeated rows of one doc_id one stays."""
    groups = similar_groups(docs)
    kept = groups.where("component_id = doc_id OR n_shingles = 0").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    has_words = F.regexp_like(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    many = groups.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    many = settle(many, "jaccard-repeated")
    if many.isEmpty():
        once = stay
    else:
        again = stay.join(many, "doc_id", "left_semi")
        once = stay.join(many, "doc_id", "left_anti").unionByName(again.where(has_words).dropDuplicates(["doc_id"])).unionByName(again.where(~has_words)).select(*docs.columns)
    return once.unionByName(docs.where(F.col("doc_id").isNull()))
