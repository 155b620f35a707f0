"""SimHash near-duplicates: fingerprints, and those within two bits of each other by the generalised pigeonhole principle."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm._spark import settle
from turnloom.operators.components import components

# Fixed values of the contract.
SHINGLE, SEED, DISTANCE, BITS = 3, 42, 2, 64

#: Fingerprints from which the correlation of bits is learnt. It decides which bits go together, so only how many candidates there are.
SAMPLE = 20_000
#: Distinct fingerprints up to which there are three partitions of about 21 bits; beyond, two of 32.
THREE_UP_TO = 1 << 24
#: Bits of a part of a partition, whose values are counted over all fingerprints.
COUNTED_BITS = 11
#: A bucket of more fingerprints than this is not probed: who would probe it looks all around itself instead.
BUCKET = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15

_ONES = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """Bits that are set in over half of the hashes of a text's shingles, as signed 64-bit number; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and the six spaces of ASCII
    if not words:
        return 0
    shingles = zip(*(words[k:] for k in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    n, held = max(len(words) - SHINGLE + 1, 1), np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for chunk in itertools.batched(shingles, CHUNK):
        h = np.fromiter((digest(join(s), SEED) for s in chunk), np.uint64, len(chunk))
        held += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_ONES[2 * held > n].sum(dtype=np.uint64).view(np.int64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        found = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts), np.int64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of docs (doc_id, text). A null text has no words, so fingerprint 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def correlated(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in so many groups of about equal size: each group begins with the bit that goes most with the ones left, and takes those that go most with it."""
    bits = ((sample.view(np.uint64)[:, None] & _ONES) != 0).astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0))
    tied = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-12)
    np.fill_diagonal(tied, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (tied[b, left].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: (tied[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        groups.append(group)
    return groups


def _codes(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    u = fp.view(np.uint64)
    return sum((((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)).astype(np.int64) for k, b in enumerate(bits))


def _around(width: int, distance: int) -> np.ndarray:
    """Numbers of so many bits with that many ones."""
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), distance)], np.int64)


def _flips(bits: list[int], threshold: int) -> np.ndarray:
    """All ways to flip up to `threshold` of the bits."""
    return np.array([sum(1 << b for b in c) for t in range(threshold + 1) for c in itertools.combinations(bits, t)], np.uint64)


class Partitions:
    """Groups of bits with the counts of all fingerprints, and the thresholds of each fingerprint by dynamic programming."""

    def __init__(self, groups: list[list[int]], counts: list[list[np.ndarray]], total: int):
        """counts: for each group and each of its parts of COUNTED_BITS, how many fingerprints have each value."""
        self.groups, self.total = groups, total
        self.masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
        self.parts = [self.cut(g) for g in groups]
        # The share of fingerprints at distance 0, 1 and 2 of each value of a part.
        self.near = []
        for parts, held in zip(self.parts, counts, strict=True):
            own = []
            for bits, n in zip(parts, held, strict=True):
                at = np.arange(1 << len(bits))
                own.append(np.stack([n[at[:, None] ^ _around(len(bits), d)].sum(axis=1) for d in range(DISTANCE + 1)], axis=1) / max(total, 1))
            self.near.append(own)
        self.flips = [[_flips(g, t) for t in range(DISTANCE + 1)] for g in groups]

    @staticmethod
    def cut(group: list[int]) -> list[list[int]]:
        n = -(-len(group) // COUNTED_BITS)
        return [group[k * len(group) // n : (k + 1) * len(group) // n] for k in range(n)]

    def expected(self, fp: np.ndarray, group: int) -> np.ndarray:
        """Candidates that a threshold of 0, 1 or 2 in a group is expected to bring: its parts taken as independent."""
        share = np.zeros((len(fp), DISTANCE + 1))
        share[:, 0] = 1
        for bits, near in zip(self.parts[group], self.near[group], strict=True):
            p = near[_codes(fp, bits)]
            share = np.stack([sum(share[:, k] * p[:, d - k] for k in range(d + 1)) for d in range(DISTANCE + 1)], axis=1)
        return self.total * share.cumsum(axis=1)

    def thresholds(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(threshold of each group, cost) of each fingerprint. Thresholds from -1 (not probed) to 2 that sum to 2 - groups + 1: if all groups of bits differed in
        more, the whole would differ in more than 2. The sum of probes and expected candidates is least."""
        goal = DISTANCE - len(self.groups) + 1
        best = {0: (np.zeros(len(fp)), np.zeros((len(fp), 0), np.int8))}
        for g in range(len(self.groups)):
            expected = self.expected(fp, g)
            new: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for (spent, (cost, chosen)), t in itertools.product(best.items(), range(-1, DISTANCE + 1)):
                more = cost + (0 if t < 0 else len(self.flips[g][t]) + expected[:, t])
                picked = np.column_stack([chosen, np.full(len(fp), t, np.int8)])
                if spent + t in new:
                    old, old_picked = new[spent + t]
                    less = more < old
                    more, picked = np.where(less, more, old), np.where(less[:, None], picked, old_picked)
                new[spent + t] = (more, picked)
            best = new
        return best[goal][1], best[goal][0]

    def probes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, key, q) of the buckets that each fingerprint probes; part -1 for those that had better look all around themselves."""
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            chosen, cost = self.thresholds(fp)
            around = cost > BITS + 1
            out = [(np.full(around.sum(), -1), np.zeros(around.sum(), np.uint64), fp[around])]
            for g, t in itertools.product(range(len(self.groups)), range(DISTANCE + 1)):
                q = fp[~around & (chosen[:, g] == t)]
                flips = self.flips[g][t]
                key = ((q.view(np.uint64) & self.masks[g])[:, None] ^ flips).ravel()
                out.append((np.full(len(key), g), key, np.repeat(q, len(flips))))
            part, key, q = (np.concatenate(x) for x in zip(*out, strict=True))
            for k in range(0, len(q), 1 << 18):
                s = slice(k, k + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(part[s].astype(np.int32)), pa.array(key[s].view(np.int64)), pa.array(q[s])], names=["part", "key", "q"])


def partitions(nodes: DataFrame) -> Partitions:
    """Partitions for the distinct fingerprints of nodes (fp): bits grouped by a sample of SAMPLE, values counted over all of them."""
    total = nodes.count()
    sample = np.array([r.fp for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    groups = correlated(sample, 3 if total <= THREE_UP_TO else 2)
    parts = [(g, k, bits) for g, group in enumerate(groups) for k, bits in enumerate(Partitions.cut(group))]
    code = lambda bits: " | ".join(f"shiftleft(shiftrightunsigned(fp, {b}) & 1, {k})" for k, b in enumerate(bits))
    values = ", ".join(f"struct({g} AS g, {k} AS k, {code(bits)} AS v)" for g, k, bits in parts)
    held = nodes.selectExpr(f"explode(array({values})) AS x").groupBy("x.g", "x.k", "x.v").count()
    counts = [[np.zeros(1 << len(bits), np.int64) for bits in Partitions.cut(group)] for group in groups]
    for r in held.collect():  # at most 2 ** COUNTED_BITS for each part of some ten bits
        counts[r.g][r.k][r.v] = r["count"]
    return Partitions(groups, counts, total)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that join all of the distinct fingerprints of nodes (fp) that differ in two bits or fewer, directly or over others.

    Each fingerprint probes buckets of equal bits by its own thresholds and is compared with what it finds there. One that would need more probes and
    candidates than it has neighbours of one bit, or meets a bucket of more than BUCKET, names itself and these neighbours: two that differ in at most
    two bits name one in common, and all that name it (65 at most) differ in at most two. Such a one and one of the others are found by the
    other's probes. So no pair is lost, and a fingerprint costs a bounded number of rows however many are like it.
    """
    plan = partitions(nodes)
    probes = settle(nodes.select("fp").mapInArrow(plan.probes, "part int, key long, q long"), "simhash-probes")
    index = nodes.select(F.col("fp").alias("x"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))) for m in plan.masks])).alias("part", "key"))
    full = index.groupBy("part", "key").count().where(F.col("count") > BUCKET).select("part", "key")
    around = settle(probes.where("part = -1").select("q").unionByName(probes.join(full, ["part", "key"], "left_semi").select("q")).distinct(), "simhash-around")
    met = probes.where("part >= 0").join(around, "q", "left_anti").join(index, ["part", "key"])
    met = met.where((F.col("q") != F.col("x")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("x"))) <= DISTANCE))
    near = F.array(F.col("q"), *[F.col("q").bitwiseXOR(F.lit(int(m.view(np.int64)))) for m in _ONES])
    named = around.select("q", F.explode(near).alias("z")).groupBy("z").agg(F.array_sort(F.collect_set("q")).alias("all")).where(F.size("all") > 1)
    stars = named.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, BITS + 1)).alias("b"))
    return settle(met.select(F.least("q", "x").alias("a"), F.greatest("q", "x").alias("b")).unionByName(stars).distinct(), "simhash-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    fingerprint: 16 hexadecimal digits, by words parted by ASCII spaces, lower-cased A-Z, in shingles of three with repeats (fewer words: one shingle of all).
    component_id: the least doc_id that is reachable over fingerprints that differ in two bits or fewer.

    Equal fingerprints are one node, so copies cost nothing beyond their hashing. Null and empty texts have fingerprint 0 and link like any other. Null
    doc_ids link too, but are no component's least; a component of none but them is null. Repeated rows come as often as they are. A
    doc_id with several texts has a row for each. Empty table: no rows. Further columns are ignored.
    """
    found = settle(fingerprints(docs), "simhash-fingerprints")
    nodes = settle(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
