"""Merkle manifests, conversation repair and SimHash: brute force, and nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnloom.llm import merkle, queries, repair, simhash
from turnloom.operators.components import components

LOW = str.maketrans({i: i + 32 for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11. Merkle


def spelled(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """(top, paths) with a list of (left, right) for each leaf."""
    paths, level, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(of):
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            paths[i].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
        of = [at // 3 for at in of]
    return level[0], paths


def audited(rows):
    by_source = defaultdict(list)
    for r in rows:
        leaf = h(*[spelled(r[c]) for c in merkle.LEAF_COLUMNS])
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
        found = h(*[spelled(r[c].replace("\n", "") if bad and c == "text" else r[c]) for c in merkle.LEAF_COLUMNS])
        by_source[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, found))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s])]) for s in order}
    root, beyond = tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (known, doc_id, leaf, found), path in zip(sorted(by_source[s]), trees[s][1], strict=True):
            whole, d = path + beyond[k], found
            for left, right in whole:
                d = h(left, d, right)
            out.append((doc_id if known else None, leaf, trees[s][0], root, h(*[x + y for x, y in whole]), d, d == root))
    return sorted(out, key=str)


@pytest.fixture
def small_tiers(monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)


def many_rows():
    r = random.Random(3)
    rows = [(k if r.random() < 0.9 else None, r.choice(["a\nb", "", "x" * 50_000, None, "né\n\n", "plain"]), "en", r.choice(["s1"] * 6 + ["s2", "é", None, "S"]), r.choice([None, 3])) for k in range(120)]
    return [*rows, rows[0], rows[0], rows[7], (500, "t\n", None, "alone", 1), (501, "t\n", None, "two", 1), (502, "t", None, "two", 1)]


@pytest.mark.parametrize("n", [126, 1, 0])
def test_merkle_against_brute_force(spark, tmp_path, small_tiers, n):
    rows = many_rows()[:n]
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("tree", "at", "n", "digest", "block", "path", "leaf", "found", "root", "slot", "d")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = audited([dict(zip(names, x, strict=True)) for x in rows]) if n else []
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert n < 100 or {x[-1] for x in want} == {True, False}


def test_merkle_in_one_window_is_the_same(spark):
    docs = spark.createDataFrame(many_rows(), SCHEMA)
    one = merkle.manifest(docs).select("doc_id", "leaf", "root", merkle.proof_digest(F.col("path")).alias("p"))
    merkle.LEVELS, before = 1, merkle.LEVELS
    try:
        assert sorted(map(str, one.collect())) == sorted(map(str, merkle.manifest(docs.repartition(7)).select("doc_id", "leaf", "root", merkle.proof_digest(F.col("path")).alias("p")).collect()))
    finally:
        merkle.LEVELS = before


# 12. Repair


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = [" " if x is None else str(x) for x in (conv, turn)]
        kind, role, text = zlib.crc32(":".join(name).encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def first_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        ended = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not ended else "duplicate" if (role, text) in seen else "truncated" if ended[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Over all states, the cheapest edits that are first in ASCII, with what they give."""
    kept = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", [])}

    def inserted(best):
        best = dict(best)
        for _ in range(2):
            for state, (cost, edits, lines) in list(best.items()):
                to, role = ("a", "assistant") if state == "u" else ("u", "user")
                best[to] = min(best.get(to, (10**9, "", [])), (cost + 5, edits + "I", [*lines, f"{role}:"]))
        return best

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, edits, lines) in inserted(best).items():
            moves = [(cost + 2, edits + "D", lines, state)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (state, role[:1]) in kept:
                    moves.append((cost + more, edits + "K", [*lines, f"{role}:{text}"], kept[state, role[:1]]))
                to, other = ("a", "assistant") if state == "u" else ("u", "user")
                moves.append((cost + 1 + more, edits + "R", [*lines, f"{other}:{text}"], to))
            for *found, to in moves:
                new[to] = min(new.get(to, (10**9, "", [])), tuple(found))
        best = new
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def mended(rows):
    out = {}
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = first_faults(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(mine)]
        cost, audit, lines = cheapest(mine, faults)
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATION = "conv_id long, turn long, role string, text string"


def conversations():
    r = random.Random(11)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.choice([1, 2, 3, 5, 8, 13])):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            text = r.choice(["Yes.", "No!  ", "Well", "", " \n", None, "Hm?\t", "é.", f"Line {turn}.\nMore {conv}", "a. b"])
            rows.append((conv, r.choice([turn] * 8 + [turn * 3, None]), role, text))
    rows += [(77, t, "user" if t % 2 else "assistant", f"Turn {t}." if t % 5 else "Again.") for t in range(150)]
    rows += [(78, 4, "user", "x" * 300_000), (78, 5, "assistant", "y."), (78, 5, "assistant", "y.")]
    return rows


@pytest.mark.parametrize("block", [repair.BLOCK, 4])
def test_repair_against_all_states(spark, monkeypatch, tmp_path, block):
    rows = conversations()
    spark.createDataFrame(rows, CONVERSATION).repartition(3).withColumns({c: F.lit("mine") for c in ("conv", "at", "block", "held", "codes", "kind", "again", "cost", "first")}).write.parquet(f"{tmp_path}/conversations.parquet")
    table = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.repair(repair.damaged(table), table, block) if block == 4 else queries.op12_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r) for r in got.collect()} == mended(rows)


def test_repair_of_nothing_and_of_dropped_rows(spark):
    none = spark.createDataFrame([], CONVERSATION)
    assert repair.repair(none).collect() == []
    gone = spark.createDataFrame([(5, 1, "user", "a.")], CONVERSATION)
    assert [tuple(r) for r in repair.repair(none, gone).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    wide = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], CONVERSATION)
    assert [(r.gaps, r.audit) for r in repair.repair(wide).collect()] == [(None, "KK")]


def test_auction_prices_are_distances():
    r = random.Random(5)
    for _ in range(300):
        codes = "".join(r.choice("uasoUASOx") for _ in range(r.randrange(12)))
        price = repair.prices(codes, repair.END, True)
        far = [0.0 if n >= 4 * len(codes) and n % 4 in repair.ACCEPTS else repair.NEVER for n in range(4 * len(codes) + 4)]
        for _ in range(3 * len(codes) + 12):  # Bellman and Ford
            far = [min([far[n], *(c + far[v] for _, c, v in repair.arcs(codes, n // 4, n % 4, True))]) for n in range(len(far))]
        assert price == far
        for e in range(4):  # crossing a block, where some states lead nowhere
            ends = [0.0 if s == e else repair.NEVER for s in range(4)]
            price = repair.prices(codes, ends, False)
            far = [ends[n % 4] if n >= 4 * len(codes) else repair.NEVER for n in range(4 * len(codes) + 4)]
            for _ in range(3 * len(codes) + 12):
                far = [min([far[n], *(c + far[v] for _, c, v in repair.arcs(codes, n // 4, n % 4, False))]) for n in range(len(far))]
            assert price == far


# 13. SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def reach(fps):
    """Least number reachable from each of a list of fingerprints."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    f = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark, tmp_path):
    r = random.Random(2)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(n)) for n in (600, 900, 1500, 4000)]
    texts = [*base]
    for k in range(60):
        w = base[k % 4].split(" ")
        for _ in range(k % 3 + 1):
            w[r.randrange(len(w))] = f"v{k}"
        texts.append(" ".join(w))
    texts += [base[0].upper(), base[0].replace(" ", "\n\t"), None, "", "  ", "one", "One TWO", "É b", "é b", "one two three", "a b c d", "\x1f x\x85y  z", "long words " * 20_000 + "end"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, base[0]), (None, "nobody else")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("fp", "least", "root", "a", "b", "fingerprint", "source")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_simhash(spark, str(tmp_path))
    fps = [plain_fingerprint(t) for _, t in rows]
    roots, least = reach(fps), {}
    for (i, _), c in zip(rows, roots, strict=True):
        least[c] = min(x for x in (least.get(c), i) if x is not None) if (least.get(c), i) != (None, None) else None
    want = [(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, roots, strict=True)]
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str)
    assert len(set(roots)) < len(set(fps)) < len(fps)


def test_links_join_all_that_are_near(spark, monkeypatch):
    r = random.Random(9)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    centres = [r.getrandbits(64) for _ in range(40)]
    fps = {0, 3, 2**64 - 1, 2**63, *centres}
    crowd = centres[0]
    fps |= {flip(crowd, r.choice([1, 2, 3, 5])) for _ in range(400)} | {crowd & ~0xFFFFF | r.getrandbits(20) for _ in range(400)}
    for c in centres[1:]:
        for _ in range(8):
            fps.add(c := flip(c, r.choice([1, 2, 2, 3, 4])))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    for bucket, three in [(simhash.BUCKET, simhash.THREE_UP_TO), (4, 0)]:
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        monkeypatch.setattr(simhash, "THREE_UP_TO", three)
        found = simhash.links(nodes)
        assert all(((x.a ^ x.b) & (2**64 - 1)).bit_count() <= 2 for x in found.collect())
        signed = [int(np.uint64(x).view(np.int64)) for x in fps]
        roots, comps = reach(fps), {x.a: x.b for x in components(found).collect()}
        groups = defaultdict(set)
        for s, c in zip(signed, roots, strict=True):
            groups[c].add(comps.get(s, s))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    assert simhash.links(nodes.limit(0)).count() == 0


def test_thresholds_sum_to_the_bound_and_avoid_full_values(spark):
    r = np.random.default_rng(4)
    fps = r.integers(0, 2**63, 3000, np.int64)
    fps[:1500] &= ~np.int64(0x1FFFFF)  # half of them agree in 21 bits
    plan = simhash.partitions(spark.createDataFrame([(int(x),) for x in np.unique(fps)], "fp long"))
    assert sorted(b for g in plan.groups for b in g) == list(range(64))
    chosen, _ = plan.thresholds(fps)
    assert (chosen.sum(axis=1) == 2 - len(plan.groups) + 1).all() and len({tuple(x) for x in chosen}) > 1


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
