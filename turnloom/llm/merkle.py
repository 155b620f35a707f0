"""A Merkle manifest of a dataset: trees of digests by lag and lead windows, proofs, and their recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.llm._spark import ranked, settle

#: Nodes that become one parent.
FANOUT = 3
#: Levels that a window takes at once: its partition has FANOUT ** LEVELS consecutive nodes of a tree.
LEVELS = 6

#: What a row's digest covers, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def spelled(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value; so no two rows of values are spelled alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The digest of a row over LEAF_COLUMNS; instead: what stands for some of them."""
    return F.sha2(F.concat(*[spelled(instead.get(c, F.col(c))) for c in LEAF_COLUMNS]), 256)


def _tier(nodes: DataFrame) -> DataFrame:
    """nodes (tree, at, n, digest) with `path`, up to LEVELS of (left, right): the siblings on either side of each of a node's ancestors, from itself up;
    and `up`, the digest of the last ancestor.

    Every row holds the digest of its ancestor of the level at hand. The ancestor's siblings are held by the rows one and two ancestors' widths away, so
    each level takes lags and leads of fixed offsets, masked by the slot in the run and the run's length. At the ragged end of a tree the row that far off
    can be missing while the sibling is there: then it is the last one, which the last row holds. Rows below a first child hash the parent, the others
    get it by lag.
    """
    order = "OVER (PARTITION BY tree, block ORDER BY at)"
    whole = "OVER (PARTITION BY tree, block ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    out = nodes.selectExpr("*", f"at DIV {FANOUT**LEVELS} AS block", "digest AS d")
    for level in range(LEVELS):
        width, k = FANOUT**level, range(1, FANOUT)
        node, held = f"at DIV {width}", f"((n + {width - 1}) DIV {width})"
        first = f"({node} - {node} % {FANOUT})"
        kept = [c for c in out.columns if c != "d"]
        out = out.selectExpr(
            "*",
            f"{node} % {FANOUT} AS slot",
            f"least({FANOUT}, {held} - {first}) AS run",
            *[f"lag(d, {x * width}) {order} AS lag{x}" for x in k],
            *[f"coalesce(lead(d, {x * width}) {order}, last(d) {whole}) AS lead{x}" for x in k],
        )
        left = ", ".join(f"IF(slot >= {x}, lag{x}, NULL)" for x in reversed(k))
        right = ", ".join(f"IF(slot + {x} < run, lead{x}, NULL)" for x in k)
        out = out.selectExpr(*kept, "d", "slot", f"IF({held} > 1, struct(concat_ws('', {left}) AS left, concat_ws('', {right}) AS right), NULL) AS path{level}")
        out = out.selectExpr("*", f"IF(slot = 0, sha2(concat(d, path{level}.right), 256), NULL) AS parent")
        told = " ".join(f"WHEN slot = {x} THEN lag(parent, {x * width}) {order}" for x in k)
        out = out.selectExpr(*kept, f"path{level}", f"CASE WHEN {held} = 1 THEN d WHEN slot = 0 THEN parent {told} END AS d")
    levels = ", ".join(f"path{level}" for level in range(LEVELS))
    return out.selectExpr(*[f"`{c}`" for c in nodes.columns], "block", f"filter(array({levels}), s -> s IS NOT NULL) AS path", "d AS up")


def climb(nodes: DataFrame) -> DataFrame:
    """nodes (tree, at, n, digest) with path, the siblings of all ancestors below the top, and top, the digest of the tree.

    at: the place in the tree from 0, n: the nodes of the tree. Tiers of LEVELS levels are settled from below, each FANOUT ** LEVELS times smaller, until
    every tree is one node; paths are then put together from above. No task holds more of a tree than a block of it.
    """
    tiers = [settle(_tier(nodes), "merkle-tier")]
    while True:
        size = FANOUT**LEVELS
        most = tiers[-1].agg(F.max("n")).first()[0] or 0
        if most <= size:
            break
        heads = tiers[-1].where(F.col("at") % size == 0)
        tiers.append(settle(_tier(heads.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / size).alias("n"), F.col("up").alias("digest"))), "merkle-tier"))
    above = tiers.pop().withColumnRenamed("up", "top")
    while tiers:
        upper = above.select("tree", F.col("at").alias("block"), F.col("path").alias("upper"), "top")
        above = tiers.pop().drop("up").join(upper, ["tree", "block"]).withColumn("path", F.concat("path", "upper")).drop("upper")
    return above.drop("block")


def folded(start: Column, path: Column) -> Column:
    """The top digest that a leaf and its path give."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest for a proof: of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, found, subroot, root, path) for each row of docs (doc_id, source, lang, n_chars, text).

    A source's leaves are ordered by doc_id (nulls first, then by leaf) into a tree, whose top is the subroot; subroots, ordered by source (null first, then by
    UTF-8 bytes), make the tree of the dataset. path leads from a leaf over its subroot to the root. found: the digest of the row as it is found
    now, where that is not the leaf; fold it with the path to see whether it still gives the root.

    Each text is read once and its digests go on alone. Repeated rows are leaves of their own, with equal digests. Nulls are `-`; a null source is a source.
    A table of one row has an empty path, and its leaf is the root. Empty table: no rows. Further columns are ignored.
    """
    rows = docs.select("doc_id", "source", leaf().alias("digest"), (leaf() if found is None else found).alias("found"))
    rows = settle(rows.withColumn("tree", spelled(F.col("source"))), "merkle-leaves")  # dealing in ranges reads its input twice
    rows = ranked(rows, ["tree"], ["doc_id", "digest"])
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n"))
    trees = climb(rows.join(sizes, "tree"))
    tops = settle(trees.where("at = 0").select("source", F.col("tree").alias("name"), F.col("top").alias("digest"), F.lit("").alias("tree")), "merkle-tops")
    roots = climb(ranked(tops, ["tree"], ["source"]).withColumn("n", F.lit(tops.count()).cast("long")))
    roots = roots.select(F.col("name").alias("tree"), F.col("top").alias("root"), F.col("path").alias("beyond"))
    return trees.join(roots, "tree").select(
        "doc_id", "source", F.col("digest").alias("leaf"), "found", F.col("top").alias("subroot"), "root", F.concat("path", "beyond").alias("path")
    )


def audit(docs: DataFrame, found: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of docs, and whether the digests found now still give its root."""
    out = manifest(docs, found).withColumn("folded_root", folded(F.col("found"), F.col("path")))
    verified = F.col("folded_root") == F.col("root")
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", verified.alias("verified"))
