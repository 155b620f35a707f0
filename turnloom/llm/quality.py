"""Quality rules: Jensen-Shannon distance of a document's character classes and common words from its language's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnloom.llm._arrow import LOWER_BYTES, SPACE_BYTES, chunks, hashes, lists, spans, window_hashes
from turnloom.llm._spark import settle

#: Common words of a language that have a bin each; all others share one.
COMMON_WORDS = 50
#: Character classes, by the first byte of a character in UTF-8: a-z, A-Z, 0-9, space, line ends, . and comma, other marks of prose, symbols, brackets
#: and slashes, control characters and the rest of ASCII; then Latin with marks (U+0080 to U+02FF), Greek to Cyrillic and Armenian (to U+057F),
#: Hebrew, Arabic and others of two bytes (to U+07FF), scripts and marks of three bytes up to U+2FFF, kana and Han (to U+9FFF), Hangul and
#: what else has three bytes, and four bytes. The other bytes of a character count nowhere.
CLASSES = 17
#: Largest Jensen-Shannon distance (0 to 1, the root of the divergence in bits), and the least length at which it is looked at.
MAX_CLASS_DISTANCE, MIN_WORD_CHARS = 0.32, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.47, 150

_CLASS = np.full(256, 9, np.int64)
for _n, _bytes in enumerate([range(97, 123), range(65, 91), range(48, 58), [32], [10, 13], b".,", b"!?:;'\"-", b"#*$%&|<>", b"()[]{}/\\_=+~^@`"]):
    _CLASS[list(_bytes)] = _n
_CLASS[0x80:0xC0] = CLASSES
for _n, _first, _last in [(10, 0xC0, 0xCB), (11, 0xCC, 0xD5), (12, 0xD6, 0xDF), (13, 0xE0, 0xE2), (14, 0xE3, 0xE9), (15, 0xEA, 0xEF), (16, 0xF0, 0xFF)]:
    _CLASS[_first : _last + 1] = _n
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_COUNTED = "lang string, word long, n long"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
VERDICT = "class_distance double, word_distance double, base_failed boolean, kept boolean"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: counts of lower-cased words (by hash) and, as word -1 - k, of character class k, per language."""
    for rows, data, offsets in chunks(batches):
        names = rows.column("lang").dictionary_encode()
        code = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
        known = [*names.dictionary.to_pylist(), None]
        start, end, row = spans(SPACE_BYTES[data], offsets)
        word = hashes(LOWER_BYTES[data], start, end).view(np.int64)
        word = np.where(word < 0, word & np.int64((1 << 63) - 1), word)
        kind = _CLASS[data]
        of = np.repeat(code, np.diff(offsets))
        for c in range(len(known)):
            w, n = np.unique(word[code[row] == c], return_counts=True)
            k = np.bincount(kind[of == c], minlength=CLASSES + 1)[:CLASSES]
            if k.sum() == 0:
                continue
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([known[c]] * (len(w) + CLASSES), pa.string()),
                "word": pa.array(np.r_[w, -1 - np.arange(CLASSES)]),
                "n": pa.array(np.r_[n, k]),
            })


def language_references(docs: DataFrame) -> DataFrame:
    """A row per language: its most common words (hashes, ascending), their shares and that of all others (last), and the shares of the
    character classes. Counted over all documents; ties among words go to the smaller hash."""
    counted = settle(
        docs.select(F.col("lang"), "text").mapInArrow(_count, _COUNTED).groupBy("lang", "word").agg(F.sum("n").alias("n")), "quality-counts"
    )
    words = counted.where("word >= 0")
    totals = words.groupBy("lang").agg(F.sum("n").alias("all"))
    # The top words of each of many slices first, then of those: no task ranks a whole vocabulary.
    part = F.pmod(F.col("word"), F.lit(256))
    top = words.withColumn("part", part).withColumn("r", F.row_number().over(W.partitionBy("lang", "part").orderBy(F.desc("n"), "word")))
    top = top.where(F.col("r") <= COMMON_WORDS).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word")))
    top = top.where(F.col("r") <= COMMON_WORDS).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("top"))
    classes = counted.where("word < 0").groupBy("lang").agg(*[F.coalesce(F.sum(F.when(F.col("word") == -1 - k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(CLASSES)])
    joined = classes.join(totals.withColumnRenamed("lang", "l1"), F.col("lang").eqNullSafe(F.col("l1")), "left").join(
        top.withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")), "left"
    )
    share = F.transform("top", lambda x: x["n"] / F.col("all").cast("double"))
    rest = 1.0 - F.aggregate(share, F.lit(0.0), lambda a, x: a + x)
    chars = sum((F.col(f"c{k}") for k in range(1, CLASSES)), F.col("c0")).cast("double")
    return joined.select(
        F.col("lang").alias("__lang"),
        F.transform("top", lambda x: x["word"]).alias("__ref_words"),
        F.concat(share, F.array(F.greatest(rest, F.lit(0.0)))).alias("__ref_shares"),
        F.array(*[F.col(f"c{k}") / chars for k in range(CLASSES)]).alias("__ref_classes"),
    )


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each line of p from the same of q, the root of the divergence in bits: 0 for equal ones, 1 for disjoint ones."""
    m = (p + q) / 2

    def part(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0.0).sum(axis=1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0.0, 1.0))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The counts of BASE, and the words' hashes (as they are written; lower-cased ones serve the histogram) and rows."""
    n = len(offsets) - 1
    start, end, row = spans(SPACE_BYTES[data], offsets)
    lead = (data & 0xC0) != 0x80  # first bytes of characters
    in_word = SPACE_BYTES[data] & lead
    total = np.r_[0, np.cumsum(in_word)]
    symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
    words = hashes(data, start, end)
    key, at = window_hashes(words, row, 5)
    order = np.lexsort((key, row[at]))
    same = (key[order][1:] == key[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.bincount(at[twice], minlength=len(words) + 1) - np.bincount(at[twice] + 5, minlength=len(words) + 1)
    repeated = np.cumsum(change[:-1]) > 0
    # Lines with a word: from the first to the last byte, without the line end.
    a, b, r = spans(data != 10, offsets)
    held = np.r_[0, np.cumsum(SPACE_BYTES[data])]
    worded = held[b] > held[a]
    line, r = hashes(data, a[worded], b[worded]), r[worded]
    order = np.lexsort((line, r))
    again = (line[order][1:] == line[order][:-1]) & (r[order][1:] == r[order][:-1])
    counts = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": total[offsets[1:]] - total[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(r[order][1:][again], minlength=n),
        "n_repeat_words": np.bincount(row[repeated], minlength=n),
    }
    return counts, start, row


def _judge(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            n = rows.num_rows
            counts, start, row = base_counts(data, offsets)
            _, end, _ = spans(SPACE_BYTES[data], offsets)
            word = hashes(LOWER_BYTES[data], start, end).view(np.int64)
            word = np.where(word < 0, word & np.int64((1 << 63) - 1), word)
            ref = rows.column("__ref").fill_null(-1).to_numpy(zero_copy_only=False)
            class_div, word_div = np.full(n, np.nan), np.full(n, np.nan)
            kind = _CLASS[data] + np.repeat(np.arange(n), np.diff(offsets)) * (CLASSES + 1)
            seen = np.bincount(kind, minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]
            for first in np.unique(ref[ref >= 0]):
                mine = np.flatnonzero(ref == first)
                at = int(mine[0])
                classes = np.array(rows.column("__ref_classes")[at].as_py())
                p = seen[mine] / np.maximum(seen[mine].sum(axis=1, keepdims=True), 1)
                class_div[mine] = jensen_shannon(p, classes[None, :])
                top = rows.column("__ref_words")[at].as_py()
                if not top:
                    continue
                shares = np.array(rows.column("__ref_shares")[at].as_py())
                top = np.array(top, np.int64)
                ours = (ref == first)[row]
                w = word[ours]
                k = np.minimum(np.searchsorted(top, w), len(top) - 1)
                k = np.where(top[k] == w, k, len(top))
                h = np.bincount(row[ours] * (len(top) + 1) + k, minlength=n * (len(top) + 1)).reshape(n, len(top) + 1)[mine]
                word_div[mine] = jensen_shannon(h / np.maximum(h.sum(axis=1, keepdims=True), 1), shares[None, :])
            failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
            far = (counts["word_chars"] >= MIN_WORD_CHARS) & (class_div > MAX_CLASS_DISTANCE)
            far |= (counts["n_words"] >= MIN_WORDS) & (word_div > MAX_WORD_DISTANCE)
            made = {k: pa.array(v.astype(np.int64)) for k, v in counts.items()} | {
                "class_distance": pa.array(class_div, from_pandas=True),
                "word_distance": pa.array(word_div, from_pandas=True),
                "base_failed": pa.array(failed),
                "kept": pa.array(~failed & ~far),
            }
            yield pa.RecordBatch.from_arrays([made.get(f.name, rows.column(f.name) if f.name in rows.schema.names else None) for f in out], schema=out)

    return run


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all by default) with the counts of BASE and of VERDICT.

    A document fails the base rules with fewer than 10 words or over 20 % of words in repeated windows of five. It is rejected
    too if it is long enough (MIN_WORD_CHARS, MIN_WORDS) and its histogram of character classes or of its language's common
    words is farther from the language's than the limits. References come from all documents; a language's is a row of
    bounded size, joined to the documents (broadcast by the planner as long as the measured table is small).
    Nulls: a null text has no words; a null lang is a language of its own. Repeated rows pass through; an empty table gives no
    rows. Columns of docs named as the new ones are replaced. Long texts are counted whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = [f.name for f in StructType.fromDDL(f"{BASE}, {VERDICT}")]
    kept = [c for c in (keep or docs.columns) if c not in new]
    references = settle(language_references(docs), "quality-references")
    references = references.withColumn("__ref", F.xxhash64("__lang").bitwiseAND(F.lit((1 << 62) - 1)))
    joined = docs.select(*dict.fromkeys([*kept, "text", "lang"])).join(references, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")
    to = StructType([*[docs.schema[c] for c in kept], *StructType.fromDDL(f"{BASE}, {VERDICT}")])
    return joined.mapInArrow(_judge(to_arrow_schema(to)), to)


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without those that judge() rejects. Columns of docs named as judge()'s pass through it under other names."""
    named = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "lang")}
    judged = judge(docs.select(*[F.col(c).alias(named.get(c, c)) for c in docs.columns])).where("kept")
    return judged.select(*[F.col(named.get(c, c)).alias(c) for c in docs.columns])
