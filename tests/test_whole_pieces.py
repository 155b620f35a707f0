"""Whole jobs against brute force, where an operator or query once did part of one."""

from __future__ import annotations

import re

import __spark_entry__


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_pairs_of_whole_pieces(spark, tmp_path):
    long = [f"w{k}" for k in range(30)]
    texts = [". ".join([" ".join(long), " ".join([*long[:20], "other", *long[22:]]), "né à la mer", "ne a la mère ok"]), "a b c. a b", "alone"]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for turn, text in enumerate(texts):
        w = [x.split() for x in re.split(r"\.", text)]
        for k, (a, b) in enumerate(zip(w, w[1:])):
            full = [*a, ".", "!", *b]
            end = next(i for i in range(len(full)) if full[i : i + 2] == a[-2:]) + 2
            end += 2 if end == len(a) else 0
            want[turn, k] = (levenshtein(a, b), levenshtein(" ".join(a), " ".join(b)), len({*a} & {*b}) / len({*a, *b}), end)
    for at, (name, column) in enumerate([("F04_edit_distance", "words"), ("F04_char_distance", "chars"), ("F05_jaccard", "j"), ("F10_quote", "at")]):
        got = {(r.turn, r.k): r[column] for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {k: v[at] for k, v in want.items()}, name
