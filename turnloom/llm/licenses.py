"""License scans: exact set-similarity join of text blocks with license templates. DataFrame functions only."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm._spark import ALNUM_GAP, ascii_lower, words_between

# Fixed values of the contract: phrases that stand for a license, and their labels.
BASE_PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: The templates of the query: what notices say, in lower case, and the label of each. Others may be given as a list or a table.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution noncommercial license cc by nc", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    ("this work is dedicated to the public domain cc0", "cc0"),
    ("all rights reserved no part may be reproduced without permission", "proprietary"),
]
#: Least share of a template's words that a block must hold.
CONTAINMENT = 0.8
#: A run of more than so many times the longest template's words says something else; in a longer block every run of that length is judged.
BLOCK_STRETCH = 3
#: Characters that all templates may have together: they go to every task.
MOST_TEMPLATE_CHARS = 4 << 20
#: Blocks are sentences and paragraphs; a single line break is a space.
BLOCK_END = r"[!?;]|\.(?![0-9])|\n[\x20\t\r]*\n"


def words_of(text: Column) -> Column:
    return words_between(text, ALNUM_GAP)


def listed_templates(templates: Sequence[tuple[str, str]] | DataFrame) -> list[tuple[str, str]]:
    """(text, label) of a list or a table (text, label), in order; an error where they are too large to be sent to all tasks."""
    if isinstance(templates, DataFrame):
        size = templates.agg(F.coalesce(F.sum(F.length("text") + F.length("label")), F.lit(0))).first()[0]
        if size > MOST_TEMPLATE_CHARS:
            raise ValueError(f"{size} characters of templates are more than {MOST_TEMPLATE_CHARS}")
        templates = [(r["text"], r["label"]) for r in templates.select("text", "label").where("text IS NOT NULL AND label IS NOT NULL").orderBy("label", "text").collect()]
    return [(t, label) for t, label in templates if t.split()]


def token_frequencies(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many documents (rows with `words`) each word of the vocabulary stands. At most as many rows as the vocabulary has words."""
    held = words.select(F.explode(F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))).alias("w")).groupBy("w").count()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in held.collect()}


def ordered_templates(templates: Sequence[tuple[str, str]], frequencies: dict[str, int]) -> list[dict]:
    """Templates as word sets in global order (rarest first), with what the filters need.

    A block that holds at least `least` of a template's n words holds one of its first n - least + 1: that is the prefix.
    Where another label's template alone would meet one, `apart` has the words that tell them apart; one of them must be there.
    """
    out = []
    sets = [(set(t.split()), label) for t, label in templates]
    for own, label in sets:
        words = sorted(own, key=lambda w: (frequencies[w], w))
        least = math.ceil(CONTAINMENT * len(words) - 1e-9)
        rivals = [u for u, other in sets if other != label and len(u & own) >= least]
        out.append({"label": label, "words": words, "n": len(words), "least": least, "prefix": words[: len(words) - least + 1], "apart": [sorted(own - u) for u in rivals]})
    return out


_TEMPLATE = "struct<label:string,words:array<string>,n:int,least:int,prefix:array<string>,apart:array<array<string>>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def phrase_starts(words: Column, phrase: str, label: str) -> Column:
    """array<struct<word,label>> of the places where the phrase's words stand one after another; null if its first word is missing."""
    p = phrase.split()
    listed = F.array(*[F.lit(w) for w in p])
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(words) - len(p) + 1, F.lit(1))),
        lambda i: (F.get(words, i - 1) == p[0]) & (F.slice(words, i, len(p)) == listed),
    )
    return F.when(F.array_contains(words, p[0]), F.transform(starts, lambda i: F.struct((i - 1).alias("word"), F.lit(label).alias("label"))))


def _score(part: Column, t: Column) -> Column:
    """Share of template t's words in part, if that meets it; else null."""
    shared = F.size(F.array_intersect(t["words"], part))
    told = F.forall(t["apart"], lambda words: F.arrays_overlap(part, words))
    return F.when((shared >= t["least"]) & told, shared / t["n"].cast("double"))


def _met(run: Column, block: Column, templates: Column, index: Column, prefixes: Column, longest: int) -> Column:
    """array<struct<score,label>> of all templates that some `longest` words of run (its distinct words: block) meet.

    The index leads from the words of the block that stand in a prefix to the templates that it may meet. Length: the block has a template's `least` words
    at least. Position: if the first shared word stands at p in global order, n - p words can still be shared.
    """
    asked = F.array_distinct(F.flatten(F.transform(F.array_intersect(block, prefixes), lambda w: F.element_at(index, w))))
    first = lambda t: F.array_min(F.transform(F.array_intersect(t["prefix"], block), lambda w: F.array_position(t["prefix"], w)))
    may = lambda t: (F.size(block) >= t["least"]) & (t["n"] - first(t) + 1 >= t["least"]) & (F.size(F.array_intersect(t["words"], block)) >= t["least"])
    starts = F.sequence(F.lit(1), F.greatest(F.size(run) - longest + 1, F.lit(1)))
    best = lambda t: F.array_max(F.transform(starts, lambda i: _score(F.slice(run, i, longest), t)))
    found = F.transform(F.filter(F.transform(asked, lambda k: F.get(templates, k)), may), lambda t: F.struct(best(t).alias("score"), t["label"].alias("label")))
    return F.filter(found, lambda x: x["score"].isNotNull())


def find_licenses(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES) -> DataFrame:
    """docs with n_words, places (array<struct<word,label>> of base phrases, by word), matches (array<struct<score,label>> of
    template matches) of every whole text. templates: (text, label), in lower case.

    A set-similarity join of the blocks of text with the templates: words have one global order, by the documents that hold them; the templates'
    prefixes are indexed by word, the index goes to every task (its size is checked), and a block looks up its words. The side of the documents is not
    shuffled, so a common word costs no more than its occurrences.

    Blocks are sentences (and paragraphs); of a block of more words than BLOCK_STRETCH times the longest template every run of
    that many words is judged: windows of twice the length overlap by half, so each run stands whole in one, and those that
    hold enough of a template are gone through word by word. Nulls and empty texts have no words; repeated
    rows pass through; an empty table gives no rows. Columns of docs with one of the three names are replaced. Without templates, only base phrases count.
    """
    given = listed_templates(templates)
    low = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    vocabulary = sorted({w for t, _ in given for w in t.split()})
    ordered = ordered_templates(given, token_frequencies(docs.select(words_of(low).alias("words")), vocabulary) if vocabulary else {})
    index: dict[str, list[int]] = {}
    for k, t in enumerate(ordered):
        for w in t["prefix"]:
            index.setdefault(w, []).append(k)
    prefixes = F.from_json(F.lit(json.dumps(sorted(index))), "array<string>")
    lookup = F.from_json(F.lit(json.dumps(index)), "map<string,array<int>>")
    known = F.from_json(F.lit(json.dumps(ordered)), f"array<{_TEMPLATE}>")
    longest = BLOCK_STRETCH * max((len(t["words"]) for t in ordered), default=1)

    lowered = docs.withColumn("__low", low).withColumn("__words", words_of(F.col("__low")))
    words = F.col("__words")
    hits = [phrase_starts(words, phrase, label) for phrase, label in BASE_PHRASES]
    none = "CAST(array() AS array<struct<word:int,label:string>>)"
    places = F.array_sort(F.flatten(F.array(*[F.coalesce(h, F.expr(none)) for h in hits])))

    def windows(b: Column) -> Column:
        cut = lambda i: _let(F.slice(b, i, 2 * longest), lambda run: F.struct(run.alias("run"), F.array_distinct(run).alias("words")))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(b) - longest + 1, F.lit(1)), F.lit(longest)), cut)

    blocks = F.filter(F.transform(F.split("__low", BLOCK_END), words_of), lambda b: F.arrays_overlap(b, prefixes))
    met = F.flatten(F.transform(F.flatten(F.transform(blocks, windows)), lambda b: _met(b["run"], b["words"], known, lookup, prefixes, longest)))
    empty = "CAST(array() AS array<struct<score:double,label:string>>)"
    return (
        lowered.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("places", places)
        .withColumn("matches", F.when(F.arrays_overlap(words, prefixes), met).otherwise(F.expr(empty)))
        .select(*[c for c in docs.columns if c not in ("n_words", "places", "matches")], "n_words", "places", "matches")
    )
