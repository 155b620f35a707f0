"""Scalar functions on text, words, hashes and scores, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Short utterances by what they do; fillers before continuers before reactions before acknowledgements.
FILLERS = ["um", "uh", "er", "erm", "so", "like", "well", "hmm"]
CONTINUERS = ["mhm", "mm", "m", "mmm", "mmhm", "uh-huh", "uhhuh", "hm", "hmm", "mm-hmm"]
REACTIONS = ["wow", "oh", "really", "no", "whoa", "god", "nice", "ha", "haha", "oof", "yikes", "damn", "seriously", "what", "huh", "ah", "aw"]
ACKS = [
    "yeah", "yes", "yep", "right", "okay", "ok", "sure", "true", "exactly", "totally", "uh", "i", "see", "gotcha", "got", "it", "cool", "alright", "fair", "definitely", "absolutely",
    "makes", "sense",
]
# Words after which a speaker goes on.
FUNCTION_WORDS = [
    "and", "but", "so", "or", "because", "um", "uh", "like", "the", "a", "to", "of", "that", "if", "with", "i", "you", "we", "is", "was", "which", "then",
]
#: Marks that may stand around a word of an utterance.
AROUND = ".,?!;:\"'"


def nfkc(t: Column) -> Column:
    """t in the compatible composed form, by Arrow batches; Spark has no function for it."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return folded(t)


def norm_text(t: Column, fold: bool = False) -> Column:
    """Lower case, without [tags] and marks other than ' and -, spaces squeezed. fold: compatible forms (wide letters, ligatures) first; the only
    part that leaves the JVM, so off unless asked for."""
    t = nfkc(t) if fold else t
    out = F.regexp_replace(F.lower(t), r"\[[^\]]*\]", " ")
    out = F.regexp_replace(out, r"[!-&(-,./:-@\[-`{-~]", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"[^ \t\n\r\f]+"), F.lit(0))


def error_units(t: Column, lang: Column) -> Column:
    """Words, or characters where words are not spaced."""
    return F.when(lang.isin("ja", "zh"), F.filter(F.split(t, ""), lambda c: ~F.regexp_like(c, F.lit(r"^\s*$")))).otherwise(words(t))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words: a fold over a of the row of distances to b's prefixes."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(prev: Column, x: Column) -> Column:
        start = F.array(F.element_at(prev, 1) + 1)
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            start,
            lambda acc, j: F.concat(
                acc,
                F.array(F.least(F.element_at(acc, -1) + 1, F.element_at(prev, j + 1) + 1, F.element_at(prev, j) + F.when(F.element_at(b, j) == x, 0).otherwise(1))),
            ),
        )

    return F.when(F.size(b) == 0, F.size(a)).otherwise(F.element_at(F.aggregate(a, first, row), -1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def last_words(t: Column, n: int) -> Column:
    w = words(t)
    return F.when(F.size(w) <= n, w).otherwise(F.slice(w, -n, n))


def ends_with_function_word(t: Column) -> Column:
    return F.coalesce(F.try_element_at(words(norm_text(t)), F.lit(-1)).isin(*FUNCTION_WORDS), F.lit(False))


def spoken(t: Column) -> Column:
    """Words of an utterance in lower case, without the marks around them."""
    bare = F.transform(words(t), lambda w: F.lower(F.regexp_replace(w, r"^[.,?!;:\"']+|[.,?!;:\"']+$", "")))
    return F.filter(bare, lambda w: w != "")


def lexical_class(t: Column) -> Column:
    """empty; filler: all words are; then, of at most three words that are all listed: continuer, reaction, ack; else other."""
    w = spoken(t)
    def all_in(*lists: list[str]) -> Column:
        listed = [x for y in lists for x in y]
        return F.forall(w, lambda x: x.isin(*listed))
    def any_in(listed: list[str]) -> Column:
        return F.exists(w, lambda x: x.isin(*listed))
    return (
        F.when(F.size(w) == 0, "empty").when(all_in(FILLERS), "filler").when((F.size(w) > 3) | ~all_in(CONTINUERS, REACTIONS, ACKS), "other")
        .when(any_in(CONTINUERS), "continuer").when(any_in(REACTIONS), "reaction").otherwise("ack")
    )


def hash_unit(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 15 hexadecimal digits of sha256 of salt and key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256), 1, 15)
    return F.conv(digits, 16, 10).cast("double") / float(16**15)


def hash_order(key: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256)


def quote_position(w: Column, quote: Column) -> Column:
    """Words up to the end of the first place where quote stands in w, and the tokens of marks after it; null if it does not."""
    n = F.size(quote)
    at = F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.slice(w, i, n) == quote), F.lit(1))
    end = at + n - 1
    tail = F.slice(w, F.coalesce(end, F.lit(0)) + 1, F.greatest(F.size(w) - end, F.lit(0)))
    marks = F.aggregate(tail, F.struct(F.lit(True).alias("on"), F.lit(0).alias("k")), lambda acc, x: F.struct((acc["on"] & F.regexp_like(x, F.lit(r"^[!-/:-@]+$"))).alias("on"), (acc["k"] + F.when(acc["on"] & F.regexp_like(x, F.lit(r"^[!-/:-@]+$")), 1).otherwise(0)).alias("k")), lambda acc: acc["k"])
    return F.when(at.isNotNull(), end + marks)


#: A numbered line: the number, marks, a colon or full stop with marks around, the answer. Unix lines; marks in the sense of Unicode.
_NUMBERED = r"(?mdU)^\W*([0-9]+)\W*[:.]\s*(.+)$"


def parse_numbered(reply: Column, n: Column, first: int = 0) -> Column:
    """array<struct<no,answer,score>> of the answers to n questions numbered from `first`, by number: lines of a number, a colon or full stop with marks around,
    and the answer. Of several answers to one number the last counts; other numbers don't. score: the number that the answer begins with, at most 10, or
    null. Null unless all numbers asked for are there."""
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    numbers = F.transform(F.regexp_extract_all(reply, F.lit(_NUMBERED), F.lit(1)), bare)
    answers = F.regexp_extract_all(reply, F.lit(_NUMBERED), F.lit(2))
    read = F.zip_with(numbers, answers, lambda k, a: F.struct(k.alias("k"), F.trim(F.regexp_replace(a, r"^\s+|\s+$", "")).alias("answer")))

    def row(k: Column) -> Column:
        answer = F.try_element_at(F.filter(read, lambda r: r["k"] == k.cast("string")), F.lit(-1))["answer"]
        digits = bare(F.regexp_extract(answer, "^[0-9]+", 0))
        score = F.when(F.length(digits) > 2, 10).otherwise(F.least(digits.try_cast("int"), F.when(digits != "", 10)))
        return F.struct(k.cast("int").alias("no"), answer.alias("answer"), score.alias("score"))

    asked = F.when(n > 0, F.sequence(F.lit(first), n + first - 1)).otherwise(F.array().cast("array<int>"))
    rows = F.transform(asked, row)
    return F.when(F.forall(rows, lambda r: r["answer"].isNotNull()), rows)


def parse_verdict(reply: Column) -> Column:
    """1 or 0 for the last "ANSWER: yes" or "ANSWER: no", else null."""
    last = F.try_element_at(F.regexp_extract_all(F.lower(reply), F.lit(r"answer:\s*(yes|no)"), F.lit(1)), F.lit(-1))
    return F.when(last == "yes", 1).when(last == "no", 0)


def time_grid(start: Column, end: Column, step: int) -> Column:
    """Points from start in steps, and the end itself when they miss it."""
    return F.array_union(F.sequence(start, end, F.lit(step).cast("long")), F.array(end))


def fuse_geometric(a: Column, t: Column, w: float) -> Column:
    """a ** (1 - w) * t ** w, where a missing t is 0.5."""
    return F.pow(a, F.lit(1 - w)) * F.pow(F.coalesce(t, F.lit(0.5)), F.lit(w))


def fuse_logit(a: Column, t: Column, w: float) -> Column:
    def logit(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))
    z = (1 - w) * logit(a) + w * logit(F.coalesce(t, F.lit(0.5)))
    return 1 / (1 + F.exp(-z))


def yes_probability(top: Column) -> Column:
    """Share of yes among the yes and no tokens of array<struct<token,logprob>>; null if there is neither."""
    def mass(word: str) -> Column:
        return F.aggregate(F.filter(top, lambda x: F.lower(F.trim(x["token"])) == word), F.lit(0.0), lambda acc, x: acc + F.exp(x["logprob"]))
    return F.try_divide(mass("yes"), mass("yes") + mass("no"))


def vap_near_probability(probs: Column, bit: int) -> Column:
    """Marginal of a bit over the probabilities of packed codes."""
    on = F.transform(probs, lambda p, i: F.when(F.getbit(i, F.lit(bit)) == 1, p.cast("double")).otherwise(0.0))
    return F.aggregate(on, F.lit(0.0), lambda acc, x: acc + x)


def clip01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def score_variants(now: list[Column], f04: list[Column], f08: list[Column], f16: list[Column], silent: Column, own: dict[str, Column], other: dict[str, Column], order: W) -> dict[str, Column]:
    """Ways to score an end of turn (eot…) or an interruption (int…) of a channel, all in [0, 1].

    now, f04, f08, f16: probabilities of the floor now and 0.4, 0.8 and 1.6 s ahead: held by the channel, held by the other, open, contested. silent: that
    the channel is. own and other: those of the label groups (backchannel, noncontent, floor_taking, turn) of both channels. order: the channel's
    frames in time; transition scores ask who held the floor in the frames before.
    """
    def released(p: list[Column]) -> Column:
        return p[2] + p[1]
    def before(x: Column, n: int) -> Column:
        return F.coalesce(F.max(x).over(order.rowsBetween(-n, -1)), F.lit(0.0))
    eot, ahead = released(now), released(f04)
    mix = (eot + ahead) / 2
    not_listening = clip01(1 - own["backchannel"] - own["noncontent"])
    out = {"eot": eot, "eot_f04": ahead, "eot_mix": mix, "int": f08[0], "int_f04": f04[0], "int_f16": f16[0], "int_mix": (f04[0] + f08[0] + f16[0]) / 3}
    for n in (5, 10, 20):
        out |= {f"eot_tr{n}": eot * before(now[0], n), f"eot_f04_tr{n}": ahead * before(now[0], n)}
    out |= {
        "int_tr10": f08[0] * before(now[1], 10), "eot_q": eot * silent, "eot_f04_q": ahead * silent, "eot_mix_q": mix * silent, "eot_q_sqrt": eot * F.sqrt(silent), "int_spk": f04[0] * (1 - silent),
        "int_nobc": f04[0] * (1 - silent) * not_listening, "int_ft": own["floor_taking"], "int_claim": f04[0] * (own["floor_taking"] + own["turn"]),
        "eot_nobc": eot * silent * clip01(1 - other["backchannel"] - other["noncontent"]),
    }
    return {k: clip01(v) for k, v in out.items()}
