"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: kinds in their order, pattern, group that is measured, least length of that group.
BASE_KINDS = [
    (
        "assign",
        r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Strings that may be secrets by their entropy.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least length of a candidate, and of what is left of one.
LEAST = 20
#: Length of the windows whose entropy is measured.
WINDOW = 20
#: Character classes: name, what a candidate of the class looks like, least entropy in bits; the first that fits counts, and one always
#: does. Random strings of 32 characters reach it in about 95 % of the cases or more, `joined` ones in half of them (identifiers and paths
#: come near; their runs between marks are judged apart). Of 20 random lower-case letters 98 % reach 3.27 bits and 50 % reach 3.68.
CLASSES = [
    ("hex", r"^[0-9A-Fa-f]+$", 3.0),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.9),
    ("one case", r"^(?:[a-z]+|[A-Z]+)$", 3.55),
    ("base36", r"^[a-z0-9]+$", 3.5),
    ("base32", r"^[A-Z0-9]+$", 3.5),
    ("letters", r"^[A-Za-z]+$", 3.9),
    ("joined", r"^.+$", 4.1),
]
#: Stretches that are no secrets: placeholders, runs of the alphabet, UUIDs. What stands around them in a candidate is judged.
ALLOW = "|".join([
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]",
    r"0123456789|123456789|abcdefgh|qwerty",
    r"(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])",
])
#: Marks that part the runs of a candidate.
MARKS = r"[+/_=-]+"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


_SPANS = "array<struct<start:int,end:int,got:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def running_sums(x: Column) -> Column:
    """For an array of ints, the sum of those before each. In blocks of about the root of its size, with the sums of the blocks before: an array of n
    takes n ** 1.5 additions and no array is copied in each step."""
    def within(parts: Column, sums: Column) -> Column:
        def block(part: Column, b: Column) -> Column:
            return _let(_sum(F.slice(sums, F.lit(1), b)), lambda before: F.transform(part, lambda v, i: before + _sum(F.slice(part, F.lit(1), i))))
        return F.flatten(F.transform(parts, block))

    width = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), w)
    blocks = _let(width, lambda w: F.transform(starts(w), lambda k: F.slice(x, k, w)))
    return _let(blocks, lambda parts: _let(F.transform(parts, _sum), lambda sums: within(parts, sums)))


def _placed(pieces: Column, whole: Column, got: Column, start: Column) -> Column:
    """Spans of the matches `whole`, before each of which a piece stands; text begins at `start`."""
    lengths = lambda xs: F.transform(xs, F.length)
    steps = F.zip_with(lengths(F.slice(pieces, F.lit(1), F.size(whole))), lengths(whole), lambda a, b: a + b)
    ends = F.zip_with(running_sums(steps), steps, lambda before, n: before + n)
    return F.zip_with(
        F.arrays_zip(ends.alias("to"), whole.alias("whole")), got,
        lambda e, g: F.struct((start + e["to"] - F.length(e["whole"])).alias("start"), (start + e["to"]).alias("end"), g.alias("got")),
    )


def located(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start,end,got>> of the leftmost non-overlapping matches, in code points: the pieces that split()
    leaves around the matches, and the matches, add up to the places."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    spans = _let(F.struct(F.split(text, pattern, -1).alias("pieces"), whole.alias("whole"), got.alias("got")), lambda m: _placed(m["pieces"], m["whole"], m["got"], F.lit(0)))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.expr(f"CAST(array() AS {_SPANS})"))


def window_entropy(s: Column, window: int) -> Column:
    """Highest Shannon entropy, in bits, of any window of s (of all of s if shorter), by incremental counts.

    With S the sum of c * log2(c) over the counts of a window's n characters, the entropy is log2(n) - S / n. As the window
    moves, one count goes up and one down, and S with them, so a step costs the alphabet and not the window.
    """
    n = F.least(F.length(s), F.lit(window))

    def gain(c: Column) -> Column:  # S after one more, less S before
        c = c.cast("double")
        return (c + 1) * F.log2(c + 1) - F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1.0)))).otherwise(0.0)

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], F.coalesce(x["old"], F.lit(0))
        more = acc["s"] + gain(F.element_at(acc["counts"], new))
        c_old = F.element_at(acc["counts"], F.greatest(old, F.lit(1))) + F.when(old == new, 1).otherwise(0)
        less = F.when(old > 0, more - gain(c_old - 1)).otherwise(more)
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k + 1 == new, 1).otherwise(0) - F.when(k + 1 == old, 1).otherwise(0))
        # Before the first whole window the last sum counts, which is that of a shorter string.
        low = F.when(x["i"] > window, F.least(acc["low"], less)).otherwise(less)
        return F.struct(counts.alias("counts"), less.alias("s"), low.alias("low"))

    # What comes and what goes, side by side and made once: a step looks nothing up in the string.
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    gone = F.concat(F.array_repeat(F.lit(0), window), codes)
    steps = F.arrays_zip(codes.alias("new"), gone.alias("old"), F.sequence(F.lit(1), F.length(s)).alias("i"))
    steps = F.filter(steps, lambda x: x["new"] > 0)
    start = F.struct(F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(1e9).alias("low"))
    return F.aggregate(steps, start, step, lambda acc: F.log2(n.cast("double")) - acc["low"] / n)


def _between(s: Column, pattern: str) -> Column:
    """array<struct<start,end,got>> of what is left of a span (start, end, got) between the matches of pattern, if long enough."""
    got = s["got"]
    def left(m: Column) -> Column:
        # A piece ends where the gap after it begins; the last has none.
        gaps = F.concat(F.transform(m["gaps"], F.length), F.array(F.lit(0)))
        steps = F.zip_with(F.transform(m["pieces"], F.length), gaps, lambda a, b: a + b)
        return F.zip_with(
            m["pieces"], running_sums(steps), lambda x, at: F.struct((s["start"] + at).alias("start"), (s["start"] + at + F.length(x)).alias("end"), x.alias("got"))
        )
    pieces = _let(F.struct(F.split(got, pattern, -1).alias("pieces"), F.regexp_extract_all(got, F.lit(pattern), F.lit(0)).alias("gaps")), left)
    return F.filter(F.when(F.regexp_like(got, F.lit(pattern)), pieces).otherwise(F.array(s)), lambda x: F.length(x["got"]) >= LEAST)


def entropy_spans(text: Column) -> Column:
    """array<struct<start,end,got>> of candidate strings, less their allow-listed stretches, whose entropy reaches their class's; where
    it does not, of the runs between their marks that reach theirs."""
    def secret(c: Column) -> Column:
        s, least = c["got"], F.lit(None).cast("double")
        for _, looks, bits in reversed(CLASSES):
            least = F.when(F.regexp_like(s, F.lit(looks)), F.lit(bits)).otherwise(least)
        return window_entropy(s, WINDOW) >= least
    parts = F.flatten(F.transform(located(text, CANDIDATE, 0), lambda c: _between(c, ALLOW)))
    runs = lambda c: F.when(F.regexp_like(c["got"], F.lit(MARKS)), F.filter(_between(c, MARKS), secret)).otherwise(F.filter(F.array(c), lambda x: F.lit(False)))
    return F.flatten(F.transform(parts, lambda c: F.when(secret(c), F.array(c)).otherwise(runs(c))))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `secrets`: array<struct<start,end,rank,kind>> by start, then kind as listed (assign, access, hex, entropy);
    code points, end exclusive.

    Null and empty texts have no spans; repeated rows and other columns pass through; an empty table gives no rows. A column
    of docs named `secrets` is replaced. Long texts are read whole.
    """
    t = F.coalesce(F.col("__text"), F.lit(""))
    out = docs.withColumn("__text", F.col(text))
    kinds = []
    for rank, (kind, pattern, group, least) in enumerate(BASE_KINDS):
        out = out.withColumn(f"__{kind}", located(t, pattern, group))
        kinds.append((kind, rank, _long_enough(F.col(f"__{kind}"), least)))
    out = out.withColumn("__entropy", entropy_spans(t))
    kinds.append(("entropy", len(BASE_KINDS), F.col("__entropy")))
    spans = F.concat(*[_named(found, kind, rank) for kind, rank, found in kinds])
    spans = F.array_sort(spans, lambda a, b: _order(a, b))
    return out.select(*[c for c in docs.columns if c != "secrets"], spans.alias("secrets"))


def _long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda m: F.length(m["got"]) >= least)


def _named(found: Column, kind: str, rank: int) -> Column:
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
    )


def _order(a: Column, b: Column) -> Column:
    x, y = (F.struct(s["start"].alias("a"), s["rank"].alias("b"), s["end"].alias("c")) for s in (a, b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced; overlapping spans count as one."""
    found = find_secrets(docs, text)
    t = F.coalesce(F.col(text), F.lit(""))
    kept = F.aggregate(
        F.col("secrets"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t) - acc["at"])),
    )
    return found.withColumn(text, F.when(F.size("secrets") > 0, kept).otherwise(F.col(text))).drop("secrets")
