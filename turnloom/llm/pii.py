"""Personal data: high-recall candidate spans, gradient-boosted trees over their format and context, calibrated thresholds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnloom.llm._spark import settle

# Fixed values of the contract: kinds in their order and their patterns.
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),  # a run of digits is tried once, from its start
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Candidates of the method, a broader pattern for each kind; those that a base span of the kind covers are left to it.
BROAD = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?::[0-9]{1,5})?"),
    "card": re.compile(r"[0-9](?:[\x20.-]{0,2}[0-9]){11,18}"),
    "phone": re.compile(r"\(?[0-9]{2,4}[)\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}"),
}
#: What such data is introduced by.
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell"),
}
#: A text without any of these has no span of the kind, base or broad; most texts are done with this test.
NEEDS = {"email": re.compile(r"@|[(\[]at[)\]]"), "ip": re.compile(r"[0-9][.,][0-9]"), "card": re.compile(r"[0-9]"), "phone": re.compile(r"[0-9]")}

FEATURES = 17
#: Labelled candidates that the trees are fit on at most: the first in the order of a hash of text and place. Half of them calibrate.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 16
#: Precision that a kind's threshold must reach on the calibration half.
PRECISION = 0.98


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))
    if kind == "email":
        return True
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    found = []
    for k, kind in enumerate(KINDS):
        if (kind == "email" and "@" not in text) or (kind == "phone" and "+" not in text) or not NEEDS[kind].search(text):
            continue
        matches = _emails(text) if kind == "email" else BASE[kind].finditer(text)
        found += [(m.start(), k, m.end()) for m in matches if valid(kind, m[0])]
    return sorted(found)


_EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])" + BASE["email"].pattern)


def _emails(text: str) -> Iterator[re.Match]:
    """BASE["email"].finditer(text), where each run of characters is tried from its start, or the last match's end, only."""
    at = 0
    while m := BASE["email"].match(text, at) or _EMAIL_RUN.search(text, at):
        yield m
        at = m.end()


_CUED = {kind: re.compile(r"(?<![a-z])(?:e-?)?(?:" + "|".join(cues) + r")(?:s|ed|er|ment|ress|ess|phone|ephone)?(?![a-z])") for kind, cues in CUES.items()}
_SPELLED_OUT = re.compile(r"[(\[](?:at|dot)[)\]]")


def plausible(kind: str, s: str) -> bool:
    """What a number plan, a check digit or a domain says of a broad span, whatever the base patterns do."""
    if kind == "email":
        host = re.split(r"\s?(?:@|\(at\)|\[at\])\s?", s)[-1]
        labels = re.split(r"\s?(?:\.|\(dot\)|\[dot\])\s?", host)
        return re.fullmatch(r"[A-Za-z]{2,12}", labels[-1]) is not None and not labels[0].isdigit()
    if kind == "ip":
        octets = s.split(":")[0]
        return len(set(re.findall(r"[.,]", octets))) == 1 and all(int(x) <= 255 for x in re.split(r"[.,]", octets))
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "card":
        return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(set(digits)) > 2


def features(text: str, kind: int, start: int, end: int, found: list[tuple[int, int, int]]) -> list[float]:
    """Format and context of a span among the base spans, the same for all kinds; trees are told the kind."""
    s = text[start:end]
    digits = re.sub(r"[^0-9]", "", s)
    groups = re.findall(r"[0-9]+", s)
    left, right = text[max(0, start - 24) : start], text[end : end + 12]
    cue = _CUED[KINDS[kind]].search(left.lower())
    tail = re.search(r"[A-Za-z]+$", s)
    return [
        kind,
        len(s),
        len(digits),
        len(set(digits)),
        len(groups),
        max(map(len, groups), default=0),
        max((int(g[:9]) for g in groups), default=0),
        float(len(digits) >= 12 and luhn(digits)),
        len(re.findall(r"[\x20()]", s)),
        len(re.findall(r"[.,]", s)),
        len(tail[0]) if tail else 0,
        float(cue is not None),
        float(bool(left) and (left[-1].isalnum() or left[-1] in "+.,-")),
        float(bool(right) and (right[0].isalnum() or re.match(r"[.,-][0-9]", right) is not None)),
        float(plausible(KINDS[kind], s)),
        len(_SPELLED_OUT.findall(s)),
        float(any(a < end and start < b for a, _, b in found)),
    ]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the broad spans, which may overlap those of other kinds."""
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) if NEEDS[kind].search(text) for m in BROAD[kind].finditer(text))


_SAMPLED = "by long, y int, x array<double>"


def judged(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that no base span of their own kind touches: those the trees are asked about, and fit on."""
    return [(start, kind, end) for start, kind, end in candidates(text) if not any(k == kind and a < end and start < b for a, k, b in found)]


def _rewritten(kind: str, s: str, form: int) -> str | None:
    """A base span as people write it who keep to no pattern; None for addresses, which have no such form."""
    if kind == "email":
        at, dot = [(" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", " . ")][form % 4]
        local, host = s.rsplit("@", 1)
        return local + at + host.replace(".", dot)
    if kind == "phone":
        return s[1:]
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", s)
        return [".", "--", "  "][form % 3].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return None


def evidence(text: str) -> list[tuple[str, int, list[float]]]:
    """(place, label, features) of candidates like those that are judged, with labels that do not come from the base patterns.

    As they stand: personal data if a cue word or a country code comes before them, or @ and dots are spelled out, and they are plausible and stand
    alone; all others count as none, also those that no one can tell. Base spans are masked, that is rewritten to forms that
    no base pattern knows: what is found of their kind in them is personal data, what is found of others is none.
    """
    found = base_spans(text)
    out = []
    for start, kind, end in judged(text, found):
        x = features(text, kind, start, end, found)
        coded = KINDS[kind] == "phone" and re.search(r"\+[0-9]{1,3}[\x20.-]?$", text[max(0, start - 5) : start])
        y = (x[11] or coded or KINDS[kind] == "email" and x[15] >= 2) and x[14] and not x[12] and not x[13]
        out.append((f"{start}:{text[start : end + 20]}", int(bool(y)), x))
    for a, k, b in found:
        left, right = text[max(0, a - 40) : a], text[b : b + 20]
        key = f"{KINDS[k]}:{left}{text[a:b]}{right}"
        new = _rewritten(KINDS[k], text[a:b], hashlib.blake2b(key.encode(), digest_size=1).digest()[0])
        if new is None:
            continue
        masked = left + new + right
        left_over = base_spans(masked)
        for start, kind, end in judged(masked, left_over):
            if start < len(left) + len(new) and len(left) < end:
                inside = min(end, len(left) + len(new)) - max(start, len(left))
                out.append((f"{start}:{key}", int(kind == k and inside >= 0.8 * (end - start)), features(masked, kind, start, end, left_over)))
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by, ys, xs = [], [], []
        for text in batch.column("text").to_pylist():
            if not text or not NEEDS["card"].search(text) and not NEEDS["email"].search(text):
                continue
            for place, y, x in evidence(text):
                by.append(int.from_bytes(hashlib.blake2b(place.encode(), digest_size=8).digest(), "little", signed=True))
                ys.append(y)
                xs.append(x)
        yield pa.RecordBatch.from_pydict({"by": pa.array(by, pa.int64()), "y": pa.array(ys, pa.int32()), "x": pa.array(xs, pa.list_(pa.float64()))})


class Boosted:
    """Gradient-boosted trees for a yes-or-no label: second-order logistic loss, splits at quantiles, full trees of a fixed depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(FEATURES)]
        margin = np.full(len(y), self.start)
        for _ in range(TREES if len(x) else 0):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, p - y, p * (1 - p), cuts)
            self.trees.append(tree)
            margin += RATE * self._tree(tree, x)

    @staticmethod
    def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << DEPTH) - 1
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(x), np.int64)
        for at in range(inner):
            mine = node == at
            gs, hs, best = g[mine].sum(), h[mine].sum(), 1e-6
            for j in range(FEATURES):
                v = x[mine, j]
                for c in cuts[j]:
                    left = v <= c
                    gl, hl = g[mine][left].sum(), h[mine][left].sum()
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    if gain > best:
                        best, feature[at], cut[at] = gain, j, c
            node[mine] = 2 * at + 1 + (x[mine, feature[at]] > cut[at])
        for k in range(inner + 1):
            mine = node == inner + k
            leaf[k] = -g[mine].sum() / (h[mine].sum() + 1)
        return feature, cut, leaf

    @staticmethod
    def _tree(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return leaf[node - len(feature)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        for tree in self.trees:
            margin += RATE * self._tree(tree, x)
        return 1 / (1 + np.exp(-margin))


def calibrate(p: np.ndarray, y: np.ndarray) -> float:
    """The least threshold at which PRECISION of the spans at and above it are personal data; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    p, good = p[order], np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[p[1:] != p[:-1], True][: len(p)]
    fit = np.flatnonzero(last & (good >= PRECISION))
    return float(p[fit[-1]]) if len(fit) else 2.0


def fit(docs: DataFrame) -> tuple[Boosted, np.ndarray]:
    """Trees and a threshold for each kind. All documents' candidates are labelled and counted; of these, those with the least hashes are the
    sample. A first cut by hash leaves about twice SAMPLE, so what the tasks send does not grow with their number."""
    labelled = settle(docs.select("text").mapInArrow(_labelled, _SAMPLED), "pii-labelled")
    many = labelled.count()
    if many > 2 * SAMPLE:
        labelled = labelled.where(F.col("by") < -(1 << 63) + int(2 * SAMPLE / many * float(1 << 64)))
    rows = labelled.orderBy("by", "y", "x").limit(SAMPLE).collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, FEATURES)
    y = np.array([r["y"] for r in rows], np.float64)
    half = np.arange(len(y)) % 2 == 0
    model = Boosted(x[half], y[half])
    p = model.probability(x[~half])
    return model, np.array([calibrate(p[x[~half, 0] == k], y[~half][x[~half, 0] == k]) for k in range(len(KINDS))])


def selected(spans: list[tuple[int, int, int]], p: list[float]) -> list[tuple[int, int, int]]:
    """Of accepted candidates that overlap, the most probable; of equals the first."""
    kept: list[tuple[int, int, int]] = []
    for _, (a, k, e) in sorted(zip([-v for v in p], spans, strict=True)):
        if not any(a < to and start < e for start, _, to in kept):
            kept.append((a, k, e))
    return sorted(kept)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<start:int,end:int,kind:string,base:boolean>>"


def _spelled(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(model: Boosted, thresholds: np.ndarray, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, broad, x, owner = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text or not NEEDS["card"].search(text) and not NEEDS["email"].search(text):
                    base.append([])
                    continue
                base.append(base_spans(text))
                for start, kind, end in judged(text, base[i]):
                    broad.append((start, kind, end))
                    x.append(features(text, kind, start, end, base[i]))
                    owner.append(i)
            x = np.array(x).reshape(-1, FEATURES)
            p = model.probability(x)
            accepted: list[list] = [[] for _ in base]
            for i, span, v, k in zip(owner, broad, p.tolist(), p >= thresholds[x[:, 0].astype(int)], strict=True):
                if k:
                    accepted[i].append((span, v))
            more = [selected([s for s, _ in found], [v for _, v in found]) for found in accepted]
            made = {
                **{f"n_{kind}": pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k, kind in enumerate(KINDS)},
                "base_sha256": pa.array([hashlib.sha256(_spelled(b).encode()).hexdigest() for b in base], pa.string()),
                "spans": pa.array([_spelled(sorted(b + m)) for b, m in zip(base, more, strict=True)], pa.string()),
                "found": pa.array(
                    [[{"start": a, "end": e, "kind": KINDS[k], "base": (a, k, e) in set(b)} for a, k, e in sorted(b + m)] for b, m in zip(base, more, strict=True)],
                    out.field("found").type,
                ),
            }
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in out], schema=out)

    return run


def find_pii(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all by default) with the counts of base spans, their digest, and all spans (places in code points,
    end exclusive): base ones and candidates that touch none of their own kind and that the trees accept; of accepted ones that overlap, the
    most probable.

    Nulls and empty texts have no spans; repeated rows pass through; an empty table gives no rows (and trees that accept nothing).
    Columns of docs named as the new ones are replaced. Texts are searched whole; no shuffle but for the sample.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    model, thresholds = fit(docs)
    new = [f.name for f in StructType.fromDDL(FOUND)]
    kept = [c for c in (keep or docs.columns) if c not in new]
    to = StructType([*[docs.schema[c] for c in kept], *StructType.fromDDL(FOUND)])
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(_scan(model, thresholds, to_arrow_schema(to)), to)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by its kinds in brackets. Spans that overlap are one: all of what any of them covers goes, under the
    names of all of them."""
    found = find_pii(docs)
    t = F.col("text")
    none = "CAST(array() AS array<struct<start:int,end:int,kinds:array<string>>>)"

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.array_union(last["kinds"], F.array(s["kind"])).alias("kinds"))
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(s["kind"]).alias("kinds"))
        return F.when(last.isNotNull() & (s["start"] < last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(new)))

    spans = F.aggregate("found", F.expr(none), merge)
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(F.array_join(s["kinds"], "/")), F.lit("]")).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t) - acc["at"])),
    )
    return found.withColumn("text", F.when(F.size("found") > 0, cut).otherwise(t)).select(*docs.columns)
