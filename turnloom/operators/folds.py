"""The folds over a channel's events that depend on what was taken before, for a batch of channels at once: lists as offsets and values, in numpy.

A batch's lists lie one after another on one axis, each row on a stretch of its own, so a search in the axis is a search in each list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MATCH = "hits array<bigint>, fps array<boolean>"


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists and the row of each."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(n)), n)


def listed(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    """n lists of the values, which are in the order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32()), values)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype("int64")


def matches(seen: pa.Array, pos: pa.Array, negs: pa.Array, excl: pa.Array, before: int, after: int) -> pa.Array:
    """MATCH by row: the prediction that each positive claims, or null, and whether each negative span (start_ms, end_ms) holds a prediction that is in no positive's
    window. seen and pos are in order and distinct."""
    (p, p_row), (t, t_row), (neg, n_row), (out, x_row) = flat(seen), flat(pos), flat(negs), flat(excl)
    p, t = _numbers(p), _numbers(t)
    spans = [(rows, _numbers(x.field("start_ms")), _numbers(x.field("end_ms"))) for x, rows in ((neg, n_row), (out, x_row))]
    every = np.concatenate([p, t, *spans[0][1:], *spans[1][1:], [0]])
    least = every.min() - before
    width = every.max() + after + 1 - least
    key = p_row * width + (p - least)

    def inside(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.searchsorted(key, rows * width + (lo - least), "left")
        return a, np.maximum(a, np.searchsorted(key, rows * width + (hi - least), "right"))

    def covered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(a, minlength=len(key) + 1) - np.bincount(b, minlength=len(key) + 1))[:-1] > 0

    held = ~covered(*inside(*spans[1]))
    p, key = p[held], key[held]
    end = t + after
    end[:-1] = np.where(t_row[1:] == t_row[:-1], np.minimum(end[:-1], t[1:]), end[:-1])
    a, b = inside(t_row, t - before, end)
    hit, free = np.full(len(t), -1), 0  # the first prediction that none has claimed
    for k, (first, stop) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := max(first, free)) < stop:
            hit[k], free = x, x + 1
    hits = pa.array(p[hit] if len(p) else np.zeros(len(t), "int64"), pa.int64(), mask=hit < 0)
    alone = np.concatenate([[0], np.cumsum(~covered(a, b))])
    a, b = inside(*spans[0])
    n = len(seen)
    return pa.StructArray.from_arrays([listed(hits, t_row, n), listed(pa.array(alone[b] > alone[a]), n_row, n)], ["hits", "fps"])


def counted(pos: pa.Array, match: pa.StructArray) -> tuple[pa.Array, pa.Array]:
    """By row: the latencies of the hits of a MATCH, and how many negative spans are hit."""
    (t, row), (hits, _), (fps, n_row) = flat(pos), flat(match.field("hits")), flat(match.field("fps"))
    held = pc.is_valid(hits)
    lats = listed(pc.subtract(hits, t).filter(held), row[held.to_numpy(zero_copy_only=False)], len(pos))
    return lats, pa.array(np.bincount(n_row[fps.to_numpy(zero_copy_only=False)], minlength=len(pos)).astype("int64"))


def ends(at: pa.Array, step_ms: int) -> pa.Array:
    """When frames are known: their ends."""
    i, row = flat(at)
    return listed(pa.array((_numbers(i) + 1) * step_ms), row, len(at))


def rises(i: pa.Array, p: pa.Array, least: float, most: float, holds: list[int]) -> pa.Array:
    """One list: a channel's frames (i, lo, hi, low_k…) whose score rises from lo, that of the frame before (0 if there is none), to hi, where [lo, hi) may hold a threshold
    from least to most; low_k: the least score of the frame and the k after it, null where they end. Null scores are no rises and count for no least."""
    i = _numbers(i)
    order = np.argsort(i, kind="stable")
    i, p = i[order], p.to_numpy(zero_copy_only=False)[order]
    lo = np.nan_to_num(np.concatenate([[0.0], p[:-1]]))
    at = np.flatnonzero((p > lo) & (p > least) & (lo <= most))
    told = {"i": pa.array(i[at]), "lo": pa.array(lo[at]), "hi": pa.array(p[at])}
    high = np.where(np.isnan(p), np.inf, p)
    for k in holds:
        whole = at + k < len(p)
        ahead = np.full(len(at), np.nan)
        ahead[whole] = np.min([high[at[whole] + j] for j in range(k + 1)], axis=0)
        told[f"low_{k}"] = pa.array(ahead, mask=~whole)
    return listed(pa.StructArray.from_arrays(list(told.values()), list(told)), np.zeros(len(at), "int64"), 1)


def sweep(rises: pa.Array, thetas: list[float], refractories: list[int], recommits: list[int]):
    """(theta, refractory, recommit, fires by row) for each setting. rises: lists of (i, lo, hi, low_k…) in order."""
    e, row = flat(rises)
    i, lo, hi = _numbers(e.field("i")), *(e.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
    lows = {k: e.field(f"low_{k}").to_numpy(zero_copy_only=False) for k in recommits if k}  # null: nan, above nothing
    least = i.min() if len(i) else 0
    width = (i.max() - least if len(i) else 0) + max([1, *refractories, *recommits]) + 1
    for theta in thetas:
        on = (lo <= theta) & (theta < hi)
        key = row[on] * width + (i[on] - least)
        for r in refractories:
            # What follows the last edge of a row is the first of the next, which is always kept.
            following, kept, at = np.searchsorted(key, key + r).tolist(), [], 0
            while at < len(key):
                kept.append(at)
                at = max(following[at], at + 1)
            kept = np.array(kept, "int64")
            for k in recommits:
                again = key[kept][lows[k][on][kept] > theta] + k if k else key[:0]
                fires = np.unique(np.concatenate([key[kept], again]))
                yield theta, r, k, listed(pa.array(fires % width + least), fires // width, len(rises))
