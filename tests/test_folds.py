"""Sweeps and matches made for batches of channels, against the rules told one by one."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from turnloom.operators import folds
from turnloom.operators import policy as P
from turnloom.operators import scoring as M
from turnloom.plans import fixtures

THETAS, REFRACTORIES, RECOMMITS = [0.2, 0.5, 0.8], [1, 4], [0, 3]


def told_sweep(frames, theta, refractory, recommit):
    """frames: (i, p) in order. Edges far enough apart, and again where the score stays above."""
    out, last = set(), None
    for n, (i, p) in enumerate(frames):
        before = frames[n - 1][1] if n and frames[n - 1][1] is not None else 0.0
        if p is None or not p > theta or before > theta or (last is not None and i - last < refractory):
            continue
        out.add(i)
        last = i
        held = [x for _, x in frames[n : n + recommit + 1]]
        if recommit and len(held) == recommit + 1 and all(x is None or x > theta for x in held):
            out.add(i + recommit)
    return out


def test_a_sweep_is_that_of_each_setting_alone(spark):
    r, tracks = random.Random(5), {}
    for c in range(6):
        for s in (1, 2):
            tracks[c, s] = [(i, r.choice([None, *[k / 10 for k in range(11)]])) for i in range(0 if c else 2, 60) if r.random() < 0.9]
    rows = [(c, s, i, p) for (c, s), f in tracks.items() for i, p in f]
    r.shuffle(rows)
    track = spark.createDataFrame(rows, "conv_id long, speaker int, i long, eot double")
    thetas = spark.createDataFrame([(t,) for t in THETAS], "theta double")
    got = {}
    for x in M.sweep_fires(track, "eot", thetas, REFRACTORIES, RECOMMITS).collect():
        got.setdefault((x.theta, x.refractory, x.recommit, x.conv_id, x.speaker), []).append(x.i)
    want = {(t, a, k, *c): told_sweep(f, t, a, k) for t in THETAS for a in REFRACTORIES for k in RECOMMITS for c, f in tracks.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def told_match(seen, pos, negs, excl, before, after):
    seen = [p for p in seen if not any(a <= p <= b for a, b in excl)]
    ends = [min(t + after, *pos[k + 1 : k + 2], t + after) for k, t in enumerate(pos)]
    hits, last = [], None
    for t, end in zip(pos, ends, strict=True):
        hit = next((p for p in seen if t - before <= p <= end and (last is None or p > last)), None)
        hits.append(hit)
        last = last if hit is None else hit
    free = [p for p in seen if not any(t - before <= p <= end for t, end in zip(pos, ends, strict=True))]
    return {"hits": hits, "fps": [any(a <= p <= b for p in free) for a, b in negs]}


def test_matches_are_claimed_in_order(spark):
    r = random.Random(6)
    some = lambda most: sorted(r.sample(range(400), r.randrange(most)))
    spans = lambda: sorted((a, a + r.randrange(60)) for a in some(5))
    rows = [(some(30), some(9), spans(), spans()) for _ in range(200)] + [([], [], [], []), ([], [5], [(1, 2)], [])]
    listed = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    as_spans = lambda k: pa.array([[{"start_ms": a, "end_ms": b} for a, b in x[k]] for x in rows], listed)
    longs = lambda k: pa.array([x[k] for x in rows], pa.list_(pa.int64()))
    assert folds.matches(longs(0), longs(1), as_spans(2), as_spans(3), 25, 70).to_pylist() == [told_match(*x, 25, 70) for x in rows]


def test_thresholds_multiply_after_the_last_shuffle(spark):
    thetas = spark.createDataFrame([(t,) for t in THETAS], "theta double")
    track = fixtures.frames(spark, "/root/testdata/sf0.001")
    plan = M.sweep_fires(track, "eot", thetas, REFRACTORIES, RECOMMITS)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(theta" not in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_turn_policies_multiply_after_the_last_shuffle(spark):
    rows = spark.createDataFrame([P.grid_row(f"p{n}", P.Policy(eot_th=t, min_gap=g)) for n, (t, g) in enumerate([(None, 200), (0.7, 320), (0.9, 200)])], P.GRID)
    speech = fixtures.segments(spark, "/root/testdata/sf0.001").select("conv_id", "speaker", "start_ms", "end_ms")
    durations = speech.groupBy("conv_id").agg(F.max("end_ms").alias("duration_ms"))
    plan = P.turn_end_grid(speech, durations, rows, fixtures.frames(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(policy" not in plan and "hashpartitioning(eot_th" not in plan
