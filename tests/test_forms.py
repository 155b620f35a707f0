"""Further forms of operators on hand-made rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import corpus as K
from turnloom.operators import frames as R
from turnloom.operators import intervals as I
from turnloom.operators import windows as V

SPAN = "conv_id long, speaker int, start_ms long, end_ms long"


def test_compatible_forms(spark):
    df = spark.createDataFrame([("ＡＢＣ ﬁne [x]!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.norm_text(F.col("t"), fold=True)).collect()] == ["abc fine", None, ""]
    assert [r[0] for r in df.select(T.norm_text(F.col("t"))).collect()] == ["ａｂｃ ﬁne", None, ""]


def test_activity_of_annotators_with_pad(spark):
    rows = [(1, 1, 100, 200, "Normal Turn"), (1, 1, 180, 260, "Normal Turn"), (1, 2, 0, 400, "Channel Bleed")]
    got = R.rasterize(spark.createDataFrame(rows, f"{SPAN}, label string"), 80, 50, ["Channel Bleed"])
    assert {(r.speaker, r.i): r.active for r in got.collect()} == {(1, 0): 1, (1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 0} | {(2, i): 0 for i in range(5)}


def test_exact_code_against_brute_force(spark):
    draw = random.Random(4)
    rows = [(c, 1 + draw.randrange(2), a, a + 20 * draw.randrange(1, 60)) for c in range(3) for a in (20 * draw.randrange(400) for _ in range(30))]
    times = [(c, 20 * k * 13) for c in range(4) for k in range(30)]
    bins = [200, 400, 600, 800]
    got = R.vap_code_exact(spark.createDataFrame(times, "conv_id long, t_ms long"), spark.createDataFrame(rows, SPAN), bins)
    want = {}
    for c, t in times:
        code, lo = 0, t
        for k, n in enumerate(bins):
            for s in (1, 2):
                on = sum(any(r[0] == c and r[1] == s and r[2] <= x < r[3] for r in rows) for x in range(lo, lo + n, 20))
                code |= (2 * on * 20 >= n) << (4 * (s - 1) + k)
            lo += n
        want[c, t] = code
    assert {(r.conv_id, r.t_ms): r.code for r in got.collect()} == want


def test_weights_of_floor_and_acts(spark):
    span = lambda *rows: spark.createDataFrame(list(rows), SPAN)
    frames = spark.createDataFrame([(1, s, i) for s in (1, 2) for i in range(4)], "conv_id long, speaker int, i long")
    got = R.floor_act_weights(frames, span((1, 1, 80, 160)), span((1, 2, 160, 320), (1, 1, 160, 320)), span((1, 1, 160, 320)), 80)
    rows = {(r.speaker, r.i): (r.floor_w, r.act_w) for r in got.collect()}
    assert [rows[1, i] for i in range(4)] == [(0, 1), (1, 1), (1, 1), (1, 1)]
    assert [rows[2, i] for i in range(4)] == [(0, 1), (1, 0), (1, 0), (1, 1)]


def test_offsets_at_any_distance(spark):
    anchors = spark.createDataFrame([(1, 1, 10_000), (1, 2, 5_000), (2, 1, 0)], "conv_id long, speaker int, t_ms long")
    turns = spark.createDataFrame([(1, 2, 7_000, 8_000), (1, 2, 60_000, 61_000), (1, 1, 4_000, 4_500), (1, 1, 6_000, 6_500)], SPAN)
    got = I.floor_transfer_offsets(anchors, turns)
    assert {(r.conv_id, r.speaker): r.offset_ms for r in got.collect()} == {(1, 1): 50_000, (1, 2): -1_000}
    assert I.offset_summary(got).collect()[0].asDict() == {"n": 2, "median_ms": 24_500.0, "overlap_share": 0.5}
    assert I.offset_summary(got.where("false")).collect()[0].asDict() == {"n": 0, "median_ms": None, "overlap_share": None}


def test_sufficient_from(spark):
    rows = [(1, 0, 9, 1), (1, 1, 3, 2), (1, 2, 8, 3), (1, 3, 0, 4), (2, 0, 9, 1), (3, 0, 8, 2), (3, 1, None, 3), (3, 2, 9, 4), (4, 0, None, 1), (4, 1, None, 8)]
    got = V.sufficient_from(spark.createDataFrame(rows, "turn long, t long, score int, seen long"), ["turn"], "t", "score", 8, "seen")
    assert {r.turn: (r.stable, r.lead, r.share) for r in got.collect()} == {1: (2, 1, 0.75), 3: (2, 0, 1.0), 4: (1, 0, 1.0)}


def test_crops_chunks_and_enrollment(spark):
    n = spark.createDataFrame([(1, 10), (2, 7), (3, 0)], "conv_id long, n long")
    assert sorted((r.conv_id, r.start) for r in R.crop_starts(n, 5, 2, 2, F.lit(2)).collect()) == [(1, 2), (1, 2), (1, 4), (1, 4)]
    assert sorted(tuple(r) for r in R.chunk_plan(n, 4, 3).collect()) == [(1, 0, 0, 4), (1, 1, 4, 8), (1, 5, 8, 10), (2, 0, 0, 4), (2, 1, 4, 7)]
    f = spark.createDataFrame([(1, 0, True, [1.0, 2.0]), (1, 1, False, [9.0, 9.0]), (1, 2, True, [3.0, 4.0]), (1, 3, True, [7.0, 7.0]), (2, 0, False, [5.0, 5.0])], "who long, i long, on boolean, v array<double>")
    assert {(r.who, r.pos): r["mean"] for r in V.enrollment_vector(f, ["who"], "i", "v", 2, F.col("on")).collect()} == {(1, 0): 2, (1, 1): 3, (2, 0): 0, (2, 1): 0}


def test_order_in_split_has_no_gaps(spark):
    got = K.order_in_split(spark.range(500).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 3 == 0, "dev").otherwise("train").alias("split")), "conv_id", "o").collect()
    for split in ("dev", "train"):
        assert sorted(r.nth for r in got if r.split == split) == list(range(sum(r.split == split for r in got)))
