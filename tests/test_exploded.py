"""Frames made by explode look as small to the planner as their segments: no plan may send them through the driver."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from turnloom.operators import anatomy as A
from turnloom.operators import frames as R
from turnloom.operators import silence as S
from turnloom.plans import fixtures, stream_queries

SF = "/root/testdata/sf0.001"
SPAN = "conv_id long, speaker int, start_ms long, end_ms long"
QUERIES = [
    "J02_validity_spans", "R07_vap_code", "R08_targets", "R10_acts", "R10_slots", "R12_onset_label", "M17_false_events", "M17_padded", "M18_agreement", "R01_annotators", "R01_rasterize", "R02_fine_acts",
    "R05_weights", "R08_occupancy",
]


@pytest.mark.parametrize("name", QUERIES)
def test_no_frames_are_broadcast(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_marks_keep_to_the_grid(spark):
    seg = spark.createDataFrame([(1, 1, 0, 200), (1, 2, 400, 401), (None, 1, 0, 80)], SPAN).withColumn("label", F.lit("x"))
    got = {(r.conv_id, r.speaker, r.i): r.active for r in R.rasterize(seg, 80, 500).collect()}
    assert got == {(1, s, i): 1 for s in (1, 2) for i in range(6)} | {(None, s, 0): 0 for s in (1, 2)}
    frames = R.rasterize(seg, 80)
    out = R.floor_act_weights(frames, seg.where("speaker = 2"), seg.where("speaker = 1"), seg.limit(0), 80)
    assert {(r.conv_id, r.speaker, r.i) for r in out.where("floor_w = 0").collect()} == {(1, 1, 4), (1, 2, 4)}
    assert {(r.conv_id, r.speaker, r.i) for r in out.where("act_w = 0").collect()} == {(1, 1, 0), (1, 1, 1)}


def test_false_events_with_and_without_pad(spark):
    row = "conv_id long, speaker int, i long, active int"
    active = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 1), (1, 1, 1, 0), (1, 2, 1, 1), (1, 1, 2, 1), (1, 2, 2, 1), (1, 1, 3, 0)], row)
    wide = active.withColumn("active", F.when((F.col("speaker") == 1) & (F.col("i") == 1), 1).otherwise(F.col("active")))
    fires = active.where("speaker = 1 AND i IN (1, 3)")
    assert [(r.speaker, r.fires, r.minutes) for r in A.false_event_rate(fires, active, 60000).collect()] == [(1, 1, 2.0)]
    assert [(r.speaker, r.fires, r.minutes) for r in A.false_event_rate(fires, active, 60000, wide).collect()] == [(1, 0, 1.0)]


def test_files_of_a_stream_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(stream_queries, "FRAMES_PER_FILE", 5000)
    frames, files = stream_queries.frames(spark, SF).count(), (stream_queries._stream(spark, SF), len(spark.read.parquet(_newest(spark)).inputFiles()))[1]
    assert files >= frames / 5000 - 1 > 4


def test_state_of_a_stream_has_a_partition_for_each_file(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(stream_queries, "FRAMES_PER_FILE", 5000)
    own = stream_queries._stream(spark, SF).sparkSession
    assert int(own.conf.get("spark.sql.shuffle.partitions")) >= len(spark.read.parquet(_newest(spark)).inputFiles()) > 4
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_partitions_of_frames_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS_PER_PARTITION", 5000)
    f = fixtures.frames(spark, SF)
    assert f.rdd.getNumPartitions() >= f.count() / 5000 > 4


def test_members_are_counted_without_distinct_groups(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.7), (2, "a", 0.5), (2, "a", 0.5), (3, "a", 0.5), (4, "a", 0.5), (4, None, 0.1), (5, "a", 1.5), (5, "b", 0.5)]
    mean, bad = A.aligned_mean(spark.createDataFrame(rows, "k long, member string, p double"), ["k"], "p", 2)
    assert [(r.k, round(r["mean"], 9)) for r in mean.collect()] == [(1, 0.6)] and {r.k for r in bad.collect()} == {2, 3, 4, 5}
    assert "distinct" not in bad._jdf.queryExecution().executedPlan().toString()


def _newest(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return max((f"{root}/{p}" for p in os.listdir(root) if p.startswith("stream-")), key=os.path.getmtime)


def test_frames_are_made_after_the_shuffle(spark):
    plan = fixtures.frames(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]


@pytest.mark.parametrize("name", ["A02_turn_ends", "A03_miss_causes", "C02_recommit", "R09_eot_targets", "W11_readout"])
def test_joins_by_frame_are_merge_joins(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[[^\]]*\bi#", plan)


def test_silence_policies_multiply_after_the_last_shuffle(spark):
    track = fixtures.frames(spark, SF)
    policies = spark.createDataFrame([(0, 2, None, None), (1, 4, 2, 19)], "policy int, quiet int, other int, again int")
    plan = S.silence_fires(track, policies)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan[: plan.index("BroadcastNestedLoopJoin")]


@pytest.mark.parametrize("pad", [0, 300])
def test_padded_rate_of_segments_is_that_of_frames(spark, pad):
    rnd = random.Random(pad)
    rows = [(rnd.choice([0, 1, 2, 3, 4, None]), rnd.choice([1, 2, 1, 2, 1, 2, 3, None]), a := rnd.randrange(0, 20000), a + rnd.choice([-50, 0, 1, 80, 500, 1000, 1500]), rnd.choice(["x", "out", None])) for _ in range(80)]
    seg = spark.createDataFrame([*rows, (7, 1, 100, 90000, "out"), (8, 2, 100, 900, "x")], f"{SPAN}, label string")
    fires = spark.createDataFrame([(c, s, i) for c in range(9) for s in (1, 2) for i in range(0, 300, 3)], "conv_id long, speaker int, i long")
    want = A.false_event_rate(fires, R.rasterize(seg, 80, 0, ["out"]), 80, R.rasterize(seg, 80, pad, ["out"]))
    got = A.padded_false_event_rate(fires, seg, 80, pad, ["out"])
    told = lambda df: sorted((r.speaker, r.fires, round(r.minutes, 9), round(r.per_minute, 9)) for r in df.collect())
    assert told(got) == told(want) and len(told(got)) == 2
    assert got.dtypes == want.dtypes


def test_padded_rate_shuffles_no_frames(spark):
    plan = __spark_entry__.queries()["M17_padded"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*\bi#", plan) and plan.count("Generate explode(sequence") == 1  # those that the fires are found in
