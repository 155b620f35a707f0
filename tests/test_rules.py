"""Rules against plain re-tellings of them: gold of several annotators, silence policies, word times, replies, clips, intervals of resamples, streams, transcripts, judges."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnloom.functions import text
from turnloom.operators import anatomy, consensus, corpus, intervals, judge, scoring, silence, transcripts, windows
from turnloom.streaming import commits as X

# Gold of several annotators

SEGMENT = "conv_id long, speaker int, annotator string, start_ms long, end_ms long, canonical string"


def spans_by_millisecond(rows, n, k):
    """What k of n annotators say at each step of 10 ms, as spans."""
    out = []
    for channel in sorted({r[:2] for r in rows}):
        mine, last = [r for r in rows if r[:2] == channel], None
        for t in range(0, 3000, 10):
            said = {}
            for who in {r[2] for r in mine}:
                over = [r for r in mine if r[2] == who and r[3] <= t < r[4]]
                if over:
                    said[who] = max((r[3], r[5]) for r in over)[1]
            votes = defaultdict(int)
            for label in said.values():
                votes[label] += 1
            best = max(votes.items(), key=lambda x: (x[1], x[0]), default=(None, 0))
            state = None if not said else ("label", best[0]) if best[1] >= k else None if n - len(said) >= k else ("open", None)
            if state is None:
                last = None
            elif last and last[1] == state:
                last[0][3] = t + 10
            else:
                last = ([*channel, t, t + 10, state[1]], state)
                out.append(last[0])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_consensus_of_annotators_who_cut_differently(spark, k):
    r, rows = random.Random(k), []
    for conv in range(6):
        for speaker in (1, 2):
            for who in "abc":
                t = 0
                while t < 2500:
                    t += 10 * r.randrange(20)
                    n = 10 * r.randrange(1, 40)
                    rows.append((conv, speaker, who, t, t + n, r.choice(["Turn", "Turn", "Backchannel", "Interruption", "NonFloorTakingInterruption"])))
                    t += n if r.random() < 0.9 else n // 20 * 10
    rows = list({(x[0], x[1], x[2], x[3]): x for x in rows}.values())
    df = spark.createDataFrame(rows, SEGMENT).withColumn("label", F.col("canonical"))
    assert sorted((tuple(x) for x in consensus.consensus_spans(df, 3, k).collect()), key=str) == spans_by_millisecond(rows, 3, k)


def test_what_is_disputed_or_failed_is_excluded(spark):
    rows = [(1, 1, who, 0, end, "Turn") for who, end in (("a", 1000), ("b", 1200), ("c", 1200))]
    rows += [(1, 2, who, 1300, 2000, label) for who, label in (("a", "Turn"), ("b", "Backchannel"), ("c", "NonContent"))]
    rows += [(1, 2, who, 2500, 2800, "NonFloorTakingInterruption") for who in "abc"] + [(1, 1, who, 3000, 4000, "Interruption") for who in "abc"]
    df = spark.createDataFrame(rows, SEGMENT)
    got = {tuple(x) for x in consensus.consensus_gold(df, 3).collect()}
    assert got == {(1, "eot", "neg", 1, 1200, 3000), (1, "int", "excl", 2, 1300, 2000), (1, "int", "excl", 2, 2500, 2800), (1, "int", "pos", 1, 3000, 3000)}
    two = {tuple(x) for x in consensus.consensus_gold(df.where("annotator != 'c'"), 2).where("task = 'eot' AND kind = 'excl'").collect()}
    assert two == {(1, "eot", "excl", 1, 1000, 1200), (1, "eot", "excl", 2, 1300, 2000)}
    preds = spark.createDataFrame([(1, "int", 2, 2600)], "conv_id long, task string, speaker int, t_ms long")
    plain = scoring.gold_events(spark.createDataFrame([(1, 2, 2500, 2800, "NonFloorTakingInterruption"), (1, 2, 2550, 2700, "Backchannel")], "conv_id long, speaker int, start_ms long, end_ms long, canonical string"))
    assert [x.outcome for x in scoring.score_events(plain, preds).collect()] == ["TN"]
    assert [x.outcome for x in scoring.score_events(plain.where("kind != 'excl'"), preds).collect()] == ["FP"]


def test_annotators_who_agree_score_perfectly(golden):
    same = golden.select("*", F.explode(F.array(*[F.lit(x) for x in "abc"])).alias("annotator"))
    rows = consensus.annotator_ceiling(same, ["a", "b", "c"]).collect()
    assert len(rows) == 12 and all((r.recall, r.fn) == (1.0, 0) for r in rows)
    gold, own = consensus.consensus_gold(same, 3), consensus.own_events(same, "a")
    marks = consensus.by_marking(gold, same, ["a", "b", "c"], own).where("kind = 'pos'").collect()
    assert {(r.marking, r.n == r.hit) for r in marks} == {(3, True)}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(1, 1, 0, 2000, "Turn"), (1, 1, 2600, 4000, "Turn"), (1, 2, 4200, 6000, "Turn"), (1, 1, 5500, 7000, "Interruption"), (1, 2, 8000, 10000, "Turn"), (1, 1, 8500, 8800, "Backchannel"), (1, 1, 11000, 12000, "Turn")]
    return spark.createDataFrame(rows, "conv_id long, speaker int, start_ms long, end_ms long, canonical string")


def test_totals_by_difference_are_those_of_the_events(spark, golden):
    r = random.Random(3)
    gold = scoring.gold_events(golden)
    rows = [(p, 1, task, s, 10 * r.randrange(1200)) for p in range(4) for task in ("eot", "int") for s in (1, 2) for _ in range(r.randrange(6))]
    preds = spark.createDataFrame(rows, "policy int, conv_id long, task string, speaker int, t_ms long")
    events = scoring.score_events(gold, preds, ("policy",))
    want = sorted(map(str, scoring.summarize(events, ["policy", "task"]).collect()))
    assert sorted(map(str, scoring.event_totals(gold, preds, ["policy"]).collect())) == want
    every = spark.createDataFrame([(p,) for p in (0, 9)], "policy int")
    silent = scoring.event_totals(gold, preds, ["policy"], ("task",), every).where("policy = 9").collect()
    assert {(x.task, x.tp, x.fp, x.recall) for x in silent} == {("eot", 0, 0, 0.0), ("int", 0, 0, 0.0)}


# Silence policies


def told_commits(vad, quiet, other, again):
    """Frame by frame: ages from the first frame of a state, commits in quiet after own speech."""
    out, start = [], [0, 0]
    armed, last = [False, False], [None, None]
    for i in range(len(vad)):
        for s in (0, 1):
            if i and (vad[i][s] >= 0.5) != (vad[i - 1][s] >= 0.5):
                start[s] = i
        for s in (0, 1):
            if vad[i][s] >= 0.5:
                armed[s], last[s] = True, None
                continue
            ok = i - start[s] >= quiet and (other is None or (vad[i][1 - s] >= 0.5 and i - start[1 - s] >= other))
            if armed[s] and ok and (last[s] is None or (again is not None and i - last[s] >= again)):
                out.append((s + 1, i))
                last[s] = i
    return sorted(out)


def test_silence_policies_frame_by_frame(spark):
    r, vad, on = random.Random(8), [], [False, True]
    for _ in range(600):
        on = [x != (r.random() < 0.1) for x in on]
        vad.append([0.9 if x else 0.1 for x in on])
    rows = [(1, s + 1, i, vad[i][s]) for i in range(600) for s in (0, 1)]
    track = spark.createDataFrame(rows, "conv_id long, speaker int, i long, vad double")
    points = [(n, q, o, a) for n, (q, o, a) in enumerate([(q, o, a) for q in (0, 2, 7) for o in (None, 0, 3) for a in (None, 4)])]
    fires = silence.silence_fires(track, spark.createDataFrame(points, "policy int, quiet int, other int, again int")).collect()
    for n, q, o, a in points:
        assert sorted((x.speaker, x.i) for x in fires if x.policy == n) == told_commits(vad, q, o, a)
    # The other has to talk, not to be quiet.
    own, other = [1] * 3 + [0] * 12, [0] * 8 + [1] * 7
    rows = [(1, s, i, float(v)) for s, t in ((1, own), (2, other)) for i, v in enumerate(t)]
    ages = silence.state_ages(spark.createDataFrame(rows, "conv_id long, speaker int, i long, vad double")).where("speaker = 1")
    assert sorted(x.i for x in ages.where(silence.eligible(2, 3)).collect()) == [11, 12, 13, 14]
    assert sorted(x.i for x in ages.where(silence.eligible(2)).collect()) == list(range(5, 15))


# Word times and replies


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ([("a", 100, 400), ("b", None, None), ("c", None, None), ("d", 900, 950)], [(100, 400), (400, 650), (650, 900), (900, 950)]),
        ([("a", None, None), ("b", 600, 800), ("c", None, None), ("d", None, None)], [(0, 600), (600, 800), (800, 900), (900, 1000)]),
        ([("a", 0, 400), ("b", None, None), ("c", 400, 900)], [(0, 400), (0, 900), (400, 900)]),  # no gap: the neighbours' time
        ([("a", 100, 980), ("b", None, None)], [(100, 980), (100, 1000)]),
        ([("?", None, None), ("a", 100, 300), ("、", 5, 9), ("?", None, None), ("b", None, None)], [(100, 100), (100, 300), (300, 300), (300, 300), (300, 1000)]),
        ([("…", None, None), ("--", 3, 4)], [(0, 500), (500, 1000)]),  # nothing spoken
    ],
)
def test_word_times(spark, words, want):
    rows = [(1, n, w, a, b, 1000) for n, (w, a, b) in enumerate(words)]
    df = spark.createDataFrame(rows, "conv_id long, n int, word string, start_ms long, end_ms long, duration_ms long")
    assert [(r.start_ms, r.end_ms) for r in intervals.fill_missing_times(df, "conv_id", "n", "word", "duration_ms").orderBy("n").collect()] == want


def test_replies_to_numbered_questions(spark):
    def told(reply, n):
        got = {int(m[1]): m[2].strip() for m in re.finditer(r"(?m)^\W*(\d+)\W*[:.]\s*(.+)$", reply)}
        if not all(k in got for k in range(n)):
            return None
        return [(k, got[k], min(10, int(m.group())) if (m := re.match(r"\d+", got[k])) else None) for k in range(n)]

    replies = [
        "0: 8/10\n1: 7", "0: a\n7: b", "1: a\n2: b", "0: a\n1: b\n0: c", "**0.** 12 words\n- 1) : x ", "0: \n1: y\n1: z", "0. 5: x\nsee\n 1:7", "00: 007\n01: 99999999999999", "", "0: é\n1: ü3",
        "0: a\n1:", "0:1\n\n(1). 10", "0 1: x",
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "id int, reply string").withColumn("rows", text.parse_numbered(F.col("reply"), F.lit(2)))
    got = {r.id: r["rows"] and [tuple(x) for x in r["rows"]] for r in df.collect()}
    assert got == {k: told(reply, 2) for k, reply in enumerate(replies)}
    assert spark.range(1).select(text.parse_numbered(F.lit(None).cast("string"), F.lit(1)).alias("r")).first().r is None


def test_nothing_is_known_before_the_first_frame(spark):
    track = spark.createDataFrame([(1, 1, i, 0.5 + i, "x") for i in range(3)], "conv_id long, speaker int, i long, p double, s string")
    points = spark.createDataFrame([(1, 1, t) for t in (0, 79, 80, 239, 240, 9999)], "conv_id long, speaker int, t_ms long")
    assert [(r.t_ms, r.i, r.p) for r in windows.as_of(points, track, 80).orderBy("t_ms").collect()] == [(0, -1, 0.0), (79, -1, 0.0), (80, 0, 0.5), (239, 1, 1.5), (240, 2, 2.5), (9999, 2, 2.5)]


def test_gap_to_a_turn_that_is_far_off(spark):
    scores = spark.createDataFrame([(1, "eot", 1, "TP", 5000, 100), (1, "eot", 1, "FN", 9000, None)], "conv_id long, task string, speaker int, outcome string, t_ms long, latency_ms long")
    win = scores.select("conv_id", "speaker", "t_ms", (F.col("t_ms") - 250).alias("lo_ms"), (F.col("t_ms") + 3000).alias("hi_ms"))
    preds = spark.createDataFrame([], "conv_id long, speaker int, t_ms long")
    track = spark.createDataFrame([(1, 1, 0, 0.5)], "conv_id long, speaker int, i long, eot double")
    turns = [(1, "a", 2, 0, 6000, "x", "Turn", "t"), (1, "a", 2, 2_000_000, 2_000_500, "x", "Turn", "t")]
    segments = spark.createDataFrame(turns, "conv_id long, annotator string, speaker int, start_ms long, end_ms long, label string, canonical string, text string")
    out = anatomy.turn_end_residuals(scores, win, preds, track, "eot", segments, ["a"], 80)
    assert {r.t_ms: r.gap_ms for r in out.collect()} == {5000: 1_995_000, 9000: 1_991_000}


# Clips


def told_clips(rows, seconds, feed_cap, episode_cap, salt, least, most, partition=None, share=0.02):
    unit = lambda key, s: int(hashlib.sha256(f"{s}:{key}".encode()).hexdigest()[:15], 16) / 16**15
    order = sorted((unit(f"{e}#{c}", salt), f, e, c, s) for f, e, c, s in rows if least <= s <= most and (partition is None or (unit(f, salt + ":split") < share) == (partition == "val")))
    feeds, episodes, out, total = defaultdict(float), defaultdict(float), set(), 0.0
    for _, f, e, c, s in order:
        if feeds[f] + s > feed_cap or episodes[f, e] + s > episode_cap:
            continue
        feeds[f], episodes[f, e], total = feeds[f] + s, episodes[f, e] + s, total + s
        out.add((f, e, c))
        if total >= seconds:
            break
    return out


def test_clips_of_a_hot_feed_against_one_pass(spark, monkeypatch):
    r = random.Random(6)
    rows = [("hot" if r.random() < 0.4 else f"f{r.randrange(9)}", f"e{r.randrange(12)}", k, float(r.randrange(5, 90))) for k in range(1500)]
    rows += [("few", "one", 5000 + k, 30.0) for k in range(300)]  # an episode that fills before its feed
    df = spark.createDataFrame(rows, "feed string, episode string, clip long, seconds double").repartition(3)
    for at_once in (4.0, 0.5):
        monkeypatch.setattr(corpus, "FEED_CAPS_AT_ONCE", at_once)
        for args in ((1e9, 900.0, 200.0, "s", 10.0, 80.0), (2500.0, 900.0, 200.0, "s", 10.0, 80.0)):
            assert {(x.feed, x.episode, x.clip) for x in corpus.select_clips(df, *args).collect()} == told_clips(rows, *args)
    args = (1e9, 900.0, 200.0, "s", 10.0, 80.0, "val", 0.4)
    assert {(x.feed, x.episode, x.clip) for x in corpus.select_clips(df, *args).collect()} == told_clips(rows, *args)
    assert corpus.select_clips(df.limit(0), 9.0, 9.0, 9.0, "s", 1.0, 2.0).count() == 0


# Resamples


def test_intervals_of_one_and_of_differing_groups(spark):
    counts = spark.createDataFrame([(g, s, 3, 1, s, 2) for g in range(6) for s in (1, 2)], "grp int, system int, tp long, fn long, fp long, tn long")
    lats = spark.createDataFrame([(g, s, 100 * s, 3) for g in range(6) for s in (1, 2)], "grp int, system int, latency_ms long, n long")
    got = {(r.system, r.metric): r for r in scoring.cluster_bootstrap(counts, lats, "grp", "system", 40, 1).collect()}
    assert len(got) == 6 and all((r.low, r.high, r.valid) == (r.value, r.value, 40) for r in got.values())
    assert (got[2, "recall"].diff, got[2, "fp_rate"].diff, got[2, "p50_ms"].low_diff) == (0.0, 0.5 - 1 / 3, 100.0)
    assert scoring.cluster_bootstrap(counts.where("grp < 3"), lats, "grp", "system", 40, 1).count() == 0
    some = scoring.cluster_bootstrap(counts, lats.where("grp = 0"), "grp", "system", 40, 1).where("metric = 'p50_ms'").first()
    assert some.valid < 40  # resamples without the group that has latencies


# Streams


def test_state_ends_and_late_frames_go(spark, tmp_path):
    schema = "conv_id long, speaker int, i long, p double, last boolean, ts timestamp"
    frame = lambda conv, i, at, last=False: (conv, 1, i, 0.9 if i % 4 == 3 else 0.1, last, at)
    hours = lambda rows: spark.createDataFrame(rows, "conv_id long, speaker int, i long, p double, last boolean, at long").select("*", F.timestamp_millis(F.col("at")).alias("ts")).drop("at")
    files = [
        [frame(1, i, i * 80) for i in range(8)] + [frame(2, i, i * 80, i == 7) for i in range(8)],
        [frame(3, i, 3_600_000 + i * 80) for i in range(8)],  # the watermark passes the first two
        [frame(3, 10, 3_600_800), frame(3, 11, 3_600_880)],
        [frame(1, 10, 800), frame(1, 11, 880)] + [frame(9, i, 9_000_000 + i * 80, i == 3) for i in range(4)],  # the first two are late
    ]
    for k, rows in enumerate(files):
        hours(rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    out = X.rising_edge_commit(stream, "p", 0.5, 2)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.conv_id, r.i) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 3), (1, 7), (2, 3), (2, 7), (3, 3), (3, 7), (3, 11), (9, 3)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


# Transcripts and judges


def test_transcripts_show_nothing_that_comes_later(spark):
    segs = [(1, 1, 0, 1000, "one two three four"), (1, 2, 500, 1500, "[noise tag] yes"), (1, 1, 2000, 3000, "five six"), (1, 2, 2500, 4000, "a b c d e"), (1, 1, 9000, 9500, "")]
    df = spark.createDataFrame(segs, "conv_id long, speaker int, start_ms long, end_ms long, text string")
    points = spark.createDataFrame([(1, 1, t, None) for t in (100, 700, 1800, 2800, 9999)] + [(1, 2, 2800, 500)], "conv_id long, speaker int, t_ms long, own_start_ms long")
    lines = {(r.speaker, r.t_ms): r.context for r in transcripts.shown_lines(df, points).collect()}
    assert lines[1, 100] == "" and lines[1, 700] == "A: one ..." and lines[1, 1800] == "A: one two three four\nB: [noise tag] yes"
    assert lines[1, 2800] == "A: one two three four\nB: [noise tag] yes\nA: five ..." and lines[2, 2800] == "B: one two three four\nB: five ..."
    runs = {r.t_ms: r.context for r in transcripts.shown_runs(df, points.where("speaker = 1").select("conv_id", "speaker", "t_ms"), n=2).collect()}
    assert runs[100] == "(nothing yet)" and runs[9999] == "A: five six\nB: a b c d e" and runs[1800] == "A: one two three four\nB: [noise tag] yes"
    told = transcripts.shown_messages(df, points.where("speaker = 1").select("conv_id", "speaker", "t_ms"))
    said = {r.t_ms: [(m.who, " ".join(m.words)) for m in r.messages] for r in told.collect()}
    assert said[1800] == [("user", "one two three four"), ("assistant", "[noise tag] yes")] and said[100] == []
    assert said[9999][-2:] == [("user", "five six"), ("assistant", "a b c d e")]


def test_a_judge_that_fails_is_asked_again(spark):
    items = spark.createDataFrame([(k, k % 3, k // 9, f"t{k}") for k in range(60)], "id long, lane long, batch long, text string")

    def half(rows):
        assert len({(r["lane"], r["batch"]) for r in rows}) == 1
        if rows[0]["batch"] % 2:
            raise ConnectionError("down")
        return [len(r["text"]) for r in rows][: len(rows) - (rows[0]["batch"] == 4)]

    first = judge.judged(items, "id", ["lane", "batch"], half, "int", attempts=2).cache()
    assert first.count() == 60 and first.where("result IS NULL AND error IS NOT NULL").count() == sum(b % 2 or b == 4 for b in [k // 9 for k in range(60)])
    again = judge.judged(items, "id", ["lane", "batch"], lambda rows: [len(r["text"]) for r in rows], "int", first)
    assert again.count() == first.where("result IS NULL").count()
    assert {(r.id, r.result, r.error) for r in judge.resumed(first, again, "id").collect()} == {(k, len(f"t{k}"), None) for k in range(60)}


# Causality


def test_a_look_ahead_is_caught(spark):
    from pyspark.sql import Window as W

    from turnloom.operators.prefix import prefix_report
    from turnloom.plans.stream_queries import CAUSAL

    r = random.Random(12)
    rows, on = [], [0, 0]
    for conv in range(4):
        for i in range(300):
            for s in (1, 2):
                on[s - 1] ^= r.random() < 0.1
                rows.append((conv, s, i, 0.9 if on[s - 1] else 0.1, r.random(), r.random()))
    track = spark.createDataFrame(rows, "conv_id long, speaker int, i long, vad double, eot double, int double")
    ahead = W.partitionBy("conv_id", "speaker").orderBy("i")
    planted = {
        "next": lambda f: f.select("conv_id", "speaker", "i", F.lead("eot").over(ahead).alias("x")),
        "whole": lambda f: f.select("conv_id", "speaker", "i", F.max("eot").over(W.partitionBy("conv_id")).alias("x")),
        "other": lambda f: f.join(f.groupBy("conv_id").agg(F.max("i").alias("n")), "conv_id").where("i < n - 40").select("conv_id", "speaker", "i"),
        "now": lambda f: f.select("conv_id", "speaker", "i", "eot"),
    }
    assert {x.job for x in prefix_report(track, planted, "s").select("job").distinct().collect()} == {"next", "whole", "other"}
    few = {k: CAUSAL[k] for k in ("C04_fires", "C06", "W01", "J02")}
    assert prefix_report(track, few, "t").count() == 0


# Policies as rows


def test_policies_as_rows_equal_each_alone(spark):
    from turnloom.operators import policy as P

    r, speech, frames = random.Random(21), [], []
    for conv in range(3):
        for s in (1, 2):
            t = 0
            while t < 20_000:
                t += r.choice([120, 250, 300, 600, 1500, 4000])
                n = r.choice([100, 400, 700, 2000])
                speech.append((conv, s, t, t + n))
                t += n
            frames += [(conv, s, i, r.random()) for i in range(300)]
    speech = spark.createDataFrame(speech, "conv_id long, speaker int, start_ms long, end_ms long")
    durations = spark.createDataFrame([(c, 24_000) for c in range(3)], "conv_id long, duration_ms long")
    track = spark.createDataFrame(frames, "conv_id long, speaker int, i long, eot double")
    policies = [
        P.Policy(eot_th=None), P.Policy(eot_th=0.95), P.Policy(eot_th=0.9, min_gap=320, mw_model=320, read_from=0), P.Policy(min_gap=320, deadline=1200, confirm=None, eot_th=0.99),
        P.Policy(min_wait=400, other_dur=100, resume_min=300, eot_th=None, confirm=1500),
    ]
    rows = spark.createDataFrame([P.grid_row(f"p{n}", p) for n, p in enumerate(policies)], P.GRID)
    got = defaultdict(set)
    for x in P.turn_end_grid(speech, durations, rows, track).collect():
        got[x.policy].add((x.conv_id, x.speaker, x.t_ms))
    for n, p in enumerate(policies):
        voices = intervals.union_intervals(speech, ["conv_id", "speaker"], p.min_gap, inclusive=False)
        alone = {tuple(x) for x in P.turn_ends(voices, durations, p, track).collect()}
        assert alone and got[f"p{n}"] == alone, n


def test_activity_of_diarized_slots(spark):
    from turnloom.operators import frames as R

    segs = [(1, "x", 100, 250), (1, "w", 90, 130), (2, "a", 0, 40), (2, "b", 0, 80), (2, "c", 5, 9), (3, "z", 500, 900)]
    df = spark.createDataFrame(segs, "conv_id long, who string, start_ms long, end_ms long")
    lengths = spark.createDataFrame([(1, 4), (2, 2), (3, 3), (4, 5)], "conv_id long, frames long")
    got = {(r.conv_id, r.slot, r.i): r.active for r in R.slot_activity(df, lengths, 80).collect()}
    assert {k for k, v in got.items() if v} == {(1, 0, 1), (1, 1, 1), (1, 1, 2)}  # centres 40, 120, 200, 280; the one who begins first is slot 0
    assert len(got) == 8 + 6 and all(k[0] != 2 for k in got)
    assert [(r.conv_id, r.speakers) for r in R.slot_rejects(df).collect()] == [(2, 3)]
