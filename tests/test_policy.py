"""Hand-made cases of the turn policies, of fine labels and of overlap geometry."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import vocab
from turnloom.operators import candidates, commit, frames, intervals
from turnloom.operators.policy import Policy, floor_taken, turn_ends
from turnloom.streaming import commits as X

RULES = dict(eot_th=None, int_th=None)


@pytest.fixture(scope="module")
def ends(spark):
    def run(own, other=(), until=10_000, score=None, **p):
        rows = [(1, 1, a, b) for a, b in own] + [(1, 2, a, b) for a, b in other]
        voices = spark.createDataFrame(rows, "conv_id long, speaker int, start_ms long, end_ms long")
        track = None if score is None else spark.createDataFrame([(1, 1, i, float(v)) for i, v in enumerate(score)], "conv_id long, speaker int, i long, eot double")
        got = turn_ends(voices, spark.createDataFrame([(1, until)], "conv_id long, duration_ms long"), Policy(**p), track)
        return sorted(r.t_ms for r in got.where("speaker = 1").collect())
    return run


@pytest.fixture(scope="module")
def taken(spark):
    def run(own, score=None, **p):
        voices = spark.createDataFrame([(1, 1, a, b) for a, b in own], "conv_id long, speaker int, start_ms long, end_ms long")
        track = None if score is None else spark.createDataFrame([(1, 1, i, float(v)) for i, v in enumerate(score)], "conv_id long, speaker int, i long, int double")
        return sorted(r.t_ms for r in floor_taken(voices, Policy(**p), track).collect())
    return run


def test_deadline_and_confirmation(ends):
    assert ends([(0, 2000)], **RULES, deadline=2000, confirm=2500) == [4000, 4500]
    assert ends([(0, 2000)], **RULES, deadline=2500, confirm=2500) == [4500]
    assert ends([(0, 2000)], **RULES, confirm=None) == [4500]


def test_the_others_voice_commits_after_min_wait(ends):
    assert ends([(0, 2000)], [(2100, 5000)], **RULES, min_wait=800, other_dur=200, confirm=None) == [2800]
    assert ends([(0, 2000)], [(2700, 5000)], **RULES, min_wait=600, other_dur=300, confirm=None) == [3000]


def test_only_a_lasting_resumption_cancels(ends):
    assert ends([(0, 2000), (3000, 6000)], **RULES, confirm=None) == [8500]
    assert 4500 in ends([(0, 2000), (3000, 3200)], **RULES, confirm=None)


def test_no_confirmation_after_a_resumption(ends):
    got = ends([(0, 2000), (3500, 6000)], [(2100, 3000)], **RULES, min_wait=600, other_dur=200)
    assert 2600 in got and 4500 not in got


def test_score_commits_early_but_not_before_its_wait(ends):
    late = [0.0] * 30 + [0.9] * 95
    assert ends([(0, 2000)], score=late, eot_th=0.8, mw_model=320, read_from=160, confirm=None) == [2480]
    assert ends([(0, 2000)], score=[0.9] * 125, eot_th=0.8, mw_model=320, read_from=160, confirm=None) == [2320]


def test_pending_ends_are_flushed_at_the_end(ends):
    assert ends([(0, 2000)], until=3000, **RULES) == [3000]


def test_interruptions_by_duration_and_score(taken):
    assert taken([(1000, 1500), (3000, 5000)], **RULES, int_dur=900) == [3900]
    assert taken([(1000, 1700)], **RULES, int_dur=800) == [1800]
    assert taken([(1000, 1500)], **RULES, int_dur=800) == []
    score = [0.8 if i == 41 else 0.0 for i in range(125)]
    assert taken([(3000, 5000)], score, int_th=0.5, int_dur=900, int_fallback=False) == [3360]
    assert taken([(2000, 5000)], score, int_th=0.5, int_dur=900, int_fallback=False) == []
    # A score that rises after the fallback does not put it off.
    assert taken([(2000, 5000)], score, int_th=0.5, int_dur=900) == [2900]


def _vad(rnd, n):
    out = []
    while len(out) < n:
        out += [float(len(out) % 2)] * rnd.randrange(1, 12) if not out or out[-1] != float(len(out) % 2) else [1.0 - out[-1]] * rnd.randrange(1, 12)
    return out[:n]


@pytest.mark.parametrize("scored", [True, False])
def test_policies_do_not_look_ahead(spark, scored):
    rnd = random.Random(7)
    rows = [(1, s, i, v, rnd.random(), rnd.random()) for s in (1, 2) for i, v in enumerate(_vad(rnd, 600))]
    track = spark.createDataFrame(rows, "conv_id long, speaker int, i long, vad double, eot double, int double").cache()
    p = Policy() if scored else Policy(**RULES)

    def job(kind):
        def run(f):
            on = f.where("vad > 0.5").select("conv_id", "speaker", (F.col("i") * 80).alias("start_ms"), ((F.col("i") + 1) * 80).alias("end_ms"))
            voices = intervals.union_intervals(on, ["conv_id", "speaker"], p.min_gap, inclusive=False)
            until = f.groupBy("conv_id").agg(((F.max("i") + 1) * 80).alias("duration_ms"))
            got = turn_ends(voices, until, p, f if scored else None) if kind == "eot" else floor_taken(voices, p, f if scored else None)
            # The flush at the end of the audio belongs to the end, which a cut moves.
            return got.withColumn("i", F.floor((F.col("t_ms") - 1) / 80)).select("conv_id", "speaker", "i", "t_ms")
        return run

    for kind in ("eot", "int"):
        for cut in (150, 303, 452):
            assert X.prefix_differences(job(kind), track, cut - 1).where(f"t_ms < {cut * 80} - 80").isEmpty(), (kind, cut)


@pytest.mark.parametrize("cut", [40, 77])
def test_other_commits_do_not_look_ahead(spark, cut):
    rnd = random.Random(8)
    rows = [(1, s, i, v, rnd.random()) for s in (1, 2) for i, v in enumerate(_vad(rnd, 120))]
    track = spark.createDataFrame(rows, "conv_id long, speaker int, i long, vad double, p double").cache()
    jobs = {
        "quiet": lambda f: commit.quiet_armed_commit(f, "vad", "p", 0.5, 5),
        "edges": lambda f: commit.rising_edge_commit(f, "p", 0.5, 4),
        "points": lambda f: commit.query_points(f, "p", 0.3, 2),
        "again": lambda f: commit.recommit(f, commit.rising_edge_commit(f, "p", 0.2, 4), "p", 0.2, 2),
    }
    for name, job in jobs.items():
        assert X.prefix_differences(job, track, cut).isEmpty(), name


def test_fine_labels_by_priority(spark):
    segs = [
        (1, 1, 0, 1000, "Regular Turn"), (1, 1, 500, 900, "Floor-taking Cooperative Interruption"), (1, 2, 200, 600, "Reaction Backchannel"),
        (1, 2, 1200, 1600, "Awkward Silence"), (1, 2, 0, 2000, "Made Up"),
    ]
    df = spark.createDataFrame(segs, "conv_id long, speaker int, start_ms long, end_ms long, label string")
    names = ["SILENT", *[n for n, _, _ in vocab.FINE]]
    got = {(r.speaker, r.i): names[r.fine] for r in frames.fine_acts(df, vocab.fine_index(F.col("label")), 100).collect()}
    assert [got[1, 2], got[1, 7], got[2, 3], got[2, 13], got[2, 18]] == ["Normal Turn", "Floor-taking Cooperative Interruption", "Reaction Backchannel", "Awkward Silence", "SILENT"]
    assert len(vocab.FINE) == 17 and [n for n, _, g in vocab.FINE if g is None] == ["Awkward Silence"]


def test_geometry_of_overlaps(spark):
    segs = {
        "none": [(1, 0, 1000), (2, 1200, 2000)], "overlap": [(1, 0, 2000), (2, 1500, 4000)], "took": [(1, 0, 3000), (2, 1500, 4000)],
        "short": [(1, 0, 5000), (2, 2000, 2500)], "failed": [(1, 0, 5000), (2, 2000, 3500)],
        # The other pauses and resumes within 0.7 s before this run ends, so it has not yielded.
        "failed/resumed": [(1, 0, 3000), (1, 3600, 6000), (2, 1500, 4500)],
    }
    rows = [(k, s, a, b) for k, name in enumerate(segs) for s, a, b in segs[name]]
    df = spark.createDataFrame(rows, "conv_id long, speaker int, start_ms long, end_ms long")
    got = {(r.conv_id, r.start_ms): r.geometry for r in intervals.overlap_geometry(df).where("speaker = 2").collect()}
    assert [got[k, segs[name][-1][1]] for k, name in enumerate(segs)] == [n.split("/")[0] for n in segs]


def test_turn_end_targets(spark):
    vad = {1: [1.0] * 4 + [0.0] * 8 + [1.0] * 3 + [0.0] * 25, 2: [0.0] * 40}
    track = spark.createDataFrame([(1, s, i, v) for s in (1, 2) for i, v in enumerate(vad[s])], "conv_id long, speaker int, i long, vad double")
    gold = [(1, "pos", 1, 800, 800), (1, "neg", 1, 2560, 3200), (1, "excl", 1, 1100, 1300)]
    gold = spark.createDataFrame(gold, "conv_id long, kind string, speaker int, start_ms long, end_ms long")
    got = {(r.speaker, (r.i + 1) * 160): (r.y, r.w) for r in frames.eot_targets(track, gold, "vad", 160).collect()}
    assert all(y == 0 for (s, t), (y, _) in got.items() if t < 800 or t >= 2080)
    assert got[1, 800][0] == 1 and all(w == 0 for (s, t), (_, w) in got.items() if s == 2 or 1100 <= t <= 1300)
    assert sum(w for (s, t), (_, w) in got.items() if s == 1 and 2560 <= t <= 3200) == pytest.approx(1)


def test_candidates_of_a_turn(spark):
    long = " ".join(f"w{k}, x" for k in range(30))
    rows = [(1, 1, 0, 1000, "well, I [noise] think so, yes"), (1, 1, 1500, 2000, "and then"), (1, 2, 2500, 9000, long)]
    df = spark.createDataFrame(rows, "conv_id long, speaker int, start_ms long, end_ms long, text string")
    got = candidates.turn_candidates(df).orderBy("run", "n_words").collect()
    first = [(r.n_words, r.kind) for r in got if r.run == 0]
    assert first == [(4, "mid"), (5, "pause"), (7, "end")]
    second = [r for r in got if r.run == 1]
    assert len(second) == 12 and second[-1].kind == "end" and second[-1].t_ms == 9000 and second[0].n_words == 3
