"""Golden rows and properties of the conversation operators."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions import vocab
from turnloom.operators import anatomy, commit, corpus, frames, intervals, onsets, scoring, scripts, selection, windows
from turnloom.sources import io
from turnloom.streaming import commits as X

GOLDEN = [
    (1, 0, 2000, "Turn"), (1, 2600, 4000, "Turn"), (2, 4300, 6000, "Turn"), (1, 5500, 7000, "Interruption"), (2, 6200, 6500, "Backchannel"), (2, 7200, 10000, "Turn"),
    (1, 10400, 12000, "Turn"),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(1, *r) for r in GOLDEN], "conv_id long, speaker int, start_ms long, end_ms long, canonical string").cache()


def track(spark, values, speaker=1):
    return spark.createDataFrame([(1, speaker, i, float(v)) for i, v in enumerate(values)], "conv_id long, speaker int, i long, p double")


def test_gold_of_hand_made_segments(golden):
    got = {(r.task, r.kind, r.speaker, r.start_ms) for r in scoring.gold_events(golden).collect()}
    assert {("eot", "pos", 1, 4000), ("eot", "pos", 2, 6000), ("eot", "pos", 1, 7000), ("eot", "pos", 2, 10000)} <= got
    assert ("eot", "neg", 1, 2000) in got and ("int", "pos", 1, 5500) in got and ("int", "neg", 2, 6200) in got


def test_oracle_predictions_score_perfectly(golden):
    gold = scoring.gold_events(golden)
    preds = gold.where("kind = 'pos'").select("conv_id", "task", "speaker", F.col("start_ms").alias("t_ms"))
    for r in scoring.summarize(scoring.score_events(gold, preds), ["task"]).collect():
        assert (r.recall, r.fn, r.fp) == (1.0, 0, 0)


def test_extra_fires_in_a_window_cost_nothing_and_pauses_count(golden):
    gold = scoring.gold_events(golden)
    preds = [(1, "eot", 1, t) for t in (2300, 4100, 4200)]
    preds = golden.sparkSession.createDataFrame(preds, "conv_id long, task string, speaker int, t_ms long")
    r = scoring.summarize(scoring.score_events(gold.where("task = 'eot'"), preds), ["task"]).first()
    assert (r.tp, r.fp) == (1, 1)


def test_refractory_suppresses_and_does_not_reset(spark):
    t = track(spark, [0, 1, 0, 1, 0, 0, 1, 0])
    assert sorted(r.i for r in commit.rising_edge_commit(t, "p", 0.5, 4).collect()) == [1, 6]
    again = commit.recommit(track(spark, [0, 1, 1, 1, 0]), commit.rising_edge_commit(track(spark, [0, 1, 1, 1, 0]), "p", 0.5, 4), "p", 0.5, 2)
    assert sorted(r.i for r in again.collect()) == [1, 3]


def test_commit_is_causal(spark):
    random.seed(0)
    t = track(spark, [random.random() for _ in range(300)])
    job = lambda x: commit.rising_edge_commit(x, "p", 0.7, 5)
    assert X.prefix_differences(job, t, 150).isEmpty()


def test_intervals_touching_and_exclusive(spark):
    s = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 25, 30), (1, 40, 40)], "k long, start_ms long, end_ms long")
    got = lambda **o: sorted((r.start_ms, r.end_ms) for r in intervals.union_intervals(s, ["k"], **o).collect())
    assert got() == [(0, 20), (25, 30)]
    assert got(gap_ms=5) == [(0, 30)]
    assert got(gap_ms=5, inclusive=False) == [(0, 20), (25, 30)]


def test_range_join_equals_all_pairs(spark):
    random.seed(1)
    rows = [(random.randrange(2), a := random.randrange(200_000), a + random.randrange(60_000)) for _ in range(60)]
    a = spark.createDataFrame(rows[:30], "k long, start_ms long, end_ms long")
    b = spark.createDataFrame(rows[30:], "k long, start_ms long, end_ms long")
    want = sorted((x, y) for x in rows[:30] for y in rows[30:] if x[0] == y[0] and x[1] <= y[2] + 100 and y[1] - 100 <= x[2])
    got = intervals.range_join(a, b, ["k"], pad_ms=100).collect()
    assert sorted(((r.k, r.start_ms, r.end_ms), (r.b_k, r.b_start_ms, r.b_end_ms)) for r in got) == want


def test_floor_hand_over(spark, golden):
    claims = golden.where("canonical IN ('Turn', 'Interruption')")
    anchors = scoring.gold_events(golden).where("task = 'eot' AND kind = 'pos'").select("conv_id", "speaker", F.col("start_ms").alias("t_ms"))
    floor = {r.i: r.floor for r in frames.floor_hard(claims, anchors, 100).collect()}
    assert floor[5] == "HELD_0" and floor[22] == "HELD_0" and floor[41] == "OPEN" and floor[57] == "CONTESTED" and floor[65] == "HELD_0" and floor[80] == "HELD_1"
    soft = {r.i: (r.held_0, r.held_1) for r in frames.floor_soft(frames.floor_hard(claims, anchors, 100)).collect()}
    assert all(abs(sum(soft[i]) - 1) < 1e-9 for i in (55, 57, 59)) and soft[55][1] > soft[59][1]


def test_speech_runs_keep_an_exact_gap(spark):
    t = track(spark, [1, 1, 0, 0, 1, 0, 1])
    assert sorted((r.from_i, r.to_i) for r in windows.speech_segments(t, "p", 0.5, 2).collect()) == [(0, 2), (4, 7)]
    assert sorted((r.from_i, r.to_i) for r in windows.speech_segments(t, "p", 0.5, 3).collect()) == [(0, 7)]


def test_components_against_search(spark):
    random.seed(2)
    rows = [(c, f"a{random.randrange(30)}", f"b{random.randrange(30)}") for c in range(25)]
    meta = spark.createDataFrame([*rows, (99, "x", None)], "conv_id long, actor_1 string, actor_2 string")
    root = {c: c for c in [r[0] for r in rows] + [99]}
    for _ in rows:
        for c, a, b in rows:
            for d, e, f in rows:
                if {a, b} & {e, f}:
                    root[c] = root[d] = min(root[c], root[d])
    assert {r.conv_id: r.component for r in corpus.actor_components(meta).collect()} == root


def test_clips_keep_caps_and_grow(spark):
    rows = [(f"f{k % 7}", f"e{k % 21}", k, float(20 + k % 50)) for k in range(300)]
    m = spark.createDataFrame(rows, "feed string, episode string, clip long, seconds double")
    def picked(seconds):
        return corpus.select_clips(m, seconds, 400.0, 150.0, "s", 25.0, 60.0).collect()
    small, large = picked(500.0), picked(1500.0)
    assert {r.clip for r in small} <= {r.clip for r in large} and sum(r.seconds for r in small) >= 500
    for key, cap in (("feed", 400), ("episode", 150)):
        held = {}
        for r in large:
            held[r[key]] = held.get(r[key], 0) + r.seconds
        assert max(held.values()) <= cap


def test_edit_distance(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]
    random.seed(3)
    rows = [([random.choice("abc") for _ in range(random.randrange(6))], [random.choice("abc") for _ in range(random.randrange(6))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r.d for r in df.select(T.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [plain(a, b) for a, b in rows]


def test_labels_alias_and_unknown(spark):
    df = spark.createDataFrame([("Regular Turn",), ("Overlap",), ("?",)], "l string")
    got = df.select(vocab.canonical(F.col("l")).alias("c"), vocab.fine_index(F.col("l")).alias("i")).collect()
    assert [tuple(r) for r in got] == [("Turn", 5), ("Turn", 8), (None, 0)]


def test_stream_policy_equals_batch(spark, tmp_path):
    from turnloom.operators.policy import Policy, floor_taken, turn_ends
    from turnloom.streaming.policy import turn_policy

    rnd = random.Random(12)
    rows = []
    for conv in range(3):
        on = {1: False, 2: True}
        for i in range(400):
            for s in (1, 2):
                on[s] = not on[s] if rnd.random() < 0.12 else on[s]
                rows.append((conv, s, i, float(on[s]), rnd.random(), rnd.random(), i == 399))
    t = spark.createDataFrame(rows, "conv_id long, speaker int, i long, vad double, eot double, int double, last boolean").withColumn("ts", F.timestamp_millis(F.col("i") * 80))
    for k in range(4):  # files split conversations, and channels of a frame
        t.where(f"(i * 2 + speaker) div 201 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    p = Policy(eot_th=0.93, int_th=0.9, confirm=1800)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = X.drained(turn_policy(stream, p, "vad", "eot", "int"), "policy", str(tmp_path / "cp"), str(tmp_path / "out")).collect()
    heard = t.where("vad > 0.5").select("conv_id", "speaker", (F.col("i") * 80).alias("start_ms"), ((F.col("i") + 1) * 80).alias("end_ms"))
    voices = intervals.union_intervals(heard, ["conv_id", "speaker"], p.min_gap, inclusive=False)
    until = t.groupBy("conv_id").agg(((F.max("i") + 1) * 80).alias("duration_ms"))
    want = {(r.conv_id, r.speaker, "eot", r.t_ms) for r in turn_ends(voices, until, p, t).collect()} | {(r.conv_id, r.speaker, "int", r.t_ms) for r in floor_taken(voices, p, t).collect()}
    assert {tuple(r) for r in out} == want and len(want) > 100


def test_bad_cues_are_rejects(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\n[Normal Turn] hello there\n\n2\n00:00:03,000 --> 00:00:04,000\nno label\n")
    good, bad = io.read_srt(spark, str(tmp_path))
    assert [(r.start_ms, r.end_ms, r.label, r.text) for r in good.collect()] == [(1000, 2500, "Normal Turn", "hello there")] and bad.count() == 1


def test_stream_commits_equal_batch(spark, tmp_path):
    random.seed(4)
    t = track(spark, [random.random() for _ in range(200)]).withColumn("ts", F.timestamp_millis(F.col("i") * 80))
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    out = X.drained(X.rising_edge_commit(stream, "p", 0.7, 5), "t1", str(tmp_path / "cp"), str(tmp_path / "out"))
    assert sorted(r.i for r in out.collect()) == sorted(r.i for r in commit.rising_edge_commit(t, "p", 0.7, 5).collect())


def test_greedy_match_takes_nearest_free(spark):
    p = spark.createDataFrame([(1, 100), (1, 120), (1, 900)], "k long, t_ms long")
    g = spark.createDataFrame([(1, 110), (1, 150)], "k long, g_ms long")
    assert sorted((r.t_ms, r.g_ms) for r in scoring.greedy_match(p, g, ["k"], 60).collect()) == [(100, 110), (120, 150)]


def test_auc_of_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 1.0), ("b", 1, 2.0)], "g string, y int, s double")
    assert {r.g: r.auc for r in scoring.auc(df, "y", "s", ("g",)).collect()} == {"a": 0.5, "b": None}


def _pause_brute(spans, thetas, delays, timeouts):
    """The pause sweep span by span, for both rules."""
    out = {}
    for rule in ("first", "harness"):
        for k in range(thetas + 1):
            for d in delays:
                for to in timeouts:
                    cut, late, holds, ends = 0, 0, 0, 0
                    for label, rows in spans:
                        lasts = rows[-1][0]
                        if label == "hold" and not 200 <= lasts <= 5000:
                            continue
                        if rule == "first":
                            at = next((t for t, p in rows if t >= d and p > k / thetas - 1e-9), None)
                        else:
                            at = next((max(d, t) for t, p in rows if p > k / thetas + 1e-9), None)
                        if label == "hold":
                            holds += 1
                            cut += lasts > to or (at is not None and lasts > at)
                        else:
                            ends += 1
                            late += at if at is not None and at <= to else to
                    if to >= d:
                        out[rule, k, d, to] = (cut / holds if holds else None, late / ends if ends else None)
    return out


def test_pause_sweep_against_brute_force(spark):
    rnd = random.Random(4)
    spans = []
    for _ in range(40):
        n = rnd.randrange(1, 60)
        spans.append((rnd.choice(["hold", "eot"]), [(100 * (j + 1), rnd.randrange(0, 120) / 100) for j in range(n)]))
    df = spark.createDataFrame([(f"s{i}", t, p, label) for i, (label, rows) in enumerate(spans) for t, p in rows], "span string, silence_ms int, p double, label string")
    got = {(r.rule, r.k, r.delay, r.timeout): (r.cutoff, r.latency_ms) for r in anatomy.pause_sweep(df, 10, [200, 500], [300, 1000, 3500]).collect()}
    want = _pause_brute(spans, 10, [200, 500], [300, 1000, 3500])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_contexts_reach_back_as_far_as_they_need(spark):
    words = spark.createDataFrame([(1, 1000 * k, f"w{k}") for k in range(5)] + [(1, 400_000, "late")], "conv_id long, end_ms long, word string")
    points = spark.createDataFrame([(1, 0), (1, 2500), (1, 399_000), (1, 500_000)], "conv_id long, t_ms long")
    got = {r.t_ms: r.context for r in anatomy.text_context(words, points, "conv_id", 300, 3).collect()}
    assert got == {0: None, 2500: "w0 w1 w2", 399_000: "w2 w3 w4", 500_000: "w3 w4 late"}
    said = spark.createDataFrame([(1, 2, 0, 500, "a"), (1, 2, 0, 900, "b"), (1, 2, 2000, 2500, "c"), (1, 1, 100, 600, "own")], "conv_id long, speaker int, turn_start_ms long, end_ms long, word string")
    points = spark.createDataFrame([(1, 1, 700), (1, 1, 1500), (1, 1, 2200), (1, 2, 50)], "conv_id long, speaker int, t_ms long")
    got = {(r.speaker, r.t_ms): r.context for r in anatomy.other_turn_context(said, points, 2).collect()}
    assert got == {(1, 700): "a", (1, 1500): "a b", (1, 2200): None, (2, 50): None}


def test_long_chain_of_shared_actors(spark):
    meta = spark.createDataFrame([(k, f"a{k}", f"a{k + 1}") for k in range(200)], "conv_id long, actor_1 string, actor_2 string")
    assert {r.component for r in corpus.actor_components(meta).collect()} == {0}


def test_dialogue_codes(spark):
    def item(script, pos, speaker, kind, text, host=None, after=None, takes=None, language="en"):
        return (script, pos, pos, speaker, kind, text, host, after, takes, language)
    w = lambda n: " ".join(f"w{k}" for k in range(n))
    items = [item(1, k, "AB"[k % 2], "turn", f"t{k} {w(6)} <pause 0.4>") for k in range(20)]
    items += [item(2, 0, "A", "turn", w(10)), item(2, 1, "B", "interruption", "no wait", 0, 2, True), item(2, 2, "A", "backchannel", w(5)), item(2, 3, "A", "turn", "As an AI (laughs) I")]
    items += [item(3, k, "A", "turn", "長長長長長長") for k in range(6)]
    df = spark.createDataFrame(items, "script_id long, pos long, id long, speaker string, kind string, text string, host long, after_word long, takes_floor boolean, language string")
    df = df.withColumn("language", F.when(F.col("script_id") == 3, "ja").otherwise(F.col("language")))
    got = {r.script_id: r.reasons for r in corpus.dialogue_filter(df).collect()}
    assert got == {
        2: "long_backchannel,no_pauses,participation,role_break,stage_direction,too_short,weak_interruption",
        3: "monologue_run,no_pauses,participation,too_short,unsegmented,verbatim_repeat",
    }


def test_quantiles_by_ranges_equal_exact_ones(spark):
    rnd = random.Random(1)
    values = [rnd.random() for _ in range(700)] + [0.5] * 50 + [0.0] * 20 + [1.0]
    got = {r.theta for r in scoring.theta_grid(spark.createDataFrame([(v,) for v in values], "p double"), "p", 33).collect()}
    kept = sorted(v for v in values if v > 0)
    at = [k / 32 * (len(kept) - 1) for k in range(33)]
    want = {kept[int(a)] + (a - int(a)) * (kept[min(int(a) + 1, len(kept) - 1)] - kept[int(a)]) for a in at} | {k / 100 for k in range(1, 100)}
    assert all(min(abs(g - w) for w in want) < 1e-12 for g in got) and all(min(abs(g - w) for g in got) < 1e-12 for w in want)


def test_advancement_screen(spark):
    rows = lambda **kw: spark.createDataFrame([("eot", kw["recall"], kw["fp_rate"])], "task string, recall double, fp_rate double")
    paired = spark.createDataFrame([("eot", 20.0)], "task string, gain_ms double")
    assert scoring.advancement(rows(recall=0.9, fp_rate=0.2), rows(recall=0.896, fp_rate=0.1), paired).first().passed
    assert not scoring.advancement(rows(recall=0.9, fp_rate=0.2), rows(recall=0.89, fp_rate=0.1), paired).first().recall_ok


def test_onset_context_counts_known_frames_only(spark):
    segs = spark.createDataFrame([(1, 1, 0, 800), (1, 2, 600, 2000), (1, 1, 2400, 3000)], "conv_id long, speaker int, start_ms long, end_ms long")
    rows = []
    for speaker, own in ((1, lambda i: i < 8 or i >= 24), (2, lambda i: 6 <= i < 20)):
        rows += [(1, speaker, i, own(i)) for i in range(30)]
    frames_ = spark.createDataFrame(rows, "conv_id long, speaker int, i long, own boolean")
    other = frames_.selectExpr("conv_id", "3 - speaker AS speaker", "i", "own AS other")
    got = {(r.speaker, r.start_ms): r for r in onsets.onset_context(segs, frames_.join(other, ["conv_id", "speaker", "i"]), 100, [200]).collect()}
    second = got[2, 600]
    assert (second.own_share, second.other_share, second.other_run_ms, second.silence_ms, second.other_now) == (1.0, 1.0, 600, 5000, True)
    third = got[1, 2400]
    assert (third.own_share, third.other_share, third.silence_ms, third.other_run_ms, third.other_now) == (1.0, 0.0, 1600, 0, False)
    assert third.other_recent == pytest.approx(14 / 20)
    assert got[1, 0].other_recent == 0.0


def test_oracle_queries_of_overlapping_segments(spark):
    segs = spark.createDataFrame([(1, 1, 0, 1000, 5), (1, 2, 1200, 1800, 3), (1, 1, 5000, 6000, 0)], "conv_id long, speaker int, start_ms long, end_ms long, n long")
    got = sorted((r.kind, r.speaker, r.words, r.t_ms) for r in onsets.oracle_queries(segs, 300).collect())
    assert got == [("eot", 1, 5, 1300), ("eot", 2, 3, 2100), ("int", 2, 1, 1700), ("int", 2, 2, 1900), ("int", 2, 3, 2100)]


def test_picked_policy_fits_budget_and_cap(spark):
    rows = [("m", "p1", 0.9, 0.2, 300.0), ("m", "p2", 0.8, 0.05, 900.0), ("m", "p3", 0.7, 0.05, 200.0), ("r", "p4", 0.5, 0.9, None)]
    summary = spark.createDataFrame(rows, "family string, policy string, recall double, fp_rate double, p50_ms double")
    got = {(r.family, r.budget, r.cap_ms): r.policy for r in selection.pick_policies(summary, [0.1, 0.5], [500.0, 1e9]).collect()}
    assert got == {("m", 0.1, 500.0): "p3", ("m", 0.1, 1e9): "p2", ("m", 0.5, 500.0): "p1", ("m", 0.5, 1e9): "p1"}


def test_held_out_halves_of_one_good_policy(spark):
    rows = [(p, u, int(p < 9), int(p == 9), 0, 1) for p in (1, 9) for u in range(60)]
    r = selection.split_half(spark.createDataFrame(rows, "policy int, u long, tp long, fn long, fp long, tn long"), "u", 0.1, 20, "s").first()
    assert (r.recall, r.fp_rate, r.fp_p95, r.splits) == (1.0, 0.0, 0.0, 20)


def test_grouped_probe_separates_held_out_groups(spark):
    rnd = random.Random(5)
    rows = [(i, i % 12, y, [y * 3.0 + rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)]) for i in range(240) for y in [rnd.randrange(2)]]
    data = spark.createDataFrame(rows, "id long, part long, y int, x array<double>")
    # All three components: standardised features have equal variance, so fewer components may leave out the one that tells.
    scored = selection.grouped_cv_scores(data, "x", "y", "part", 3, 3, "g").cache()
    assert scored.count() == 240 and scored.select("part", "fold").distinct().count() == 12
    assert scoring.auc(scored, "y", "score").first().auc > 0.95


def test_schema_check_codes(spark):
    items = [
        (1, 0, 0, "A", "turn", "well so I went", None, None, None),
        (1, 1, 1, "B", "backchannel", "mhm", 0, "well so", None),
        (1, 2, 2, "B", "backchannel", "ok", 0, "not there", None),
        (1, 3, 3, "B", "backchannel", "yes", 0, "I went", None),
        (1, 4, 4, "A", "backchannel", "hm", 0, "well", None),
        (1, 5, 5, "B", "turn", "one two", None, None, None),
        (1, 6, 6, "B", "interruption", "wait", 0, "well", True),
        (1, 7, 6, "C", None, " ", None, None, None),
    ]
    df = spark.createDataFrame(items, "script_id long, pos long, id long, speaker string, kind string, text string, host long, after string, takes_floor boolean")
    got = sorted((r.pos, r.code) for r in scripts.schema_check(df).collect())
    assert got == [(2, "after_missing"), (3, "after_range"), (4, "bad_host"), (6, "duplicate_id"), (6, "not_current"), (7, "bad_kind"), (7, "bad_speaker"), (7, "duplicate_id"), (7, "empty_text")]


def test_voice_bank_equals_greedy_packing(spark):
    rnd = random.Random(3)
    rows = [(f"s{s}", "fm"[s % 2], u, rnd.choice([400, 900, 1500, 2500, 4000, 7000, 12000]), rnd.random()) for s in range(12) for u in range(rnd.randrange(1, 60))]
    got = {r.speaker: (r.clip_ms, r.ids) for r in scripts.voice_bank(spark.createDataFrame(rows, "speaker string, gender string, utt_id long, ms long, quality double"), per_gender=99).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        used, ids = 0, []
        for _, _, u, ms, _ in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[3], r[2])):
            if used + ms <= 10_000:
                used, ids = used + ms + 250, [*ids, u]
        if sum(r[3] for r in rows if r[0] == s) >= 6000 and used - 250 >= 6000:
            want[s] = (used - 250, ids)
    assert got == want and want
