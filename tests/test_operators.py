"""Golden values and edge cases that the stored tables don't reach."""

import json
import math
import random

import pytest

from framewright.functions import text
from framewright.operators import directions, documents, export, layout, quality, raster, sequence, signal, store
from pyspark.sql import functions as F


def clip(spark, frames, label=0):
    return spark.createDataFrame([(label, i, [float(x) for x in e], len(frames)) for i, e in enumerate(frames)], "label int, frame int, e array<double>, n int")


def test_period_of_a_walk_and_its_picks(spark):
    frames = [[math.sin(2 * math.pi * t / 16), math.cos(2 * math.pi * t / 16)] for t in range(60)]
    c = clip(spark, frames)
    found = sequence.find_cycle(sequence.lag_curves(c, 8, 40)).first()
    assert found.period == 16 and found.seam < 1e-6
    picks = sequence.loop_picks(c, 8).orderBy("slot").collect()
    assert len(picks) == 8 and all(p.fps == 12.0 for p in picks)
    assert (picks[1].pick - picks[0].pick) % 16 == 2


def test_one_shot_window_peak_and_static_clip(spark):
    frames = [[0.0] if t < 10 or t > 30 else [math.sin(math.pi * (t - 10) / 20)] for t in range(50)]
    w = sequence.active_window(clip(spark, frames)).first()
    assert 17 <= w.peak <= 23 and 8 <= w.first <= 12 and 28 <= w.last <= 32
    picks = [r.pick for r in sequence.oneshot_picks(sequence.active_window(clip(spark, frames)), 6).orderBy("slot").collect()]
    assert w.peak in picks and picks == sorted(set(picks))
    still = sequence.active_window(clip(spark, [[1.0]] * 9)).first()
    assert (still.first, still.last, still.peak) == (0, 8, 0)
    assert sequence.active_window(clip(spark, []).limit(0)).count() == 0


def test_consensus_period(spark):
    def valley(period, centre, depth):
        return depth + abs(period - centre) / 10

    rows = [(d, p, round(min(valley(p, c, 1.0), valley(p, 2 * c, 1.2)), 4)) for d, c in enumerate([17, 24, 24, 26, 20]) for p in range(8, 61)]
    got = {r.label: (r.cycle, r.length) for r in sequence.common_cycle(spark.createDataFrame(rows, "label int, period int, score double")).collect()}
    assert {v[0] for v in got.values()} and len({v[0] for v in got.values()}) == 1
    assert [got[d][1] for d in range(5)] == [17, 24, 24, 26, 20]


def test_stance_slope(spark):
    x, values = 60.0, []
    for t in range(36):
        values.append(x)
        x += -3 if t % 12 < 9 else 9
    sig = spark.createDataFrame([(1, i, v, "a", 36) for i, v in enumerate(values)], "user_id int, frame int, value double, event_type string, n int")
    assert abs(signal.stance_slopes(sig).first().slope - 3.0) < 0.3


def test_frame_grid_slug_and_numbering(spark):
    row = spark.range(1).select(text.frame_grid(F.lit(3)).alias("a"), text.frame_grid(F.lit(5)).alias("b"), text.slug(F.lit("Moon Walk!")).alias("c"), text.slug(F.lit("걷기 1")).alias("d"), text.slug(F.lit(None).cast("string")).alias("e")).first()
    assert tuple(row) == (73, 124, "moon_walk", "motion", "motion")
    keys = ["walk", "walk", "walk2", "walk", "run", "walk2"]
    named = documents.unique_keys(spark.createDataFrame([(1, i, k) for i, k in enumerate(keys)] + [(2, 1, "walk")], "p int, o int, k string"), "p", ["o"], "k")
    assert [(r.p, r.name) for r in named.orderBy("p", "place").collect()] == [(1, n) for n in ("walk", "walk2", "walk22", "walk3", "run", "walk23")] + [(2, "walk")]


def test_documents_that_are_missing_or_empty(spark):
    motions = spark.createDataFrame([("p1", "m1", "walk", "done")], "project string, id string, name string, status string")
    wanted = spark.createDataFrame([("p1", "m2")], "project string, id string")
    with pytest.raises(Exception, match="no motion m2 in p1"):
        documents.found(wanted, motions).collect()
    with pytest.raises(Exception, match="no keyframes"):
        spark.range(1).select(documents.keyframes(F.lit('x {"keys": []} y'))).collect()
    with pytest.raises(Exception, match="no direction set of 5"):
        directions.of_motions(spark.createDataFrame([(1, 5, True)], "key int, count int, mirror boolean")).collect()


def test_gap_fill_at_both_ends(spark):
    sig = spark.createDataFrame([(1, i, v, t, 6) for i, (v, t) in enumerate([(9.0, "m"), (1.0, "k"), (9.0, "m"), (9.0, "m"), (4.0, "k"), (9.0, "m")])], "user_id int, frame int, value double, event_type string, n int")
    got = [r.filled for r in signal.gap_filled(sig, F.col("event_type") == "m").orderBy("frame").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_sources_overrides_and_retime(spark):
    made = spark.createDataFrame([("a", 1), ("a", 2)], "key string, dir int")
    wanted = spark.createDataFrame([("a", 1), ("a", 3), ("a", 4)], "key string, dir int")
    mirror = spark.createDataFrame([(1, 4), (3, 2), (4, 5)], "dir int, mirror int")
    got = {(r.dir, r.source, r.flip) for r in layout.sources(wanted, made, mirror).collect()}
    assert got == {(1, 1, False), (3, 2, True), (4, None, False)}
    picks = spark.createDataFrame([("a", 0, 5, 10), ("a", 1, 6, 10)], "key string, slot int, pick int, n int")
    chosen = spark.createDataFrame([("a", 1, 99)], "key string, slot int, chosen int")
    assert [r.pick for r in layout.overridden(picks, chosen).orderBy("slot").collect()] == [5, 9]
    twice = layout.retimed(spark.createDataFrame([("a", 12.0, 3.0)], "key string, fps double, speed double"), F.lit(2.0)).first()
    assert (twice.fps, twice.frame_ms, twice.speed) == (24.0, 41.7, 6.0)


def test_best_attempt_keeps_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 3, 5), (1, 1, 5), (1, 2, 7)], "k int, attempt int, drift int")
    assert tuple(store.best_attempts(rows, "k").first()) == (1, 1, 5)


def test_border_median_and_majority(spark):
    flat = [(0, 0, y, x, 255, 0, 255) if y in (0, 5) or x in (0, 5) else (0, 0, y, x, 10, 10, 10) for y in range(6) for x in range(6)]
    px = spark.createDataFrame(flat, "label int, frame int, y int, x int, r int, g int, b int")
    row = raster.border_median(px, 6).first()
    assert (row.r, row.g, row.b, row.key) == (255.0, 0.0, 255.0, True)
    spot = [(0, 0, y, x) + ((250,) * 3 if (y, x) == (2, 2) else (5,) * 3) for y in range(5) for x in range(5)]
    px = spark.createDataFrame(spot, "label int, frame int, y int, x int, r int, g int, b int")
    assert {r.q for r in raster.majority(px).collect()} == {0}


def test_motion_keys_of_whole_names(spark):
    rows = [("Walking home left", None, "walking_home_left"), ("Walking home right", "", "walking_home_right"), ("천천히 걷기", None, "walk"), ("춤 걷", None, "walk"),
            ("Jump", "hop_2", "hop_2"), ("걷기", "No Key", "motion"), ("x", "walk\n", "motion"), ("!!", None, "motion"), (None, None, "motion")]
    df = spark.createDataFrame(rows, "name string, fixed string, want string")
    assert [r.key for r in df.select(text.motion_key(F.col("name"), F.col("fixed")).alias("key")).collect()] == [r[2] for r in rows]


def test_keys_take_the_next_free_number_whatever_digits_they_end_in(spark):
    rng = random.Random(4)
    scopes = {s: [rng.choice(["walk", "walk2", "walk22", "run", "run3", "7", "72", "x y"]) for _ in range(rng.randint(1, 25))] for s in range(30)}
    scopes[99] = [f"cell{i}" for i in range(300)]
    scopes[100] = ["idle"] * 300
    rows = [(s, i, k) for s, keys in scopes.items() for i, k in enumerate(keys)]
    got = {(r["s"], r["place"]): r["name"] for r in documents.unique_keys(spark.createDataFrame(rows, "s int, o int, k string"), "s", ["o"], "k").collect()}
    assert len(got) == len(rows)
    for s, keys in scopes.items():
        taken = set()
        for i, key in enumerate(keys):
            name, n = key, 2
            while name in taken:
                name, n = f"{key}{n}", n + 1
            taken.add(name)
            assert got[s, i] == name


def test_archived_motions_never_share_a_folder(spark):
    rows = [("p", 1, 1, "walk", "a.png"), ("p", 2, 2, "walk2", "a.png"), ("p", 3, 3, "walk", "a.png"), ("p", 3, 3, "walk", "b.png"), ("q", 1, 1, "walk", "a.png")]
    got = sorted((r.project, r.path) for r in export.archive_paths(spark.createDataFrame(rows, "project string, motion int, created int, key string, path string")).collect())
    assert got == [("p", "walk/a.png"), ("p", "walk2/a.png"), ("p", "walk3/a.png"), ("p", "walk3/b.png"), ("q", "walk/a.png")]


def test_template_values_that_hold_marks_stay_as_they_are(spark):
    template = '{"a": "{{NAME}}", "b": "is {{NAME}}, {{SIZE}} of {{SIZE}}", "c": {"d": ["{{SIZE}}", "{{OTHER}}", "{{NONE}}"]}}'
    df = spark.createDataFrame([("{{SIZE}} \"{{NAME}}\" $1 \\", 7)], "n string, s int")
    made = json.loads(df.select(documents.filled_json(F.lit(template), {"NAME": F.col("n"), "SIZE": F.col("s"), "NONE": F.lit(None).cast("int")}).alias("j")).first().j)
    name = '{{SIZE}} "{{NAME}}" $1 \\'
    assert made == {"a": name, "b": f"is {name}, 7 of 7", "c": {"d": [7, "{{OTHER}}", None]}}
    plain = df.select(documents.filled_json(F.lit("{}"), {"NAME": F.col("n")}).alias("j"), documents.filled_json(F.lit(None).cast("string"), {"NAME": F.col("n")}).alias("k")).first()
    assert plain.j == "{}" and plain.k is None
