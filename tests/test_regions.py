import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import cutout, effects, matting, palette, regions
from framewright.sources.images import as_png, packed, read_frames
from framewright.sources.tables import SIDE, pixels
from framewright.streaming.drift import drift_windows, read_events

SF = "/root/testdata/sf0.001"


def flood(mask, eight):
    h, w = mask.shape
    out, n = np.full((h, w), -1), 0
    for y in range(h):
        for x in range(w):
            if mask[y, x] and out[y, x] < 0:
                n, todo = y * regions.LINE + x, [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < h and 0 <= b < w and mask[a, b] and out[a, b] < 0:
                        out[a, b] = n
                        todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if eight or not (i and j)]
    return out


def table(spark, **planes):
    """A pixel table of arrays [frame, y, x]; all frames of label 1."""
    shape = next(iter(planes.values())).shape
    at = np.indices(shape).reshape(3, -1)
    data = {"label": np.ones(at.shape[1], int), "frame": at[0], "y": at[1], "x": at[2]} | {k: v.ravel() for k, v in planes.items()}
    import pandas as pd

    frame = spark.createDataFrame(pd.DataFrame(data))
    return frame.select(*[F.col(c).cast("int") if t == "bigint" else F.col(c) for c, t in frame.dtypes])


def plane(rows, name, shape, fill=-1):
    out = np.full(shape, fill, dtype=object)
    for r in rows.select("frame", "y", "x", name).collect():
        out[r[0], r[1], r[2]] = r[3]
    return out


@pytest.mark.parametrize("eight", [False, True])
def test_parts_against_flood_fill(spark, eight):
    rng = np.random.default_rng(1)
    masks = np.stack([rng.random((23, 17)) < share for share in (0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0) for _ in range(3)])
    got = plane(regions.labelled(table(spark, m=masks), F.col("m"), eight), "part", masks.shape)
    want = np.stack([flood(m, eight) for m in masks])
    assert (np.where(np.equal(got, None), -1, got) == want).all()


def test_parts_in_small_batches_with_missing_pixels_and_values(spark, monkeypatch):
    monkeypatch.setattr(regions, "BATCH_ROWS", 50)
    rng = np.random.default_rng(2)
    value = rng.integers(0, 3, (6, 9, 9))
    rows = table(spark, v=value).filter("v <> 2 or x <> 4")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = plane(regions.labelled(rows, F.col("v") > 0, same=F.col("v")), "part", value.shape)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for f in range(6):
        there = (value[f] != 2) | (np.arange(9)[None, :] != 4)
        for v in (1, 2):
            want = flood((value[f] == v) & there, False)
            mine = (value[f] == v) & there
            assert (got[f][mine] == want[mine]).all()
    assert regions.labelled(rows.limit(0), F.col("v") > 0).count() == 0


def spread(mask, offsets):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        for dy, dx in offsets:
            if 0 <= y + dy < h and 0 <= x + dx < w:
                out[y + dy, x + dx] = True
    return out


def test_masks_grow_shrink_and_open(spark):
    rng = np.random.default_rng(3)
    masks = rng.random((4, 15, 12)) < 0.3
    rows = table(spark, m=masks)
    square = lambda r: [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    disc = lambda r: [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= round(math.sqrt(r * r - dy * dy))]
    thin = lambda m, r: ~spread(~m, square(r))
    for got, want in [
        (regions.grow(rows, "g", F.col("m"), 2), lambda m: spread(m, square(2))), (regions.shrink(rows, "g", ~F.col("m"), 1), lambda m: thin(~m, 1)),
        (regions.opened(rows, "g", ~F.col("m")), lambda m: spread(thin(~m, 1), square(1))), (regions.grow_disc(rows, "g", F.col("m"), 4), lambda m: spread(m, disc(4))),
    ]:
        assert (plane(got, "g", masks.shape) == np.stack([want(m) for m in masks])).all()


def test_reach_is_limited_in_steps(spark):
    path = np.zeros((2, 3, 60), bool)
    path[:, 1] = True
    start = np.zeros_like(path)
    start[0, 1, 0] = start[1, 1, 0] = start[1, 1, 59] = True
    got = plane(regions.reached(table(spark, m=path, s=start), "r", F.col("s"), F.col("m"), 40), "r", path.shape)
    assert got[0].sum() == 41 and got[1].sum() == 60


def test_distances_are_exact(spark):
    rng = np.random.default_rng(4)
    masks = rng.random((5, 14, 19)) < np.array([0.5, 0.8, 0.95, 0.99, 1.0])[:, None, None]
    got = plane(cutout.distances(table(spark, m=masks), "d", F.col("m"), 6), "d", masks.shape)
    for f, m in enumerate(masks):
        holes = np.argwhere(~m)
        for y in range(14):
            for x in range(19):
                want = min((math.hypot(y - a, x - b) for a, b in holes), default=99)
                assert (got[f, y, x] is None) if want > 6 else math.isclose(got[f, y, x], want)


def test_blur_mirrors_at_the_border(spark):
    rng = np.random.default_rng(5)
    values = rng.random((2, 16, 13))
    weights = cutout.gauss(1.5)
    kernel = np.array(weights[:0:-1] + weights)
    assert len(kernel) == 13 and math.isclose(kernel.sum(), 1)
    got = plane(cutout.blurred(table(spark, v=values), {"b": F.col("v")}, 1.5, 16, 13), "b", values.shape).astype(float)
    padded = np.pad(values, ((0, 0), (6, 6), (6, 6)), mode="reflect")
    rows = sum(w * padded[:, :, k : k + 13] for k, w in enumerate(kernel))
    assert np.allclose(got, sum(w * rows[:, k : k + 16] for k, w in enumerate(kernel)))
    with pytest.raises(ValueError):
        cutout.blurred(table(spark, v=values), {"b": F.col("v")}, 2.8, 10, 10)


def sprite(spark, image, alpha):
    planes = {c: image[..., k].astype(int) for k, c in enumerate("rgb")}
    return table(spark, **planes, a=alpha.astype(int))


def test_a_torn_hole_counts_and_a_gap_with_an_outline_does_not(spark):
    image = np.full((2, 20, 20, 3), 200, np.uint8)
    alpha = np.zeros((2, 20, 20), int)
    alpha[:, 2:18, 2:18] = 255
    alpha[:, 8:12, 8:12] = 0
    image[1, 6:14, 6:14] = 60
    rows = sprite(spark, image, alpha)
    assert [(r.frame, r.holes, r.pixels) for r in regions.torn_holes(rows, 20).collect()] == [(0, 1, 16)]
    assert regions.torn_holes(rows, 20, least=17).count() == 0


def test_small_parts_far_away_go_and_slivers_too(spark):
    alpha = np.zeros((1, 40, 40), int)
    alpha[0, 10:30, 10:20], alpha[0, 12:14, 22:24], alpha[0, 5:7, 35:37], alpha[0, 30:38, 30:38], alpha[0, 0, 0] = 255, 255, 255, 255, 255
    rows = sprite(spark, np.full((1, 40, 40, 3), 90), alpha)
    gone = lambda df: {(r.y, r.x) for r in df.filter("gone and a = 0").join(rows.filter("a > 0").select("label", "frame", "y", "x"), ["label", "frame", "y", "x"]).collect()}
    assert gone(regions.without_detached(rows, 40)) == {(5, 35), (5, 36), (6, 35), (6, 36), (0, 0)}
    assert gone(regions.without_slivers(rows)) == {(0, 0)}


def test_direction_sheet_of_boxes(spark):
    image = np.zeros((1, 60, 60, 3), int)
    image[0, 5:15, 25:35], image[0, 45:55, 5:12], image[0, 25:35, 25:35] = 200, 150, 255  # N, SW, and one in the middle
    image[0, 17:19, 26:30] = 200  # a shoe that nearly touches N
    image[0, 2:4, 2:4] = 250  # too small
    rows = sprite(spark, image, np.zeros((1, 60, 60)))
    back = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0)], "label int, frame int, r double, g double, b double")
    cells = regions.sheet_cells(rows, back, 60, least=40)
    assert {r.dir: (r.x0, r.y0, r.x1, r.y1, r.area) for r in cells.collect()} == {"N": (25, 5, 35, 19, 108), "SW": (5, 45, 12, 55, 70)}
    assert [r.dir for r in regions.missing_cells(cells, rows, ["N", "E"]).collect()] == ["E"]


def test_specks_of_a_label_grid(spark):
    q = np.zeros((2, 7, 7), int)
    q[:, 3, 3], q[:, 5, 2:5], q[:, 0, 3], q[:, 1, 1] = 1, 2, 3, 4  # a speck, three cells, one at the frame's edge, one that is kept
    opaque = np.ones((2, 7, 7), bool)
    opaque[1, 3, 4] = False  # now at the figure's edge
    cells = table(spark, q=q, a=opaque).withColumnsRenamed({"y": "by", "x": "bx"})
    want = q.copy()
    want[:, 3, 3], want[:, 5, 2:5] = [0, 1], 0
    back = lambda df: plane(df.withColumnsRenamed({"by": "y", "bx": "x"}), "q", q.shape)
    assert (back(regions.without_specks(cells, {4})) == want).all()
    assert (back(regions.without_specks(cells, {4}, most=2)) == np.where(q == 2, 2, want)).all()


def test_holes_are_filled_and_shadows_go(spark):
    """A body with a hole the key tore, a grey shadow beside it, and a fleck far away."""
    n = 40
    image = np.full((1, n, n, 3), (250, 0, 250))
    key, model = np.zeros((1, n, n)), np.zeros((1, n, n))
    image[0, 5:30, 8:20], key[0, 5:30, 8:20], model[0, 5:30, 8:20] = (60, 120, 200), 1.0, 0.97
    image[0, 12:20, 10:18], key[0, 12:20, 10:18] = (235, 235, 240), 0.0  # torn
    image[0, 28:34, 20:34], key[0, 28:34, 20:34] = (90, 90, 90), 0.9  # shadow
    image[0, 2:4, 35:37], key[0, 2:4, 35:37] = (255, 255, 255), 0.8  # fleck
    rows = table(spark, **{c: image[..., k] for k, c in enumerate("rgb")}, alpha=key, model=model)
    rows = rows.withColumns({"bg_r": F.lit(250.0), "bg_g": F.lit(0.0), "bg_b": F.lit(250.0)})
    every = matting.combined(rows)
    got = plane(every, "alpha", key.shape).astype(float)[0]
    assert (got[12:20, 10:18] == 0.97).all() and (got[30:34, 23:34] == 0).all() and (got[2:4, 35:37] == 0).all()
    counts = every.agg(F.sum("filled"), F.sum("removed")).first()
    assert counts[0] == 64 and counts[1] >= 84
    shadow = plane(matting.combined(rows, "shadow"), "alpha", key.shape).astype(float)[0]
    assert (shadow[30:34, 23:34] == 0).all() and (shadow[2:4, 35:37] == 0.8).all()
    assert plane(matting.combined(rows, "none"), "alpha", key.shape).astype(float)[0][30, 30] == 0.9
    with pytest.raises(ValueError):
        matting.combined(rows, "some")


def test_planted_glow_and_outburst_go_and_the_figure_stays(spark):
    n, frames = 64, 8
    image = np.full((frames, n, n, 3), (250, 6, 248))
    alpha = np.zeros((frames, n, n), int)
    image[:, 20:50, 10:26], alpha[:, 20:50, 10:26] = (150, 90, 60), 255
    image[3, 24:44, 44:60], alpha[3, 24:44, 44:60] = (90, 140, 255), 255  # a blue glow
    image[5, 2:14, 40:62], alpha[5, 2:14, 40:62] = (250, 250, 240), 255  # a white burst
    rows = sprite(spark, image, alpha).withColumn("alpha", F.col("a") / 255.0)
    rows = cutout.with_background(rows, n, n)
    got = {r.frame: (r.removed, r.remaining) for r in effects.removed_counts(effects.without_effects(rows, n)).collect()}
    assert got == {f: ({3: 320, 5: 264}.get(f, 0), 480) for f in range(frames)}


def test_palettes_of_two_labels_in_one_plan(spark):
    colours = [(1, 10.0, 10.0, 10.0, 50), (1, 12.0, 10.0, 10.0, 50), (1, 200.0, 10.0, 10.0, 30), (1, 10.0, 220.0, 10.0, 20), (2, 5.0, 5.0, 5.0, 7)]
    rows = spark.createDataFrame(colours, "label int, u double, v double, w double, many long")
    got = {r.label: [tuple(c) for c in r.centres] for r in palette.palettes(rows, 3).collect()}
    assert got[2] == [(5.0, 5.0, 5.0)] and sorted(got[1]) == [(10.0, 220.0, 10.0), (11.0, 10.0, 10.0), (200.0, 10.0, 10.0)]
    near = palette.nearest(rows.select("label", "u", "v", "w"), palette.palettes(rows, 3)).collect()
    assert max(r.near.d for r in near) == 1.0


def test_edits_are_spliced_where_they_changed_much(spark):
    n = 24
    base = np.full((1, n, n, 3), 100)
    edit = base + 2
    edit[0, 8:16, 8:16] = (220, 40, 40)
    rows = table(spark, **{c: base[..., k] for k, c in enumerate("rgb")}, **{f"e{c}": edit[..., k] for k, c in enumerate("rgb")})
    got = plane(matting.spliced(rows, n, n), "r", (1, n, n)).astype(int)[0]
    assert (got[9:15, 9:15] >= 215).all() and (got[:2] == 100).all() and (got[:, :2] == 100).all()


def test_png_files_read_back(spark, tmp_path):
    frames = packed(pixels(spark, SF).filter("label = 0 and frame < 3"), SIDE, SIDE)
    want = {r.frame: r.data for r in frames.collect()}
    for r in as_png(frames).collect():
        (tmp_path / f"{r.frame:03d}.png").write_bytes(r.bytes)
    got = read_frames(spark, str(tmp_path)).collect()
    assert len(got) == 3
    for r in got:
        bgr = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, 3)
        assert bgr[..., ::-1].tobytes() == bytes(want[r.frame])


def test_stream_equals_batch(spark):
    batch = {tuple(r) for r in drift_windows(spark.read.parquet(f"{SF}/events.parquet")).collect()}
    query = drift_windows(read_events(spark, SF)).writeStream.outputMode("complete").format("memory").queryName("drift").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("drift").collect()} == batch
