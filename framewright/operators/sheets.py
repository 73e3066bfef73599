"""From analysed directions to a sheet: common crop, game information, retiming, and the whole assembly.

``reports`` has a row per direction that was made: (key, dir, fps, picks array<int>, peak, period, stance, step).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators import directions, sequence

FPS = 24
#: Angle of each direction on the screen, and which side view tells the walking speed first.
ANGLES = {"E": 0, "SE": 45, "S": 90, "SW": 135, "W": 180, "NW": 225, "N": 270, "NE": 315}
SIDES = ["E", "W", "SE", "NE", "SW", "NW"]


def one_decimal(value: Column) -> Column:
    """Rounded to one decimal, ties to even, without a negative zero."""
    return F.bround(F.round(value, 6), 1) + F.lit(0.0)


def velocity(speed: Column, direction: Column, ground: Column) -> Column:
    """struct<x, y>: pixels a second on the screen; y points down and is shortened by the view from above."""
    angle = F.radians(F.element_at(F.create_map(*[F.lit(x) for pair in ANGLES.items() for x in pair]), direction).cast("double"))
    return F.struct(one_decimal(speed * F.cos(angle)).alias("x"), one_decimal(speed * F.sin(angle) * ground).alias("y"))


def common_crop(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, x0, y0, x1, y1, pivot_x, pivot_y): one crop for all boxes (key, x0, y0, x1, y1), with sizes (key, width, height, feet).

    It is symmetric around the middle, so that flipping keeps the pivot, and holds all boxes and the feet's line with 3 % padding.
    """
    all_ = boxes.groupBy("key").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")]).join(sizes, "key")
    pad, middle = F.bround(0.03 * F.col("height")), F.col("width") / 2
    half = F.greatest(middle - F.col("x0"), F.col("x1") - middle) + pad
    whole = lambda v: v.cast("int")
    out = all_.select(
        "key", middle.alias("middle"), "feet", whole(F.greatest(F.lit(0.0), F.bround(middle - half))).alias("x0"), whole(F.greatest(F.lit(0.0), F.floor("y0") - pad)).alias("y0"),
        whole(F.least(F.col("width").cast("double"), F.bround(middle + half))).alias("x1"), whole(F.least(F.col("height").cast("double"), F.floor(F.greatest("y1", "feet")) + pad)).alias("y1"),
    )
    return out.select("key", "x0", "y0", "x1", "y1", (F.col("middle") - F.col("x0")).alias("pivot_x"), (F.col("feet") - F.col("y0")).alias("pivot_y"))


def hit_frames(shown: DataFrame) -> DataFrame:
    """(key, hit_frame, hits) of (key, ord, dir, picks, peak) of one-shot motions: the slot nearest to each direction's peak.

    The motion's hit is S's, else the commonest (the least of equally common ones).
    """
    nearest = F.array_min(F.transform("picks", lambda p, i: F.struct(F.abs(p - F.col("peak")).alias("gap"), i.alias("slot"))))["slot"]
    hits = shown.filter("peak is not null and size(picks) > 0").select("key", "ord", "dir", nearest.alias("hit"))
    counts = hits.groupBy("key", "hit").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg((-F.max(F.struct("n", -F.col("hit")))["col2"]).alias("mode"))
    listed = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "dir", "hit"))).alias("hits"), F.max(F.when(F.col("dir") == "S", F.col("hit"))).alias("front"))
    return listed.join(counts, "key").select("key", F.coalesce("front", "mode").alias("hit_frame"), F.transform("hits", lambda h: F.struct(h["dir"], h["hit"])).alias("hits"))


def move_speeds(reports: DataFrame, scales: DataFrame) -> DataFrame:
    """(key, side, move_speed_auto, move_speed) of walking loops, with scales (key, scale, move_scale).

    The first side view with a stance speed or a step length counts. The stance speed (turned into the walking direction)
    holds unless it is under half or over twice what the step length says.
    """
    rank = F.array_position(F.array(*map(F.lit, SIDES)), F.col("dir"))
    usable = reports.filter((rank > 0) & ((F.coalesce("stance", F.lit(0.0)) != 0) | (F.coalesce("step", F.lit(0.0)) != 0)))
    first = usable.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "dir", "stance", "step", "period")).alias("s")).select("key", "s.*").join(scales, "key")
    angle = F.element_at(F.create_map(*[F.lit(x) for pair in ANGLES.items() for x in pair]), F.col("dir")).cast("double")
    old = F.when(F.col("step") != 0, 2 * F.col("step") * F.col("scale") / (F.col("period") / FPS))
    new = F.when(F.col("stance") != 0, F.col("stance") * FPS * F.col("scale") / F.greatest(F.lit(0.5), F.abs(F.cos(F.radians(angle)))))
    speed = F.when(new.isNull(), old).when(old.isNull() | (new / old).between(0.5, 2), new).otherwise(old)
    found = first.withColumn("speed", F.round(speed, 9))
    return found.select("key", F.col("dir").alias("side"), one_decimal(F.col("speed")).alias("move_speed_auto"), one_decimal(F.col("speed") * F.col("move_scale")).alias("move_speed"))


def rescaled(meta: DataFrame, scale: Column) -> DataFrame:
    """(key, move_speed, move_scale, velocity) of (key, move_speed_auto, ground, order array<string>): speeds at another scale."""
    v = F.col("move_speed_auto") * scale
    moves = F.transform("order", lambda d: F.struct(d.alias("dir"), velocity(v, d, F.coalesce("ground", F.lit(0.5))).alias("v")))
    return meta.filter("move_speed_auto is not null").select("key", one_decimal(v).alias("move_speed"), F.bround(scale, 3).alias("move_scale"), moves.alias("velocity"))


def retimed(meta: DataFrame, fps: Column) -> DataFrame:
    """(key, fps, frame_ms, move_speed, move_speed_auto, velocity): sheet metadata played at another rate; speeds and velocities go with it.

    ``velocity`` is array<struct<dir, v: struct<x, y>>>. What a sheet doesn't have stays null.
    """
    k = fps / F.col("fps")
    moves = F.transform("velocity", lambda m: F.struct(m["dir"].alias("dir"), F.struct(one_decimal(m["v"]["x"] * k).alias("x"), one_decimal(m["v"]["y"] * k).alias("y")).alias("v")))
    speed = lambda c: F.when(F.col("move_speed").isNotNull(), one_decimal(F.col(c) * k))
    return meta.select(
        "key", F.bround(fps, 2).alias("fps"), F.when(F.col("frame_ms").isNotNull(), F.bround(F.round(1000 / fps, 6), 1)).alias("frame_ms"), speed("move_speed").alias("move_speed"),
        speed("move_speed_auto").alias("move_speed_auto"), moves.alias("velocity"),
    )


def shared_span(start: Column, period: Column, slots: int) -> Column:
    """The evenly spaced frames of a loop whose span is known."""
    n = F.greatest(F.lit(1), F.least(F.lit(slots), period))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (start + F.bround(i * period / n)).cast("int"))


def assembled(clip: DataFrame, boxes: DataFrame, names: DataFrame, sizes: DataFrame, slots: int = 8, scale: float = 1.0) -> DataFrame:
    """(key, ord, dir, slot, label, frame, flip, x, y, w, h, fps, pivot_x, pivot_y): a loop's sheet, a row per cell.

    ``names`` (key, count, mirror, dir, label) says which clip shows a direction that was made; ``boxes`` (label, frame, x0,
    y0, x1, y1) where the figure is. Each made direction is analysed by itself; all show as many cells as the shortest, cut
    by one crop from the picked frames' boxes. A direction that wasn't made shows its mirror image, flipped. Cells lie by
    direction, then slot; fps is the mean of the directions' rates.
    """
    picks = sequence.loop_picks(clip.join(names.select("label").distinct(), "label", "left_semi"), slots)
    made = names.join(picks, "label")
    dirs = directions.of_motions(names.select("key", "count", "mirror").distinct())
    used = made.join(boxes, (made["label"] == boxes["label"]) & (made["pick"] == boxes["frame"])).select("key", "x0", "y0", "x1", "y1")
    crop = common_crop(used, sizes)
    per_dir = made.groupBy("key", "dir").agg(F.count(F.lit(1)).alias("n"), F.first("fps").alias("fps"))
    rates = per_dir.groupBy("key").agg(F.min("n").alias("n"), F.round(F.avg("fps"), 6).alias("fps"))
    shown = dirs.withColumn("source", F.coalesce("flip_of", "dir"))
    cells = shown.join(made.select("key", F.col("dir").alias("source"), "label", "slot", F.col("pick").alias("frame")), ["key", "source"]).join(rates, "key").join(crop, "key").filter("slot < n")
    w, h = F.bround((F.col("x1") - F.col("x0")) * scale).cast("int"), F.bround((F.col("y1") - F.col("y0")) * scale).cast("int")
    return cells.select(
        "key", "ord", "dir", "slot", "label", "frame", F.col("flip_of").isNotNull().alias("flip"), (F.col("slot") * w).alias("x"), (F.col("ord") * h).alias("y"), w.alias("w"), h.alias("h"), "fps",
        (F.col("pivot_x") * scale).alias("pivot_x"), (F.col("pivot_y") * scale).alias("pivot_y"),
    )
