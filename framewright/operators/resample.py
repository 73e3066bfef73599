"""Resizing by tables of weights: Lanczos for sprites and cell cutouts, area means for comparisons.

A pixel table is resized along its lines, then along its columns; each pass joins the pixels with a weight table of the two
sizes (at most seven rows a place of the longer side, so it is broadcast) and sums by the target place. Frames are
partitioned once; both sums reuse that. Frames of one call have one size; the rows are complete grids.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators.cutout import reaching
from framewright.operators.raster import FRAME
from framewright.operators.regions import added, by_frame, flag, narrow

#: How far the Lanczos kernel reaches, in target places; weights are integers of so many binary digits.
REACH, DIGITS = 3, 22
#: Pixels of a shrunk sprite with at most this opacity are emptied: ripples outside its edges.
FAINT = 12


def lanczos_taps(size: int, to: int) -> list[tuple[int, int, int]]:
    """(target, source, weight) of a line of ``size`` places resized to ``to``; a target's weights add up to about 2 ** DIGITS."""
    step = size / to
    wide = max(step, 1.0)
    found = []
    for t in range(to):
        middle = (t + 0.5) * step
        places = range(max(0, int(middle - REACH * wide + 0.5)), min(size, int(middle + REACH * wide + 0.5)))
        offsets = [math.pi * (s + 0.5 - middle) / wide for s in places]
        raw = [1.0 if v == 0 else math.sin(v) * math.sin(v / REACH) * REACH / (v * v) if abs(v) < REACH * math.pi else 0.0 for v in offsets]
        found += [(t, s, math.floor(abs(w / sum(raw)) * 2**DIGITS + 0.5) * (1 if w > 0 else -1)) for s, w in zip(places, raw)]
    return found


def area_taps(size: int, to: int) -> list[tuple[int, int, float]]:
    """(target, source, share) of a line shrunk from ``size`` to ``to`` places: the part of the target that the source covers."""
    if to > size:
        raise ValueError("area means only shrink")
    covered = lambda t, s: (min((t + 1) * size, (s + 1) * to) - max(t * size, s * to)) / size
    return [(t, s, covered(t, s)) for t in range(to) for s in range(t * size // to, -(-(t + 1) * size // to))]


def _resized(rows: DataFrame, names: str | list[str], size: tuple[int, int], to: tuple[int, int], exact: bool) -> DataFrame:
    """(label, frame, y, x, *names): lines first, then columns; ``exact`` by Lanczos to bytes after each pass, else by area means."""
    session = rows.sparkSession
    parts = getattr(rows, "_framed", None) or -1  # as many as the pixels were dealt over, so that Spark drops this where it can
    rows = rows.select(*FRAME, "y", "x", *names)
    rows = rows.repartition(parts, *FRAME) if parts > 0 else rows.repartition(*FRAME)
    for axis, other, k in (("x", "y", 1), ("y", "x", 0)):
        taps, kind = (lanczos_taps, "long") if exact else (area_taps, "double")
        table = F.broadcast(session.createDataFrame(taps(size[k], to[k]), f"target int, {axis} int, weight {kind}"))
        total = lambda c: F.sum(F.col(c) * F.col("weight"))
        byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(v + 2 ** (DIGITS - 1), DIGITS))).cast("int")
        sums = rows.join(table, axis).groupBy(*FRAME, other, "target").agg(*[(byte(total(c)) if exact else total(c)).alias(c) for c in names])
        rows = sums.withColumnRenamed("target", axis)
    return rows.select(*FRAME, "y", "x", *names)


def scaled(size: tuple[int, int], scale: float) -> tuple[int, int]:
    """(height, width) at a scale, halves to the even number, one pixel at least."""
    return max(1, round(size[0] * scale)), max(1, round(size[1] * scale))


def shrunk_sprites(rows: DataFrame, height: int, width: int, scale: float, faint: int = FAINT) -> DataFrame:
    """(label, frame, y, x, r, g, b, a) of sprites at ``scale``, sharp; pixels of opacity ``faint`` or less are empty.

    Colours are weighted by opacity before they are resized, and divided by it after. An empty table gives an empty one.
    """
    solid = added(rows, {c: F.floor((2 * F.col(c) * F.col("a") + 255) / 510).cast("int") for c in "rgb"})
    small = _resized(solid, list("rgba"), (height, width), scaled((height, width), scale), True)
    shown = F.col("a") > faint
    back = {c: F.when(shown, F.least(F.lit(255), F.floor(255 * F.col(c) / F.col("a")).cast("int"))).otherwise(0) for c in "rgb"}
    return small.withColumns(back | {"a": F.when(shown, F.col("a")).otherwise(0)})


def small_frames(rows: DataFrame, height: int, width: int, to_width: int = 32) -> DataFrame:
    """(label, frame, y, x, r, g, b): frames for comparisons, colours (0 to 1) weighted by opacity, ``to_width`` wide at most."""
    to_width = min(width, to_width)
    seen = added(rows, {c: F.col(c) * F.col("a") / 65025.0 for c in "rgb"})
    return _resized(seen, list("rgb"), (height, width), (max(1, round(height * to_width / width)), to_width), False)


def cell_cutouts(rows: DataFrame, height: int, width: int, scale: float) -> DataFrame:
    """(label, frame, y, x, r, g, b, a) of a sheet's cells (r, g, b, mask) at ``scale``: the mask two pixels wider, its edge soft."""
    weights = reaching(1.0, height, width)
    cells = narrow(rows, lambda r: r.select(*FRAME, "y", "x", "r", "g", "b", "mask"))
    soft = by_frame(cells, {"mask": flag("mask")}, lambda frames, mask: {"soft": frames.blurred(frames.grow(mask, 2), weights, height, width)}, {"soft": "double"})
    opaque = added(soft, {"a": F.floor(F.round(255 * F.col("soft"), 6) + 0.5).cast("int")})
    return _resized(opaque, list("rgba"), (height, width), scaled((height, width), scale), True)


def frame_steps(rows: DataFrame, height: int, width: int, to_width: int = 32) -> DataFrame:
    """(label, frame, next, step): the mean difference of each frame from the next one of its label, and of the last from the first.

    Frames are compared small. A label with one frame has no row; numbers of frames needn't be without gaps.
    """
    small, parts = small_frames(rows, height, width, to_width), getattr(rows, "_framed", None) or -1
    order = small.select(*FRAME).distinct()
    ends = order.groupBy("label").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).filter("first < last")
    after = F.lead("frame").over(W.partitionBy("label").orderBy("frame"))
    pairs = order.join(ends, "label").withColumn("next", F.coalesce(after, "first")).select(*FRAME, "next")
    other = small.select("label", F.col("frame").alias("next"), "y", "x", *[F.col(c).alias(f"n_{c}") for c in "rgb"])
    if parts > 0:  # as many tasks as the pixels were dealt over: the join's other side follows
        other = other.repartition(parts, "label", "next", "y", "x")
    gap = sum((F.abs(F.col(f"n_{c}") - F.col(c)) for c in "rgb"), F.lit(0.0)) / 3
    return small.join(pairs.hint("merge"), [*FRAME]).join(other.hint("merge"), ["label", "next", "y", "x"]).groupBy(*FRAME, "next").agg(F.avg(gap).alias("step"))
