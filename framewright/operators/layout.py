"""Sheet layout: cell rectangles, tags, crops, margins, retiming, overrides, hits, contact sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rects(cells: DataFrame) -> DataFrame:
    """(key, dir, slot, x, y, w, h): a row per direction in order, a column per slot; all cells as large as the largest."""
    of_key = W.partitionBy("key")
    sized = cells.select("key", "dir", "slot", F.max("w").over(of_key).alias("w"), F.max("h").over(of_key).alias("h"))
    row = F.dense_rank().over(of_key.orderBy("dir")) - 1
    return sized.select("key", "dir", "slot", (F.col("slot") * F.col("w")).alias("x"), (row * F.col("h")).alias("y"), "w", "h")


def tags(cells: DataFrame, fps: float = 12.0) -> DataFrame:
    """(key, dir, first, last, duration): running frame numbers of each direction, and milliseconds a frame."""
    order = W.partitionBy("key").orderBy("dir", "slot")
    numbered = cells.select("key", "dir", (F.row_number().over(order) - 1).alias("i"))
    return numbered.groupBy("key", "dir").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.lit(round(1000 / fps)).alias("duration"))


def sheet_meta(rects_: DataFrame) -> DataFrame:
    """(key, frames, width, height): the number of cells and the size of the whole sheet."""
    return rects_.groupBy("key").agg(F.count(F.lit(1)).alias("frames"), F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"))


def sheet_json(rects_: DataFrame) -> DataFrame:
    """(key, json): the cells of each direction, in order, as nested JSON."""
    slots = rects_.groupBy("key", "dir").agg(F.array_sort(F.collect_list(F.struct("slot", "x", "y", "w", "h"))).alias("cells"))
    return slots.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("dir", "cells")))).alias("json"))


def common_crop(cells: DataFrame, pad: float = 0.03) -> DataFrame:
    """(key, half, top, frames): the symmetric half width with padding, the largest height, the least frames of a direction."""
    per_dir = cells.groupBy("key", "dir").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.count(F.lit(1)).alias("m"))
    out = per_dir.groupBy("key").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.min("m").alias("frames"))
    return out.select("key", (F.ceil(F.col("w") / 2) + F.bround(pad * F.col("h"))).cast("long").alias("half"), F.col("h").alias("top"), "frames")


def margins(cells: DataFrame) -> DataFrame:
    """(key, dir, left, top): how far each direction's cell lies inside the cell that all directions share."""
    per_dir = cells.groupBy("key", "dir").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    of_key = W.partitionBy("key")
    return per_dir.select("key", "dir", F.floor((F.max("w").over(of_key) - F.col("w")) / 2).alias("left"), (F.max("h").over(of_key) - F.col("h")).alias("top"))


def contact_sheet(cells: DataFrame, columns: int = 8, most: int = 24) -> DataFrame:
    """(key, slot, column, row): every so many cells, about ``most`` of them, in a grid."""
    order = W.partitionBy("key").orderBy("dir", "slot")
    numbered = cells.select("key", (F.row_number().over(order) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy("key")).alias("m"))
    kept = numbered.filter(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("m") / most)) == 0)
    at = F.row_number().over(W.partitionBy("key").orderBy("i")) - 1
    return kept.select("key", F.col("i").alias("slot"), (at % columns).alias("column"), F.floor(at / columns).alias("row"))


def retimed(motions: DataFrame, factor) -> DataFrame:
    """(key, fps, frame_ms, speed): metadata of (key, fps, speed) at ``factor`` times the rate."""
    fps = F.col("fps") * factor
    return motions.select("key", F.round(fps, 4).alias("fps"), F.round(1000 / fps, 1).alias("frame_ms"), F.round(F.col("speed") * factor, 6).alias("speed"))


def velocities(speeds: DataFrame, elevation: float = 30.0) -> DataFrame:
    """(id, dir, vx, vy): the speed of each id on the ground in eight directions, 1 decimal, no negative zero."""
    angle = F.radians(F.col("dir") * 45.0)
    made = speeds.select("id", "speed", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dir"))
    ground = F.sin(F.radians(F.lit(elevation)))
    plain = lambda v: F.bround(F.bround(v, 6), 1) + F.lit(0.0)
    return made.select("id", "dir", plain(F.col("speed") * F.cos(angle)).alias("vx"), plain(F.col("speed") * F.sin(angle) * ground).alias("vy"))


def hits(cells: DataFrame) -> DataFrame:
    """(key, hit): the slot nearest to each direction's widest cell; of all directions the first's, else the commonest."""
    widest = cells.groupBy("key", "dir").agg(F.max(F.struct("w", -F.col("slot"))).alias("m"))
    of_dir = widest.select("key", "dir", (-F.col("m.col2")).alias("hit"))
    front = of_dir.filter("dir = 1").select("key", F.col("hit").alias("front"))
    counts = of_dir.groupBy("key", "hit").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", -F.col("hit"))).alias("b"))
    return counts.select("key", (-F.col("b.col2")).alias("mode")).join(front, "key", "left").select("key", F.coalesce("front", "mode").alias("hit"))


def overridden(picks: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, slot, pick): (key, slot, pick, n) with the frames of (key, slot, chosen), clamped to the clip."""
    chosen = F.when(F.col("chosen").isNotNull(), F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("chosen"))))
    return picks.join(overrides, ["key", "slot"], "left").select("key", "slot", F.coalesce(chosen, "pick").alias("pick"))


def sources(wanted: DataFrame, made: DataFrame, mirror: DataFrame) -> DataFrame:
    """(key, dir, source, flip): each wanted direction's own images, else its mirror's flipped; null where neither is made."""
    own = made.select("key", F.col("dir"), F.lit(True).alias("own")).distinct()
    other = made.select("key", F.col("dir").alias("mirror"), F.lit(True).alias("other")).distinct()
    both = wanted.join(F.broadcast(mirror), "dir").join(own, ["key", "dir"], "left").join(other, ["key", "mirror"], "left")
    source = F.when(F.col("own"), F.col("dir")).when(F.col("other"), F.col("mirror"))
    return both.select("key", "dir", source.alias("source"), (F.col("own").isNull() & F.col("other").isNotNull()).alias("flip"))


def engine_text(rects_: DataFrame) -> DataFrame:
    """(key, text): one line per cell of each sheet, as a game engine's resource text lists regions."""
    line = F.format_string("region_%d_%02d = Rect2(%d, %d, %d, %d)", "dir", "slot", "x", "y", "w", "h")
    lines = rects_.select("key", F.struct("dir", "slot", line.alias("line")).alias("s")).groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lines.select("key", F.array_join(F.col("s.line"), "\n").alias("text"))
