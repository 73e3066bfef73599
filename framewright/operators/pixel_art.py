"""Frames as pixel art with a given palette: votes of sub-pixels, dark lines first, stray cells, majority, and temporal hold.

``palette`` is a list of (r, g, b), MAX_COLOURS at most, the same for all frames; a cell's colour is its index. Cells are
blocks of sub-pixels. Every step groups by cell or looks at neighbours by windows and equality joins, but for the hold,
which goes through a cell's frames in order; spans of a cell's frames, not clips, are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.scratch import stored

MAX_COLOURS = 256
CELL = ("label", "frame", "by", "bx")
#: Frames of a cell that are gone through at a time.
SPAN = 128


def _dark(palette: list[tuple[int, int, int]], limit: float) -> list[bool]:
    return [0.299 * r + 0.587 * g + 0.114 * b < limit for r, g, b in palette]


def _first_most(votes: Column) -> Column:
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("int")


def voted(frames: DataFrame, palette: list[tuple[int, int, int]], block: int = 4, dark_limit: float = 70.0, dark_share: float = 0.4) -> DataFrame:
    """(label, frame, by, bx, votes, q, a) of (label, frame, y, x, r, g, b, alpha): each cell's votes by colour, its colour, and whether it is opaque.

    Opaque sub-pixels vote for the nearest palette colour; the first of equally many wins. Where dark colours have a share
    of the cell (and two votes) the commonest dark one wins, so that thin lines stay. Half of a cell opaque makes it so.
    """
    if not 0 < len(palette) <= MAX_COLOURS:
        raise ValueError(f"palettes have 1 to {MAX_COLOURS} colours")
    table = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(c) for c, v in zip("rgb", colour)]) for k, colour in enumerate(palette)])
    gap = lambda p: sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in "rgb"), F.lit(0))
    nearest = F.array_min(F.transform(table, lambda p: F.struct(gap(p).alias("d"), p["k"].alias("k"))))["k"]
    solid = F.col("alpha") > 127
    sub = frames.select("label", "frame", F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx"), solid.alias("solid"), nearest.alias("k"))
    votes = F.array(*[F.count_if(F.col("solid") & (F.col("k") == k)) for k in range(len(palette))])
    cells = sub.groupBy(*CELL).agg(votes.alias("votes"), (F.avg(F.col("solid").cast("int")) >= 0.5).alias("a"))
    dark = F.zip_with("votes", F.array(*map(F.lit, _dark(palette, dark_limit))), lambda n, d: F.when(d, n).otherwise(0))
    lines = F.aggregate(dark, F.lit(0).cast("long"), lambda s, n: s + n) >= max(2, dark_share * block * block)
    return cells.select(*CELL, "votes", F.when(lines, _first_most(dark)).otherwise(_first_most(F.col("votes"))).alias("q"), "a")


def without_strays(cells: DataFrame, palette: list[tuple[int, int, int]], dark_limit: float = 70.0) -> DataFrame:
    """Cells whose four neighbours are all opaque and of other colours take the commonest of these; dark ones stay."""
    across, down = W.partitionBy("label", "frame", "by").orderBy("bx"), W.partitionBy("label", "frame", "bx").orderBy("by")
    near = F.array(*[f(F.struct("q", "a")).over(w) for w in (down, across) for f in (F.lag, F.lead)])
    rows = cells.withColumn("near", F.filter(near, lambda n: n["a"] & (n["q"] != F.col("q"))))
    counts = F.transform(F.array_distinct("near.q"), lambda q: F.struct((-F.size(F.filter("near", lambda n: n["q"] == q))).alias("n"), q.alias("q")))
    dark = F.element_at(F.array(*map(F.lit, _dark(palette, dark_limit))), F.col("q") + 1)
    stray = F.col("a") & (F.size("near") == 4) & ~dark
    return rows.withColumn("q", F.when(stray, F.array_min(counts)["q"]).otherwise(F.col("q"))).drop("near")


def majority_of_eight(cells: DataFrame, palette: list[tuple[int, int, int]], least: int = 6, dark_limit: float = 70.0) -> DataFrame:
    """Opaque cells take the colour that ``least`` or more of their eight neighbours have, if these are opaque; dark ones stay."""
    around = F.array(*[F.struct((F.col("by") + dy).alias("by"), (F.col("bx") + dx).alias("bx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    near = cells.filter("a").select("label", "frame", "q", F.explode(around).alias("p")).select("label", "frame", "p.by", "p.bx", "q")
    votes = near.groupBy(*CELL, "q").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(*CELL, F.col("q").alias("most"))
    dark = F.element_at(F.array(*map(F.lit, _dark(palette, dark_limit))), F.col("q") + 1)
    new = F.when(F.col("a") & ~dark, F.coalesce("most", "q")).otherwise(F.col("q"))
    return cells.join(votes, list(CELL), "left").withColumn("q", new).drop("most")


def held(cells: DataFrame, palette: list[tuple[int, int, int]], block: int = 4, share: float = 0.3, dark_limit: float = 70.0) -> DataFrame:
    """(label, frame, by, bx, q, a): a cell keeps the colour of the frame before if that has nearly as many votes now.

    Nearly: at most a share of the cell fewer, one vote at least; both colours dark, or neither; opaque before and now. Spans of
    frames are gone through beside each other: first for every colour that may be held when a span begins, to know the one
    that is held when it ends, then, when a cell's spans have been chained, once more from the colour that was.
    """
    slack = max(2, round(share * block * block))
    dark = F.array(*map(F.lit, _dark(palette, dark_limit)))
    kinds = dict(cells.dtypes)
    def after(before: Column, x: Column) -> Column:
        now, then = F.get(x["votes"], x["q"]), F.get(x["votes"], before["q"])
        keep = x["a"] & before["a"] & (before["q"] != x["q"]) & (then > 0) & (then >= now - slack) & (F.get(dark, before["q"]) == F.get(dark, x["q"]))
        return F.struct(x["frame"].alias("frame"), F.when(F.coalesce(keep, F.lit(False)), before["q"]).otherwise(x["q"]).alias("q"), x["a"].alias("a"))

    def add(acc: Column, new: Callable[[Column], Column]) -> Column:
        return F.concat(acc, F.array(new(F.element_at(acc, -1))))

    none = F.lit(None).cast(f"struct<q:{kinds['q']},a:boolean>")
    begun = lambda q, a: F.struct(F.lit(None).cast(kinds["frame"]).alias("frame"), q.cast(kinds["q"]).alias("q"), a.alias("a"))
    ends = F.transform(F.sequence(F.lit(0), F.lit(len(palette) - 1)), lambda k: F.aggregate("f", begun(k, F.lit(True)), after)["q"])
    spans = cells.groupBy(F.struct("label", "by", "bx").alias("cell"), F.floor(F.col("frame") / SPAN).alias("span")).agg(F.array_sort(F.collect_list(F.struct("frame", "votes", "q", "a"))).alias("f"))
    spans = stored(spans.select("*", F.element_at("f", 1)["q"].alias("first"), ends.alias("ends"), F.element_at("f", -1)["a"].alias("last")), "spans")  # else the cells are made twice
    chained = spans.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("span", "first", "ends", "last"))).alias("s"))
    end = lambda before, s: F.struct(F.get(s["ends"], F.when(before["a"], before["q"]).otherwise(s["first"])).alias("q"), s["last"].alias("a"))
    starts = F.aggregate("s", F.array(none), lambda acc, s: add(acc, lambda before: end(before, s)))
    starts = chained.select("cell", F.explode(F.arrays_zip(F.col("s.span").alias("span"), F.slice(starts, F.lit(1), F.size("s")).alias("start"))).alias("x")).select("cell", "x.*")
    shown = F.aggregate("f", F.array(begun(F.col("start.q"), F.col("start.a"))), lambda acc, x: add(acc, lambda before: after(before, x)))
    out = spans.join(starts, ["cell", "span"]).select("cell", F.explode(F.slice(shown, F.lit(2), F.size("f"))).alias("x"))
    return out.select("cell.label", "x.frame", "cell.by", "cell.bx", "x.q", "x.a")


def pixelated(frames: DataFrame, palette: list[tuple[int, int, int]], block: int = 4) -> DataFrame:
    """(label, frame, by, bx, q, a): all steps in order: votes, strays, majority, hold."""
    return held(majority_of_eight(without_strays(voted(frames, palette, block), palette), palette), palette, block)


def light_part(frames: DataFrame, backs: DataFrame) -> DataFrame:
    """(label, frame, y, x, light): how much a pixel is light, before smoothing, given backs (label, frame, r, g, b).

    The larger of two ramps: how much brighter its most brightened channel is (50 to 150), and how far its colour is from
    the background's (45 to 100), weaker where it is darker. Shadows (the background's colour, darker) are none.
    """
    back = backs.select("label", "frame", *[F.col(c).cast("double").alias(f"b_{c}") for c in "rgb"])
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    dot = lambda a, b: sum((F.col(a + c) * F.col(b + c) for c in "rgb"), F.lit(0.0))
    grey = lambda p: 0.299 * F.col(p + "r") + 0.587 * F.col(p + "g") + 0.114 * F.col(p + "b")
    up = clip((F.greatest(*[F.col(c) - F.col(f"b_{c}") for c in "rgb"]) - 50) / 100)
    far = F.sqrt(sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in "rgb"), F.lit(0.0)))
    darker = grey("b_") - grey("")
    cosine = dot("", "b_") / (F.sqrt(dot("", "")) * F.sqrt(dot("b_", "b_")) + 1e-6)
    other = F.when((cosine > 0.97) & (darker > 6), 0.0).otherwise(clip((far - 45) / 55) * clip(1 - (darker - 10) / 40))
    return frames.join(back, ["label", "frame"]).select("label", "frame", "y", "x", F.round(F.greatest(up, other) + 1e-9, 6).alias("light"))


def motion_signal(frames: DataFrame) -> DataFrame:
    """(label, frame, upper, area): z-scores over a clip of how much of the figure is in the top 30 % of its box, and of its size."""
    solid = F.col("alpha") > 127
    row = F.when(F.col("alpha") > 25, F.col("y"))
    of_frame = W.partitionBy("label", "frame")
    limit = F.floor(F.min(row).over(of_frame) + (F.max(row).over(of_frame) + 1 - F.min(row).over(of_frame)) * 0.3)
    sums = frames.withColumn("limit", limit).groupBy("label", "frame").agg(F.count_if(solid & (F.col("y") < F.col("limit"))).alias("upper"), F.count_if(solid).alias("area"))
    clip = W.partitionBy("label")
    z = lambda c: F.round((F.col(c) - F.avg(c).over(clip)) / (F.stddev_pop(c).over(clip) + 1e-6), 6).alias(c)
    return sums.select("label", "frame", z("upper"), z("area"))


def video_times(videos: DataFrame, fps: float = 24.0, max_seconds: float = 5.0, max_side: int = 640) -> DataFrame:
    """(key, i, source, width, height): which frame of (key, fps, frames, width, height) each frame at ``fps`` shows, and at what size.

    Videos under 12 frames are an error; sizes are even, and never larger than the video's.
    """
    read = F.least(F.col("frames"), F.floor(F.col("fps") * max_seconds) + 2)
    enough = F.when(F.col("frames") >= 12, read).otherwise(F.raise_error(F.lit("a video of half a second or more is needed")).cast("long"))
    k = F.least(F.lit(1.0), max_side / F.greatest("width", "height"))
    even = lambda c: (F.floor(F.floor(F.col(c) * k) / 2) * 2).cast("int")
    rows = videos.select("key", "fps", enough.alias("read"), even("width").alias("width"), even("height").alias("height"))
    length = F.least(F.col("read") / F.col("fps"), F.lit(max_seconds))
    shown = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil(F.round(length * fps, 6)) - 1)))
    source = F.least(F.col("read") - 1, F.bround(F.round(F.col("i") / fps * F.col("fps"), 6)).cast("long"))
    return shown.select("key", "i", source.alias("source"), "width", "height")


def facing(joints: DataFrame) -> DataFrame:
    """(key, x, y, z) of (key, across, up) vectors as array<double>: the unit vector that a chest looks along, their cross product."""
    a, u = (lambda i: F.col("across")[i]), (lambda i: F.col("up")[i])
    cross = [a(1) * u(2) - a(2) * u(1), a(2) * u(0) - a(0) * u(2), a(0) * u(1) - a(1) * u(0)]
    length = F.sqrt(sum((c * c for c in cross), F.lit(0.0))) + 1e-9
    return joints.select("key", *[F.round(c / length, 6).alias(n) for c, n in zip(cross, "xyz")])


def headings(joints: DataFrame) -> DataFrame:
    """(key, yaw): degrees by which a captured clip (key, across) is turned, from the mean line between left and right."""
    return joints.groupBy("key").agg(F.round(F.degrees(F.atan2(F.avg(-F.col("across")[2]), F.avg(F.col("across")[0]))), 6).alias("yaw"))


def blended(turns: DataFrame) -> DataFrame:
    """(key, w, x, y, z) of (key, a, b, t): the rotation a share t of the way from quaternion a to b, the short way round."""
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    near = turns.withColumn("dot", dot).select("key", "t", "a", F.transform("b", lambda v: F.when(F.col("dot") < 0, -v).otherwise(v)).alias("b"), F.least(F.lit(1.0), F.abs("dot")).alias("d"))
    angle = F.acos("d")
    straight = F.zip_with("a", "b", lambda x, y: x + F.col("t") * (y - x))
    curved = F.zip_with("a", "b", lambda x, y: (F.sin((1 - F.col("t")) * angle) * x + F.sin(F.col("t") * angle) * y) / F.sin(angle))
    mixed = near.select("key", F.when(F.col("d") > 0.9995, straight).otherwise(curved).alias("q"))
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v))
    return mixed.select("key", *[F.round(F.col("q")[i] / length, 6).alias(n) for i, n in enumerate("wxyz")])
