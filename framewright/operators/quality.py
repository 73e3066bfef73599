"""Quality rules over keyed frames (label, frame, y, x, r, g, b, alpha 0..255): what is wrong with which frames of a sheet.

A label is a direction; its frames are in order, and complete grids of pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators.raster import FRAME, luma

SOLID = 128
#: Rules in the order in which a direction's issues are listed; size comes after all directions.
RULES = ["hole", "fringe", "pink", "shadow", "empty", "seam", "edge", "bg", "size"]


def grown(mask: DataFrame, side: int, radius: int = 1) -> DataFrame:
    """(label, frame, y, x): the positions within ``radius`` rows and columns of a mask's, inside the frame."""
    reach = range(-radius, radius + 1)
    shifts = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in reach for dx in reach])
    near = mask.select(*FRAME, F.explode(shifts).alias("p")).select(*FRAME, "p.y", "p.x")
    return near.filter(F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1)).distinct()


def shrunk(frames: DataFrame, inside: Column, side: int, radius: int = 1) -> DataFrame:
    """(label, frame, y, x): positions of a mask with no other position near; the frame's border is no other position."""
    place = [*FRAME, "y", "x"]
    return frames.filter(inside).select(*place).join(grown(frames.filter(~inside).select(*place), side, radius), place, "left_anti")


def borders(pixels: DataFrame, side: int, band: int = 2, limit: int = 110) -> DataFrame:
    """(label, frame, r, g, b, share): the median of the four border lines, corners counted twice, and the edge band's pattern share, in one pass."""
    last = side - 1
    times = (F.col("y") == 0).cast("int") + (F.col("y") == last).cast("int") + (F.col("x") == 0).cast("int") + (F.col("x") == last).cast("int")
    edge = (F.least("y", "x") < band) | (F.greatest("y", "x") >= side - band)
    odd = F.when(edge, (F.least("r", "b") - F.col("g") < limit).cast("int"))
    return pixels.groupBy(*FRAME).agg(*[F.percentile(c, F.lit(0.5), times).alias(c) for c in "rgb"], F.round(F.avg(odd), 6).alias("share"))


def background_changes(pixels: DataFrame, side: int, far: float = 60.0, pattern: float = 0.1) -> DataFrame:
    """(label, frames, changed): frames whose border colour is far from the first one's, or whose edge band has a pattern."""
    first = W.partitionBy("label").orderBy("frame")
    gap = sum((F.pow(F.col(c) - F.first(c).over(first), F.lit(2.0)) for c in "rgb"), F.lit(0.0))
    odd = borders(pixels, side).select("label", ((gap > far * far) | (F.col("share") > pattern)).alias("odd"))
    return odd.groupBy("label").agg(F.count(F.lit(1)).alias("frames"), F.count_if("odd").alias("changed"))


def drifting(pixels: DataFrame, side: int, step: int = 2) -> DataFrame:
    """(label, drifted, total): of every ``step``-th frame those whose border isn't magenta or has a pattern, times ``step``; and all frames."""
    bad = ((F.least("r", "b") - F.col("g") <= 80) | (F.col("share") > 0.1)) & (F.col("frame") % step == 0)
    return borders(pixels, side).groupBy("label").agg((F.count_if(bad) * step).alias("drifted"), F.count(F.lit(1)).alias("total"))


def spread(value: Column, radius: int, most: bool) -> list[Column]:
    """Largest (or least) values within ``radius`` columns, and the function that goes on over rows; frames must be complete grids."""
    pick = F.max if most else F.min
    rows = lambda v, line, along: pick(v).over(W.partitionBy(*FRAME, line).orderBy(along).rowsBetween(-radius, radius))
    return rows(value, "y", "x"), lambda v: rows(v, "x", "y")


def fringed(frames: DataFrame) -> DataFrame:
    """(label, frame): frames with key colour on the figure's outline, and much less of it inside.

    The outline is the figure grown by a pixel less the figure shrunk by one; inside is three pixels in. Neighbourhoods are
    windows over rows, then columns, of complete frames; beyond the frame nothing counts.
    """
    key = (F.least("r", "b") - F.col("g") > 60) | (F.col("g") - F.greatest("r", "b") > 60)
    marked = frames.select(*FRAME, "y", "x", key.cast("int").alias("key"), "alpha", (F.col("alpha") > SOLID).cast("int").alias("solid"))
    steps = {"grown": (1, True), "shrunk": (1, False), "inner": (3, False)}
    across = {n: spread(F.col("solid"), *how)[0] for n, how in steps.items()}
    down = {n: spread(F.col("solid"), *how)[1](F.col(n)) for n, how in steps.items()}
    near = marked.withColumns(across).withColumns(down)
    band = (F.col("grown") == 1) & (F.col("shrunk") == 0) & (F.col("alpha") > 20)
    shares = near.groupBy(*FRAME).agg(F.avg(F.when(band, F.col("key"))).alias("edge"), F.coalesce(F.avg(F.when(F.col("inner") == 1, F.col("key"))), F.lit(0.0)).alias("inside"))
    return shares.filter((F.col("edge") > 0.04) & (F.col("edge") > 3 * F.col("inside") + 0.02)).select(*FRAME)


def outlined(frames: DataFrame, side: int, band: int = 7, dark: float = 80.0, share: float = 0.45, least: int = 100) -> DataFrame:
    """(label, share, outlined): how much of the edge band is dark, on average over frames with enough opaque pixels."""
    place = [*FRAME, "y", "x"]
    solid = F.col("alpha") > 127
    edge = frames.filter(solid).join(shrunk(frames, solid, side, band // 2), place, "left_anti").groupBy(*FRAME).agg(F.avg((luma() < dark).cast("int")).alias("share"))
    enough = frames.filter(solid).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return edge.join(enough, list(FRAME)).groupBy("label").agg(F.round(F.avg("share"), 6).alias("share")).select("label", "share", (F.col("share") >= share).alias("outlined"))


def small_steps(frames: DataFrame) -> DataFrame:
    """(label, jump, step): mean colour difference of the last and the first frame, and the median one between neighbours."""
    place = W.partitionBy("label", "y", "x").orderBy("frame")
    shown = [(F.col(c) * F.col("alpha") / 255 / 255).alias(c) for c in "rgb"]
    ends = frames.select(*FRAME, "y", "x", *shown).withColumn("last", F.max("frame").over(W.partitionBy("label")))
    gap = lambda other: sum((F.abs(F.col(c) - other(c)) for c in "rgb"), F.lit(0.0)) / 3
    steps = ends.select(*FRAME, "last", gap(lambda c: F.lag(c).over(place)).alias("step"), F.when(F.col("frame") == F.col("last"), gap(lambda c: F.first(c).over(place))).alias("jump"))
    per_frame = steps.groupBy(*FRAME).agg(F.round(F.avg("step"), 9).alias("step"), F.round(F.avg("jump"), 9).alias("jump"))
    return per_frame.groupBy("label").agg(F.max("jump").alias("jump"), F.median("step").alias("step"), F.count(F.lit(1)).alias("frames"))


def issues(frames: DataFrame, raw: DataFrame, side: int, loop: bool = True, vivid: bool = False, holes: DataFrame | None = None) -> DataFrame:
    """(place, kind, label, frames, count, ratio): the issues of all directions, by direction, rule and then size.

    ``raw`` has the frames before keying; ``holes`` (label, frame) what the hole kernel found. frames is an array. With
    vivid effects holes, empty frames, cut edges and sizes aren't judged; seams and sizes only in loops, seams over more
    than two frames, sizes over more than two directions. Only directions that were made should be given.
    """
    solid = F.col("alpha") > SOLID
    of_frame, of_label = W.partitionBy(*FRAME), W.partitionBy("label")
    tall = F.when(solid, F.col("y"))
    edges = frames.withColumn("bottom", F.max(tall).over(of_frame)).withColumn("top", F.min(tall).over(of_frame))
    low = solid & (F.col("y") >= F.greatest(F.lit(0), F.col("bottom") - F.greatest(F.lit(2), F.floor(0.06 * (F.col("bottom") - F.col("top"))))))
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    grey = (most - least < 18) & (most > 60) & (most < 215)
    box = edges.groupBy(*FRAME).agg(
        F.count_if(solid).alias("area"), F.coalesce(F.max(tall) - F.min(tall) + 1, F.lit(0)).alias("height"), F.count_if(low).alias("low"), F.count_if(low & grey).alias("grey"),
        F.count_if(solid & (F.least("r", "b") - F.col("g") > 50) & (F.col("r") > 150)).alias("pink"),
        F.bool_or(solid & ((F.least("y", "x") == 0) | (F.greatest("y", "x") == side - 1))).alias("touches"),
    )
    share = F.coalesce(F.try_divide("pink", "area"), F.lit(0.0))
    middle = F.coalesce(F.nullif(F.median("area").over(of_label), F.lit(0.0)), F.lit(1.0))
    judged = box.withColumn("share", share).withColumn("base", F.first("share").over(of_label.orderBy("frame"))).withColumn("middle", middle)
    listed = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.col("frame").cast("long"))))
    facts = judged.groupBy("label").agg(
        listed(F.col("share") > F.col("base") + 0.01).alias("pink"), listed((F.col("low") > 20) & (F.col("grey") > 0.5 * F.col("low"))).alias("shadow"),
        listed(F.col("area") < 0.3 * F.col("middle")).alias("empty"), F.count_if("touches").alias("touching"), F.median("height").alias("height"),
    )
    every = W.partitionBy(F.lit(1))  # a row a direction
    facts = facts.withColumn("mid", F.coalesce(F.nullif(F.median("height").over(every), F.lit(0.0)), F.lit(1.0))).withColumn("dirs", F.count(F.lit(1)).over(every))
    nothing = F.array().cast("array<long>")

    def issue(kind: str, when: Column, frames_: Column = nothing, count: Column | None = None, ratio: Column | None = None) -> Column:
        count = F.lit(None) if count is None else count
        ratio = F.lit(None) if ratio is None else ratio
        row = F.struct(
            F.lit(RULES.index(kind)).alias("rule"), F.lit(kind).alias("kind"), frames_.cast("array<long>").alias("frames"), count.cast("long").alias("count"), ratio.cast("double").alias("ratio")
        )
        return F.when(when, row)

    found = [issue(kind, F.size(kind) > 0, F.col(kind)) for kind in (("pink", "shadow") if vivid else ("pink", "shadow", "empty"))]
    if not vivid:
        found.append(issue("edge", F.col("touching") > 3))
        if loop:
            off = F.abs(F.col("height") - F.col("mid")) / F.col("mid") > 0.15
            found.append(issue("size", (F.col("dirs") > 2) & off, ratio=F.bround(F.col("height") / F.col("mid"), 2)))
    parts = [facts.select("label", F.explode(F.array_compact(F.array(*found))).alias("i"))]
    lists = [("fringe", fringed(frames))] + ([("hole", holes)] if holes is not None and not vivid else [])
    parts += [rows.groupBy("label").agg(F.array_sort(F.collect_list(F.col("frame").cast("long"))).alias("f")).select("label", issue(kind, F.lit(True), F.col("f")).alias("i")) for kind, rows in lists]
    if loop:
        seams = small_steps(frames).filter((F.col("frames") > 2) & (F.col("jump") > 0.01) & (F.col("jump") > 2.2 * F.col("step")))
        parts.append(seams.select("label", issue("seam", F.lit(True), F.array(F.col("frames") - 1, F.lit(0))).alias("i")))
    changed = background_changes(raw, side).filter(F.col("changed") > 0.1 * F.col("frames"))
    parts.append(changed.select("label", issue("bg", F.lit(True), count=F.col("changed")).alias("i")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # an issue list is as long as there are directions and rules, whatever the frames' number
    order = W.orderBy((F.col("i.rule") == len(RULES) - 1).cast("int"), "label", "i.rule")
    return out.select((F.row_number().over(order) - 1).alias("place"), "i.kind", "label", "i.frames", "i.count", "i.ratio")


def thumbnails(frames: DataFrame, block: int) -> DataFrame:
    """(label, frame, v): grey values over white, averaged over square blocks, by rows; 0 is black, 1 white."""
    a = F.col("alpha") / 255
    grey = (luma() * a + 255 * (1 - a)) / 255
    cells = frames.groupBy(*FRAME, F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")).agg(F.round(F.avg(grey), 6).alias("g"))
    return cells.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("by", "bx", "g")))["g"].alias("v"))


def layers(whole: DataFrame, body: DataFrame) -> DataFrame:
    """(.., body, fx) of two tables (.., alpha in 0..1): the part of a cutout that is the figure, and what is left as light, both 0..255."""
    place = [*FRAME, "y", "x"]
    both = whole.join(body.withColumnRenamed("alpha", "own"), place)
    own = F.least("own", "alpha")
    whole_number = lambda v: F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5, 6)).cast("int")
    return both.select(*place, whole_number(own).alias("body"), whole_number(F.col("alpha") - own).alias("fx"))
