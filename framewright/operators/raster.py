"""Pixel-relational operators over (label, frame, y, x, r, g, b): keying, boxes, bands, palettes, votes, quality rules.

Each groups by frame or clip, or looks at neighbours with windows; no operator collects a raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FRAME = ("label", "frame")


def luma() -> Column:
    return 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def keyness(green: Column) -> Column:
    """How much a pixel is of the key colour: magenta, or green."""
    return F.when(green, F.col("g") - F.greatest("r", "b")).otherwise(F.least("r", "b") - F.col("g"))


def is_key(r: Column, g: Column, b: Column) -> Column:
    return (F.least(r, b) - g > 80) | (g - F.greatest(r, b) > 50)


def border_median(pixels: DataFrame, side: int) -> DataFrame:
    """(label, frame, r, g, b, key): the median of the four border lines, corners counted twice, and whether it is a key colour."""
    last = side - 1
    times = (F.col("y") == 0).cast("int") + (F.col("y") == last).cast("int") + (F.col("x") == 0).cast("int") + (F.col("x") == last).cast("int")
    border = pixels.withColumn("times", times).filter("times > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times"))))
    out = border.groupBy(*FRAME).agg(*[F.median(c).alias(c) for c in "rgb"])
    return out.select(*FRAME, "r", "g", "b", is_key(F.col("r"), F.col("g"), F.col("b")).alias("key"))


def edge_share(pixels: DataFrame, side: int, band: int = 2, limit: int = 110) -> DataFrame:
    """(label, frame, share): the part of the edge band that isn't clean key colour."""
    edge = (F.col("y") < band) | (F.col("x") < band) | (F.col("y") >= side - band) | (F.col("x") >= side - band)
    return pixels.filter(edge).groupBy(*FRAME).agg(F.round(F.avg((F.least("r", "b") - F.col("g") < limit).cast("int")), 6).alias("share"))


def _keyed(pixels: DataFrame, side: int) -> DataFrame:
    """``pixels`` with their frame's border colour bg_r, bg_g, bg_b and the alpha of a ramp of keyness against the border's."""
    green = F.col("bg_g") - F.greatest("bg_r", "bg_b") > 50
    back = border_median(pixels, side).select(*FRAME, *[F.col(c).alias(f"bg_{c}") for c in "rgb"])
    keyed = pixels.join(back, list(FRAME)).withColumn("m", keyness(green) / 255.0)
    border = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == side - 1) | (F.col("x") == side - 1)
    level = F.greatest(F.lit(0.2), F.median(F.when(border, F.col("m"))).over(W.partitionBy(*FRAME)))
    ramp = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("m") / F.col("mk") - 0.2) / 0.4))
    return keyed.withColumn("mk", level).withColumn("alpha", F.round(ramp, 6))


def key_alpha(pixels: DataFrame, side: int) -> DataFrame:
    """(label, frame, y, x, alpha): a ramp of keyness against the border's."""
    return _keyed(pixels, side).select(*FRAME, "y", "x", "alpha")


def despilled(pixels: DataFrame) -> DataFrame:
    """Magenta spill taken from r and b, then green spill from g."""
    pink = F.greatest(F.lit(0), F.least("r", "b") - F.col("g"))
    once = pixels.select(*FRAME, "y", "x", (F.col("r") - pink).alias("r"), "g", (F.col("b") - pink).alias("b"))
    return once.select(*FRAME, "y", "x", "r", (F.col("g") - F.greatest(F.lit(0), F.col("g") - F.greatest("r", "b"))).alias("g"), "b")


def decontaminated(pixels: DataFrame, side: int) -> DataFrame:
    """(.., r, g, b, a): the background taken out of half transparent pixels, packed with a rounded alpha."""
    both = _keyed(pixels, side)
    a = F.bround(F.col("alpha") * 255).cast("int")

    def clean(c: str) -> Column:
        value = (F.col(c) - (1 - F.col("alpha")) * F.col(f"bg_{c}")) / F.greatest(F.col("alpha"), F.lit(0.05))
        value = F.when(F.col("alpha") > 0.05, value).otherwise(F.col(c))
        return F.when(a == 0, 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(value, 6)))).cast("int")).alias(c)

    return both.select(*FRAME, "y", "x", *[clean(c) for c in "rgb"], a.alias("a"))


def solid(pixels: DataFrame) -> DataFrame:
    """The pixels brighter than mid grey: the figure."""
    return pixels.filter(luma() > 128)


def boxes(pixels: DataFrame, side: int) -> DataFrame:
    """(label, frame, x0, y0, x1, y1, area, cx, touches): bounding box (end exclusive), area, centre and border contact."""
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == side - 1) | (F.col("x") == side - 1)
    return solid(pixels).groupBy(*FRAME).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"),
        F.count(F.lit(1)).alias("area"), F.round(F.avg("x"), 6).alias("cx"), F.bool_or(edge).alias("touches"),
    )


def centre_drift(pixels: DataFrame, side: int) -> DataFrame:
    """(label, drift, touching): how far the alpha-weighted centre moves over a clip, and how many frames touch the border."""
    edge = (F.least("y", "x") == 0) | (F.greatest("y", "x") == side - 1)
    tiny, columns = 1e-6, side * (side - 1) / 2  # each column weighs a little, so that empty frames have a centre
    cx = (F.sum(F.col("x") * F.col("alpha")) + tiny * columns) / (F.sum("alpha") + tiny * side)
    frames = key_alpha(pixels, side).groupBy(*FRAME).agg(F.round(cx, 6).alias("cx"), F.bool_or(edge & (F.col("alpha") > 0.5)).alias("touches"))
    return frames.groupBy("label").agg(F.bround(F.round(F.max("cx") - F.min("cx"), 6), 1).alias("drift"), F.count_if(F.col("touches")).alias("touching"))


def row_widths(pixels: DataFrame) -> DataFrame:
    """(label, frame, y, width): the figure's extent in each row."""
    return solid(pixels).groupBy(*FRAME, "y").agg((F.max("x") - F.min("x") + 1).alias("width"))


def body_heights(pixels: DataFrame, share: float = 0.25) -> DataFrame:
    """(label, frame, height): rows from the first to the last one that is at least a share of the widest."""
    widths = row_widths(pixels).withColumn("widest", F.max("width").over(W.partitionBy(*FRAME)))
    return widths.filter(F.col("width") >= share * F.col("widest")).groupBy(*FRAME).agg((F.max("y") - F.min("y") + 1).alias("height"))


def step_lengths(pixels: DataFrame, share: float = 0.07, least_rows: int = 10, frames: int = 4) -> DataFrame:
    """(label, step): largest less least width of the figure's lowest band, over clips with enough frames that are tall enough.

    The band has a share of the figure's height, and three rows above the lowest at least.
    """
    of_frame = W.partitionBy(*FRAME)
    rows = solid(pixels).withColumn("top", F.min("y").over(of_frame)).withColumn("bottom", F.max("y").over(of_frame)).withColumn("rows", F.size(F.collect_set("y").over(of_frame)))
    start = F.greatest(F.col("top"), F.col("bottom") - F.greatest(F.lit(3), F.bround(share * (F.col("bottom") - F.col("top")))))
    low = rows.filter((F.col("rows") >= least_rows) & (F.col("y") >= start))
    feet = low.groupBy(*FRAME).agg((F.max("x") - F.min("x") + 1).alias("width"))
    return feet.groupBy("label").agg(F.count(F.lit(1)).alias("m"), (F.max("width") - F.min("width")).alias("step")).filter(F.col("m") >= frames).select("label", "step")


def head_histogram(pixels: DataFrame, side: int, least: int = 50) -> DataFrame:
    """(label, bin, share): colours of the top 45 % of the cell in 8 x 8 x 8 bins; no rows at all if a label has under ``least`` pixels."""
    top = pixels.filter(F.col("y") < F.lit(int(side * 0.45)))
    bin_ = F.floor(F.col("r") / 32) * 64 + F.floor(F.col("g") / 32) * 8 + F.floor(F.col("b") / 32)
    counts = top.groupBy("label", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("m"))
    sums = counts.withColumn("total", F.sum("m").over(W.partitionBy("label")))
    few = sums.agg(F.min("total").alias("fewest")).filter(F.col("fewest") >= least)
    return sums.join(F.broadcast(few)).select("label", "bin", F.round(F.col("m") / F.col("total"), 8).alias("share"))


def face_shares(shares: DataFrame, front: int, back: int, ratio: float = 2.0) -> DataFrame:
    """(label, face): the share of each label's colours that mark the front: bins well above ``ratio`` times the back's share."""
    marks = shares.groupBy("bin").agg(F.max(F.when(F.col("label") == front, F.col("share"))).alias("s"), F.max(F.when(F.col("label") == back, F.col("share"))).alias("n"))
    marks = marks.filter(F.coalesce("s", F.lit(0.0)) > ratio * F.coalesce("n", F.lit(0.0)) + 0.002).select("bin", "s")
    total = marks.agg(F.sum("s").alias("total"))
    found = shares.join(F.broadcast(marks), "bin").groupBy("label").agg(F.sum("share").alias("v"))
    return found.join(F.broadcast(total), F.col("total") >= 0.03).select("label", F.round(F.col("v") / F.col("total"), 6).alias("face"))


def block_votes(pixels: DataFrame, levels: int = 4, block: int = 2) -> DataFrame:
    """(label, frame, by, bx, q): the commonest luma level of each block; the lowest of equally common ones."""
    voted = pixels.withColumn("q", F.floor(luma() * levels / 256).cast("int"))
    cells = [*FRAME, F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")]
    counts = voted.groupBy(*cells, "q").agg(F.count(F.lit(1)).alias("m"))
    return counts.groupBy(*FRAME, "by", "bx").agg(F.max(F.struct("m", -F.col("q"))).alias("v")).select(*FRAME, "by", "bx", (-F.col("v.col2")).alias("q"))


def majority(pixels: DataFrame, levels: int = 4, least: int = 6, kept: tuple = (0,)) -> DataFrame:
    """(label, frame, y, x, q): levels after taking on that of ``least`` or more of the 8 neighbours; the levels ``kept`` (dark lines) stay."""
    q = pixels.select(*FRAME, "y", "x", F.floor(luma() * levels / 256).cast("int").alias("q"))
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    near = q.select(*FRAME, "q", F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in around])).alias("p"))
    votes = near.select(*FRAME, "p.y", "p.x", "q").groupBy(*FRAME, "y", "x", "q").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= least)
    new = F.when(F.col("q").isin(*kept), F.col("q")).otherwise(F.coalesce("vote", "q"))
    return q.join(votes.select(*FRAME, "y", "x", F.col("q").alias("vote")), [*FRAME, "y", "x"], "left").select(*FRAME, "y", "x", new.alias("q"))


def light_alpha(pixels: DataFrame) -> DataFrame:
    """(.., a): how much a pixel is light: a ramp of its brightening over the clip's first frame, 0 where it darkens."""
    first = F.first(luma()).over(W.partitionBy("label", "y", "x").orderBy("frame"))
    gain = luma() - first
    return pixels.select(*FRAME, "y", "x", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (gain - 50) / 100)), 6).alias("a"))


def grid_fold(pixels: DataFrame, periods: int = 4, bins: int = 4) -> DataFrame:
    """(label, period, share): for each period, the largest share of edge strength that folds into one bin."""
    w = W.partitionBy(*FRAME, "y").orderBy("x")
    edges = pixels.select("label", "x", F.abs(luma() - F.lag(luma()).over(w)).alias("d")).filter("d is not null")
    folded = edges.select("label", "x", "d", F.explode(F.sequence(F.lit(2), F.lit(periods))).alias("period"))
    bin_ = F.floor(F.pmod(F.col("x"), F.col("period")) / F.col("period") * bins)
    sums = folded.groupBy("label", "period", bin_.alias("bin")).agg(F.sum("d").alias("d"))
    return sums.groupBy("label", "period").agg(F.round(F.max("d") / F.sum("d"), 6).alias("share"))


def lab(pixels: DataFrame) -> DataFrame:
    """(.., l, a, b2): CIE Lab of sRGB under D65, scaled to 0..255 as 8-bit Lab is, 4 decimals."""

    def linear(c: str) -> Column:
        v = F.col(c) / 255.0
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    def bent(v: Column) -> Column:
        return F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16.0 / 116)

    lin = pixels.select(*FRAME, "y", "x", *[linear(c).alias(c) for c in "rgb"])
    xyz = lin.select(
        *FRAME, "y", "x", bent((0.412453 * F.col("r") + 0.357580 * F.col("g") + 0.180423 * F.col("b")) / 0.950456).alias("fx"),
        bent(0.212671 * F.col("r") + 0.715160 * F.col("g") + 0.072169 * F.col("b")).alias("fy"),
        bent((0.019334 * F.col("r") + 0.119193 * F.col("g") + 0.950227 * F.col("b")) / 1.088754).alias("fz"),
    )
    return xyz.select(
        *FRAME, "y", "x", F.round((116 * F.col("fy") - 16) * 2.55, 4).alias("l"), F.round(500 * (F.col("fx") - F.col("fy")) + 128, 4).alias("a"),
        F.round(200 * (F.col("fy") - F.col("fz")) + 128, 4).alias("b2"),
    )


def edited_share(pixels: DataFrame, limit: float = 14.0) -> DataFrame:
    """(label, frame, share): pixels whose Lab colour is over ``limit`` from the clip's first frame."""
    first = W.partitionBy("label", "y", "x").orderBy("frame")
    gap = lambda c: F.pow(F.col(c) - F.first(c).over(first), F.lit(2.0))
    far = lab(pixels).select(*FRAME, (gap("l") + gap("a") + gap("b2") > limit * limit).alias("far"))
    return far.groupBy(*FRAME).agg(F.round(F.avg(F.col("far").cast("int")), 6).alias("share"))


def area_outliers(pixels: DataFrame, side: int, over: float = 1.08, around: int = 6) -> DataFrame:
    """(label, frame, clean): frames whose figure is over ``over`` times the median area, and how many clean ones are near."""
    box = boxes(pixels, side).select(*FRAME, "area", F.median("area").over(W.partitionBy("label")).alias("mid"))
    near = W.partitionBy("label").orderBy("frame").rangeBetween(-around, around)
    marked = box.select(*FRAME, (F.col("area") > over * F.col("mid")).alias("out"))
    return marked.select(*FRAME, "out", F.count_if(~F.col("out")).over(near).alias("clean")).filter("out").select(*FRAME, "clean")


def even_heights(pixels: DataFrame, most: float = 0.08, spread: float = 1.15) -> DataFrame:
    """(label, factor): what evens each clip's median body height with the median of all, within +-``most``; 1 where heights differ too much."""
    clips = body_heights(pixels).groupBy("label").agg(F.median("height").alias("height"))
    total = clips.agg(F.median("height").alias("mid"), F.max("height").alias("hi"), F.min("height").alias("lo"))
    factor = F.greatest(F.lit(1 - most), F.least(F.lit(1 + most), F.col("mid") / F.col("height")))
    return clips.join(F.broadcast(total), F.col("mid").isNotNull()).select("label", F.round(F.when(F.col("hi") > spread * F.col("lo"), 1.0).otherwise(factor), 6).alias("factor"))


def head_rows(pixels: DataFrame, side: int) -> DataFrame:
    """(label, frame, top, neck): the figure's first row, and the narrowest smoothed row at 15 to 55 % of its height.

    Row widths are smoothed over three rows, missing rows count as zero. If the neck is over 0.8 of the widest row above
    it, it is put at 30 % instead.
    """
    rows = row_widths(pixels)
    span = rows.groupBy(*FRAME).agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    grid = span.select("*", F.explode(F.sequence("top", "bottom")).alias("y")).join(rows, [*FRAME, "y"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
    order = W.partitionBy(*FRAME).orderBy("y")
    smooth = F.round((F.coalesce(F.lag("width").over(order), F.lit(0)) + F.col("width") + F.coalesce(F.lead("width").over(order), F.lit(0))) / 3, 6)
    height = F.col("bottom") - F.col("top") + 1
    part = grid.withColumn("s", smooth).withColumn("at", (F.col("y") - F.col("top")) / height).withColumn("h", height)
    above = F.max("s").over(order.rowsBetween(W.unboundedPreceding, 0))
    inside = part.withColumn("above", above).filter(F.col("at").between(0.15, 0.55))
    low = inside.groupBy(*FRAME, "top", "h").agg(F.min(F.struct("s", "y", "above")).alias("m"))
    neck = F.when(F.col("m.s") > 0.8 * F.col("m.above"), F.col("top") + F.bround(0.3 * F.col("h")).cast("int")).otherwise(F.col("m.y"))
    return low.select(*FRAME, "top", neck.alias("neck"))


def best_shift(pixels: DataFrame, side: int, reach: int = 1, levels: int = 4) -> DataFrame:
    """(label, frame, dy, dx, score): the shift within ``reach`` at which the top half of the clip's first frame fits best.

    The score counts pixels of the same luma level; of equal scores the smallest shift in rows, then columns, wins.
    """
    q = pixels.select(*FRAME, "y", "x", F.floor(luma() * levels / 256).cast("int").alias("q"))
    head = q.filter((F.col("frame") == 0) & (F.col("y") < side // 2)).select("label", "y", "x", "q")
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])
    moved = head.select("label", "q", "y", "x", F.explode(offsets).alias("o")).select("label", "q", "o.dy", "o.dx", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    hits = q.join(moved, ["label", "y", "x", "q"]).groupBy(*FRAME, "dy", "dx").agg(F.count(F.lit(1)).alias("score"))
    best = hits.groupBy(*FRAME).agg(F.max(F.struct("score", -F.abs("dy"), -F.abs("dx"), "dy", "dx")).alias("m"))
    return best.select(*FRAME, F.col("m.dy").alias("dy"), F.col("m.dx").alias("dx"), F.col("m.score").alias("score"))
