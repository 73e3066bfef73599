"""Light effects that aren't the figure's: glows of foreign colours, bright outbursts against neighbouring frames, what is left of both.

Sprites are (label, frame, y, x, r, g, b, a), complete grids; palettes (label, centres) come from ``palettes`` over a
histogram in Lab. Colours are compared, masks grow and parts are judged in kernels over whole frames (``by_frame``);
silhouettes of clean frames are united by windows over frames, a row a line of pixels, packed as bits. Facts of a label (its
palette, its first frame) are broadcast: 0.6 KB a label. What a frame is told (palette, silhouette) goes with its first pixel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.colour import hsv_arrays, lab_arrays
from framewright.operators.cutout import COLOURS, Colours
from framewright.operators.palette import SPACE, histogram, palettes
from framewright.operators.raster import FRAME
from framewright.operators.regions import Frames, by_frame, dealt, erased, followed, narrow, rounded, without_detached, without_slivers

#: Lab distance from which a colour is foreign to the figure.
FOREIGN = 22.0
GROWTH = 40
#: Pixels of a line that one number holds as bits.
BITS = 62


def character_palette(sprites: DataFrame, colours: int = 24) -> DataFrame:
    """(label, centres): the Lab colours of each label's first frame, of pixels with opacity above 200."""
    first = sprites.join(F.broadcast(sprites.groupBy("label").agg(F.min("frame").alias("frame"))), list(FRAME), "left_semi")
    return palettes(histogram(first, in_lab=True), colours)


def _first_pixel():
    return (F.col("y") == 0) & (F.col("x") == 0)


def _told(frames: Frames, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What frames are told with one of their pixels: each item's frame and its place in the frame's list, and the items."""
    ends = lists.offsets.to_numpy()
    many = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(frames.where, many), place, lists.flatten()


def with_colours(sprites: DataFrame, figure: DataFrame) -> DataFrame:
    """``sprites`` with hue, sat, val and strange, the Lab distance to the nearest colour of the label's figure (null without colours)."""

    def work(frames, r, g, b, centres):
        frame, place, colours = _told(frames, centres)
        near = np.full((place.max(initial=0) + 1, frames.shape[0], 3), np.nan)
        for k, n in enumerate(SPACE):
            near[place, frame, k] = colours.field(n).to_numpy(zero_copy_only=False)
        own, least = lab_arrays(r, g, b), np.full(len(r), np.nan)
        for slot in near:
            apart = [slot[:, k][frames.where] - v for k, v in enumerate(own)]
            least = np.fmin(least, apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2])
        return {"strange": np.sqrt(least), **dict(zip(("hue", "sat", "val"), hsv_arrays(r, g, b)))}

    known = narrow(dealt(sprites), lambda r: r.join(F.broadcast(figure.select("label", F.col("centres").alias("_centres"))), "label", "left").select(*r.columns, "_centres"))
    inputs = {"centres": F.when(_first_pixel(), F.col("_centres")), **{c: F.col(c) for c in "rgb"}}
    known = by_frame(known, inputs, work, {"strange": "double", "hue": "int", "sat": "int", "val": "int"}, drop=["_centres"])
    return known


def effect_mask(rows: DataFrame, least: int = 120, white: int = 400) -> DataFrame:
    """``rows`` (of ``with_colours``) with effect: whether a pixel is of a light effect that the figure's colours don't explain.

    Seeds are thick glows of foreign blue to violet. Bright cores and pale blue rims within 21 pixels of a seed belong to
    it, and so does pure white in parts of ``white`` pixels. The mask follows bright rims that touch it, GROWTH pixels at
    most; parts of ``least`` pixels stay, with a pixel around them.
    """

    def work(frames, a, hue, sat, val, strange):
        shown, blue = a > 0, (hue >= 80) & (hue <= 150)
        core, rim = shown & (sat < 50) & (val > 228), shown & blue & (sat > 18) & (val > 140)
        pure = shown & (sat < 25) & (val > 242)
        seed = frames.opened(shown & (strange > FOREIGN) & blue & (sat > 45) & (val > 70))
        large = pure & (frames.areas(frames.parts(pure, True)) >= white)
        begun = seed | (frames.grow(seed, 21) & (core | rim)) | large
        mask = followed(frames, begun, core | rim, GROWTH)
        return {"effect": frames.grow(mask & (frames.areas(frames.parts(mask, True)) >= least), 1)}

    return by_frame(rows, ["a", "hue", "sat", "val", "strange"], work, {"effect": "boolean"})


def clean_silhouette(rows: DataFrame, window: int = 6, spike: float = 1.08) -> DataFrame:
    """``rows`` (with alpha 0..1) plus burst (the frame has far more pixels than usual), mid (the label's median area) and outline.

    A frame bursts with more than ``spike`` times the median of its label's solid areas (alpha above a half); others are
    clean. outline is the union of the clean frames within ``window``; where there are none, of the nearest clean ones before and
    after it within four windows; null where there is no such frame, or the frame doesn't burst.
    """
    reach, parts = 4 * window, getattr(rows, "_framed", None) or -1
    chunk, bit = F.floor(F.col("x") / BITS).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x") % BITS).cast("int"))
    lines = rows.groupBy(*FRAME, "y", chunk.alias("chunk")).agg(F.bit_or(F.when(F.col("alpha") > 0.5, bit).otherwise(F.lit(0).cast("long"))).alias("bits"))
    areas = lines.groupBy(*FRAME).agg(F.sum(F.bit_count("bits")).alias("solid_area")).withColumn("mid", F.median("solid_area").over(W.partitionBy("label")))
    areas = areas.select(*FRAME, "mid", (F.col("solid_area") > F.col("mid") * spike).alias("burst"))
    line = W.partitionBy("label", "y", "chunk").orderBy("frame")
    own = lines.join(areas.hint("merge"), list(FRAME)).withColumn("own", F.when(~F.col("burst"), F.col("bits")))
    seen = own.withColumns({
        "inside": F.bit_or("own").over(line.rangeBetween(-window, window)), "left": F.last("own", ignorenulls=True).over(line.rangeBetween(-reach, -1)),
        "right": F.first("own", ignorenulls=True).over(line.rangeBetween(1, reach)),
    })
    far = F.coalesce(F.col("left").bitwiseOR(F.col("right")), "left", "right")
    facts = seen.withColumn("outline", F.when(F.col("burst"), F.coalesce("inside", far))).groupBy(*FRAME).agg(
        F.first("mid").alias("mid"), F.first("burst").alias("burst"), F.max("chunk").alias("last_chunk"), F.min("y").alias("top"),
        F.array_sort(F.collect_list(F.when(F.col("outline").isNotNull(), F.struct("y", "chunk", "outline")))).alias("outlines"),
    )
    # pixels are joined by frame; a frame's outlines go with its first pixel as a list of lines
    own_rows = rows.repartition(parts, *FRAME) if parts > 0 else rows.repartition(*FRAME)
    both = own_rows.join(facts.hint("merge"), list(FRAME))
    told = F.when((F.col("y") == F.col("top")) & (F.col("x") == 0), F.col("outlines"))
    both = dealt(both.select(*rows.columns, "mid", "burst", told.alias("_outlines")), parts if parts > 0 else None)

    def work(frames, outlines):
        frame, _, lines = _told(frames, outlines)
        y, chunk, bits = (lines.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("y", "chunk", "outline"))
        held = np.full(frames.shape, -1, np.int8)
        for k in range(min(BITS, frames.shape[2])):
            x = chunk * BITS + k
            inside = x < frames.shape[2]
            held[frame[inside], y[inside], x[inside]] = bits[inside] >> k & 1
        out = frames.flat(held)
        return {"outline": pa.array(out > 0, mask=out < 0)}

    return by_frame(both, {"outlines": F.col("_outlines")}, work, {"outline": "boolean"}, drop=["_outlines"])


def temporal_mask(rows: DataFrame, height: int, share: float = 0.08) -> DataFrame:
    """``rows`` (of ``with_colours`` and ``clean_silhouette``, bg_*) with outburst: what a bursting frame shows beyond clean frames' outlines.

    The outline grows by a disc of a share of the height (three pixels at least). Beyond it, bright, foreign or background-coloured
    pixels are candidates; within it, thick patches of plain background. Parts that don't come within two pixels of the
    outline go, and those larger than a quarter of the median area; a pixel around them too.
    """
    radius = max(3, int(share * height))

    def work(frames, outline, a, sat, val, strange, mid, **columns):
        away = rounded(Colours(**columns).far(), 6)
        known, outline = ~np.isnan(outline.astype(float)) & (a > 0), outline == 1
        odd = ((sat < 60) & (val > 170)) | (strange > FOREIGN) | (away < 40)
        wide = frames.grow_disc(outline, radius)
        candidate = (known & ~wide & odd) | frames.opened(known & wide & (away < 25), 2)
        part = frames.parts(candidate, True)
        touched = frames.of_part(part, frames.grow(wide, 2)) > 0
        return {"outburst": frames.grow(candidate & (~touched | (frames.areas(part) > 0.25 * mid)), 1)}

    return by_frame(rows, ["outline", "a", "sat", "val", "strange", "mid", *COLOURS], work, {"outburst": "boolean"})


def without_effects(rows: DataFrame, height: int, figure: DataFrame | None = None) -> DataFrame:
    """``rows`` (sprites with alpha 0..1 and bg_*) without light effects: r, g, b, a changed; taken says which pixels lost their opacity.

    Effects by colour and by outburst go together; where anything went, slivers go too; then parts that float away from
    the figure. ``figure`` are palettes, of each label's first frame if not given. All frames of a label must be there.
    """
    kept = rows.columns
    colours = with_colours(clean_silhouette(rows), character_palette(rows) if figure is None else figure)
    masked = temporal_mask(effect_mask(colours), height)
    gone = F.col("effect") | F.col("outburst")
    both = lambda frames, a, effect, outburst: {"before": a > 0, "hit": frames.most(effect | outburst)}
    hit = by_frame(masked, ["a", "effect", "outburst"], both, {"before": "boolean", "hit": "boolean"})
    whole = without_detached(without_slivers(erased(hit, gone), judged=F.col("hit")), height)
    return narrow(whole, lambda r: r.withColumn("taken", F.col("before") & (F.col("a") == 0)).select(*kept, "taken"))


def removed_counts(cleaned: DataFrame) -> DataFrame:
    """(label, frame, removed, left): how many pixels of each frame lost their opacity, and how many have some."""
    return cleaned.groupBy(*FRAME).agg(F.count_if("taken").alias("removed"), F.count_if(F.col("a") > 0).alias("remaining"))
