"""Palettes of many motions at once: median cut over colour histograms, refined by weighted means. No collect, no fit a group.

A histogram is (label, u, v, w, many): distinct colours in any space, with their counts. Boxes of all labels are cut in the same
round; rounds are the logarithm of the number of colours, whatever the number of labels. Where a box is cut follows from the
weights of whole steps of its longest side; only colours of the step that the half falls in are put in order, so that no
task sorts a label's colours. Cuts (a row a box) are stored and broadcast; the colours are stored once and never shuffled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.colour import lab
from framewright.scratch import stored

SPACE = ("u", "v", "w")
#: The order of a box's colours.
KEY = ("_along", *SPACE)


def histogram(sprites: DataFrame, in_lab: bool = False, above: int = 200) -> DataFrame:
    """(label, u, v, w, many): the colours of each label's pixels with opacity over ``above``, in Lab if asked."""
    counted = sprites.filter(F.col("a") > above).groupBy("label", "r", "g", "b").agg(F.count(F.lit(1)).alias("many"))
    space = lab("r", "g", "b") if in_lab else [F.col(c).cast("double") for c in "rgb"]
    return counted.select("label", *[c.alias(n) for c, n in zip(space, SPACE)], "many").groupBy("label", *SPACE).agg(F.sum("many").alias("many"))


def _sides(rows: DataFrame) -> DataFrame:
    """(label, box, side, total, worth): the number of each box's longest side (ties: the first), its weight, and weight times longest side."""
    spans = rows.groupBy("label", "box").agg(F.sum("many").alias("total"), *[(F.max(c) - F.min(c)).alias(c) for c in SPACE])
    most = F.greatest(*SPACE)
    side = F.when(F.col("u") == most, 0).when(F.col("v") == most, 1).otherwise(2)
    return spans.select("label", "box", side.alias("side"), "total", F.round(most * F.col("total"), 4).alias("worth"))


def _split(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """``rows`` with the boxes of ``sides`` cut along that side where half of the weight is reached; the upper part has an odd number.

    Other boxes keep their rows as the lower part. The first colour of a box is always in the lower part, the last of several
    in the upper one.
    """
    along = F.when(F.col("side") == 0, F.col("u")).when(F.col("side") == 1, F.col("v")).otherwise(F.col("w"))
    lined = lambda facts: rows.join(F.broadcast(facts), ["label", "box"], "left").withColumn("_along", along).withColumn("_step", F.floor("_along"))
    box = W.partitionBy("label", "box")
    steps = lined(sides.select("label", "box", "side")).filter("side is not null").groupBy("label", "box", "_step").agg(F.sum("many").alias("many"))
    until = F.sum("many").over(box.orderBy("_step"))
    weighed = steps.withColumns({"_until": until, "_low": F.min("_step").over(box), "_high": F.max("_step").over(box)}).join(F.broadcast(sides), ["label", "box"])
    # the step in which the half is reached; those below it are low, those above it high
    at = weighed.filter((2 * F.col("_until") >= F.col("total")) & (2 * (F.col("_until") - F.col("many")) < F.col("total")))
    at = stored(at.select("label", "box", "side", "total", F.col("_step").alias("_at"), (F.col("_until") - F.col("many")).alias("_below"), (F.col("_step") == F.col("_low")).alias("_first"), (F.col("_step") == F.col("_high")).alias("_last")), "palette-steps")
    order = box.orderBy(*KEY)
    near = lined(at).filter(F.col("_step") == F.col("_at")).withColumns({
        "_before": F.col("_below") + F.sum("many").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("many"), "_next": F.lead("many").over(order), "_n": F.row_number().over(order),
    })
    high = ~(F.col("_first") & (F.col("_n") == 1)) & ((2 * F.col("_before") >= F.col("total")) | (F.col("_last") & F.col("_next").isNull()))
    bounds = near.filter(high).groupBy("label", "box").agg(F.min(F.struct(*KEY)).alias("_bound"))
    cuts = stored(at.join(bounds, ["label", "box"], "left").select("label", "box", "side", "_at", "_bound"), "palette-cuts")
    upper = (F.col("_step") > F.col("_at")) | ((F.col("_step") == F.col("_at")) & (F.struct(*KEY) >= F.col("_bound")))
    return lined(cuts).select("label", *SPACE, "many", (F.col("box") * 2 + F.coalesce(upper, F.lit(False)).cast("int")).alias("box"))


def _centres(boxed: DataFrame) -> DataFrame:
    """(label, centres): the weighted mean of each box, in the boxes' order."""
    whole = lambda c: F.round(F.col(c) * 10000).cast("long")  # noqa: E731  ten-thousandths: their sums don't depend on the order
    means = [(F.floor(F.sum(whole(c) * F.col("many")) * 100 / F.sum("many") + 0.5) / 1000000).alias(c) for c in SPACE]
    each = boxed.groupBy("label", "box").agg(*means)
    return each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("box", *SPACE))).alias("c")).select("label", F.transform("c", lambda x: F.struct(*[x[n].alias(n) for n in SPACE])).alias("centres"))


def gap(c: Column) -> Column:
    """The squared distance of the colour u, v, w from a centre."""
    return sum(((c[n] - F.col(n)) * (c[n] - F.col(n)) for n in SPACE), F.lit(0.0))


def nearest(colours: DataFrame, centres: DataFrame) -> DataFrame:
    """``colours`` (label, u, v, w, ..) with near struct<d, k>: the squared distance to the nearest centre of the label, and its number.

    Of equally near centres the first counts; without centres it is null.
    """
    least = F.array_min(F.transform("centres", lambda c, k: F.struct(gap(c).alias("d"), k.alias("k"))))
    return colours.join(F.broadcast(centres), "label", "left").withColumn("near", least).drop("centres")


def palettes(colours: DataFrame, k: int = 24, rounds: int = 2) -> DataFrame:
    """(label, centres array<struct<u, v, w>>): ``k`` colours at most for each label of a histogram.

    Boxes are cut in halves of weight until there are ``k``; where that isn't a power of two, the boxes with the largest
    weight times longest side are cut once more (ties: the first). Boxes of one colour stay. ``rounds`` rounds then move each
    centre to the mean of the colours that are nearest to it; a centre that none is nearest to goes. Coordinates have four decimals.
    """
    colours = stored(colours, "palette-colours")
    rows, depth = colours.withColumn("box", F.lit(0)), k.bit_length() - 1
    for _ in range(depth):
        rows = _split(rows, stored(_sides(rows), "palette-sides"))
    if k > 1 << depth:
        rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("worth"), "box"))
        rows = _split(rows, stored(_sides(rows).withColumn("_rank", rank).filter(F.col("_rank") <= k - (1 << depth)).drop("_rank"), "palette-sides"))
    centres = stored(_centres(rows), "palette-centres")
    for _ in range(rounds):
        centres = stored(_centres(nearest(colours, centres).withColumn("box", F.col("near.k"))), "palette-centres")
    return centres
