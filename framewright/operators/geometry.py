"""Placing figures: first frames, redrawn cells, preview grids; rules over colours of regions, mask sets and joint names; new ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators.directions import CELL
from framewright.operators.raster import is_key

#: Preview cells (column, row) of four and of two directions; eight use the sheet's own cells.
CROSS = {"N": (1, 0), "W": (0, 1), "E": (2, 1), "S": (1, 2)}
PAIR = {"W": (0, 0), "E": (1, 0)}


def first_frames(figures: DataFrame, width: int = 640, height: int = 640, share: float = 0.72, margin: float = 0.12, most: float = 0.08, spread: float = 1.15) -> DataFrame:
    """(key, dir, scale, width, height, x, y) of (key, dir, w, h, body): how each figure of a sheet is scaled and where it is pasted.

    One scale makes the median height a share of the frame. Body heights (null or 0: as it is) are evened with their median
    within ``most``, unless the tallest is over ``spread`` times the shortest. Feet stand on one line, figures in the middle.
    """
    of_key = W.partitionBy("key")
    figures = figures.withColumn("body", F.nullif("body", F.lit(0)))
    scale = share * height / F.median("h").over(of_key)
    even = F.greatest(F.lit(1 - most), F.least(F.lit(1 + most), F.median("body").over(of_key) / F.col("body")))
    alike = F.max("body").over(of_key) <= spread * F.min("body").over(of_key)
    k = scale * F.when(F.col("body").isNull() | ~alike, 1.0).otherwise(even)
    feet = height - round(margin * height)
    sized = figures.select("key", "dir", F.round(k, 9).alias("scale"), "w", "h")
    side = lambda c: F.greatest(F.lit(1), F.bround(F.round(F.col(c) * F.col("scale"), 6)).cast("int"))
    placed = sized.select("key", "dir", F.round("scale", 6).alias("scale"), side("w").alias("width"), side("h").alias("height"))
    return placed.select("*", F.floor((width - F.col("width")) / 2).cast("int").alias("x"), (feet - F.col("height")).alias("y"))


def redrawn(cells: DataFrame) -> DataFrame:
    """(key, dir, x0, y0, x1, y1, width, height, x, y) of (key, dir, sheet_w, sheet_h, left, top, right, bottom, new_w, new_h): where a redrawn figure goes.

    The cell of a 3 x 3 sheet, and in it the new figure as tall as the old one (last row less first), its lowest row and
    its middle where the old ones were; without an old figure three quarters of the cell, at nine tenths, in the middle.
    """
    at = lambda i: F.element_at(F.create_map(*[F.lit(x) for d, c in CELL.items() for x in (d, c[i])]), F.col("dir"))
    edge = lambda n, size: F.floor(n * F.col(size) / 3).cast("int")
    box = cells.select("*", edge(at(0), "sheet_w").alias("x0"), edge(at(1), "sheet_h").alias("y0"), edge(at(0) + 1, "sheet_w").alias("x1"), edge(at(1) + 1, "sheet_h").alias("y1"))
    wide, tall = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    old = F.coalesce((F.col("bottom") - F.col("top")).cast("double"), 0.75 * tall)
    low, middle = F.coalesce(F.col("bottom").cast("double"), 0.9 * tall), F.coalesce((F.col("left") + F.col("right")) / 2, wide / 2)
    k = old / F.col("new_h")
    side = lambda c: F.greatest(F.lit(1), F.bround(F.round(F.col(c) * k, 6)).cast("int"))
    sized = box.select("key", "dir", "x0", "y0", "x1", "y1", side("new_w").alias("width"), side("new_h").alias("height"), low.alias("low"), middle.alias("middle"))
    return sized.select(
        "key", "dir", "x0", "y0", "x1", "y1", "width", "height", F.floor(F.round(F.col("middle") - F.col("width") / 2, 6)).cast("int").alias("x"), F.floor(F.round(F.col("low") - F.col("height"), 6)).cast("int").alias("y")
    )


def preview_places(spark: SparkSession) -> DataFrame:
    """(count, dir, column, row, columns, rows): the preview grid of each direction set."""
    rows = [(n, d, c, r, 1 + max(x for x, _ in g.values()), 1 + max(y for _, y in g.values())) for n, g in ((8, CELL), (4, CROSS), (2, PAIR)) for d, (c, r) in g.items()]
    return spark.createDataFrame(rows, "count int, dir string, column int, row int, columns int, rows int")


def preview(sheets: DataFrame, gap: int = 8) -> DataFrame:
    """(key, dir, x, y, width, height) of (key, count, dir, w, h): where a direction's cell goes in the preview, and the preview's size."""
    grid = F.broadcast(preview_places(sheets.sparkSession))
    whole = lambda n, s: F.col(n) * F.col(s) + (F.col(n) - 1) * gap
    return sheets.join(grid, ["count", "dir"]).select(
        "key", "dir", (F.col("column") * (F.col("w") + gap)).alias("x"), (F.col("row") * (F.col("h") + gap)).alias("y"), whole("columns", "w").alias("width"), whole("rows", "h").alias("height")
    )


def shadow_like(regions: DataFrame) -> DataFrame:
    """(key, shadow) of a region's pixels (key, r, g, b, back_r, back_g, back_b): hardly any colour, and not brighter than the background."""
    grey = lambda p: 0.299 * F.col(p + "r") + 0.587 * F.col(p + "g") + 0.114 * F.col(p + "b")
    mean = regions.groupBy("key").agg(*[F.avg(c).alias(c) for c in ("r", "g", "b", "back_r", "back_g", "back_b")])
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return mean.select("key", (((most - least) / F.greatest(most, F.lit(1.0)) < 0.25) & (grey("") <= grey("back_") + 12)).alias("shadow"))


def matte_policy(effects: Column, r: Column, g: Column, b: Column) -> Column:
    """struct<mode, fill, light>: what is taken out beside the figure (all or none), how sure a filled hole must be, whether light is keyed apart."""
    policy = lambda mode, fill, light: F.struct(F.lit(mode).alias("mode"), F.lit(fill).alias("fill"), F.lit(light).alias("light"))
    plain = policy("all", None, False)
    return F.when(effects != "vivid", plain).when(is_key(r, g, b), policy("none", 0.95, False)).otherwise(policy("all", 0.95, True))


def joint_map(wanted: DataFrame, joints: DataFrame) -> DataFrame:
    """``wanted`` (part, place, name) with joint: the index of the body's joint of that name, 0 where it has none."""
    own = joints.groupBy("name").agg(F.max("joint").alias("joint"))
    return wanted.join(own, "name", "left").select("part", "place", F.coalesce("joint", F.lit(0)).alias("joint"))


def either(*masks: DataFrame) -> DataFrame:
    """Positions (key, y, x) that one mask or another has."""
    out = masks[0]
    for mask in masks[1:]:
        out = out.union(mask)
    return out.distinct()


def new_ids(rows: DataFrame, at: Column) -> DataFrame:
    """``rows`` with new ids: project (pYYYYMMDD- and 6 hex digits), motion and version (time and 4 or 3), job (10)."""
    hexes = lambda n: F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, n)
    stamp = F.date_format(at, "MMddHHmmss")
    return rows.withColumns({
        "project_id": F.concat(F.lit("p"), F.date_format(at, "yyyyMMdd"), F.lit("-"), hexes(6)), "motion_id": F.concat(F.lit("m"), stamp, hexes(4)),
        "version_id": F.concat(F.lit("v"), stamp, hexes(3)), "job_id": F.concat(F.lit("j"), hexes(10)),
    })
