"""Compass directions of a sheet: which exist, which are made, which is drawn first, and which look the wrong way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Output order of the direction sets, mirror images, and cells of the 3 x 3 sheet (column, row).
ORDERS = {8: ["S", "SW", "W", "NW", "N", "NE", "E", "SE"], 4: ["S", "W", "N", "E"], 2: ["W", "E"]}
MIRROR = {"W": "E", "SW": "SE", "NW": "NE", "E": "W", "SE": "SW", "NE": "NW"}
LEFT = ["W", "SW", "NW"]
CELL = {"NW": (0, 0), "N": (1, 0), "NE": (2, 0), "W": (0, 1), "E": (2, 1), "SW": (0, 2), "S": (1, 2), "SE": (2, 2)}
MASTER = ["E", "SE", "W", "SW", "S"]


def table(spark: SparkSession) -> DataFrame:
    """(count, ord, dir, mirror, left, column, row): the 14 rows of all direction sets."""
    rows = [(n, k, d, MIRROR.get(d), d in LEFT, *CELL[d]) for n, dirs in ORDERS.items() for k, d in enumerate(dirs)]
    return spark.createDataFrame(rows, "count int, ord int, dir string, mirror string, left boolean, column int, row int")


def of_motions(motions: DataFrame) -> DataFrame:
    """(key, ord, dir, made, flip_of): the directions of each motion (key, count, mirror), in sheet order.

    With mirroring the left side isn't made but flipped from the right. A count that has no set is an error.
    """
    known = F.when(F.col("count").isin(*ORDERS), F.col("count")).otherwise(F.raise_error(F.concat(F.lit("no direction set of "), F.coalesce(F.col("count").cast("string"), F.lit("null")))))
    dims = F.broadcast(table(motions.sparkSession))
    return motions.withColumn("count", known.cast("int")).join(dims.withColumnRenamed("mirror", "other"), "count").select(
        "key", "ord", "dir", (~F.col("mirror") | ~F.col("left")).alias("made"), F.when(F.col("mirror") & F.col("left"), F.col("other")).alias("flip_of")
    )


def master(dirs: DataFrame) -> DataFrame:
    """(key, dir): of the directions that are made the one where a motion shows best, else the first."""
    rank = F.array_position(F.array(*map(F.lit, MASTER)), F.col("dir"))
    first = F.struct(F.when(rank > 0, rank).otherwise(len(MASTER) + 1), "ord", "dir")
    return dirs.filter("made").groupBy("key").agg(F.min(first).alias("m")).select("key", F.col("m.dir").alias("dir"))


def plans(dirs: DataFrame) -> DataFrame:
    """(key, output, made): the directions of each motion in sheet order, and those that are made, as lists."""
    ordered = lambda rows: F.array_sort(F.collect_list(rows))["dir"]
    row = F.struct("ord", "dir")
    return dirs.groupBy("key").agg(ordered(row).alias("output"), ordered(F.when(F.col("made"), row)).alias("made"))


def facing_problems(shares: DataFrame) -> DataFrame:
    """(key, dir, looks) of (key, dir, share): diagonals whose share of face colours says they look the wrong way.

    A back diagonal looks front if it shows 0.75 of the front diagonals' share (where that is half or more) or 0.8 of the
    front's; a front diagonal looks back under 0.35. Keys without N and S have no verdict.
    """
    at = lambda d: F.max(F.when(F.col("dir") == d, F.col("share")))
    wide = shares.groupBy("key").agg(*[at(d).alias(d) for d in ("NE", "NW", "SE", "SW")], F.count_if(F.col("dir").isin("N", "S")).alias("poles"))
    ref = F.coalesce(F.greatest("SE", "SW"), F.lit(1.0))
    front = lambda d: (ref >= 0.5) & ((F.col(d) >= 0.75 * ref) | (F.col(d) >= 0.8))
    found = [F.when(front(d), F.struct(F.lit(d).alias("dir"), F.lit("front").alias("looks"))) for d in ("NE", "NW")]
    found += [F.when(F.col(d) < 0.35, F.struct(F.lit(d).alias("dir"), F.lit("back").alias("looks"))) for d in ("SE", "SW")]
    return wide.filter("poles >= 2").select("key", F.explode(F.array_compact(F.array(*found))).alias("p")).select("key", "p.*")


def result_items(direction: Column) -> Column:
    """The relative paths of everything that belongs to one direction of a motion."""
    shapes = ["frames/%s", "ai/%s", "raw/%s.webp", "first/%s.png", "first/%s.prompt.txt", "mannequin_%s.mp4"]
    return F.array(*[F.format_string(s, direction) for s in shapes])
