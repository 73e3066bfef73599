"""Adapters from stored tables to the engine's shapes: clips of vectors, signals, sheets of cells, pixel frames.

Every shape has explicit order columns; nothing depends on the order of files or rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators.regions import noted

#: Side of the square rasters that 64-long vectors hold.
SIDE = 8
#: Side of the pictures drawn from vectors, a square of pixels a component, and the background colours of their clips.
PICTURE = 32
#: Vectors whose pictures one task draws: a quarter of a million pixels.
PICTURES_A_TASK = 256
#: Vectors whose small frames one task draws: as many pixels.
FRAMES_A_TASK = 4096
#: Line items of one task, whose sheets' windows and lists are then sorted in memory.
CELLS_A_TASK = 100_000
BACKGROUNDS = [(250, 6, 248), (20, 220, 30), (128, 128, 128)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """(label, frame, e array<double>, n): a clip per label, frames from 0 by vec_id, n frames in the clip."""
    vectors = table(spark, folder, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    order = W.partitionBy("label").orderBy("vec_id")
    return vectors.select(
        "label", (F.row_number().over(order) - 1).alias("frame"), "e", F.count(F.lit(1)).over(W.partitionBy("label")).alias("n")
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, frame, value, event_type, n): a signal per user, frames from 0 by (ts, event_id)."""
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value", "event_type")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        "user_id", (F.row_number().over(order) - 1).alias("frame"), "value", "event_type",
        F.count(F.lit(1)).over(W.partitionBy("user_id")).alias("n"),
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """(key, dir, slot, w, h): a sheet per order, a direction per line number, slots from 0 within it.

    Narrow lines are dealt by order once, so that what is made of sheets isn't shuffled again; a task's lines don't grow with
    the table, which is counted for that.
    """
    lines = table(spark, folder, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // CELLS_A_TASK))
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax").repartition(parts, "l_orderkey")
    order = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    return lines.select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("dir"), (F.row_number().over(order) - 1).alias("slot"),
        (16 + F.col("l_partkey") % 48).cast("int").alias("w"), (16 + F.col("l_suppkey") % 48).cast("int").alias("h"),
    )


def pixels(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """(label, frame, y, x, r, g, b): each vector as a square frame; three neighbouring values give a pixel's channels.

    Vectors stay with their label, or are dealt over tasks by frame before they are drawn; the table is counted for that.
    """
    e = F.col("e")
    channel = lambda shift: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 700 * F.element_at(e, ((F.col("pos") + shift) % (SIDE * SIDE) + 1).cast("int"))))).cast("int")
    frames = clips(spark, folder)
    if dealt:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, folder, "embeddings").count() // FRAMES_A_TASK))
        frames = frames.select("label", "frame", "e").repartition(parts, "label", "frame")
    spread = frames.select("label", "frame", "e", F.posexplode("e").alias("pos", "v"))
    return spread.select(
        "label", "frame", F.floor(F.col("pos") / SIDE).cast("int").alias("y"), (F.col("pos") % SIDE).cast("int").alias("x"),
        channel(0).alias("r"), channel(21).alias("g"), channel(42).alias("b"),
    )


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(label, frame, y, x, r, g, b, a, model): each vector as a picture of figures on a magenta, green or grey background.

    A component is a square of four pixels; its value decides between figure, shade and background, with ragged edges.
    Other components give the colours (some squares are glowing blue or white), a is the opacity of a sprite (0 to 255),
    and model (0 to 1) is what a matting model might see. Vectors are dealt over tasks by frame before they are drawn, so pixels
    aren't shuffled for it, and the pixels of a task don't grow with the table; it is counted for that.
    """
    unit = PICTURE // SIDE
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, folder, "embeddings").count() // PICTURES_A_TASK))
    frames = clips(spark, folder).select("label", "frame", "e").repartition(parts, "label", "frame").sortWithinPartitions("label", "frame")
    whole = frames.select("label", "frame", "e", F.explode(F.sequence(F.lit(0), F.lit(PICTURE * PICTURE - 1))).alias("p"))
    at = whole.select("label", "frame", "e", F.floor(F.col("p") / PICTURE).cast("int").alias("y"), (F.col("p") % PICTURE).cast("int").alias("x"))
    by, bx = F.floor(F.col("y") / unit).cast("int"), F.floor(F.col("x") / unit).cast("int")
    at = at.withColumns({"c": by * SIDE + bx, "j": ((F.col("y") * 7 + F.col("x") * 13 + F.col("frame") * 5) % 9 - 4).cast("int")})
    rim = (F.least(by, bx) == 0) | (F.greatest(by, bx) == SIDE - 1)
    near = lambda shift: F.element_at("e", ((F.col("c") + shift) % (SIDE * SIDE) + 1).cast("int"))
    value = near(0) - F.when(rim, 0.1).otherwise(0.0)
    at = at.withColumns({"v": value, "glow": near(11), "back": (F.col("label") % 3).cast("int")})
    figure, shade = F.col("v") + 0.0075 * F.col("j") > 0.02, F.col("v") > -0.04
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")

    def channel(k: int, shift: int) -> F.Column:
        back = F.when(F.col("back") == 0, BACKGROUNDS[0][k]).when(F.col("back") == 1, BACKGROUNDS[1][k]).otherwise(BACKGROUNDS[2][k])
        own = F.when(F.col("glow") > 0.2, (90, 150, 250)[k] + 2 * F.col("j")).when(F.col("glow") < -0.2, 247 + 2 * F.col("j")).otherwise(F.floor(128 + 700 * near(shift)) + F.col("j"))
        flat = F.when(F.col("j") == 4, 1).when(F.col("j") == -4, -1).otherwise(0)
        return byte(F.when(figure, own).when(shade, back - 15 + F.col("j")).otherwise(back + flat))

    drawn = at.select(
        "label", "frame", "y", "x", channel(0, 5).alias("r"), channel(1, 21).alias("g"), channel(2, 42).alias("b"),
        F.when(figure, 255).when(shade, 40 + 5 * F.col("j")).otherwise(0).cast("int").alias("a"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 4 * F.col("v") + 1.5 * near(33))), 6).alias("model"),
    )
    return noted(drawn, parts)
