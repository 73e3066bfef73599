"""Frames from image folders, and sheets written back as PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(folder, frame, h, w, channels, data): images under ``path`` in name order within their folder; data is BGR(A)."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    folder = F.regexp_extract("origin", "^(.*)/[^/]*$", 1)
    order = W.partitionBy("folder").orderBy("origin")
    named = images.withColumn("folder", folder)
    return named.select("folder", (F.row_number().over(order) - 1).alias("frame"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("channels"), "data")


def png(image: np.ndarray) -> bytes:
    """A PNG file of an RGB or RGBA image."""
    h, w, channels = image.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * channels)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def packed(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(label, frame, h, w, data) of a pixel table: height * width * 3 channel bytes a frame; pixels that are missing are black."""
    cell = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("at"), *[F.col(c).cast("int").alias(c) for c in "rgb"])
    rows = pixels.groupBy(F.col("label").cast("int"), F.col("frame").cast("int")).agg(F.collect_list(cell).alias("cells"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells")
            flat = cells.flatten()
            of_row = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
            data = np.zeros((batch.num_rows, height * width, 3), np.uint8)
            for k, c in enumerate("rgb"):
                data[of_row, flat.field("at").to_numpy(zero_copy_only=False), k] = flat.field(c).to_numpy(zero_copy_only=False)
            sizes = [pa.array(np.full(batch.num_rows, n, np.int32)) for n in (height, width)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("frame"), *sizes, pa.array([d.tobytes() for d in data], pa.binary())], names=["label", "frame", "h", "w", "data"])

    return rows.mapInArrow(pack, "label int, frame int, h int, w int, data binary")


def as_png(frames: DataFrame) -> DataFrame:
    """(label, frame, bytes) of packed RGB frames; write them with any binary sink."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = [png(np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, 3)) for r in batch.itertuples()]
            yield pd.DataFrame({"label": batch["label"], "frame": batch["frame"], "bytes": files})

    return frames.mapInPandas(encode, "label int, frame int, bytes binary")
