"""Colour spaces as column expressions, and the same over arrays: 8-bit Lab and HSV of 0..255 channels, as image libraries scale them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lab(r: str, g: str, b: str) -> list[Column]:
    """CIE Lab of sRGB under D65, scaled to 0..255: lightness times 2.55, the others moved by 128; 4 decimals."""

    def linear(c: str) -> Column:
        v = F.col(c) / 255.0
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    def bent(v: Column) -> Column:
        return F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16.0 / 116)

    lr, lg, lb = linear(r), linear(g), linear(b)
    fx = bent((0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456)
    fy = bent(0.212671 * lr + 0.715160 * lg + 0.072169 * lb)
    fz = bent((0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754)
    return [F.round((116 * fy - 16) * 2.55, 4), F.round(500 * (fx - fy) + 128, 4), F.round(200 * (fy - fz) + 128, 4)]


def hsv(r: str, g: str, b: str) -> list[Column]:
    """Hue in half degrees (0 to 179), saturation and value in 0..255, as whole numbers."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    span = most - least
    turn = F.when(span == 0, 0.0).when(most == F.col(r), 30.0 * (F.col(g) - F.col(b)) / span)
    turn = turn.when(most == F.col(g), 60 + 30.0 * (F.col(b) - F.col(r)) / span).otherwise(120 + 30.0 * (F.col(r) - F.col(g)) / span)
    hue = F.pmod(F.floor(F.round(turn, 6) + 0.5), F.lit(180)).cast("int")
    saturation = F.when(most == 0, 0).otherwise(F.floor(F.round(255.0 * span / most, 6) + 0.5)).cast("int")
    return [hue, saturation, most]


def lab_arrays(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """``lab`` over arrays of whole numbers from 0 to 255."""
    v = np.arange(256) / 255.0
    linear = np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)
    bent = lambda v: np.where(v > 0.008856, np.cbrt(v), 7.787 * v + 16.0 / 116)
    digits = lambda v: np.floor(v * 10000 + 0.5) / 10000
    lr, lg, lb = linear[r], linear[g], linear[b]
    fx = bent((0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456)
    fy = bent(0.212671 * lr + 0.715160 * lg + 0.072169 * lb)
    fz = bent((0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754)
    return [digits((116 * fy - 16) * 2.55), digits(500 * (fx - fy) + 128), digits(200 * (fy - fz) + 128)]


def hsv_arrays(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """``hsv`` over arrays."""
    most, least = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = np.maximum(most - least, 1)
    turn = np.where(most == r, 30.0 * (g - b) / span, np.where(most == g, 60 + 30.0 * (b - r) / span, 120 + 30.0 * (r - g) / span))
    half = lambda v: np.floor(np.floor(v * 1e6 + 0.5) / 1e6 + 0.5)
    hue = np.where(most == least, 0, half(turn) % 180).astype(np.int32)
    return [hue, half(255.0 * (most - least) / np.maximum(most, 1)).astype(np.int32), most]
