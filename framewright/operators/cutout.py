"""Cutting figures out of their background: alphas from grey and key backgrounds, refined edges, distances, blurs, finished sprites.

Pixel tables are (label, frame, y, x, r, g, b, ..), complete grids of known size. An alpha is a column 0..1. An operator is
one kernel (``by_frame``), what looks at a pixel alone too, so that a chain of operators streams through in one pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.raster import FRAME
from framewright.operators.regions import Frames, by_frame, dropped, flag, rounded

#: The ramp of distances from a plain background: nothing below, everything above.
RAMP = (12.0, 40.0)
#: The ramp of keyness against the border's: figure below, background above.
KEY_RAMP = (0.2, 0.6)


#: The columns of a pixel's colour and its background's.
COLOURS = ["r", "g", "b", "bg_r", "bg_g", "bg_b"]


def with_background(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """``pixels`` with bg_r, bg_g, bg_b: the median colour of their frame's border lines, corners counted twice."""
    work = lambda frames, **colours: {f"bg_{c}": frames.border_middle(v, height, width) for c, v in colours.items()}
    return by_frame(pixels, list("rgb"), work, {f"bg_{c}": "double" for c in "rgb"})


@dataclass
class Colours:
    """Colours of pixels and their backgrounds in kernels."""

    r: np.ndarray
    g: np.ndarray
    b: np.ndarray
    bg_r: np.ndarray
    bg_g: np.ndarray
    bg_b: np.ndarray

    def own(self) -> list[np.ndarray]:
        return [self.r, self.g, self.b]

    def back(self) -> list[np.ndarray]:
        return [self.bg_r, self.bg_g, self.bg_b]

    def far(self) -> np.ndarray:
        """How far a pixel's colour is from the background's."""
        return rounded(np.sqrt(sum(((c - d) * (c - d) for c, d in zip(self.own(), self.back())), 0.0)), 9)

    def green(self) -> np.ndarray:
        return self.bg_g - np.maximum(self.bg_r, self.bg_b) > 50

    def key(self) -> np.ndarray:
        """Whether the background is a key colour: magenta, or green."""
        return (np.minimum(self.bg_r, self.bg_b) - self.bg_g > 80) | self.green()

    def keyness(self) -> np.ndarray:
        return np.where(self.green(), self.g - np.maximum(self.r, self.b), np.minimum(self.r, self.b) - self.g)

    def clean(self, alpha: np.ndarray) -> list[np.ndarray]:
        """The colours without what shines through of the background."""
        return [_byte((c - (1 - alpha) * d) / np.fmax(alpha, 0.05)) for c, d in zip(self.own(), self.back())]


def _byte(v: np.ndarray) -> np.ndarray:
    """A value cut to 0..255, its fraction dropped."""
    return np.floor(rounded(np.clip(v, 0.0, 255.0), 5))


#: Least pixels and least share of the largest part that a part needs to be no blot, and how far it reaches: plain, key.
BLOTS = ((50, 0.02, 2), (30, 0.002, 3))


def _alpha(rows: DataFrame, keyed: bool | None, height: int, width: int, ramp: tuple[float, float], key_ramp: tuple[float, float]) -> DataFrame:
    """``rows`` plus alpha: by ``key_ramp`` in ``keyed`` frames (None: those before a key colour), by ``ramp`` in others; far blots are empty, frames without a solid pixel stay."""
    (low, high), (key_low, key_high) = ramp, key_ramp

    def work(frames, **columns):
        colours = Colours(**columns)
        far = colours.far()
        key = colours.key() if keyed is None else np.full(len(far), keyed)
        near = frames.parts(~key & (far < high))
        outside = frames.of_part(near, frames.border(height, width)) > 0
        m = colours.keyness() / 255.0
        level = np.maximum(0.2, frames.border_middle(m, height, width))
        by_key = rounded(1 - np.clip((m / level - key_low) / (key_high - key_low), 0.0, 1.0), 9)
        alpha = np.where(key, by_key, np.where(outside, np.clip((far - low) / (high - low), 0.0, 1.0), 1.0))
        area = frames.areas(frames.parts(alpha > 0.5, True))
        most = frames.most(area)
        stays = most == 0
        for (least, share, halo), own in zip(BLOTS, (~key, key)):
            if own.any():
                stays |= frames.grow(own & (area > 0) & (area >= np.maximum(least, share * most)), halo)
        return {"alpha": np.where(stays, alpha, 0.0)}

    return by_frame(rows, COLOURS, work, {"alpha": "double"})


def plain_alpha(rows: DataFrame, height: int, width: int, ramp: tuple[float, float] = RAMP) -> DataFrame:
    """``rows`` (with bg_r, bg_g, bg_b) plus alpha against a plain background.

    Only what is near the background and connected with the border (by sides) fades, along the ramp; what the figure
    encloses stays opaque. Small parts are blots: under 50 pixels, or 2 % of the largest, and away from larger ones.
    """
    return _alpha(rows, False, height, width, ramp, KEY_RAMP)


def chroma_alpha(rows: DataFrame, height: int, width: int, ramp: tuple[float, float] = KEY_RAMP) -> DataFrame:
    """``rows`` (with bg_r, bg_g, bg_b) plus alpha against a magenta or green background.

    Alpha falls along the ramp of keyness against the border's median (corners twice, 0.2 at least). Parts of under 30
    pixels, or 0.2 % of the largest, are blots.
    """
    return _alpha(rows, True, height, width, RAMP, ramp)


def frame_alpha(rows: DataFrame, height: int, width: int) -> DataFrame:
    """``rows`` plus alpha: by key colour where the frame's background is one, else by distance."""
    return _alpha(rows, None, height, width, RAMP, KEY_RAMP)


def drawing_alpha(rows: DataFrame, height: int, width: int, near: float = 5.0, least: int = 40, flat: float = 2.5) -> DataFrame:
    """``rows`` plus alpha of a drawing: as against a plain background, and enclosed gaps of flat background colour are empty too.

    A gap is opaque so far, within ``near`` of the background, has ``least`` pixels connected by sides, and is ``flat`` on average.
    """

    def work(frames, alpha, **columns):
        far = Colours(**columns).far()
        part = frames.parts((far < near) & (alpha > 0.5))
        gap = (part >= 0) & (frames.areas(part) >= least) & (frames.mean(part, far, 9) < flat)
        return {"alpha": np.where(gap, 0.0, alpha)}

    return by_frame(plain_alpha(rows, height, width), [*COLOURS, "alpha"], work, {"alpha": "double"})


def gauss(sigma: float, whole: bool = False) -> list[float]:
    """Weights of a normal curve at whole steps from its middle on; four deviations on either side, three for ``whole`` numbers."""
    size = round(sigma * (3 if whole else 4) * 2 + 1) | 1
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(size // 2 + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [w / total for w in raw]


def blurred(pixels: DataFrame, named: dict[str, Column], sigma: float, height: int, width: int) -> DataFrame:
    """``pixels`` with each of ``named`` blurred: weighted sums along rows, then columns; beyond the border the frame is mirrored.

    The border itself isn't doubled; for this the frame must be larger than the reach of the curve.
    """
    weights = reaching(sigma, height, width)
    work = lambda frames, **values: {c: frames.blurred(v, weights, height, width) for c, v in values.items()}
    return by_frame(pixels, named, work, {c: "double" for c in named})


def reaching(sigma: float, height: int, width: int) -> list[float]:
    """The weights of a blur, if frames are larger than its reach."""
    weights = gauss(sigma)
    if min(height, width) < len(weights):
        raise ValueError(f"frames must be larger than {len(weights) - 1} pixels")
    return weights


def refined(rows: DataFrame, height: int, width: int, band: int = 2) -> DataFrame:
    """``rows`` (r, g, b, bg_*, alpha) with edges solved anew: r, g, b become doubles.

    The outer ``band`` pixels of the figure lie somewhere between the background and the blurred colour of the figure
    further in: that place is their alpha (it only falls), the inner colour their colour. Pixels with hardly any figure
    near (a weight up to 0.02), and where the inner colour is like the background's (within 20), stay as they are.
    """
    weights = reaching(band + 0.8, height, width)

    def work(frames, alpha, **columns):
        new, alpha = _refined(frames, Colours(**columns), alpha, weights, band)
        return {**dict(zip("rgb", new)), "alpha": alpha}

    return by_frame(rows, [*COLOURS, "alpha"], work, {c: "double" for c in (*"rgb", "alpha")})


def _refined(frames: Frames, colours: Colours, alpha: np.ndarray, weights: list[float], band: int) -> tuple[list[np.ndarray], np.ndarray]:
    core = frames.shrink(alpha > 0.5, band)
    blur = lambda v: frames.blurred(v * core, weights, frames.shape[1], frames.shape[2])
    weight = blur(np.ones(len(core)))
    inner = [rounded(blur(c) / np.maximum(weight, 1e-4), 6) for c in colours.own()]
    step = [i - d for i, d in zip(inner, colours.back())]
    length = rounded(sum((s * s for s in step), 0.0), 6)
    along = np.clip(sum(((c - d) * s for c, d, s in zip(colours.own(), colours.back(), step)), 0.0) / np.maximum(length, 1.0), 0.0, 1.0)
    ok = (alpha > 0.5) & ~core & (rounded(weight, 9) > 0.02) & (length > 400)
    return [np.where(ok, i, c) for i, c in zip(inner, colours.own())], np.where(ok, rounded(np.minimum(alpha, along), 9), alpha)


def _packed(colours: list[np.ndarray], alpha: np.ndarray) -> dict[str, np.ndarray]:
    """r, g, b and a (0..255, half to even) for alpha, and no colour where that is 0; null where alpha is."""
    a = np.rint(rounded(alpha * 255, 6))
    return {**{c: np.where(a > 0, v, 0) for c, v in zip("rgb", colours)}, "a": a}


def cutouts(rows: DataFrame, height: int, width: int, band: int = 2) -> DataFrame:
    """``rows`` (r, g, b, bg_*, alpha) as sprites (.., r, g, b, a): refined edges, and the background's tint taken out.

    Before a key colour the edges are refined, then its spill is taken from the colours; else what shines through is
    taken out first, and the edges are refined after it.
    """
    weights = reaching(band + 0.8, height, width)
    work = lambda frames, alpha, **columns: _cut(frames, Colours(**columns), alpha, weights, band)
    return dropped(by_frame(rows, [*COLOURS, "alpha"], work, {c: "int" for c in "rgba"}), "alpha")


def _cut(frames: Frames, colours: Colours, alpha: np.ndarray, weights: list[float], band: int) -> dict[str, np.ndarray]:
    key, green = colours.key(), colours.green()
    base = [np.where(key | (alpha <= 0.05), c, v) for c, v in zip(colours.own(), colours.clean(alpha))]
    new, alpha = _refined(frames, Colours(*base, *colours.back()), alpha, weights, band)
    r, g, b = (_byte(c) for c in new)
    pink, lime = np.where(key & ~green, np.maximum(0, np.minimum(r, b) - g), 0), np.where(key & green, np.maximum(0, g - np.maximum(r, b)), 0)
    return _packed([r - pink, g - lime, b - pink], alpha)


def distances(pixels: DataFrame, name: str, on: Column, most: int) -> DataFrame:
    """``pixels`` with the exact distance ``name`` to the nearest pixel outside the mask, if that is at most ``most``, else null.

    First the nearest outside pixel of each column, up and down; then the least of the parabolas of the columns within ``most``.
    """
    return by_frame(pixels, {"on": flag(on)}, lambda frames, on: {name: _distances(frames, on, most)}, {name: "double"})


def _distances(frames: Frames, on: np.ndarray, most: int) -> np.ndarray:
    never = np.int64(1) << 40
    outside = ~frames.grid(on, True)
    y = np.arange(frames.shape[1])[None, :, None]
    above = y - np.maximum.accumulate(np.where(outside, y, -never), axis=1)
    below = np.minimum.accumulate(np.where(outside, y, never)[:, ::-1], axis=1)[:, ::-1] - y
    gap = np.minimum(np.minimum(above, below), 1 << 20) ** 2
    square = gap.copy()
    for k in range(1, min(most, frames.shape[2] - 1) + 1):
        np.minimum(square[:, :, k:], gap[:, :, :-k] + k * k, out=square[:, :, k:])
        np.minimum(square[:, :, :-k], gap[:, :, k:] + k * k, out=square[:, :, :-k])
    square = frames.flat(square)
    return np.where(square <= most * most, np.sqrt(square), np.nan)


def finished(rows: DataFrame, height: int, width: int, band: int = 3) -> DataFrame:
    """Sprites of ``rows`` (r, g, b, bg_*, alpha); before a green background, what lies deeper than ``band`` pixels keeps its own colour.

    Deep: opaque (0.99) and farther than ``band`` from every pixel under a half; so green figures don't turn grey inside.
    """
    weights = reaching(2.8, height, width)

    def work(frames, alpha, **columns):
        colours = Colours(**columns)
        deep = np.isnan(_distances(frames, alpha >= 0.5, band)) & (alpha >= 0.99) & colours.green()
        new = _cut(frames, colours, alpha, weights, 2)
        return new | {c: np.where(deep, own, new[c]) for c, own in zip("rgb", colours.own())}

    return dropped(by_frame(rows, [*COLOURS, "alpha"], work, {c: "int" for c in "rgba"}), "alpha")


def loaded_reference(rows: DataFrame, height: int, width: int) -> DataFrame:
    """(label, frame, y, x, r, g, b, a): drawings on a plain background, cut out and moved to their bounding box (alpha above 0.1)."""

    def work(frames, alpha, **columns):
        colours, shown, ends = Colours(**columns), alpha > 0.1, {}
        for c, v in (("y", frames.y), ("x", frames.x)):
            ends |= {f"low_{c}": frames.least(np.where(shown, v, 1 << 20)), f"high_{c}": frames.most(np.where(shown, v, -1))}
        clean = [np.where(alpha > 0.05, v, c) for c, v in zip(colours.own(), colours.clean(alpha))]
        return ends | _packed(clean, alpha)

    ends = {f"{k}_{c}": "long" for c in "yx" for k in ("low", "high")}
    cut = by_frame(plain_alpha(rows, height, width), [*COLOURS, "alpha"], work, ends | {c: "int" for c in "rgba"})
    boxed = cut.filter(F.col("y").between(F.col("low_y"), F.col("high_y")) & F.col("x").between(F.col("low_x"), F.col("high_x")))
    return boxed.select(*FRAME, (F.col("y") - F.col("low_y")).cast("int").alias("y"), (F.col("x") - F.col("low_x")).cast("int").alias("x"), "r", "g", "b", "a")
