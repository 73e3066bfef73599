"""Two opinions on what is figure: the key's alpha and a matting model's, joined region by region; light effects; splices.

Rows are (label, frame, y, x, r, g, b, bg_r, bg_g, bg_b, alpha, model), complete grids; alpha is the key's, model the model's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.colour import lab
from framewright.operators.cutout import COLOURS, Colours, frame_alpha, reaching, with_background
from framewright.operators.raster import FRAME
from framewright.operators.regions import Frames, added, by_frame, dropped, flag, rounded

BLOB = 24


def blobs(frames: Frames, on: np.ndarray, least: int = BLOB) -> np.ndarray:
    """The part of each pixel in the mask's thick regions, else -1: opened by a square of three, corners connect, ``least`` pixels at least."""
    part = frames.parts(frames.opened(on), True)
    return np.where(frames.areas(part) >= least, part, -1)


def _luma(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 0.299 * r + 0.587 * g + 0.114 * b


def _like_shadow(frames: Frames, part: np.ndarray, r: np.ndarray, g: np.ndarray, b: np.ndarray, tone: np.ndarray) -> np.ndarray:
    """Whether a region is grey on average, and not brighter than the background, whose luma is ``tone``."""
    means = [frames.mean(part, c) for c in (r, g, b)]
    most, least = np.maximum.reduce(means), np.minimum.reduce(means)
    own = _luma(*means)
    return ((most - least) / np.maximum(most, 1.0) < 0.25) & (rounded(own, 6) <= rounded(tone + 12, 6))


def combined(rows: DataFrame, remove: str = "all", confident: float = 0.8, least: int = BLOB, spared: str | None = None) -> DataFrame:
    """``rows`` with the joined alpha, and filled and removed: how often a pixel was part of a region that was filled or taken out.

    Regions the key lost but the model sees (above 0.6 against under 0.4) are filled by the model's alpha, with two pixels
    around them, if they aren't of the background's colour (20 on average), the model is ``confident`` on average, and the
    figure is within three pixels of them. What the model is very sure of never stays half transparent. Regions the key
    kept but the model doesn't see (above 0.6 against under 0.15) go: all of them, those like a shadow, or none
    (``remove``); with all, so does every part that has no pixel within three of the model's figure. From frames where the
    column ``spared`` is true nothing goes.
    """
    if remove not in ("all", "shadow", "none"):
        raise ValueError("remove is all, shadow or none")

    def work(frames, alpha, model, **columns):
        kept = np.nan_to_num(columns.pop(spared)).astype(bool) if spared else np.zeros(len(alpha), bool)
        colours = Colours(**columns)
        far = colours.far()
        lost = blobs(frames, (model > 0.6) & (alpha < 0.4), least)
        near = frames.of_part(lost, frames.grow(alpha > 0.5, 3)) > 0
        fill = (lost >= 0) & (frames.mean(lost, far) >= 20) & (frames.mean(lost, model) >= confident) & near
        out = np.where(frames.grow(fill, 2), np.fmax(alpha, model), alpha)
        out = np.where((model > max(confident, 0.9)) & (far >= 20) & (out < model), model, out)
        removed = np.zeros(len(out), np.int32)
        if remove != "none":
            extra = blobs(frames, (alpha > 0.6) & (model < 0.15), least)
            goes = (extra >= 0) & ~kept & (_like_shadow(frames, extra, *colours.own(), _luma(*colours.back())) if remove == "shadow" else True)
            out = np.where(frames.grow(goes, 2), np.fmin(out, model), out)
            removed += goes
        if remove == "all":
            part = frames.parts(out > 0.3, True)
            loose = (part >= 0) & ~kept & (frames.of_part(part, frames.grow(model > 0.5, 3)) == 0)
            out = np.where(loose, 0.0, out)
            removed += loose
        return {"alpha": out, "filled": fill.astype(np.int32), "removed": removed}

    return by_frame(rows, [*COLOURS, "alpha", "model", *[spared] * bool(spared)], work, {"alpha": "double", "filled": "int", "removed": "int"})


def light_alpha(rows: DataFrame, height: int, width: int) -> DataFrame:
    """``rows`` with light: the alpha of light effects before a background that isn't a key colour, blurred a little.

    The larger of two ramps: how much a channel is brighter than the background's (50 to 150), and how far the colour is
    (45 to 100), which fades where the pixel is darker; nothing where it is the background's hue, only darker.
    """
    weights = reaching(0.8, height, width)

    def work(frames, **columns):
        colours = Colours(**columns)
        own, back = colours.own(), colours.back()
        up = np.clip((np.maximum.reduce([c - d for c, d in zip(own, back)]) - 50) / 100, 0.0, 1.0)
        darker = rounded(_luma(*back) - _luma(*own), 9)
        norm = lambda parts: np.sqrt(sum((c * c for c in parts), 0.0))
        same = rounded(sum((c * d for c, d in zip(own, back)), 0.0) / (norm(own) * norm(back) + 1e-6), 9) > 0.97
        apart = np.clip((colours.far() - 45) / 55, 0.0, 1.0) * np.clip(1 - (darker - 10) / 40, 0.0, 1.0)
        light = np.fmax(up, np.where(same & (darker > 6), 0.0, apart))
        return {"light": rounded(frames.blurred(light, weights, height, width), 6)}

    return by_frame(rows, COLOURS, work, {"light": "double"})


def matted(rows: DataFrame, height: int, width: int, vivid: bool = False) -> DataFrame:
    """``rows`` with the final alpha (and filled, removed): figures alone, or figures and their light effects (``vivid``).

    Vivid effects stay before a key colour, where the key cuts them well; before any other background the figure is the
    model's, and the light is cut by itself.
    """
    if not vivid:
        return combined(rows, "all")
    keyed = by_frame(rows, COLOURS, lambda frames, **columns: {"_key": Colours(**columns).key()}, {"_key": "boolean"})
    both = light_alpha(combined(keyed, "all", 0.95, spared="_key"), height, width)
    chosen = lambda frames, alpha, light, _key: {"alpha": np.where(_key, alpha, np.fmax(alpha, light))}
    return dropped(by_frame(both, ["alpha", "light", "_key"], chosen, {"alpha": "double"}), "light", "_key")


def spliced(rows: DataFrame, height: int, width: int, limit: float = 14.0) -> DataFrame:
    """``rows`` (r, g, b; edited as er, eg, eb) with r, g, b of the edit where it changed much (Lab), softly blended, else of the original."""
    gap = F.sqrt(sum(((a - b) * (a - b) for a, b in zip(lab("r", "g", "b"), lab("er", "eg", "eb"))), F.lit(0.0)))
    weights = reaching(1.5, height, width)
    work = lambda frames, changed: {"soft": frames.blurred(frames.grow(frames.opened(changed), 2), weights, height, width)}
    soft = by_frame(rows, {"changed": flag(F.round(gap, 6) > limit)}, work, {"soft": "double"})
    mixed = lambda c: F.floor(F.round(F.col(c) * (1 - F.col("soft")) + F.col(f"e{c}") * F.col("soft"), 5)).cast("int")
    return dropped(added(soft, {c: mixed(c) for c in "rgb"}), "soft")


def merged_edit(rows: DataFrame, side: int) -> DataFrame:
    """``rows`` with the splice, and the original's background colour where the edit shows background (alpha under a half)."""
    own = with_background(rows, side, side)
    own = dropped(added(own, {f"own_{c}": F.bround(f"bg_{c}").cast("int") for c in "rgb"} | {f"was_{c}": F.col(c) for c in "rgb"} | {c: F.col(f"e{c}") for c in "rgb"}), "bg_r", "bg_g", "bg_b")
    shown = frame_alpha(with_background(own, side, side), side, side)
    back = dropped(added(shown, {c: F.col(f"was_{c}") for c in "rgb"} | {"empty": F.col("alpha") < 0.5}), "alpha", "bg_r", "bg_g", "bg_b", "was_r", "was_g", "was_b")
    both = spliced(back, side, side)
    return dropped(added(both, {c: F.when(F.col("empty"), F.col(f"own_{c}")).otherwise(F.col(c)) for c in "rgb"}), "empty", "own_r", "own_g", "own_b")
