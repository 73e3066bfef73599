"""Text and rule functions as column expressions: routing, slugs, templates, phrases, clip rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs in the text, in any case; null texts have none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.greatest(*[F.contains(low, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(low, F.lit(words[0]))


def effects_route(text: Column, words: list[str]) -> Column:
    """vivid for texts that speak of effects, else none."""
    return F.when(has_any(text, words), "vivid").otherwise("none")


def is_locomotion(key: Column, loop: Column, text: Column, words: list[str]) -> Column:
    """Walking and running move; other loops do if they aren't idle and their text says so."""
    return key.isin("walk", "run") | (loop & (key != "idle") & has_any(text, words))


def slug(text: Column) -> Column:
    """A lower-case key of letters, digits and underscores that starts with a letter, else motion."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.rlike(key, F.lit("^[a-z][a-z0-9_]*$")), key).otherwise("motion")


#: Korean names of common motions, and their keys; the first that a name holds counts.
KO_KEYS = {
    "대기": "idle", "걷기": "walk", "걷": "walk", "달리기": "run", "뛰": "run", "공격": "attack", "피격": "hit", "쓰러": "death", "죽": "death", "점프": "jump",
    "춤": "dance", "문워크": "dance", "베기": "slash", "마법": "magic", "방어": "guard", "구르기": "roll", "앉": "sit", "인사": "wave",
}


def motion_key(name: Column, fixed: Column) -> Column:
    """The fixed key if there is one, else that of a Korean motion in the name, else the slug of the whole name."""
    name = F.coalesce(name, F.lit(""))
    known = F.coalesce(*[F.when(F.contains(name, F.lit(ko)), en) for ko, en in KO_KEYS.items()])
    usable = F.when(F.rlike(fixed, F.lit(r"\A[a-z][a-z0-9_]*\z")), fixed).otherwise("motion")
    return F.when(F.coalesce(fixed, F.lit("")) != "", usable).otherwise(F.coalesce(known, slug(name)))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with {{NAME}} replaced by values; unknown names stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


#: What a camera at an angle of up to 5, under 25, under 55 and more degrees is called.
CAMERAS = (
    "a fixed eye-level camera (straight horizontal view, not looking down)",
    "a fixed camera slightly above the character, looking down at about %s degrees",
    "a fixed high-angle camera looking down at the character from about %s degrees above, like the classic high quarter-view camera of isometric-style MMORPGs",
    "a fixed top-down camera looking down at the character from about %s degrees above, so the top of the head and the shoulders dominate the view",
)
#: Pixel art of so many pixels, and any other style.
STYLES = (
    "TRUE PIXEL ART game sprite: each character is about %s pixel-art pixels tall; every pixel-art pixel is a crisp square block of exactly the same size across the whole image, aligned to one grid; "
    "no anti-aliasing, no gradients, no blur, no soft edges; a limited palette of about 24 colors; a clean 1-pixel dark outline around each character; simple cel shading with 2 to 3 shades per material",
    "the same clean 2D game illustration style as the reference, with cel shading and clear dark outlines",
)


def camera_phrase(angle: Column) -> Column:
    """Words for a camera's height over the ground, in degrees, which are rounded first."""
    whole = F.bround(angle).cast("int")
    level, low, high, top = (F.format_string(c, whole.cast("string")) for c in CAMERAS)
    return F.when(whole <= 5, level).when(whole < 25, low).when(whole < 55, high).otherwise(top)


def style_phrase(style: Column, pixels: Column) -> Column:
    """Words for a drawing style; pixel art names the figure's height in pixels."""
    return F.when(style == "pixel", F.format_string(STYLES[0], pixels.cast("string"))).otherwise(STYLES[1])


def effects_of(explicit: Column, strip: Column) -> Column:
    """How light effects are treated: as asked, else stripped if flagged, else vivid."""
    return F.when(F.coalesce(explicit, F.lit("")) != "", explicit).when(strip, "strip").otherwise("vivid")


def frame_fit(oneshot: Column) -> Column:
    """struct<size, foot>: the figure's height and its feet's distance from the bottom, as shares of the picture's height."""
    size = lambda s, f: F.struct(F.lit(s).alias("size"), F.lit(f).alias("foot"))
    return F.when(oneshot, size(0.52, 0.14)).otherwise(size(0.72, 0.12))


def mannequin_elevation(angle: Column) -> Column:
    return angle * 2 / 3


def mannequin_background(setting: Column) -> Column:
    """Mid grey if set, else key magenta."""
    return F.when(setting == "gray", "#808080").otherwise("#FF00FF")


def is_valid_setting(count: Column, style: Column, pixels: Column) -> Column:
    """Whether a request's direction count, style and pixel height are allowed."""
    return F.coalesce(count.isin(2, 4, 8) & style.isin("hd", "pixel") & pixels.between(24, 160), F.lit(False))


def clip_seconds(mode: Column, loop: Column, hold: Column) -> Column:
    """Seconds of a clip: 3 for direct loops and mannequin one-shots, else 5."""
    return F.when((mode == "video") | hold, 5).when(loop & (mode == "direct"), 3).when(~loop & (mode == "mannequin"), 3).otherwise(5)


def frame_grid(seconds: Column) -> Column:
    """Frames for so many seconds: at least 5, raised to the next 17 k + 5."""
    n = F.greatest(F.lit(5), F.bround(seconds * 24).cast("int"))
    return n + F.pmod(F.lit(5) - F.pmod(n, F.lit(17)), F.lit(17))


def frame_size(stored: Column, pixel: Column, asked: Column) -> Column:
    """The stored size, else 640; pixel art rounds the asked size down to 16."""
    return F.coalesce(stored, F.when(pixel, F.floor(asked / 16).cast("int") * 16).otherwise(640))


def clamped(value: Column, least: float, most: float) -> Column:
    """The value inside its limits; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), value)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit(""))


def is_safe_name(name: Column) -> Column:
    """Whether a stored name has only small letters, digits and hyphens."""
    return F.rlike(F.coalesce(name, F.lit("")), F.lit("^[a-z0-9-]+$"))


def kept_fields(json_text: Column, names: list[str]) -> Column:
    """The fields of a flat JSON object that are in ``names``, as JSON; null texts give null."""
    fields = F.map_filter(F.from_json(json_text, "map<string,string>"), lambda k, v: k.isin(*names))
    return F.to_json(fields)
