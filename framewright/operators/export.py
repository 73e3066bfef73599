"""Engine files of sheets: frame documents, resource and scene texts, frame paths, one resource for several motions.

``cells`` has (key, image, fps, loop, pivot_x, pivot_y, ord, dir, slot, x, y, w, h): a row per cell, directions by ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.documents import unique_keys


def frame_documents(cells: DataFrame, app: str = "framewright") -> DataFrame:
    """(key, json): frames by running number, animations by direction, and sheet metadata with a tag per direction.

    A motion that isn't a loop repeats its tags once; the pivot is a share of the cell, 4 decimals.
    """
    order = W.partitionBy("key").orderBy("ord", "slot")
    pivot = F.struct(F.round(F.col("pivot_x") / F.col("w"), 4).alias("x"), F.round(F.col("pivot_y") / F.col("h"), 4).alias("y"))
    size = F.struct("w", "h")
    frame = F.struct(
        F.struct("x", "y", "w", "h").alias("frame"), F.lit(False).alias("rotated"), F.lit(False).alias("trimmed"),
        F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), "w", "h").alias("spriteSourceSize"), size.alias("sourceSize"),
        F.bround(1000 / F.col("fps")).cast("int").alias("duration"), pivot.alias("pivot"), pivot.alias("anchor"),
    )
    numbered = cells.withColumn("i", F.row_number().over(order) - 1).withColumn("frame", frame)
    per_dir = numbered.groupBy("key", "ord", "dir").agg(
        F.array_sort(F.collect_list(F.struct("i", F.col("frame").alias("f")))).alias("rows"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"),
        *[F.first(c).alias(c) for c in ("image", "fps", "loop", "pivot_x", "pivot_y")],
    )
    tag = F.struct(
        F.col("dir").alias("name"), F.array_min("rows.i").alias("from"), F.array_max("rows.i").alias("to"), F.lit("forward").alias("direction"), F.when(~F.col("loop"), "1").alias("repeat")
    )
    whole = per_dir.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("ord", "dir", "rows", tag.alias("tag")))).alias("d"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        *[F.first(c).alias(c) for c in ("image", "fps", "loop", "pivot_x", "pivot_y")],
    )
    named = lambda r: F.struct(r["i"].cast("string").alias("k"), r["f"].alias("v"))
    frames = F.map_from_entries(F.transform(F.flatten("d.rows"), named))
    animations = F.map_from_entries(F.transform("d", lambda d: F.struct(d["dir"], F.transform(d["rows"], lambda r: r["i"].cast("string")))))
    meta = F.struct(
        F.lit(app).alias("app"), F.lit("1.0").alias("version"), "image", F.lit("RGBA8888").alias("format"), F.struct(F.col("right").alias("w"), F.col("bottom").alias("h")).alias("size"),
        F.lit("1").alias("scale"), F.col("d.tag").alias("frameTags"), "loop", "fps", F.array("pivot_x", "pivot_y").alias("pivot"),
    )
    return whole.select("key", F.to_json(F.struct(frames.alias("frames"), animations.alias("animations"), meta.alias("meta"))).alias("json"))


def number(value: Column) -> Column:
    """A number in up to six significant digits, without trailing zeros, as %g prints it between 0.0001 and a million."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(value)))).cast("int")
    scaled = F.bround(value * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    plain = F.regexp_replace(F.format_string("%.9f", scaled), r"\.?0+$", "")
    return F.when(value == 0, "0").otherwise(plain)


def literal(value: Column, kind: T.DataType) -> Column:
    """A column of any type as the text of a resource literal: booleans, numbers, quoted strings, lists, dictionaries, null."""
    if isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(value.cast("double"))
    elif isinstance(kind, T.StringType):
        text = F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: literal(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}": '), literal(value[f.name], f.dataType)) for f in kind.fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(literal(e["key"].cast("string"), T.StringType()), F.lit(": "), literal(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(value), entry), ", "), F.lit("}"))
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(text)


def resources(cells: DataFrame) -> DataFrame:
    """(project, text): one resource text a project, from cells with project, k (the motion's place), prefix and margin.

    Animations are named by direction, or prefix_direction; ``margin`` (text, or null) goes with every region.
    """
    tex = F.concat((F.col("k") + 1).cast("string"), F.lit("_tex"))
    region_id = F.concat_ws("_", F.lit("AtlasTexture"), F.col("k").cast("string"), "dir", F.col("slot").cast("string"))
    margin = F.coalesce(F.concat(F.lit("\nmargin = Rect2("), F.col("margin"), F.lit(")")), F.lit(""))
    sub = F.concat(
        F.lit('[sub_resource type="AtlasTexture" id="'), region_id, F.lit('"]\natlas = ExtResource("'), tex, F.lit('")\nregion = '), F.format_string("Rect2(%d, %d, %d, %d)", "x", "y", "w", "h"), margin
    )
    frame = F.concat(F.lit('{"duration": 1.0, "texture": SubResource("'), region_id, F.lit('")}'))
    ext = F.concat(F.lit('[ext_resource type="Texture2D" path="'), F.col("image"), F.lit('" id="'), tex, F.lit('"]'))
    name = F.when(F.col("prefix") == "", F.col("dir")).otherwise(F.concat_ws("_", "prefix", "dir"))
    per_dir = cells.withColumn("sub", sub).withColumn("frame", frame).withColumn("ext", ext).withColumn("name", name).groupBy("project", "k", "ord").agg(
        F.array_sort(F.collect_list(F.struct("slot", "sub", "frame"))).alias("s"), *[F.first(c).alias(c) for c in ("ext", "name", "loop", "fps")]
    )
    animation = F.concat(
        F.lit('{"frames": ['), F.array_join("s.frame", ", "), F.lit('], "loop": '), F.col("loop").cast("string"), F.lit(', "name": &"'), F.col("name"), F.lit('", "speed": '),
        F.col("fps").cast("double").cast("string"), F.lit("}"),
    )
    rows = per_dir.select("project", F.struct("k", "ord", "ext", F.col("s.sub").alias("subs"), animation.alias("animation")).alias("r"))
    whole = rows.groupBy("project").agg(F.array_sort(F.collect_list("r")).alias("r"))
    exts, subs = F.array_distinct("r.ext"), F.flatten("r.subs")
    head = F.format_string('[gd_resource type="SpriteFrames" load_steps=%d format=3]', F.size(exts) + F.size(subs) + 1)
    last = F.concat(F.lit("[resource]\nanimations = ["), F.array_join("r.animation", ", "), F.lit("]"))
    return whole.select("project", F.concat(F.array_join(F.concat(F.array(head), exts, subs, F.array(last)), "\n\n"), F.lit("\n")).alias("text"))


def scenes(motions: DataFrame) -> DataFrame:
    """(key, text): scene texts of (key, name, resource, first, frame_w, frame_h, pivot_x, pivot_y, pixel); the pivot is the node's origin."""
    text = F.concat_ws(
        "\n", F.lit("[gd_scene load_steps=2 format=3]"), F.lit(""), F.format_string('[ext_resource type="SpriteFrames" path="%s" id="1_frames"]', "resource"), F.lit(""),
        F.format_string('[node name="%s" type="AnimatedSprite2D"]', "name"), F.when(F.col("pixel"), "texture_filter = 1"), F.lit('sprite_frames = ExtResource("1_frames")'),
        F.format_string('animation = &"%s"', "first"), F.format_string('autoplay = "%s"', "first"),
        F.format_string("offset = Vector2(%.1f, %.1f)", F.col("frame_w") / 2 - F.col("pivot_x"), F.col("frame_h") / 2 - F.col("pivot_y")), F.lit(""),
    )
    return motions.select("key", text.alias("text"))


def frame_paths(cells: DataFrame, res: str = "hd") -> DataFrame:
    """(key, path, x, y, w, h): where each cell's own image goes, and its rectangle in the sheet."""
    path = F.concat(F.lit(f"frames/{res}/"), F.col("dir"), F.lit("/"), F.col("dir"), F.format_string("_%02d.png", "slot"))
    return cells.select("key", path.alias("path"), "x", "y", "w", "h")


def motion_files(cells: DataFrame, res: str = "hd") -> DataFrame:
    """(key, path): all engine files of each motion: document, image, resource, scene, frames and the usage note."""
    tag = "" if res == "hd" else f"_{res}"
    heads = cells.select("key", "image").distinct()
    name = F.concat(F.col("key").cast("string"), F.lit(tag))
    fixed = [
        F.concat(name, F.lit("_aseprite.json")), F.concat(F.lit("godot/"), F.col("image")), F.concat(F.lit("godot/"), name, F.lit(".tres")), F.concat(F.lit("godot/"), name, F.lit(".tscn")), F.lit("usage.txt"),
    ]
    return heads.select("key", F.explode(F.array(*fixed)).alias("path")).unionByName(frame_paths(cells, res).select("key", "path"))


def common_cells(motions: DataFrame) -> DataFrame:
    """(project, key, width, height, pivot_x, pivot_y, left, top, more_w, more_h) of (project, key, frame_w, frame_h, pivot_x, pivot_y).

    One cell for all motions of a project, with every pivot at the same place; margins say how each cell lies in it.
    """
    of_project = W.partitionBy("project")
    left, top = F.max("pivot_x").over(of_project), F.max("pivot_y").over(of_project)
    right, bottom = F.max(F.col("frame_w") - F.col("pivot_x")).over(of_project), F.max(F.col("frame_h") - F.col("pivot_y")).over(of_project)
    whole = lambda v: F.bround(v).cast("int")
    return motions.select(
        "project", "key", whole(left + right).alias("width"), whole(top + bottom).alias("height"), whole(left).alias("pivot_x"), whole(top).alias("pivot_y"),
        whole(left - F.col("pivot_x")).alias("left"), whole(top - F.col("pivot_y")).alias("top"), (whole(left + right) - F.col("frame_w")).alias("more_w"), (whole(top + bottom) - F.col("frame_h")).alias("more_h"),
    )


def archive_paths(files: DataFrame) -> DataFrame:
    """(project, path) of (project, motion, created, key, path): files under their motion's key; a taken key gets the next free number."""
    motions = files.select("project", "motion", "created", "key").distinct()
    at = W.partitionBy("project").orderBy("created", "motion", "key")
    placed = motions.select("project", "motion", "created", "key", (F.row_number().over(at) - 1).alias("place"))
    named = placed.join(unique_keys(motions, "project", ["created", "motion"], "key"), ["project", "place"]).select("project", "motion", F.col("name").alias("folder"))
    return files.join(named, ["project", "motion"]).select("project", F.concat_ws("/", "folder", "path").alias("path"))
