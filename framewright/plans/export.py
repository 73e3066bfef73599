"""Registered queries of the direction and export operators: orders as motions, line items as sheet cells, customers as projects."""

from __future__ import annotations

from framewright.operators import directions as dirs_op
from framewright.operators import export as op
from framewright.operators.layout import rects
from framewright.plans.layout import RECT
from framewright.sources.tables import cells, table
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Directions of line numbers 1 to 7.
NAMES = dirs_op.ORDERS[8][:7]
CELLS = f"""{RECT}, cel AS (SELECT key, 'sheet_' || key || '.png' AS image, CAST(6 + key % 18 AS INT) AS fps, key % 2 = 0 AS loop, w / 2.0::DOUBLE AS pivot_x, h - 3.5::DOUBLE AS pivot_y, dir AS ord,
  ({NAMES!r})[dir] AS dir, slot, x, y, w, h FROM rect)"""
MOTION = f"""{CELLS}, mo AS (SELECT DISTINCT o_custkey AS project, key, w AS frame_w, h AS frame_h, pivot_x, pivot_y, key % 3 = 0 AS pixel FROM cel JOIN orders ON o_orderkey = key)"""
DIRS = """mot AS (SELECT o_orderkey AS key, ([8, 4, 2])[o_custkey % 3 + 1] AS count, o_orderkey % 2 = 0 AS mirror FROM orders),
 dim(count, dirs) AS (VALUES (8, ['S', 'SW', 'W', 'NW', 'N', 'NE', 'E', 'SE']), (4, ['S', 'W', 'N', 'E']), (2, ['W', 'E'])),
 dr AS (SELECT key, unnest(range(len(dirs))) AS ord, unnest(dirs) AS dir, mirror FROM mot JOIN dim USING (count)),
 di AS (SELECT key, ord, dir, NOT (mirror AND dir IN ('W', 'SW', 'NW')) AS made, CASE WHEN mirror AND dir IN ('W', 'SW', 'NW') THEN replace(dir, 'W', 'E') END AS flip_of FROM dr)"""
SHARES = """sha AS (SELECT l_suppkey AS key, (['S', 'SW', 'W', 'NW', 'N', 'NE', 'E', 'SE'])[(l_linenumber + l_partkey) % 8 + 1] AS dir, round(avg(l_discount) * 10, 6) AS share FROM lineitem GROUP BY ALL)"""


def sheet_cells(spark, folder):
    rows = rects(cells(spark, folder))
    return rows.select(
        "key", F.concat(F.lit("sheet_"), F.col("key").cast("string"), F.lit(".png")).alias("image"), (6 + F.col("key") % 18).cast("int").alias("fps"), (F.col("key") % 2 == 0).alias("loop"),
        (F.col("w") / 2).alias("pivot_x"), (F.col("h") - 3.5).alias("pivot_y"), F.col("dir").alias("ord"), F.element_at(F.array(*map(F.lit, NAMES)), F.col("dir")).alias("dir"), "slot", "x", "y", "w", "h",
    )


def _motions(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("created"))
    sized = sheet_cells(spark, folder).select("key", F.col("w").alias("frame_w"), F.col("h").alias("frame_h"), "pivot_x", "pivot_y").distinct()
    return sized.join(orders, "key").withColumn("pixel", F.col("key") % 3 == 0)


def _merged(spark, folder):
    common = op.common_cells(_motions(spark, folder))
    margin = F.concat_ws(", ", *[F.col(c).cast("string") for c in ("left", "top", "more_w", "more_h")])
    placed = common.select("project", "key", margin.alias("margin"), (F.row_number().over(op.W.partitionBy("project").orderBy("key")) - 1).alias("k"))
    return op.resources(sheet_cells(spark, folder).join(placed, "key").withColumn("prefix", F.concat(F.lit("m"), F.col("key").cast("string"))))


def _single(spark, folder):
    return op.resources(sheet_cells(spark, folder).withColumnsRenamed({"key": "project"}).withColumns({"k": F.lit(0), "prefix": F.lit(""), "margin": F.lit(None).cast("string")})).withColumnRenamed("project", "key")


def _scenes(spark, folder):
    first = sheet_cells(spark, folder).groupBy("key").agg(F.min(F.struct("ord", "dir"))["dir"].alias("first"))
    named = _motions(spark, folder).join(first, "key").withColumn("name", F.concat(F.lit("m"), F.col("key").cast("string")))
    return op.scenes(named.withColumn("resource", F.concat("name", F.lit(".tres"))))


def _literals(spark, folder):
    parts = table(spark, folder, "part")
    value = F.struct(
        (F.col("p_size") % 2 == 0).alias("even"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit('say "'), F.col("p_name"), F.lit('"'))).alias("name"),
        F.array(F.col("p_size") / 4, F.lit(0.0)).alias("list"),
    )
    kind = T.StructType([T.StructField("even", T.BooleanType()), T.StructField("size", T.IntegerType()), T.StructField("price", T.DoubleType()), T.StructField("name", T.StringType()), T.StructField("list", T.ArrayType(T.DoubleType()))])
    return parts.select("p_partkey", op.literal(value, kind).alias("text"))


def _archive(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("motion"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("created"), F.lower(F.substring("o_orderpriority", 3, 9)).alias("key"))
    files = op.frame_paths(sheet_cells(spark, folder)).select(F.col("key").alias("motion"), "path")
    return op.archive_paths(files.join(orders, "motion")).groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"), F.max("path").alias("last"), F.count_distinct("path").alias("paths"))


def _dirs(spark, folder):
    count = F.element_at(F.array(F.lit(8), F.lit(4), F.lit(2)), (F.col("o_custkey") % 3 + 1).cast("int"))
    return dirs_op.of_motions(table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), count.alias("count"), (F.col("o_orderkey") % 2 == 0).alias("mirror")))


def _plans(spark, folder):
    listed = lambda c: F.array_join(c, ",").alias(c)
    return dirs_op.plans(_dirs(spark, folder)).select("key", listed("output"), listed("made"))


def _facing(spark, folder):
    names = F.array(*map(F.lit, dirs_op.ORDERS[8]))
    at = ((F.col("l_linenumber") + F.col("l_partkey")) % 8 + 1).cast("int")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.element_at(names, at).alias("dir"))
    return dirs_op.facing_problems(lines.agg(F.round(F.avg("l_discount") * 10, 6).alias("share")))


QUERIES = {
    "dim_directions": _dirs,
    "dim_master": lambda s, d: dirs_op.master(_dirs(s, d)),
    "dim_plan_view": _plans,
    "dir_facing": _facing,
    "dir_items": lambda s, d: _dirs(s, d).filter("made").select("key", "dir", F.explode(dirs_op.result_items(F.col("dir"))).alias("path")),
    "exp_document": lambda s, d: op.frame_documents(sheet_cells(s, d)),
    "exp_resource": _single,
    "exp_scene": _scenes,
    "exp_literal": _literals,
    "exp_frame_paths": lambda s, d: op.frame_paths(sheet_cells(s, d)),
    "exp_files": lambda s, d: op.motion_files(sheet_cells(s, d)),
    "exp_common_cells": lambda s, d: op.common_cells(_motions(s, d)),
    "exp_merged_resource": _merged,
    "exp_archive": _archive,
}
_SUB = """'[sub_resource type="AtlasTexture" id="' || id || '"]' || chr(10) || 'atlas = ExtResource("' || (k + 1) || '_tex")' || chr(10) || 'region = Rect2(' || x || ', ' || y || ', ' || w || ', ' || h || ')' || margin"""
_RESOURCE = f"""id AS (SELECT *, 'AtlasTexture_' || k || '_' || dir || '_' || slot AS id FROM src),
 pd AS (SELECT project, k, ord, string_agg({_SUB}, chr(10) || chr(10) ORDER BY slot) AS subs, count(*) AS n, any_value('[ext_resource type="Texture2D" path="' || image || '" id="' || (k + 1) || '_tex"]') AS ext,
   '{{"frames": [' || string_agg('{{"duration": 1.0, "texture": SubResource("' || id || '")}}', ', ' ORDER BY slot) || '], "loop": ' || any_value(loop) || ', "name": &"' || any_value(prefix || dir) || '", "speed": ' || any_value(fps::DOUBLE) || '}}' AS animation
   FROM id GROUP BY project, k, ord),
 ex AS (SELECT project, string_agg(ext, chr(10) || chr(10) ORDER BY k) AS exts, count(*) AS n FROM (SELECT DISTINCT project, k, ext FROM pd) GROUP BY project),
 al AS (SELECT project, string_agg(subs, chr(10) || chr(10) ORDER BY k, ord) AS subs, sum(n) AS n, string_agg(animation, ', ' ORDER BY k, ord) AS animations FROM pd GROUP BY project),
 txt AS (SELECT project, '[gd_resource type="SpriteFrames" load_steps=' || CAST(al.n + ex.n + 1 AS BIGINT) || ' format=3]' || chr(10) || chr(10) || exts || chr(10) || chr(10) || subs || chr(10) || chr(10)
   || '[resource]' || chr(10) || 'animations = [' || animations || ']' || chr(10) AS text FROM al JOIN ex USING (project))"""
_COMMON = """com AS (SELECT project, key, CAST(round_even(l + r, 0) AS INT) AS width, CAST(round_even(t + b, 0) AS INT) AS height, CAST(round_even(l, 0) AS INT) AS pivot_x, CAST(round_even(t, 0) AS INT) AS pivot_y,
   CAST(round_even(l - px, 0) AS INT) AS "left", CAST(round_even(t - py, 0) AS INT) AS top, CAST(round_even(l + r, 0) AS INT) - frame_w AS more_w, CAST(round_even(t + b, 0) AS INT) - frame_h AS more_h
   FROM (SELECT project, key, frame_w, frame_h, pivot_x AS px, pivot_y AS py, max(pivot_x) OVER w AS l, max(pivot_y) OVER w AS t, max(frame_w - pivot_x) OVER w AS r, max(frame_h - pivot_y) OVER w AS b FROM mo WINDOW w AS (PARTITION BY project)))"""
ORACLES = {
    "dim_directions": f"WITH {DIRS} SELECT key, ord, dir, made, flip_of FROM di",
    "dim_master": f"WITH {DIRS} SELECT key, (min({{'p': coalesce(nullif(list_position(['E', 'SE', 'W', 'SW', 'S'], dir), 0), 6), 'o': ord, 'd': dir}})).d AS dir FROM di WHERE made GROUP BY key",
    "dim_plan_view": f"WITH {DIRS} SELECT key, string_agg(dir, ',' ORDER BY ord) AS output, coalesce(string_agg(dir, ',' ORDER BY ord) FILTER (made), '') AS made FROM di GROUP BY key",
    "dir_facing": f"""WITH {SHARES}, wd AS (SELECT key, max(share) FILTER (dir = 'NE') AS ne, max(share) FILTER (dir = 'NW') AS nw, max(share) FILTER (dir = 'SE') AS se, max(share) FILTER (dir = 'SW') AS sw FROM sha
   GROUP BY key HAVING count(*) FILTER (dir IN ('N', 'S')) >= 2), rf AS (SELECT *, coalesce(greatest(se, sw), 1) AS ref FROM wd)
SELECT key, 'NE' AS dir, 'front' AS looks FROM rf WHERE ref >= 0.5 AND (ne >= 0.75 * ref OR ne >= 0.8) UNION ALL SELECT key, 'NW', 'front' FROM rf WHERE ref >= 0.5 AND (nw >= 0.75 * ref OR nw >= 0.8)
UNION ALL SELECT key, 'SE', 'back' FROM rf WHERE se < 0.35 UNION ALL SELECT key, 'SW', 'back' FROM rf WHERE sw < 0.35""",
    "dir_items": f"WITH {DIRS} SELECT key, dir, unnest(['frames/' || dir, 'ai/' || dir, 'raw/' || dir || '.webp', 'first/' || dir || '.png', 'first/' || dir || '.prompt.txt', 'mannequin_' || dir || '.mp4']) AS path FROM di WHERE made",
    "exp_document": f"""WITH {CELLS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, slot) - 1 AS i, '{{"x":' || round(pivot_x / w, 4) || ',"y":' || round(pivot_y / h, 4) || '}}' AS pv FROM cel),
 f AS (SELECT *, '"' || i || '":{{"frame":{{"x":' || x || ',"y":' || y || ',"w":' || w || ',"h":' || h || '}},"rotated":false,"trimmed":false,"spriteSourceSize":{{"x":0,"y":0,"w":' || w || ',"h":' || h || '}},"sourceSize":{{"w":' || w || ',"h":' || h
   || '}},"duration":' || CAST(round_even(1000.0::DOUBLE / fps, 0) AS INT) || ',"pivot":' || pv || ',"anchor":' || pv || '}}' AS f FROM n),
 d AS (SELECT key, ord, any_value('"' || dir || '":[') || string_agg('"' || i || '"', ',' ORDER BY i) || ']' AS a,
   any_value('{{"name":"' || dir || '","from":') || min(i) || ',"to":' || max(i) || ',"direction":"forward"' || any_value(CASE WHEN loop THEN '' ELSE ',"repeat":"1"' END) || '}}' AS tag FROM n GROUP BY key, ord),
 a AS (SELECT key, string_agg(a, ',' ORDER BY ord) AS a, string_agg(tag, ',' ORDER BY ord) AS tags FROM d GROUP BY key),
 g AS (SELECT key, string_agg(f, ',' ORDER BY i) AS f, max(x + w) AS r, max(y + h) AS b, any_value(image) AS image, any_value(loop) AS loop, any_value(fps) AS fps, any_value(pivot_x) AS px, any_value(pivot_y) AS py FROM f GROUP BY key)
SELECT key, '{{"frames":{{' || f || '}},"animations":{{' || a || '}},"meta":{{"app":"framewright","version":"1.0","image":"' || image || '","format":"RGBA8888","size":{{"w":' || r || ',"h":' || b || '}},"scale":"1","frameTags":[' || tags
 || '],"loop":' || loop || ',"fps":' || fps || ',"pivot":[' || px || ',' || py || ']}}}}' AS json FROM g JOIN a USING (key)""",
    "exp_resource": f"WITH {CELLS}, src AS (SELECT *, key AS project, 0 AS k, '' AS prefix, '' AS margin FROM cel), {_RESOURCE} SELECT project AS key, text FROM txt",
    "exp_scene": f"""WITH {MOTION}, fi AS (SELECT key, (min({{'o': ord, 'd': dir}})).d AS first FROM cel GROUP BY key)
SELECT key, '[gd_scene load_steps=2 format=3]' || chr(10) || chr(10) || '[ext_resource type="SpriteFrames" path="m' || key || '.tres" id="1_frames"]' || chr(10) || chr(10) || '[node name="m' || key || '" type="AnimatedSprite2D"]' || chr(10)
 || CASE WHEN pixel THEN 'texture_filter = 1' || chr(10) ELSE '' END || 'sprite_frames = ExtResource("1_frames")' || chr(10) || 'animation = &"' || first || '"' || chr(10) || 'autoplay = "' || first || '"' || chr(10)
 || 'offset = Vector2(' || format('{{:.1f}}', frame_w / 2.0::DOUBLE - pivot_x) || ', ' || format('{{:.1f}}', frame_h / 2.0::DOUBLE - pivot_y) || ')' || chr(10) AS text FROM mo JOIN fi USING (key)""",
    "exp_literal": """SELECT p_partkey, '{"even": ' || (p_size % 2 = 0) || ', "size": ' || p_size || ', "price": ' || printf('%g', p_retailprice) || ', "name": '
 || CASE WHEN p_partkey % 3 > 0 THEN '"say \\"' || p_name || '\\""' ELSE 'null' END || ', "list": [' || printf('%g', p_size / 4.0::DOUBLE) || ', 0]}' AS text FROM part""",
    "exp_frame_paths": f"WITH {CELLS} SELECT key, 'frames/hd/' || dir || '/' || dir || printf('_%02d.png', slot) AS path, x, y, w, h FROM cel",
    "exp_files": f"""WITH {CELLS} SELECT key, 'frames/hd/' || dir || '/' || dir || printf('_%02d.png', slot) AS path FROM cel
UNION ALL SELECT key, unnest([key || '_aseprite.json', 'godot/' || image, 'godot/' || key || '.tres', 'godot/' || key || '.tscn', 'usage.txt']) FROM (SELECT DISTINCT key, image FROM cel)""",
    "exp_common_cells": f"WITH {MOTION}, {_COMMON} SELECT * FROM com",
    "exp_merged_resource": f"""WITH {MOTION}, {_COMMON}, nk AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY key) - 1 AS k FROM com),
 src AS (SELECT cel.*, project, k, 'm' || key || '_' AS prefix, chr(10) || 'margin = Rect2(' || "left" || ', ' || top || ', ' || more_w || ', ' || more_h || ')' AS margin FROM cel JOIN nk USING (key)), {_RESOURCE} SELECT * FROM txt""",
    "exp_archive": f"""WITH {CELLS}, nm AS (SELECT o_orderkey AS motion, o_custkey AS project, lower(substr(o_orderpriority, 3, 9)) AS name, row_number() OVER (PARTITION BY o_custkey, lower(substr(o_orderpriority, 3, 9)) ORDER BY o_orderdate, o_orderkey) AS n
   FROM orders WHERE o_orderkey IN (SELECT key FROM cel)), pt AS (SELECT project, name || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END || '/frames/hd/' || dir || '/' || dir || printf('_%02d.png', slot) AS path FROM cel JOIN nm ON motion = key)
SELECT project, count(*) AS files, min(path) AS first, max(path) AS last, count(DISTINCT path) AS paths FROM pt GROUP BY project""",
}
