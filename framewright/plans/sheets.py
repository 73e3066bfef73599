"""Registered queries of sheet assembly: embeddings as clips of five directions, suppliers and orders as reports."""

from __future__ import annotations

from framewright.operators import raster
from framewright.operators import sheets as op
from framewright.plans.raster import BOX
from framewright.plans.sequence import _loop_sql
from framewright.sources.tables import SIDE, clips, pixels, table
from pyspark.sql import functions as F

MADE = ["S", "SE", "E", "NE", "N"]
#: Two motions of five made directions each: labels 0 to 4 and 5 to 9.
NAMES_SQL = f"nm AS (SELECT l // 5 AS key, ({MADE!r})[l % 5 + 1] AS dir, l AS label FROM (SELECT unnest(range(10)) AS l))"
ORDER_SQL = """dr AS (SELECT key, unnest(range(8)) AS ord, unnest(['S', 'SW', 'W', 'NW', 'N', 'NE', 'E', 'SE']) AS dir FROM (SELECT unnest([0, 1]) AS key)),
 so2 AS (SELECT *, CASE WHEN dir IN ('SW', 'W', 'NW') THEN replace(dir, 'W', 'E') ELSE dir END AS source FROM dr)"""
CROP = """cr AS (SELECT key, greatest(0, round_even(4 - hw, 0))::INT AS x0, greatest(0, y0 - 0)::INT AS y0, least(8, round_even(4 + hw, 0))::INT AS x1, least(8, greatest(y1, 7))::INT AS y1
  FROM (SELECT key, greatest(4 - min(x0), max(x1) - 4)::DOUBLE AS hw, min(y0) AS y0, max(y1) AS y1 FROM us GROUP BY key))"""
REPORTS = """rp AS (SELECT l_suppkey AS key, (['S', 'SW', 'W', 'NW', 'N', 'NE', 'E', 'SE'])[(l_linenumber + l_partkey) % 8 + 1] AS dir, count(*) AS n, round(avg(l_quantity) / 8, 4) AS stance, round(max(l_discount) * 400, 4) AS step,
  10 + min(l_linenumber) AS period, min(l_quantity)::INT AS peak FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY ALL)"""


def _names(spark):
    names = F.array(*map(F.lit, MADE))
    return spark.range(10).select(
        F.floor(F.col("id") / 5).alias("key"), F.lit(8).alias("count"), F.lit(True).alias("mirror"), F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("dir"), F.col("id").cast("int").alias("label")
    )


def _assembled(spark, folder):
    names = _names(spark)
    sizes = names.select("key").distinct().select("key", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(7).alias("feet"))
    return op.assembled(clips(spark, folder), raster.boxes(pixels(spark, folder), SIDE), names, sizes)


def _crop(spark, folder):
    boxes = raster.boxes(pixels(spark, folder), SIDE).withColumnRenamed("label", "key")
    sizes = boxes.select("key").distinct().select("key", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), (5 + F.col("key") % 3).alias("feet"))
    return op.common_crop(boxes, sizes)


def reports(spark, folder):
    names = F.array(*map(F.lit, ["S", "SW", "W", "NW", "N", "NE", "E", "SE"]))
    at = ((F.col("l_linenumber") + F.col("l_partkey")) % 8 + 1).cast("int")
    lines = table(spark, folder, "lineitem").filter("l_partkey % 3 > 0").groupBy(F.col("l_suppkey").alias("key"), F.element_at(names, at).alias("dir"))
    return lines.agg(
        F.round(F.avg("l_quantity") / 8, 4).alias("stance"), F.round(F.max("l_discount") * 400, 4).alias("step"), (10 + F.min("l_linenumber")).alias("period"), F.min("l_quantity").cast("int").alias("peak")
    )


def _hits(spark, folder):
    order = F.array(*map(F.lit, ["S", "SW", "W", "NW", "N", "NE", "E", "SE"]))
    picks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i * 7 + F.col("key") % 5).cast("int"))
    out = op.hit_frames(reports(spark, folder).select("key", F.array_position(order, F.col("dir")).alias("ord"), "dir", picks.alias("picks"), "peak"))
    return out.select("key", "hit_frame", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["dir"], h["hit"].cast("string"))), ",").alias("hits"))


def _speeds(spark, folder):
    some = reports(spark, folder).withColumn("stance", F.when(F.col("key") % 4 > 0, F.col("stance"))).withColumn("step", F.when(F.col("key") % 5 > 0, F.col("step")))
    scales = some.select("key").distinct().select("key", F.lit(0.5).alias("scale"), (1 + F.col("key") % 3 / 4).alias("move_scale"))
    return op.move_speeds(some, scales)


def _meta(spark, folder):
    order = F.array(*map(F.lit, ["S", "SE", "NW"]))
    meta = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 7 > 0, F.round(F.abs("s_acctbal") / 100, 1)).alias("move_speed_auto"), F.lit(0.5).alias("ground"), order.alias("order"),
        (6 + F.col("s_suppkey") % 18).cast("double").alias("fps"),
    )
    return meta


def _listed(df):
    return df.withColumn("velocity", F.array_join(F.transform("velocity", lambda m: F.concat_ws(":", m["dir"], m["v"]["x"].cast("string"), m["v"]["y"].cast("string"))), ","))


def _retimed(spark, folder):
    meta = _meta(spark, folder)
    moved = op.rescaled(meta, F.lit(1.0)).select("key", "move_speed", "velocity")
    whole = meta.join(moved, "key", "left").withColumn("frame_ms", F.when(F.col("key") % 3 > 0, 1000 / F.col("fps")))
    return _listed(op.retimed(whole, F.col("fps") * 1.5))


def _span(spark, folder):
    orders = table(spark, folder, "orders")
    picks = op.shared_span((F.col("o_orderkey") % 20).cast("int"), (1 + F.col("o_custkey") % 60).cast("int"), 8)
    return orders.select("o_orderkey", F.array_join(picks, ",").alias("picks"))


QUERIES = {
    "assemble_sheet": _assembled,
    "lay_crop": _crop,
    "game_hit_frames": _hits,
    "game_move_speed": _speeds,
    "game_rescaled": lambda s, d: _listed(op.rescaled(_meta(s, d), 1 + F.col("key") % 5 / 4)),
    "game_retimed": _retimed,
    "pick_shared_span": _span,
}
_META = """mt AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 7 > 0 THEN round(abs(s_acctbal) / 100, 1) END AS auto, (6 + s_suppkey % 18)::DOUBLE AS fps FROM supplier)"""
_ONE = "(round_even(round({}, 6), 1) + 0.0::DOUBLE)"


def _moves(speed: str) -> str:
    parts = [f"'{d}:' || {_ONE.format(f'{speed} * cos(radians({a}::DOUBLE))')} || ':' || {_ONE.format(f'{speed} * sin(radians({a}::DOUBLE)) * 0.5')}" for d, a in (("S", 90), ("SE", 45), ("NW", 225))]
    return " || ',' || ".join(parts)


def _again(speed: str) -> str:
    parts = []
    for d, a in (("S", 90), ("SE", 45), ("NW", 225)):
        x, y = _ONE.format(f"{speed} * cos(radians({a}::DOUBLE))"), _ONE.format(f"{speed} * sin(radians({a}::DOUBLE)) * 0.5")
        parts.append(f"'{d}:' || {_ONE.format(f'{x} * 1.5')} || ':' || {_ONE.format(f'{y} * 1.5')}")
    return " || ',' || ".join(parts)


ORACLES = {
    "assemble_sheet": f"""WITH pick AS ({_loop_sql()}), {BOX}, {NAMES_SQL}, {ORDER_SQL}, md AS (SELECT nm.key, nm.dir, nm.label, slot, pick AS frame, fps FROM nm JOIN pick USING (label)),
 us AS (SELECT key, x0, y0, x1, y1 FROM md JOIN bx USING (label, frame)), {CROP},
 pd AS (SELECT key, dir, count(*) AS n, any_value(fps) AS fps FROM md GROUP BY key, dir), rt AS (SELECT key, min(n) AS n, round(avg(fps), 6) AS fps FROM pd GROUP BY key)
SELECT so2.key, ord, so2.dir, slot, label, frame, so2.dir <> source AS flip, slot * (x1 - x0) AS x, ord * (y1 - y0) AS y, x1 - x0 AS w, y1 - y0 AS h, rt.fps, 4.0::DOUBLE - x0 AS pivot_x, 7.0::DOUBLE - y0 AS pivot_y
FROM so2 JOIN md ON md.key = so2.key AND md.dir = source JOIN rt ON rt.key = so2.key JOIN cr ON cr.key = so2.key WHERE slot < n""",
    "lay_crop": f"""WITH {BOX}, c AS (SELECT label AS key, 5 + label % 3 AS feet, greatest(4 - min(x0), max(x1) - 4)::DOUBLE AS hw, min(y0) AS y0, max(y1) AS y1 FROM bx GROUP BY label),
 r AS (SELECT key, feet, greatest(0, round_even(4 - hw, 0))::INT AS x0, y0, least(8, round_even(4 + hw, 0))::INT AS x1, least(8, greatest(y1, feet)) AS y1 FROM c) SELECT key, x0, y0, x1, y1, 4.0::DOUBLE - x0 AS pivot_x, feet - y0 AS pivot_y FROM r""",
    "game_hit_frames": f"""WITH {REPORTS}, h AS (SELECT key, dir, list_position(['S', 'SW', 'W', 'NW', 'N', 'NE', 'E', 'SE'], dir) AS ord, (list_min(list_transform(range(8), lambda i: {{'g': abs(i * 7 + key % 5 - peak), 's': i}}))).s AS hit FROM rp),
 c AS (SELECT key, hit, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT key, -(max({{'n': n, 'h': -hit}})).h AS mode FROM c GROUP BY key)
SELECT h.key, coalesce(max(hit) FILTER (dir = 'S'), any_value(mode)) AS hit_frame, string_agg(dir || ':' || hit, ',' ORDER BY ord) AS hits FROM h JOIN m ON m.key = h.key GROUP BY h.key""",
    "game_move_speed": f"""WITH {REPORTS}, u AS (SELECT key, dir, list_position(['E', 'W', 'SE', 'NE', 'SW', 'NW'], dir) AS rank, CASE WHEN key % 4 > 0 THEN stance END AS stance, CASE WHEN key % 5 > 0 THEN step END AS step, period FROM rp),
 f AS (SELECT key, (min({{'r': rank, 'd': dir, 'st': stance, 'sp': step, 'p': period}})) AS s FROM u WHERE rank > 0 AND (coalesce(stance, 0) <> 0 OR coalesce(step, 0) <> 0) GROUP BY key),
 v AS (SELECT key, s.d AS side, CASE WHEN s.sp <> 0 THEN 2 * s.sp * 0.5::DOUBLE / (s.p / 24.0::DOUBLE) END AS old,
   CASE WHEN s.st <> 0 THEN s.st * 24 * 0.5::DOUBLE / greatest(0.5, abs(cos(radians(CASE s.d WHEN 'E' THEN 0 WHEN 'SE' THEN 45 WHEN 'SW' THEN 135 WHEN 'W' THEN 180 WHEN 'NW' THEN 225 ELSE 315 END::DOUBLE)))) END AS new FROM f),
 w AS (SELECT key, side, round(CASE WHEN new IS NULL THEN old WHEN old IS NULL OR new / old BETWEEN 0.5 AND 2 THEN new ELSE old END, 9) AS speed FROM v)
SELECT key, side, {_ONE.format('speed')} AS move_speed_auto, {_ONE.format('speed * (1 + key % 3 / 4.0::DOUBLE)')} AS move_speed FROM w""",
    "game_rescaled": f"WITH {_META}, v AS (SELECT key, 1 + key % 5 / 4.0::DOUBLE AS k, auto * (1 + key % 5 / 4.0::DOUBLE) AS v FROM mt WHERE auto IS NOT NULL) SELECT key, {_ONE.format('v')} AS move_speed, round_even(k, 3) AS move_scale, {_moves('v')} AS velocity FROM v",
    "game_retimed": f"""WITH {_META} SELECT key, round_even(fps * 1.5, 2) AS fps, CASE WHEN key % 3 > 0 THEN round_even(round(1000 / (fps * 1.5), 6), 1) END AS frame_ms, {_ONE.format(_ONE.format('auto') + ' * 1.5')} AS move_speed,
 {_ONE.format('auto * 1.5')} AS move_speed_auto, {_again('auto')} AS velocity FROM mt""",
    "pick_shared_span": """SELECT o_orderkey, string_agg(o_orderkey % 20 + CAST(round_even(i * (1 + o_custkey % 60) / least(8, 1 + o_custkey % 60)::DOUBLE, 0) AS INT), ',' ORDER BY i) AS picks
FROM orders, (SELECT unnest(range(8)) AS i) WHERE i < least(8, 1 + o_custkey % 60) GROUP BY o_orderkey""",
}
