"""Registered queries of the geometry operators, over line items as figures and pixels as regions."""

from __future__ import annotations

from framewright.operators import geometry as op
from framewright.operators import raster
from framewright.plans.export import CELLS, DIRS, _dirs, sheet_cells
from framewright.plans.raster import BORDER, PIX
from framewright.sources.tables import SIDE, pixels, table
from pyspark.sql import functions as F

FIG = f"""{CELLS}, fig AS (SELECT key, dir, max(w - slot % 3) AS w, max(h - ord) AS h, CASE WHEN key % 5 > 0 THEN nullif(max(greatest(0, h - ord * (key % 4))), 0) END AS body FROM cel GROUP BY key, dir)"""


def _figures(spark, folder):
    rows = sheet_cells(spark, folder).groupBy("key", "dir").agg(F.max(F.col("w") - F.col("slot") % 3).alias("w"), F.max(F.col("h") - F.col("ord")).alias("h"), F.max(F.greatest(F.lit(0), F.col("h") - F.col("ord") * (F.col("key") % 4))).alias("body"))
    return rows.withColumn("body", F.when(F.col("key") % 5 > 0, F.col("body")))


def _redrawn(spark, folder):
    rows = _figures(spark, folder)
    there = F.col("key") % 3 > 0
    box = {"left": F.when(there, F.col("key") % 7), "top": F.when(there, F.col("key") % 5), "right": F.when(there, F.col("key") % 7 + F.col("w")), "bottom": F.when(there, F.col("key") % 5 + F.col("h"))}
    return op.redrawn(rows.select("key", "dir", F.lit(600).alias("sheet_w"), (500 + F.col("key") % 100).alias("sheet_h"), *[c.alias(n) for n, c in box.items()], (F.col("w") * 3).alias("new_w"), (F.col("h") * 2 + 1).alias("new_h")))


def _preview(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.element_at(F.array(F.lit(8), F.lit(4), F.lit(2)), (F.col("o_custkey") % 3 + 1).cast("int")).alias("count"), (20 + F.col("o_orderkey") % 9).alias("w"), (30 + F.col("o_custkey") % 9).alias("h"))
    return op.preview(_dirs(spark, folder).select("key", "dir").join(orders, "key"))


def _shadows(spark, folder):
    back = raster.border_median(pixels(spark, folder), SIDE).select("label", "frame", *[F.col(c).alias(f"back_{c}") for c in "rgb"])
    rows = pixels(spark, folder).filter("y > 5").join(back, ["label", "frame"])
    return op.shadow_like(rows.withColumn("key", F.concat_ws("-", "label", "frame")))


def _policy(spark, folder):
    borders = raster.border_median(pixels(spark, folder), SIDE)
    return borders.select("label", "frame", op.matte_policy(F.when(F.col("frame") % 3 > 0, "vivid").otherwise("strip"), F.col("r"), F.col("g"), F.col("b")).alias("p")).select("label", "frame", "p.*")


def _joints(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("joint")).filter("joint % 3 > 0")
    return op.joint_map(table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("part"), F.col("c_custkey").alias("place"), F.col("n_name").alias("name")), nations)


def _either(spark, folder):
    place = pixels(spark, folder).filter("frame < 20").withColumn("key", F.concat_ws("-", "label", "frame"))
    return op.either(place.filter("r > 200").select("key", "y", "x"), place.filter("b > 200").select("key", "y", "x"), place.filter("g < 20").select("key", "y", "x"))


QUERIES = {
    "lay_first_frames": lambda s, d: op.first_frames(_figures(s, d)),
    "lay_redrawn": _redrawn,
    "lay_preview": _preview,
    "img_shadow_like": _shadows,
    "rule_matte": _policy,
    "join_joint_names": _joints,
    "set_masks": _either,
    "store_new_ids": lambda s, d: op.new_ids(table(s, d, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderdate")).select(
        "o_orderkey", *[F.regexp_replace(c, "[0-9a-f]{%d}$" % n, "").alias(c) for c, n in (("project_id", 6), ("motion_id", 4), ("version_id", 3), ("job_id", 10))]),
}
_SIDE = "greatest(1, round_even(round({c} * {k}, 6), 0)::INT)"
_AT = {i: "CASE dir " + " ".join(f"WHEN '{d}' THEN {c[i]}" for d, c in op.CELL.items()) + " END" for i in (0, 1)}
_GRID = ", ".join(f"({n}, '{d}', {c}, {r}, {cols}, {rows})" for n, g, cols, rows in ((8, op.CELL, 3, 3), (4, op.CROSS, 3, 3), (2, op.PAIR, 2, 1)) for d, (c, r) in g.items())
ORACLES = {
    "lay_first_frames": f"""WITH {FIG}, k AS (SELECT key, dir, w, h, round(0.72::DOUBLE * 640 / median(h) OVER k * CASE WHEN body IS NULL OR max(body) OVER k > 1.15::DOUBLE * min(body) OVER k THEN 1 ELSE greatest(0.92::DOUBLE, least(1.08::DOUBLE, median(body) OVER k / body)) END, 9) AS s
   FROM fig WINDOW k AS (PARTITION BY key)), z AS (SELECT key, dir, round(s, 6) AS scale, {_SIDE.format(c='w', k='s')} AS width, {_SIDE.format(c='h', k='s')} AS height FROM k)
SELECT *, floor((640 - width) / 2)::INT AS x, 640 - 77 - height AS y FROM z""",
    "lay_redrawn": f"""WITH {FIG}, b AS (SELECT *, 600 AS sw, 500 + key % 100 AS sh, w * 3 AS nw, h * 2 + 1 AS nh, {_AT[0]} AS cx, {_AT[1]} AS cy FROM fig),
 c AS (SELECT *, cx * sw // 3 AS x0, cy * sh // 3 AS y0, (cx + 1) * sw // 3 AS x1, (cy + 1) * sh // 3 AS y1 FROM b),
 o AS (SELECT *, CASE WHEN key % 3 > 0 THEN h::DOUBLE ELSE 0.75::DOUBLE * (y1 - y0) END AS old, CASE WHEN key % 3 > 0 THEN (key % 5 + h)::DOUBLE ELSE 0.9::DOUBLE * (y1 - y0) END AS low, CASE WHEN key % 3 > 0 THEN (key % 7 * 2 + w) / 2.0::DOUBLE ELSE (x1 - x0) / 2.0::DOUBLE END AS middle FROM c),
 z AS (SELECT *, {_SIDE.format(c='nw', k='(old / nh)')} AS width, {_SIDE.format(c='nh', k='(old / nh)')} AS height FROM o)
SELECT key, dir, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1, width, height, floor(round(middle - width / 2.0::DOUBLE, 6))::INT AS x, floor(round(low - height, 6))::INT AS y FROM z""",
    "lay_preview": f"""WITH {DIRS}, gr(count, dir, c, r, cols, nrows) AS (VALUES {_GRID}), si AS (SELECT o_orderkey AS key, 20 + o_orderkey % 9 AS w, 30 + o_custkey % 9 AS h FROM orders)
SELECT di.key, di.dir, c * (w + 8) AS x, r * (h + 8) AS y, cols * w + (cols - 1) * 8 AS width, nrows * h + (nrows - 1) * 8 AS height FROM di JOIN mot USING (key) JOIN gr ON gr.count = mot.count AND gr.dir = di.dir JOIN si ON si.key = di.key""",
    "img_shadow_like": f"""WITH {BORDER}, m AS (SELECT p.label || '-' || p.frame AS key, avg(p.r) AS r, avg(p.g) AS g, avg(p.b) AS b, avg(bg.r) AS br, avg(bg.g) AS bgr, avg(bg.b) AS bb FROM px p JOIN bg ON bg.label = p.label AND bg.frame = p.frame WHERE p.y > 5 GROUP BY 1)
SELECT key, (greatest(r, g, b) - least(r, g, b)) / greatest(greatest(r, g, b), 1) < 0.25 AND 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b <= 0.299::DOUBLE * br + 0.587::DOUBLE * bgr + 0.114::DOUBLE * bb + 12 AS shadow FROM m""",
    "rule_matte": f"""WITH {BORDER}, k AS (SELECT label, frame, frame % 3 > 0 AS vivid, least(r, b) - g > 80 OR g - greatest(r, b) > 50 AS key FROM bg)
SELECT label, frame, CASE WHEN vivid AND key THEN 'none' ELSE 'all' END AS mode, CASE WHEN vivid THEN 0.95::DOUBLE END AS fill, vivid AND NOT key AS light FROM k""",
    "join_joint_names": "SELECT c_mktsegment AS part, c_custkey AS place, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey ELSE 0 END AS joint FROM customer",
    "set_masks": f"WITH {PIX} SELECT DISTINCT label || '-' || frame AS key, y, x FROM px WHERE frame < 20 AND (r > 200 OR b > 200 OR g < 20)",
    "store_new_ids": "SELECT o_orderkey, 'p' || strftime(o_orderdate, '%Y%m%d-') AS project_id, 'm' || strftime(o_orderdate, '%m%d%H%M%S') AS motion_id, 'v' || strftime(o_orderdate, '%m%d%H%M%S') AS version_id, 'j' AS job_id FROM orders",
}
