"""Registered queries of the layout operators, over line items as sheets and orders as motions."""

from __future__ import annotations

from framewright.operators import layout as op
from framewright.sources.tables import cells, table
from pyspark.sql import functions as F

CELL = """cell AS (SELECT l_orderkey AS key, l_linenumber AS dir, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS slot, CAST(16 + l_partkey % 48 AS INT) AS w, CAST(16 + l_suppkey % 48 AS INT) AS h FROM lineitem)"""
RECT = f"""{CELL}, rect AS (SELECT key, dir, slot, slot * max(w) OVER k AS x, (dense_rank() OVER (PARTITION BY key ORDER BY dir) - 1) * max(h) OVER k AS y,
  max(w) OVER k AS w, max(h) OVER k AS h FROM cell WINDOW k AS (PARTITION BY key))"""


def _motions(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select(F.col("o_orderkey").alias("key"), (6.0 + F.col("o_orderkey") % 18).alias("fps"), (F.col("o_totalprice") / 1000).alias("speed"))


def _overrides(spark, folder):
    lines = cells(spark, folder)
    picks = lines.select(F.struct("key", "dir").alias("kd"), "slot", "w").select(F.concat_ws("-", "kd.key", "kd.dir").alias("key"), "slot", F.col("w").alias("pick"), F.lit(48).alias("n"))
    chosen = lines.filter("h % 5 = 0").select(F.concat_ws("-", "key", "dir").alias("key"), "slot", (F.col("h") - 20).alias("chosen"))
    return op.overridden(picks, chosen)


def _sources(spark, folder):
    lines = cells(spark, folder).select("key", "dir").distinct()
    mirror = spark.range(1, 9).select(F.col("id").cast("int").alias("dir"), (9 - F.col("id")).cast("int").alias("mirror"))
    wanted = lines.select("key").distinct().select("key", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("dir"))
    return op.sources(wanted, lines, mirror)


QUERIES = {
    "lay_rects": lambda s, d: op.rects(cells(s, d)),
    "lay_tags": lambda s, d: op.tags(cells(s, d)),
    "lay_sheet_size": lambda s, d: op.sheet_meta(op.rects(cells(s, d))),
    "lay_sheet_json": lambda s, d: op.sheet_json(op.rects(cells(s, d))),
    "lay_common_crop": lambda s, d: op.common_crop(cells(s, d)),
    "lay_margins": lambda s, d: op.margins(cells(s, d)),
    "lay_contact_sheet": lambda s, d: op.contact_sheet(cells(s, d)),
    "lay_retime": lambda s, d: op.retimed(_motions(s, d), F.lit(1.5)),
    "lay_move_scale": lambda s, d: _motions(s, d).select("key", F.round(F.col("speed") * (1 + F.col("key") % 3) * 0.5, 6).alias("speed")),
    "lay_velocity": lambda s, d: op.velocities(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("speed"))),
    "lay_game_hits": lambda s, d: op.hits(cells(s, d)),
    "pick_overrides": _overrides,
    "dim_sources": _sources,
}
ORACLES = {
    "lay_rects": f"WITH {RECT} SELECT * FROM rect",
    "lay_tags": f"WITH {CELL}, n AS (SELECT key, dir, row_number() OVER (PARTITION BY key ORDER BY dir, slot) - 1 AS i FROM cell) SELECT key, dir, min(i) AS first, max(i) AS last, 83 AS duration FROM n GROUP BY ALL",
    "lay_sheet_size": f"WITH {RECT} SELECT key, count(*) AS frames, max(x + w) AS width, max(y + h) AS height FROM rect GROUP BY key",
    "lay_sheet_json": f"""WITH {RECT}, c AS (SELECT key, dir, '{{"dir":' || dir || ',"cells":[' || string_agg('{{"slot":' || slot || ',"x":' || x || ',"y":' || y || ',"w":' || w || ',"h":' || h || '}}', ',' ORDER BY slot) || ']}}' AS j FROM rect GROUP BY key, dir)
SELECT key, '[' || string_agg(j, ',' ORDER BY dir) || ']' AS json FROM c GROUP BY key""",
    "lay_common_crop": f"""WITH {CELL}, p AS (SELECT key, dir, max(w) AS w, max(h) AS h, count(*) AS m FROM cell GROUP BY ALL)
SELECT key, CAST(ceil(max(w) / 2.0) + round_even(0.03::DOUBLE * max(h), 0) AS BIGINT) AS half, max(h) AS top, min(m) AS frames FROM p GROUP BY key""",
    "lay_margins": f"""WITH {CELL}, p AS (SELECT key, dir, max(w) AS w, max(h) AS h FROM cell GROUP BY ALL)
SELECT key, dir, (max(w) OVER (PARTITION BY key) - w) // 2 AS left, max(h) OVER (PARTITION BY key) - h AS top FROM p""",
    "lay_contact_sheet": f"""WITH {CELL}, n AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY dir, slot) - 1 AS i, count(*) OVER (PARTITION BY key) AS m FROM cell),
 k AS (SELECT key, i, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS pos FROM n WHERE i % greatest(1, m // 24) = 0) SELECT key, i AS slot, pos % 8 AS column, pos // 8 AS row FROM k""",
    "lay_retime": "SELECT o_orderkey AS key, round((6.0 + o_orderkey % 18)::DOUBLE * 1.5, 4) AS fps, round(1000 / ((6.0 + o_orderkey % 18)::DOUBLE * 1.5), 1) AS frame_ms, round(o_totalprice / 1000 * 1.5, 6) AS speed FROM orders",
    "lay_move_scale": "SELECT o_orderkey AS key, round(o_totalprice / 1000 * (1 + o_orderkey % 3) * 0.5, 6) AS speed FROM orders",
    "lay_velocity": """SELECT s_suppkey AS id, dir, round_even(round_even(s_acctbal / 100 * cos(radians(dir * 45.0::DOUBLE)), 6), 1) + 0.0 AS vx,
 round_even(round_even(s_acctbal / 100 * sin(radians(dir * 45.0::DOUBLE)) * sin(radians(30.0::DOUBLE)), 6), 1) + 0.0 AS vy FROM supplier, (SELECT unnest(range(8)) AS dir)""",
    "lay_game_hits": f"""WITH {CELL}, d AS (SELECT key, dir, -(max({{'w': w, 's': -slot}})).s AS hit FROM cell GROUP BY key, dir), c AS (SELECT key, hit, count(*) AS m FROM d GROUP BY ALL),
 b AS (SELECT key, -(max({{'m': m, 'h': -hit}})).h AS mode FROM c GROUP BY key) SELECT b.key, coalesce(d.hit, mode) AS hit FROM b LEFT JOIN d ON d.key = b.key AND d.dir = 1""",
    "pick_overrides": f"WITH {CELL} SELECT key || '-' || dir AS key, slot, CASE WHEN h % 5 = 0 THEN greatest(0, least(47, h - 20)) ELSE w END AS pick FROM cell",
    "dim_sources": f"""WITH {CELL}, m AS (SELECT DISTINCT key, dir FROM cell), w AS (SELECT key, dir FROM (SELECT DISTINCT key FROM cell), (SELECT unnest(range(1, 8)) AS dir))
SELECT w.key, w.dir, CASE WHEN a.dir IS NOT NULL THEN w.dir WHEN b.dir IS NOT NULL THEN 9 - w.dir END AS source, a.dir IS NULL AND b.dir IS NOT NULL AS flip
FROM w LEFT JOIN m a ON a.key = w.key AND a.dir = w.dir LEFT JOIN m b ON b.key = w.key AND b.dir = 9 - w.dir""",
}
