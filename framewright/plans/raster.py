"""Registered queries of the raster operators, over vectors as square frames."""

from __future__ import annotations

from framewright.operators import raster as op
from framewright.sources.tables import SIDE, pixels

CH = "CAST(greatest(0, least(255, floor(128 + 700 * e[(pos + {k}) % 64 + 1]))) AS INT)"
PIX = f"""clip AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 px AS (SELECT label, frame, pos // 8 AS y, pos % 8 AS x, {CH.format(k=0)} AS r, {CH.format(k=21)} AS g, {CH.format(k=42)} AS b FROM clip, (SELECT unnest(range(64)) AS pos)),
 pl AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS luma FROM px), so AS (SELECT * FROM pl WHERE luma > 128)"""
BORDER = f"""{PIX}, bd AS (SELECT px.* FROM px, (SELECT unnest(range(1, 5)) AS k) WHERE k <= (y = 0)::INT + (y = 7)::INT + (x = 0)::INT + (x = 7)::INT),
 bg AS (SELECT label, frame, median(r) AS r, median(g) AS g, median(b) AS b FROM bd GROUP BY label, frame)"""
ALPHA = f"""{BORDER}, ky AS (SELECT p.*, (CASE WHEN bg.g - greatest(bg.r, bg.b) > 50 THEN p.g - greatest(p.r, p.b) ELSE least(p.r, p.b) - p.g END) / 255.0::DOUBLE AS m FROM px p JOIN bg ON bg.label = p.label AND bg.frame = p.frame),
 mk AS (SELECT *, greatest(0.2, median(m) FILTER (y = 0 OR x = 0 OR y = 7 OR x = 7) OVER (PARTITION BY label, frame)) AS mk FROM ky),
 al AS (SELECT label, frame, y, x, round(1 - greatest(0, least(1, (m / mk - 0.2) / 0.4)), 6) AS alpha FROM mk)"""
BOX = f"""{PIX}, bx AS (SELECT label, frame, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area, round(avg(x), 6) AS cx,
 bool_or(y = 0 OR x = 0 OR y = 7 OR x = 7) AS touches FROM so GROUP BY label, frame)"""
CLEAN = "CASE WHEN round_even(alpha * 255, 0) = 0 THEN 0 ELSE CAST(floor(greatest(0, least(255, round(CASE WHEN alpha > 0.05 THEN (p.{c} - (1 - alpha) * bg.{c}) / greatest(alpha, 0.05) ELSE p.{c} END, 6)))) AS INT) END AS {c}"
HIST = f"""{PIX}, hc AS (SELECT label, (r // 32) * 64 + (g // 32) * 8 + b // 32 AS bin, count(*) AS m FROM px WHERE y < 3 GROUP BY ALL),
 hs AS (SELECT label, bin, round(m / sum(m) OVER (PARTITION BY label), 8) AS share FROM hc)"""

QUERIES = {
    "img_bg_median": lambda s, d: op.border_median(pixels(s, d), SIDE),
    "img_edge_share": lambda s, d: op.edge_share(pixels(s, d), SIDE),
    "img_key_ramp": lambda s, d: op.key_alpha(pixels(s, d), SIDE),
    "img_despill": lambda s, d: op.despilled(pixels(s, d)),
    "img_decontaminate": lambda s, d: op.decontaminated(pixels(s, d), SIDE),
    "img_boxes": lambda s, d: op.boxes(pixels(s, d), SIDE),
    "img_centre_drift": lambda s, d: op.centre_drift(pixels(s, d), SIDE),
    "img_body_height": lambda s, d: op.body_heights(pixels(s, d)),
    "img_step_length": lambda s, d: op.step_lengths(pixels(s, d), least_rows=5),
    "img_head_hist": lambda s, d: op.head_histogram(pixels(s, d), SIDE),
    "img_face_share": lambda s, d: op.face_shares(op.head_histogram(pixels(s, d), SIDE), 0, 1),
    "img_block_vote": lambda s, d: op.block_votes(pixels(s, d)),
    "img_majority": lambda s, d: op.majority(pixels(s, d)),
    "img_light_alpha": lambda s, d: op.light_alpha(pixels(s, d)),
    "img_grid_fold": lambda s, d: op.grid_fold(pixels(s, d)),
}
ORACLES = {
    "img_bg_median": f"WITH {BORDER} SELECT *, least(r, b) - g > 80 OR g - greatest(r, b) > 50 AS key FROM bg",
    "img_edge_share": f"WITH {PIX} SELECT label, frame, round(avg((least(r, b) - g < 110)::INT), 6) AS share FROM px WHERE y < 2 OR x < 2 OR y >= 6 OR x >= 6 GROUP BY label, frame",
    "img_key_ramp": f"WITH {ALPHA} SELECT * FROM al",
    "img_despill": f"""WITH {PIX}, a AS (SELECT label, frame, y, x, r - greatest(0, least(r, b) - g) AS r, g, b - greatest(0, least(r, b) - g) AS b FROM px)
SELECT label, frame, y, x, r, g - greatest(0, g - greatest(r, b)) AS g, b FROM a""",
    "img_decontaminate": f"""WITH {ALPHA} SELECT p.label, p.frame, p.y, p.x, {', '.join(CLEAN.format(c=c) for c in 'rgb')}, CAST(round_even(alpha * 255, 0) AS INT) AS a
FROM px p JOIN al ON al.label = p.label AND al.frame = p.frame AND al.y = p.y AND al.x = p.x JOIN bg ON bg.label = p.label AND bg.frame = p.frame""",
    "img_boxes": f"WITH {BOX} SELECT * FROM bx",
    "img_centre_drift": f"""WITH {ALPHA}, cx AS (SELECT label, frame, round((sum(x * alpha) + 0.000001::DOUBLE * 28) / (sum(alpha) + 0.000001::DOUBLE * 8), 6) AS cx, bool_or(alpha > 0.5 AND (y IN (0, 7) OR x IN (0, 7))) AS touches FROM al GROUP BY label, frame)
SELECT label, round_even(round(max(cx) - min(cx), 6), 1) AS drift, count(*) FILTER (touches) AS touching FROM cx GROUP BY label""",
    "img_body_height": f"""WITH {PIX}, w AS (SELECT label, frame, y, max(x) - min(x) + 1 AS width FROM so GROUP BY ALL), m AS (SELECT *, max(width) OVER (PARTITION BY label, frame) AS widest FROM w)
SELECT label, frame, max(y) - min(y) + 1 AS height FROM m WHERE width >= 0.25 * widest GROUP BY label, frame""",
    "img_step_length": f"""WITH {PIX}, l AS (SELECT label, frame, y, x FROM so), b AS (SELECT label, frame, min(y) AS top, max(y) AS bottom FROM l GROUP BY label, frame HAVING count(DISTINCT y) >= 5),
 f AS (SELECT label, frame, max(x) - min(x) + 1 AS width FROM l JOIN b USING (label, frame) WHERE y >= greatest(top, bottom - greatest(3, round_even(0.07::DOUBLE * (bottom - top), 0))) GROUP BY label, frame)
SELECT label, max(width) - min(width) AS step FROM f GROUP BY label HAVING count(*) >= 4""",
    "img_head_hist": f"WITH {HIST} SELECT * FROM hs",
    "img_face_share": f"""WITH {HIST}, mk AS (SELECT bin, max(share) FILTER (label = 0) AS s FROM hs GROUP BY bin HAVING coalesce(max(share) FILTER (label = 0), 0) > 2 * coalesce(max(share) FILTER (label = 1), 0) + 0.002)
SELECT label, round(sum(share) / (SELECT sum(s) FROM mk), 6) AS face FROM hs JOIN mk ON mk.bin = hs.bin WHERE (SELECT sum(s) FROM mk) >= 0.03 GROUP BY label""",
    "img_block_vote": f"""WITH {PIX}, c AS (SELECT label, frame, y // 2 AS "by", x // 2 AS bx, CAST(floor(luma * 4 / 256) AS INT) AS q, count(*) AS m FROM pl GROUP BY ALL)
SELECT label, frame, "by", bx, -(max({{'m': m, 'q': -q}})).q AS q FROM c GROUP BY label, frame, "by", bx""",
    "img_majority": f"""WITH {PIX}, q AS (SELECT label, frame, y, x, CAST(floor(luma * 4 / 256) AS INT) AS q FROM pl),
 n AS (SELECT label, frame, y + dy AS y, x + dx AS x, q FROM q, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE dy <> 0 OR dx <> 0),
 v AS (SELECT label, frame, y, x, q AS vote FROM n GROUP BY ALL HAVING count(*) >= 6)
SELECT q.label, q.frame, q.y, q.x, CASE WHEN q.q = 0 THEN 0 ELSE coalesce(vote, q.q) END AS q FROM q LEFT JOIN v USING (label, frame, y, x)""",
    "img_light_alpha": f"WITH {PIX} SELECT label, frame, y, x, round(greatest(0, least(1, (luma - first_value(luma) OVER (PARTITION BY label, y, x ORDER BY frame) - 50) / 100)), 6) AS a FROM pl",
    "img_grid_fold": f"""WITH {PIX}, e AS (SELECT label, x, abs(luma - lag(luma) OVER (PARTITION BY label, frame, y ORDER BY x)) AS d FROM pl),
 f AS (SELECT label, period, floor((x % period) / period * 4) AS bin, sum(d) AS d FROM e, (SELECT unnest([2, 3, 4]) AS period) WHERE d IS NOT NULL GROUP BY ALL)
SELECT label, period, round(max(d) / sum(d), 6) AS share FROM f GROUP BY label, period""",
}
