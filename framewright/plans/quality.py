"""Registered queries of the quality rules; a pixel's alpha is twice its green value, so that figures have soft edges."""

from __future__ import annotations

from framewright.operators import quality as op
from framewright.operators import raster
from framewright.plans.raster import ALPHA, BORDER, PIX
from framewright.sources.tables import SIDE, pixels
from pyspark.sql import functions as F

KEYED = f"""{PIX}, kf AS (SELECT *, least(255, g * 2) AS alpha FROM px), sol AS (SELECT * FROM kf WHERE alpha > 128), nso AS (SELECT * FROM kf WHERE alpha <= 128)"""


def keyed(spark, folder, dealt=False):
    return pixels(spark, folder, dealt).withColumn("alpha", F.least(F.lit(255), F.col("g") * 2))


def _issues(spark, folder):
    out = op.issues(keyed(spark, folder), pixels(spark, folder), SIDE)
    return out.withColumn("frames", F.array_join(F.col("frames").cast("array<string>"), ","))


def _layers(spark, folder):
    light = raster.light_alpha(pixels(spark, folder)).withColumnRenamed("a", "alpha")
    return op.layers(raster.key_alpha(pixels(spark, folder), SIDE), light)


_NEAR = "SELECT DISTINCT {t}.label, {t}.frame, {t}.y + dy AS y, {t}.x + dx AS x FROM {t}, (SELECT unnest(range(-{r}, {r} + 1)) AS dy), (SELECT unnest(range(-{r}, {r} + 1)) AS dx)"
_MORPH = f"""{KEYED}, gr AS ({_NEAR.format(t='sol', r=1)}), n1 AS ({_NEAR.format(t='nso', r=1)}), n3 AS ({_NEAR.format(t='nso', r=3)}),
 e1 AS (SELECT label, frame, y, x FROM sol ANTI JOIN n1 USING (label, frame, y, x)), e3 AS (SELECT label, frame, y, x FROM sol ANTI JOIN n3 USING (label, frame, y, x)),
 bn AS (SELECT label, frame, y, x FROM gr ANTI JOIN e1 USING (label, frame, y, x)),
 kc AS (SELECT *, (least(r, b) - g > 60 OR g - greatest(r, b) > 60)::INT AS key FROM kf),
 ba AS (SELECT label, frame, avg(key) AS edge FROM kc JOIN bn USING (label, frame, y, x) WHERE alpha > 20 GROUP BY label, frame), ina AS (SELECT label, frame, avg(key) AS inside FROM kc JOIN e3 USING (label, frame, y, x) GROUP BY label, frame),
 fri AS (SELECT label, frame FROM ba LEFT JOIN ina USING (label, frame) WHERE edge > 0.04 AND edge > 3 * coalesce(inside, 0) + 0.02)"""
_BACK = """bb AS (SELECT label, frame, sqrt((r - first_value(r) OVER w) ** 2 + (g - first_value(g) OVER w) ** 2 + (b - first_value(b) OVER w) ** 2) > 60 AS far, least(r, b) - g <= 80 AS odd FROM bg WINDOW w AS (PARTITION BY label ORDER BY frame)),
 pt AS (SELECT label, frame, avg((least(r, b) - g < 110)::INT) > 0.1 AS pattern FROM px WHERE y < 2 OR x < 2 OR y >= 6 OR x >= 6 GROUP BY label, frame),
 bc AS (SELECT label, count(*) AS frames, count(*) FILTER (far OR pattern) AS changed FROM bb JOIN pt USING (label, frame) GROUP BY label)"""
_BOXES = """bo AS (SELECT label, frame, count(*) FILTER (alpha > 128) AS area, coalesce(max(y) FILTER (alpha > 128) - min(y) FILTER (alpha > 128) + 1, 0) AS height, max(y) FILTER (alpha > 128) AS bottom, min(y) FILTER (alpha > 128) AS top,
   count(*) FILTER (alpha > 128 AND least(r, b) - g > 50 AND r > 150) AS pink, bool_or(alpha > 128 AND (y IN (0, 7) OR x IN (0, 7))) AS touches FROM kf GROUP BY label, frame),
 emp AS (SELECT * FROM (SELECT *, coalesce(nullif(median(area) OVER (PARTITION BY label), 0), 1) AS mid FROM bo) WHERE area < 0.3 * mid),
 ps AS (SELECT label, frame, coalesce(pink / nullif(area, 0), 0) AS share FROM bo),
 pin AS (SELECT * FROM (SELECT *, first_value(share) OVER (PARTITION BY label ORDER BY frame) AS base FROM ps) WHERE share > base + 0.01),
 fe AS (SELECT label, frame, count(*) AS n, count(*) FILTER (greatest(r, g, b) - least(r, g, b) < 18 AND greatest(r, g, b) > 60 AND greatest(r, g, b) < 215) AS grey FROM sol JOIN bo USING (label, frame)
   WHERE y >= greatest(0, bottom - greatest(2, floor(0.06 * (bottom - top)))) GROUP BY label, frame),
 sdw AS (SELECT * FROM fe WHERE n > 20 AND grey > 0.5 * n)"""
_STEPS = """cl AS (SELECT label, frame, y, x, r * alpha / 255.0::DOUBLE / 255 AS r, g * alpha / 255.0::DOUBLE / 255 AS g, b * alpha / 255.0::DOUBLE / 255 AS b FROM kf),
 st AS (SELECT label, frame, max(frame) OVER (PARTITION BY label) AS last, (abs(r - lag(r) OVER w) + abs(g - lag(g) OVER w) + abs(b - lag(b) OVER w)) / 3 AS step,
   (abs(r - first_value(r) OVER w) + abs(g - first_value(g) OVER w) + abs(b - first_value(b) OVER w)) / 3 AS jump FROM cl WINDOW w AS (PARTITION BY label, y, x ORDER BY frame)),
 sf AS (SELECT label, frame, round(avg(step), 9) AS step, round(avg(jump) FILTER (frame = last), 9) AS jump FROM st GROUP BY label, frame),
 ss AS (SELECT label, max(jump) AS jump, median(step) AS step, count(*) AS frames FROM sf GROUP BY label)"""
QUERIES = {
    "qa_report": _issues,
    "qa_fringe": lambda s, d: op.fringed(keyed(s, d)),
    "qa_seam_steps": lambda s, d: op.small_steps(keyed(s, d)),
    "img_bg_changes": lambda s, d: op.background_changes(pixels(s, d), SIDE),
    "img_bg_drift": lambda s, d: op.drifting(pixels(s, d), SIDE),
    "img_outline": lambda s, d: op.outlined(keyed(s, d), SIDE, band=3, least=20),
    "img_thumbnails": lambda s, d: op.thumbnails(keyed(s, d), 2).withColumn("v", F.array_join(F.col("v").cast("array<string>"), ",")),
    "img_layers": _layers,
}
ORACLES = {
    "qa_fringe": f"WITH {_MORPH} SELECT * FROM fri",
    "qa_seam_steps": f"WITH {KEYED}, {_STEPS} SELECT * FROM ss",
    "img_bg_changes": f"WITH {BORDER}, {_BACK} SELECT * FROM bc",
    "img_bg_drift": f"WITH {BORDER}, {_BACK} SELECT label, 2 * count(*) FILTER ((odd OR pattern) AND frame % 2 = 0) AS drifted, count(*) AS total FROM bb JOIN pt USING (label, frame) GROUP BY label",
    "img_outline": f"""WITH {KEYED}, no AS (SELECT * FROM kf WHERE alpha <= 127), nn AS ({_NEAR.format(t='no', r=1)}), e0 AS (SELECT label, frame, y, x FROM kf ANTI JOIN nn USING (label, frame, y, x) WHERE alpha > 127),
 ed AS (SELECT label, frame, y, x FROM kf ANTI JOIN e0 USING (label, frame, y, x) WHERE alpha > 127 AND (label, frame) IN (SELECT (label, frame) FROM kf WHERE alpha > 127 GROUP BY label, frame HAVING count(*) >= 20)),
 es AS (SELECT label, frame, avg((0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b < 80)::INT) AS share FROM kf JOIN ed USING (label, frame, y, x) GROUP BY label, frame)
SELECT label, round(avg(share), 6) AS share, round(avg(share), 6) >= 0.45 AS outlined FROM es GROUP BY label""",
    "img_thumbnails": f"""WITH {KEYED}, th AS (SELECT label, frame, y // 2 AS "by", x // 2 AS bx, round(avg(((0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) * (alpha / 255.0::DOUBLE) + 255 * (1 - alpha / 255.0::DOUBLE)) / 255), 6) AS g FROM kf GROUP BY ALL)
SELECT label, frame, string_agg(g, ',' ORDER BY "by", bx) AS v FROM th GROUP BY label, frame""",
    "img_layers": f"""WITH {ALPHA}, li AS (SELECT label, frame, y, x, round(greatest(0, least(1, (luma - first_value(luma) OVER (PARTITION BY label, y, x ORDER BY frame) - 50) / 100)), 6) AS own FROM pl)
SELECT label, frame, y, x, CAST(floor(round(greatest(0, least(1, least(own, alpha))) * 255 + 0.5, 6)) AS INT) AS body, CAST(floor(round(greatest(0, least(1, alpha - least(own, alpha))) * 255 + 0.5, 6)) AS INT) AS fx FROM al JOIN li USING (label, frame, y, x)""",
    "qa_report": f"""WITH {_MORPH}, {BORDER.replace(PIX + ', ', '')}, {_BACK}, {_BOXES}, {_STEPS},
 hg AS (SELECT label, median(height) AS height FROM bo GROUP BY label), md AS (SELECT coalesce(nullif(median(height), 0), 1) AS mid, count(*) AS dirs FROM hg),
 al AS (SELECT 1 AS rule, 'fringe' AS kind, label, string_agg(frame, ',' ORDER BY frame) AS frames, NULL::BIGINT AS count, NULL::DOUBLE AS ratio FROM fri GROUP BY label
   UNION ALL SELECT 2, 'pink', label, string_agg(frame, ',' ORDER BY frame), NULL, NULL FROM pin GROUP BY label UNION ALL SELECT 3, 'shadow', label, string_agg(frame, ',' ORDER BY frame), NULL, NULL FROM sdw GROUP BY label
   UNION ALL SELECT 4, 'empty', label, string_agg(frame, ',' ORDER BY frame), NULL, NULL FROM emp GROUP BY label
   UNION ALL SELECT 5, 'seam', label, (frames - 1) || ',0', NULL, NULL FROM ss WHERE frames > 2 AND jump > 0.01 AND jump > 2.2 * step
   UNION ALL SELECT 6, 'edge', label, '', NULL, NULL FROM bo GROUP BY label HAVING count(*) FILTER (touches) > 3 UNION ALL SELECT 7, 'bg', label, '', changed, NULL FROM bc WHERE changed > 0.1 * frames
   UNION ALL SELECT 8, 'size', label, '', NULL, round_even(height / mid, 2) FROM hg, md WHERE dirs > 2 AND abs(height - mid) / mid > 0.15)
SELECT row_number() OVER (ORDER BY (rule = 8)::INT, label, rule) - 1 AS place, kind, label, frames, count, ratio FROM al""",
}
