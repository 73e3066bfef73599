"""Registered queries of the pose operators, and of the later raster and export operators."""

from __future__ import annotations

from framewright.operators import layout, pose as op, raster
from framewright.plans.layout import RECT
from framewright.plans.raster import BOX, PIX
from framewright.plans.sequence import CLIP
from framewright.plans.signal import SIG
from framewright.sources.tables import SIDE, cells, clips, pixels, signals
from pyspark.sql import functions as F


def _keys(spark, folder):
    return signals(spark, folder).select("user_id", F.col("frame").alias("j"), (F.col("frame") * 0.25).alias("t"), F.floor(F.col("value") / 60).alias("pose"))


ANGLE = ["e[1]", "(e[1] + e[2])", "(e[1] + e[2] + e[3])"]


def _chain(axis: str, joint: int) -> str:
    terms = {"x": "{n} * sin({a}) * cos(e[4])", "y": "{n} * cos({a})", "z": "{n} * sin({a}) * sin(e[4])"}[axis]
    return f"round({' + '.join(terms.format(n=n, a=a) for n, a in list(zip(op.BONES, ANGLE))[:joint])}, 6) + 0.0 AS {axis}"


FK = f"{CLIP}, fk AS (" + " UNION ALL ".join(f"SELECT label, frame, {j} AS joint, {_chain('x', j)}, {_chain('y', j)}, {_chain('z', j)} FROM clip" for j in (1, 2, 3)) + ")"
VIEW = f"""{FK}, vw AS (SELECT label, frame, joint, side, round(x * cos(w) + z * sin(w), 6) + 0.0 AS u, round(y * cos(radians(20.0::DOUBLE)) - (z * cos(w) - x * sin(w)) * sin(radians(20.0::DOUBLE)), 6) + 0.0 AS v
 FROM (SELECT fk.*, side, radians(side * 45.0::DOUBLE) AS w FROM fk, (SELECT unnest(range(8)) AS side)))"""
LIN = "(CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END) AS {c}"
BENT = "(CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE 7.787 * {v} + 16.0 / 116 END) AS {n}"
LAB = f"""{PIX}, li AS (SELECT label, frame, y, x, {', '.join(LIN.format(c=c) for c in 'rgb')} FROM px),
 xz AS (SELECT label, frame, y, x, {BENT.format(v='((0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.950456)', n='fx')},
  {BENT.format(v='(0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b)', n='fy')}, {BENT.format(v='((0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.088754)', n='fz')} FROM li),
 lab AS (SELECT label, frame, y, x, round((116 * fy - 16) * 2.55, 4) AS l, round(500 * (fx - fy) + 128, 4) AS a, round(200 * (fy - fz) + 128, 4) AS b2 FROM xz)"""

QUERIES = {
    "pose_fk": lambda s, d: op.chain_joints(clips(s, d)),
    "pose_project": lambda s, d: op.projected(op.chain_joints(clips(s, d))),
    "pose_fit": lambda s, d: op.fit(op.projected(op.chain_joints(clips(s, d)))),
    "key_retime": lambda s, d: op.retimed_keys(_keys(s, d)),
    "lay_engine_text": lambda s, d: layout.engine_text(layout.rects(cells(s, d))),
    "img_lab": lambda s, d: raster.lab(pixels(s, d)),
    "img_edited_share": lambda s, d: raster.edited_share(pixels(s, d)),
    "img_area_outliers": lambda s, d: raster.area_outliers(pixels(s, d), SIDE),
    "img_even_heights": lambda s, d: raster.even_heights(pixels(s, d)),
}
ORACLES = {
    "pose_fk": f"WITH {FK} SELECT * FROM fk",
    "pose_project": f"WITH {VIEW} SELECT * FROM vw",
    "pose_fit": f"""WITH {VIEW}, m AS (SELECT label, max(v) AS hi, min(v) AS lo, max(abs(u)) AS wide FROM vw WHERE frame % 2 = 0 GROUP BY label),
 s AS (SELECT *, greatest(0.36, least(0.72, 0.45 / greatest(hi - lo, 2 * wide))) AS scale FROM m)
SELECT label, round(scale, 5) AS scale, round(greatest(0.06, least(0.3, 0.12 - lo * scale * 0.1)), 5) AS foot FROM s""",
    "key_retime": f"""WITH {SIG}, k AS (SELECT user_id, frame AS j, frame * 0.25::DOUBLE AS t, floor(value / 60) AS pose FROM sig),
 c AS (SELECT *, pose = first_value(pose) OVER (PARTITION BY user_id ORDER BY j) AS sf, pose = first_value(pose) OVER (PARTITION BY user_id ORDER BY j DESC) AS sl FROM k),
 m AS (SELECT *, min(j) FILTER (NOT sf) OVER w AS a, max(j) FILTER (NOT sl) OVER w AS b, max(j) OVER w AS z FROM c WINDOW w AS (PARTITION BY user_id)),
 p AS (SELECT *, max(t) FILTER (j < coalesce(a, z + 1)) OVER w AS s, min(t) FILTER (j > coalesce(b, -1)) OVER w AS e0, max(t) OVER w AS "end" FROM m WINDOW w AS (PARTITION BY user_id)),
 q AS (SELECT *, greatest(e0, s) AS e, least(s, 0.4) AS head, least("end" - greatest(e0, s), 0.5) AS rest FROM p),
 f AS (SELECT *, CASE WHEN e - s > 0 THEN least(1.0, (3.04 - head - rest) / (e - s)) ELSE 1.0 END AS factor FROM q)
SELECT user_id, j, round(1e-7 + CASE WHEN t <= s THEN CASE WHEN s > 0 THEN t * head / s ELSE 0 END WHEN t <= e THEN head + (t - s) * factor
 ELSE head + (e - s) * factor + (t - e) * rest / greatest("end" - e, 1e-9) END, 5) AS t FROM f""",
    "lay_engine_text": f"""WITH {RECT} SELECT key, string_agg('region_' || dir || '_' || lpad(CAST(slot AS VARCHAR), 2, '0') || ' = Rect2(' || x || ', ' || y || ', ' || w || ', ' || h || ')', chr(10) ORDER BY dir, slot) AS text FROM rect GROUP BY key""",
    "img_lab": f"WITH {LAB} SELECT * FROM lab",
    "img_edited_share": f"""WITH {LAB}, d AS (SELECT label, frame, pow(l - first_value(l) OVER w, 2) + pow(a - first_value(a) OVER w, 2) + pow(b2 - first_value(b2) OVER w, 2) > 14 * 14 AS far
 FROM lab WINDOW w AS (PARTITION BY label, y, x ORDER BY frame)) SELECT label, frame, round(avg(far::INT), 6) AS share FROM d GROUP BY label, frame""",
    "img_area_outliers": f"""WITH {BOX}, m AS (SELECT label, frame, area > 1.08 * median(area) OVER (PARTITION BY label) AS out FROM bx)
SELECT a.label, a.frame, count(*) FILTER (NOT b.out) AS clean FROM m a JOIN m b ON a.label = b.label AND abs(a.frame - b.frame) <= 6 WHERE a.out GROUP BY a.label, a.frame""",
    "img_even_heights": f"""WITH {PIX}, w AS (SELECT label, frame, y, max(x) - min(x) + 1 AS width FROM so GROUP BY ALL), x AS (SELECT *, max(width) OVER (PARTITION BY label, frame) AS widest FROM w),
 h AS (SELECT label, frame, max(y) - min(y) + 1 AS height FROM x WHERE width >= 0.25 * widest GROUP BY label, frame), c AS (SELECT label, median(height) AS height FROM h GROUP BY label)
SELECT label, round(CASE WHEN (SELECT max(height) FROM c) > 1.15 * (SELECT min(height) FROM c) THEN 1.0 ELSE greatest(0.92, least(1.08, (SELECT median(height) FROM c) / height)) END, 6) AS factor FROM c""",
}
