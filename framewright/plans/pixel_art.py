"""Registered queries of the pixel-art, light and motion operators."""

from __future__ import annotations

from framewright.operators import pixel_art as op
from framewright.operators import raster
from framewright.plans.quality import KEYED, keyed
from framewright.plans.raster import BORDER
from framewright.sources.tables import SIDE, clips, pixels, table
from pyspark.sql import functions as F

PALETTE = [(20, 20, 20), (200, 60, 60), (60, 200, 60), (60, 60, 200), (200, 200, 80), (230, 230, 230)]
_LIST = ", ".join(f"{{'k': {k}, 'r': {r}, 'g': {g}, 'b': {b}}}" for k, (r, g, b) in enumerate(PALETTE))
_VOTES = f"""{KEYED}, sb AS (SELECT label, frame, y // 2 AS "by", x // 2 AS bx, alpha > 127 AS solid, (list_min(list_transform([{_LIST}], lambda p: {{'d': (r - p.r) ** 2 + (g - p.g) ** 2 + (b - p.b) ** 2, 'k': p.k}}))).k AS k FROM kf),
 ce AS (SELECT label, frame, "by", bx, [{', '.join(f'count(*) FILTER (solid AND k = {k})' for k in range(len(PALETTE)))}] AS votes, avg(solid::INT) >= 0.5 AS a FROM sb GROUP BY ALL),
 vo AS (SELECT label, frame, "by", bx, votes, CAST(CASE WHEN votes[1] >= 2 THEN 0 ELSE list_position(votes, list_max(votes)) - 1 END AS INT) AS q, a FROM ce)"""
_CLEAN = f"""{_VOTES}, nb AS (SELECT a.label, a.frame, a."by", a.bx, b.q FROM vo a JOIN vo b ON a.label = b.label AND a.frame = b.frame AND ((a.bx = b.bx AND a."by" - b."by" IN (-1, 1)) OR (a."by" = b."by" AND a.bx - b.bx IN (-1, 1))) WHERE b.a AND a.q <> b.q),
 lo AS (SELECT label, frame, "by", bx FROM nb GROUP BY ALL HAVING count(*) = 4), lv AS (SELECT label, frame, "by", bx, q, count(*) AS n FROM nb JOIN lo USING (label, frame, "by", bx) GROUP BY ALL),
 lq AS (SELECT label, frame, "by", bx, (min({{'n': -n, 'q': q}})).q AS new FROM lv GROUP BY ALL),
 st AS (SELECT label, frame, "by", bx, votes, a, CASE WHEN a AND q <> 0 THEN coalesce(new, q) ELSE q END AS q FROM vo LEFT JOIN lq USING (label, frame, "by", bx)),
 e8 AS (SELECT label, frame, "by" + dy AS "by", bx + dx AS bx, q AS most FROM st, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE a AND (dy <> 0 OR dx <> 0)),
 mj AS (SELECT label, frame, "by", bx, most FROM e8 GROUP BY ALL HAVING count(*) >= 6),
 cl AS (SELECT label, frame, "by", bx, votes, a, CASE WHEN a AND q <> 0 THEN coalesce(most, q) ELSE q END AS q FROM st LEFT JOIN mj USING (label, frame, "by", bx))"""
_TURNS = """tu AS (SELECT label AS key, [e[1], e[2], e[3], e[4]] AS a0, [e[5], e[6], e[7], e[8]] AS b0, frame % 11 / 10.0::DOUBLE AS t, frame FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""


def _cells(spark, folder):
    return op.voted(keyed(spark, folder, dealt=True), PALETTE, 2)


def _videos(spark, folder):
    parts = table(spark, folder, "part")
    return op.video_times(parts.select(F.col("p_partkey").alias("key"), (12 + F.col("p_size")).cast("double").alias("fps"), (12 + F.col("p_partkey") % 300).alias("frames"), (100 + F.col("p_size") * 20).alias("width"), (90 + F.col("p_size") * 13).alias("height")))


def _vectors(spark, folder):
    e = lambda a: F.slice("e", a, 3)
    return clips(spark, folder).select(F.concat_ws("-", "label", "frame").alias("key"), "label", e(1).alias("across"), e(4).alias("up"))


def _turns(spark, folder):
    unit = lambda c: F.transform(c, lambda v: v / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, w: s + w * w)))
    rows = clips(spark, folder).select(F.concat_ws("-", "label", "frame").alias("key"), unit(F.slice("e", 1, 4)).alias("a"), unit(F.slice("e", 5, 4)).alias("b"), (F.col("frame") % 11 / 10).alias("t"))
    return op.blended(rows)


QUERIES = {
    "px_votes": lambda s, d: _cells(s, d).select("label", "frame", "by", "bx", F.array_join(F.col("votes").cast("array<string>"), ",").alias("votes"), "q", "a"),
    "px_clean": lambda s, d: op.majority_of_eight(op.without_strays(_cells(s, d), PALETTE), PALETTE).select("label", "frame", "by", "bx", "q", "a"),
    "px_pixelated": lambda s, d: op.pixelated(keyed(s, d, dealt=True), PALETTE, 2),
    "img_light_part": lambda s, d: op.light_part(pixels(s, d), raster.border_median(pixels(s, d), SIDE)),
    "sig_motion_of_figure": lambda s, d: op.motion_signal(keyed(s, d)),
    "sig_video_times": _videos,
    "pose_facing": lambda s, d: op.facing(_vectors(s, d)),
    "pose_heading": lambda s, d: op.headings(_vectors(s, d).select(F.col("label").alias("key"), "across")),
    "pose_blend": _turns,
}
ORACLES = {
    "px_votes": f"""WITH {_VOTES} SELECT label, frame, "by", bx, array_to_string(votes, ',') AS votes, q, a FROM vo""",
    "px_clean": f"""WITH {_CLEAN} SELECT label, frame, "by", bx, q, a FROM cl""",
    "px_pixelated": f"""WITH RECURSIVE {_CLEAN}, ho AS (SELECT label, frame, "by", bx, q, a FROM cl WHERE frame = 0
   UNION ALL SELECT c.label, c.frame, c."by", c.bx, CASE WHEN c.a AND h.a AND h.q <> c.q AND c.votes[h.q + 1] > 0 AND c.votes[h.q + 1] >= c.votes[c.q + 1] - 2 AND (h.q = 0) = (c.q = 0) THEN h.q ELSE c.q END, c.a
   FROM ho h JOIN cl c ON c.label = h.label AND c."by" = h."by" AND c.bx = h.bx AND c.frame = h.frame + 1) SELECT * FROM ho""",
    "img_light_part": f"""WITH {BORDER}, v AS (SELECT p.label, p.frame, p.y, p.x, p.r::DOUBLE AS r, p.g::DOUBLE AS g, p.b::DOUBLE AS b, bg.r AS br, bg.g AS bgr, bg.b AS bb FROM px p JOIN bg ON bg.label = p.label AND bg.frame = p.frame),
 w AS (SELECT *, greatest(0, least(1, (greatest(r - br, g - bgr, b - bb) - 50) / 100)) AS up, sqrt((r - br) ** 2 + (g - bgr) ** 2 + (b - bb) ** 2) AS far,
   (0.299::DOUBLE * br + 0.587::DOUBLE * bgr + 0.114::DOUBLE * bb) - (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS darker,
   (r * br + g * bgr + b * bb) / (sqrt(r * r + g * g + b * b) * sqrt(br * br + bgr * bgr + bb * bb) + 0.000001::DOUBLE) AS cosine FROM v)
SELECT label, frame, y, x, round(greatest(up, CASE WHEN cosine > 0.97 AND darker > 6 THEN 0 ELSE greatest(0, least(1, (far - 45) / 55)) * greatest(0, least(1, 1 - (darker - 10) / 40)) END) + 0.000000001::DOUBLE, 6) AS light FROM w""",
    "sig_motion_of_figure": f"""WITH {KEYED}, l AS (SELECT *, floor(min(y) FILTER (alpha > 25) OVER w + (max(y) FILTER (alpha > 25) OVER w + 1 - min(y) FILTER (alpha > 25) OVER w) * 0.3::DOUBLE) AS lim FROM kf WINDOW w AS (PARTITION BY label, frame)),
 s AS (SELECT label, frame, count(*) FILTER (alpha > 127 AND y < lim) AS u, count(*) FILTER (alpha > 127) AS n FROM l GROUP BY label, frame)
SELECT label, frame, round((u - avg(u) OVER c) / (stddev_pop(u) OVER c + 0.000001::DOUBLE), 6) AS upper, round((n - avg(n) OVER c) / (stddev_pop(n) OVER c + 0.000001::DOUBLE), 6) AS area FROM s WINDOW c AS (PARTITION BY label)""",
    "sig_video_times": """WITH v AS (SELECT p_partkey AS key, (12 + p_size)::DOUBLE AS fps, least(12 + p_partkey % 300, floor((12 + p_size) * 5.0::DOUBLE)::BIGINT + 2) AS read, 100 + p_size * 20 AS w, 90 + p_size * 13 AS h FROM part),
 k AS (SELECT *, least(1, 640.0::DOUBLE / greatest(w, h)) AS k, ceil(round(least(read / fps, 5) * 24, 6))::BIGINT AS n FROM v)
SELECT key, i, least(read - 1, round_even(round(i / 24.0::DOUBLE * fps, 6), 0)::BIGINT) AS source, (floor(floor(w * k) / 2) * 2)::INT AS width, (floor(floor(h * k) / 2) * 2)::INT AS height FROM k, (SELECT unnest(range(130)) AS i) WHERE i < n""",
    "pose_facing": """WITH c AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 x AS (SELECT label || '-' || frame AS key, e[2] * e[6] - e[3] * e[5] AS x, e[3] * e[4] - e[1] * e[6] AS y, e[1] * e[5] - e[2] * e[4] AS z FROM c)
SELECT key, round(x / (sqrt(x * x + y * y + z * z) + 0.000000001::DOUBLE), 6) AS x, round(y / (sqrt(x * x + y * y + z * z) + 0.000000001::DOUBLE), 6) AS y, round(z / (sqrt(x * x + y * y + z * z) + 0.000000001::DOUBLE), 6) AS z FROM x""",
    "pose_heading": "SELECT label AS key, round(degrees(atan2(avg(-CAST(embedding[3] AS DOUBLE)), avg(CAST(embedding[1] AS DOUBLE)))), 6) AS yaw FROM embeddings GROUP BY label",
    "pose_blend": f"""WITH {_TURNS}, u AS (SELECT key || '-' || frame AS key, t, list_transform(a0, lambda v: v / sqrt(list_sum(list_transform(a0, lambda w: w * w)))) AS a, list_transform(b0, lambda v: v / sqrt(list_sum(list_transform(b0, lambda w: w * w)))) AS b FROM tu),
 d AS (SELECT key, t, a, CASE WHEN list_dot_product(a, b) < 0 THEN list_transform(b, lambda v: -v) ELSE b END AS b, least(1, abs(list_dot_product(a, b))) AS d FROM u),
 q AS (SELECT key, CASE WHEN d > 0.9995 THEN list_transform(range(1, 5), lambda i: a[i] + t * (b[i] - a[i])) ELSE list_transform(range(1, 5), lambda i: (sin((1 - t) * acos(d)) * a[i] + sin(t * acos(d)) * b[i]) / sin(acos(d))) END AS q FROM d),
 n AS (SELECT key, q, sqrt(list_dot_product(q, q)) AS n FROM q) SELECT key, round(q[1] / n, 6) AS w, round(q[2] / n, 6) AS x, round(q[3] / n, 6) AS y, round(q[4] / n, 6) AS z FROM n""",
}
