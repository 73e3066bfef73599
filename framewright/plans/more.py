"""Registered queries of further operators: stills, shifts, head rows, drawing order, limits, names and fields."""

from __future__ import annotations

from framewright.functions import text as fn
from framewright.operators import pose, raster, sequence, signal
from framewright.plans.pose import VIEW
from framewright.plans.raster import PIX
from framewright.plans.sequence import ACTIVE
from framewright.plans.signal import SIG
from framewright.sources.tables import SIDE, clips, pixels, signals, table
from pyspark.sql import functions as F


def _shifted(spark, folder):
    clip = clips(spark, folder)
    ends = clip.select("label", "n").distinct()
    lags = ends.select("label", (F.col("label") % 5 - 2).alias("lag"))
    return sequence.shifted_picks(sequence.oneshot_picks(sequence.active_window(clip)), lags, ends)


def _limits(spark, folder):
    part = table(spark, folder, "part")
    return part.select("p_partkey", fn.clamped(F.col("p_size") * 2, 0, 80).cast("int").alias("angle"), fn.clamped(F.col("p_size") * 4, 24, 160).cast("int").alias("pixels"), F.round(fn.clamped(F.col("p_retailprice") / 20, 0.5, 60.0), 6).alias("fps"))


def _names(spark, folder):
    pages = table(spark, folder, "pages")
    last = F.regexp_extract("url", "([^/]*)$", 1)
    return pages.select("page_id", fn.host_of(F.col("url")).alias("host"), fn.is_safe_name(last).alias("safe"))


QUERIES = {
    "sig_stills": lambda s, d: signal.stills(signals(s, d)),
    "pick_shifted": _shifted,
    "img_head_rows": lambda s, d: raster.head_rows(pixels(s, d), SIDE),
    "img_best_shift": lambda s, d: raster.best_shift(pixels(s, d), SIDE),
    "pose_drawn_order": lambda s, d: pose.drawn_order(pose.projected(pose.chain_joints(clips(s, d)))),
    "rule_limits": _limits,
    "txt_names": _names,
    "store_game_fields": lambda s, d: table(s, d, "events").select("event_id", fn.kept_fields(F.col("props"), ["k", "hit"]).alias("fields")),
}
ORACLES = {
    "sig_stills": f"""WITH {SIG}, c AS (SELECT DISTINCT user_id, n FROM sig), f AS (SELECT DISTINCT user_id, CAST(round_even(i * (n - 1) / 9, 0) AS BIGINT) AS frame FROM c, (SELECT unnest(range(10)) AS i))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS i, frame, round(frame / 24, 6) AS t FROM f""",
    "pick_shifted": f"""WITH {ACTIVE}, ev AS (SELECT act.*, i, first + CAST(round_even(i * (last - first) / 7, 0) AS INT) AS pick FROM act, (SELECT unnest(range(8)) AS i)),
 b AS (SELECT label, (min({{'g': abs(pick - peak), 'i': i}})).i AS best FROM ev GROUP BY label), f AS (SELECT DISTINCT ev.label, CASE WHEN i = best THEN peak ELSE pick END AS pick FROM ev JOIN b ON ev.label = b.label),
 p AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY pick) - 1 AS slot, pick FROM f), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT p.label, slot, greatest(0, least(n - 1, pick + p.label % 5 - 2)) AS pick FROM p JOIN n ON n.label = p.label""",
    "img_head_rows": f"""WITH {PIX}, rw AS (SELECT label, frame, y, max(x) - min(x) + 1 AS width FROM so GROUP BY ALL), sp AS (SELECT label, frame, min(y) AS top, max(y) AS bottom FROM rw GROUP BY label, frame),
 gd AS (SELECT sp.*, ys.y, coalesce(rw.width, 0) AS width FROM sp JOIN (SELECT unnest(range(8)) AS y) ys ON ys.y BETWEEN sp.top AND sp.bottom LEFT JOIN rw ON rw.label = sp.label AND rw.frame = sp.frame AND rw.y = ys.y),
 sm AS (SELECT *, bottom - top + 1 AS h, round((coalesce(lag(width) OVER w, 0) + width + coalesce(lead(width) OVER w, 0)) / 3, 6) AS s FROM gd WINDOW w AS (PARTITION BY label, frame ORDER BY y)),
 ab AS (SELECT *, max(s) OVER (PARTITION BY label, frame ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM sm),
 lo AS (SELECT label, frame, top, h, min({{'s': s, 'y': y, 'a': above}}) AS m FROM ab WHERE (y - top) / h BETWEEN 0.15::DOUBLE AND 0.55::DOUBLE GROUP BY ALL)
SELECT label, frame, top, CASE WHEN lo.m.s > 0.8 * lo.m.a THEN top + CAST(round_even(0.3::DOUBLE * h, 0) AS INT) ELSE lo.m.y END AS neck FROM lo""",
    "img_best_shift": f"""WITH {PIX}, q AS (SELECT label, frame, y, x, CAST(floor(luma * 4 / 256) AS INT) AS q FROM pl), o AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
 h AS (SELECT q.label, q.frame, dy, dx, count(*) AS score FROM q a JOIN o ON a.frame = 0 AND a.y < 4 JOIN q ON q.label = a.label AND q.y = a.y + dy AND q.x = a.x + dx AND q.q = a.q GROUP BY ALL),
 b AS (SELECT label, frame, max({{'s': score, 'y': -abs(dy), 'x': -abs(dx), 'dy': dy, 'dx': dx}}) AS m FROM h GROUP BY label, frame) SELECT label, frame, b.m.dy AS dy, b.m.dx AS dx, b.m.s AS score FROM b""",
    "pose_drawn_order": f"WITH {VIEW} SELECT label, frame, side, joint, row_number() OVER (PARTITION BY label, frame, side ORDER BY v, joint) - 1 AS z FROM vw",
    "rule_limits": "SELECT p_partkey, greatest(0, least(80, p_size * 2)) AS angle, greatest(24, least(160, p_size * 4)) AS pixels, round(greatest(0.5, least(60.0, p_retailprice / 20)), 6) AS fps FROM part",
    "txt_names": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_full_match(regexp_extract(url, '([^/]*)$', 1), '[a-z0-9-]+') AS safe FROM pages",
    "store_game_fields": "SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS fields FROM events",
}
