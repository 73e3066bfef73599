"""Registered queries of the signal operators, over events as signals."""

from __future__ import annotations

from framewright.operators import signal as op
from framewright.sources.tables import signals
from pyspark.sql import functions as F

SIG = """sig AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
TYPED = SIG.replace("AS frame, value,", "AS frame, value, event_type,")
Z = f"{SIG}, z AS (SELECT user_id, frame, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6), 6) AS z FROM sig WINDOW w AS (PARTITION BY user_id))"
NEAR = """SELECT user_id, frame, last_value(CASE WHEN {k} THEN value END IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN {k} THEN frame END IGNORE NULLS) OVER b AS f0,
  first_value(CASE WHEN {k} THEN value END IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN {k} THEN frame END IGNORE NULLS) OVER a AS f1 FROM sig
  WINDOW b AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
SMOOTH = """WITH {sig}, o AS (SELECT unnest(range(-2, 3)) AS o)
SELECT s.user_id, s.frame, round(sum(exp(-(o * o) / (2 * (2 / 1.5) * (2 / 1.5))) * v.value) / sum(exp(-(o * o) / (2 * (2 / 1.5) * (2 / 1.5)))), 6) AS smooth
FROM sig s CROSS JOIN o JOIN sig v ON v.user_id = s.user_id AND v.frame = {at} GROUP BY s.user_id, s.frame"""

QUERIES = {
    "sig_motion_zscore": lambda s, d: op.zscores(signals(s, d)),
    "sig_best_lag": lambda s, d: op.best_lags(signals(s, d)),
    "sig_stance_slope": lambda s, d: op.stance_slopes(signals(s, d)),
    "sig_active_speed": lambda s, d: op.active_speed(signals(s, d)),
    "sig_smooth_clamp": lambda s, d: op.smoothed(signals(s, d)),
    "sig_smooth_wrap": lambda s, d: op.smoothed(signals(s, d), wrap=True),
    "sig_gap_fill": lambda s, d: op.gap_filled(signals(s, d), F.col("event_type") == "click"),
    "sig_resample": lambda s, d: op.resampled(signals(s, d)),
    "sig_loop_blend": lambda s, d: op.loop_blended(signals(s, d)),
    "key_interpolate": lambda s, d: op.key_interpolated(signals(s, d)),
    "sig_drift": lambda s, d: op.drift(signals(s, d), 60.0),
    "sig_bg_changed": lambda s, d: op.changed_from_first(signals(s, d), 60.0),
    "sig_playback": lambda s, d: op.played(signals(s, d)),
}
ORACLES = {
    "sig_motion_zscore": f"WITH {Z} SELECT * FROM z",
    "sig_best_lag": f"""WITH {Z}, sc AS (SELECT a.user_id AS user_a, b.user_id AS user_b, lag, round(avg(a.z * b.z), 6) AS score FROM z a CROSS JOIN (SELECT unnest(range(-10, 11)) AS lag) l
  JOIN z b ON b.user_id = a.user_id + 1 AND b.frame = a.frame + lag GROUP BY ALL HAVING count(*) >= 24)
SELECT user_a, user_b, -(max({{'s': score, 'l': -lag}})).l AS lag, (max({{'s': score, 'l': -lag}})).s AS score FROM sc GROUP BY user_a, user_b""",
    "sig_stance_slope": f"""WITH {SIG}, st AS (SELECT user_id, frame, lead(value) OVER (PARTITION BY user_id ORDER BY frame) - value AS d FROM sig),
 sg AS (SELECT *, CASE WHEN count(*) FILTER (d < -0.5) OVER w >= count(*) FILTER (d > 0.5) OVER w THEN -1 ELSE 1 END AS sign FROM st WHERE d IS NOT NULL WINDOW w AS (PARTITION BY user_id)),
 mv AS (SELECT *, sign * d > 0.5 AS moving FROM sg),
 il AS (SELECT *, avg(moving::INT) OVER (PARTITION BY user_id) AS share, sum((NOT moving)::INT) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM mv),
 rn AS (SELECT user_id, island, min(frame) AS a, max(frame) + 1 AS b, count(*) AS m FROM il WHERE moving AND share >= 0.25 GROUP BY ALL HAVING count(*) >= 3),
 sl AS (SELECT r.user_id, r.island, r.m, abs(regr_slope(s.value, s.frame)) AS s FROM rn r JOIN sig s ON s.user_id = r.user_id AND s.frame BETWEEN r.a AND r.b GROUP BY ALL)
SELECT user_id, round(sum(s * m) / sum(m), 4) AS slope FROM sl GROUP BY user_id""",
    "sig_active_speed": f"""WITH {SIG}, sp AS (SELECT user_id, frame, n, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)), 0) AS s FROM sig),
 tp AS (SELECT *, 0.06 * max(s) OVER (PARTITION BY user_id) AS t FROM sp)
SELECT user_id, coalesce(greatest(min(frame) FILTER (s > t) - 2, 0), 0) AS first, coalesce(least(max(frame) FILTER (s > t) + 2, max(n) - 1), max(n) - 1) AS last,
 -(max({{'s': s, 'f': -frame}})).f AS peak FROM tp GROUP BY user_id""",
    "sig_smooth_clamp": SMOOTH.format(sig=SIG, at="greatest(0, least(s.n - 1, s.frame + o))"),
    "sig_smooth_wrap": SMOOTH.format(sig=SIG, at="((s.frame + o) % s.n + s.n) % s.n"),
    "sig_gap_fill": f"WITH {TYPED}, nr AS ({NEAR.format(k=chr(101) + 'vent_type <> ' + chr(39) + 'click' + chr(39))}) SELECT user_id, frame, round(coalesce(CASE WHEN f1 = f0 THEN v0 ELSE v0 + (v1 - v0) * (frame - f0) / (f1 - f0) END, v0, v1), 6) AS filled FROM nr",
    "sig_resample": f"""WITH {SIG}, c AS (SELECT DISTINCT user_id, n FROM sig), m AS (SELECT user_id, n, unnest(range(CAST(ceil((n - 1) * 0.8) AS BIGINT) + 1)) AS i FROM c),
 s AS (SELECT user_id, i, least(n - 1, CAST(round_even(i * 1.25, 0) AS BIGINT)) AS source FROM m) SELECT s.*, sig.value FROM s JOIN sig ON sig.user_id = s.user_id AND sig.frame = s.source""",
    "sig_loop_blend": f"""WITH {SIG}, u AS (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY frame) AS v0, least(12, n) AS w FROM sig),
 e AS (SELECT *, CASE WHEN frame >= n - w THEN (frame - (n - w) + 1) / (w + 1) ELSE 0 END AS x FROM u),
 b AS (SELECT user_id, frame AS at, n, value + (v0 - value) * (x * x * (3 - 2 * x)) AS v FROM e)
SELECT b.user_id, f.frame, round(b.v, 6) AS blended FROM b JOIN (SELECT unnest(range(100)) AS frame) f ON f.frame % b.n = b.at""",
    "key_interpolate": f"""WITH {SIG}, nr AS ({NEAR.format(k='frame % 5 = 0')}), u AS (SELECT *, CASE WHEN f1 > f0 THEN (frame - f0) / (f1 - f0) ELSE 0 END AS u FROM nr)
SELECT user_id, frame AS t, round(v0 + (coalesce(v1, v0) - v0) * u * u * (3 - 2 * u), 6) AS pose FROM u""",
    "sig_drift": f"WITH {SIG} SELECT user_id, 2 * count(*) FILTER (frame % 2 = 0 AND value > 60) AS bad, count(*) AS total FROM sig GROUP BY user_id",
    "sig_bg_changed": f"""WITH {SIG}, a AS (SELECT user_id, abs(value - first_value(value) OVER (PARTITION BY user_id ORDER BY frame)) > 60 AS away FROM sig)
SELECT user_id, count(*) FILTER (away) AS changed, avg(away::INT) > 0.1 AS bad FROM a GROUP BY user_id""",
    "sig_playback": f"""WITH {SIG}, t AS (SELECT user_id, n, unnest(range(120)) AS tick FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)),
 f AS (SELECT user_id, tick, CAST(floor(tick * 12 / 60.0) AS BIGINT) % n AS frame FROM t)
SELECT f.user_id, f.tick, f.frame, (SELECT max(value) FROM sig WHERE sig.user_id = f.user_id AND sig.frame = f.frame) AS value, round(((-3.5 * f.tick) % 64 + 64) % 64, 6) AS scroll FROM f""",
}
