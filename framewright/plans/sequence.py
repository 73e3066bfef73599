"""Registered queries of the sequence operators, over embeddings as clips."""

from __future__ import annotations

from framewright.operators import sequence as op
from framewright.sources.tables import clips, table
from pyspark.sql import functions as F

CLIP = """clip AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
  CAST(embedding AS DOUBLE[]) AS e, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"""
DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) / len({a})"


def _curves(lo: int, hi: int) -> str:
    return f"""{CLIP}, curve AS (SELECT a.label, p.period, a.frame, {DIST.format(a='a.e', b='b.e')} AS d
  FROM clip a CROSS JOIN (SELECT unnest(range({lo}, {hi + 1})) AS period) p JOIN clip b ON b.label = a.label AND b.frame = a.frame + p.period),
 score AS (SELECT label, period, avg(d) AS score FROM curve GROUP BY ALL)"""


def _find(curve: str, name: str) -> str:
    return f"""{name}_s AS (SELECT label, period, avg(d) AS score FROM {curve} GROUP BY ALL),
 {name}_v AS (SELECT *, min(score) OVER (PARTITION BY label) AS best, lag(score) OVER (PARTITION BY label ORDER BY period) AS s0,
   lead(score) OVER (PARTITION BY label ORDER BY period) AS s1 FROM {name}_s),
 {name}_p AS (SELECT label, coalesce(min(period) FILTER (score <= s0 AND score <= s1 AND score <= best * 1.15), (min({{'s': score, 'p': period}})).p) AS period FROM {name}_v GROUP BY label),
 {name} AS (SELECT c.label, c.period, (min({{'d': c.d, 'f': c.frame}})).f AS start, round((min({{'d': c.d, 'f': c.frame}})).d, 6) AS seam
   FROM {curve} c JOIN {name}_p p ON c.label = p.label AND c.period = p.period GROUP BY ALL)"""


def _loop_sql() -> str:
    return f"""WITH {_curves(8, 30)}, {_find('curve', 'once')},
 r AS (SELECT label, period, round(score, 4) AS score FROM score),
 half AS (SELECT o.label, o.period AS p FROM once o JOIN r ON r.label = o.label GROUP BY o.label, o.period
   HAVING min(r.score) FILTER (r.period BETWEEN 2 * o.period - 2 AND 2 * o.period + 2) < 0.95 * min(r.score) FILTER (r.period = o.period)),
 sub AS (SELECT c.* FROM curve c JOIN half h ON c.label = h.label AND c.period BETWEEN 2 * h.p - 2 AND 2 * h.p + 2), {_find('sub', 'again')},
 cycle AS (SELECT * FROM once WHERE label NOT IN (SELECT label FROM half) UNION ALL SELECT * FROM again),
 ph AS (SELECT y.label, y.period, y.start, -(max({{'h': c.e[1], 'f': -c.frame}})).f - y.start AS phase, least(8, y.period) AS n
   FROM cycle y JOIN clip c ON c.label = y.label AND c.frame BETWEEN y.start AND y.start + y.period - 1 GROUP BY y.label, y.period, y.start)
SELECT label, slot, start + (phase + CAST(round_even(slot * period / n, 0) AS INT)) % period AS pick, round(n * 24 / period, 6) AS fps
FROM ph, (SELECT unnest(range(8)) AS slot) WHERE slot < n"""


ACTIVE = f"""{CLIP}, dd AS (SELECT c.label, c.frame, c.n, {DIST.format(a='c.e', b='f.e')} AS d FROM clip c JOIN clip f ON f.label = c.label AND f.frame = 0),
 lim AS (SELECT *, greatest(0.004, 0.2 * max(d) OVER (PARTITION BY label)) AS t FROM dd),
 act AS (SELECT label, coalesce(greatest(min(frame) FILTER (d > t) - 2, 0), 0) AS first, coalesce(least(max(frame) FILTER (d > t) + 2, max(n) - 1), max(n) - 1) AS last,
   -(max({{'d': d, 'f': -frame}})).f AS peak FROM lim GROUP BY label)"""

HOLD = f"""{ACTIVE}, st AS (SELECT a.label, a.frame, {DIST.format(a='a.e', b='b.e')} AS s FROM clip a JOIN clip b ON a.label = b.label AND b.frame = a.frame + 1),
 sl AS (SELECT *, greatest(0.002, 0.15 * max(s) OVER (PARTITION BY label)) AS t FROM st),
 mv AS (SELECT label, min(frame) AS a, max(frame) AS b FROM sl WHERE s > t GROUP BY label),
 en AS (SELECT dd.*, greatest(a - 2, 0) AS first, least(b + 3, n - 1) AS last FROM dd JOIN mv ON dd.label = mv.label),
 held AS (SELECT label, first, last, -(max({{'d': d, 'f': -frame}})).f AS peak FROM en WHERE frame <= last GROUP BY ALL)"""

PICK = f"""WITH {ACTIVE}, ev AS (SELECT act.*, i, first + CAST(round_even(i * (last - first) / 7, 0) AS INT) AS pick FROM act, (SELECT unnest(range(8)) AS i)),
 b AS (SELECT label, (min({{'g': abs(pick - peak), 'i': i}})).i AS best FROM ev GROUP BY label),
 f AS (SELECT DISTINCT ev.label, CASE WHEN i = best THEN peak ELSE pick END AS pick FROM ev JOIN b ON ev.label = b.label)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY pick) - 1 AS slot, pick FROM f"""

SEAM = f"""WITH {CLIP}, st AS (SELECT a.label, median({DIST.format(a='a.e', b='b.e')}) AS step FROM clip a JOIN clip b ON a.label = b.label AND b.frame = a.frame + 1 GROUP BY a.label),
 j AS (SELECT a.label, {DIST.format(a='a.e', b='b.e')} AS jump FROM clip a JOIN clip b ON a.label = b.label AND a.frame = a.n - 1 AND b.frame = 0)
SELECT j.label, round(jump, 6) AS jump, round(step, 6) AS step, jump > 0.01 AND jump > 2.2 * step AS bad FROM j JOIN st ON j.label = st.label"""

COMMON = f"""WITH {_curves(8, 40)}, r AS (SELECT label, period, round(score, 4) AS score FROM score),
 v0 AS (SELECT *, min(score) OVER (PARTITION BY label) AS best, lag(score) OVER (PARTITION BY label ORDER BY period) AS s0, lead(score) OVER (PARTITION BY label ORDER BY period) AS s1 FROM r),
 v AS (SELECT label, period, score / best AS rel FROM v0 WHERE score <= s0 AND score <= s1),
 b AS (SELECT label, (min({{'s': score, 'p': period}})).p AS best FROM r GROUP BY label),
 f AS (SELECT label, best / k AS f FROM b, (SELECT unnest([1, 2, 3]) AS k) WHERE best / k >= 7),
 x AS (SELECT f.label, f.f, CASE WHEN bool_or(v.period BETWEEN 0.8 * f.f AND 1.25 * f.f) THEN 0.0 ELSE 0.5 END AS extra FROM f LEFT JOIN v ON v.label = f.label AND v.rel <= 1.8 GROUP BY ALL),
 co AS (SELECT label, c2, min(abs(ln(f / (c2 / 2))) + extra) AS cost FROM x, (SELECT unnest(range(20, 81)) AS c2) GROUP BY ALL),
 t AS (SELECT c2, sum(cost) AS cost, count(*) AS dirs FROM co GROUP BY c2),
 c AS (SELECT max(c2) / 2 AS c, max(dirs) AS dirs FROM t WHERE cost <= (SELECT min(cost) + 0.01 * max(dirs) + 1e-9 FROM t)),
 a AS (SELECT k, k * c AS t, dirs FROM c, (SELECT unnest([1, 2]) AS k)),
 near AS (SELECT label, k, t, dirs, min({{'w': round(abs(ln(period / t)) + 0.3 * (rel - 1), 9), 'rel': rel, 'p': period}}) AS m FROM v JOIN a ON abs(ln(period / t)) <= ln(1.6) AND rel <= 3 GROUP BY ALL),
 votes AS (SELECT count(*) FILTER (n2.m.rel < 0.75 * n1.m.rel) AS votes FROM near n1 JOIN near n2 ON n1.label = n2.label AND n1.k = 1 AND n2.k = 2)
SELECT label, t AS cycle, near.m.p AS length FROM near, votes WHERE k = CASE WHEN 2 * votes > dirs THEN 2 ELSE 1 END"""

CENTRES = """WITH pt AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 me AS (SELECT label, i, round(avg(e[i]), 6) AS v FROM pt, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), ce AS (SELECT label AS k, list(v ORDER BY i) AS e FROM me GROUP BY label)
SELECT p.vec_id AS id, (min({'d': round(list_sum(list_transform(list_zip(p.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), 'k': c.k})).k AS k FROM pt p, ce c GROUP BY p.vec_id"""


def _nearest(spark, folder):
    points = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    return op.nearest_of(points.select("id", "e"), op.mean_vectors(points))


QUERIES = {
    "seq_score_curve": lambda s, d: op.score_curve(clips(s, d)),
    "seq_find_cycle": lambda s, d: op.find_cycle(op.lag_curves(clips(s, d), 8, 30)),
    "seq_pick_loop": lambda s, d: op.loop_picks(clips(s, d)),
    "seq_common_cycle": lambda s, d: op.common_cycle(op.score_curve(clips(s, d), 8, 40)),
    "seq_oneshot_window": lambda s, d: op.active_window(clips(s, d)),
    "seq_oneshot_window_hold": lambda s, d: op.active_window_hold(clips(s, d)),
    "seq_pick_oneshot": lambda s, d: op.oneshot_picks(op.active_window(clips(s, d))),
    "seq_seam": lambda s, d: op.seams(clips(s, d)),
    "seq_nearest_centre": _nearest,
}
ORACLES = {
    "seq_score_curve": f"WITH {_curves(8, 30)} SELECT label, period, round(score, 4) AS score FROM score",
    "seq_find_cycle": f"WITH {_curves(8, 30)}, {_find('curve', 'once')} SELECT * FROM once",
    "seq_pick_loop": _loop_sql(),
    "seq_common_cycle": COMMON,
    "seq_oneshot_window": f"WITH {ACTIVE} SELECT label, first, last, peak FROM act",
    "seq_oneshot_window_hold": f"WITH {HOLD} SELECT * FROM held UNION ALL SELECT label, first, last, peak FROM act WHERE label NOT IN (SELECT label FROM mv)",
    "seq_pick_oneshot": PICK,
    "seq_seam": SEAM,
    "seq_nearest_centre": CENTRES,
}
