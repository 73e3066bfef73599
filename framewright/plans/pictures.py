"""Registered queries over pictures drawn from vectors, and their SQL: regions, cutouts, matting, effects, palettes.

The SQL finds connected parts in its own way: runs of a line are nodes, and a recursive query carries numbers from run to run.
Results are digests a frame: counts, sums, and sums weighted by place, so that every pixel matters.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewright.operators import cutout, effects, matting, palette, regions, resample
from framewright.operators.pixel_art import voted
from framewright.operators.raster import FRAME, luma
from framewright.plans.pixel_art import PALETTE
from framewright.sources.tables import BACKGROUNDS, PICTURE, clips, pictures, table
from framewright.streaming.drift import drift_windows

N = PICTURE
_Q = "CAST(floor(alpha * 10000 + 0.5::DOUBLE) AS BIGINT)"


def _at():
    return F.col("y") * N + F.col("x") + 1


def alpha_digest(rows, *more):
    """(label, frame, shown, mass, moment): pixels over a half, and the alphas' sum, plain and weighted by place."""
    q = F.floor(F.col("alpha") * 10000 + 0.5).cast("long")
    return rows.groupBy(*FRAME).agg(F.count_if(F.col("alpha") > 0.5).alias("shown"), F.sum(q).alias("mass"), F.sum(q * _at()).alias("moment"), *more)


def sprite_digest(rows):
    """(label, frame, shown, opacity, moment): pixels with opacity, its sum, and the colours weighted by place."""
    colour = F.col("r") * 3 + F.col("g") * 5 + F.col("b") * 7 + F.col("a")
    return rows.groupBy(*FRAME).agg(F.count_if(F.col("a") > 0).alias("shown"), F.sum("a").cast("long").alias("opacity"), F.sum((colour * _at()).cast("long")).alias("moment"))


def _small_digest(rows):
    """(label, frame, moment, places) of pixels with colours from 0 to 1."""
    value = F.floor((F.col("r") + 2 * F.col("g") + 4 * F.col("b")) * 10000 + 0.3).cast("long")
    return rows.groupBy(*FRAME).agg(F.sum(value * (F.col("y") * 20 + F.col("x") + 1)).alias("moment"), F.count(F.lit(1)).alias("places"))


def flag_digest(rows, flag):
    return rows.groupBy(*FRAME).agg(F.count_if(flag).alias("pixels"), F.sum(F.when(flag, _at()).otherwise(0).cast("long")).alias("moment"))


def _alpha_sql(src: str, more: str = "") -> str:
    return f"SELECT label, frame, count(*) FILTER (alpha > 0.5) AS shown, CAST(sum({_Q}) AS BIGINT) AS mass, CAST(sum({_Q} * (y * {N} + x + 1)) AS BIGINT) AS moment{more} FROM {src} GROUP BY label, frame"


def _sprite_sql(src: str) -> str:
    return f"""SELECT label, frame, count(*) FILTER (a > 0) AS shown, CAST(sum(a) AS BIGINT) AS opacity, CAST(sum((r * 3 + g * 5 + b * 7 + a) * (y * {N} + x + 1)) AS BIGINT) AS moment
 FROM {src} GROUP BY label, frame"""


def _flag_sql(src: str, flag: str) -> str:
    return f"SELECT label, frame, count(*) FILTER ({flag}) AS pixels, CAST(sum(CASE WHEN {flag} THEN y * {N} + x + 1 ELSE 0 END) AS BIGINT) AS moment FROM {src} GROUP BY label, frame"


def _channel(k: int, shift: int) -> str:
    back = f"CASE back WHEN 0 THEN {BACKGROUNDS[0][k]} WHEN 1 THEN {BACKGROUNDS[1][k]} ELSE {BACKGROUNDS[2][k]} END"
    own = f"CASE WHEN glow > 0.2::DOUBLE THEN {(90, 150, 250)[k]} + 2 * j WHEN glow < -0.2::DOUBLE THEN 247 + 2 * j ELSE floor(128 + 700 * e[(c + {shift}) % 64 + 1]) + j END"
    return f"CAST(greatest(0, least(255, CASE WHEN fig THEN {own} WHEN shade THEN {back} - 15 + j ELSE {back} + CASE j WHEN 4 THEN 1 WHEN -4 THEN -1 ELSE 0 END END)) AS INT)"


PIC = f"""c AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
 p0 AS (SELECT label, frame, e, CAST(p // {N} AS INT) AS y, CAST(p % {N} AS INT) AS x, (p // {N}) // 4 AS sy, (p % {N}) // 4 AS sx FROM c, range({N * N}) t(p)),
 p1 AS (SELECT *, CAST(sy * 8 + sx AS INT) AS c, (y * 7 + x * 13 + frame * 5) % 9 - 4 AS j, label % 3 AS back FROM p0),
 p2 AS (SELECT *, e[c + 1] - CASE WHEN least(sy, sx) = 0 OR greatest(sy, sx) = 7 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS v, e[(c + 11) % 64 + 1] AS glow FROM p1),
 p3 AS (SELECT *, v + 0.0075::DOUBLE * j > 0.02::DOUBLE AS fig, v > -0.04::DOUBLE AS shade FROM p2),
 pic AS MATERIALIZED (SELECT label, frame, y, x, {_channel(0, 5)} AS r, {_channel(1, 21)} AS g, {_channel(2, 42)} AS b, CAST(CASE WHEN fig THEN 255 WHEN shade THEN 40 + 5 * j ELSE 0 END AS INT) AS a,
   round(greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + 4 * v + 1.5::DOUBLE * e[(c + 33) % 64 + 1])), 6) AS model FROM p3)"""
LUMA = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"


def parts_sql(src: str, on: str, out: str, eight: bool, same: str = "0") -> str:
    """CTEs up to ``out``: ``src`` with the column part, by runs and a recursive query."""
    e = int(eight)
    return f"""{out}_m AS (SELECT label, frame, y, x, {same} AS s FROM {src} WHERE {on}),
 {out}_g AS (SELECT *, x - row_number() OVER (PARTITION BY label, frame, y, s ORDER BY x) AS g FROM {out}_m),
 {out}_r AS (SELECT label, frame, y, s, min(x) AS x0, max(x) AS x1, y * 65536 + min(x) AS id FROM {out}_g GROUP BY label, frame, y, s, g),
 {out}_e AS (SELECT a.label, a.frame, a.id AS i, b.id AS k FROM {out}_r a JOIN {out}_r b ON a.label = b.label AND a.frame = b.frame AND a.s = b.s AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + {e} AND b.x0 <= a.x1 + {e}),
 {out}_t AS (SELECT * FROM {out}_r r WHERE NOT EXISTS (SELECT 1 FROM {out}_e e WHERE e.label = r.label AND e.frame = r.frame AND e.i = r.id AND e.k < r.id)),
 {out}_c(label, frame, id, part) AS (SELECT label, frame, id, id FROM {out}_t UNION SELECT e.label, e.frame, e.k, c.part FROM {out}_c c JOIN {out}_e e ON e.label = c.label AND e.frame = c.frame AND e.i = c.id),
 {out}_l AS (SELECT label, frame, id, min(part) AS part FROM {out}_c GROUP BY label, frame, id),
 {out}_p AS (SELECT g.label, g.frame, g.y, g.x, l.part FROM {out}_g g JOIN {out}_r r ON r.label = g.label AND r.frame = g.frame AND r.y = g.y AND r.s = g.s AND g.x BETWEEN r.x0 AND r.x1 JOIN {out}_l l ON l.label = r.label AND l.frame = r.frame AND l.id = r.id),
 {out} AS (SELECT s.*, p.part FROM {src} s LEFT JOIN {out}_p p ON p.label = s.label AND p.frame = s.frame AND p.y = s.y AND p.x = s.x)"""


def spread_sql(src: str, name: str, on: str, out: str, radius: int, shrink: bool = False) -> str:
    """CTEs up to ``out``: ``src`` with the column name: the mask grown or shrunk by ``radius``."""
    f = "bool_and" if shrink else "bool_or"
    over = f"ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"""{out}_1 AS (SELECT *, {f}(coalesce({on}, false)) OVER (PARTITION BY label, frame, y ORDER BY x {over}) AS {name}_1 FROM {src}),
 {out} AS (SELECT * EXCLUDE ({name}_1), {f}({name}_1) OVER (PARTITION BY label, frame, x ORDER BY y {over}) AS {name} FROM {out}_1)"""


def opened_sql(src: str, name: str, on: str, out: str, radius: int = 1) -> str:
    small, wide = spread_sql(src, f"{name}_s", on, f"{out}_o", radius, True), spread_sql(f"{out}_o", name, f"{name}_s", f"{out}_p", radius)
    return f"{small},\n {wide}, {out} AS (SELECT * EXCLUDE ({name}_s) FROM {out}_p)"


def areas_sql(src: str, out: str) -> str:
    return f"{out}_n AS (SELECT label, frame, part, count(*) AS area FROM {src} WHERE part IS NOT NULL GROUP BY ALL), {out} AS (SELECT s.*, n.area, max(n.area) OVER (PARTITION BY s.label, s.frame) AS most FROM {src} s LEFT JOIN {out}_n n ON n.label = s.label AND n.frame = s.frame AND n.part = s.part)"


def disc_sql(src: str, name: str, on: str, out: str, radius: int) -> str:
    """CTEs up to ``out``: ``src`` with name: a pixel of the mask is in a disc around the pixel, by a join with the disc's places."""
    places = ", ".join(f"({dy}, {dx})" for dy in range(-radius, radius + 1) for dx in range(-round(math.sqrt(radius * radius - dy * dy)), round(math.sqrt(radius * radius - dy * dy)) + 1))
    return f"""{out}_d(dy, dx) AS (VALUES {places}), {out}_n AS (SELECT DISTINCT label, frame, y + dy AS y, x + dx AS x FROM {src}, {out}_d WHERE {on}),
 {out} AS (SELECT s.*, n.y IS NOT NULL AS {name} FROM {src} s LEFT JOIN {out}_n n ON n.label = s.label AND n.frame = s.frame AND n.y = s.y AND n.x = s.x)"""


def blur_sql(src: str, names: list[str], sigma: float, out: str) -> str:
    """CTEs up to ``out``: ``src`` with columns b_<name>: joined with the mirrored neighbours, along lines, then columns."""
    size = round(sigma * 8 + 1) | 1
    raw = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-(size // 2), size // 2 + 1)}
    total = sum(raw.values())
    kernel = ", ".join(f"({k}, {w / total!r}::DOUBLE)" for k, w in raw.items())
    turn = lambda v: f"CASE WHEN {v} < 0 THEN -({v}) WHEN {v} >= {N} THEN {2 * (N - 1)} - ({v}) ELSE {v} END"
    first = ", ".join(f"sum(w * s.{n}) AS {n}" for n in names)
    return f"""{out}_k(k, w) AS (VALUES {kernel}), {out}_x AS (SELECT p.label, p.frame, p.y, p.x, {first} FROM {src} p CROSS JOIN {out}_k JOIN {src} s ON s.label = p.label AND s.frame = p.frame AND s.y = p.y AND s.x = {turn('p.x + k')} GROUP BY ALL),
 {out}_y AS (SELECT p.label, p.frame, p.y, p.x, {first} FROM {out}_x p CROSS JOIN {out}_k JOIN {out}_x s ON s.label = p.label AND s.frame = p.frame AND s.x = p.x AND s.y = {turn('p.y + k')} GROUP BY ALL),
 {out} AS (SELECT s.*, {', '.join(f'u.{n} AS b_{n}' for n in names)} FROM {src} s JOIN {out}_y u ON u.label = s.label AND u.frame = s.frame AND u.y = s.y AND u.x = s.x)"""


def back_sql(pic: str = "pic", out: str = "src") -> str:
    """CTEs up to ``out``: ``pic`` with its background, distances from it, and whether that is green, or a key colour."""
    lines = " UNION ALL ".join(f"SELECT * FROM {pic} WHERE {c} = {v}" for c in "yx" for v in (0, N - 1))
    return f"""{out}_bg AS (SELECT label, frame, median(r) AS bg_r, median(g) AS bg_g, median(b) AS bg_b FROM ({lines}) GROUP BY label, frame),
 {out} AS MATERIALIZED (SELECT p.*, bg_r, bg_g, bg_b, round(sqrt((r - bg_r) ** 2 + (g - bg_g) ** 2 + (b - bg_b) ** 2), 9) AS far, bg_g - greatest(bg_r, bg_b) > 50 AS green,
   least(bg_r, bg_b) - bg_g > 80 OR bg_g - greatest(bg_r, bg_b) > 50 AS key FROM {pic} p JOIN {out}_bg q ON q.label = p.label AND q.frame = p.frame)"""


BACK = back_sql()


def lanczos_sql(src: str, names: str, to: int, out: str) -> str:
    """CTEs up to ``out``: ``src`` resized to ``to`` x ``to`` by Lanczos weights of 22 binary digits, lines first; bytes after each pass."""
    step = N / to
    byte = lambda c: f"CAST(greatest(0, least(255, (sum({c} * w) + 2097152) >> 22)) AS INT) AS {c}"
    both = ", ".join(byte(c) for c in names)
    return f"""{out}_0 AS (SELECT t, s, (t + 0.5::DOUBLE) * {step!r}::DOUBLE AS mid FROM range({to}) a(t), range({N}) b(s)),
 {out}_1 AS (SELECT t, s, pi() * (s + 0.5::DOUBLE - mid) / {max(step, 1.0)!r}::DOUBLE AS v FROM {out}_0 WHERE s >= greatest(0, trunc(mid - {3 * max(step, 1.0)!r}::DOUBLE + 0.5)) AND s < least({N}, trunc(mid + {3 * max(step, 1.0)!r}::DOUBLE + 0.5))),
 {out}_2 AS (SELECT t, s, CASE WHEN v = 0 THEN 1 WHEN abs(v) < 3 * pi() THEN sin(v) * sin(v / 3) * 3 / (v * v) ELSE 0 END AS raw FROM {out}_1),
 {out}_w AS (SELECT t, s, CAST(sign(raw) * floor(abs(raw / sum(raw) OVER (PARTITION BY t)) * 4194304 + 0.5) AS BIGINT) AS w FROM {out}_2),
 {out}_x AS (SELECT label, frame, y, CAST(t AS INT) AS x, {both} FROM {src} JOIN {out}_w ON s = x GROUP BY label, frame, y, t),
 {out} AS (SELECT label, frame, CAST(t AS INT) AS y, x, {both} FROM {out}_x JOIN {out}_w ON s = y GROUP BY label, frame, t, x)"""


BORDER = f"(x = 0 OR y = 0 OR x = {N - 1} OR y = {N - 1})"
clip = lambda v: f"greatest(0::DOUBLE, least(1::DOUBLE, {v}))"


def blots_sql(src: str, out: str, least: int, share: float, halo: int) -> str:
    return (
        parts_sql(src, "alpha > 0.5", f"{out}_b", True) + ",\n " + areas_sql(f"{out}_b", f"{out}_a") + ",\n "
        + spread_sql(f"{out}_a", "near", f"part IS NOT NULL AND area >= greatest({least}, {share}::DOUBLE * most)", f"{out}_w", halo)
        + f",\n {out} AS MATERIALIZED (SELECT * EXCLUDE (part, area, most, near, alpha), CASE WHEN near OR most IS NULL THEN alpha ELSE 0::DOUBLE END AS alpha FROM {out}_w)"
    )


def plain_sql(src: str, out: str) -> str:
    return (
        parts_sql(src, "far < 40", f"{out}_f", False)
        + f",\n {out}_q AS (SELECT *, part IS NOT NULL AND bool_or({BORDER}) OVER (PARTITION BY label, frame, part) AS outer_ FROM {out}_f),"
        + f" {out}_s AS (SELECT * EXCLUDE (part, outer_), CASE WHEN outer_ THEN {clip('(far - 12) / 28')} ELSE 1::DOUBLE END AS alpha FROM {out}_q),\n " + blots_sql(f"{out}_s", out, 50, 0.02, 2)
    )


def chroma_sql(src: str, out: str) -> str:
    lines = " UNION ALL ".join(f"SELECT label, frame, m FROM {out}_m WHERE {c} = {v}" for c in "yx" for v in (0, N - 1))
    return f"""{out}_m AS (SELECT *, CASE WHEN green THEN g - greatest(r, b) ELSE least(r, b) - g END / 255.0::DOUBLE AS m FROM {src}),
 {out}_v AS (SELECT label, frame, greatest(0.2::DOUBLE, median(m)) AS level FROM ({lines}) GROUP BY label, frame),
 {out}_s AS (SELECT m.* EXCLUDE (m), round(1 - {clip('(m / level - 0.2::DOUBLE) / (0.6::DOUBLE - 0.2::DOUBLE)')}, 9) AS alpha FROM {out}_m m JOIN {out}_v v ON v.label = m.label AND v.frame = m.frame),
 """ + blots_sql(f"{out}_s", out, 30, 0.002, 3)


def frame_sql(out: str, src: str = "src") -> str:
    return f"""{out}_sk AS (SELECT * FROM {src} WHERE key), {out}_sp AS (SELECT * FROM {src} WHERE NOT key), {chroma_sql(f'{out}_sk', f'{out}_ck')}, {plain_sql(f'{out}_sp', f'{out}_cp')},
 {out} AS MATERIALIZED (SELECT * FROM {out}_ck UNION ALL BY NAME SELECT * FROM {out}_cp)"""


def refined_sql(src: str, out: str) -> str:
    core = spread_sql(src, "core_", "alpha > 0.5", f"{out}_h", 2, True)
    dd = "round((fr - bg_r) * (fr - bg_r) + (fg - bg_g) * (fg - bg_g) + (fb - bg_b) * (fb - bg_b), 6)"
    return f"""{core}, {out}_i AS (SELECT *, core_::INT::DOUBLE AS core, r * core_::INT AS cr, g * core_::INT AS cg, b * core_::INT AS cb FROM {out}_h), {blur_sql(f'{out}_i', ['core', 'cr', 'cg', 'cb'], 2.8, f'{out}_u')},
 {out}_n AS (SELECT *, round(b_cr / greatest(b_core, 0.0001::DOUBLE), 6) AS fr, round(b_cg / greatest(b_core, 0.0001::DOUBLE), 6) AS fg, round(b_cb / greatest(b_core, 0.0001::DOUBLE), 6) AS fb FROM {out}_u),
 {out}_t AS (SELECT *, {clip(f'((r - bg_r) * (fr - bg_r) + (g - bg_g) * (fg - bg_g) + (b - bg_b) * (fb - bg_b)) / greatest({dd}, 1::DOUBLE)')} AS t, alpha > 0.5 AND NOT core_ AND round(b_core, 9) > 0.02::DOUBLE AND {dd} > 400 AS ok FROM {out}_n),
 {out} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN ok THEN fr ELSE r::DOUBLE END AS r, CASE WHEN ok THEN fg ELSE g::DOUBLE END AS g, CASE WHEN ok THEN fb ELSE b::DOUBLE END AS b, CASE WHEN ok THEN round(least(alpha, t), 9) ELSE alpha END AS alpha) FROM {out}_t)"""


byte = lambda v: f"CAST(floor(round(greatest(0::DOUBLE, least(255::DOUBLE, {v})), 5)) AS INT)"
clean = lambda c: byte(f"({c} - (1 - alpha) * bg_{c}) / greatest(alpha, 0.05::DOUBLE)")
PACK = "CAST(round_even(round(alpha * 255, 6), 0) AS INT)"


def cutouts_sql(src: str, out: str, keep: str = "") -> str:
    """CTEs up to ``out``: sprites of ``src``."""
    base = ", ".join(f"CASE WHEN key OR alpha <= 0.05 THEN {c} ELSE {clean(c)} END AS {c}" for c in "rgb")
    return f"""{out}_a AS (SELECT * REPLACE ({base}) FROM {src}), {refined_sql(f'{out}_a', f'{out}_r')}, {out}_y AS (SELECT * REPLACE ({byte('r')} AS r, {byte('g')} AS g, {byte('b')} AS b) FROM {out}_r),
 {out}_z AS (SELECT * REPLACE (r - CASE WHEN key AND NOT green THEN greatest(0, least(r, b) - g) ELSE 0 END AS r, g - CASE WHEN key AND green THEN greatest(0, g - greatest(r, b)) ELSE 0 END AS g,
   b - CASE WHEN key AND NOT green THEN greatest(0, least(r, b) - g) ELSE 0 END AS b, {PACK} AS a) FROM {out}_y),
 {out} AS (SELECT * REPLACE (CASE WHEN a > 0 THEN r ELSE 0 END AS r, CASE WHEN a > 0 THEN g ELSE 0 END AS g, CASE WHEN a > 0 THEN b ELSE 0 END AS b) FROM {out}_z)"""


def blobs_sql(src: str, on: str, out: str) -> str:
    return opened_sql(src, "thick", on, f"{out}_k") + ",\n " + parts_sql(f"{out}_k", "thick", f"{out}_q", True) + f""",
 {out}_n AS (SELECT label, frame, part, count(*) AS area FROM {out}_q WHERE part IS NOT NULL GROUP BY ALL HAVING count(*) >= 24),
 {out} AS (SELECT s.* EXCLUDE (part, thick), n.part, n.area FROM {out}_q s LEFT JOIN {out}_n n ON n.label = s.label AND n.frame = s.frame AND n.part = s.part)"""


def combine_sql(src: str, out: str, remove: str, confident: str) -> str:
    """CTEs up to ``out``: ``src`` with the joined alpha, filled and removed."""
    o = out
    part = "OVER (PARTITION BY label, frame, part)"
    text = f"""{blobs_sql(src, 'model > 0.6::DOUBLE AND alpha < 0.4::DOUBLE', f'{o}_l')}, {spread_sql(f'{o}_l', 'nf', 'alpha > 0.5', f'{o}_w', 3)},
 {o}_f AS (SELECT *, part IS NOT NULL AND round(avg(far) {part}, 6) >= 20 AND round(avg(model) {part}, 6) >= {confident}::DOUBLE AND bool_or(nf) {part} AS fil FROM {o}_w), {spread_sql(f'{o}_f', 'wide', 'fil', f'{o}_g', 2)},
 {o}_h AS (SELECT * EXCLUDE (part, area, nf), CASE WHEN wide THEN greatest(alpha, model) ELSE alpha END AS o1 FROM {o}_g),
 {o}_i AS MATERIALIZED (SELECT * EXCLUDE (wide, fil, o1), fil::INT AS filled, CASE WHEN model > greatest({confident}::DOUBLE, 0.9::DOUBLE) AND far >= 20 AND o1 < model THEN model ELSE o1 END AS o2, 0 AS removed FROM {o}_h)"""
    last = f"{o}_i"
    if remove != "none":
        means = [f"round(avg({c}) {part}, 6)" for c in "rgb"]
        shadow = f"(greatest({', '.join(means)}) - least({', '.join(means)})) / greatest({', '.join(means)}, 1) < 0.25::DOUBLE AND round(0.299::DOUBLE * {means[0]} + 0.587::DOUBLE * {means[1]} + 0.114::DOUBLE * {means[2]}, 6) <= round(0.299::DOUBLE * bg_r + 0.587::DOUBLE * bg_g + 0.114::DOUBLE * bg_b + 12, 6)"
        text += f""", {blobs_sql(last, 'alpha > 0.6::DOUBLE AND model < 0.15::DOUBLE', f'{o}_x')}, {o}_y AS (SELECT *, part IS NOT NULL AND {'true' if remove == 'all' else shadow} AS goes FROM {o}_x), {spread_sql(f'{o}_y', 'wide', 'goes', f'{o}_z', 2)},
 {o}_v AS MATERIALIZED (SELECT * EXCLUDE (part, area, wide, goes, o2, removed), CASE WHEN wide THEN least(o2, model) ELSE o2 END AS o2, goes::INT AS removed FROM {o}_z)"""
        last = f"{o}_v"
    if remove == "all":
        text += f""", {spread_sql(last, 'body', 'model > 0.5', f'{o}_b', 3)}, {parts_sql(f'{o}_b', 'o2 > 0.3::DOUBLE', f'{o}_d', True)}, {o}_j AS (SELECT *, part IS NOT NULL AND NOT bool_or(body) {part} AS loose FROM {o}_d),
 {o}_u AS (SELECT * EXCLUDE (part, body, loose, o2, removed), CASE WHEN loose THEN 0::DOUBLE ELSE o2 END AS o2, removed + loose::INT AS removed FROM {o}_j)"""
        last = f"{o}_u"
    return text + f", {o} AS MATERIALIZED (SELECT * EXCLUDE (o2) REPLACE (o2 AS alpha) FROM {last})"


def light_sql(src: str, out: str) -> str:
    darker = f"round(0.299::DOUBLE * bg_r + 0.587::DOUBLE * bg_g + 0.114::DOUBLE * bg_b - {LUMA}, 9)"
    same = "round((r * bg_r + g * bg_g + b * bg_b) / (sqrt(r * r + g * g + b * b) * sqrt(bg_r * bg_r + bg_g * bg_g + bg_b * bg_b) + 0.000001::DOUBLE), 9) > 0.97::DOUBLE"
    return f"""{out}_l AS (SELECT *, {darker} AS darker, {same} AS alike FROM {src}),
 {out}_m AS (SELECT *, greatest({clip('(greatest(r - bg_r, g - bg_g, b - bg_b) - 50) / 100')}, CASE WHEN alike AND darker > 6 THEN 0::DOUBLE ELSE {clip('(far - 45) / 55')} * {clip('1 - (darker - 10) / 40')} END) AS lit FROM {out}_l),
 {blur_sql(f'{out}_m', ['lit'], 0.8, f'{out}_n')}, {out} AS (SELECT * EXCLUDE (darker, alike, lit, b_lit), round(b_lit, 6) AS light FROM {out}_n)"""


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE {c} / 255.0::DOUBLE / 12.92::DOUBLE END"


def lab_sql(src: str, out: str, channels: str, names: tuple[str, str, str]) -> str:
    r, g, b = channels.split()
    bent = lambda v: f"CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE 7.787::DOUBLE * ({v}) + 16.0::DOUBLE / 116 END"
    return f"""{out}_1 AS (SELECT *, {_linear(r)} AS lr_, {_linear(g)} AS lg_, {_linear(b)} AS lb_ FROM {src}),
 {out}_2 AS (SELECT * EXCLUDE (lr_, lg_, lb_), (0.412453::DOUBLE * lr_ + 0.357580::DOUBLE * lg_ + 0.180423::DOUBLE * lb_) / 0.950456::DOUBLE AS x_, 0.212671::DOUBLE * lr_ + 0.715160::DOUBLE * lg_ + 0.072169::DOUBLE * lb_ AS y_, (0.019334::DOUBLE * lr_ + 0.119193::DOUBLE * lg_ + 0.950227::DOUBLE * lb_) / 1.088754::DOUBLE AS z_ FROM {out}_1),
 {out}_3 AS (SELECT * EXCLUDE (x_, y_, z_), {bent('x_')} AS fx_, {bent('y_')} AS fy_, {bent('z_')} AS fz_ FROM {out}_2),
 {out} AS (SELECT * EXCLUDE (fx_, fy_, fz_), round((116 * fy_ - 16) * 2.55::DOUBLE, 4) AS {names[0]}, round(500 * (fx_ - fy_) + 128, 4) AS {names[1]}, round(200 * (fy_ - fz_) + 128, 4) AS {names[2]} FROM {out}_3)"""


def histogram_sql(src: str, out: str, in_lab: bool) -> str:
    space = lab_sql(f"{out}_h", f"{out}_c", "r g b", ("u", "v", "w")) if in_lab else f"{out}_c AS (SELECT *, r::DOUBLE AS u, g::DOUBLE AS v, b::DOUBLE AS w FROM {out}_h)"
    return f"{out}_h AS (SELECT label, r, g, b, count(*) AS many FROM {src} WHERE a > 200 GROUP BY ALL), {space}, {out} AS MATERIALIZED (SELECT label, u, v, w, CAST(sum(many) AS BIGINT) AS many FROM {out}_c GROUP BY ALL)"


def palettes_sql(colours: str, out: str, k: int = 24, rounds: int = 2) -> str:
    """CTEs up to ``out`` (label, k, u, v, w): boxes cut in halves of weight, then means of the nearest colours."""
    span = "greatest(max(u) OVER b - min(u) OVER b, max(v) OVER b - min(v) OVER b, max(w) OVER b - min(w) OVER b)"
    window = "WINDOW b AS (PARTITION BY label, box)"

    def cut(src: str, to: str) -> str:
        return f"""{to}_a AS (SELECT *, CASE {span} WHEN max(u) OVER b - min(u) OVER b THEN u WHEN max(v) OVER b - min(v) OVER b THEN v ELSE w END AS al FROM {src} {window}),
 {to}_b AS (SELECT *, sum(many) OVER (PARTITION BY label, box) AS total, sum(many) OVER o - many AS before, row_number() OVER o AS rn, lead(many) OVER o AS nx FROM {to}_a WINDOW o AS (PARTITION BY label, box ORDER BY al, u, v, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 {to} AS (SELECT label, u, v, w, many, box * 2 + (rn > 1 AND (2 * before >= total OR nx IS NULL))::INT AS box FROM {to}_b)"""

    steps, last, depth = [f"{out}_0 AS (SELECT *, 0 AS box FROM {colours})"], f"{out}_0", k.bit_length() - 1
    for i in range(depth):
        steps.append(cut(last, f"{out}_{i + 1}"))
        last = f"{out}_{i + 1}"
    if k > 1 << depth:
        steps.append(f"{out}_w AS (SELECT *, round({span} * sum(many) OVER b, 4) AS worth FROM {last} {window}), {out}_r AS (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY worth DESC, box) AS rk FROM {out}_w)")
        steps.append(f"{out}_y AS (SELECT * EXCLUDE (worth, rk) FROM {out}_r WHERE rk <= {k - (1 << depth)}), {cut(f'{out}_y', f'{out}_z')}, {out}_e AS (SELECT * FROM {out}_z UNION ALL SELECT label, u, v, w, many, box * 2 FROM {out}_r WHERE rk > {k - (1 << depth)})")
        last = f"{out}_e"
    mean = ", ".join(f"floor(sum(CAST(round({c} * 10000) AS BIGINT) * many) * 100 / sum(many) + 0.5::DOUBLE) / 1000000 AS {c}" for c in "uvw")
    ranked = "SELECT label, row_number() OVER (PARTITION BY label ORDER BY box) - 1 AS k, u, v, w FROM"
    steps.append(f"{out}_m AS ({ranked} (SELECT label, box, {mean} FROM {last} GROUP BY label, box))")
    last = f"{out}_m"
    for i in range(rounds):
        gap = "(c.u - m.u) * (c.u - m.u) + (c.v - m.v) * (c.v - m.v) + (c.w - m.w) * (c.w - m.w)"
        steps.append(f"{out}_n{i} AS (SELECT c.label, c.u, c.v, c.w, any_value(many) AS many, (min({{'d': {gap}, 'k': k}})).k AS box FROM {colours} c JOIN {last} m ON m.label = c.label GROUP BY c.label, c.u, c.v, c.w), {out}_m{i} AS ({ranked} (SELECT label, box, {mean} FROM {out}_n{i} GROUP BY label, box))")
        last = f"{out}_m{i}"
    return ",\n ".join(steps) + f", {out} AS MATERIALIZED (SELECT * FROM {last})"


HUE = "CASE WHEN most = least THEN 0 WHEN most = r THEN 30.0::DOUBLE * (g - b) / (most - least) WHEN most = g THEN 60 + 30.0::DOUBLE * (b - r) / (most - least) ELSE 120 + 30.0::DOUBLE * (r - g) / (most - least) END"
#: src with alpha, figure palettes pl of the first frames, and hue, sat, val, strange, blue, core, rim in co.
COLOURED = f"""f0 AS (SELECT * FROM pic WHERE frame = 0), {histogram_sql('f0', 'hi', True)}, {palettes_sql('hi', 'pl')},
 dc AS (SELECT DISTINCT label, r, g, b FROM pic), {lab_sql('dc', 'dl', 'r g b', ('u', 'v', 'w'))},
 dn AS (SELECT d.label, r, g, b, sqrt(min((d.u - m.u) * (d.u - m.u) + (d.v - m.v) * (d.v - m.v) + (d.w - m.w) * (d.w - m.w))) AS strange FROM dl d LEFT JOIN pl m ON m.label = d.label GROUP BY ALL),
 ml AS (SELECT src.*, strange, greatest(src.r, src.g, src.b) AS most, least(src.r, src.g, src.b) AS least, src.a / 255.0::DOUBLE AS alpha FROM src JOIN dn ON dn.label = src.label AND dn.r = src.r AND dn.g = src.g AND dn.b = src.b),
 hs AS (SELECT *, (CAST(floor(round({HUE}, 6) + 0.5::DOUBLE) AS INT) + 180) % 180 AS hue, CASE WHEN most = 0 THEN 0 ELSE CAST(floor(round(255.0::DOUBLE * (most - least) / most, 6) + 0.5::DOUBLE) AS INT) END AS sat, most AS val FROM ml),
 co AS MATERIALIZED (SELECT *, hue BETWEEN 80 AND 150 AS blue, a > 0 AND sat < 50 AND val > 228 AS core, a > 0 AND hue BETWEEN 80 AND 150 AND sat > 18 AND val > 140 AS rim FROM hs)"""
_LOCAL = "OVER (PARTITION BY label, frame, part)"
EFFECT = f"""{COLOURED}, {opened_sql('co', 'seed', 'a > 0 AND strange > 22 AND blue AND sat > 45 AND val > 70', 'e1')}, {spread_sql('e1', 'near', 'seed', 'e2', 21)}, {parts_sql('e2', 'a > 0 AND sat < 25 AND val > 242', 'e3', True)},
 e4 AS (SELECT * EXCLUDE (part), seed OR (near AND (core OR rim)) OR (part IS NOT NULL AND count(*) {_LOCAL} >= 400) AS begun FROM e3), {parts_sql('e4', 'begun OR core OR rim', 'e5', True)},
 e6 AS (SELECT * EXCLUDE (part), part IS NOT NULL AND bool_or(begun) {_LOCAL} AS followed FROM e5), {parts_sql('e6', 'followed', 'e7', True)}, e8 AS (SELECT * EXCLUDE (part), part IS NOT NULL AND count(*) {_LOCAL} >= 120 AS big FROM e7),
 {spread_sql('e8', 'effect', 'big', 'ef', 1)}"""
BURST = f"""ar AS (SELECT label, frame, count(*) FILTER (alpha > 0.5) AS n FROM co GROUP BY label, frame), md AS (SELECT *, median(n) OVER (PARTITION BY label) AS mid FROM ar), ck AS (SELECT *, n <= mid * 1.08::DOUBLE AS clean FROM md),
 c1 AS (SELECT t.label, t.frame, i.frame AS i FROM ck t JOIN ck i ON i.label = t.label AND i.clean AND abs(i.frame - t.frame) <= 6 WHERE NOT t.clean),
 c2 AS (SELECT t.label, t.frame, max(i.frame) FILTER (i.frame < t.frame) AS p, min(i.frame) FILTER (i.frame > t.frame) AS q FROM ck t JOIN ck i ON i.label = t.label AND i.clean AND NOT t.clean ANTI JOIN c1 ON c1.label = t.label AND c1.frame = t.frame GROUP BY ALL),
 c3 AS (SELECT * FROM c1 UNION ALL SELECT label, frame, p FROM c2 WHERE frame - p <= 24 UNION ALL SELECT label, frame, q FROM c2 WHERE q - frame <= 24),
 ou AS (SELECT c3.label, c3.frame, y, x, bool_or(alpha > 0.5) AS outline FROM c3 JOIN co ON co.label = c3.label AND co.frame = c3.i GROUP BY ALL),
 b1 AS (SELECT ef.*, coalesce(outline, false) AS outline, outline IS NOT NULL AND a > 0 AS known, mid, round(far, 6) AS away FROM ef LEFT JOIN ou ON ou.label = ef.label AND ou.frame = ef.frame AND ou.y = ef.y AND ou.x = ef.x JOIN ck ON ck.label = ef.label AND ck.frame = ef.frame),
 {disc_sql('b1', 'wide', 'outline', 'b2', 3)}, {opened_sql('b2', 'encl', 'known AND wide AND away < 25', 'b3', 2)}, b4 AS (SELECT *, (known AND NOT wide AND ((sat < 60 AND val > 170) OR coalesce(strange > 22, false) OR away < 40)) OR encl AS cand FROM b3),
 {spread_sql('b4', 'touch', 'wide', 'b5', 2)}, {parts_sql('b5', 'cand', 'b6', True)}, b7 AS (SELECT * EXCLUDE (part), part IS NOT NULL AND (NOT bool_or(touch) {_LOCAL} OR count(*) {_LOCAL} > 0.25::DOUBLE * mid) AS goes FROM b6),
 {spread_sql('b7', 'outburst', 'goes', 'bu', 1)}"""
REMOVED = f"""r1 AS (SELECT label, frame, y, x, r, g, b, a AS a0, CASE WHEN effect OR outburst THEN 0 ELSE a END AS a, bool_or(effect OR outburst) OVER (PARTITION BY label, frame) AS hit FROM bu), {parts_sql('r1', 'a > 32', 'r2', True)}, {areas_sql('r2', 'r3')},
 r4 AS (SELECT * EXCLUDE (part, area, most) REPLACE (CASE WHEN hit AND area < 0.01::DOUBLE * most THEN 0 ELSE a END AS a) FROM r3), {parts_sql('r4', 'a > 32', 'r5', True)}, {areas_sql('r5', 'r6')},
 r7 AS (SELECT *, min(part) FILTER (area = most) OVER (PARTITION BY label, frame) AS main FROM r6), {disc_sql('r7', 'nearby', 'part = main', 'r8', 3)},
 r9 AS (SELECT *, coalesce(area < 0.15::DOUBLE * most AND part <> main AND NOT bool_or(nearby) {_LOCAL}, false) AS away FROM r8), {spread_sql('r9', 'drop_', 'away', 'ra', 1)},
 rb AS (SELECT label, frame, y, x, a0, CASE WHEN drop_ THEN 0 ELSE a END AS a, r, g, b FROM ra), rc AS (SELECT label, frame, y, x, a0, a, CASE WHEN a > 0 OR a0 = 0 THEN r ELSE 0 END AS r, CASE WHEN a > 0 OR a0 = 0 THEN g ELSE 0 END AS g, CASE WHEN a > 0 OR a0 = 0 THEN b ELSE 0 END AS b FROM rb)"""


def _edit(rows):
    """``rows`` with an edit: brighter where the model is sure, hardly changed elsewhere."""
    return regions.added(rows, {f"e{c}": F.least(F.lit(255), F.col(c) + F.when(F.col("model") > 0.7, 60).otherwise(2)).cast("int") for c in "rgb"})


_EDIT = ", ".join(f"CAST(least(255, {c} + CASE WHEN model > 0.7::DOUBLE THEN 60 ELSE 2 END) AS INT) AS e{c}" for c in "rgb")


def _back(spark, folder, *more):
    """Pictures with their backgrounds; only the columns that are asked for besides r, g, b are drawn."""
    rows = pictures(spark, folder)
    return cutout.with_background(regions.narrow(rows, lambda p: p.select(*FRAME, "y", "x", "r", "g", "b", *more)), N, N)


def _keyed(spark, folder, *more):
    return cutout.frame_alpha(_back(spark, folder, *more), N, N)


def _cells(spark, folder):
    return regions.sheet_cells(_back(spark, folder), None, N)


def _kept(rows, whole):
    """(label, frame, kept, removed): pixels with opacity, and those that lost it."""
    return rows.groupBy(*FRAME).agg(F.count_if(F.col("a") > 0).alias("kept"), F.count_if(F.col("gone") & (F.col(whole) > 0)).alias("removed"))


def _sprites(spark, folder):
    return regions.narrow(pictures(spark, folder), lambda p: p.select(*FRAME, "y", "x", "r", "g", "b", "a", F.col("a").alias("own")))


def _counts(rows):
    return alpha_digest(rows, F.sum("filled").cast("long").alias("filled"), F.sum("removed").cast("long").alias("removed"))


def _votes(spark, folder):
    return voted(pictures(spark, folder).withColumnRenamed("a", "alpha"), PALETTE).select(*FRAME, "by", "bx", "q", "a")


def splice_sql(src: str, out: str) -> str:
    two = lab_sql(src, f"{out}_la", "r g b", ("l1", "m1", "n1")) + ",\n " + lab_sql(f"{out}_la", f"{out}_lb", "er eg eb", ("l2", "m2", "n2"))
    changed = "round(sqrt((l1 - l2) * (l1 - l2) + (m1 - m2) * (m1 - m2) + (n1 - n2) * (n1 - n2)), 6) > 14"
    mixed = ", ".join(f"CAST(floor(round({c} * (1 - b_on) + e{c} * b_on, 5)) AS INT) AS {c}" for c in "rgb")
    return f"""{two}, {opened_sql(f'{out}_lb', 'hit', changed, f'{out}_op')}, {spread_sql(f'{out}_op', 'wide', 'hit', f'{out}_gr', 2)}, {out}_in AS (SELECT *, wide::INT::DOUBLE AS on FROM {out}_gr),
 {blur_sql(f'{out}_in', ['on'], 1.5, f'{out}_bl')}, {out} AS (SELECT * REPLACE ({mixed}) FROM {out}_bl)"""


_NEAREST = "(min({'d': (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), 'k': k})).k"
_DARK = ", ".join(str(k) for k, (r, g, b) in enumerate(PALETTE) if 0.299 * r + 0.587 * g + 0.114 * b < 70)
VOTES = f"""pa(k, pr, pg, pb) AS (VALUES {', '.join(f'({k}, {r}, {g}, {b})' for k, (r, g, b) in enumerate(PALETTE))}), ix AS (SELECT label, frame, y, x, any_value(a) AS a, {_NEAREST} AS k FROM pic, pa GROUP BY label, frame, y, x),
 vk AS (SELECT label, frame, y // 4 AS y, x // 4 AS x, k, count(*) FILTER (a > 127) AS n FROM ix GROUP BY ALL), vc AS (SELECT label, frame, y, x, -(max({{'n': n, 'k': -k}})).k AS q, sum(n) AS solid, coalesce(sum(n) FILTER (k IN ({_DARK or -1})), 0) AS dark, -(max({{'n': n, 'k': -k}}) FILTER (k IN ({_DARK or -1}) AND n > 0)).k AS dq FROM vk GROUP BY label, frame, y, x),
 vt AS MATERIALIZED (SELECT label, frame, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(CASE WHEN dark >= 6.4 THEN dq WHEN solid = 0 THEN 0 ELSE q END AS INT) AS q, 2 * solid >= 16 AS a FROM vc)"""
CELL_SQL = f"""WITH RECURSIVE {PIC}, {BACK}, {spread_sql('src', 'merged', 'far > 40', 'gr', 2)}, {parts_sql('gr', 'merged', 'm', True)},
 bx AS (SELECT label, frame, part, count(*) AS n, least(2, floor(round(avg(y) / {N} * 3, 9))) * 3 + least(2, floor(round(avg(x) / {N} * 3, 9))) AS cell, count(*) FILTER (far > 40) AS area,
   {', '.join(f'{f}({c}) FILTER (far > 40) AS {c}{k}' for c in 'xy' for f, k in (('min', 0), ('max', 1)))} FROM m WHERE part IS NOT NULL GROUP BY label, frame, part),
 nm AS (SELECT *, (['NW', 'N', 'NE', 'W', NULL, 'E', 'SW', 'S', 'SE'])[CAST(cell AS INT) + 1] AS dir FROM bx WHERE n >= 30 AND area > 0),
 cells AS (SELECT label, frame, dir, min(x0) AS x0, min(y0) AS y0, max(x1) + 1 AS x1, max(y1) + 1 AS y1, CAST(sum(area) AS BIGINT) AS area FROM nm WHERE dir IS NOT NULL GROUP BY label, frame, dir)"""

def _centres(rows):
    """(label, k, u, v, w): a row a colour."""
    return rows.select("label", F.posexplode("centres").alias("k", "c")).select("label", "k", "c.u", "c.v", "c.w")


def _light(spark, folder):
    return regions.added(_back(spark, folder, "a"), {"alpha": F.col("a") / 255.0})


def _first(spark, folder):
    """The first picture of each label; the others aren't drawn."""
    return pictures(spark, folder).filter("frame = 0")


def _coloured(spark, folder, silhouettes=False):
    rows = regions.narrow(pictures(spark, folder), lambda p: p.select(*FRAME, "y", "x", "r", "g", "b", "a", (F.col("a") / 255.0).alias("alpha")))
    seen = effects.with_colours(effects.clean_silhouette(rows) if silhouettes else rows, effects.character_palette(_first(spark, folder)))
    return effects.effect_mask(cutout.with_background(seen, N, N))


WITH = f"WITH RECURSIVE {PIC}"
KEYED = f"{WITH}, {BACK}, {frame_sql('ka')}"
_COUNTED = ", CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(removed) AS BIGINT) AS removed"

QUERIES = {
    "img_regions": lambda s, d: regions.regions(pictures(s, d), luma() > 128),
    "img_slivers": lambda s, d: _kept(regions.without_slivers(_sprites(s, d)), "own"),
    "img_detached": lambda s, d: _kept(regions.without_detached(_sprites(s, d), N), "own"),
    "img_holes": lambda s, d: regions.torn_holes(pictures(s, d), N),
    "img_sheet_cells": _cells,
    "img_missing_cells": lambda s, d: regions.missing_cells(_cells(s, d), clips(s, d), ["N", "E", "S", "W"]),
    "img_specks": lambda s, d: regions.without_specks(_votes(s, d), {0}),
    "img_plain_alpha": lambda s, d: alpha_digest(cutout.plain_alpha(_back(s, d), N, N)),
    "img_chroma_alpha": lambda s, d: alpha_digest(cutout.chroma_alpha(_back(s, d), N, N)),
    "img_frame_alpha": lambda s, d: alpha_digest(_keyed(s, d)),
    "img_drawing_alpha": lambda s, d: alpha_digest(cutout.drawing_alpha(_back(s, d), N, N)),
    "img_refined_edges": lambda s, d: alpha_digest(cutout.refined(_keyed(s, d), N, N)),
    "img_cutouts": lambda s, d: sprite_digest(cutout.cutouts(_keyed(s, d), N, N)),
    "img_reference": lambda s, d: sprite_digest(cutout.loaded_reference(_back(s, d), N, N)),
    "img_distances": lambda s, d: cutout.distances(_keyed(s, d), "deep", F.col("alpha") >= 0.5, N).groupBy(*FRAME).agg(F.round(F.sum("deep"), 6).alias("total"), F.round(F.max("deep"), 6).alias("deepest")),
    "img_finish": lambda s, d: sprite_digest(cutout.finished(_keyed(s, d), N, N)),
    "img_combine": lambda s, d: _counts(matting.combined(_keyed(s, d, "model"))),
    "img_combine_shadow": lambda s, d: _counts(matting.combined(_keyed(s, d, "model"), "shadow")),
    "img_light": lambda s, d: alpha_digest(matting.light_alpha(_back(s, d), N, N).withColumn("alpha", F.col("light"))),
    "img_matte_vivid": lambda s, d: _counts(matting.matted(_keyed(s, d, "model"), N, N, vivid=True)),
    "img_splice": lambda s, d: sprite_digest(matting.spliced(_edit(pictures(s, d)), N, N)),
    "img_palette": lambda s, d: _centres(palette.palettes(palette.histogram(pictures(s, d)))),
    "img_character_palette": lambda s, d: _centres(effects.character_palette(_first(s, d))),
    "img_effects": lambda s, d: flag_digest(_coloured(s, d), F.col("effect")),
    "img_bursts": lambda s, d: flag_digest(effects.temporal_mask(_coloured(s, d, silhouettes=True), N), F.col("outburst")),
    "img_remove_effects": lambda s, d: effects.removed_counts(effects.without_effects(_light(s, d), N, effects.character_palette(_first(s, d)))),
    "img_shrink": lambda s, d: sprite_digest(resample.shrunk_sprites(pictures(s, d), N, N, 0.4)),
    "img_cell_cutouts": lambda s, d: sprite_digest(resample.cell_cutouts(regions.added(pictures(s, d), {"mask": F.col("a") > 128}), N, N, 0.75)),
    "img_small_frames": lambda s, d: _small_digest(resample.small_frames(pictures(s, d), N, N, 20)),
    "img_frame_steps": lambda s, d: resample.frame_steps(pictures(s, d), N, N).withColumn("step", F.round("step", 6)),
    "stream_drift_windows": lambda s, d: drift_windows(table(s, d, "events")),
    "img_merge_edit": lambda s, d: sprite_digest(matting.merged_edit(_edit(pictures(s, d)), N)),
}
ORACLES = {
    "img_regions": f"""{WITH}, {parts_sql('pic', f'{LUMA} > 128', 'm', False)}, g AS (SELECT label, frame, part, count(*) AS area, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM m WHERE part IS NOT NULL GROUP BY label, frame, part)
SELECT * EXCLUDE (part), row_number() OVER (PARTITION BY label, frame ORDER BY part) AS region FROM g""",
    "img_slivers": f"""{WITH}, {parts_sql('pic', 'a > 32', 'm', True)}, {areas_sql('m', 'n')}
SELECT label, frame, count(*) FILTER (a > 0 AND NOT coalesce(area < 0.01::DOUBLE * most, false)) AS kept, count(*) FILTER (a > 0 AND area < 0.01::DOUBLE * most) AS removed FROM n GROUP BY label, frame""",
    "img_detached": f"""{WITH}, {parts_sql('pic', 'a > 32', 'm', True)}, {areas_sql('m', 'n')}, w AS (SELECT *, min(part) FILTER (area = most) OVER (PARTITION BY label, frame) AS main FROM n), {disc_sql('w', 'near', 'part = main', 'd', 3)},
 t AS (SELECT label, frame, part FROM d WHERE part IS NOT NULL GROUP BY ALL HAVING NOT bool_or(near) AND any_value(area) < 0.15::DOUBLE * any_value(most) AND part <> any_value(main)),
 f AS (SELECT d.*, t.part IS NOT NULL AS away FROM d LEFT JOIN t ON t.label = d.label AND t.frame = d.frame AND t.part = d.part), {spread_sql('f', 'gone', 'away', 'z', 1)}
SELECT label, frame, count(*) FILTER (a > 0 AND NOT gone) AS kept, count(*) FILTER (a > 0 AND gone) AS removed FROM z GROUP BY label, frame""",
    "img_holes": f"""{WITH}, q AS (SELECT *, {LUMA} AS luma, count(*) FILTER (a > 128) OVER (PARTITION BY label, frame) AS figure FROM pic), {parts_sql('q', 'a <= 128', 'm', False)},
 h AS (SELECT label, frame, part, count(*) AS area FROM m WHERE part IS NOT NULL GROUP BY ALL HAVING NOT bool_or({BORDER}) AND count(*) >= greatest(12, 0.001::DOUBLE * any_value(figure)) AND any_value(figure) > 0),
 o(d) AS (SELECT unnest(range(-2, 3))), u AS (SELECT DISTINCT m.label, m.frame, m.part, area, m.y + a.d AS y, m.x + b.d AS x FROM m JOIN h ON h.label = m.label AND h.frame = m.frame AND h.part = m.part, o a, o b),
 v AS (SELECT u.label, u.frame, u.part, any_value(area) AS area, avg((luma < 80)::INT) AS dark, round(avg(luma), 9) AS bright FROM u JOIN q ON q.label = u.label AND q.frame = u.frame AND q.y = u.y AND q.x = u.x AND q.a > 128 GROUP BY ALL)
SELECT label, frame, count(*) AS holes, CAST(sum(area) AS BIGINT) AS pixels FROM v WHERE dark < 0.15 AND bright > 150 GROUP BY label, frame""",
    "img_sheet_cells": f"{CELL_SQL} SELECT * FROM cells",
    "img_missing_cells": f"{CELL_SQL} SELECT f.label, f.frame, d.dir FROM (SELECT DISTINCT label, frame FROM pic) f CROSS JOIN (VALUES ('N'), ('E'), ('S'), ('W')) d(dir) ANTI JOIN cells ON cells.label = f.label AND cells.frame = f.frame AND cells.dir = d.dir",
    "img_specks": f"""{WITH}, {VOTES}, {parts_sql('vt', 'a AND q <> 0', 'm', False, 'q')}, sz AS (SELECT label, frame, part FROM m WHERE part IS NOT NULL GROUP BY ALL HAVING count(*) <= 3),
 st(dy, dx) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)), nb AS (SELECT m.label, m.frame, m.part, n.q, coalesce(n.a, false) AS a, n.part AS other FROM m JOIN sz ON sz.label = m.label AND sz.frame = m.frame AND sz.part = m.part CROSS JOIN st
   LEFT JOIN m n ON n.label = m.label AND n.frame = m.frame AND n.y = m.y + dy AND n.x = m.x + dx),
 vo AS (SELECT label, frame, part, q, count(*) AS n FROM nb WHERE a AND other IS DISTINCT FROM part GROUP BY ALL), ok AS (SELECT label, frame, part FROM nb GROUP BY ALL HAVING bool_and(a)),
 be AS (SELECT label, frame, part, -(max({{'n': n, 'q': -q}})).q AS new FROM vo SEMI JOIN ok USING (label, frame, part) GROUP BY ALL)
SELECT m.label, m.frame, m.y AS by, m.x AS bx, CAST(coalesce(new, q) AS INT) AS q, a FROM m LEFT JOIN be ON be.label = m.label AND be.frame = m.frame AND be.part = m.part""",
    "img_plain_alpha": f"{WITH}, {BACK}, {plain_sql('src', 'al')} {_alpha_sql('al')}",
    "img_chroma_alpha": f"{WITH}, {BACK}, {chroma_sql('src', 'al')} {_alpha_sql('al')}",
    "img_frame_alpha": f"{KEYED} {_alpha_sql('ka')}",
    "img_drawing_alpha": f"""{WITH}, {BACK}, {plain_sql('src', 'al')}, {parts_sql('al', 'far < 5 AND alpha > 0.5', 'm', False)}, {areas_sql('m', 'n')},
 z AS (SELECT * REPLACE (CASE WHEN part IS NOT NULL AND area >= 40 AND round(avg(far) OVER (PARTITION BY label, frame, part), 9) < 2.5 THEN 0::DOUBLE ELSE alpha END AS alpha) FROM n) {_alpha_sql('z')}""",
    "img_refined_edges": f"{KEYED}, {refined_sql('ka', 'rf')} {_alpha_sql('rf')}",
    "img_cutouts": f"{KEYED}, {cutouts_sql('ka', 'co')} {_sprite_sql('co')}",
    "img_reference": f"""{WITH}, {BACK}, {plain_sql('src', 'al')}, cl AS (SELECT * REPLACE ({', '.join(f'CASE WHEN alpha > 0.05 THEN {clean(c)} ELSE {c} END AS {c}' for c in 'rgb')}, {PACK} AS a) FROM al),
 lo AS (SELECT label, frame, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM cl WHERE alpha > 0.1::DOUBLE GROUP BY label, frame),
 cu AS (SELECT cl.label, cl.frame, cl.y - y0 AS y, cl.x - x0 AS x, CASE WHEN a > 0 THEN r ELSE 0 END AS r, CASE WHEN a > 0 THEN g ELSE 0 END AS g, CASE WHEN a > 0 THEN b ELSE 0 END AS b, a FROM cl JOIN lo ON lo.label = cl.label AND lo.frame = cl.frame AND cl.y BETWEEN y0 AND y1 AND cl.x BETWEEN x0 AND x1) {_sprite_sql('cu')}""",
    "img_distances": f"""{KEYED}, gp AS (SELECT a.label, a.frame, a.y, a.x, min(abs(a.y - b.y)) AS g FROM ka a JOIN ka b ON b.label = a.label AND b.frame = a.frame AND b.x = a.x AND b.alpha < 0.5 GROUP BY ALL),
 ds AS (SELECT a.label, a.frame, a.y, a.x, sqrt(min(g.g * g.g + (a.x - g.x) * (a.x - g.x))) AS d FROM ka a JOIN gp g ON g.label = a.label AND g.frame = a.frame AND g.y = a.y GROUP BY ALL)
SELECT f.label, f.frame, round(sum(d), 6) AS total, round(max(d), 6) AS deepest FROM (SELECT DISTINCT label, frame FROM ka) f LEFT JOIN ds ON ds.label = f.label AND ds.frame = f.frame AND ds.d <= {N} GROUP BY ALL""",
    "img_finish": f"""{KEYED}, {cutouts_sql('ka', 'co')}, nz AS (SELECT DISTINCT label, frame, y + a.d AS y, x + b.d AS x FROM ka, (SELECT unnest(range(-3, 4)) AS d) a, (SELECT unnest(range(-3, 4)) AS d) b WHERE alpha < 0.5 AND a.d * a.d + b.d * b.d <= 9),
 fi AS (SELECT co.label, co.frame, co.y, co.x, co.a, nz.y IS NULL AND ka.alpha >= 0.99::DOUBLE AND ka.green AS deep, {', '.join(f'co.{c} AS n_{c}, ka.{c} AS o_{c}' for c in 'rgb')} FROM co JOIN ka ON ka.label = co.label AND ka.frame = co.frame AND ka.y = co.y AND ka.x = co.x
   LEFT JOIN nz ON nz.label = co.label AND nz.frame = co.frame AND nz.y = co.y AND nz.x = co.x), fj AS (SELECT label, frame, y, x, a, {', '.join(f'CASE WHEN deep THEN o_{c} ELSE n_{c} END AS {c}' for c in 'rgb')} FROM fi) {_sprite_sql('fj')}""",
    "img_combine": f"{KEYED}, {combine_sql('ka', 'cb', 'all', '0.8')} {_alpha_sql('cb', _COUNTED)}",
    "img_combine_shadow": f"{KEYED}, {combine_sql('ka', 'cb', 'shadow', '0.8')} {_alpha_sql('cb', _COUNTED)}",
    "img_light": f"{WITH}, {BACK}, {light_sql('src', 'li')}, lj AS (SELECT *, light AS alpha FROM li) {_alpha_sql('lj')}",
    "img_matte_vivid": f"""{KEYED}, vk AS (SELECT * FROM ka WHERE key), vp AS (SELECT * FROM ka WHERE NOT key), {combine_sql('vk', 'c1', 'none', '0.95')}, {combine_sql('vp', 'c2', 'all', '0.95')}, {light_sql('c2', 'c3')},
 vm AS (SELECT label, frame, y, x, alpha, filled, removed FROM c1 UNION ALL SELECT label, frame, y, x, greatest(alpha, light), filled, removed FROM c3) {_alpha_sql('vm', _COUNTED)}""",
    "img_splice": f"{WITH}, ed AS (SELECT *, {_EDIT} FROM pic), {splice_sql('ed', 'sp')} {_sprite_sql('sp')}",
    "img_merge_edit": f"""{WITH}, {BACK}, ed AS (SELECT *, {_EDIT} FROM pic), {splice_sql('ed', 'sp')}, ee AS (SELECT label, frame, y, x, er AS r, eg AS g, eb AS b FROM ed), {back_sql('ee', 'eb')}, {frame_sql('ea', 'eb')},
 me AS (SELECT sp.label, sp.frame, sp.y, sp.x, sp.a, {', '.join(f'CASE WHEN ea.alpha < 0.5 THEN CAST(round_even(src.bg_{c}, 0) AS INT) ELSE sp.{c} END AS {c}' for c in 'rgb')} FROM sp JOIN src ON src.label = sp.label AND src.frame = sp.frame AND src.y = sp.y AND src.x = sp.x
   JOIN ea ON ea.label = sp.label AND ea.frame = sp.frame AND ea.y = sp.y AND ea.x = sp.x) {_sprite_sql('me')}""",
    "img_palette": f"{WITH}, {histogram_sql('pic', 'hi', False)}, {palettes_sql('hi', 'pl')} SELECT * FROM pl",
    "img_character_palette": f"{WITH}, f0 AS (SELECT * FROM pic WHERE frame = 0), {histogram_sql('f0', 'hi', True)}, {palettes_sql('hi', 'pl')} SELECT * FROM pl",
    "img_effects": f"{WITH}, {BACK}, {EFFECT} {_flag_sql('ef', 'effect')}",
    "img_bursts": f"{WITH}, {BACK}, {EFFECT}, {BURST} {_flag_sql('bu', 'outburst')}",
    "img_remove_effects": f"{WITH}, {BACK}, {EFFECT}, {BURST}, {REMOVED} SELECT label, frame, count(*) FILTER (a0 > 0 AND a = 0) AS removed, count(*) FILTER (a > 0) AS remaining FROM rc GROUP BY label, frame",
    "img_shrink": f"""{WITH}, so AS (SELECT label, frame, y, x, a, {', '.join(f'(2 * {c} * a + 255) // 510 AS {c}' for c in 'rgb')} FROM pic), {lanczos_sql('so', 'rgba', 13, 'sm')},
 sh AS (SELECT label, frame, y, x, {', '.join(f'CASE WHEN a > 12 THEN least(255, 255 * {c} // greatest(a, 1)) ELSE 0 END AS {c}' for c in 'rgb')}, CASE WHEN a > 12 THEN a ELSE 0 END AS a FROM sm) {_sprite_sql('sh')}""",
    "img_cell_cutouts": f"""{WITH}, {spread_sql('pic', 'wide', 'a > 128', 'wd', 2)}, wf AS (SELECT * EXCLUDE (a), CAST(wide AS INT)::DOUBLE AS soft FROM wd), {blur_sql('wf', ['soft'], 1.0, 'bl')},
 op AS (SELECT label, frame, y, x, r, g, b, CAST(floor(round(255 * b_soft, 6) + 0.5::DOUBLE) AS INT) AS a FROM bl), {lanczos_sql('op', 'rgba', 24, 'sm')} {_sprite_sql('sm')}""",
    "img_small_frames": f"""{WITH}, ov AS (SELECT t, s, (least((t + 1) * {N}, (s + 1) * 20) - greatest(t * {N}, s * 20)) / {N}::DOUBLE AS w FROM range(20) a(t), range({N}) b(s) WHERE least((t + 1) * {N}, (s + 1) * 20) > greatest(t * {N}, s * 20)),
 sm AS (SELECT label, frame, u.t AS y, v.t AS x, {', '.join(f'sum(u.w * v.w * {c} * a / 65025::DOUBLE) AS {c}' for c in 'rgb')} FROM pic JOIN ov u ON u.s = y JOIN ov v ON v.s = x GROUP BY label, frame, u.t, v.t)
SELECT label, frame, CAST(sum(floor((r + 2 * g + 4 * b) * 10000 + 0.3::DOUBLE) * (y * 20 + x + 1)) AS BIGINT) AS moment, count(*) AS places FROM sm GROUP BY label, frame""",
    "img_frame_steps": f"""{WITH}, od AS (SELECT label, frame, coalesce(lead(frame) OVER (PARTITION BY label ORDER BY frame), min(frame) OVER (PARTITION BY label)) AS next FROM (SELECT DISTINCT label, frame FROM pic))
SELECT od.label, od.frame, od.next, round(avg(({' + '.join(f'abs(q.{c} * q.a - p.{c} * p.a)' for c in 'rgb')}) / 195075::DOUBLE), 6) AS step FROM od JOIN pic p ON p.label = od.label AND p.frame = od.frame
 JOIN pic q ON q.label = od.label AND q.frame = od.next AND q.y = p.y AND q.x = p.x WHERE od.frame <> od.next GROUP BY od.label, od.frame, od.next""",
    "stream_drift_windows": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) FILTER (value > 60) AS bad, count(*) AS total
FROM events GROUP BY 1, 2""",
}
