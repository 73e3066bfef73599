"""Registered queries of the text and rule functions."""

from __future__ import annotations

from framewright.functions import text as fn
from framewright.operators.documents import unique_keys
from framewright.sources.tables import table
from pyspark.sql import functions as F

GLOW, MOVES = ["shin", "tion", "glow"], ["anto", "walk", "rein"]


def _like(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), '{w}')" for w in words) + ")"


def _slugs(spark, folder):
    turns = table(spark, folder, "conversations")
    return unique_keys(turns.select("conv_id", "turn", fn.slug(F.col("text")).alias("key")), "conv_id", ["turn"], "key")


def _motion_keys(spark, folder):
    turns = table(spark, folder, "conversations")
    name = F.when(F.col("turn") % 7 == 3, F.concat(F.lit("걷기 "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    keyed = turns.select("conv_id", "turn", fn.motion_key(name, F.when(F.col("turn") % 5 == 2, F.col("role"))).alias("key"))
    return unique_keys(keyed, "conv_id", ["turn"], "key")


def _templates(spark, folder):
    parts = table(spark, folder, "part")
    made = fn.filled(F.lit("{{NAME}} by {{BRAND}}, {{SIZE}} px, {{OTHER}}"), {"NAME": F.col("p_name"), "BRAND": F.col("p_brand"), "SIZE": F.col("p_size")})
    return parts.select("p_partkey", made.alias("text"))


def _rules(spark, folder):
    orders = table(spark, folder, "orders")
    loop, hold = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 7 == 0
    mode = F.element_at(F.array(F.lit("direct"), F.lit("mannequin"), F.lit("video")), (F.col("o_custkey") % 3 + 1).cast("int"))
    seconds = fn.clip_seconds(mode, loop, hold)
    return orders.select("o_orderkey", seconds.alias("seconds"), fn.frame_grid(seconds).alias("frames"))


QUERIES = {
    "txt_effects": lambda s, d: table(s, d, "documents").select("doc_id", fn.effects_route(F.col("text"), GLOW).alias("route")),
    "txt_locomotion": lambda s, d: table(s, d, "conversations").select(
        "conv_id", "turn", fn.is_locomotion(F.col("role"), F.col("turn") % 2 == 0, F.col("text"), MOVES).alias("moves")),
    "txt_slug": _slugs,
    "txt_motion_key": _motion_keys,
    "txt_template": _templates,
    "txt_camera": lambda s, d: table(s, d, "part").select("p_partkey", fn.camera_phrase((F.col("p_size") * 1.5)).alias("phrase")),
    "rule_seconds_frames": _rules,
    "rule_frame_grid": lambda s, d: table(s, d, "orders").select("o_orderkey", fn.frame_grid((F.col("o_orderkey") % 100) / 10).alias("frames")),
    "rule_frame_size": lambda s, d: table(s, d, "part").select(
        "p_partkey", fn.frame_size(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 20), F.col("p_partkey") % 2 == 0, F.col("p_size") * 10 + 7).alias("size")),
}
UNIQUE = """l AS (SELECT conv_id, list_reduce(list_transform(list(key ORDER BY turn), lambda k: [k]), lambda acc, k: list_append(acc, CASE WHEN list_contains(acc, k[1])
   THEN k[1] || (list_filter(range(2, len(acc) + 3), lambda n: NOT list_contains(acc, k[1] || n)))[1] ELSE k[1] END)) AS names FROM s GROUP BY conv_id)
 SELECT conv_id, unnest(range(len(names))) AS place, unnest(names) AS name FROM l"""
ORACLES = {
    "txt_effects": f"SELECT doc_id, CASE WHEN {_like('text', GLOW)} THEN 'vivid' ELSE 'none' END AS route FROM documents",
    "txt_locomotion": f"SELECT conv_id, turn, role IN ('walk', 'run') OR (turn % 2 = 0 AND role <> 'idle' AND {_like('text', MOVES)}) AS moves FROM conversations",
    "txt_slug": f"""WITH k AS (SELECT conv_id, turn, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '_', 'g'), '_') AS k FROM conversations),
 s AS (SELECT conv_id, turn, CASE WHEN regexp_full_match(k, '[a-z][a-z0-9_]*') THEN k ELSE 'motion' END AS key FROM k),
 {UNIQUE}""",
    "txt_motion_key": f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 2 THEN role END AS fixed, CASE WHEN turn % 7 = 3 THEN '걷기 ' || coalesce(text, '') ELSE coalesce(text, '') END AS name FROM conversations),
 k AS (SELECT conv_id, turn, CASE WHEN coalesce(fixed, '') <> '' THEN fixed {" ".join(f"WHEN contains(name, '{ko}') THEN '{en}'" for ko, en in fn.KO_KEYS.items())}
  ELSE trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') END AS k FROM t),
 s AS (SELECT conv_id, turn, CASE WHEN regexp_full_match(k, '[a-z][a-z0-9_]*') THEN k ELSE 'motion' END AS key FROM k),
 {UNIQUE}""",
    "txt_template": "SELECT p_partkey, p_name || ' by ' || p_brand || ', ' || p_size || ' px, {{OTHER}}' AS text FROM part",
    "txt_camera": f"""SELECT p_partkey, CASE WHEN r <= 5 THEN '{fn.CAMERAS[0]}' WHEN r < 25 THEN printf('{fn.CAMERAS[1]}', r::VARCHAR) WHEN r < 55 THEN printf('{fn.CAMERAS[2]}', r::VARCHAR)
 ELSE printf('{fn.CAMERAS[3]}', r::VARCHAR) END AS phrase FROM (SELECT p_partkey, CAST(round_even(p_size * 1.5::DOUBLE, 0) AS INT) AS r FROM part)""",
    "rule_seconds_frames": """WITH m AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS loop, o_orderkey % 7 = 0 AS hold, (['direct', 'mannequin', 'video'])[o_custkey % 3 + 1] AS mode FROM orders),
 s AS (SELECT o_orderkey, CASE WHEN mode = 'video' OR hold THEN 5 WHEN loop AND mode = 'direct' THEN 3 WHEN NOT loop AND mode = 'mannequin' THEN 3 ELSE 5 END AS seconds FROM m)
SELECT o_orderkey, seconds, CASE seconds WHEN 3 THEN 73 ELSE 124 END AS frames FROM s""",
    "rule_frame_grid": """WITH n AS (SELECT o_orderkey, greatest(5, CAST(round_even((o_orderkey % 100) / 10.0::DOUBLE * 24, 0) AS INT)) AS n FROM orders)
SELECT o_orderkey, n + ((5 - n % 17) % 17 + 17) % 17 AS frames FROM n""",
    "rule_frame_size": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size * 20 WHEN p_partkey % 2 = 0 THEN (p_size * 10 + 7) // 16 * 16 ELSE 640 END AS size FROM part",
}
