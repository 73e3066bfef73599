"""Registered queries of the document operators: customers as projects, orders as motions and jobs."""

from __future__ import annotations

from framewright.functions import text as fn
from framewright.operators import documents as op
from framewright.sources.tables import cells, table
from pyspark.sql import functions as F

STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END"
TEMPLATE = '{"text": "{{NAME}}", "label": "size {{SIZE}} of {{NAME}}", "size": "{{SIZE}}", "list": ["{{PRICE}}", {"seed": 7, "other": "{{OTHER}}"}]}'


def project_documents(spark, folder):
    """(path, json): a document a customer; every 13th is cut off, every 17th has no turnaround."""
    motions = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.struct(F.concat(F.lit("m"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("id"), F.col("o_orderpriority").alias("name"), F.expr(STATUS_SQL).alias("status")).alias("m")
    ).groupBy("c_custkey").agg(F.array_sort(F.collect_list("m")).alias("motions"))
    document = F.to_json(F.struct(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("2024-01-01 00:00:00").alias("created"),
        F.when(F.col("c_custkey") % 17 > 0, "turnaround.png").alias("turnaround"), "motions",
    ))
    path = F.concat(F.lit("p"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    whole = table(spark, folder, "customer").select("c_custkey", "c_name").join(motions, "c_custkey", "left")
    cut = F.when(F.col("c_custkey") % 13 == 0, F.expr("left(json, length(json) - 2)")).otherwise(F.col("json"))
    return whole.withColumn("json", document).select(path.alias("path"), cut.alias("json"))


def _found(spark, folder):
    docs = project_documents(spark, folder).filter("path not like '%5'")
    motions = op.motions_of(docs)
    wanted = motions.groupBy("project").agg(F.max("id").alias("id")).filter("id is not null")
    return op.found(wanted, motions)


def _interrupted(spark, folder):
    return op.interrupted(op.motions_of(project_documents(spark, folder))).groupBy("project", "status").agg(F.count(F.lit(1)).alias("motions"))


def _config(spark, folder):
    own = F.from_json("props", "map<string,string>")
    merged = op.overlaid({"k": "0", "mode": "plain"}, F.when(F.col("event_id") % 3 > 0, own))
    return table(spark, folder, "events").select("event_id", merged["k"].alias("k"), merged["mode"].alias("mode"), F.size(merged).alias("n"))


def _keyframes(spark, folder):
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("event_id").cast("double").alias("t"), F.col("value").alias("v"))).alias("keys"))).alias("json"))
    keys = op.keyframes(F.concat(F.lit("Here it is: "), "json", F.lit(" Done.")))
    made = rows.select("user_id", keys.alias("k"))
    return made.select("user_id", F.size("k").alias("n"), F.col("k")[0]["t"].alias("first"), F.element_at("k", -1)["v"].alias("last"))


def _repaired(spark, folder):
    turns = table(spark, folder, "conversations").groupBy("conv_id")
    picked = lambda c: F.coalesce(F.array_sort(F.collect_set(F.when(c, F.col("turn")))), F.array().cast("array<long>"))
    sets = turns.agg(picked(F.col("turn") % 2 == 0).alias("held"), picked(F.col("turn") % 3 == 0).alias("added"), picked(F.col("turn") % 5 == 0).alias("removed"))
    return sets.select("conv_id", F.array_join(op.repaired_set(F.col("held"), F.col("added"), F.col("removed")), ",").alias("frames"))


def _lines(spark, folder):
    return cells(spark, folder).select("key", "dir", "slot", "w", "h")


def _edited(spark, folder):
    rows = _lines(spark, folder).select(F.concat_ws("-", "key", "dir").alias("key"), "slot", "w", "h")
    edits = rows.filter("h % 3 = 0").select("key", "slot", F.when(F.col("h") % 2 == 0, F.col("h")).alias("frame"))
    return op.edited_overrides(rows.filter("w % 2 = 0").select("key", "slot", F.col("w").alias("frame")), edits)


def _redone(spark, folder):
    rows = _lines(spark, folder).groupBy("key", "dir").agg(F.sum("w").alias("value"), F.max("h").alias("chosen"))
    return op.redone(rows, rows.filter("dir % 3 = 0 and key % 2 = 0").select("key", "dir", (F.col("value") * 10).alias("value")))


def _jobs(spark, folder):
    orders = table(spark, folder, "orders")
    return op.active_jobs(orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("created"), F.expr(STATUS_SQL).alias("state"), (F.col("o_totalprice") % 1000 / 1000).alias("progress")))


def _eta(spark, folder):
    source = F.element_at(F.array(*map(F.lit, op.DIRECTION_SECONDS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return op.expected_seconds(table(spark, folder, "orders").select(F.col("o_custkey").alias("project"), source.alias("source"), (1 + F.col("o_orderkey") % 8).alias("directions")))


def _pixel_cells(spark, folder):
    rows = _lines(spark, folder).groupBy("key", "dir").agg(F.max("h").alias("height"))
    return op.pixel_cells(rows.withColumns({"cell": F.col("key") % 5, "wanted": F.lit(24)}))


def _pixel_heights(spark, folder):
    motions = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") + F.col("o_custkey") % 2).alias("file"), F.when(F.col("o_orderkey") % 3 > 0, "pixel").otherwise("hd").alias("style"), F.lit(64).alias("wanted"))
    return op.pixel_heights(motions, _pixel_cells(spark, folder).withColumnRenamed("key", "file"))


def _fill(spark, folder):
    parts = table(spark, folder, "part")
    made = op.filled_json(F.lit(TEMPLATE), {"NAME": F.concat(F.lit('a "'), F.col("p_name"), F.lit('"')), "SIZE": F.col("p_size"), "PRICE": F.when(F.col("p_size") > 5, F.col("p_size") / 2)})
    return parts.select("p_partkey", made.alias("json"))


def _reseed(spark, folder):
    flow = F.concat(F.lit('{"3": {"inputs": {"seed": '), F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("string")).otherwise('["8", 0]'), F.lit(', "noise_seed":-5, "steps": 8}}, "n": "seed"}'))
    flow = F.when(F.col("p_size") % 8 == 0, F.replace(flow, F.lit("noise_seed"), F.lit("noise"))).otherwise(flow)
    return table(spark, folder, "part").select("p_partkey", op.reseeded(flow, F.col("p_partkey") + 1000).alias("json"))


def _rules(spark, folder):
    part = table(spark, folder, "part")
    oneshot, pixel = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    return part.select(
        "p_partkey", fn.effects_of(F.when(F.col("p_size") % 5 == 0, F.lower(F.substring("p_brand", 1, 5))), F.col("p_size") % 7 == 0).alias("effects"),
        fn.frame_fit(oneshot)["size"].alias("fit_size"), fn.frame_fit(oneshot)["foot"].alias("fit_foot"), F.round(fn.mannequin_elevation(F.col("p_size") * 1.5), 6).alias("elevation"),
        fn.mannequin_background(F.when(F.col("p_size") % 11 == 0, "gray")).alias("back"), fn.is_valid_setting(F.col("p_size") % 10, F.when(pixel, "pixel").otherwise(F.col("p_type")), F.col("p_size") * 4).alias("valid"),
        fn.style_phrase(F.when(pixel, "pixel").otherwise("hd"), F.col("p_size")).alias("style"),
    )


QUERIES = {
    "doc_projects": lambda s, d: op.projects(project_documents(s, d)),
    "doc_find_motion": _found,
    "doc_interrupted": _interrupted,
    "doc_config": _config,
    "doc_keyframes": _keyframes,
    "set_repaired": _repaired,
    "set_last_wins": lambda s, d: op.last_wins(table(s, d, "lineitem").select(F.col("l_partkey").alias("path"), F.struct("l_linenumber", "l_orderkey", "l_extendedprice").alias("rank"), F.col("l_quantity").alias("value"))),
    "pick_override_edits": _edited,
    "store_partial_redo": _redone,
    "job_active": _jobs,
    "job_eta": _eta,
    "sheet_pixel_cells": _pixel_cells,
    "rule_pixel_height": _pixel_heights,
    "txt_json_template": _fill,
    "txt_reseed": _reseed,
    "rule_settings": _rules,
}
_CELL = """cell AS (SELECT l_orderkey AS key, l_linenumber AS dir, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS slot, CAST(16 + l_partkey % 48 AS INT) AS w, CAST(16 + l_suppkey % 48 AS INT) AS h FROM lineitem)"""
_PIXEL = f"""{_CELL}, hd AS (SELECT key, dir, max(h) AS height FROM cell GROUP BY ALL), md AS (SELECT key, key % 5 AS cell, median(height) AS height FROM hd GROUP BY key),
 pc AS (SELECT key, CASE WHEN cell > 0 AND round_even(height / cell, 0) BETWEEN 12 AND 48 THEN CAST(round_even(height / cell, 0) AS INT) END AS cells FROM md)"""
ORACLES = {
    "doc_projects": """WITH g AS (SELECT c_custkey, c_name, count(o_orderkey) AS motions FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 13 > 0 AND c_custkey % 17 > 0 GROUP BY ALL)
SELECT row_number() OVER (ORDER BY c_custkey DESC) - 1 AS place, 'p' || c_custkey AS id, c_name AS name, '2024-01-01 00:00:00' AS created, 'turnaround.png' AS turnaround, motions FROM g""",
    "doc_find_motion": f"""SELECT 'p' || o_custkey AS project, 'm' || lpad(max(o_orderkey)::VARCHAR, 8, '0') AS id, max_by(o_orderpriority, o_orderkey) AS name, max_by({STATUS_SQL}, o_orderkey) AS status
FROM orders WHERE o_custkey % 13 > 0 AND o_custkey % 10 <> 5 GROUP BY o_custkey""",
    "doc_interrupted": "SELECT 'p' || o_custkey AS project, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'interrupted' END AS status, count(*) AS motions FROM orders WHERE o_custkey % 13 > 0 GROUP BY ALL",
    "doc_config": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN coalesce(json_extract_string(props, '$.k'), '0') ELSE '0' END AS k, 'plain' AS mode, 2 AS n FROM events",
    "doc_keyframes": "SELECT user_id, count(*) AS n, min(event_id)::DOUBLE AS first, arg_max(value, event_id) AS last FROM events GROUP BY user_id",
    "set_repaired": "SELECT conv_id, coalesce(string_agg(DISTINCT turn, ',' ORDER BY turn) FILTER ((turn % 2 = 0 OR turn % 3 = 0) AND turn % 5 > 0), '') AS frames FROM conversations GROUP BY conv_id",
    "set_last_wins": "SELECT l_partkey AS path, (max({'l': l_linenumber, 'o': l_orderkey, 'e': l_extendedprice, 'v': l_quantity})).v AS value FROM lineitem GROUP BY l_partkey",
    "pick_override_edits": f"WITH {_CELL} SELECT key || '-' || dir AS key, slot, CASE WHEN h % 3 = 0 THEN h ELSE w END AS frame FROM cell WHERE (h % 3 = 0 AND h % 2 = 0) OR (h % 3 > 0 AND w % 2 = 0)",
    "store_partial_redo": f"WITH {_CELL} SELECT key, dir, sum(w) * CASE WHEN dir % 3 = 0 AND key % 2 = 0 THEN 10 ELSE 1 END AS value, CASE WHEN dir % 3 = 0 AND key % 2 = 0 THEN NULL ELSE max(h) END AS chosen FROM cell GROUP BY key, dir",
    "job_active": """SELECT o_custkey AS project, o_orderkey AS id, o_orderpriority AS kind, floor(o_totalprice % 1000 / 1000 * 1000 + 0.5::DOUBLE) / 1000 AS progress, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place
FROM orders WHERE o_orderstatus <> 'F'""",
    "job_eta": "SELECT o_custkey AS project, sum(CASE WHEN o_orderkey % 4 = 2 THEN 50 ELSE 0 END + (1 + o_orderkey % 8) * ([125, 720, 320, 720])[o_orderkey % 4 + 1])::BIGINT AS seconds FROM orders GROUP BY o_custkey",
    "sheet_pixel_cells": f"WITH {_PIXEL} SELECT key, cells FROM pc",
    "rule_pixel_height": f"WITH {_PIXEL} SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE coalesce(nullif(cells, 0), 64) END AS height FROM orders LEFT JOIN pc ON pc.key = o_orderkey + o_custkey % 2",
    "txt_json_template": """SELECT p_partkey, '{"text": "a \\"' || p_name || '\\"", "label": "size ' || p_size || ' of a \\"' || p_name || '\\"", "size": ' || p_size || ', "list": ['
 || CASE WHEN p_size > 5 THEN (p_size / 2.0::DOUBLE)::VARCHAR ELSE 'null' END || ', {"seed": 7, "other": "{{OTHER}}"}]}' AS json FROM part""",
    "txt_reseed": """SELECT p_partkey, CASE WHEN p_size % 8 > 0 THEN '{"3": {"inputs": {"seed": ' || CASE WHEN p_size % 4 > 0 THEN (p_partkey + 1000)::VARCHAR ELSE '["8", 0]' END || ', "noise_seed":' || (p_partkey + 1000) || ', "steps": 8}}, "n": "seed"}' END AS json FROM part""",
    "rule_settings": """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN lower(substr(p_brand, 1, 5)) WHEN p_size % 7 = 0 THEN 'strip' ELSE 'vivid' END AS effects, CASE WHEN p_size % 2 = 0 THEN 0.52 ELSE 0.72 END::DOUBLE AS fit_size,
 CASE WHEN p_size % 2 = 0 THEN 0.14 ELSE 0.12 END::DOUBLE AS fit_foot, round(p_size::DOUBLE, 6) AS elevation, CASE WHEN p_size % 11 = 0 THEN '#808080' ELSE '#FF00FF' END AS back,
 p_size % 10 IN (2, 4, 8) AND p_size % 3 = 0 AND p_size * 4 BETWEEN 24 AND 160 AS valid,
 CASE WHEN p_size % 3 = 0 THEN 'TRUE PIXEL ART game sprite: each character is about ' || p_size || ' pixel-art pixels tall; every pixel-art pixel is a crisp square block of exactly the same size across the whole image, aligned to one grid; no anti-aliasing, no gradients, no blur, no soft edges; a limited palette of about 24 colors; a clean 1-pixel dark outline around each character; simple cel shading with 2 to 3 shades per material'
 ELSE 'the same clean 2D game illustration style as the reference, with cel shading and clear dark outlines' END AS style FROM part""",
}
