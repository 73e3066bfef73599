"""Registered queries of the store operators: conversations as versions, events as attempts, nations as directions."""

from __future__ import annotations

from framewright.operators import store as op
from framewright.sources.tables import table
from pyspark.sql import functions as F


def _attempts(spark, folder):
    events = table(spark, folder, "events")
    return op.best_attempts(events.select("user_id", F.col("event_id").alias("attempt"), F.floor("value").alias("drift")), "user_id")


def _missing(spark, folder):
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    customers = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING' and c_acctbal > 9000")
    required = nations.join(F.broadcast(regions), nations["n_regionkey"] == regions["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    return op.missing(required, customers.select(F.col("c_nationkey").alias("n_nationkey")), ["n_nationkey"])


def _sets(spark, folder):
    have = table(spark, folder, "labels").groupBy().agg(F.count(F.lit(1)).alias("labelled"))
    docs, labels = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels").select("doc_id")
    counts = docs.join(labels, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("both")), docs.join(labels, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("only_docs"))
    return have.join(counts[0]).join(counts[1])


QUERIES = {
    "store_versions_last3": lambda s, d: op.last_versions(table(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn"),
    "store_swap": lambda s, d: op.swapped(table(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("size")), "conv_id", "turn", "size"),
    "store_best_attempt": _attempts,
    "set_missing_dirs": _missing,
    "set_label_overlap": _sets,
    "store_project_list": lambda s, d: table(s, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(
        F.count(F.lit(1)).alias("motions"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("updated")),
}
ORACLES = {
    "store_versions_last3": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations QUALIFY rank <= 3",
    "store_swap": """WITH v AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER w AS r, count(*) OVER (PARTITION BY conv_id) AS m, lead(length(text)) OVER w AS older, lag(length(text)) OVER w AS newer
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, CASE WHEN m > 1 AND r = 1 THEN older WHEN m > 1 AND r = 2 THEN newer ELSE size END AS size FROM v""",
    "store_best_attempt": "SELECT user_id, (min({'d': floor(value), 'a': event_id})).a AS attempt, CAST((min({'d': floor(value), 'a': event_id})).d AS BIGINT) AS drift FROM events GROUP BY user_id",
    "set_missing_dirs": """SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
 WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)""",
    "set_label_overlap": "SELECT (SELECT count(*) FROM labels) AS labelled, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS \"both\", (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_docs",
    "store_project_list": "SELECT o_custkey AS project, count(*) AS motions, count(*) FILTER (o_orderstatus = 'F') AS done, max(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) AS updated FROM orders GROUP BY 1",
}
