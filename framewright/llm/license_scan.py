"""License scan: ordered signature rules over normalised words, in built-in SQL functions and without a shuffle.

Each text becomes lower-case words joined by single spaces. Documents without any rule keyword stop there. In the
others, a rule's regex runs only where its literal phrase occurs, and marks its spans in the text, so that word positions
come from one split. Spans inside another span of the same or a higher priority are suppressed (of equal spans the
first rule stays). All work is per row: it needs no shuffle, and a very common licence line costs no more than a rare one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import renamed
from framewright.llm.license_rules import build_rules

#: Fixed values of the base scan: phrase and label.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
START, END = "\u0001", "\u0002"  # can't occur among words

RULE_TYPE = "struct<rule:int,label:string,priority:int,keyword:string,literal:string,regex:string,score:double>"
SPAN_TYPE = "array<struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string,score:double>>"


def words_of(text: Column) -> Column:
    """Lower-case words joined by single spaces; ASCII other than letters and digits separates words.

    lower() also folds letters beyond A-Z; that changes neither word borders nor, as all phrases are ASCII, matches.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def count_words(words: Column) -> Column:
    spaces = F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(words == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(padded: Column, regex: Column) -> Column:
    """array<struct<start, stop>> of word indexes: leftmost matches of whole words, not overlapping."""
    marked = F.regexp_replace(padded, F.concat(F.lit(" ("), regex, F.lit(")(?= )")), F.lit(f" {START}$1{END}"))

    def of(tokens: Column) -> Column:
        starts = F.filter(F.transform(tokens, lambda t, i: F.when(F.startswith(t, F.lit(START)), i)), lambda x: x.isNotNull())
        stops = F.filter(F.transform(tokens, lambda t, i: F.when(F.endswith(t, F.lit(END)), i + 1)), lambda x: x.isNotNull())
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))

    return _let(F.split(F.trim(marked), " "), of)


def _table(rules: list[tuple]) -> Column:
    """The rules as one array literal (a single expression keeps planning fast)."""
    names = ("rule", "label", "priority", "keyword", "literal", "regex", "score")
    return F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rules])), f"array<{RULE_TYPE}>")


def _unsuppressed(spans: Column) -> Column:
    """Spans not inside an earlier one (by start, longest, priority, rule) of the same or a higher priority; one pass."""
    start = F.struct(
        F.array(*[F.lit(-1)] * 5).alias("reach"), F.array().cast(SPAN_TYPE).alias("kept")
    )

    def step(acc: Column, s: Column) -> Column:
        inside = F.element_at(acc["reach"], -s["neg_priority"]) >= -s["neg_end"]
        reach = F.transform(
            acc["reach"], lambda x, i: F.when(i < -s["neg_priority"], F.greatest(x, -s["neg_end"])).otherwise(x)
        )
        kept = F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(s)))
        return F.struct(reach.alias("reach"), kept.alias("kept"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["kept"])


def license_scan(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None, rules: list[tuple] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with what the scan found in each whole text.

    n_words; base: array of (label, start, stop) for every place of a base phrase; detections: array of
    (label, rule, priority, start, stop, score) left after suppression; base_labels and labels (base and rules), distinct
    and sorted; score: the largest of the surviving detections, 0 without any. Start and stop are word indexes from 0,
    stop exclusive. Null texts count as empty and give 0 words and empty arrays; rows aren't merged, dropped or reordered.
    Columns of ``docs`` named like the results are replaced; other names don't matter. An empty table gives an empty result.
    """
    rules = build_rules() if rules is None else rules
    results = ("n_words", "base", "detections", "base_labels", "labels", "score")
    carried = [c for c in (docs.columns if columns is None else columns) if c not in results]
    keywords = sorted({r[3] for r in rules} | {p.split(" ")[0] for p, _ in BASE} | {"license"})
    table = _table(rules)
    rows, back = renamed(docs, carried, words=words_of(docs[text_col]))
    rows = rows.withColumn("n_words", count_words(F.col("words")))
    rows = rows.withColumn("words", F.concat(F.lit(" "), F.col("words"), F.lit(" ")))
    padded = F.col("words")
    rows = rows.withColumn("keys", F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(padded, F.concat(F.lit(" "), k, F.lit(" ")))))
    gate = F.size("keys") > 0
    none = F.array().cast("array<struct<label:string,start:int,stop:int>>")

    def places(phrase: str, label: str) -> Column:
        spans = _spans(padded, F.lit(phrase))
        named = F.transform(spans, lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["stop"].alias("stop")))
        return F.when(F.contains(padded, F.lit(f" {phrase} ")), named).otherwise(none)

    base = F.flatten(F.array(*[places(phrase, label) for phrase, label in BASE]))
    live = F.filter(table, lambda r: F.array_contains(F.col("keys"), r["keyword"]) & F.contains(padded, F.concat(F.lit(" "), r["literal"], F.lit(" "))))
    found = F.flatten(F.transform(live, lambda r: F.transform(
        _spans(padded, r["regex"]),
        lambda s: F.struct(
            s["start"].alias("start"), (-s["stop"]).alias("neg_end"), (-r["priority"]).alias("neg_priority"),
            r["rule"].alias("rule"), r["label"].alias("label"), r["score"].alias("score"),
        ),
    )))
    rows = rows.withColumn("base", F.when(gate, base).otherwise(none))
    rows = rows.withColumn("found", F.when(gate, found).otherwise(F.array().cast(SPAN_TYPE)))
    rows = rows.withColumn("left", F.when(F.size("found") > 0, _unsuppressed(F.col("found"))).otherwise(F.col("found")))
    detections = F.transform("left", lambda s: F.struct(
        s["label"].alias("label"), s["rule"].alias("rule"), (-s["neg_priority"]).alias("priority"),
        s["start"].alias("start"), (-s["neg_end"]).alias("stop"), s["score"].alias("score"),
    ))
    base_labels = F.array_sort(F.array_distinct(F.col("base.label")))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.col("left.label"))))
    return rows.select(
        *[F.col(k).alias(c) for k, c in back.items()], "n_words", "base", detections.alias("detections"), base_labels.alias("base_labels"),
        labels.alias("labels"), F.coalesce(F.array_max(F.col("left.score")), F.lit(0.0)).alias("score"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = license_scan(docs, columns=["doc_id"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).cast("long").alias("first_word"),
        F.array_max(F.col("base.start")).cast("long").alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score",
    )


def license_base(spark, sf_dir: str) -> DataFrame:
    """The columns of op6_license_scan that its rules don't change, which SQL can say."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
 phrase(words, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
 place AS (SELECT doc_id, label, unnest(list_filter(range(1, len(ws) - len(words) + 2), lambda i: ws[i : i + len(words) - 1] = words)) - 1 AS pos FROM w, phrase WHERE list_has_all(ws, words))
SELECT w.doc_id, len(any_value(ws)) AS n_words, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN place ON place.doc_id = w.doc_id GROUP BY w.doc_id
"""
