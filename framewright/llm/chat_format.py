r"""Chat formatting into budgeted windows, in built-in SQL functions.

A turn is written as ``### role: text </turn>`` and a newline. Inside texts and roles the escape character and the control
strings' characters are escaped one for one (``\b`` a backslash, ``\h`` a #, ``\t`` a </turn>), so that no text or role
holds a control string and the output reads back exactly. A turn costs its words and one for its role. Prefix sums of the
costs choose spans of whole turns: a window takes turns while they fit the budget; every later window starts with the
system turn and a limited number of repeated turns. The loss mask covers assistant texts, each only where it is new.

Scale: prefix sums run within blocks of turn numbers and go on from the sums of the blocks before, so that one long
conversation is many tasks' work. They cut a conversation into segments of SEGMENT_COST; a row holds one segment, and takes
the last turns of the segment before, and the system turn, by equality joins. Only a digest of a whole conversation, as in
the registered query, brings it into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import stored

END = " </turn>\n"
#: Plain and escaped strings, in the order in which they are escaped. No escaped string holds a plain one, but for the first.
ESCAPES = [("\\", "\\b"), ("</turn>", "\\t"), ("#", "\\h")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c"), ("\n", "\\n")]

BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 512, 128, 4
#: Turns are formatted together in segments of this cost, which start windows of their own; and summed in blocks of so many turn numbers.
SEGMENT_COST, BLOCK_TURNS = 8192, 1024
WINDOW = "struct<history:int,start:int,stop:int>"
TURN = "struct<role:string,cost:int,head:string,body:string>"


def escaped(text: Column, table=ESCAPES) -> Column:
    for plain, safe in table:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column, table=ESCAPES) -> Column:
    """Each backslash begins one escape, and only the last step, which isn't read again, makes backslashes."""
    for plain, safe in reversed(table):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(turns: Column, system: Column, begin: Column, budget: int, history_tokens: int, history_turns: int) -> Column:
    """array<WINDOW> over turn indexes; turns [history, start) are repeated, [start, stop) are new. The first start is ``begin``."""
    sums = F.aggregate(turns, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t["cost"])))

    def chosen(p: Column) -> Column:
        of_system = F.element_at(p, system + 1)

        def history(i: Column) -> Column:
            """Where the turns start that are repeated before a window whose first new turn is i."""
            cost = F.element_at(p, i + 2) - F.element_at(p, i + 1)
            back = F.sequence(F.greatest(i - history_turns, system), F.greatest(i, system))
            again = lambda j: F.element_at(p, i + 1) - F.element_at(p, j + 1)
            return F.coalesce(F.array_min(F.filter(back, lambda j: (again(j) <= history_tokens) & (of_system + again(j) + cost <= budget))), i)

        def before(i: Column, first: Column) -> Column:
            return of_system + F.element_at(p, i + 1) - F.element_at(p, first + 1)

        state = lambda done, first, start, used: F.struct(done.alias("done"), first.alias("history"), start.alias("start"), used.alias("used"))
        none = F.array().cast(f"array<{WINDOW}>")
        initial = F.when(begin == 0, state(none, F.lit(0), F.lit(0), F.lit(0))).otherwise(
            _let(history(begin), lambda h: state(none, h, begin, before(begin, h)))
        )

        def step(acc: Column, i: Column) -> Column:
            cost = F.element_at(p, i + 2) - F.element_at(p, i + 1)
            full = (acc["used"] + cost > budget) & (i > acc["start"]) & (i > system)
            closed = F.array(F.struct(acc["history"].alias("history"), acc["start"].alias("start"), i.alias("stop")))
            fresh = _let(history(i), lambda h: state(F.concat(acc["done"], closed), h, i, before(i, h) + cost))
            return F.when(full, fresh).otherwise(state(acc["done"], acc["history"], acc["start"], acc["used"] + cost))

        def last(acc: Column) -> Column:
            return F.concat(acc["done"], F.array(F.struct(acc["history"].alias("history"), acc["start"].alias("start"), F.size(turns).alias("stop"))))

        return F.aggregate(F.sequence(begin, F.size(turns) - 1), initial, step, last)

    return _let(sums, chosen)


def _render(turns: Column, window: Column, system: Column) -> Column:
    """struct<text, repeated, loss> of one window: its text, how many leading turns repeat, the masked code points."""
    again = F.concat(
        F.when(window["start"] > 0, F.slice(turns, 1, system)).otherwise(F.slice(turns, 1, 0)),
        F.slice(turns, window["history"] + 1, window["start"] - window["history"]),
    )
    new = F.slice(turns, window["start"] + 1, window["stop"] - window["start"])
    loss = F.array().cast("array<struct<start:int,stop:int>>")
    start = F.struct(F.lit(0).alias("at"), loss.alias("loss"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        stop = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct(
            (stop + len(END)).alias("at"), F.when(t["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss")
        )

    shown = F.concat(
        F.transform(again, lambda t: F.struct(t["head"].alias("head"), t["body"].alias("body"), F.lit(False).alias("target"))),
        F.transform(new, lambda t: F.struct(t["head"].alias("head"), t["body"].alias("body"), (t["role"] == "assistant").alias("target"))),
    )
    return _let(shown, lambda all_: F.struct(
        F.array_join(F.transform(all_, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("text"),
        F.size(again).alias("repeated"),
        F.aggregate(all_, start, step, lambda acc: acc["loss"]).alias("loss"),
    ))


def _segments(turns: DataFrame, segment_cost: int, block_turns: int) -> DataFrame:
    """(key, conv, segment, before, turns): the turns of a segment in order, and what the turns before it cost; key has no nulls."""
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).alias("block"),
    ).withColumn("cost", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) + 1)
    blocks = rows.groupBy("key", "block").agg(F.sum("cost").alias("cost"))
    of_blocks = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("cost").over(of_blocks), F.lit(0)).alias("offset"))
    of_turns = Window.partitionBy("key", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("cost").over(of_turns))
    summed = summed.join(blocks, ["key", "block"]).withColumn("upto", F.col("upto") + F.col("offset"))
    whole = summed.groupBy("key", F.floor((F.col("upto") - 1) / segment_cost).alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("upto", "role", "text", "cost"))).alias("turns"), F.min(F.col("upto") - F.col("cost")).alias("before"), F.min("conv").alias("conv")
    )
    return whole.select("key", "conv", "segment", "before", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["cost"].alias("cost"),
        F.concat(F.lit("### "), escaped(t["role"], ROLE_ESCAPES), F.lit(": ")).alias("head"), escaped(t["text"]).alias("body"),
    )).alias("turns"))


def chat_windows(
    turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS,
    segment_cost: int = SEGMENT_COST, block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """One row per window: conv_id, segment, window, text, repeated, loss, from rows (conv_id, turn, role, text).

    Turns go by (turn, role, text), nulls first; repeated rows are turns of their own. Null roles and texts count as empty;
    a null conv_id is one conversation. Tokens are runs without white space, and one for the role. A turn beyond the budget
    is whole, and the only new turn of its window. A first turn with the role system stands in every window. ``repeated`` is the number of leading
    turns that an earlier window has as new ones; loss has code point spans (start, stop). Windows of a conversation go by
    (segment, window). Other columns are ignored; an empty table gives an empty result.
    """
    segments = stored(_segments(turns, segment_cost, block_turns), "segments")
    none = F.array().cast(f"array<{TURN}>")
    first = segments.filter("before = 0").select("key", "conv", "segment", "turns", F.when(F.col("turns")[0]["role"] == "system", 1).otherwise(0).alias("system"), F.lit(0).alias("begin"))
    tails = segments.select("key", F.col("segment").alias("last"), F.slice("turns", -F.least(F.size("turns"), F.lit(history_turns)), F.lit(history_turns)).alias("tail"))
    heads = first.filter("system = 1").select("key", F.slice("turns", 1, 1).alias("head"), F.size("turns").alias("n"), F.col("segment").alias("at"))
    later = segments.filter("before > 0").withColumn("previous", F.floor((F.col("before") - 1) / segment_cost))
    later = later.join(tails, (later["key"] == tails["key"]) & (F.col("previous") == F.col("last"))).drop(tails["key"])
    later = later.join(heads, "key", "left").withColumn("head", F.coalesce("head", none))
    # the system turn isn't repeated twice where the segment before has only it and a few more
    whole_tail = (F.col("previous") == F.col("at")) & (F.col("n") <= history_turns)
    tail = F.when(whole_tail, F.slice("tail", F.lit(2), F.lit(history_turns))).otherwise(F.col("tail"))
    later = later.select(
        "key", "conv", "segment", F.concat("head", tail, "turns").alias("turns"), F.size("head").alias("system"), (F.size("head") + F.size(tail)).alias("begin")
    )
    every = first.unionByName(later)
    every = every.withColumn("spans", _windows(F.col("turns"), F.col("system"), F.col("begin"), budget, history_tokens, history_turns))
    shown = every.select("conv", "segment", F.posexplode(F.transform("spans", lambda w: _render(F.col("turns"), w, F.col("system")))).alias("window", "w"))
    return shown.select(F.col("conv").alias("conv_id"), "segment", "window", "w.*")


def read_turns(text: Column, repeated: Column) -> Column:
    """array<struct<role, text>> of one window's new turns, read back from its text."""
    ended = F.split(text, END)
    new = F.slice(ended, repeated + 1, F.size(ended) - 1 - repeated)
    return F.transform(new, lambda t: F.struct(
        unescaped(F.regexp_extract(t, r"(?s)^### ([^:]*): ", 1), ROLE_ESCAPES).alias("role"),
        unescaped(F.regexp_extract(t, r"(?s)^### [^:]*: (.*)$", 1)).alias("text"),
    ))


def read_loss(text: Column, loss: Column) -> Column:
    """The window's text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.call_function("substring", text, s["start"] + 1, s["stop"] - s["start"]))), "")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    windows = chat_windows(turns.unionByName(odd))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = windows.withColumn("read", read_turns(F.col("text"), F.col("repeated"))).select(
        "conv_id", "segment", "window", lines.alias("lines"), F.size("read").alias("n"), read_loss(F.col("text"), F.col("loss")).alias("loss"),
        F.length("text").alias("length"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("segment", "window", "lines", "loss"))).alias("parts"),
        F.sum("length").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
    )
    whole = whole.select("*", F.array_join("parts.lines", "").alias("lines"), F.array_join("parts.loss", "").alias("loss"))
    return whole.select(
        "conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )


#: The windows' sizes come from the same sums, turn by turn; texts of windows are compared with a brute-force version in the tests.
OP7_SQL = r"""
WITH RECURSIVE given AS (
   SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(i)),
 sized AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS cost,
   15 + length(replace(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '#', '\h'), ':', '\c'), chr(10), '\n'))
      + length(replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '#', '\h')) AS size FROM given),
 numbered AS (SELECT *, row_number() OVER w - 1 AS i, sum(cost) OVER w AS upto, sum(size) OVER w AS chars FROM sized
   WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
 conv AS (SELECT conv_id, list_prepend(0, list(upto::BIGINT ORDER BY i)) AS p, list_prepend(0, list(chars::BIGINT ORDER BY i)) AS c, count(*) AS n,
   max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS sys, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS lines,
   coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss FROM numbered GROUP BY conv_id),
 step AS (
   SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS start, p[2] AS used, c[2] AS chars, 1::BIGINT AS windows FROM conv
   UNION ALL
   SELECT conv_id, i, CASE WHEN fresh THEN i ELSE start END, CASE WHEN fresh THEN p[sys + 1] + p[i + 1] - p[h + 1] + p[i + 2] - p[i + 1] ELSE used + p[i + 2] - p[i + 1] END,
          chars + c[i + 2] - c[i + 1] + CASE WHEN fresh THEN c[sys + 1] + c[i + 1] - c[h + 1] ELSE 0 END, windows + fresh::BIGINT
   FROM (SELECT s.conv_id, s.i + 1 AS i, start, used, chars, windows, p, c, sys,
            (used + p[s.i + 3] - p[s.i + 2] > 512 AND s.i + 1 > start AND s.i + 1 > sys) OR (p[s.i + 3] - 1) // 8192 <> (p[s.i + 2] - 1) // 8192 AS fresh,
            coalesce(list_min(list_filter(range(greatest(s.i - 3, sys), s.i + 1), lambda j: p[s.i + 2] - p[j + 1] <= 128 AND p[sys + 1] + p[s.i + 3] - p[j + 1] <= 512)), s.i + 1) AS h
         FROM step s JOIN conv ON conv.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.i + 1 < n))
SELECT conv.conv_id, n AS n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars AS formatted_chars, windows AS n_windows
FROM conv JOIN step ON step.conv_id IS NOT DISTINCT FROM conv.conv_id AND step.i = n - 1
"""
