"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by a dictionary of trie-node pairs.

The words are numbered twice as tries: read forwards, every distinct beginning is a node; read backwards, every distinct
ending is. Leaving out position p of a word gives the pair (node of the beginning before p, node of the ending after p);
the gap before position p gives the pair (node before p, node from p on). Two words with the same left-out pair differ by
a replaced letter; a word whose left-out pair is another's gap pair has one letter more. So integer pairs, joined by
grouping, give the exact neighbours. In a run of equal letters only leaving out the last one counts as an insertion,
so that no neighbour is met twice.

Numbering needs no join of beginnings: the words are sorted, and a word shares the nodes of its common beginning with the
word before it. Every range of the sort numbers its own words; the first word of a range takes the nodes it shares with
the word before from the range before it (two words a range on the driver). The node of a whole word is in the words'
order, so integers settle ties between words.

Scale: (2 length + 1) pairs of integers a distinct word shuffle once; a group holds at most one word a letter and one
more, so that no group is hot and no pair of words is ever written. Neighbours are counted and the best is found within the groups.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm.bpe import chunks, tidy
from framewright.llm.common import stored

#: Words counted together in a task before they go to Spark's own aggregation.
MOST_COUNTED = 200_000
#: Words in a range of the sort.
RANGE_WORDS = 200_000


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, noise: int | None = 31) -> DataFrame:
    """(word, n) of the runs of letters (A-Z, a-z, U+00C0 to U+00FF) in whole texts, A-Z in lower case; words of ``least_chars`` letters and more.

    With ``noise``, the runs of one document whose CRC-32 of ``id:run`` is divisible by it lose a letter, the same one in each
    place. Null texts have no words, a null id counts as the empty string, repeated rows count again.
    """
    run = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in chunks(batches):
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                seed = zlib.crc32(f"{ident}:".encode())
                for word, n in Counter(run.findall(text.lower())).items():  # bytes: A-Z alone are changed
                    if noise and (h := zlib.crc32(word, seed)) % noise == 0:
                        letters = word.decode()
                        if len(letters) == least_chars:
                            continue
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    found[word] += n
                if len(found) > MOST_COUNTED:
                    yield flush()
        if found:
            yield flush()

    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].alias("text")).filter("text is not null")
    return rows.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _common(a: str, b: str) -> int:
    """How many letters both begin with."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def trie_nodes(words: DataFrame, key: str, parts: int) -> DataFrame:
    """``words`` with nodes array<long>: the node number of each beginning of the distinct strings ``key``, from the empty one on.

    Numbers are distinct within the trie; those of whole strings grow in the order of the strings.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in words.dtypes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, free = "", np.zeros(1, np.int64), 1
        for batch in batches:
            lists, ends = [], [0]
            for word in batch.column(key).to_pylist():
                same = _common(last, word)
                nodes = np.concatenate([nodes[: same + 1], np.arange(free, free + len(word) - same)])
                free += len(word) - same
                last = word
                lists.append(nodes)
                ends.append(ends[-1] + len(nodes))
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "nodes"])

    ranges = words.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    local = stored(ranges.mapInArrow(number, f"{kinds}, part int, nodes array<long>"), "trie")
    # every range began at its own root: its first beginnings are those of the last word of the range before it
    ends = local.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(key, "nodes")).alias("last"), F.max(F.element_at("nodes", -1)).alias("most"))
    base, before, rows = 0, None, []
    for end in sorted(ends.collect(), key=lambda r: r["part"]):
        shared = before[1][: _common(before[0], end["first"]) + 1] if before else []
        rows.append((end["part"], base, shared))
        nodes = [shared[x] if x < len(shared) else base + x for x in end["last"]["nodes"]]
        before, base = (end["last"][key], nodes), base + end["most"] + 1
    bases = words.sparkSession.createDataFrame(rows, "part int, base long, shared array<long>")
    whole = F.transform("nodes", lambda x: F.when(x < F.size("shared"), F.get("shared", x.cast("int"))).otherwise(F.col("base") + x))
    return local.join(F.broadcast(bases), "part").select(*words.columns, whole.alias("nodes"))


def node_pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(front, rear, id, n, role): the left-out and gap pairs of words (id, word, n, nodes), with backward nodes by (word, nodes).

    Role 0: a left-out letter; 1: one that the next letter equals, no insertion here; 2: a gap.
    """
    both = forward.withColumnRenamed("nodes", "f").join(backward.select("word", F.col("nodes").alias("b")), "word")
    both = both.withColumn("c", F.split("word", "")).withColumn("size", F.size("f") - 1)
    letter = lambda p: F.get(F.col("c"), p)
    skipped = lambda p: F.struct(
        F.get("f", p).alias("front"), F.get("b", F.col("size") - 1 - p).alias("rear"),
        F.when((p + 1 < F.col("size")) & (letter(p) == letter(p + 1)), 1).otherwise(0).alias("role"),
    )
    gap = lambda p: F.struct(F.get("f", p).alias("front"), F.get("b", F.col("size") - p).alias("rear"), F.lit(2).alias("role"))
    places = F.sequence(F.lit(0), F.col("size"))
    pairs = F.concat(F.transform(F.slice(places, F.lit(1), F.col("size")), skipped), F.transform(places, gap))
    return both.select("id", "n", F.explode(pairs).alias("p")).select("p.front", "p.rear", "id", "n", "p.role")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best struct<n, turned>): how many words are near a word, and the one of largest n (least id, turned negative)."""
    same = W.partitionBy("front", "rear")
    met = pairs.withColumn("many", F.count(F.lit(1)).over(same)).filter("many > 1")
    member = F.struct("n", (-F.col("id")).alias("turned"), "role")
    groups = met.groupBy("front", "rear").agg(F.sort_array(F.collect_list(member), asc=False).alias("all"), (F.count_if(F.col("role") > 0) > 1).alias("apart"))
    each = groups.select("all", "apart", F.explode("all").alias("m"))
    mine = F.col("m.turned")
    # a letter left out of a run and a gap meet elsewhere; of the first three one is near, if any is
    near = F.filter(F.slice("all", 1, 3), lambda x: (x["turned"] != mine) & ((x["role"] == 0) | (F.col("m.role") == 0)))
    found = each.select(
        (-mine).alias("id"), (F.size("all") - 1 - (F.col("apart") & (F.col("m.role") > 0)).cast("int")).cast("long").alias("many"),
        F.get(near, F.lit(0)).alias("best"),
    )
    return found.groupBy("id").agg(F.sum("many").alias("n_near"), F.max(F.struct("best.n", "best.turned")).alias("best"))


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of counted words (word, n): the commoner spelling of each, if there is one.

    Two words are near if one inserted, deleted or replaced code point makes one the other. The form of a word is the near
    word of largest n (ties: the least in code-point order), if that is at least ``ratio`` times its own n; root follows
    forms to the last (the word itself without a form). Repeated words are one, their counts added; null words are left
    out, null counts are 0; the empty word is a word. An empty table gives an empty result; other columns don't matter.
    """
    counted = words.filter("word is not null").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
    counted = stored(counted, "words")
    parts = max(1, -(-counted.count() // RANGE_WORDS))
    forward = trie_nodes(counted, "word", parts).withColumn("id", F.element_at("nodes", -1))
    backward = trie_nodes(counted.select(F.reverse("word").alias("drow")), "drow", parts).withColumn("word", F.reverse("drow"))
    found = stored(neighbours(node_pairs(forward, backward)), "near")
    named = forward.select("id", "word", "n")
    rows = named.join(found, "id", "left")
    fits = F.col("best.n") >= ratio * F.col("n")
    rows = stored(rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.turned")).alias("to")), "forms")
    step = rows.filter("to is not null").select("id", F.col("to").alias("root"))
    while True:  # n grows by the ratio at each form, so a chain is short, and its followed part doubles each time
        beyond = step.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        moved = stored(step.join(beyond, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        step = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            break
    form = named.select(F.col("id").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = named.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    ends = rows.join(step.withColumnRenamed("root", "root_id"), "id", "left").join(form, "to", "left").join(root, "root_id", "left")
    return ends.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_variants(document_words(docs).filter("n >= 2"))
