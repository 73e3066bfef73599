"""Substring dedup: repeated windows of words are found by recompression and confirmed on fingerprints.

Rounds of recompression name runs of equal symbols and pairs of symbols of the classes left and right, starting from
words. A name is a 64-bit fingerprint of what it stands for, so all tasks agree on names without exchanging tables, and
whether two neighbours merge depends on their names alone. Equal substrings therefore get equal symbols inside, except
near their ends; for each symbol border the words that decide it are tracked. Every window of words takes as its key the
name of the phrase that starts at its first border of the highest level that its own words decide (level 0, its first
word, always is one). So equal windows have equal keys, and neighbouring windows share them.

1. Keys of all documents are counted across the corpus. A block of documents sends its distinct keys once, so that a key
   has at most a row a block. Keys that two documents share set a bit of a bitmap; its size follows from their number, up to
   MAX_FILTER_BITS (a full bitmap costs time, never results).
2. Windows whose key's bit is set are fingerprinted in 96 bits. A block sends a fingerprint once, with its least document;
   its other documents are decided on the spot. So a passage in a third of all documents is one row a block. The least
   document of each fingerprint keeps it.
3. Each document with removed windows gets their fingerprints, and drops the words they cover. Other documents stay where
   they are.

A text that a smaller id has too is a copy: it loses all its words (given a window's length) and takes no part in 1 and 2.
What a task holds is a chunk of texts and a block of BLOCK_ROWS rows; counting and settling are Spark's grouping and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.bpe import chunks, digests, ragged, tidy, words_of
from framewright.llm.common import renamed, stored
from framewright.llm.minhash import MAX_BROADCAST_IDS, mix, word_hashes

ROUNDS, PHRASE = 3, 6
#: Bits of the bitmap of shared keys: so many a key, in a power of two within these bounds.
BITS_PER_KEY, MIN_FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 18, 1 << 29
#: A block sends what it holds beyond so many keys or windows.
BLOCK_ROWS = 1_500_000
FAR = 1 << 40
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def recompress(names: np.ndarray, edge: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level (border, low, high): symbol starts, and the half-open words that decide each of them, both ascending.

    ``edge`` has the positions where documents start, and the number of words. What an edge decides is left out: the
    same words elsewhere have other neighbours.
    """
    n = len(names)
    border = np.arange(n + 1)
    low, high = border.copy(), border.copy()
    fixed = np.zeros(n + 1, bool)
    fixed[edge] = True
    levels = [(border[:-1], border[:-1], border[:-1])]  # a word starts where it starts
    for r in range(rounds):
        if len(names) < 2:
            break
        right = (mix(names + np.uint64((r + 1) * int(P2) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        merged = np.zeros(len(border), bool)  # the border before symbol j goes: a run, or a pair (left, right)
        merged[1:-1] = (names[:-1] == names[1:]) | (~right[:-1] & right[1:])
        merged &= ~fixed
        new_low, new_high = low.copy(), high.copy()
        new_low[1:] = np.minimum(low[1:], np.minimum(low[:-1], border[:-1]))
        new_high[:-1] = np.maximum(high[:-1], np.maximum(high[1:], border[1:]))
        new_low[fixed], new_high[fixed] = -FAR, FAR  # elsewhere this border might have gone
        stays = ~merged
        starts = np.nonzero(stays[:-1])[0]
        ends = np.append(starts[1:], len(names))
        first, last = names[starts], names[ends - 1]
        size = ends - starts
        of_first = np.add.reduceat(names == np.repeat(first, size), starts)
        made = mix(first * P1 + last * P2 + mix((of_first * 65_537 + size).astype(np.uint64)))
        names = np.where(size == 1, first, made)
        border, low, high, fixed = border[stays], new_low[stays], new_high[stays], fixed[stays]
        decided = (low > -FAR) & (high < FAR)
        levels.append((border[decided], low[decided], high[decided]))
    return levels


def fold(words: np.ndarray, size: int, factor: np.uint64 = P1) -> np.ndarray:
    """Fingerprints of all runs of ``size`` words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size if n else 0):
        out = out * factor + words[j : j + n]
    return mix(out)


def window_keys(words: np.ndarray, offsets: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each window start, where its key phrase starts."""
    key_at = np.full(len(starts), -1)
    todo = np.arange(len(starts))
    for border, low, high in reversed(recompress(words, offsets)):
        if not len(todo) or not len(border):
            continue
        p = starts[todo]
        k = np.searchsorted(low, p)
        found = k < len(border)
        k = np.minimum(k, len(border) - 1)
        found &= np.maximum(high[k], border[k] + PHRASE) <= p + window
        key_at[todo[found]] = border[k[found]]
        todo = todo[~found]
    return key_at


class _Chunk:
    """Words, windows and keys of one chunk of documents."""

    def __init__(self, texts: pa.Array, window: int):
        distinct, codes, self.offsets = words_of(texts, lower=False)
        self.words = word_hashes(distinct)[codes]
        counts = np.maximum(0, np.diff(self.offsets) - window + 1)
        self.starts = ragged(self.offsets[:-1], counts)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        at = window_keys(self.words, self.offsets, self.starts, window)
        self.keys = fold(self.words, PHRASE)[at] if len(at) else np.zeros(0, np.uint64)


def _fingerprints(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    one, two = fold(words, window), fold(words, window, P2)
    return one[starts], (two[starts] >> np.uint64(32)).astype(np.uint32)


def _keys(docs: DataFrame, window: int) -> DataFrame:
    """(key, documents): a block's distinct keys, with 2 where two of its documents have the key, else 1."""

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, docs_ = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")  # documents of a key stay in order
        keys, docs_ = keys[order], docs_[order]
        at = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        many = docs_[at] != docs_[np.append(at[1:], len(keys)) - 1]
        return pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(1 + many.astype(np.int32))], names=["key", "documents"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, before = [], 0, 0
        for batch in chunks(batches):
            c = _Chunk(batch.column("text"), window)
            fresh = np.ones(len(c.keys), bool)
            fresh[1:] = (c.keys[1:] != c.keys[:-1]) | (c.doc[1:] != c.doc[:-1])
            held.append((c.keys[fresh], c.doc[fresh] + before))
            rows, before = rows + int(fresh.sum()), before + batch.num_rows
            if rows >= BLOCK_ROWS:
                yield send(held)
                held, rows = [], 0
        if rows:
            yield send(held)

    return docs.mapInArrow(tidy(run), "key long, documents int")


def _shared_keys(keys: DataFrame, max_bits: int) -> tuple[int, np.ndarray]:
    """(bits, bitmap): which slots, the low bits of a key, belong to a key that two documents have."""
    shared = stored(keys.groupBy("key").agg(F.sum("documents").alias("documents")).filter("documents > 1").select("key"), "shared")
    bits = max(MIN_FILTER_BITS, min(max_bits, 1 << (BITS_PER_KEY * shared.count()).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    parts = shared.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():  # bits / 32,768 rows of 4 KB
        part = np.frombuffer(row["bitmap"], np.uint8)
        out[(row["bucket"] - 1) * len(part) :][: len(part)] = part
    return bits, out


def _removed_windows(docs: DataFrame, bitmap, bits: int, window: int) -> DataFrame:
    """(doc, prints): for documents with removed windows, the fingerprints (one, two) of these."""
    record = np.dtype([("one", "<i8"), ("two", "<i4"), ("doc", "<i8")])

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        """A block's fingerprints by document, once each; all but the least document of a fingerprint lose it."""
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["doc"], rows["two"], rows["one"]))]
        same = (rows["one"][1:] == rows["one"][:-1]) & (rows["two"][1:] == rows["two"][:-1])
        repeated = np.concatenate([[False], same & (rows["doc"][1:] == rows["doc"][:-1])])
        least = rows["doc"][np.concatenate([[True], ~same])][np.cumsum(np.concatenate([[True], ~same])) - 1]
        gone = (rows["doc"] > least)[~repeated]
        rows = rows[~repeated]
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[c])) for c in record.names), pa.array(gone)], names=[*record.names, "gone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, flags = [], 0, bitmap.value
        for batch in chunks(batches):
            c = _Chunk(batch.column("text"), window)
            slot = (c.keys & np.uint64(bits - 1)).astype(np.int64)
            at = np.nonzero((flags[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)[0]
            if len(at):
                out = np.empty(len(at), record)
                one, two = _fingerprints(c.words, c.starts[at], window)
                out["one"], out["two"] = one.view(np.int64), two.view(np.int32)
                out["doc"] = batch.column("id").to_numpy(zero_copy_only=False)[c.doc[at]]
                held.append(out)
                rows += len(at)
            if rows >= BLOCK_ROWS:
                yield send(held)
                held, rows = [], 0
        if rows:
            yield send(held)

    sent = stored(docs.mapInArrow(tidy(run), "one long, two int, doc long, gone boolean"), "windows")
    least = F.min("doc").over(Window.partitionBy("one", "two"))
    late = sent.filter("not gone").withColumn("least", least).filter("doc > least").select("one", "two", "doc")
    gone = late.unionByName(sent.filter("gone").select("one", "two", "doc"))
    return gone.groupBy("doc").agg(F.collect_list(F.struct("one", "two")).alias("prints"))


RESULTS = {"n_words": "long", "n_removed": "long", "kept": "string", "kept_sha256": "string"}


def substring_dedup(
    docs: DataFrame, window: int = 13, results: tuple[str, ...] = ("n_words", "n_removed", "kept"), id_col: str = "doc_id",
    text_col: str = "text", columns: list[str] | None = None, max_filter_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with ``results``: n_words, n_removed, kept (text) and kept_sha256.

    Words are runs without ASCII white space, unchanged. A word goes if it lies in a window of ``window`` consecutive
    words whose sequence also starts in a document with a smaller id; windows are judged on the input. Kept words are
    joined by single spaces. Null texts have no words. Rows of one id don't remove each other's words, whatever their texts;
    a null id neither removes nor loses any. An empty table gives an empty result; columns named like a result are replaced,
    other names don't matter.
    """
    spark = docs.sparkSession
    if window < PHRASE:
        raise ValueError(f"windows have {PHRASE} words or more")
    carried = [c for c in (docs.columns if columns is None else columns) if c not in results]
    plain, back = renamed(docs, carried, id=docs[id_col].cast("long"), text=F.coalesce(docs[text_col], F.lit("")))
    rows = plain.select("id", "text", F.sha2("text", 256).alias("sha")).filter("id is not null")
    named = rows.select("id", "sha")
    again = named.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("sha", "first")
    copies = stored(named.join(stored(again, "again"), "sha").filter("id > first").select("id", "sha").distinct(), "copies")
    copies = F.broadcast(copies) if copies.count() <= MAX_BROADCAST_IDS else copies
    firsts = rows.join(copies, ["id", "sha"], "left_anti")

    bits, flags = _shared_keys(_keys(firsts, window), max_filter_bits)
    prints = stored(_removed_windows(firsts, spark.sparkContext.broadcast(flags), bits, window), "prints")
    touched = prints.select(F.col("doc").alias("id"))
    marked = plain.withColumn("sha", F.sha2("text", 256)).join(copies.withColumn("copy", F.lit(True)), ["id", "sha"], "left").drop("sha")
    if touched.count() <= MAX_BROADCAST_IDS:  # only these documents are shuffled
        none = F.lit(None).cast(prints.schema["prints"].dataType)
        some = marked.filter("copy is null").join(F.broadcast(touched), "id", "left_semi").join(prints, F.col("id") == prints["doc"])
        rest = marked.filter("copy is null").join(F.broadcast(touched), "id", "left_anti").unionByName(marked.filter("copy"))
        marked = some.drop("doc").unionByName(rest.withColumn("prints", none))
    else:
        marked = marked.join(prints, F.col("id") == prints["doc"], "left")
    marked = marked.select(*back, "text", "prints", "copy")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            distinct, codes, offsets = words_of(batch.column("text"), lower=False)
            words = word_hashes(distinct)[codes]
            keep = np.ones(len(codes), bool)
            copy = pc.fill_null(batch.column("copy"), False).to_numpy(zero_copy_only=False)
            for k, found in enumerate(batch.column("prints")):
                a, b = int(offsets[k]), int(offsets[k + 1])
                if b - a < window:
                    continue
                if copy[k]:
                    keep[a:b] = False
                elif found.is_valid and len(found):
                    one, two = _fingerprints(words[a:b], np.arange(b - a - window + 1), window)
                    hit = np.isin(one.view(np.int64), found.values.field("one").to_numpy()) & np.isin(two.view(np.int32), found.values.field("two").to_numpy())
                    cover = np.cumsum(np.concatenate([hit.astype(int), np.zeros(window, int)]) - np.concatenate([np.zeros(window, int), hit.astype(int)]))
                    keep[a:b] = cover[: b - a] == 0
            ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
            made: dict[str, pa.Array] = {"n_words": pa.array(np.diff(offsets)), "n_removed": pa.array(np.diff(offsets) - np.diff(ends))}
            if {"kept", "kept_sha256"} & {*results}:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.take(distinct.cast(pa.string()), pa.array(codes[keep])))
                made["kept"] = pc.binary_join(lists, " ")
                made["kept_sha256"] = digests(made["kept"])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(carried))] + [made[r] for r in results], names=[*back, *results])

    fields = [f"{k} {kind}" for k, kind in plain.dtypes[: len(carried)]] + [f"{r} {RESULTS[r]}" for r in results]
    out = marked.mapInArrow(tidy(drop), ", ".join(fields))
    return out.select(*[F.col(k).alias(c) for k, c in back.items()], *results)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, 13, ("n_words", "n_removed", "kept_sha256"), columns=["doc_id"])


OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 win AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)),
 least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
 gone AS (SELECT DISTINCT win.doc_id, p + i AS pos FROM win JOIN least ON least.k = win.k AND least.d < win.doc_id, (SELECT unnest(range(13)) AS i)),
 word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
