"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index keeps, for each term, the items' BM25 weights divided by the item's own score, so that one threshold serves
all items: a passage that holds a whole item scores 1. Item counts, document frequencies and the mean length are those of
all items. Postings are cut into blocks of BLOCK_ITEMS items with the largest weight of each term in each block. As in
block-max WAND a passage is given up where the sum of its terms' maxima is below the threshold, then a block where the sum
of its block maxima is, and only the blocks that are left are opened; numpy adds up the bounds of many passages together
instead of moving one cursor at a time. Candidates above the threshold are verified on word shingles of the item's
question and answer.

Scale: documents aren't shuffled. The index is broadcast while the items have at most ``max_index_bytes`` of text; more
items are dealt into shards of about that size by their ids. A shard is a query set of its own: one more pass over the
documents, with the same scores, and one index in memory at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.bpe import chunks, ragged, tidy, words_of
from framewright.llm.common import stored
from framewright.llm.minhash import MAX_BROADCAST_IDS
from framewright.llm.recompress import fold

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE, WHOLE, PART = 5, 0.8, 0.5
MAX_INDEX_BYTES = 16 << 20
BLOCK_ITEMS = 16
#: Passages whose bounds are added up together.
TOGETHER = 256
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, codes, offsets): lower-case words without the marks around them; words of marks only are left out."""
    words, codes, offsets = words_of(texts, lower=True)
    words = pc.ascii_trim(words, characters=MARKS)
    real = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.zeros(0, bool)
    return words, codes[real], np.concatenate([[0], np.cumsum(real)])[offsets]


@dataclass
class Index:
    """A BM25 index of test items, with block maxima, and their shingles.

    An entry is a term in a block: entries of term t are entry_of[t]:entry_of[t + 1], postings of entry e are posting_of[e]:posting_of[e + 1].
    """

    items: list
    terms: pa.Array
    entry_of: np.ndarray
    entry_block: np.ndarray
    entry_most: np.ndarray
    posting_of: np.ndarray
    posting_item: np.ndarray
    posting_weight: np.ndarray
    term_most: np.ndarray
    shingles: list  # per item: (size, hashes, whether each ends in the answer)


@dataclass
class Statistics:
    """Of all items: how many, their mean length in words, and in how many each term occurs."""

    n: int
    mean: float
    frequency: dict[str, int]


def _answer_start(text: str, n: int) -> int:
    """The first word of the answer: the last sentence, or the last third of a single one."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if terms_of(pa.array([s]))[2][-1]]
    if len(sentences) > 1:
        return n - int(terms_of(pa.array([sentences[-1]]))[2][-1])
    return 2 * n // 3


def statistics(items: list[tuple]) -> Statistics:
    """Of (item_id, text) rows."""
    words, codes, offsets = terms_of(pa.array([t for _, t in items], pa.string()))
    names = words.to_pylist()
    frequency = Counter(t for a, b in zip(offsets, offsets[1:]) for t in {names[c] for c in codes[a:b]})
    return Statistics(len(items), float(np.diff(offsets).mean()) if items else 0.0, frequency)


def build_index(items: list[tuple], of_all: Statistics | None = None) -> Index:
    """The index of (item_id, text) rows, a shard of the items that ``of_all`` describes (default: these rows).

    Items without words are in it, but no passage finds them. Terms are sorted, so that sums don't depend on the shard.
    """
    of_all = of_all or statistics(items)
    texts = ["" if t is None else t for _, t in items]
    words, codes, offsets = terms_of(pa.array(texts, pa.string()))
    names, of_word = np.unique(np.array(words.to_pylist(), object), return_inverse=True) if len(words) else (np.zeros(0, object), np.zeros(0, np.int64))
    seq = of_word.astype(np.int64)[codes]
    n, size = len(items), np.diff(offsets)
    item = np.repeat(np.arange(n), size)
    pair, tf = np.unique(seq * max(1, n) + item, return_counts=True)
    term, item = pair // max(1, n), pair % max(1, n)
    df = np.array([of_all.frequency.get(t, 0) for t in names], float)
    idf = np.log(1 + (of_all.n - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * size[item] / max(1.0, of_all.mean))
    weight = idf[term] * tf * (K1 + 1) / (tf + norm)
    weight = weight / np.bincount(item, weight, minlength=n)[item]
    blocks = -(-n // BLOCK_ITEMS)
    entry, first = np.unique(term * max(1, blocks) + item // BLOCK_ITEMS, return_index=True)
    most = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
    entry_of = np.searchsorted(entry, np.arange(len(names) + 1) * max(1, blocks))
    term_most = np.maximum.reduceat(most, entry_of[:-1][np.diff(entry_of) > 0]) if len(most) else np.zeros(0)
    of_term = np.zeros(len(names))
    of_term[np.diff(entry_of) > 0] = term_most
    shingles = []
    for k in range(n):
        own = seq[offsets[k] : offsets[k + 1]].astype(np.uint64) + np.uint64(1)
        width = min(SHINGLE, len(own))
        if not width:
            shingles.append((0, np.zeros(0, np.uint64), np.zeros(0, bool)))
            continue
        shingles.append((width, fold(own, width), np.arange(width - 1, len(own)) >= _answer_start(texts[k], len(own))))
    return Index(
        [i for i, _ in items], pa.array(names, pa.string()), entry_of, entry % max(1, blocks), most, np.append(first, len(item)), item, weight, of_term, shingles
    )


def find(index: Index, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of all verified leaks."""
    words, codes, offsets = terms_of(texts)
    known = pc.fill_null(pc.index_in(words, value_set=index.terms.cast(words.type)), -1).to_numpy(zero_copy_only=False)
    seq = known[codes].astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    width = len(index.terms)
    pair = np.unique(text[seq >= 0] * width + seq[seq >= 0])
    if not len(pair):
        return
    of, term = pair // width, pair % width
    starts = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0]
    ends = np.append(starts[1:], len(of))
    slack = threshold - 1e-6  # sums of bounds and of weights round differently
    enough = np.add.reduceat(index.term_most[term], starts) >= slack
    starts, ends = starts[enough], ends[enough]
    blocks = int(index.entry_block.max(initial=0)) + 1
    candidates: list[tuple[int, int, float]] = []
    for a in range(0, len(starts), TOGETHER):
        lo, hi = starts[a : a + TOGETHER], ends[a : a + TOGETHER]
        rows = ragged(lo, hi - lo)
        first, count = index.entry_of[term[rows]], index.entry_of[term[rows] + 1] - index.entry_of[term[rows]]
        entry = ragged(first, count)
        place = np.repeat(np.repeat(np.arange(len(lo)), hi - lo), count) * blocks + index.entry_block[entry]
        bound = np.bincount(place, index.entry_most[entry], minlength=len(lo) * blocks)
        opened = bound >= slack
        if not opened.any():
            continue
        left = opened[place]
        entry, place = entry[left], place[left]
        count = index.posting_of[entry + 1] - index.posting_of[entry]
        posting = ragged(index.posting_of[entry], count)
        slot = np.repeat((np.cumsum(opened) - 1)[place], count) * BLOCK_ITEMS + index.posting_item[posting] % BLOCK_ITEMS
        score = np.round(np.bincount(slot, index.posting_weight[posting], minlength=int(opened.sum()) * BLOCK_ITEMS), 9)
        good = np.nonzero(score >= threshold)[0]
        which = np.nonzero(opened)[0][good // BLOCK_ITEMS]
        candidates += zip(of[lo[which // blocks]].tolist(), (which % blocks * BLOCK_ITEMS + good % BLOCK_ITEMS).tolist(), score[good].tolist())
    own: dict[tuple[int, int], np.ndarray] = {}
    for k, item, score in candidates:
        size, hashes, answer = index.shingles[item]
        if (k, size) not in own:
            own[k, size] = fold((seq[offsets[k] : offsets[k + 1]] + 1).astype(np.uint64), size)
        there = np.isin(hashes, own[k, size])
        question, reply = (float(there[part].mean()) if part.any() else 1.0 for part in (~answer, answer))
        if there.mean() >= WHOLE and question >= PART and reply >= PART:
            yield k, item, score, question, reply


def leaks(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): documents that hold an item of ``items`` (item_id, text).

    Words are compared in lower case without the marks around them. A document is found if its BM25 score is at least
    ``threshold`` of the item's own, it has 80 % of the item's five-word shingles (shorter items: their one sequence),
    and half of those of its question and of its answer (the last sentence, or the last third). Null and empty texts
    hold nothing and are in nothing. Repeated documents and items give repeated pairs; ids may be null. Empty tables give
    an empty result; other columns don't matter.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    sets = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    words = sets.mapInArrow(tidy(_words), "n long, terms array<string>")
    n, size = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()
    mean = words.agg(F.avg("n")).first()[0] or 0.0
    frequency = stored(words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "frequency")
    shards = max(1, -(-int(size) // max_index_bytes))
    found = None
    for shard in range(shards):
        part = sets.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        terms = part.mapInArrow(tidy(_words), "n long, terms array<string>").select(F.explode("terms").alias("term")).distinct()
        held = {r["term"]: r["n"] for r in frequency.join(terms, "term").collect()}
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in part.orderBy("item_id", "text").collect()], Statistics(n, mean, held)))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                got = list(find(index.value, batch.column("text"), threshold))
                which = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pc.take(batch.column("id"), which), pa.array([index.value.items[g[1]] for g in got], pa.int64()), *(pa.array([g[c] for g in got], pa.float64()) for c in (2, 3, 4))],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        pairs = rows.mapInArrow(tidy(search), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        if shards == 1:
            return pairs
        pairs = stored(pairs, "leaks")
        index.destroy()
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number of words, distinct terms) of each item."""
    for batch in chunks(batches):
        words, codes, offsets = terms_of(batch.column("text"))
        names = words.to_pylist()
        terms = [sorted({names[c] for c in codes[a:b]}) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets)), pa.array(terms, pa.list_(pa.string()))], names=["n", "terms"])


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns unchanged; rows with a null id stay."""
    leaked = stored(leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    few = leaked.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(leaked) if few else leaked, docs[id_col] == leaked["_leaked"], "left_anti")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
