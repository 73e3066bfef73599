"""Near-duplicate detection by min-max hashing, with links confirmed on full shingle sets.

Each of PERMUTATIONS hash evaluations of a set keeps its minimum and its maximum: both agree between two sets with the
probability of their Jaccard similarity, so a signature has twice as many values as evaluations. Bands of ROWS values
make bucket keys; at a similarity of 0.8 a pair shares none of the BANDS buckets with a probability of 2e-5.

Documents with equal sets are one class, numbered by itself: ids may repeat with different texts. Of the classes in a
bucket the one that meets most others is the pivot; the others are compared with it on full sets. Components follow from
the confirmed links. A bucket that still holds several components is open. Its members aren't paired by bucket, as texts
of one template may be very many there and linked with nothing: they meet on their rare shingles. Under one order of all
shingles, rarest first, two sets with ``percent`` of their union in common share one of the first n - ceil(percent n) + 1
of each, with enough others to follow, so no link is lost, and what a template's texts have in common comes last and makes
no pair. The order is that
of counts in SLOTS counters, which needn't be exact: any order that all tasks share keeps the rule. Within a rare shingle,
members of the largest component are never paired with each other. A parity sketch of 1,024 bits tells most other pairs
apart before full sets are compared: two sketches never differ in more bits than the sets do in shingles.

Scale: signatures are made where the text is read; buckets shuffle 64-bit keys; full sets are made for candidates only.
Hot classes and buckets are pre-aggregated and joined by broadcast; a set that very many pairs need is salted.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.bpe import chunks, tidy, words_of
from framewright.llm.common import HOT_SHARE, join_groups, stored
from framewright.llm.components import components

ROWS, BANDS = 6, 36
PERMUTATIONS = ROWS * BANDS // 2
#: Up to so many candidate ids are broadcast to pick their texts (16 bytes each); beyond it they are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
SKETCH_WORDS = 16
#: Counters of the shingles' order, a power of two: at most 8 MB on the driver and in each task, at every size.
SLOTS = 1 << 20
_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_BAND = _RANDOM.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_SALT = _RANDOM.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; empty without words."""
    distinct, codes, offsets = words_of(texts, lower=True)
    words = word_hashes(distinct)[codes]
    n = len(words) - k + 1
    fold = np.zeros(max(0, n), np.uint64)
    for j in range(k if n > 0 else 0):
        fold = fold * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    fold = mix(fold)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            part = np.sort(fold[a : b - k + 1])
            yield part[np.concatenate([[True], part[1:] != part[:-1]])]
        elif b > a:
            one = np.full(1, b - a, np.uint64)  # shorter than a shingle: the sequence itself, told apart by its length
            for j in range(a, b):
                one = mix(one * np.uint64(0xD6E8FEB86659FD93) + words[j : j + 1])
            yield one
        else:
            yield np.empty(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, (1 << 32) - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 1024):
        h = x[at : at + 1024, None] * _A + _B
        np.minimum(low, h.min(0), out=low)
        np.maximum(high, h.max(0), out=high)
    values = np.concatenate([low, high]).astype(np.uint64).reshape(BANDS, ROWS)
    return mix((mix(values + _SALT[:, None]) * _BAND).sum(1, dtype=np.uint64) + _SALT)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS integers; each shingle flips one bit. Sketches differ in at most as many bits as the sets in shingles."""
    odd = np.bincount((shingles & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """(id, mark, n_shingles, set_key, bands, sketch) of rows (id, mark, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sizes, keys, bands, sketches = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                keys.append(_set_key(s))
                bands.append(band_keys(s).view(np.int64) if len(s) else None)
                sketches.append(parity_sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "mark", "n_shingles", "set_key", "bands", "sketch"],
            )

    return docs.mapInArrow(tidy(sign), "id long, mark long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def _set_key(shingles: np.ndarray) -> bytes | None:
    return blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = list(shingle_sets(batch.column("text"), k))
            keys = pa.array([_set_key(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_key", "shingles"])

    return docs.mapInArrow(tidy(make), "set_key binary, shingles array<long>")


def _with_set(pairs: DataFrame, sets: DataFrame, key: str, name: str, limit: int) -> DataFrame:
    """``pairs`` with the set of node ``key``. A node in more than ``limit`` pairs meets them in several copies of its set."""
    sizes = pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / limit).alias("copies")).filter("copies > 1")
    hot = F.broadcast(sizes)  # at most as many as there are pairs / limit: HOT_SHARE
    salted = pairs.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1)))).drop("copies")
    copies = sets.select(F.col("node").alias(key), F.col("shingles").alias(name)).join(hot, key, "left")
    copies = copies.select(key, name, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)).cast("long") - 1)).alias("salt"))
    return salted.join(copies, [key, "salt"]).drop("salt")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` percent in common. Both sides are stored tables."""
    limit = max(1_000, pairs.count() // HOT_SHARE)
    both = _with_set(_with_set(pairs, sets, "a", "sa", limit), sets, "b", "sb", limit)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            shingles = batch.column("shingles").flatten().to_numpy(zero_copy_only=False)
            np.add.at(counts, shingles & (SLOTS - 1), 1)
        at = np.flatnonzero(counts)
        for start in range(0, len(at), 100_000):
            part = at[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["slot", "n"])

    table = sets.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    return counts


def rare_prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The n - ceil(percent n) + 1 rarest shingles of a set, in the order of their counters, then of the shingles."""
    n = len(shingles)
    order = np.lexsort((shingles, counts[shingles & (SLOTS - 1)]))
    return shingles[order[: n + (-percent * n) // 100 + 1]]


def _rare(sets: DataFrame, percent: int) -> DataFrame:
    """(rare, place, node, n, component) for the rare shingles of sets (node, n, component, shingles), places from 0."""
    counts = sets.sparkSession.sparkContext.broadcast(_slot_counts(sets))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rare = rare_prefix(batch.column("shingles")[i].values.to_numpy(), counts.value, percent)
                same = lambda c: pa.array(np.full(len(rare), batch.column(c)[i].as_py(), np.int64))  # noqa: B023, E731
                place = pa.array(np.arange(len(rare), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rare), place, same("node"), same("n"), same("component")], names=["rare", "place", "node", "n", "component"])

    return sets.select("node", "n", "component", "shingles").mapInArrow(make, "rare long, place long, node long, n long, component long")


def _unsettled(open_sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes of different components that share a rare shingle and may have ``percent`` percent in common.

    A pair comes once for each shared rare shingle after which enough others may follow in both sets.
    """
    rare = stored(_rare(open_sets, percent), "rare")
    shares = rare.groupBy("rare", "component").agg(F.count(F.lit(1)).alias("share"))
    split = shares.groupBy("rare").agg(F.max(F.struct("share", "component")).alias("top"), F.sum("share").alias("size"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    split = stored(split.select("rare", "size", F.col("top")["component"].alias("major")), "split")
    met = join_groups(rare, split, "rare", "size", rare.count())
    met = stored(met.join(open_sets.select("node", "sketch"), "node"), "met")
    other = met.filter("component <> major").select("rare", *[F.col(c).alias(f"{c}2") for c in ("place", "node", "n", "component", "sketch")])
    fits = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    follow = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    enough = (100 + percent) * follow >= percent * (F.col("n") + F.col("n2"))
    differ = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    near = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("n2"))
    # a pair of two others is met from both sides
    once = (F.col("component") == F.col("major")) | (F.col("node") < F.col("node2"))
    pairs = met.join(other, "rare").filter((F.col("component") != F.col("component2")) & once & fits & enough & near)
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _placed(docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, n_shingles, component) per row of ``docs``; mark is a hash of the text."""
    text = docs[text_col]
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    signed = stored(_signed(rows, shingle_words), "signed")
    filled = signed.filter("set_key is not null and id is not null")
    total = max(1, signed.count())
    classes = filled.groupBy("set_key").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed once written
    shared = classes.select("node", "n", F.explode("bands").alias("bucket"))
    crowded = stored(shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "crowded")
    n_shared = total * BANDS
    members = stored(join_groups(shared, crowded, "bucket", "members", n_shared), "members")
    degrees = members.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = stored(members.join(degrees, "node"), "ranked")
    pivots = stored(
        ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node", "n")).alias("top"), F.count(F.lit(1)).alias("many"))
        .select("bucket", F.col("top")["node"].alias("pivot"), F.col("top")["n"].alias("pivot_n"), "many"),
        "pivots",
    )
    starred = join_groups(ranked.select("bucket", "node", "n"), pivots, "bucket", "many", n_shared)
    fits = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    tried = starred.filter("node <> pivot").filter(fits).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    tried = stored(tried.distinct(), "pairs")
    wanted = stored(classes.join(ranked.select("node").distinct(), "node", "left_semi").select("node", "set_key", F.col("rep").alias("id")), "wanted")
    few = wanted.count() <= MAX_BROADCAST_IDS
    wanted_ids = wanted.select("id").distinct()
    sets = _sets(rows.join(F.broadcast(wanted_ids) if few else wanted_ids, "id", "left_semi"), shingle_words)
    sets = stored(sets.join(wanted.select("node", "set_key"), "set_key").select("node", "shingles").dropDuplicates(["node"]), "sets")
    links = stored(_confirmed(tried, sets, percent), "links")
    found = stored(components(links), "components")
    # candidate pairs that the pivots did not settle: in one bucket, in different components, not compared yet
    placed = stored(
        ranked.filter("members > 2").select("bucket", "node", "n", "members").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed"
    )
    split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many"))
    split = stored(split.filter("low < high").select("bucket", "many"), "split")
    open_ = stored(join_groups(placed, split, "bucket", "many", n_shared).select("node", "n", "component").distinct(), "open")
    open_sets = stored(open_.join(sets, "node").join(classes.select("node", "sketch"), "node"), "open-sets")
    rest = _unsettled(open_sets, percent).distinct().join(tried, ["a", "b"], "left_anti")
    more = stored(_confirmed(stored(rest, "rest"), sets, percent), "links")
    if not more.isEmpty():
        found = stored(components(links.union(more)), "components")
    joined = stored(found.join(classes.select("node", "rep"), "node"), "joined")
    least = joined.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("size"))
    reached = join_groups(joined.select("node", "component"), stored(least, "least"), "component", "size", total)
    named = classes.select("set_key", "node", "rep", "size").join(reached.select("node", "least"), "node", "left")
    named = stored(named.select("set_key", "size", F.coalesce("least", "rep").alias("component")), "named")
    alone = signed.filter("set_key is null or id is null").select("id", "mark", "n_shingles", F.col("id").alias("component"))
    together = join_groups(filled.select("id", "mark", "n_shingles", "set_key"), named, "set_key", "size", total)
    return alone.unionByName(together.select("id", "mark", "n_shingles", "component"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Letters A-Z are lower-cased, words are runs without ASCII white space; a document's set has its distinct shingles of
    ``shingle_words`` words (the whole sequence where it is shorter). Sets with at least ``percent`` percent of their
    union in common are linked; component_id is the least id reachable. A text without words (or null) has an empty set
    and is linked with nothing, as is a row with a null id (component_id null). Rows repeated with the same id give
    repeated results, and rows with one id and different texts are compared each for itself; other columns don't matter;
    an empty table gives an empty result.
    """
    placed = _placed(docs, shingle_words, percent, id_col, text_col)
    kept = F.col("id").eqNullSafe(F.col("component"))
    return placed.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that aren't the least id of their component; columns unchanged; null ids stay.

    Of rows with one id and different texts, those go whose own text is linked with a lesser id.
    """
    placed = _placed(docs, shingle_words, percent, id_col, text_col)
    dropped = stored(placed.filter("id <> component").select(F.col("id").alias("_dropped"), F.col("mark").alias("_mark")).distinct(), "dropped")
    few = dropped.count() <= MAX_BROADCAST_IDS
    same = (docs[id_col].cast("long") == dropped["_dropped"]) & (F.xxhash64(docs[text_col]) == dropped["_mark"])
    return docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti")


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle_words=2, percent=80)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS k FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * m >= 80 * (nx.n + ny.n - m)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
 g AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN g ON g.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
