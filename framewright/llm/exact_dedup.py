"""Exact dedup by two passes over a Bloom filter of text hashes.

Pass one hashes every text to one filter bit and keeps only the bits that two rows or more set, as bitmaps of 32,768 bits.
Pass two tests every row against them: a row whose bit nobody else set is unique and passes straight through. The other
rows alone are shuffled, by SHA-256 of the text (ids and digests, never texts), and grouped exactly; a false positive of
the filter only costs a shuffled row. Everything is built-in SQL functions.

Scale: the filter has BITS_PER_ROW bits a row, in a power of two, up to MAX_FILTER_BITS (64 MB, which bounds the
broadcast). One hash function suffices at these sizes: up to 16 million rows at most 3 % of the unique rows shuffle, and a
second function would double what pass one shuffles, a bit number a row. With more rows than the largest filter has room
for, more unique rows shuffle their digests, half of them at 370 million. Groups holding a large share of all rows are
pre-aggregated and joined back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import join_groups, renamed, stored

BITS_PER_ROW = 32
MAX_FILTER_BITS = 1 << 29


def filter_bit(text: Column, n_bits: int) -> Column:
    """The filter bit of a text, from 1."""
    return F.pmod(F.xxhash64(text), F.lit(n_bits)) + 1


def repeated_bits(texts: DataFrame, n_bits: int) -> DataFrame:
    """(bucket long, bitmap binary): the filter bits that two or more rows set. ``texts`` has the one column text."""
    bits = texts.groupBy(filter_bit(F.col("text"), n_bits).alias("bit")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def _flagged(rows: DataFrame, bitmaps: DataFrame, n_bits: int) -> DataFrame:
    """``rows`` (with column text) plus again: true where the row's filter bit was set twice."""
    bit = filter_bit(F.col("text"), n_bits)
    marked = rows.withColumn("bit", bit).withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(bitmaps), "bucket", "left")
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    return marked.withColumn("again", F.coalesce(hit, F.lit(False))).drop("bit", "bucket", "bitmap")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW,
    max_filter_bits: int = MAX_FILTER_BITS, columns: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` (``columns`` of it, all by default) with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after no change; null counts as empty, so null and empty texts are one group. Of
    equal texts the largest id stays. Rows repeated with the same id all count in group_size and share one verdict; a
    null id never beats another and is kept only in a group of null ids. An empty table gives an empty result. Columns
    of ``docs`` named like the results are replaced by them; other names don't matter.
    """
    carried = [c for c in (docs.columns if columns is None else columns) if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    plain, back = renamed(docs, carried, id=docs[id_col], text=F.coalesce(docs[text_col], F.lit("")))
    total = docs.count()
    n_bits = max(1 << 15, min(max_filter_bits, 1 << (total * bits_per_row).bit_length()))
    bitmaps = stored(repeated_bits(plain.select("text"), n_bits), "bloom")
    rows = _flagged(plain, bitmaps, n_bits).withColumn("sha", F.sha2("text", 256)).drop("text")
    alone = rows.filter("not again").select(*back, "id", "sha", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"))
    again = rows.filter("again").drop("again")
    groups = stored(again.groupBy("sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size")), "groups")
    grouped = join_groups(again, groups, "sha", "size", total).select(*back, "id", "sha", "keep", "size")
    return alone.unionByName(grouped).select(
        *[F.col(k).alias(c) for k, c in back.items()], F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text a row with a larger id repeats; columns unchanged."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {name: f"c{k}" for k, name in enumerate(names)}
    return exact_dedup(plain, at[id_col], at[text_col]).filter("kept").select(
        *[F.col(f"c{k}").alias(name) for k, name in enumerate(names)]
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, columns=["doc_id"])


OP9_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""
