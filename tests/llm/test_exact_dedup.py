from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from framewright.llm.exact_dedup import _flagged, drop_exact_copies, exact_dedup, filter_bit, repeated_bits

ROWS = [(1, "a", 9), (2, "a", 8), (3, None, 7), (4, "", 6), (5, "b" * 100_000, 5), (6, "a ", 4), (None, "a", 3), (None, "z", 2)]


def check(spark, **kw):
    docs = spark.createDataFrame(ROWS * 1, "doc_id long, text string, keep_id int")
    got = {(r.doc_id, r.text): r for r in exact_dedup(docs, **kw).collect()}
    assert len(got) == len(ROWS)
    assert (got[1, "a"].keep_id, got[1, "a"].group_size, got[1, "a"].kept) == (2, 3, False)
    assert got[2, "a"].kept and not got[None, "a"].kept and got[None, "z"].kept
    assert got[3, None].keep_id == 4 and got[4, ""].group_size == 2
    assert got[6, "a "].group_size == 1 and got[6, "a "].kept
    assert got[5, "b" * 100_000].text_sha256 == sha256(b"b" * 100_000).hexdigest()


def test_against_stated_rows(spark):
    check(spark)


def test_smallest_filter_gives_the_same(spark):
    check(spark, max_filter_bits=1)


def test_saturated_filter_is_still_exact(spark):
    docs = spark.createDataFrame([(i, f"t{i % 70000}") for i in range(100_000)], "doc_id long, text string")
    rows = exact_dedup(docs, max_filter_bits=1 << 15).collect()
    assert len(rows) == 100_000
    assert all(r.keep_id == (r.doc_id % 70_000 + 70_000 if r.doc_id % 70_000 < 30_000 else r.doc_id) for r in rows)


def test_filter_holds_just_the_repeated_bits(spark):
    n_bits = 1 << 17
    texts = [f"x{i}" for i in range(6000)] + [f"x{i}" for i in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    of = {r.text: r.bit for r in docs.distinct().select("text", filter_bit(F.col("text"), n_bits).alias("bit")).collect()}
    counts = Counter(of[t] for t in texts)
    bitmaps = repeated_bits(docs, n_bits)
    got = {r.text: r.again for r in _flagged(docs, bitmaps, n_bits).collect()}
    assert got == {t: counts[of[t]] > 1 for t in texts}
    assert 300 <= sum(got.values()) < 700


def test_hot_group_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(300)] + [(1000, "x")], "doc_id long, text string")
    kept = drop_exact_copies(docs)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r.doc_id for r in kept.collect()) == [299, 1000]
    assert exact_dedup(docs.limit(0)).count() == 0


def test_names_of_every_kind_and_repeated_rows(spark):
    names = ["id", "text_", "sha", "bit", "bucket", "bitmap", "again", "keep", "size", "c0", "_text", "_sha", "word"]
    docs = spark.createDataFrame([(1, "a", *names), (1, "a", *names), (2, "b", *names)], ["doc_id", "text", *names])
    rows = sorted(exact_dedup(docs).collect())
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows] == [(1, 1, 2, True), (1, 1, 2, True), (2, 2, 1, True)]
    assert all(r[n] == n for r in rows for n in names)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1, 2), (2, "a", "y", 3, 4)], "doc_id long, text string, _text string, _id int, word int")
    assert [tuple(r) for r in drop_exact_copies(docs).collect()] == [(2, "a", "y", 3, 4)]
