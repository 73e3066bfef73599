import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framewright.llm.fill_middle import SkipLists, fill_in_middle, original, units_of

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "\n\t ", "one", " one", "one ", "one  two\nthree ", "é ü x \U0001f600 日本 語", "has <P> inside", "a<S>b", "x <M", "<M>", "< P>", "<S", "a <", "P> b",
    "\x00 nul \x00", "a b c", "w " * 5000 + "end", "long" * 3000,
]


def brute(i, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 80 else "psm", len(p), len(m), out


def test_brute_force_with_odd_texts_and_clashing_columns(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], i, "x", "y", "z") for i in range(len(TEXTS) * 12)] + [(7, TEXTS[7], 1, "x", "y", "z")] * 2 + [(None, "a b c d", 1, "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, c0 string, h1 string")
    made = fill_in_middle(docs).withColumn("back", original(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "text", "c0", "h1", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = made.collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["c0"] == "y" and r["h1"] == "z"


def test_descents_reach_every_rank_of_every_list():
    rng = np.random.default_rng(3)
    texts = [" ".join("é" * int(k) for k in rng.integers(1, 9, n)) + end for n, end in [(0, ""), (1, ""), (8, " "), (9, ""), (64, ""), (65, "\n"), (700, ""), (0, "  "), (4000, "")]]
    counts, points = units_of(pa.array(texts))
    units = [UNIT.findall(t) for t in texts]
    assert counts.tolist() == [len(u) for u in units]
    assert points.tolist() == [len(x) for u in units for x in u]
    lists = SkipLists(counts, points)
    assert len(lists.lanes) == 4
    for _ in range(300):
        ranks = rng.integers(0, counts + 1)
        assert lists.reach(ranks).tolist() == [len("".join(u[:r])) for u, r in zip(units, ranks.tolist())]
    assert lists.reach(counts).tolist() == [len(t) for t in texts]


def test_a_slice_of_a_batch_and_nothing_at_all(spark):
    counts, points = units_of(pa.array(["a b", "c d e", ""]).slice(1))
    assert counts.tolist() == [3, 0] and points.tolist() == [1, 2, 2]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(empty).count() == 0
    assert fill_in_middle(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), columns=["doc_id"]).filter("form = 'plain' and n = 0 and output = ''").count() == 2


def test_own_marks_and_rates_and_broken_outputs(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(60)], "doc_id long, text string")
    made = fill_in_middle(docs, rate=100, spm_rate=0, marks=("[pre]", "[suf]", "[mid]")).cache()
    assert {r[0] for r in made.select("form").distinct().collect()} == {"psm"}
    assert made.filter(original(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")) == F.col("text")).count() == 60
    broken = spark.createDataFrame([("<P>a<S>b", "psm"), ("a", "spm"), (None, "plain"), ("a", "other")], "output string, form string")
    assert broken.filter(original(F.col("output"), F.col("form")).isNotNull()).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"wörd{i}" for i in range(400_000))
    got = fill_in_middle(spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string"), rate=100).collect()
    assert all((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_all(r["doc_id"], text) for r in got)


def brute_all(i, text):
    digest = hashlib.sha256(f"42:{i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 80
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
