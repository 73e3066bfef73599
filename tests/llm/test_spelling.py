import random
import re
import zlib
from collections import Counter

from framewright.llm.spelling import document_words, spelling_variants, trie_nodes
from pyspark.sql import functions as F


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    by_length, form, out = {}, {}, {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w, n in words.items():
        own = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form[w], None, n, len(own), words[best] if form[w] is not None else None]
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def check(spark, words, parts=None):
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(rows).collect()}
    assert got == brute(words)


def test_random_words_over_a_small_alphabet(spark):
    rng = random.Random(4)
    words = {}
    for _ in range(700):  # many neighbours, runs of equal letters, beginnings and endings that are words
        words["".join(rng.choices("abÿ", k=rng.randint(0, 7)))] = rng.choice([1, 1, 2, 9, 10, 30, 100, 100, 1000, 20000])
    check(spark, words)


def test_chains_ties_and_edges(spark):
    check(spark, {"colours": 10_000, "colour": 1000, "color": 100, "colr": 10, "clr": 1, "abab": 10, "abac": 10, "abad": 1, "": 3, "z": 30, "zz": 300, "aaaa": 5, "aaa": 50, "aa": 500, "日本語": 4, "日本": 40})


def test_many_ranges_share_beginnings(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(400)})
    rows = spark.createDataFrame([(w,) for w in words], "word string").repartition(5)
    got = trie_nodes(rows, "word", 23).collect()
    number = {}
    for r in got:
        assert len(r["nodes"]) == len(r["word"]) + 1
        for k, node in enumerate(r["nodes"]):
            assert number.setdefault(r["word"][:k], node) == node  # one number a beginning
    assert len(set(number.values())) == len(number)  # one beginning a number
    ends = [r["nodes"][-1] for r in sorted(got, key=lambda r: r["word"])]
    assert ends == sorted(ends)


def test_words_of_documents(spark):
    texts = ["Prefixing PREFIXING prefixing x", "straße-Straßenbahn ÀÉÎõü×÷ÿÀÉÎõü", "sixlet sevenle eightlet", None, "", "naïveté" * 3, "a1b" * 9, "Ωabcdefgh", "İstanbulda"]
    rows = [(i, t) for i, t in enumerate(texts * 40)] + [(1, texts[1])] * 3
    want = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = {r["word"]: r["n"] for r in document_words(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")).collect()}
    assert got == want


def test_nothing_nulls_repeats_and_a_very_long_word(spark):
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert document_words(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
    long = "ab" * 60_000
    rows = [(None, 5), ("letters", 3), ("letters", 4), ("leters", None), (long, 1), (long + "c", 20), (long[:-1], 2)]
    got = {r["word"]: r for r in spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got) == {"letters", "leters", long, long + "c", long[:-1]}
    assert got["letters"]["n"] == 7 and got["leters"]["form"] == "letters"
    assert got[long]["form"] == long + "c" and got[long]["n_near"] == 2 and got[long[:-1]]["n_near"] == 1


def test_whole_query_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = document_words(docs).filter("n >= 2")
    pairs = {r["word"]: r["n"] for r in words.collect()}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(words).collect()}
    assert got == brute(pairs) and any(v[0] for v in got.values())
    assert words.filter(F.length("word") < 7).isEmpty()
