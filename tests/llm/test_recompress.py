import random
import re
from hashlib import sha256

import numpy as np
import pytest

from framewright.llm import recompress as rc
from framewright.llm.recompress import fold, substring_dedup, window_keys


def brute(rows, window):
    """(words, removed, kept text) of each row; windows count by the least id that has them."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in sorted(words):
        for p in range(len(w) - window + 1):
            least.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus():
    rng = random.Random(11)
    vocabulary = ["the", "of", "and"] + [f"w{i}" for i in range(60)]
    passages = [rng.choices(vocabulary, k=n) for n in (12, 13, 14, 20, 60)]
    rows = [(0, None), (1, ""), (2, "a"), (3, " ".join(["x"] * 40)), (4, " ".join(["x"] * 25)), (5, " ".join("xy" * 20)), (6, "é　" * 5 + " b " * 13), (7, "b " * 13)]
    for i in range(8, 90):
        text = []
        for _ in range(rng.randint(1, 4)):
            text += rng.choices(vocabulary, k=rng.choice([0, 3, 30])) + rng.choice(passages) * rng.choice([1, 1, 2])
        rows.append((i, "\n ".join(text)))
    rows += [(90, rows[20][1]), (91, rows[20][1]), (92, "B " * 13)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,block,bits", [(13, 10**6, 1 << 29), (13, 50, 1 << 15), (8, 10**6, 1 << 29)])
def test_against_brute_force(spark, window, block, bits, monkeypatch):
    monkeypatch.setattr(rc, "MIN_FILTER_BITS", 1 << 15)
    monkeypatch.setattr(rc, "BLOCK_ROWS", block)
    rows = corpus()
    want = {r[0]: r[1:] for r in brute(rows, window)}
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = substring_dedup(docs, window, ("n_words", "n_removed", "kept", "kept_sha256"), max_filter_bits=bits).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id
        assert r.kept_sha256 == sha256(r.kept.encode()).hexdigest()
    assert any(r.n_removed for r in got)


def test_null_ids_and_empty_table(spark):
    text = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text + " tail")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_removed, r.kept) for r in substring_dedup(docs).collect())
    assert got == [(0, 0, text), (5, 0, text), (5, 0, text), (9, 20, "tail")]
    assert substring_dedup(docs.limit(0)).count() == 0


def test_repeated_ids_of_different_texts(spark):
    rng = random.Random(2)
    texts = {name: " ".join(f"{name}{rng.randrange(50)}" for _ in range(20)) for name in "VWX"}
    rows = [(1, texts["W"]), (2, texts["W"]), (2, texts["V"]), (3, texts["V"]), (4, texts["X"]), (4, texts["X"] + " tail"), (5, texts["X"] + " tail"), (5, texts["W"] + " " + texts["X"])]
    names = ["id", "sha", "copy", "prints", "c0", "doc"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], ["doc_id", "text", *names])
    got = substring_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(brute(rows, 13))
    assert all(r[n] == n for r in got for n in names)


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "head " + long)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(docs, results=("n_removed",)).collect()) == [(1, 0), (2, 200_000)]


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(5)
    for _ in range(50):
        shared = rng.integers(0, 30, 40).astype(np.uint64)
        found = []
        for _ in range(2):
            before, after = rng.integers(0, 30, rng.integers(0, 20)), rng.integers(0, 30, rng.integers(0, 20))
            words = np.concatenate([before, shared, after]).astype(np.uint64)
            starts = np.arange(len(words) - 12)
            at = window_keys(words, np.array([0, len(words)]), starts, 13)
            assert ((at >= starts) & (at + rc.PHRASE <= starts + 13)).all()
            found.append(fold(words, rc.PHRASE)[at][len(before) : len(before) + 28])
        assert (found[0] == found[1]).all()
