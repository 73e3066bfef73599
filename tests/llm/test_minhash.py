import random
import re

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm.components import components
from framewright.llm.minhash import SLOTS, _unsettled, band_keys, drop_near_duplicates, near_duplicates, parity_sketch, rare_prefix, shingle_sets


def brute(rows, k, percent=80):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(7)
    words = ["w%d" % i for i in range(300)]
    rows, n = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two"), (5, "One  two\n"), (6, "two one")], 7
    base = [rng.choices(words, k=rng.choice([30, 80, 300])) for _ in range(12)]
    for text in base:
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(text)
            for _ in range(int(len(copy) * rng.choice([0, 0.02, 0.05, 0.08, 0.12]))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    chain = rng.choices(words, k=120)  # each step is near the one before it, the ends are not near
    for _ in range(15):
        rows.append((n, " ".join(chain)))
        n += 1
        chain = chain[6:] + rng.choices(words, k=6)
    rng.shuffle(rows)
    return rows


def check(spark, k):
    rows = corpus()
    want = brute(rows, k)
    got = near_duplicates(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rep int, bucket string"), k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_two_word_shingles_against_brute_force(spark):
    check(spark, 2)


def test_hub_of_near_copies_and_null_ids(spark):
    rng = random.Random(9)
    base = ["v%d" % i for i in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        copy = list(base)
        for j in rng.sample(range(200), 8):
            copy[j] = f"x{i}_{j}"
        rows.append((i, " ".join(copy)))
    want = brute(rows, 2)
    docs = spark.createDataFrame(rows + [(None, " ".join(base)), (None, None)], "doc_id long, text string")
    got = near_duplicates(docs, 2).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: c for i, (_, c) in want.items()}
    assert sum(r.doc_id is None and r.component_id is None for r in got) == 2
    kept = drop_near_duplicates(docs, 2)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in want.values()}) + 2


@pytest.mark.parametrize("local", [40, 10**6])
def test_components_of_a_long_path_and_a_star(spark, local):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), local).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(1000, 1100)}}


def test_min_and_max_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(3)
    same = []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        same.append((band_keys(np.sort(x[:110])) == band_keys(np.sort(x[10:]))).mean())
    assert abs(np.mean(same) - (100 / 120) ** 6) < 0.03
    assert [len(s) for s in shingle_sets(pa.array(["a b a b a", None, "a"]), 2)] == [2, 0, 1]


def test_very_long_text_and_clashing_names(spark):
    long = " ".join(f"t{i}" for i in range(150_000))
    docs = spark.createDataFrame([(3, long, "x"), (2, long + " end", "y"), (1, None, "z"), (2, long + " end", "y")], "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, 5).collect())
    assert got == [(1, 0, 1), (2, 149_997, 2), (2, 149_997, 2), (3, 149_996, 2)]
    assert sorted(r.component_id for r in drop_near_duplicates(docs, 5).collect()) == ["y", "y", "z"]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(8)
    for n in (1, 50, 400, 5000):
        x = rng.integers(0, 1 << 63, n + 60, dtype=np.uint64)
        a, b = x[:n], x[60 : n + 60] if n > 60 else x[1 : n + 1]
        bits = sum(int(v).bit_count() for v in (parity_sketch(a) ^ parity_sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def edited(words, at, tag):
    return " ".join(f"{tag}{i}" if i in at else w for i, w in enumerate(words))


def test_one_id_with_different_texts(spark):
    a, b = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, edited(b, {3}, "x")), (3, edited(a, {9}, "y")), (4, "by itself")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_two_texts_of_one_id_link_by_their_own_words_only(spark):
    a, b = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, edited(b, {3}, "x")), (7, edited(a, {9}, "y"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs, 2).collect()) == [(2, 2), (5, 2), (5, 5), (7, 5)]
    assert sorted((r.doc_id, r.text) for r in drop_near_duplicates(docs, 2).collect()) == sorted([rows[2], rows[0]])


def test_template_family_makes_few_pairs(spark):
    rng = random.Random(21)
    base = [f"t{i}" for i in range(140)]
    rows = [(i, " ".join(base + [f"own{i}_{j}" for j in range(50)])) for i in range(2_000)]
    near = rng.sample(range(2_000), 40)
    rows += [(2_000 + i, rows[i][1] + f" tail{i}") for i in near]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 2).collect()}
    assert got == {i: i - 2_000 if i >= 2_000 else i for i, _ in rows}
    sets = [(i, s) for (i, _), s in zip(rows, shingle_sets(pa.array([t for _, t in rows]), 2))]
    table = spark.createDataFrame([(i, len(s), i, s.view(np.int64).tolist(), parity_sketch(s).tolist()) for i, s in sets], "node long, n long, component long, shingles array<long>, sketch array<long>")
    assert _unsettled(table, 80).count() <= 20 * len(rows)


def test_rare_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 9, 10, 100):
        counts = rng.integers(0, 9, SLOTS)
        for cut in range(n):
            x = np.unique(rng.integers(0, 1 << 62, 2 * n, dtype=np.int64))
            a, b = x[:n], x[cut : n + cut]
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                assert len(np.intersect1d(rare_prefix(a, counts, 80), rare_prefix(b, counts, 80)))
