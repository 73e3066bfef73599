import functools
import math
import random
import re
import string
from collections import Counter

import pyarrow as pa
import pytest

from framewright.llm.decontaminate import build_index, drop_leaks, find, leaks


@functools.cache
def words(text):
    return [w for w in (x.strip(string.punctuation) for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) if w]


def brute(docs, items):
    """Pairs with 80 % of the item's shingles; retrieval and parts may only leave out less."""
    out, own_words, sets = set(), {d: words(t) for d, t in docs}, {}
    for i, item in items:
        w = words(item)
        k = min(5, len(w))
        if not k:
            continue
        want = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        for d, own in own_words.items():
            if (d, k) not in sets:
                sets[d, k] = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
            have = sets[d, k]
            if sum(s in have for s in want) >= 0.8 * len(want):
                out.add((d, i))
    return out


def corpus():
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "to"] * 20 + [f"term{i}" for i in range(3000)]
    items = [(i, ". ".join(" ".join(rng.choices(vocabulary, k=rng.choice([6, 9, 20]))).capitalize() for _ in range(rng.choice([1, 2, 3]))) + ".") for i in range(150)]
    items += [(150, None), (151, ""), (152, "two words"), (153, items[3][1]), (154, "..."), (155, "of the")]
    docs = []
    for d in range(300):
        text = rng.choices(vocabulary, k=rng.choice([5, 50, 3000]))
        if d % 3 == 0:
            leak = rng.choice(items[:150])[1]
            if d % 2:
                leak = leak.upper().replace(".", " !")
            if d % 5 == 0:  # a damaged copy: one word in the middle of a long item
                w = leak.split()
                w[len(w) // 2] = "damaged"
                leak = " ".join(w)
            at = rng.randrange(len(text))
            text[at:at] = ["(" + leak + ")"]
        docs.append((d, " ".join(text)))
    return docs + [(300, None), (301, ""), (302, "Two words!"), (303, "the of the")], items


def test_against_brute_force(spark):
    docs, items = corpus()
    got = leaks(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 60
    assert all(r.score >= 0.5 and r.question_overlap >= 0.5 and r.answer_overlap >= 0.5 for r in got)


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_shards_find_the_same(spark, threshold):
    docs, items = corpus()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(leaks(a, b, threshold).collect())
    assert len(whole) > 40
    assert sorted(leaks(a, b, threshold, max_index_bytes=9000).collect()) == whole


def test_scores_against_plain_bm25():
    docs, items = corpus()
    n, sizes = len(items), [len(words(t)) for _, t in items]
    mean, df = sum(sizes) / n, Counter(w for _, t in items for w in set(words(t)))

    def weights(text, size):
        tf = Counter(words(text))
        return {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * size / mean)) for w, c in tf.items()}

    of_item = [weights(t, s) for (_, t), s in zip(items, sizes)]
    seen = 0
    for k, i, score, *_ in find(build_index(items), pa.array([t for _, t in docs]), 0.5):
        own = set(words(docs[k][1]))
        assert score == pytest.approx(sum(v for w, v in of_item[i].items() if w in own) / sum(of_item[i].values()), abs=1e-8)
        seen += 1
    assert seen > 60


def test_dropping(spark):
    docs, items = corpus()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    kept = drop_leaks(a, b)
    assert kept.columns == a.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in brute(docs, items)}


def test_null_ids_repeated_rows_and_long_texts(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(None, item), (1, item), (1, item), (2, "x " * 400_000 + item), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in leaks(docs, items).collect())
    assert got == {(None, 7): 2, (None, None): 1, (1, 7): 4, (1, None): 2, (2, 7): 2, (2, None): 1}


def test_block_bounds_lose_nothing():
    docs, items = corpus()
    index = build_index(items)
    texts = pa.array([t for _, t in docs])
    assert {(k, i) for k, i, *_ in find(index, texts, 0.5)} == {(k, i) for k, i, *_ in find(index, texts, 0.0001)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaks(docs, items).count() == 1
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
