import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import quality as q
from pyspark.sql import functions as F


def model(texts):
    """Brute force: the probability of the last byte of a gram, interpolated modified Kneser-Ney."""
    counts = {5: Counter()}
    for t in texts:
        b = b"\0\0\0\0" + t.encode()
        counts[5].update(b[i : i + 5] for i in range(len(b) - 4))
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    rule = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = {}
        for i in (1, 2, 3):
            usable = n[1] and n[i] and n[i + 1]
            d[i] = max(min(i - (i + 1) * y * n[i + 1] / n[i], i), 0.05) if usable else 0.5 + 0.25 * i
        of = defaultdict(list)
        for g, v in c.items():
            of[g[:-1]].append(v)
        rule[k] = c, d, of

    def p(g):
        out = 1 / 256
        for k in range(1, 6):
            c, d, of = rule[k]
            part = g[5 - k :]
            if part[:-1] in of:
                values = of[part[:-1]]
                seen = max(c[part] - d[min(3, c[part])], 0) if part in c else 0
                out = seen / sum(values) + sum(d[min(3, v)] for v in values) / sum(values) * out
        return out

    return p


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(["the", "ing", "re", "ou", "é"], k=rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(5, 120))), "en" if i % 3 else "fr") for i in range(200)]
    rows += [(200 + i, "".join(rng.choices("QXZJ#$%", k=200)), "en") for i in range(20)]
    return rows + [(300, None, "en"), (301, "", "fr"), (302, "no model here", "de"), (303, "the", None)]


@pytest.mark.parametrize("limit", [q.MAX_TABLE_ROWS, 0])
def test_against_brute_force(spark, limit):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, trusted string")
    ids = spark.range(150).withColumnRenamed("id", "doc_id")
    held = {r.id for r in spark.range(150).filter(F.pmod(F.xxhash64("id"), F.lit(q.HELD_OUT)) == 0).collect()}
    got = {r.doc_id: r for r in q.quality(docs, ids, max_table_rows=limit).collect()}
    assert len(got) == len(rows)
    models = {lang: model([t for i, t, la in rows if la == lang and i < 150 and i not in held]) for lang in ("en", "fr")}
    for i, text, lang in rows:
        r = got[i]
        if not text:
            assert r.perplexity is None and r.accepted
        elif lang in models:
            b = b"\0\0\0\0" + text.encode()
            want = math.exp(-sum(math.log(models[lang](b[k : k + 5])) for k in range(len(b) - 4)) / (len(b) - 4))
            assert r.perplexity == pytest.approx(want, rel=1e-4)
        else:
            assert r.threshold is None and r.accepted
    limit_en = sorted(got[i].perplexity for i in held if rows[i][2] == "en")
    assert got[1].threshold in limit_en[-2:]
    assert sum(got[i].accepted for i in range(200)) >= 190
    assert not any(got[i].accepted for i in range(200, 220))


def test_dropping_and_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    ids = spark.range(150).withColumnRenamed("id", "doc_id")
    kept = q.drop_rejected(docs, ids)
    assert kept.columns == docs.columns and 190 <= kept.count() <= 204
    assert q.quality(docs.limit(0), ids).count() == 0
    assert q.quality(docs, ids.limit(0)).filter("accepted").count() == docs.count()


def test_grams_of_sliced_columns():
    keys, offsets = q.grams(pa.array(["zzz", "ab", None, "", "é"])[1:])
    assert offsets.tolist() == [0, 2, 2, 2, 4]
    assert keys.tolist() == [0x61, 0x6162, 0xC3, 0xC3A9]


@pytest.mark.parametrize("limit", [q.MAX_TABLE_ROWS, 0])
def test_one_bad_word_in_a_long_text(spark, limit):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(["the", "ing", "re", "ou"], k=rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(20, 400))), "en") for i in range(60)]
    for i in range(10):
        rows.append((100 + i, " ".join([*(word() for _ in range(500)), "xyzzyq", *(word() for _ in range(500))]), "en"))
    rows.append((120, "ab cd", "en"))
    got = {r.doc_id: r for r in q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.range(60).withColumnRenamed("id", "doc_id"), max_table_rows=limit).collect()}
    assert sum(got[100 + i].perplexity <= got[100 + i].threshold for i in range(10)) >= 5  # the mean alone lets them pass
    assert not any(got[100 + i].accepted for i in range(10))
    assert sum(got[i].accepted for i in range(60)) >= 40  # thresholds are the largest of about 12
    assert got[120].peak is None


def test_doc_scores_by_word():
    key, offsets = q.grams(pa.array(["abc de fgh", None, "ab", "z" * 30]))
    logp = -np.arange(len(key), dtype=float)
    perplexity, peak = (x.to_pylist() for x in q.doc_scores(key, offsets, logp))
    assert perplexity == pytest.approx([math.exp(4.5), None, math.exp(10.5), math.exp(26.5)])
    assert peak == pytest.approx([math.exp(1.5), None, None, math.exp(38.5)])  # "fgh" has 3 bytes; 30 bytes are 24 and 6
    assert [len(x) for x in q.doc_scores(*q.grams(pa.array([], pa.string())), np.zeros(0))] == [0, 0]


@pytest.mark.parametrize("limit", [q.MAX_TABLE_ROWS, 0])
def test_repeated_rows_come_back_each(spark, limit):
    rows = [r for r in corpus() if r[0] < 60 or r[0] >= 300]
    times = {r[0]: 1 + (r[0] % 3 == 0) * 2 for r in rows}
    docs = spark.createDataFrame([r for r in rows for _ in range(times[r[0]])] + [(None, "the", "en")] * 2, "doc_id long, text string, lang string")
    got = q.quality(docs, spark.range(50).withColumnRenamed("id", "doc_id"), max_table_rows=limit).collect()
    assert Counter(r.doc_id for r in got) == Counter({**times, None: 2})
    assert len(set(got)) == len(rows) + 1
