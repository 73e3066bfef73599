import math

import numpy as np

from framewright.llm.caps import ProductCode, near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, class int, cell string, v string"


def brute(rows, cosine=0.98):
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    ok = [r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = []
    for r, o in zip(rows, ok):
        if o:
            v = np.array(r[1], float)
            v = v / np.abs(v).max()
            unit.append(v / np.linalg.norm(v))
        else:
            unit.append(None)
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i))) for i, r in enumerate(rows)), key=str)


def around(rng, centre, spread):
    v = centre + spread * rng.standard_normal(len(centre)) / math.sqrt(len(centre))
    return v


def table(seed=1, dim=24):
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda x: x / np.linalg.norm(x))(rng.standard_normal(dim))
    vectors = []
    for size, spread in [(1, 0.0), (40, 0.05), (60, 0.12), (80, 0.2), (30, 0.25), (5, 0.02), (12, 0.0)]:  # tight, half within reach, apart, equal
        centre = unit()
        vectors += [(around(rng, centre, spread), 1) for _ in range(size)]
    for k in range(80):
        vectors.append((unit() * (1 + k % 3), k % 2))
    chain = unit()
    for _ in range(12):  # each near the one before it
        vectors.append((chain.copy(), 0))
        chain = around(rng, chain, 0.17)
    rng.shuffle(vectors)
    return [(i, [float(x) for x in v], lab, 1, "x", "y") for i, (v, lab) in enumerate(vectors)]


def answers(spark, rows, schema=SCHEMA, **kw):
    got = near_vectors(spark.createDataFrame(rows, schema), **kw).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str)


def test_clumps_chains_and_copies_match_brute_force(spark):
    rows = table()
    want = brute(rows)
    assert answers(spark, rows) == want and max(w[1] for w in want) > 50


def test_odd_rows(spark):
    base = [0.3, -0.4, 0.5, 0.1]
    inf, nan = float("inf"), float("nan")
    vectors = [base, [2 * x for x in base], [-x for x in base], None, [], [0.0] * 4, [-0.0] * 4, [inf, 1.0, 0.0, 0.0], [nan, 1.0, 0.0, 0.0], [None, 1.0, 0.0, 0.0],
               base[:3], [1e200 * x for x in base], [1e-200 * x for x in base], [0.3, -0.4, 0.5, 0.1000001], [1.0], [5.0], [-1.0]]
    rows = [(10 + k, v, 1, 1, "x", "y") for k, v in enumerate(vectors)]
    rows += [(30, base, None, 1, "x", "y"), (31, base, 2, 1, "x", "y"), (10, base, 1, 1, "x", "y"), (10, [1.0, 1.0, 1.0, 1.0], 1, 1, "x", "y"), (9, [1.0, 1.0, 1.0, 1.01], 1, 1, "x", "y"), (None, base, 1, 1, "x", "y"), (None, None, 1, 1, "x", "y")]
    got, want = answers(spark, rows), brute(rows)
    assert got == want
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_many_copies_and_a_near_group(spark):
    rng = np.random.default_rng(2)
    v, w = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(i, [float(x) for x in v], 5) for i in range(400)] + [(400 + i, [float(x) for x in w + 0.01 * rng.standard_normal(16)], 5) for i in range(300)]
    got = answers(spark, rows, "vec_id long, embedding array<float>, label int")
    assert got == sorted([(i, 399, 0) for i in range(400)] + [(400 + i, 299, 400) for i in range(300)], key=str)


def test_random_pairs_at_the_limit_share_a_filter():
    rng = np.random.default_rng(3)
    code = ProductCode(64, 1024)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((4000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z
    (a, fa), (b, fb) = code.filters(x), code.filters(y)
    both = np.intersect1d(a << 32 | fa, b << 32 | fb) >> 32
    assert 12 <= np.bincount(a, minlength=4000).min() and np.bincount(a, minlength=4000).mean() < 40
    assert len(np.unique(both)) >= 3998


def test_real_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in docs.collect()]
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(docs).collect()), key=str) == brute(rows)
