import numpy as np

from scanframe.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, copies string, tile int"


def brute(rows, cosine):
    n, up = len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    count = [0] * n
    for i in range(n):
        for j in range(i):
            (_, x, lx), (_, y, ly) = rows[i], rows[j]
            if lx is None or lx != ly or not x or not y or len(x) != len(y):
                continue
            x, y = np.array(x, float), np.array(y, float)
            if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
                continue
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                count[i] += 1
                count[j] += 1
                a, b = find(i), find(j)
                if rows[a][0] > rows[b][0]:
                    a, b = b, a
                up[b] = a
    return {rows[i][0]: (count[i], rows[find(i)][0]) for i in range(n)}


def test_against_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 16)).astype(np.float32)
    rows = []
    for k in range(240):
        v = base[k % 25] + rng.normal(scale=[0, 0.05, 0.2, 0.35][k % 4], size=16).astype(np.float32)
        rows.append((1000 - k, [float(np.float32(x)) for x in v * (1 + k % 3)], None if k % 41 == 0 else k % 2))
    none, nan, inf = None, float("nan"), float("inf")
    rows += [(1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [nan] * 16, 1), (5, [inf] * 16, 1), (6, [none] * 16, 1), (7, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    want = brute([(i, None if v is None or any(x is None for x in v) else v, l) for i, v, l in rows], 0.98)
    got = ed.near_vectors(df, tile=20).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_bound_never_hides_a_link():
    rng = np.random.default_rng(1)
    for dims in (3, 64, 1500):
        x = rng.normal(size=(60, dims))
        y = np.concatenate([x[:30] + rng.normal(scale=0.2, size=(30, dims)), rng.normal(size=(30, dims))])
        x, y = (z / np.linalg.norm(z, axis=1)[:, None] for z in (x, y))
        below = ed.doubtless_below(ed.quantised(x), ed.quantised(y), 0.98)
        assert not (below & (x @ y.T >= 0.98)).any()
        assert below.mean() > 0.9


def test_extreme_lengths_and_empty_table(spark):
    v = [[1e-30, 2e-30], [1e30, 2e30], [2.0, 1.0]]
    df = spark.createDataFrame([(k, x, 1, "x", 0) for k, x in enumerate(v)], SCHEMA)
    assert sorted((r["vec_id"], r["component_id"]) for r in ed.near_vectors(df).collect()) == [(0, 0), (1, 0), (2, 2)]
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
