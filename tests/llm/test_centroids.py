import hashlib
import math
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scanframe.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, vector int"


def brute(rows, k=8, rounds=10, dims=64):
    """(vec_id, cluster, distance) per usable row in whole numbers of any size, and the final centroids."""
    kept = [
        (i, [math.floor(Fraction(x) * 1024) for x in v], v) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    c = [list(x) for _, x, _ in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        own = [near(x)[1] for _, x, _ in kept]
        for j in range(len(c)):
            mine = [x for (_, x, _), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(z) // len(mine) for z in zip(*mine, strict=True)]
    return [(i, near(x)[1], near(x)[0]) for i, x, _ in kept], c


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)
    got = ce.cluster_vectors(df, **how).collect()
    want, c = brute(rows, how.get("k", 8), dims=how.get("dims", 64))

    def fits(n):
        return n if n < 2**63 else None

    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    sums = [sum(d for _, o, d in want if o == j) for j in range(len(c))]
    rows_of = [(i, j, fits(d), fits(sums[j]), fits(sum(sums)), digest[j]) for i, j, d in want]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, rows_of))
    return got


def test_against_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(11, 64))
    rows = [(1000 - k, (base[k % 11] + rng.normal(scale=0.4, size=64)).tolist()) for k in range(150)]
    rows += [(7, rows[3][1])] * 60 + [(None, rows[5][1]), (None, rows[9][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None), (2, []), (3, [0.0] * 63), (4, [nan] * 64), (5, [inf] * 64), (6, [None] * 64), (8, [0.0] * 65), (9, [0.0] * 64)]
    assert len(check(spark, rows)) == 213


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(k, [float(x)] + [0.0] * 63) for k, x in enumerate([0, 0, 0, 0, 2, 2, 4, 1, 1, 1, 3])]
    check(spark, rows)
    check(spark, [(k, [1.0, -1.0]) for k in range(20)], k=3, dims=2)  # equal centroids: all but one are empty


def test_few_vectors_and_none(spark):
    check(spark, [(4, [0.25] * 64), (5, [-0.25] * 64)])
    for rows in ([], [(1, None, 1, "x", 2)]):
        got = ce.cluster_vectors(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_any_magnitude_stays_exact(spark):
    rng = np.random.default_rng(5)
    for size in (2.0**16, 2.0**18, 2.0**40, 1e300):
        check(spark, [(k, (rng.normal(size=64) * size).tolist()) for k in range(40)])
    check(spark, [(k, [5e-324 * (k % 3 - 1)] * 64) for k in range(9)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=9), st.lists(
    st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=30))
def test_tournament_equals_comparing_distances(centers, points):
    winner, distance = ce.Bisectors(centers).nearest(np.array(points, np.int64))
    for p, w, d in zip(points, winner.tolist(), distance.tolist(), strict=True):
        assert (d, w) == min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(centers))


def test_pieces_add_up():
    for value in (0, 1, -1, 2**32, -(2**32) - 5, 10**30, -(10**40)):
        assert sum(part << (32 * limb) for limb, part in ce._pieces(value)) == value
