import hashlib
import math

import numpy as np

from skylathe.llm.drake import Bounds, clustered, distances

KIND = "vec_id long, embedding array<double>, cluster int, `n.v` int, own string"


def _plain(rows, k=16, times=3, size=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, q, strict=True)), e) for e, q in enumerate(c))
    for _ in range(times):
        of = [(near(v)[1], v) for _, v in kept]
        c = [[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := [v for a, v in of if a == e]) else q for e, q in enumerate(c)]
    found = [(i, *near(v)) for i, v in kept]
    total = {e: sum(d for _, d, a in found if a == e) for _, _, e in found}
    return sorted(repr((i, e, d, total[e], sum(total.values()), hashlib.sha256(",".join(map(str, c[e])).encode()).hexdigest())) for i, d, e in found)


def test_bounds_hold_and_certify_the_nearest_centroid():
    rng = np.random.default_rng(1)
    for spread, k, b in [(2, 6, 2), (50, 16, 4), (1000, 9, 3), (3, 2, 1), (5, 1, 0)]:
        v, c = rng.integers(-spread, spread + 1, (400, 3)), rng.integers(-spread, spread + 1, (k, 3))
        bounds = Bounds.measured(v, c, b)
        looked = []
        for turn in range(6):
            d = distances(v, c)
            assert (bounds.own == d.argmin(axis=1)).all()
            root = np.sqrt(d)
            assert (root[np.arange(400), bounds.own] <= bounds.upper).all()
            assert (np.take_along_axis(root, bounds.ids, axis=1) >= bounds.lower).all()
            others = np.ones(d.shape, bool)
            np.put_along_axis(others, np.concatenate([bounds.own[:, None], bounds.ids], axis=1), False, axis=1)
            assert (np.where(others, root, np.inf).min(axis=1, initial=np.inf) >= bounds.rest).all()
            new = c + rng.integers(-1, 2, c.shape) * (turn % 3)
            by = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + 1e-9)
            b = max(min(b, 1), b - turn // 3)
            bounds, depth = bounds.moved(v, new, by, b)
            c = new
            looked.append((depth < 0).mean())
        assert spread < 50 or max(looked) > 0.5


def test_distances_are_exact_for_large_components():
    v, c = np.array([[1 << 26, -(1 << 26)]]), np.array([[-(1 << 26), (1 << 26) - 1]])
    assert distances(v, c).tolist() == [[(1 << 27) ** 2 + ((1 << 27) - 1) ** 2]]


def test_clusters_equal_the_plain_rounds(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.2, (20, 64))
    rows = [(i, [float(x) for x in centres[rng.integers(0, 20)] + rng.normal(0, 0.05, 64)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [rows[3], rows[3], (None, rows[4][1]), (5, rows[9][1])]
    odd = [(2000, None), (2001, [0.0] * 63), (2002, [0.0] * 63 + [None]), (2003, [float("inf")] + [0.0] * 63), (2004, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + odd], KIND).repartition(5)
    got = clustered(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == _plain(rows)


def test_few_vectors_and_odd_tables(spark):
    empty = clustered(spark.createDataFrame([], KIND))
    assert empty.count() == 0 and len(empty.columns) == 6
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64), (3, [0.25] * 64)]
    few = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in [*rows, (9, [1e300] * 64)]], KIND)
    got = sorted((tuple(r) for r in clustered(few).collect()), key=lambda r: r[0])
    assert got[-1] == (9, None, None, None, None, None)
    assert [repr(r) for r in got[:3]] == _plain(rows)
    one = spark.createDataFrame([(i, [0.5] * 64, 1, 2, "x") for i in range(4)], KIND)
    assert {r["distance"] for r in clustered(one, centroids=1).collect()} == {0}
