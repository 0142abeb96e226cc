import hashlib
import math

import numpy as np
import pytest

from skylathe.llm import quantize
from skylathe.llm.quantize import Tree

KIND = "vec_id long, embedding array<float>, label int, row string, `a.b` int, code string"


def _plain(rows, entries=256, times=4):
    """The contract, one vector after another."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // 4
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(v, k) for _, v, _ in kept[:entries]] for k in range(4)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), e) for e, q in enumerate(book))
    for _ in range(times):
        for k in range(4):
            of = [(near(cut(v, k), books[k])[1], cut(v, k)) for _, v, _ in kept]
            for e in {e for e, _ in of}:
                own = [p for x, p in of if x == e]
                books[k][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, total = [], {}
    for i, v, lab in kept:
        found = [near(cut(v, k), books[k]) for k in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
        total[lab] = total.get(lab, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for q in book for x in q).encode()).hexdigest()
    return sorted((repr(x) for x in ((i, c, e, total[lab], digest) for i, c, e, lab in out)))


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_tree_gives_the_nearest_entry_and_the_lower_of_equal_ones(spread):
    rng = np.random.default_rng(spread)
    for n in (1, 15, 33, 500):
        points = rng.integers(-spread, spread + 1, (n, 4))
        points[: n // 3] = points[0]
        book = np.concatenate([points[rng.integers(0, n, 20)], rng.integers(-spread, spread + 1, (20, 4))])
        tree = Tree.unpacked(Tree.over(points).packed(), 4)
        d = ((points[:, None] - book) ** 2).sum(axis=2)
        code, error = tree.codes(book)
        assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
        counts, sums = np.zeros(40, int), np.zeros((40, 4), int)
        tree.sums_by_entry(book, counts, sums)
        assert (counts == np.bincount(code, minlength=40)).all()
        assert all((sums[e] == points[code == e].sum(axis=0)).all() for e in range(40))


def test_equal_vectors_go_as_one_subtree():
    tree = Tree.over(np.full((1000, 2), 7))
    assert [(a, b, code, node) for a, b, code, node in tree.nearest(np.array([[9, 9], [7, 7], [7, 7]]))] == [(0, 1000, 1, 0)]


def test_codes_equal_the_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(quantize, "BLOCK", 64)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.01, 8)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(500 + i, rows[0][1], 1) for i in range(40)] + [rows[5], rows[5], (None, rows[6][1], None), (7, rows[8][1], None)]
    rows += [(900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [float("nan")] + [0.0] * 7, 2), (903, [float("-inf")] + [0.0] * 7, 2)]
    df = spark.createDataFrame([(i, v, lab, "x", 1, "y") for i, v, lab in rows], KIND)
    for entries in (256, 5):
        got = quantize.compressed(df.repartition(3), entries=entries)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == _plain(rows, entries)


def test_odd_tables(spark):
    empty = quantize.compressed(spark.createDataFrame([], KIND))
    assert empty.count() == 0 and len(empty.columns) == 5
    odd = spark.createDataFrame([(2, [1.0] * 4, 1, "", 1, ""), (3, [1.0] * 8, 1, "", 1, ""), (4, [], 2, "", 1, ""), (5, [1e30] * 4, 2, "", 1, ""), (6, [1.0] * 3, None, "", 1, "")], KIND)
    told = {r["vec_id"]: tuple(r)[1:4] for r in quantize.compressed(odd).collect()}
    assert told == {2: ("00000000", 0, 0), 3: (None, None, 0), 4: (None, None, None), 5: (None, None, None), 6: (None, None, None)}
