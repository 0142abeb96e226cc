import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from skylathe.llm import mixing

WEIGHTS = {"domain": {"a": 2.0, "b": 1.0}, "lang": {"x": 3.0, "z": 0.0}, "source": {"s1": 5.0}}


def fill(given, caps, weights):
    """Shares by weight under caps, shortages shared again until nothing changes."""
    out, open_ = {}, dict(caps)
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k, c in open_.items() if not weights[k] or c <= weights[k] * given / total + 1e-9]
        if not full:
            return out | {k: weights[k] * given / total for k in open_}
        for k in full:
            out[k] = open_.pop(k)
            given -= out[k]
    return out


def slow(rows, share, epochs):
    w = lambda level, v: WEIGHTS[level].get(v, 1.0)
    leaves = defaultdict(int)
    for _, text, *leaf in rows:
        leaves[tuple(leaf)] += len((text or "").split())
    caps = {k: v * epochs * all(w(lv, x) > 0 for lv, x in zip(mixing.LEVELS, k, strict=True)) for k, v in leaves.items()}
    given = {(): min(int(sum(leaves.values()) * share), sum(caps.values()))}
    for depth in (1, 2, 3):
        below = {}
        for node, g in given.items():
            kids = {k[:depth]: 0 for k in caps if k[: depth - 1] == node}
            for k, c in caps.items():
                if k[:depth] in kids:
                    kids[k[:depth]] += c
            below |= fill(g, kids, {k: w(mixing.LEVELS[depth - 1], k[-1]) for k in kids})
        given = below
    out = defaultdict(int)
    for leaf, n in leaves.items():
        budget = int(given[leaf] + 1e-6)
        whole = budget // n if n else 0
        rest = budget - whole * n
        own = [(i, t) for i, t, *x in rows if tuple(x) == leaf]
        places = defaultdict(int)
        of = lambda i: hashlib.md5(f"{mixing.SEED}|{whole}|{'null' if i is None else i}".encode()).hexdigest()  # noqa: E731, B023
        for i, t in own:
            places[of(i)] += len((t or "").split())
        fits, end = 0, ""
        for p in sorted(places):
            fits += places[p]
            if fits > rest:
                break
            end = p
        for i, _ in own:
            out[i] += whole + (of(i) <= end)
    return {i: n for i, n in out.items() if n}


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice("aab"), rng.choice(["x", "x", "y", "z", None]), rng.choice(["s1", "s1", "s2", None])) for i in range(400)]
    rows += [(None, "a b", "a", "x", "s1"), (None, "c", "a", "x", "s1"), rows[7], (900, None, "b", "y", "s9"), (901, "q " * 3000, "b", "x", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string, source string")
    for share, epochs in ((0.3, 1), (0.9, 2), (5.0, 3)):
        taken = mixing.mixture(docs, domain=F.col("dom"), weights=WEIGHTS, share=share, epochs=epochs)
        times = defaultdict(int)
        for r in taken.collect():
            times[r.doc_id] += 1
        assert times == slow(rows, share, epochs)
        assert taken.columns == [*docs.columns, "__domain", "__epoch"]


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "src0", 1, 2)], "doc_id long, text string, lang string, source string, domain int, n int")
    assert mixing.mixture(docs, share=1.0).count() == 1
    assert mixing.mixture(docs.limit(0)).count() == 0
