import random

import xxhash
from pyspark.sql import functions as F

from skylathe.llm import common, simhash


def slow_fingerprint(text):
    words, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\r\x0b\x0c":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    """pairs: (doc_id, fingerprint)"""
    label = {d: d for d, _ in pairs}
    changed = True
    while changed:
        changed = False
        for d, f in pairs:
            for e, g in pairs:
                if (f ^ g).bit_count() <= 2 and label[e] < label[d]:
                    label[d], changed = label[e], True
    return label


TEXTS = ["", None, " \n\t", "One", "one two", "one two three", "One Two Three", "Éa éa ÉA b\x0bc d", "a\x1cb c d e", "w " * 5000, "x\x0cy z " * 7000]


def test_fingerprint_is_that_of_the_plain_version():
    for text in TEXTS:
        assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def test_documents(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = TEXTS + [None, "one two three"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(base))
            base[rng.randrange(len(base))] = rng.choice(words)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t in enumerate(texts)]
    label = slow_components(prints)
    assert got == {i: (f"{f:016x}", label[i]) for i, f in prints}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))


def test_full_buckets_lose_no_link(spark):
    rng = random.Random(2)
    fps = {0, 5}
    base = rng.getrandbits(64)
    while len(fps) < 500:  # one large ball, so that buckets hold more than are paired
        fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(40)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    roots = {r.node % 2**64: r.root for r in simhash.components(simhash.links(df)).collect()}
    label = slow_components(list(enumerate(fps)))
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(label[i], set()).add(f)
    found = {}
    for f, r in roots.items():
        found.setdefault(r, set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_few_keys_of_a_fingerprint_hold_every_link(spark, monkeypatch):
    """Six rows a fingerprint are shuffled, and all pairs within two bits share one of them."""
    rng, made = random.Random(3), []
    fps = {rng.getrandbits(64) for _ in range(20)}
    fps |= {f ^ (1 << a) ^ (1 << b) for f in fps for a, b in [rng.choices(range(64), k=2) for _ in range(10)]}
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in sorted(fps)], "fp long")
    monkeypatch.setattr(simhash, "checkpointed", lambda d: made.append(d.count()) or common.checkpointed(d))
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", 10**6)
    got = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()}
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    assert max(made) <= 6 * len(fps)


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, None)], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).select("doc_id", "component_id").collect()
    assert sorted(rows, key=str) == sorted([(1, 1), (1, 1), (None, 1), (None, 2), (2, 2)], key=str)
    assert simhash.one_of_each(docs).filter(F.col("doc_id").isNotNull()).count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_small_tables_of_many_partitions_become_few(spark):
    table, rows = common.counted(spark.range(0, 60, 1, 97).toDF("a"))
    assert rows == 60 and table.rdd.getNumPartitions() == 1
    assert sorted(r.a for r in table.collect()) == list(range(60))
    assert common.fewer(table, 0).count() == 60
    roots = {r.node: r.root for r in simhash.components(table.selectExpr("a", "a + 1 as b")).collect()}
    assert roots == {i: 0 for i in range(61)}
