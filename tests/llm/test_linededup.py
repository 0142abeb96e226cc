import random

import pytest
from pyspark.sql import functions as F

from skylathe.llm import linededup


def shingles(line):
    w = line.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def slow(docs):
    """docs: (doc_id, text) in the order that counts."""
    seen, out = [], []
    for doc_id, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            s = shingles(line)
            if s and any(9 * len(s & t) >= 4 * (len(s) + len(t)) for t in seen):
                seen.append(s)
                continue
            if s:
                seen.append(s)
            kept.append(line)
        out.append((doc_id, None if text is None else "\n".join(kept)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"W{i}" for i in range(60)]
    pool = [rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 7, 12, 30, 60])) for _ in range(60)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(pool)) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(0, 40))
            for _ in range(rng.choice([0, 0, 1, 2])):
                if line:
                    line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "\t"]).join(line))
        docs.append((i, "\n".join(lines)))
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, docs[0][1]), (204, "a b c d e\r\nA  b c d E"), (205, "z " * 40_000 + "\n" + " ".join(f"v{i}" for i in range(30_000)))]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, h string, n int")
    out = linededup.without_later_lines(table)
    assert out.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(slow(docs))


def test_links_are_those_of_the_plain_join(spark):
    rng = random.Random(12)
    base = [f"t{i}" for i in range(25)]
    texts = set()
    for _ in range(150):  # one crowd of near copies
        line = list(base)
        for _ in range(rng.randint(0, 2)):
            line[rng.randrange(25)] = f"x{rng.randrange(9)}"
        texts.add(" ".join(line))
    docs = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    _, classes, links = linededup.classes_and_links(docs)
    doc = {r.k: r["first"].doc_id for r in classes.collect()}
    got = {(doc[r.earlier], doc[r.later]) for r in links.collect()}
    sets = list(enumerate(map(shingles, sorted(texts))))
    assert got == {(a, b) for a, s in sets for b, t in sets if a < b and 9 * len(s & t) >= 4 * (len(s) + len(t))}


def test_repeated_null_and_no_rows(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(1, line), (1, line), (None, line + " seven"), (2, line + "\nx")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in linededup.without_later_lines(docs).collect()), key=str)
    assert got == sorted([(1, line), (1, line), (None, line + " seven"), (2, "x")], key=str)
    assert linededup.report(docs.limit(0)).count() == 0
    assert linededup.report(docs.withColumn("n_lines", F.lit(1))).count() == 4


@pytest.mark.parametrize("n", range(1, 60))
def test_prefix_bound(n):
    assert (4 * n + 4) // 5 == -(-4 * n // 5)


def test_tokens_in_many_prefixes_go_last(spark, monkeypatch):
    """Many lines around one passage, few of them alike, with the bound for common tokens low."""
    monkeypatch.setattr(linededup, "COMMON", 5)
    rng = random.Random(17)
    passage, docs = [f"P{i}" for i in range(12)], []
    for i in range(150):
        own = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([0, 1, 3, 8, 20]))]
        docs.append((i, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
    docs += [(200 + i, docs[i][1] + " more") for i in range(0, 150, 3)]
    got = linededup.without_later_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(slow(docs))


def test_long_lines_of_one_passage_are_not_all_verified(spark, monkeypatch):
    """Lines of 360 words that have a third in common share a common part of their tokens; few need their words."""
    rng, asked = random.Random(23), []
    passage = [f"P{i}" for i in range(120)]
    own = [[f"w{rng.randrange(10**6)}" for _ in range(240)] for _ in range(30)]
    docs = [(i, " ".join(passage + w)) for i, w in enumerate(own)] + [(100, " ".join(passage + own[0][:-1]))]
    lines_of = linededup._Join._lines_of
    monkeypatch.setattr(linededup._Join, "_lines_of", lambda self, keys: asked.append(keys.count()) or lines_of(self, keys))
    got = linededup.without_later_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(slow(docs))
    assert sum(asked) < 10


def test_words_are_as_rare_in_upper_case(spark):
    docs = spark.createDataFrame([(i, f"COMMON word{i} Common w{i}") for i in range(50)], "doc_id long, text string")
    ranks = linededup.rarity(docs)
    of = F.get(ranks, linededup._of_word(F.xxhash64(F.lit("common"))).cast("int"))
    assert spark.range(1).select(of == F.array_max(ranks)).first()[0]


def test_hashes_are_made_once_a_line(spark, monkeypatch):
    """A crowd around one line: its hashes aren't made for every pair that it is in."""
    asked, hashes = [], linededup._hashes
    monkeypatch.setattr(linededup, "_hashes", lambda line: asked.append(line) or hashes(line))
    base = [f"b{i}" for i in range(40)]
    docs = [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(20)]
    got = linededup.without_later_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(slow(docs))
    assert set(asked) == {"line"}
