import random

import pytest

import corpus_pipeline
from skylathe.llm import linededup
from tests.llm.test_linededup import shingles
from tests.llm.test_simhash import slow_fingerprint


def slow_kept(docs):
    """The doc_ids that stay of docs (doc_id, text) in the order of doc_id."""
    sets = [shingles((t or "").replace("\n", " ")) for _, t in docs]
    prints = [slow_fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if (prints[a] ^ prints[b]).bit_count() <= 2 or (s and t and 9 * len(s & t) >= 4 * (len(s) + len(t))):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return [d for k, (d, _) in enumerate(docs) if label[k] == k]


@pytest.mark.parametrize("long_set", [1000, 20])
def test_edited_copies_go(spark, monkeypatch, long_set):
    monkeypatch.setattr(linededup, "_LONG_SET", long_set)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(900, None), (901, ""), (902, "one two three"), (903, "One two\nthree")]
    for i in range(12):
        base = rng.choices(words, k=rng.choice([30, 90, 150]))
        for j in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(j):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((10 * i + j, rng.choice([" ", "\n"]).join(text)))
            if j % 2:
                base = text  # chains: the ends of a group may be too far apart to match
    docs.sort()
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string")
    want = slow_kept(docs)
    out = corpus_pipeline.near_duplicate_stage(spark, table, "")
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_duplicate_stage(spark, empty, "").count() == 0
