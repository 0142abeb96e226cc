import random
import zlib

import numpy as np

from skylathe.llm import language

VOICES = {"aa": "the of and ring with house water stone", "bb": "der und schloß zeit über ung keit straße", "cc": "été où leçon dans avec eau mère très"}


def voice(rng, name, n):
    return " ".join(rng.choices(VOICES[name].split(), k=n))


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, want = rng.integers(97, 103, (5, 9)), np.array([0, 1, 2, 1, 0])
    weight = (rng.random((5, 9)) < 0.8).astype(np.float32)
    _, g = net.gradients(data, want, weight)
    for k, v in net.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 40)]:
            if k == "x" and not 97 <= at[1] < 103:
                continue
            old, e = v[at], 1e-2
            v[at] = old + e
            up, _ = net.gradients(data, want, weight)
            v[at] = old - e
            down, _ = net.gradients(data, want, weight)
            v[at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3, (k, at)


def test_pooling_is_that_of_window_by_window():
    rng = random.Random(1)
    net = language.Network(list(VOICES))
    texts = [b"", b"a", *(voice(rng, "bb", n).encode() for n in (3, 18, 40, 900))]
    got = language.pooled(net, texts)
    inner, fold = language.WINDOW - 2 * language.WARM, language._fold()
    for t, p in zip(texts, got, strict=True):
        sums = np.zeros(3)
        for a in range(0, len(t), inner):
            cells = [fold[t[i]] if 0 <= i < len(t) else 32 for i in range(a - language.WARM, a + inner + language.WARM)]
            probs = net.labels(np.array([cells]))[language.WARM : language.WARM + min(inner, len(t) - a), 0]
            sums += probs.sum(axis=0)
        # blanks behind a text may be the next text's first bytes only beyond WARM
        assert np.allclose(p, sums / max(1, len(t)), atol=1e-5)


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, voice(rng, n := rng.choice(list(VOICES)), rng.choice([4, 30, 400])), n, 0.5) for i in range(400)]
    rows += [(1000, None, "aa", 1.0), (1001, "", "bb", 1.0), (1002, "12 34 ... ###", "cc", 1.0), (1003, rows[0][1], None, 1.0), (None, rows[0][1], "aa", 1.0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = language.predictions(docs).collect()
    assert len(out) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert len(held) > 50 and sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.95 * len(held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.predictions(docs).first().lang_pred == "und"
    assert language.predictions(docs.limit(0)).count() == 0


def test_every_language_is_learnt_from(spark):
    docs = [(i, f"text of {i}", f"l{i % 90:02d}") for i in range(1800)] + [(9000, "rare words", "rare"), (9001, "rare words", "rare"), (9002, "rare words", "rare"), (9003, "rare words", "rare")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for rows in (400, 2):
        got = language.sample(table, "lang", "doc_id", "text", rows)
        assert {n for n, _ in got} == {x[2] for x in docs}
    assert len(got) < 500
