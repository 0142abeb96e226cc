import random

from skylathe.llm import licenses
from tests.llm.test_decontaminate import slow_words


def shingles(text):
    w = slow_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def slow(docs, templates):
    out = []
    for doc_id, text in docs:
        s, best = shingles(text), {}
        for name, t in templates.items():
            own = shingles(t)
            if own and len(s & own) / len(own) >= 0.8:
                best[name] = len(s & own) / len(own)
        out.append((doc_id, len(best), ",".join(sorted(best)), round(max(best.values()), 6) if best else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(13)
    templates = dict(licenses.TEMPLATES) | {f"long{i}": " ".join(rng.choices([f"t{j}" for j in range(400)], k=n)) for i, n in enumerate([4, 5, 6, 7, 8, 9, 10, 13, 17, 40, 150])}
    docs = []
    for i in range(150):
        text = rng.choices("the of and in house".split(), k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(list(templates.values())).split()
            if len(t) > 30 and rng.random() < 0.5:
                t[rng.randrange(len(t))] = "changed"
            text += t + rng.choices(["x", "y,"], k=rng.randint(0, 9))
        docs.append((i, rng.choice([" ", "\n"]).join(text).upper()))
    docs += [(500, None), (501, ""), (502, "mit"), (503, "Released under the MIT License"), (504, "w " * 30_000 + templates["mit"]), (None, templates["mit"]), docs[3], docs[3]]
    d = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, license string, key int")
    t = spark.createDataFrame([*templates.items(), ("none", None)], "license string, text string")
    assert sorted(map(tuple, licenses.scan(d, t).collect()), key=str) == slow(docs, templates)
    assert licenses.scan(d.limit(0), t).count() == 0
    assert {r.n_licenses for r in licenses.scan(d, t.limit(0)).collect()} == {0}


def test_parts_are_retrieved_as_often_as_stated(spark):
    """Parts of n shingles at random places: those that the bands miss, against the bound."""
    rng, docs, templates, n_parts = random.Random(14), [], {}, 150
    for n in range(5, 9):
        for i in range(n_parts):
            part = [f"t{n}_{i}_{j}" for j in range(n + 4)]
            templates[f"{n}-{i}"] = " ".join(part)
            docs.append((len(docs), " ".join([f"a{rng.randrange(10**9)}" for _ in range(rng.randint(6, 30))] + part + [f"b{rng.randrange(10**9)}" for _ in range(rng.randint(6, 30))])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([*templates.items()], "license string, text string")
    got = {r.license for r in licenses.matches(d, t).select("license").collect()}
    for n in range(5, 9):
        missed = sum(f"{n}-{i}" not in got for i in range(n_parts))
        assert missed <= n_parts * (1 - n / 12) ** licenses.BANDS + 3
