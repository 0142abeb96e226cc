import random

import corpus_pipeline
from skylathe.llm import mixing
from tests.llm import test_decontaminate, test_linededup, test_mixing, test_simhash


def test_stages_against_plain_versions(spark, tmp_path, monkeypatch):
    rng = random.Random(21)
    calm = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    pool = [" ".join(rng.choices(calm, k=60)) for _ in range(6)]
    bench = [(i, " ".join(rng.choices(calm, k=14))) for i in range(5)]
    for i in range(260):
        lines = [" ".join(rng.choices(calm, k=rng.randint(5, 40))) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.3:
            lines.append(rng.choice(pool))
        if rng.random() < 0.1:
            lines.append(rng.choice(bench)[1])
        toxic = rng.random() < 0.25
        if toxic:
            lines[0] += " you stupid idiot"
        docs.append((i, "\n".join(lines), rng.choice(["en", "de"]), f"src{rng.randrange(14)}"))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1] + " again", *docs[i][2:]) for i in range(12)] + [(2000, None, "en", "src1"), (2001, "", None, None)]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now.collect())
        assert k == 4 or now.columns == columns
    calmly = [r for r in docs if "idiot" not in (r[1] or "")]
    assert sorted(r.doc_id for r in seen[0]) == sorted(r[0] for r in calmly)
    lines = test_linededup.slow([(d, t) for d, t, *_ in sorted(calmly)])
    assert sorted((r.doc_id, r.text) for r in seen[1]) == sorted(lines)
    label = test_simhash.slow_components([(d, test_simhash.slow_fingerprint(t)) for d, t in lines])
    single = [(d, t) for d, t in lines if label[d] == d]
    assert sorted(r.doc_id for r in seen[2]) == sorted(d for d, _ in single)
    clean = [d for d, *_, bad in test_decontaminate.slow(single, bench) if not bad]
    assert sorted(r.doc_id for r in seen[3]) == sorted(clean)
    leaf = {d: (s, g) for d, _, s, g in docs}
    domain = lambda g: "other" if g is None else "web" if int(g[3:]) < 10 else "books"
    rows = [(d, t, domain(leaf[d][1]), *leaf[d]) for d, t in single if d in set(clean)]
    monkeypatch.setattr(test_mixing, "WEIGHTS", mixing.WEIGHTS)
    times = {}
    for r in seen[4]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == test_mixing.slow(rows, mixing.SHARE, mixing.EPOCHS)


def test_run_gives_what_the_stages_give(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "domain", "epoch"]
    assert 0 < out.count()


KIND = "doc_id long, text string, lang string, source string, n_chars long, domain string, epoch int, `a.b` int"


def _odd(spark, rows):
    return spark.createDataFrame(rows, KIND)


def test_every_stage_takes_odd_tables(spark, tmp_path):
    """Null and repeated ids, null texts, repeated rows and clashing or dotted columns; then no rows at all."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "A quiet day by the sea.\nNothing more.", "en", "src1", 9, "d", 7, 1), (1, "Another text under the same number", "en", "src1", 9, "d", 7, 1), (None, long, None, None, None, None, None, None), (None, "words of no number", "en", "src12", 1, "x", 1, 2), (3, None, "en", "src1", 0, "d", 7, 3), (4, "", "en", "src1", 0, "d", 7, 4), (5, long + " end", "en", "src1", 0, "d", 7, 5)]
    rows += [rows[1]] * 2
    folder = tmp_path / "sf"
    spark.createDataFrame([(1, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "benchmark text of ten words that stands in no document here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for case in (rows, []):
        docs = _odd(spark, case)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(folder))
            out.write.parquet(f"{tmp_path}/{len(case)}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{len(case)}/{k}")
            if name != "mixing":
                assert set(docs.columns) == set(KIND.replace("`", "").replace(",", "").split()[::2])
        assert {"doc_id", "text", "domain", "epoch", "a.b"} <= set(docs.columns)
        if not case:
            assert docs.count() == 0
