import random

import duckdb

import corpus_pipeline
from skylathe.llm import linededup
from tests.llm import test_linededup


def made(n):
    rng = random.Random(31)
    vocabulary = [f"W{i}" for i in range(12)]
    pool = [rng.choices(vocabulary, k=k) for k in (1, 1, 2, 3, 4, 4, 5, 6, 12, 30) for _ in range(3)]
    return [(i, "\n".join(rng.choice([" ", "\t"]).join(rng.choice(pool) if rng.random() < 0.7 else rng.choices(vocabulary, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 6)))) for i in range(n)]


def test_short_copies_go(spark):
    docs = made(80) + [(200, None), (201, ""), (202, "\n\n"), (203, "a b\na b c\nA  b\nb a")]
    want = test_linededup.slow(docs)
    assert want[-1][1] == "a b\na b c\nb a"
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = corpus_pipeline.line_stage(spark, table, "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == want


def test_report_is_its_sql(spark, tmp_path):
    table = spark.createDataFrame(made(50) + [(200, None)], "doc_id long, text string")
    table.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"select doc_id, n_lines, n_removed, kept_sha256 from ({linededup.SQL})").fetchall()
    assert sum(r[2] for r in want) > 20
    assert sorted(tuple(r) for r in linededup.report(table).collect()) == sorted(want)
