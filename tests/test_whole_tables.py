"""Queries that give a result for every row of their table, not only for a sample of it."""

import numpy as np
import pytest

from skylathe.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table, where, key", [
    ("calibrate_stamps", "embeddings", "label > 1", "vec_id"),
    ("previous_accepted", "orders", "true", "o_orderkey"),
    ("sun_altitude", "orders", "true", "o_orderkey"),
])
def test_every_row_has_a_result(spark, name, table, where, key):
    want = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").filter(where).select(key).collect()}
    assert want and want == {r[0] for r in catalogue.QUERIES[name](spark, FOLDER).select(key).distinct().collect()}


def test_every_stamp_is_calibrated_like_a_plain_loop(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    stack = lambda k: np.median([np.array(r.embedding, float) + 1 for r in rows if r.label == k], axis=0)
    dark, flat = stack(0), stack(1)
    want = {}
    for r in rows:
        if r.label > 1:
            for p in range(64):
                want[r.vec_id, p // 8, p % 8] = ((r.embedding[p] + 1 - dark[p]) / flat[p], bool(flat[p] < 0.5 or flat[p] > 1.5))
    got = {(r.vec_id, r.y, r.x): (r.value, r.doubtful) for r in catalogue.QUERIES["calibrate_stamps"](spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-4 and got[k][1] == want[k][1] for k in want)
