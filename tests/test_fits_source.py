import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylathe.sources import fits, fits_source


@pytest.fixture(scope="module")
def source(spark):
    fits_source.register(spark)
    return spark


@pytest.fixture(scope="module")
def million(source, tmp_path_factory):
    """A table of a million rows in one file, wide ones with a cube in the middle."""
    n, path = 1_000_000, tmp_path_factory.mktemp("m") / "t.fits"
    rows = np.zeros(n, np.dtype([("id", ">i8"), ("x", ">f8"), ("k", ">i2"), ("name", "S4"), ("v", ">f4", (3,))]))
    rows["id"], rows["x"], rows["k"] = np.arange(n), np.arange(n) / 7, np.arange(n) % 100
    rows["x"][::1000], rows["name"], rows["v"] = np.nan, b"ab", np.arange(n)[:, None] % 5
    cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rows.dtype.itemsize, "NAXIS2": n, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 5, "TNULL3": 99, "TZERO3": 0}
    for i, (name, form) in enumerate({"id": "K", "x": "D", "k": "I", "name": "4A", "v": "3E"}.items(), 1):
        cards |= {f"TTYPE{i}": name, f"TFORM{i}": form}
    path.write_bytes(fits_source.summed_unit({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0}, b"") + fits_source.summed_unit(cards, rows.tobytes()))
    return str(path), rows


def test_a_table_is_read_in_ranges(source, million):
    path, rows = million
    df = source.read.format("fits_table").option("split", 1 << 20).load(path)
    assert df.dtypes == [("path", "string"), ("id", "bigint"), ("x", "double"), ("k", "smallint"), ("name", "string"), ("v", "array<float>")]
    assert df.rdd.getNumPartitions() > 30
    got = df.agg(F.count("*"), F.sum("id"), F.count_distinct("id"), F.count("k"), F.sum(F.when(~F.isnan("x"), F.col("x"))), F.sum(F.col("v")[1]), F.min("name")).first()
    n = len(rows)
    assert tuple(got)[:4] == (n, n * (n - 1) // 2, n, n - n // 100)
    assert got[4] == pytest.approx(np.nansum(rows["x"])) and got[5] == 2 * n and got[6] == "ab"


def test_only_wanted_columns_and_rows_are_read(source, tmp_path, monkeypatch):
    wide = np.zeros(300, np.dtype([("a", ">i4"), ("cube", ">f4", (5000,)), ("b", ">i4")]))
    wide["a"], wide["b"] = np.arange(300), np.arange(300) * 2
    cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": wide.dtype.itemsize, "NAXIS2": 300, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 3}
    cards |= {"TTYPE1": "a", "TFORM1": "J", "TTYPE2": "cube", "TFORM2": "5000E", "TTYPE3": "b", "TFORM3": "J"}
    (tmp_path / "w.fits").write_bytes(fits_source.summed_unit({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0}, b"") + fits_source.summed_unit(cards, wide.tobytes()))
    df = source.read.format("fits_table").schema("b int, path string").load(str(tmp_path))
    assert sorted(r[0] for r in df.collect()) == list(range(0, 600, 2))
    from pyspark.sql.types import StructType

    read = []
    plain = fits_source.Ranged.__getitem__
    monkeypatch.setattr(fits_source.Ranged, "__getitem__", lambda self, part: (out := plain(self, part), read.append(len(out)))[0])
    reader = fits_source.FitsTable({"path": str(tmp_path)}).reader(StructType.fromDDL("b int"))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(map(len, batches)) == 300 and sum(read) < 300 * 4 + 6 * 2880


def test_comparisons_are_pushed_into_the_reader(source, million):
    path, rows = million
    df = source.read.format("fits_table").load(path).filter("k = 7 and id >= 500000 and x < 100000").select("id", "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan fits_table" in plan and not any(x in plan for x in (">=", "<", "= 7"))
    keep = (rows["k"] == 7) & (rows["id"] >= 500000) & (rows["x"] < 100000)
    assert sorted(r.id for r in df.collect()) == rows["id"][keep].tolist()
    above = source.read.format("fits_table").load(path).filter("x > 142000").count()
    assert above == int((~(rows["x"] <= 142000)).sum())  # NaN is above all numbers, as everywhere in Spark
    assert source.read.format("fits_table").load(path).filter("k = 99").count() == 0  # 99 stands for null there
    assert source.read.format("fits_table").load(os.path.dirname(path)).filter(F.col("path") == "none").count() == 0


def test_tables_come_back_equal(source, tmp_path):
    rows = source.range(5000).select("id", (F.col("id") % 7).cast("int").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id").cast("short")).alias("s"), (F.col("id") / 3).alias("d"), (F.col("id") % 2 == 0).alias("even"), F.concat(F.lit("n"), "id").alias("name"), F.array(*[(F.col("id") * j).cast("float") for j in range(4)]).alias("v"))
    out = str(tmp_path / "out")
    rows.repartition(6).write.format("fits_table").mode("append").save(out)
    assert len(os.listdir(out)) == 6 and all(n.startswith("part-") for n in os.listdir(out))
    back = source.read.format("fits_table").load(out).drop("path")
    assert back.dtypes == rows.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert all(r.data_ok and r.unit_ok for r in fits.verified(source, out).collect())
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="there already|never replaced"):
            rows.write.format("fits_table").mode(mode).save(out)
    assert back.count() == 5000 and len(os.listdir(out)) == 6


def test_failed_writes_leave_nothing(source, tmp_path):
    out = str(tmp_path / "out")
    bad = source.range(100).repartition(4).select(F.concat(F.lit("f"), "id", F.lit(".fits")).alias("name"), F.lit(2).alias("width"), F.when(F.col("id") == 77, F.array(F.lit(1.0))).otherwise(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0]))).alias("pixels"))
    with pytest.raises(Exception, match="reshape"):
        bad.write.format("fits_image").mode("append").save(out)
    assert not os.path.exists(out) or os.listdir(out) == []
    twice = bad.filter("id != 77").select(F.lit("same.fits").alias("name"), "width", "pixels")
    with pytest.raises(Exception, match="two rows make same.fits"):
        twice.write.format("fits_image").mode("append").save(out)
    assert not os.path.exists(out) or os.listdir(out) == []
    with pytest.raises(Exception, match="can't be a file's name"):
        bad.limit(1).withColumn("name", F.lit("../x.fits")).write.format("fits_image").mode("append").save(out)
    none = bad.filter("id < 0")
    none.write.format("fits_image").mode("append").save(out)


def test_a_killed_job_leaves_no_file(source, tmp_path):
    out, sc = str(tmp_path / "out"), source.sparkContext

    def slow(batches):
        import time

        for batch in batches:
            yield batch
            time.sleep(20)

    rows = source.range(40).repartition(4).select(F.concat(F.lit("g"), "id", F.lit(".fits")).alias("name"), F.lit(1).alias("width"), F.array(F.lit(1.0)).alias("pixels"))
    failed = []

    def run():
        sc.addJobTag("doomed")
        try:
            rows.mapInPandas(slow, rows.schema).write.format("fits_image").mode("append").save(out)
        except Exception as e:
            failed.append(e)

    work = threading.Thread(target=run)
    work.start()
    work.join(8)
    sc.cancelJobsWithTag("doomed")
    sc.cancelAllJobs()
    work.join(60)
    assert failed and [f for _, _, names in os.walk(out) for f in names] == []


def test_images_come_back_equal(source, tmp_path):
    out = str(tmp_path / "out")
    rows = source.range(12).select(F.concat(F.lit("i"), "id", F.lit(".fits")).alias("name"), F.lit(5).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(34)), lambda p: (p + F.col("id")).cast("double")).alias("pixels"), F.create_map(F.lit("OBJECT"), F.concat(F.lit("star "), "id")).alias("cards"))
    rows.write.format("fits_image").mode("append").save(out)
    assert sorted(os.listdir(out)) == sorted(f"i{k}.fits" for k in range(12))
    tiles = source.read.format("fits_image").option("tile", 3).option("split", 2880).load(out)
    got = {}
    for r in tiles.collect():
        image = got.setdefault(os.path.basename(r.path), np.full((7, 5), np.nan))
        image[r.tile_y * 3 : r.tile_y * 3 + r.height, r.tile_x * 3 : r.tile_x * 3 + r.width] = np.reshape(r.pixels, (r.height, r.width))
    assert all((got[f"i{k}.fits"] == np.arange(35).reshape(7, 5) + k).all() for k in range(12))
    heads = fits.read_headers(source, out).select(F.col("header")["OBJECT"].alias("o")).collect()
    assert sorted(r.o for r in heads) == sorted(f"star {k}" for k in range(12))
    assert all(r.data_ok and r.unit_ok for r in fits.verified(source, out).collect())
    with pytest.raises(Exception, match="i3.fits is there already"):
        rows.filter("name = 'i3.fits'").write.format("fits_image").mode("append").save(out)
    rows.filter("name = 'i3.fits'").withColumn("name", F.lit("other.fits")).write.format("fits_image").mode("append").save(out)
    assert len(os.listdir(out)) == 13


def test_checksum_codes():
    rng = np.random.default_rng(6)
    for n in (0, 3, 2880, 5000):
        unit = fits_source.summed_unit({"SIMPLE": True, "BITPIX": 8, "NAXIS": 1, "NAXIS1": n}, rng.bytes(n))
        assert fits.ones_complement(unit) == 0xFFFFFFFF
    for total in (0, 1, 868229149, 0xFFFFFFFF, 0x3A3F4060):
        code = fits_source.checksum_code(total)
        assert len(code) == 16 and code.isalnum()
        turned = code[1:] + code[0]
        assert (fits.ones_complement(turned.encode(), total) - 4 * 0x30303030) % 0xFFFFFFFF == 0
    assert fits_source.checksum_code(868229149) == "hcHjjc9ghcEghc9g"


def test_scaled_and_unsigned_columns(source, tmp_path):
    rows = np.zeros(3, np.dtype([("u", ">i2"), ("t", ">i4")]))
    rows["u"], rows["t"] = [-32768, 0, 32767], [1, 2, 3]
    cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": 6, "NAXIS2": 3, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 2, "TTYPE1": "u", "TFORM1": "I", "TZERO1": 32768, "TTYPE2": "t", "TFORM2": "J", "TSCAL2": 0.5, "TNULL2": 2}
    (tmp_path / "s.fits").write_bytes(fits_source.summed_unit({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0}, b"") + fits_source.summed_unit(cards, rows.tobytes()))
    got = source.read.format("fits_table").load(str(tmp_path)).select("u", "t")
    assert [tuple(r) for r in got.collect()] == [(0.0, 0.5), (32768.0, None), (65535.0, 1.5)]
    assert got.filter("u > 40000 and t > 1").count() == 1
