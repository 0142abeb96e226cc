import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylathe.sources import archives, fits, text
from skylathe.streaming import frames


def block(data: bytes) -> bytes:
    return data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def table_file() -> bytes:
    forms = {"FLAG": "L", "B": "B", "I": "I", "J": "J", "K": "K", "NAME": "6A", "E": "2E", "D": "D"}
    kind = np.dtype([("a", "u1"), ("b", "u1"), ("c", ">i2"), ("d", ">i4"), ("e", ">i8"), ("f", "S6"), ("g", ">f4", (2,)), ("h", ">f8")])
    rows = np.array([(84, 200, -3, 1 << 20, 1 << 40, b"ab", (1.5, 2.5), np.nan), (70, 0, 5, -1, -1, b"long-x", (0, -1), 2.0**-40)], kind)
    cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": kind.itemsize, "NAXIS2": 2, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 8}
    for i, (name, form) in enumerate(forms.items(), 1):
        cards |= {f"TTYPE{i}": name, f"TFORM{i}": form}
    first = fits.written_header({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "OBJECT": "it's / here", "PERIOD": 2.915})
    return first + fits.written_header(cards) + block(rows.tobytes())


def test_cards():
    value = lambda text: fits.card_value(f"{'KEY':<8}= {text}".ljust(80))
    assert [value(t) for t in ("'it''s'  / note", "'a / b'", "T", "F / no", "", "42 / n", "-1.5", "1.5D+03", "'x   '")] == ["it's", "a / b", True, False, None, 42, -1.5, 1500.0, "x"]


def test_tables_and_headers(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(table_file())
    (tmp_path / "b.fits").write_bytes(table_file())
    heads = fits.read_headers(spark, str(tmp_path)).collect()
    assert len(heads) == 4 and {h.header.get("OBJECT") for h in heads} == {"it's / here", None}
    rows = fits.read_table(spark, str(tmp_path)).drop("path").collect()
    assert len(rows) == 4
    one, two = sorted({tuple(map(str, r)): r for r in rows}.values(), key=lambda r: r.I)
    assert tuple(one)[:7] == (True, 200, -3, 1 << 20, 1 << 40, "ab", [1.5, 2.5]) and (one.D is None or one.D != one.D)
    assert tuple(two) == (False, 0, 5, -1, -1, "long-x", [0.0, -1.0], 2.0**-40)
    assert fits.read_table(spark, str(tmp_path), wanted=["K", "NAME"]).columns == ["path", "K", "NAME"]


def test_cut_files_fail():
    with pytest.raises(EOFError):
        list(fits.headers(table_file()[:3000]))
    with pytest.raises(EOFError):
        list(fits.headers(table_file()[:5800]))


@pytest.mark.parametrize(("bits", "kind"), [(8, "u1"), (16, ">i2"), (32, ">i4"), (64, ">i8"), (-32, ">f4"), (-64, ">f8")])
def test_images(spark, tmp_path, bits, kind):
    image = np.arange(35).reshape(5, 7)
    head = fits.written_header({"SIMPLE": True, "BITPIX": bits, "NAXIS": 2, "NAXIS1": 7, "NAXIS2": 5, "BZERO": 10, "BSCALE": 2})
    (tmp_path / "i.fits").write_bytes(head + block(image.astype(kind).tobytes()))
    out = np.zeros((5, 7))
    for r in fits.read_image(spark, str(tmp_path), tile=4).collect():
        out[r.tile_y * 4 : r.tile_y * 4 + r.height, r.tile_x * 4 : r.tile_x * 4 + r.width] = np.reshape(r.pixels, (r.height, r.width))
    assert (out == image * 2 + 10).all()


def test_image_sink_round_trip(spark, tmp_path):
    data = spark.createDataFrame([([float(i) for i in range(12)], 4)], "p array<double>, w int").select(fits.image_file("p", "w")).first()[0]
    (tmp_path / "o.fits").write_bytes(bytes(data))
    assert fits.read_image(spark, str(tmp_path)).first().pixels == [float(i) for i in range(12)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"columns": ["a", "b"],\n "values": ["1", "0:15"]}')
    assert text.read_records(spark, str(tmp_path / "r.json")).first().record == {"a": "1", "b": "0:15"}
    (tmp_path / "bad.json").write_text('{"columns": ["a", "a"], "values": ["1", "2"]}')
    with pytest.raises(Exception, match="pair up"):
        text.read_records(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "v.txt").write_text("# minimum sector: 14\n# maximum sector: 86\n 77  0101 2 1\n\nshort row\n")
    data, notes = text.read_commented(spark, str(tmp_path / "v.txt"), ["target", "vector", "made", "done"], ["minimum sector", "maximum sector"])
    assert [tuple(r)[1:] for r in data.collect()] == [("77", "0101", "2", "1")]
    assert sorted(r.value for r in notes.collect()) == [14.0, 86.0]
    (tmp_path / "x.xml").write_text('<dv:r xmlns:dv="u"><dv:t dv:id="3"><dv:depth>3.2</dv:depth></dv:t></dv:r>')
    got = text.read_report(spark, str(tmp_path / "x.xml"), "dv:t", "`_dv:id` int, `dv:depth` double").first()
    assert tuple(got) == (3, 3.2)
    df = spark.createDataFrame([(1, 1 / 3)], "k int, v double")
    text.write_fixed(df, str(tmp_path / "out"), {"v": 8})
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().v == "0.33333333"
    cfg = spark.createDataFrame([("a=1\r\nab=2\r\n",)], "c string")
    assert cfg.select(text.rewritten(F.col("c"), {"a": "9"})).first()[0] == "a=9\r\nab=2\r\n"
    with pytest.raises(Exception, match="exactly once"):
        cfg.select(text.rewritten(F.col("c"), {"z": "9"})).collect()


def test_streams_give_what_tables_give(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).alias("s"), F.timestamp_seconds(F.col("id") * 4000 + F.when(F.col("id") > 100, 90_000).otherwise(0)).alias("ts"), F.col("id").cast("double").alias("v"))
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    for n, make in enumerate([lambda d: frames.time_bins(d, "ts", ["s"], "v", late="90 days"), lambda d: frames.sessions(d, "ts", ["s"], late="90 days")]):
        stream = frames.arriving(spark, f"{tmp_path}/in", rows.schema, files_a_batch=2)
        frames.run_once(make(stream), f"{tmp_path}/out{n}", f"{tmp_path}/state{n}")
        got, want = spark.read.parquet(f"{tmp_path}/out{n}").collect(), make(rows).collect()
        assert len(want) > 3 and sorted(map(str, got)) == sorted(map(str, want))


def test_data_sums(spark, tmp_path):
    data = block(np.arange(100, dtype=">i4").tobytes())
    cards = {"SIMPLE": True, "BITPIX": 32, "NAXIS": 1, "NAXIS1": 100, "DATASUM": str(fits.ones_complement(data))}
    (tmp_path / "a.fits").write_bytes(fits.written_header(cards) + data)
    (tmp_path / "b.fits").write_bytes(fits.written_header(cards) + data[:-4] + b"abcd")
    (tmp_path / "c.fits").write_bytes(fits.written_header({k: v for k, v in cards.items() if k != "DATASUM"}) + data)
    assert [r.data_ok for r in fits.verified(spark, str(tmp_path)).orderBy("path").collect()] == [True, False, None]
    assert fits.ones_complement(b"\xff" * 8) == 0xFFFFFFFF


def curve_file(sector: int, n: int, scale: float, cube: bool = False) -> bytes:
    kind = [("t", ">f8"), ("c", ">i4"), ("q", ">i4")] + ([("f", ">f4", (6,)), ("e", ">f4", (6,))] if cube else [("f", ">f4"), ("e", ">f4")])
    rows = np.zeros(n, np.dtype(kind))
    rows["t"], rows["c"] = 100 + np.arange(n) / 10, np.arange(n)
    base = scale * (1 + 0.01 * (np.arange(n) % 3 - 1))
    rows["f"] = base[:, None] + np.arange(6) if cube else base
    rows["e"] = scale * 0.001
    if n > 5:
        rows["q"][3], rows["t"][5] = 4, np.nan
    forms = {"TIME": "D", "CADENCENO": "J", "QUALITY": "J", "FLUX": "6E" if cube else "E", "FLUX_ERR": "6E" if cube else "E"}
    cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rows.dtype.itemsize, "NAXIS2": n, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 5, "BJDREFI": 2457000, "BJDREFF": 0.25, "CROWDSAP": 0.9}
    for i, (name, form) in enumerate(forms.items(), 1):
        cards |= {f"TTYPE{i}": name, f"TFORM{i}": form}
    return fits.written_header({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "SECTOR": sector}) + fits.written_header(cards) + block(rows.tobytes())


def test_light_curves_and_cubes(spark, tmp_path):
    for k, n in ((1, 40), (2, 30), (3, 10)):
        (tmp_path / f"s{k}.fits").write_bytes(curve_file(k, n, 50.0 * k))
    rows = fits.read_light_curves(spark, str(tmp_path), "FLUX", "FLUX_ERR").collect()
    assert {r.sector for r in rows} == {1, 2} and len(rows) == 70  # the third is too short
    assert {r.crowdsap for r in rows} == {0.9} and {r.flfrcsap for r in rows} == {None}
    for r in rows:
        assert r.time is None or abs((r.time - 2457100.25) * 10 % 1 - 0.5) > 0.49
        assert abs(r.flux - 1) < 0.011 and math.isclose(r.flux_error, 0.001, rel_tol=1e-5)
    assert sum(not r.good for r in rows) == 4
    (tmp_path / "cube").mkdir()
    (tmp_path / "cube" / "c.fits").write_bytes(curve_file(4, 3, 10.0, cube=True))
    px = fits.read_pixel_cubes(spark, str(tmp_path / "cube"), 3).collect()
    assert len(px) == 18 and {(r.y, r.x) for r in px} == {(y, x) for y in range(2) for x in range(3)}
    assert all(math.isclose(r.value, 10 * (1 + 0.01 * (r.cadence % 3 - 1)) + r.y * 3 + r.x, rel_tol=1e-6) for r in px)


def test_archives(spark, tmp_path):
    image = np.arange(20, dtype=">f4").reshape(4, 5)
    head = fits.written_header({"SIMPLE": True, "BITPIX": -32, "NAXIS": 2, "NAXIS1": 5, "NAXIS2": 4, "EXPTIME": 50.0} | {f"K{i}": i for i in range(700)})
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("night/Sky_Light_R_0007.fits", head + block(image.tobytes()))
        z.writestr("night/x_dark_50s_3.fits", head + block((image + 1).tobytes()))
        z.writestr("readme.txt", "no frame")
    listed = {r.member: r for r in archives.members(spark, str(tmp_path)).collect()}
    assert [(r.kind, r.sequence) for _, r in sorted(listed.items())] == [("science", 7), ("dark", 3), (None, None)]
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert all((listed[i.filename].crc, listed[i.filename].size) == (i.CRC, i.file_size) for i in z.infolist())
    heads = archives.member_headers(spark, str(tmp_path)).collect()
    assert len(heads) == 2 and all(r.header["EXPTIME"] == "50.0" and r.header["K699"] == "699" for r in heads)
    tiles = archives.member_images(spark, str(tmp_path), tile=4).filter("member like '%Light%'").orderBy("tile_x").collect()
    assert [(r.height, r.width) for r in tiles] == [(4, 4), (4, 1)] and tiles[1].pixels == [4.0, 9.0, 14.0, 19.0]


def test_delimited_and_sinks(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("name\tx\na\t1.5\nb\tNaN\nc\t\n")
    rows = text.delimited(spark, str(tmp_path / "t.tbl"), "name string, x double").orderBy("name")
    assert [tuple(r) for r in rows.collect()] == [("a", 1.5), ("b", None), ("c", None)]
    odd = spark.createDataFrame([("a", float("nan"), 1), ("b", float("inf"), None), ("c", 2.0, 3)], "k string, x double, n int")
    assert [json.loads(r.value) for r in text.records(odd.orderBy("k")).collect()] == [{"k": "a", "x": None, "n": 1}, {"k": "b", "x": None, "n": None}, {"k": "c", "x": 2.0, "n": 3}]
    text.append_records(odd.limit(1), str(tmp_path / "log"))
    text.append_records(odd.filter("k = 'c'"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    text.write_summary(odd.filter("k = 'c'"), str(tmp_path / "summary"))
    body = "".join(p.read_text() for p in (tmp_path / "summary").glob("part-*"))
    assert json.loads(body) == {"k": "c", "x": 2.0, "n": 3} and "\n" in body.strip()
    with pytest.raises(ValueError):
        text.write_summary(odd, str(tmp_path / "many"))
    grid = spark.createDataFrame([(1, 0, 0.1, 0.0, 5.0, 9.9), (2, 1, 0.2, 0.1, 6.0, 9.9)], "sector int, cell int, duration double, offset double, chi2 double, depth double")
    text.write_grid(grid, ["sector"], str(tmp_path / "grid"))
    back = spark.read.parquet(str(tmp_path / "grid"))
    assert set(back.columns) == {"sector", "cell", "duration", "offset", "chi2"} and back.filter("sector = 2").first().chi2 == 6.0
    assert text.published(odd, {"n": "Count", "k": "Name"}).columns == ["Count", "Name"]
    with pytest.raises(ValueError):
        text.published(odd, {"lost": "Lost"})
