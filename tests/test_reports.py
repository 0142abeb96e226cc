import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylathe.operators.cuts import shared_folder
from skylathe.sources import fits, fits_source, reports


def _summary_file(column: bool, n: int) -> bytes:
    rows = np.zeros(n, np.dtype([("TIME", ">f8"), ("LC", ">f4")]))
    rows["TIME"], rows["LC"] = np.arange(n), np.where(np.arange(n) % 4 == 0, np.nan, 1.0)
    cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": 12, "NAXIS2": n, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 2, "TTYPE1": "TIME", "TFORM1": "D", "TTYPE2": "LC_DETREND" if column else "OTHER", "TFORM2": "E"}
    cards |= {"EXTNAME": "TCE_1", "TPERIOD": 2.915, "TEPOCH": 3000.5, "TDUR": 2.5, "TDEPTH": 3200.0, "MAXMES": 18.0, "TIMEDEL": 0.5}
    first = {"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "SECTOR": 54, "TICID": 390988385} | ({"SECTORS": "0100001"} if column else {})
    return fits_source.summed_unit(first, b"") + fits_source.summed_unit(cards, rows.tobytes())


def test_fit_summaries(spark, tmp_path):
    (tmp_path / "a_dvt.fits").write_bytes(_summary_file(True, 10))
    (tmp_path / "b_dvt.fits").write_bytes(_summary_file(False, 3))
    (tmp_path / "c.fits").write_bytes(fits_source.summed_unit({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0}, b""))
    a, b = (tuple(r)[1:] for r in reports.fit_summaries(spark, str(tmp_path)).orderBy("path").collect())
    assert a == (54, 390988385, -1, "0100001", "1;6", 10, 7, 720.0, 2.915, 3000.5, 2.5, 3.2, 18.0)
    assert b[5:7] == (3, None) and b[3:5] == ("", "")


def test_archive_answers(spark, tmp_path):
    head = {"TICID": 7, "SECTORS": "s1-s9", "TPERIOD": 2.5, "TEPOCH": 1.5, "TDEPTH": 1500.0, "TDUR": 3.0, "TSNR": 9.0, "MAXMES": 8.0, "NTRANS": 4, "TIMEDEL": 0.5, "TSTART": 1.0, "TSTOP": 2.0}
    (tmp_path / "info").mkdir()
    (tmp_path / "info" / "a.json").write_text(json.dumps({"DV Data Header": head, "more": 1}, indent=1))
    assert tuple(reports.read_event_info(spark, str(tmp_path / "info")).first())[1:] == (7, "s1-s9", 2.5, 1.5, 1.5, 3.0, 9.0, 8.0, 4, 720.0, 1.0, 2.0)
    (tmp_path / "info" / "b.json").write_text("{}")
    with pytest.raises(Exception, match="has no DV Data Header"):
        reports.read_event_info(spark, str(tmp_path / "info")).collect()
    data = [{"TIME": 5.0, "LC_DETREND": None, "MODEL_INIT": -0.003, "SECTORS": "s2"}, {"TIME": None, "LC_DETREND": 0.1, "MODEL_INIT": None, "SECTORS": None}, {"TIME": 2.0, "LC_DETREND": 0.2, "MODEL_INIT": 0.0, "SECTORS": "s1"}]
    (tmp_path / "series").mkdir()
    (tmp_path / "series" / "a.json").write_text(json.dumps({"data": data}))
    assert tuple(reports.read_series_answers(spark, str(tmp_path / "series")).first())[1:] == (3, 2, 2.0, 5.0, 3.0, "s1;s2")
    (tmp_path / "series" / "b.json").write_text(json.dumps({"data": []}))
    with pytest.raises(Exception, match="has no rows"):
        reports.read_series_answers(spark, str(tmp_path / "series")).collect()


def test_headers_merge_in_order(spark, tmp_path):
    kind = "source array<struct<key:string,value:string,comment:string>>, solution array<struct<key:string,value:string,comment:string>>, added array<struct<key:string,value:string,comment:string>>"
    source = [("SIMPLE", "T", None), ("EXPTIME", "50", "seconds"), ("CRVAL1", "1", "old"), ("DATASUM", "9", None), ("HISTORY", "made", None)]
    solution = [("SIMPLE", "T", "other"), ("NAXIS1", "3", None), ("COMMENT", "no", None), ("CRVAL1", "2", "new"), ("CTYPE1", "TAN", "x"), ("CTYPE1", "SIN", "y"), ("HISTORY", "solved", None)]
    df = spark.createDataFrame([(source, solution, [("PLTSOLVD", "T", "yes")]), (None, None, None), (source, [], [])], kind)
    out = [[tuple(c) for c in r[0]] for r in df.select(reports.merged_cards(F.col("source"), F.col("solution"), F.col("added"))).collect()]
    assert out[0] == [("SIMPLE", "T", None), ("EXPTIME", "50", "seconds"), ("CRVAL1", "2", "new"), ("CTYPE1", "SIN", "y"), ("PLTSOLVD", "T", "yes"), ("HISTORY", "made", None), ("HISTORY", "solved", None)]
    assert out[1] == [] and out[2] == [c for c in source if c[0] != "DATASUM"]
    text = b"".join(c.ljust(80).encode() for c in ("SIMPLE  =                    T / conforms", "OBJECT  = 'a/b ''c'''          / a name", "HISTORY first step", "EXPTIME =                 50.0", "", "END"))
    (tmp_path / "h.fits").write_bytes(text.ljust(2880))
    assert [tuple(c) for c in fits.read_cards(spark, str(tmp_path)).first().cards] == [("SIMPLE", "T", "conforms"), ("OBJECT", "a/b 'c'", "a name"), ("HISTORY", "first step", None), ("EXPTIME", "50.0", None)]


def test_answers_of_one_file_are_told_apart_by_a_field(spark, tmp_path):
    row = lambda t: {"TIME": t, "LC_DETREND": t, "MODEL_INIT": -t / 1000, "SECTORS": f"s{t:.0f}"}
    (tmp_path / "many.json").write_text("\n".join(json.dumps(a) for a in ({"user id": 7, "data": [row(1.0), row(2.0)]}, {"user id": 8, "data": [row(3.0)]}, {"data": [row(4.0)]})))
    got = {tuple(r) for r in reports.read_series_answers(spark, str(tmp_path), "user id").collect()}
    assert got == {("7", 2, 2, 1.0, 2.0, 2.0, "s1;s2"), ("8", 1, 1, 3.0, 3.0, 3.0, "s3"), (None, 1, 1, 4.0, 4.0, 4.0, "s4")}
    (tmp_path / "empty.json").write_text('{"user id": 9}')
    with pytest.raises(Exception, match="has no rows"):
        reports.read_series_answers(spark, str(tmp_path), "user id").collect()


def test_the_query_of_answers_writes_few_files(spark, tmp_path):
    from skylathe.plans import catalogue

    events = spark.range(1500).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "nullif(id div 3, 0) as user_id", "'a' as event_type", "double(id) as value", "'{\"k\": 1}' as props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    before = set(os.listdir(shared_folder(spark)))
    out = catalogue.QUERIES["series_answers"](spark, str(tmp_path)).collect()
    assert len(out) == 500 and {r.user_id for r in out} == {None, *range(1, 500)} and all(r.rows == 3 for r in out)
    (folder,) = set(os.listdir(shared_folder(spark))) - before
    assert sum(f.endswith(".json") for _, _, files in os.walk(f"{shared_folder(spark)}/{folder}") for f in files) < 50
