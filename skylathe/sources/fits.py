"""FITS files as DataFrames: headers, binary tables and image tiles.

The layout is that of the FITS standard 4.0: blocks of 2880 bytes, cards of 80, big-endian data. Files
are read by ranges through the sources of fits_source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylathe.functions.expr import finite, good

BLOCK, CARD = 2880, 80
#: Codes of binary-table columns: numpy type on disk and Spark type.
CODES = {
    "L": ("u1", T.BooleanType()), "B": ("u1", T.ShortType()), "I": (">i2", T.ShortType()), "J": (">i4", T.IntegerType()),
    "K": (">i8", T.LongType()), "A": ("S", T.StringType()), "E": (">f4", T.FloatType()), "D": (">f8", T.DoubleType()),
}


def card_value(card: str):
    """The value of a card: text in quotes (two quotes stand for one), logical, number or None."""
    text = card[10:].strip()
    if text.startswith("'"):
        out, rest = "", text[1:]
        while "'" in rest:
            part, _, rest = rest.partition("'")
            out += part
            if not rest.startswith("'"):
                return out.rstrip()
            out, rest = out + "'", rest[1:]
        raise ValueError(f"unended text: {card!r}")
    text = text.partition("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    if not text:
        return None
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.upper().replace("D", "E"))
        except ValueError:
            return text


def ordered_cards(data: bytes) -> list[tuple[str, str | None, str | None]]:
    """Key, value as text and comment of a header's cards in order, up to END; cards without a value, like
    HISTORY, have their text as value, blank ones are left out."""
    out = []
    for card in (data[i : i + CARD].decode("ascii", "replace") for i in range(0, len(data), CARD)):
        key = card[:8].rstrip()
        if card.rstrip() == "END":
            break
        if card[8:10] != "= ":
            if key:
                out.append((key, card[8:].rstrip(), None))
            continue
        rest, value = card[10:].strip(), card_value(card)
        if rest.startswith("'"):
            rest = rest[1:].replace("''", "\0\0").partition("'")[2]
        comment = rest.partition("/")[2].strip()
        out.append((key, None if value is None else {True: "T", False: "F"}.get(value, str(value)) if isinstance(value, bool) else str(value), comment or None))
    return out


def header_at(data: bytes, at: int, number: int = 0) -> tuple[dict, int]:
    """The header that begins at a byte, and where its data do."""
    header: dict = {}
    while True:
        block = data[at : at + BLOCK].decode("ascii", "replace")
        if len(block) < BLOCK:
            raise EOFError(f"header of unit {number} is cut off")
        at += BLOCK
        for card in (block[i : i + CARD] for i in range(0, BLOCK, CARD)):
            if card.rstrip() == "END":
                return header, at
            if card[8:10] == "= ":
                header[card[:8].rstrip()] = card_value(card)


def headers(data: bytes) -> Iterator[tuple[int, dict, int, int]]:
    """Number, header, start and size of the data of each unit of a file."""
    at = number = 0
    while at < len(data):
        header, at = header_at(data, at, number)
        axes = [header.get(f"NAXIS{i + 1}", 0) for i in range(header.get("NAXIS", 0))]
        cells = int(np.prod(axes)) if axes else 0
        size = abs(header.get("BITPIX", 8)) // 8 * header.get("GCOUNT", 1) * (header.get("PCOUNT", 0) + cells) if cells or header.get("PCOUNT") else 0
        if at + size > len(data):
            raise EOFError(f"data of unit {number} are cut off")
        yield number, header, at, size
        at += -(-size // BLOCK) * BLOCK
        number += 1


def columns(header: dict) -> list[tuple[str, int, str]]:
    """Name, repeat count and code of a binary table's columns."""
    out = []
    for i in range(1, header["TFIELDS"] + 1):
        form = str(header[f"TFORM{i}"]).strip()
        digits = form[: len(form) - len(form.lstrip("0123456789"))]
        code = form[len(digits)]
        if code not in CODES:
            raise ValueError(f"column code {code!r} isn't supported")
        out.append((str(header.get(f"TTYPE{i}", f"col{i}")).strip(), int(digits or 1), code))
    return out


def schema_of(header: dict) -> T.StructType:
    fields = []
    for name, count, code in columns(header):
        kind = CODES[code][1]
        fields.append(T.StructField(name, kind if count == 1 or code == "A" else T.ArrayType(kind)))
    return T.StructType(fields)


def tiles_of(data: bytes, hdu: int, tile: int) -> Iterator[tuple]:
    """tile_y, tile_x, height, width, pixels of an image unit, scaled by BZERO and BSCALE."""
    for n, h, at, _ in headers(data):
        if n == hdu and h.get("NAXIS") == 2:
            kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[h["BITPIX"]]
            image = np.frombuffer(data, kind, h["NAXIS1"] * h["NAXIS2"], at).reshape(h["NAXIS2"], h["NAXIS1"])
            image = image.astype("f8") * (h.get("BSCALE") or 1) + (h.get("BZERO") or 0)
            for y in range(0, image.shape[0], tile):
                for x in range(0, image.shape[1], tile):
                    part = image[y : y + tile, x : x + tile]
                    yield (y // tile, x // tile, *part.shape, part.ravel())


def _source(spark: SparkSession, name: str, hdu: int | None = None):
    from . import fits_source

    fits_source.register(spark)
    reader = spark.read.format(name)
    return reader if hdu is None else reader.option("hdu", hdu)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, hdu, header (map), data_offset, data_size: a row for each unit of each file; data aren't read."""
    return _source(spark, "fits_headers").load(path).drop("cards")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """path, hdu, cards (array of key, value, comment in the header's order) of each unit of each file."""
    return _source(spark, "fits_headers").load(path).select("path", "hdu", "cards")


def read_table(spark: SparkSession, path: str, hdu: int = 1, wanted: list[str] | None = None) -> DataFrame:
    """The rows of a binary table of all files, with path; the schema is the first file's, and only
    wanted columns are read."""
    told = _source(spark, "fits_table", hdu).load(path)
    if wanted is None:
        return told
    return _source(spark, "fits_table", hdu).schema(T.StructType([f for f in told.schema.fields if f.name in ("path", *wanted)])).load(path)


def read_image(spark: SparkSession, path: str, hdu: int = 0, tile: int = 256) -> DataFrame:
    """path, tile_y, tile_x, height, width, pixels: square tiles of the images of all files; neither a
    frame nor a file is ever one row."""
    return _source(spark, "fits_image", hdu).option("tile", tile).load(path)


def _unit_values(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """path and a column for each key: the value of the first unit of a file that has it."""
    heads = read_headers(spark, path).select("path", "hdu", "header")
    first = [F.min_by(F.col("header")[k], F.when(F.col("header")[k].isNotNull(), F.col("hdu"))).alias(k) for k in keys]
    return heads.groupBy("path").agg(*first)


def read_light_curves(spark: SparkSession, path: str, flux: str, error: str, least: int = 20) -> DataFrame:
    """path, sector, time, flux, flux_error, quality, good, crowdsap, flfrcsap of the light curves of all
    files: times with their reference day (2457000 unless the header tells), fluxes over the median
    of the good ones. Files with fewer than `least` good rows or a median that isn't positive give nothing."""
    known = _unit_values(spark, path, ["SECTOR", "BJDREFI", "BJDREFF", "CROWDSAP", "FLFRCSAP"])
    number = lambda k, default: F.coalesce(F.col(k).cast("double"), F.lit(default))
    rows = read_table(spark, path, 1, ["TIME", flux, error, "QUALITY"]).join(known, "path")
    time = finite(F.col("TIME")) + number("BJDREFI", 2457000.0) + number("BJDREFF", 0.0)
    rows = rows.select("path", F.col("SECTOR").cast("int").alias("sector"), time.alias("time"), finite(F.col(flux).cast("double")).alias("flux"), finite(F.col(error).cast("double")).alias("flux_error"), F.col("QUALITY").cast("long").alias("quality"), F.col("CROWDSAP").cast("double").alias("crowdsap"), F.col("FLFRCSAP").cast("double").alias("flfrcsap"))
    rows = rows.withColumn("good", good(F.col("flux"), F.col("flux_error"), F.col("quality")) & F.col("time").isNotNull())
    kin = Window.partitionBy("path")
    rows = rows.withColumn("_n", F.count_if("good").over(kin)).withColumn("_s", F.percentile(F.when(F.col("good"), F.col("flux")), 0.5).over(kin)).filter((F.col("_n") >= least) & (F.col("_s") > 0))
    return rows.withColumn("flux", F.col("flux") / F.col("_s")).withColumn("flux_error", F.col("flux_error") / F.col("_s")).drop("_n", "_s")


def read_pixel_cubes(spark: SparkSession, path: str, width: int) -> DataFrame:
    """path, cadence, time, quality, y, x, value, error: the pixels of the cubes of all files, times with
    their reference day, not finite values as null."""
    known = _unit_values(spark, path, ["BJDREFI", "BJDREFF"])
    rows = read_table(spark, path, 1, ["TIME", "FLUX", "FLUX_ERR", "QUALITY", "CADENCENO"]).join(known, "path")
    time = finite(F.col("TIME")) + F.coalesce(F.col("BJDREFI").cast("double"), F.lit(2457000.0)) + F.coalesce(F.col("BJDREFF").cast("double"), F.lit(0.0))
    rows = rows.select("path", F.col("CADENCENO").cast("long").alias("cadence"), time.alias("time"), F.col("QUALITY").cast("long").alias("quality"), F.posexplode(F.arrays_zip("FLUX", "FLUX_ERR")).alias("p", "v"))
    return rows.select("path", "cadence", "time", "quality", F.expr(f"p div {width}").cast("int").alias("y"), (F.col("p") % width).alias("x"), finite(F.col("v.FLUX").cast("double")).alias("value"), finite(F.col("v.FLUX_ERR").cast("double")).alias("error"))


def written_header(cards: dict) -> bytes:
    """A header block of cards, END and blanks to whole blocks."""
    lines = []
    for key, v in cards.items():
        if isinstance(v, bool):
            text = f"{'T' if v else 'F':>20}"
        elif isinstance(v, str):
            text = "'" + v.replace("'", "''").ljust(8) + "'"
        else:
            text = f"{v!r:>20}"
        lines.append(f"{key:<8}= {text}".ljust(CARD))
    out = "".join(lines) + "END".ljust(CARD)
    return out.ljust(-(-len(out) // BLOCK) * BLOCK).encode("ascii")


@F.pandas_udf(T.BinaryType())
def image_file(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """A single-precision image file of each row of pixels, as bytes to be written as one file."""
    out = []
    for p, w in zip(pixels, width, strict=True):
        image = np.asarray(p, ">f4").reshape(-1, w)
        data = image.tobytes()
        head = written_header({"SIMPLE": True, "BITPIX": -32, "NAXIS": 2, "NAXIS1": int(w), "NAXIS2": len(image)})
        out.append(head + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0"))
    return pd.Series(out)


def ones_complement(data: bytes, start: int = 0) -> int:
    """The 32-bit ones-complement sum of the standard's DATASUM and CHECKSUM."""
    total = start + int(np.frombuffer(data.ljust(-(-len(data) // 4) * 4, b"\0"), ">u4").sum(dtype=np.uint64))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


def verified(spark: SparkSession, path: str) -> DataFrame:
    """path, hdu, data_ok, unit_ok: whether a unit's data have the sum that its DATASUM card tells, and
    the whole unit the sum of all ones that goes with CHECKSUM; null without the card.

    A task sums a file in pieces, as sums of the standard add up.
    """
    from pyarrow import fs as stores

    from .fits_source import Ranged

    piece = 8 << 20

    def total(file, start: int, end: int) -> int:
        sums = 0
        for a in range(start, end, piece):
            sums = ones_complement(file[a : min(a + piece, end)], sums)
        return sums

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["path"].drop_duplicates():
                with Ranged(stores.FileSystem.from_uri(path)[0], p) as file:
                    rows, begin = [], 0
                    for n, h, at, size in headers(file):
                        end = at + -(-size // BLOCK) * BLOCK
                        data = total(file, at, end) if "DATASUM" in h or "CHECKSUM" in h else 0
                        whole = ones_complement(b"", data + total(file, begin, at))
                        rows.append((p, n, int(h["DATASUM"]) == data if "DATASUM" in h else None, whole in (0, 0xFFFFFFFF) if "CHECKSUM" in h else None))
                        begin = end
                    yield pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype=object) for i, k in enumerate(["path", "hdu", "data_ok", "unit_ok"])})

    heads = read_headers(spark, path).filter("hdu = 0").select("path")
    return heads.mapInPandas(check, "path string, hdu int, data_ok boolean, unit_ok boolean")
