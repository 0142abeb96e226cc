"""FITS members of ZIP archives: listing, headers alone, and images as tiles. An archive is one task."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylathe.functions.expr import frame_kind
from skylathe.sources import fits

#: Bytes of a member that hold its first header, blocks of which are read until it ends.
_HEAD = 16 * fits.BLOCK


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).select("path", "content")


def members(spark: SparkSession, path: str, sequence: str = r"(\d+)\D*$") -> DataFrame:
    """archive, member, size, crc, kind (science, dark or flat by name) and sequence (the first group of
    a pattern) of every member, from the archives' directories alone."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i.filename, i.file_size, i.CRC) for p, data in zip(batch["path"], batch["content"], strict=True) for i in zipfile.ZipFile(io.BytesIO(data)).infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["archive", "member", "size", "crc"])

    rows = _archives(spark, path).mapInPandas(parse, "archive string, member string, size long, crc long")
    number = F.nullif(F.regexp_extract("member", sequence, 1), F.lit(""))
    return rows.select("*", frame_kind(F.col("member")).alias("kind"), number.cast("long").alias("sequence"))


def member_headers(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, header (map) of the first unit of each FITS member; pixels aren't decompressed."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, data in zip(batch["path"], batch["content"], strict=True):
                archive = zipfile.ZipFile(io.BytesIO(data))
                for name in archive.namelist():
                    if name.lower().endswith((".fits", ".fit", ".fts")):
                        with archive.open(name) as f:
                            head = f.read(_HEAD)
                            while b"END" + b" " * 77 not in head and (more := f.read(_HEAD)):
                                head += more
                        cards, _ = fits.header_at(head, 0)
                        rows.append((p, name, {k: None if v is None else str(v) for k, v in cards.items()}))
            yield pd.DataFrame(rows, columns=["archive", "member", "header"])

    return _archives(spark, path).mapInPandas(parse, "archive string, member string, header map<string,string>")


def member_images(spark: SparkSession, path: str, tile: int = 256) -> DataFrame:
    """archive, member, tile_y, tile_x, height, width, pixels: tiles of the first image of each FITS member."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                archive = zipfile.ZipFile(io.BytesIO(data))
                for name in archive.namelist():
                    if name.lower().endswith((".fits", ".fit", ".fts")):
                        rows = [(p, name, *t) for t in fits.tiles_of(archive.read(name), 0, tile)]
                        yield pd.DataFrame(rows, columns=["archive", "member", "tile_y", "tile_x", "height", "width", "pixels"])

    return _archives(spark, path).mapInPandas(parse, "archive string, member string, tile_y int, tile_x int, height int, width int, pixels array<double>")
