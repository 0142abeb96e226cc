"""Every query of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import advanced, curves, files, fitting, further, review, sky, tables

_PARTS = (curves, fitting, tables, further, advanced, files, sky, review)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
