"""Vectors of floats as vectors of integers, which sums and distances hold exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest magnitude of an integer component: 64 squared differences of two such stay below 2^62.
LARGEST = 1 << 27


def usable(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & whole


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as array<int>; null where one is over LARGEST."""
    scaled = lambda x: F.floor(x.cast("double") * scale)
    held = F.forall(vector, lambda x: F.abs(x.cast("double")) * scale < LARGEST)
    return F.when(held, F.transform(vector, lambda x: scaled(x).cast("int")))


def clashing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of df by name, quoted, so that dots and further columns do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
