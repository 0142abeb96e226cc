"""Data-quality checks that return what is wrong as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: a row for each rule that a row breaks; an unknown outcome counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """key, n: keys with more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def differing(left: DataFrame, right: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """key, column, left, right: values further apart than the column's tolerance, or on one side only."""
    a = left.select(key, *[F.col(c).cast("double").alias(f"l_{c}") for c in tolerances])
    b = right.select(key, *[F.col(c).cast("double").alias(f"r_{c}") for c in tolerances])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").alias("left"), F.col(f"r_{c}").alias("right"), F.lit(float(t)).alias("tolerance")) for c, t in tolerances.items()]
    long = a.join(b, key, "full_outer").select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")
    same = F.coalesce(F.abs(F.col("left") - F.col("right")) <= F.col("tolerance"), F.col("left").isNull() & F.col("right").isNull())
    return long.filter(~same).drop("tolerance")


def only_row(df: DataFrame) -> Row:
    """The one row of df; an error for none or several."""
    found = df.take(2)
    if len(found) != 1:
        raise ValueError(f"one row was expected, {'none' if not found else 'several'} came")
    return found[0]


def at_least(df: DataFrame, least: int, what: str = "rows") -> DataFrame:
    """df; fails when it is read if it has fewer rows."""
    n = df.agg(F.count("*").alias("_n"))
    ok = F.when(F.col("_n") < least, F.raise_error(F.concat(F.lit(f"{least} {what} are needed, found "), F.col("_n").cast("string"))).cast("boolean")).otherwise(True)
    return F.broadcast(n).join(df, F.lit(True), "left").filter(ok).select(*df.columns)
