"""Text sources: namespaced XML reports, column-and-value records, whitespace tables with comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylathe.functions.expr import finite
from skylathe.operators.quality import only_row


def read_report(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of an XML report; names keep their prefix, attributes start with _."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(schema).load(path)


def record(columns: Column, values: Column) -> Column:
    """A map from parallel arrays; fails where their lengths differ or a name repeats."""
    uneven = (F.size(columns) != F.size(values)) | (F.size(F.array_distinct(columns)) != F.size(columns))
    return F.when(uneven, F.raise_error(F.lit("columns and values don't pair up"))).otherwise(F.map_from_arrays(columns, values))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record (map): JSON files with the arrays columns and values."""
    rows = spark.read.schema("columns array<string>, values array<string>").json(path, multiLine=True)
    return rows.select(record(F.col("columns"), F.col("values")).alias("record"))


def read_commented(spark: SparkSession, path: str, fields: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a whitespace table (path and fields) and the numbers that its # lines give for keys (path, key, value)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    cells = F.split("line", r"\s+")
    data = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).filter(F.size(cells) == len(fields))
    notes = lines.filter(F.col("line").startswith("#")).select("path", "line", F.explode(F.array(*map(F.lit, keys))).alias("key"))
    found = F.regexp_extract("line", r"[:=]\s*(-?\d+(?:\.\d+)?)", 1)
    notes = notes.filter(F.contains(F.lower("line"), F.lower("key")) & (found != "")).select("path", "key", found.cast("double").alias("value"))
    return data.select("path", *[cells[i].alias(f) for i, f in enumerate(fields)]), notes


def write_fixed(df: DataFrame, path: str, digits: dict[str, int]) -> None:
    """CSV with a header, doubles in a fixed number of decimals."""
    cols = [F.format_string(f"%.{digits[c]}f", F.col(c)).alias(c) if c in digits else F.col(c) for c in df.columns]
    df.select(*cols).write.option("header", True).csv(path)


def rewritten(config: Column, changes: dict[str, str]) -> Column:
    """A key=value text with values replaced, line ends kept; fails unless each key is there once."""
    out = config
    for key, value in changes.items():
        pattern = rf"(?m)^{key}=[^\r\n]*"
        out = F.when(F.regexp_count(config, F.lit(pattern)) != 1, F.raise_error(F.lit(f"{key} isn't there exactly once"))).otherwise(F.regexp_replace(out, pattern, f"{key}={value}"))
    return out


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A separated table with a header, of the columns of a schema, NaN and infinities as null."""
    raw = spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)
    return raw.select(*[finite(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in raw.schema.fields])


def records(df: DataFrame) -> DataFrame:
    """value: every row as one line of JSON, unknown and not finite numbers as null."""
    cols = [finite(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def append_records(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON behind those that the folder has."""
    records(df).write.mode("append").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """The one row of df as indented JSON."""
    row = only_row(df)
    clean = df.sparkSession.createDataFrame([row], df.schema)
    pretty = clean.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    pretty.coalesce(1).write.mode("errorifexists").text(path)


def write_grid(fits: DataFrame, by: list[str], path: str) -> None:
    """Trial cells and their chi-square as a long table, a folder for each group."""
    fits.select(*by, "cell", "duration", "offset", "chi2").write.partitionBy(*by).mode("errorifexists").parquet(path)


def published(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that are shown, under their public names, in the order given; an error if one lacks."""
    lacking = [c for c in names if c not in df.columns]
    if lacking:
        raise ValueError(f"columns lack: {', '.join(lacking)}")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
