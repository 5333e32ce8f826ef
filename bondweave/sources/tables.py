"""CSV and Parquet sources and sinks with explicit schemas and row positions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import limit_rows, with_ordinal
from ..schema import ReactionSchema


def with_extension(path: str, extension: str) -> str:
    """``path`` ending in ``extension``, once."""
    extension = "." + extension.lstrip(".")
    return path if path.endswith(extension) else path + extension


def without_extension(path: str) -> str:
    return str(PurePosixPath(path).with_suffix("")) if PurePosixPath(path).suffix else path


def scan_csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[int | str] | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """A CSV file with a header; ``columns`` by name or position, ``skip`` leading rows, at most ``limit`` rows.

    Give ``schema`` in production: without one, all columns are strings. Skipping needs the rows' place
    in their file, which is computed only then.
    """
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if columns is not None:
        names = [df.columns[c] if isinstance(c, int) else c for c in columns]
        df = df.select(*names)
    if skip:
        names = df.columns
        # A file's rows lie in the order of their blocks; the first file is the one of the least name.
        place = F.struct(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
        df = with_ordinal(df.select("*", place.alias("_p")).select("*", "_p._f", "_p._b", "_p._i").drop("_p"), ["_f", "_b", "_i"], "_rn").where(F.col("_rn") > skip).select(*names)
    return df if limit is None else df.limit(limit)


def scan_sorted(spark: SparkSession, path: str, schema: str, by: list[str], ascending: bool = True, columns: list[int | str] | None = None) -> DataFrame:
    """A CSV file's rows in the order of ``by``."""
    df = scan_csv(spark, path, schema, columns)
    return df.orderBy(*[F.col(c).asc() if ascending else F.col(c).desc() for c in by])


def transform_file(spark: SparkSession, source: str, target: str, work: Callable[[DataFrame], DataFrame], schema: str | None = None) -> None:
    """Read a CSV or Parquet file, by its ending, apply ``work``, and write the result in the kind that ``target`` ends in."""
    df = scan_parquet(spark, source) if source.endswith(".parquet") else scan_csv(spark, source, schema)
    out = work(df)
    if target.endswith(".parquet"):
        out.write.mode("overwrite").parquet(target)
    else:
        write_csv(out, target)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file; reads its first line only."""
    return spark.read.option("header", True).csv(path).columns


def scan_parquet(spark: SparkSession, path: str, row_column: str | None = None) -> DataFrame:
    """A Parquet file; ``row_column`` adds each row's place in its file."""
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.row_index").alias(row_column)) if row_column else df


def read_labels(spark: SparkSession, path: str) -> list[str]:
    """Labels on the first line of a text file, separated by commas."""
    first = spark.read.text(path).limit(1).select(F.transform(F.split("value", ","), lambda s: F.trim(s)).alias("labels")).collect()
    return list(first[0]["labels"]) if first else []


def write_labels(spark: SparkSession, labels: list[str], path: str) -> None:
    spark.createDataFrame([(",".join(labels),)], "value string").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A CSV folder with headers. ``one_file`` is for small results: a single task writes it."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def column_at(df: DataFrame, position: int) -> Column:
    return df[df.columns[position]]


def union_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of several CSV files, each with its file's name in ``file``."""
    frames = [scan_csv(spark, p, schema).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)) for p in paths]
    return reduce(DataFrame.unionByName, frames)


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold ``valid`` and the rejected rest; an undecided row is rejected."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def explode_list(df: DataFrame, column: str, name: str = "item") -> DataFrame:
    """One row for each entry of a comma-separated text, trimmed; empty entries are left out."""
    items = F.filter(F.transform(F.split(column, ","), lambda s: F.trim(s)), lambda s: s != "")
    return df.withColumn(name, F.explode(items))


def ingest(df: DataFrame, schema: ReactionSchema, order_by: list[str], limit: int | float | list[int] | tuple[int, int] | None = None, one_based: bool = False, with_target: bool = True) -> DataFrame:
    """A reaction table by roles: bond numbers from 0, and by ``limit`` only some rows of its order (see ``limit_rows``).

    ``order_by`` names canonical columns; it decides which rows a limit takes, and nothing else.
    """
    out = schema.project(df, with_target)
    if one_based:
        out = out.withColumn("bidx", F.col("bidx") - 1)
    return out if limit is None else limit_rows(out, limit, order_by)
