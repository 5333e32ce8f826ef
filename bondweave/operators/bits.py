"""Sparse bit features: an array of set places for each row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_counts(df: DataFrame, bits: str = "bits") -> DataFrame:
    """(bit, n): rows that have each bit; bits that no row has are not listed."""
    return df.select(F.explode(F.array_distinct(bits)).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))


def constant_bits(df: DataFrame, n_bits: int, bits: str = "bits", threshold: float = 0.0, legacy_small_n: bool = False) -> DataFrame:
    """(bit, n): bits set in at most ``threshold`` of the rows, or in all but so many.

    ``legacy_small_n`` finds none in tables of 1024 rows or fewer.
    """
    spark = df.sparkSession
    total = df.count()
    if legacy_small_n and total <= 1024 and not threshold:
        return spark.createDataFrame([], "bit int, n long")
    every = spark.range(n_bits).select(F.col("id").cast("int").alias("bit"))
    n = every.join(bit_counts(df, bits), "bit", "left").select("bit", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return n.where((F.col("n") <= threshold * total) | (F.col("n") >= total - threshold * total))


def prune_bits(df: DataFrame, drop: Sequence[int], bits: str = "bits") -> DataFrame:
    """Rows without the dropped bits; a feature space is fixed by configuration, so the list is short."""
    return df.withColumn(bits, F.array_except(bits, F.array(*[F.lit(int(b)) for b in drop]))) if drop else df


def fit_prune(train: DataFrame, others: Sequence[DataFrame], n_bits: int, bits: str = "bits", threshold: float = 0.0) -> tuple[list[int], list[DataFrame]]:
    """Bits that are not constant on ``train``, and all tables reduced to them."""
    drop = {r["bit"] for r in constant_bits(train, n_bits, bits, threshold).select("bit").collect()}
    return [b for b in range(n_bits) if b not in drop], [prune_bits(d, sorted(drop), bits) for d in (train, *others)]


def slice_bits(bits: Column, start: int, stop: int, shift: bool = True) -> Column:
    """Bits of a block [start, stop), counted from its start if ``shift``."""
    kept = F.filter(bits, lambda b: (b >= start) & (b < stop))
    return F.transform(kept, lambda b: b - start) if shift else kept


def concat_bits(columns: Sequence[tuple[str, int]]) -> Column:
    """Blocks of (bits, size) laid end to end."""
    at, parts = 0, []
    for c, size in columns:
        parts.append(_shifted(c, at))
        at += size
    return F.concat(*parts)


def _shifted(column: str, by: int) -> Column:
    return F.transform(column, lambda b: b + by)


def columns_of_rows(df: DataFrame, row: str, bits: str = "bits") -> DataFrame:
    """(bit, rows): the sorted rows that have each bit, as one array; ``blocks_of_rows`` gives those of common bits in parts."""
    return df.select(F.col(row), F.explode(bits).alias("bit")).groupBy("bit").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def blocks_of_rows(df: DataFrame, row: str, bits: str = "bits", size: int = 65_536) -> DataFrame:
    """(bit, block, rows): the same for integer rows in blocks of ``size`` numbers, so that no array holds more than so many."""
    each = df.select(F.col(row), F.floor(F.col(row) / size).alias("block"), F.explode(bits).alias("bit"))
    return each.groupBy("bit", "block").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def activate(df: DataFrame, blocks: Sequence[tuple[int, int]], active: Sequence[bool], bits: str = "bits") -> DataFrame:
    """Rows without the bits of the feature blocks [start, stop) that are switched off; places of the others stay as they are."""
    if len(blocks) != len(active):
        raise ValueError("one switch for each block")
    dead = [b for b, on in zip(blocks, active) if not on]
    return df.withColumn(bits, F.filter(bits, lambda b: ~reduce(lambda x, y: x | y, [(b >= lo) & (b < hi) for lo, hi in dead]))) if dead else df


def to_vector(bits: Column, n_bits: int) -> Column:
    """A sparse ML vector of 0 and 1."""
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: F.array_contains(bits, i).cast("double")))


def reconcile(source: Sequence[str], target: Sequence[str]) -> list[int]:
    """Places of ``source`` labels that are not in ``target``; the rest must be ``target``, in order."""
    drop, at = [], 0
    for i, name in enumerate(source):
        if at < len(target) and name == target[at]:
            at += 1
        else:
            drop.append(i)
    if at != len(target):
        raise ValueError(f"label {target[at]!r} is missing or out of order")
    return drop
