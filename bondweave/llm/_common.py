"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checkpoints

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; see ``checkpoints.shared_dir``."""
    return checkpoints.shared_dir(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    """Number of words, without Python; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of one or two hashes that are broadcast at most, to tell documents that go from those that stay.
BROADCAST_KEYS = 500_000


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark ``df`` for broadcast only when its counted rows stay within ``limit``; else Spark shuffles the join."""
    return F.broadcast(df) if rows <= limit else df


#: A key is hot if it holds more than one row in so many; whatever the table's size, there are no more hot keys than that.
HOT = 1000


def hot_keys(counts: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """The hot keys of a table of ``total`` rows (or less), from (key, rows): HOT at most, as their shares sum to one."""
    return counts.where(F.col(rows) * HOT > total).select(key)


def join_spread(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique, without bringing the rows of a hot key together.

    The hot keys' rows of ``right``, HOT at most, are broadcast; only the other rows of ``left`` are shuffled.
    """
    hot = F.broadcast(hot)
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def salts_of(counts: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """(key, salts) of the hot keys: into so many parts their rows are cut that none holds more than a HOT-th of all."""
    return counts.where(F.col(rows) * HOT > total).select(key, F.ceil(F.col(rows) * HOT / F.lit(max(total, 1))).cast("int").alias("salts"))


def join_salted(left: DataFrame, right: DataFrame, key: str, salts: DataFrame, by: list[str]) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, a hot key's rows of ``left`` cut into its ``salts`` by a hash of ``by``.

    The rows of ``right`` are repeated for each salt of their key; all salts together are 2 * HOT at most.
    """
    n, hot = F.coalesce("_salts", F.lit(1)), F.broadcast(salts.withColumnRenamed("salts", "_salts"))
    cut = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), n).cast("int")).drop("_salts")
    many = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return cut.join(many, [key, "_salt"]).drop("_salt")


def least_by_hash(stored: DataFrame, by: list[str], limit: int, seed: int) -> DataFrame:
    """The ``limit`` rows of a stored table with the least hash of ``by``, ties by the columns themselves.

    A threshold on the hash leaves about twice as many rows before they are sorted, so the one task that does so
    gets a number of rows that grows with neither the table nor its partitions. Rows beyond the threshold come
    later in the order, so it changes nothing; it is doubled in the rare case that too few lie below it.
    """
    h, rows, share = F.xxhash64(F.lit(seed), *by), stored.count(), 2.0 * limit + 100
    below = stored
    while share < rows:
        below = stored.where(h < F.lit(int((share / rows - 0.5) * 2.0**64)))
        if below.count() >= limit:
            break
        below, share = stored, 2 * share
    return below.orderBy(h, *by).limit(limit)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores added until no column has it, so that none of a caller's columns is replaced."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` refers to it for every element of an array.

    A column of its own would not do: Catalyst merges projections and puts its expression inside the lambda.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sums of an array's elements up to and with each, by doubling: element i gets what ends 1, 2, 4, ... places before it.

    n log n steps, where an ``aggregate`` that appends to an array would copy it n times.
    """

    def doubled(wide: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(wide) + F.lit(1))).cast("int"))
        return F.aggregate(rounds, wide, lambda sums, k: F.transform(sums, lambda s, i: s + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))

    return let(F.transform(numbers, lambda n: n.cast("long")), doubled)
