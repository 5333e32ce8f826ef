"""Unordered pairs within groups: de-duplication, reversal, compute-once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_key(x: str, y: str) -> list[Column]:
    """Equal for (x, y) and (y, x). A null partner stays a partner of its own: it does not take the other's place."""
    return [F.array_sort(F.array(x, y)).alias("_pair")]


def dedup_pairs(df: DataFrame, group: Sequence[str], pair: tuple[str, str], order_by: Sequence[str], mean_of: Sequence[str] = (), ordered: bool = False, keep_if: Column | None = None) -> DataFrame:
    """The first row (by ``order_by``) of each pair within a group; ``mean_of`` columns become the pair's means.

    ``ordered`` tells (x, y) from (y, x). Rows that hold ``keep_if`` always stay. One aggregate that Spark combines before the
    shuffle finds the first rows, so no pair is ever hot; rows that stay anyway are not shuffled, unless they need their pair's means.
    """
    key = [F.struct(*pair).alias("_pair")] if ordered else pair_key(*pair)
    with_key = df.select("*", *key)
    if keep_if is None:
        first = F.min_by(F.struct(*df.columns), F.struct(*order_by)).alias("_first")
        once = with_key.groupBy(*group, "_pair").agg(first, *[F.avg(c).alias(f"_mean_{c}") for c in mean_of])
        return once.select(*[F.col(f"_mean_{c}").alias(c) if c in mean_of else F.col("_first")[c].alias(c) for c in df.columns])
    keyed = with_key.withColumn("_stays", F.coalesce(keep_if, F.lit(False)))
    first = F.min_by(F.struct(*df.columns, "_stays"), F.struct(*order_by)).alias("_first")
    once = keyed.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_pair").alias("_of")).agg(first, *[F.avg(c).alias(f"_mean_{c}") for c in mean_of])
    mean = lambda c, other: F.col(f"_mean_{c}").alias(c) if c in mean_of else other.alias(c)
    out = once.where(~F.col("_first._stays")).select(*[mean(c, F.col("_first")[c]) for c in df.columns])
    stay = keyed.where("_stays")
    if mean_of:
        same = F.col("_pair").eqNullSafe(F.col("_of"))
        for i, g in enumerate(group):
            same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
        stay = stay.join(once.drop("_first"), same)
    return out.unionByName(stay.select(*[mean(c, F.col(c)) for c in df.columns]))


def cleanup(df: DataFrame, group: Sequence[str], pair: tuple[str, str], order_by: Sequence[str], mean_of: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """A source table without repeated pairs, numbered from 1 in the order of ``order_by`` over the whole table, and checked.

    The check is a pass of its own over what was written: a group that holds one pair twice is an error, not a result.
    """
    from .order import with_ordinal

    out = with_ordinal(dedup_pairs(df, group, pair, order_by, mean_of), order_by, name)
    twice = out.groupBy(*group, *pair_key(*pair)).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a pair is there twice: {twice[0]}")
    return out


def dedup_column(df: DataFrame, group: Sequence[str], column: str, order_by: Sequence[str], mean_of: Sequence[str] = ()) -> DataFrame:
    """As ``dedup_pairs`` for one column, compared by its whole value."""
    return dedup_pairs(df, group, (column, column), order_by, mean_of, ordered=True)


def reverse_augment(df: DataFrame, pair: tuple[str, str], skip_identical: bool = True, turn: str = "turn") -> DataFrame:
    """Each row, and the row with its pair swapped, told apart by ``turn`` 0 and 1; no shuffle.

    Order by (place, turn) for swapped rows beside their originals, by (turn, place) for swapped ones last.
    """
    x, y = pair
    both = F.array(F.struct(F.lit(0).alias("t"), F.col(x).alias("x"), F.col(y).alias("y")), F.struct(F.lit(1).alias("t"), F.col(y).alias("x"), F.col(x).alias("y")))
    some = F.when(F.col(x).eqNullSafe(F.col(y)), F.slice(both, 1, 1)).otherwise(both) if skip_identical else both
    out = df.withColumn("_b", F.explode(some))
    return out.withColumn(x, F.col("_b.x")).withColumn(y, F.col("_b.y")).withColumn(turn, F.col("_b.t")).drop("_b")


def compute_once(df: DataFrame, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a costly ``compute`` to distinct keys only and bring its columns back to every row; null keys are keys."""
    computed = compute(df.select(*keys).distinct())
    named = computed.select(*[F.col(c).alias(f"_key_{c}" if c in keys else c) for c in computed.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(named, same).drop(*[f"_key_{k}" for k in keys])


def isomer_report(df: DataFrame, group: Sequence[str], pair: tuple[str, str], plain: Callable[[Column], Column]) -> DataFrame:
    """Groups whose pairs differ as written but agree once ``plain`` is applied, with both numbers of pairs."""
    raw = F.array_sort(F.array(*pair))
    flat = F.array_sort(F.array(*[plain(F.col(c)) for c in pair]))
    counts = df.groupBy(*group).agg(F.count_distinct(raw).alias("n_raw"), F.count_distinct(flat).alias("n_plain"))
    return counts.where("n_plain < n_raw")
