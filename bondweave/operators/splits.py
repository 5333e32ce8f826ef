"""Exact seeded splits by row, molecule or bond."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import with_ordinal

# The linear congruential step that ranks keys alike in any engine.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2147483648


def key_rank(key: str, seed: int) -> Column:
    """A seeded pseudo-random number below 2^31 from an integer key."""
    return F.pmod(F.col(key).cast("long") * MULTIPLIER + seed * INCREMENT, F.lit(MODULUS))


def share_of(ratio: int | float, total: int, golden: bool = False) -> float:
    """A partition's share of ``total`` keys: a count as it is, a share as it is, or total ** ratio keys under the golden rule."""
    if total <= 0:
        return 0.0
    if isinstance(ratio, int) and not isinstance(ratio, bool):
        if not 0 <= ratio <= total:
            raise ValueError(f"{ratio} of {total} keys")
        return ratio / total
    if not 0 <= ratio <= 1:
        raise ValueError("a share lies between 0 and 1")
    return int(total**ratio) / total if golden and ratio else float(ratio)


def split_shares(ratio: Sequence[float] | float | int, total: int, golden: bool = False, transfer: float = 1.0) -> tuple[float, float, float]:
    """Shares of (train, validation, test). Three numbers are scaled to sum to one; one number is the held-out
    share, of which ``transfer`` goes to validation and the rest to test."""
    if isinstance(ratio, (int, float)):
        held = share_of(ratio, total, golden)
        return 1 - held, held * transfer, held * (1 - transfer)
    if len(ratio) != 3 or min(ratio) < 0 or not sum(ratio):
        raise ValueError("three shares that are not negative, and not all 0")
    return tuple(r / sum(ratio) for r in ratio)


@dataclass(frozen=True)
class SplitPlan:
    """``held`` and ``second`` are the shares of keys for test and validation; ``cut`` is how the second is taken:
    ``shuffled`` (by the same random rank), ``bottom`` or ``top`` (the least or greatest keys of the rest).
    ``overlap`` also leaves the second cut in train."""

    held: float
    second: float = 0.0
    cut: str = "shuffled"
    overlap: bool = False
    seed: int = 42

    def __post_init__(self):
        if self.cut not in ("shuffled", "bottom", "top"):
            raise ValueError(self.cut)
        if not (0 <= self.held <= 1 and 0 <= self.second <= 1 and self.held + self.second <= 1):
            raise ValueError("shares of held-out keys sum to 1 at most")


def split_keys(keys: DataFrame, key: str, plan: SplitPlan) -> DataFrame:
    """(key, split) for distinct integer keys: exactly ceil(share * keys) of them go to each held-out part.

    Ranks come from ranges that are numbered on their own, so no task sorts all keys; any partitioning
    of the input gives the same split.
    """
    keys = keys.select(key).distinct()
    n = keys.count()
    n_test = math.ceil(round(plan.held * n, 9))
    n_val = min(math.ceil(round(plan.second * n, 9)), n - n_test)
    ranked = with_ordinal(keys.withColumn("_rank", key_rank(key, plan.seed)), ["_rank", key], "_rn")
    if plan.cut == "shuffled" or not n_val:
        split = F.when(F.col("_rn") <= n_test, "test").when(F.col("_rn") <= n_test + n_val, "val").otherwise("train")
        out = ranked.select(key, split.alias("split"))
    else:
        rest = with_ordinal(ranked.where(F.col("_rn") > n_test).select(key), [key], "_at")
        second = F.col("_at") <= n_val if plan.cut == "bottom" else F.col("_at") > n - n_test - n_val
        out = rest.select(key, F.when(second, "val").otherwise("train").alias("split")).unionByName(ranked.where(F.col("_rn") <= n_test).select(key, F.lit("test").alias("split")))
    if plan.overlap:
        out = out.unionByName(out.where("split = 'val'").select(key, F.lit("train").alias("split")))
    return out


def split_by(df: DataFrame, key: str, plan: SplitPlan) -> DataFrame:
    """All rows of a key move together; adds ``split``."""
    return df.join(split_keys(df, key, plan), key)


def drop_repeats_from_held_out(df: DataFrame, seen_by: Sequence[str], to_train: bool = False) -> DataFrame:
    """Held-out rows whose ``seen_by`` also occur in train are dropped, or moved to train."""
    in_train = df.where("split = 'train'").select(*[F.col(c).alias(f"_{c}") for c in seen_by]).distinct().withColumn("_seen", F.lit(True))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in seen_by]
    joined = df.join(in_train, same, "left").drop(*[f"_{c}" for c in seen_by])
    leak = F.col("_seen").isNotNull() & (F.col("split") != "train")
    return (joined.withColumn("split", F.when(leak, "train").otherwise(F.col("split"))) if to_train else joined.where(~leak)).drop("_seen")


def slice_split(df: DataFrame, order_by: Sequence[str], dev: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    """Rows at places [low, high) go to dev and test, all others to train; places count from 0."""
    place = F.col("_rn") - 1
    inside = lambda r: (place >= r[0]) & (place < r[1])
    split = F.when(inside(test), "test").when(inside(dev), "val").otherwise("train")
    return with_ordinal(df, order_by, "_rn").withColumn("split", split).drop("_rn")


def masks(df: DataFrame, splits: Sequence[str], split: str = "split") -> tuple[DataFrame, DataFrame]:
    """Rows of any of ``splits``, and all others; a row without a split is among the others. Both keep repeated rows."""
    inside = F.coalesce(F.col(split).isin(list(splits)), F.lit(False)) if splits else F.lit(False)
    return df.where(inside), df.where(~inside)


def share_rows(df: DataFrame, rows: Column, to: str, split: str = "split") -> DataFrame:
    """All rows, and a copy of those that hold ``rows`` in the split ``to``; rows that are there already are not copied."""
    moved = df.where(F.coalesce(rows, F.lit(False)) & ~F.col(split).eqNullSafe(F.lit(to)))
    return df.unionByName(moved.withColumn(split, F.lit(to)))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").count()


def sort_splits(df: DataFrame, order_by: Sequence[str], split: str = "split", name: str = "place") -> DataFrame:
    """Rows of each split numbered from 0 in order. The whole is cut into ranges of (split, order), so a split of most rows is no single task."""
    ranked = with_ordinal(df, [split, *order_by], "_rn")
    first = F.broadcast(ranked.groupBy(F.col(split).alias("_of")).agg(F.min("_rn").alias("_first")))  # one row a split
    return ranked.join(first, F.col(split).eqNullSafe(F.col("_of"))).withColumn(name, F.col("_rn") - F.col("_first")).drop("_rn", "_of", "_first")


#: What moves together in each mode of a split.
MODES = {"sample": ("row",), "molecule": ("mol",), "bond": ("mol", "bidx")}


def split_mode(df: DataFrame, mode: str, plan: SplitPlan, order_by: Sequence[str]) -> DataFrame:
    """Split by one of MODES; adds ``split``. Keys of several columns, and rows, are numbered first, so that any types will do."""
    if mode not in MODES:
        raise ValueError(f"{mode!r} is none of {sorted(MODES)}")
    if mode == "molecule":
        return split_by(df, "mol", plan)
    if mode == "sample":
        return split_by(with_ordinal(df, order_by, "_key"), "_key", plan).drop("_key")
    keys = with_ordinal(df.select(*MODES[mode]).distinct(), MODES[mode], "_key")
    split = keys.join(split_keys(keys, "_key", plan), "_key").drop("_key")
    return df.join(split, list(MODES[mode]))
