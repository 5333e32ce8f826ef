"""Order: ordinals, runs, arrangement, limits, top-k."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import checkpoints

#: Bits that ``monotonically_increasing_id`` leaves for a row's place in its partition.
PLACE_BITS = 33


def _ranged(df: DataFrame, order_by: Sequence[str], ranges: int | None) -> tuple[DataFrame, dict[int, int]]:
    """The rows in ranges of the order, with ``_part`` and ``_place`` (from 0) in it, and the rows of each range.

    They are written once, so that places and counts speak of the same rows whatever happens to executors.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(ranges, *order_by).sortWithinPartitions(*order_by)
    kept = checkpoints.stored(sorted_.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    placed = kept.select(*df.columns, F.shiftright("_id", PLACE_BITS).cast("int").alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place"))
    return placed, {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}  # one row a range


def _before(sizes: dict[int, int]) -> Column:
    """Sum of the sizes of earlier ranges for a row's ``_part``."""
    last = max(sizes, default=0)
    sums = list(accumulate((sizes.get(p, 0) for p in range(last)), initial=0))
    return F.get(F.array(*[F.lit(x) for x in sums]), F.col("_part")).cast("long")


def with_ordinal(df: DataFrame, order_by: Sequence[str], name: str = "rn", ranges: int | None = None) -> DataFrame:
    """Number all rows from 1 in ascending order of ``order_by``, which should be a total order.

    A window without partitions would sort everything in one task. Instead Spark cuts the order into ranges
    and sorts each; a row's number is its place in its range plus the rows of the ranges before.
    """
    placed, counts = _ranged(df, order_by, ranges)
    return placed.withColumn(name, F.col("_place") + _before(counts) + 1).drop("_part", "_place")


def run_groups(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Runs of equal keys in order: (partition columns, keys, first, last), places counted from 1.

    Within a partition the place minus the place among rows of the same key is constant along a run, so
    runs are groups. Null keys equal each other. Without partition columns the places are ordinals of
    the whole table (see ``_runs_of_all``). An empty table has no runs.
    """
    if not partition_by:
        return _runs_of_all(df, keys, order_by)
    placed = df.withColumn("_at", F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by)).cast("long"))
    among = F.row_number().over(Window.partitionBy(*partition_by, *keys).orderBy("_at"))
    placed = placed.withColumn("_run", F.col("_at") - among)
    return placed.groupBy(*partition_by, *keys, "_run").agg(F.min("_at").alias("first"), F.max("_at").alias("last")).drop("_run")


def _runs_of_all(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """A run starts where a row's key differs from that of the row before it, which for a range's first row is the
    last of an earlier range: one row a range. Starts are summed within ranges, so a hot key is spread over all."""
    placed, counts = _ranged(df.select(*dict.fromkeys([*keys, *order_by])), order_by, None)
    placed = placed.withColumn("_at", F.col("_place") + _before(counts) + 1).withColumn("_key", F.struct(*keys))
    ends = placed.groupBy("_part").agg(F.max_by("_key", "_place").alias("_end"), (F.max("_at") + 1).alias("_next"))
    w = Window.partitionBy("_part").orderBy("_place")
    marked = placed.withColumn("_lag", F.lag("_key").over(w)).join(F.broadcast(ends.select("_end", "_next")), F.col("_at") == F.col("_next"), "left")
    before = F.when(F.col("_place") > 0, F.col("_lag")).otherwise(F.col("_end"))
    starts = checkpoints.stored(marked.select(*keys, "_part", "_place", "_at", (~before.eqNullSafe(F.col("_key"))).cast("int").alias("_new")), "starts")
    sums = {r["_part"]: r["n"] for r in starts.groupBy("_part").agg(F.sum("_new").alias("n")).collect()}
    runs = starts.withColumn("_run", F.sum("_new").over(w) + _before(sums))
    return runs.groupBy(*keys, "_run").agg(F.min("_at").alias("first"), F.max("_at").alias("last")).drop("_run")


def run_index(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """For each key the sorted places where its runs start, as one array; ``run_blocks`` gives those of hot keys in parts."""
    return run_groups(df, keys, order_by, partition_by).groupBy(*partition_by, *keys).agg(F.array_sort(F.collect_list("first")).alias("starts"))


def run_blocks(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (), size: int = 65_536) -> DataFrame:
    """The same in blocks of ``size`` places, so that no array holds more than so many starts."""
    runs = run_groups(df, keys, order_by, partition_by).withColumn("block", F.floor((F.col("first") - 1) / size))
    return runs.groupBy(*partition_by, *keys, "block").agg(F.array_sort(F.collect_list("first")).alias("starts"))


def zip_rows(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Columns of two tables side by side, row by row in their orders; the tables must have as many rows, and no name in common."""
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"columns of both tables: {sorted(both)}")
    a, b = with_ordinal(left, left_order, "_rn"), with_ordinal(right, right_order, "_rn")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows beside {m}")
    return a.join(b, "_rn").drop("_rn")


def delete_rows(df: DataFrame, places: Sequence[int], order_by: Sequence[str]) -> DataFrame:
    """The table without the rows at ``places`` (from 0) of its order; none listed, none deleted."""
    return with_ordinal(df, order_by, "_rn").where(~(F.col("_rn") - 1).isin(list(places))).drop("_rn") if places else df


def arrange(df: DataFrame, key: str, order_by: Sequence[str], then_by: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """Bring equal keys together, keys by their first appearance, rows of a key by ``then_by`` or as they came."""
    first = df.groupBy(key).agg(F.min(F.struct(*order_by)).alias("_first"))
    joined = df.join(first.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    fields = [F.col("_first")[c].alias(f"_first_{i}") for i, c in enumerate(order_by)]
    flat = joined.select("*", *fields).drop("_first")
    ordered = with_ordinal(flat, [*[f"_first_{i}" for i in range(len(order_by))], *then_by, *order_by], name)
    return ordered.drop(*[f"_first_{i}" for i in range(len(order_by))])


def top_k(df: DataFrame, partition_by: Sequence[str], k: int, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each partition with their rank. Spark keeps only ``k`` per task before the shuffle."""
    w = Window.partitionBy(*partition_by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def limit_rows(df: DataFrame, limit: int | float | list[int] | tuple[int, int], order_by: Sequence[str]) -> DataFrame:
    """Rows by place: the first n, the first share (0 to 1, rounded down), listed places, or a range [low, high); places count from 0."""
    if isinstance(limit, bool) or not isinstance(limit, (int, float, list, tuple)):
        raise TypeError("limit is a number, a list of places or a range")
    if isinstance(limit, int):
        return df.orderBy(*order_by).limit(limit)
    placed = with_ordinal(df, order_by, "_rn")
    place = F.col("_rn") - 1
    if isinstance(limit, float):
        if not 0 <= limit <= 1:
            raise ValueError("a share lies between 0 and 1")
        keep = place < math.floor(limit * df.count())
    elif isinstance(limit, list):
        keep = place.isin(limit) if limit else F.lit(False)
    else:
        keep = (place >= limit[0]) & (place < limit[1])
    return placed.where(keep).drop("_rn")


def complement(df: DataFrame, places: DataFrame, name: str = "id") -> DataFrame:
    """Rows of ``df`` whose ``name`` is not among those of ``places``."""
    return df.join(places.select(name).distinct(), name, "left_anti")


def delete_places(array: Column, places: Sequence[int]) -> Column:
    """An array without the elements at ``places`` (from 0); none listed, none deleted."""
    return F.filter(array, lambda x, i: ~i.isin(list(places))) if places else array


def sort_by(df: DataFrame, *keys: tuple[str, str | None, bool]) -> DataFrame:
    """Sort by (column, type to compare as or None, descending) in turn."""
    order = [(F.col(c).cast(t) if t else F.col(c)) for c, t, _ in keys]
    return df.orderBy(*[o.desc() if d else o.asc() for o, (_, _, d) in zip(order, keys)])
