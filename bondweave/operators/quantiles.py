"""Exact quantiles of groups of any size: radix selection by nested histograms, no task with a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import checkpoints

#: Bits that one level of histograms resolves; together the 64 of a double.
LEVEL_BITS = (13, 13, 13, 13, 12)
#: Groups of at most so many distinct values are settled by one window over these.
FEW = 1 << 16


def ordered_bits(value: Column) -> Column:
    """A long whose unsigned order is that of doubles: -inf to inf, then NaN; both zeros are one."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    lowest = F.lit(-(2**63))
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(lowest))


def _top(key: str, n: int) -> Column:
    return F.shiftrightunsigned(F.col(key), 64 - n) if n else F.lit(0).cast("long")


def order_statistics(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, rank, v): the value at place ``rank`` (from 0) of each group's order.

    ``values``: (g, v, n), distinct doubles of each group with their counts; ``wanted``: (g, rank). Each level counts the values
    of the buckets that still hold a wanted place, by the next bits of the value, and finds the finer bucket of each; a place
    is settled once its bucket has one value. Counts are summed up before they are shuffled, so a group's size does not matter.
    """
    keyed = checkpoints.stored(values.select("g", "v", "n", ordered_bits(F.col("v")).alias("key")), "quantile-keys")
    state = wanted.select("g", "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("prefix"))
    settled, seen = [], 0
    for level, width in enumerate(LEVEL_BITS):
        boxes = state.select("g", "prefix").distinct()
        inside = keyed.withColumn("prefix", _top("key", seen)).join(boxes, ["g", "prefix"], "left_semi")
        hist = inside.groupBy("g", "prefix", _top("key", seen + width).alias("next")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy("g", "prefix").orderBy("next")
        hist = hist.withColumn("upto", F.sum("n").over(w))
        found = state.join(hist, ["g", "prefix"]).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        one = F.col("low").eqNullSafe(F.col("high")) | F.lit(level == len(LEVEL_BITS) - 1)
        found = checkpoints.stored(found.select("g", "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("next").alias("prefix"), F.col("low").alias("v"), one.alias("one")), "quantile-boxes")
        settled.append(found.where("one").select("g", "rank", "v"))
        state = found.where("NOT one").select("g", "rank", "left", "prefix")
        seen += width
        if not state.limit(1).count():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def exact_quantiles(df: DataFrame, value: Column, shares: Sequence[float], by: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """(by, quantiles): for each group the quantiles at ``shares`` (0 to 1) as an array, by linear interpolation between the two nearest places.

    Nulls don't count; a group without a value has no row; NaN comes last. Values are compared as doubles. Distinct values
    are counted first. Groups of ``few`` of them at most are read off one window over these counts, which that bounds;
    if any has more, all go by radix selection (``order_statistics``), with the same results.
    """
    if not all(0 <= s <= 1 for s in shares):
        raise ValueError("a share lies between 0 and 1")
    group = F.struct(*[F.col(b).alias(f"c{i}") for i, b in enumerate(by)]) if by else F.struct(F.lit(0).alias("c0"))
    rows = df.select(group.alias("g"), (value.cast("double") + F.lit(0.0)).alias("v")).where("v IS NOT NULL")
    counts = checkpoints.stored(rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    sizes = counts.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    at = [(F.col("total") - 1) * F.lit(float(s)) for s in shares]
    most = sizes.agg(F.max("distinct")).first()[0] or 0
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in at])))
    wanted = sizes.select("g", F.explode(places).alias("rank"))
    if most <= few:
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("v")))
        meets = (F.col("g") == F.col("_g")) & (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))
        found = upto.join(wanted.select(F.col("g").alias("_g"), "rank"), meets).select("g", "rank", "v")
    else:
        found = order_statistics(counts, wanted)
    read = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))
    joined = sizes.join(read, "g")

    def between(p: Column) -> Column:
        low, high = F.floor(p), F.ceil(p)
        return F.when(low == high, F.col("of")[low]).otherwise((high - p) * F.col("of")[low] + (p - low) * F.col("of")[high])

    return joined.select(*[F.col("g")[f"c{i}"].alias(b) for i, b in enumerate(by)], F.array(*[between(p) for p in at]).alias("quantiles"))
