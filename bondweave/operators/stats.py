"""Aggregates: weighted means, density, histograms, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

# The weight of recommended rows by the number of others (1, 2, 3, 4 and more), the tails
# of a density profile, and the limits of the published error shares.
RULE_WEIGHTS = (0.8, 0.7, 0.6, 0.5)
TAILS = (90.0, 95.0, 97.5, 99.0, 99.5, 99.9, 99.99)
SHARE_BELOW, SHARE_ABOVE = (1.0, 2.5), (5.0, 10.0)


def rule_mean(df: DataFrame, keys: Sequence[str], values: dict[str, int], recommended: str, max_recommended: int = 2) -> DataFrame:
    """Group means in which recommended rows weigh more.

    With 1 to ``max_recommended`` recommended rows beside others, their mean weighs RULE_WEIGHTS by the
    number of others, and the others' mean the rest; with none or only recommended rows the plain mean
    counts; other groups have no rule and are left out. ``values`` maps columns to digits (half to even).
    """
    rec = F.col(recommended) == 1
    aggs = [F.count_if(rec).alias("_r"), F.count(F.lit(1)).alias("_n")]
    for v in values:
        aggs += [F.avg(F.when(rec, F.col(v))).alias(f"_{v}_r"), F.avg(F.when(~rec, F.col(v))).alias(f"_{v}_o"), F.avg(v).alias(f"_{v}_a")]
    g = df.groupBy(*keys).agg(*aggs)
    others = F.col("_n") - F.col("_r")
    w = F.element_at(F.array(*[F.lit(x) for x in RULE_WEIGHTS]), F.least(others, F.lit(len(RULE_WEIGHTS))).cast("int"))
    plain = (F.col("_r") == 0) | (others == 0)
    g = g.where(plain | (F.col("_r") <= max_recommended))
    out = [F.bround(F.when(plain, F.col(f"_{v}_a")).otherwise(w * F.col(f"_{v}_r") + (1 - w) * F.col(f"_{v}_o")), d).alias(v) for v, d in values.items()]
    return g.select(*keys, *out, (-F.col("_r")).cast("long").alias("recommend"))


def _quantiles_of_all(df: DataFrame, column: str, shares: Sequence[float]) -> Column:
    """The quantiles of the whole table, one row, as a constant."""
    row = exact_quantiles(df, F.col(column), shares).first()
    return F.array(*[F.lit(q).cast("double") for q in (row["quantiles"] if row else [None] * len(shares))])


def density_profile(df: DataFrame, size: Column, tails: Sequence[float] = TAILS) -> DataFrame:
    """One row: count, minimum, maximum, mean and population deviation of a row's size, and exact percentiles of both tails, cut to
    whole numbers. No task holds the sizes of all rows (see ``quantiles``); an empty table has nulls."""
    shares = [(100 - t) / 100 for t in tails] + [t / 100 for t in tails]
    d = df.select(size.cast("double").alias("d"))
    p = d.agg(F.count("d").alias("n"), F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std")).withColumn("p", _quantiles_of_all(d, "d", shares))
    names = [f"l{str(t).replace('.', '_')}" for t in tails] + [f"r{str(t).replace('.', '_')}" for t in tails]
    return p.select("n", "min", "max", "mean", "std", *[F.col("p")[i].cast("long").alias(c) for i, c in enumerate(names)])


def histogram(df: DataFrame, error: str, interval: float = 0.25, top: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows by bins of the absolute error; what reaches ``top`` is in one last bin."""
    b = F.least(F.floor(F.abs(error) / interval), F.lit(int(top / interval))).cast("long").alias("bin")
    return df.groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"))


def quality_report(df: DataFrame, error: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error, root mean square error, and percentages of rows below and above the published limits."""
    e = F.abs(error)
    pct = lambda c: F.lit(100.0) * F.avg(c.cast("double"))
    name = lambda x: str(x).rstrip("0").rstrip(".").replace(".", "_")
    aggs = [F.count(error).alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse")]
    aggs += [pct(e < x).alias(f"below_{name(x)}") for x in SHARE_BELOW] + [pct(e > x).alias(f"above_{name(x)}") for x in SHARE_ABOVE]
    return df.groupBy(*by).agg(*aggs)


def class_profile(df: DataFrame, cls: str, mol: str) -> DataFrame:
    """Rows and molecules of each class, with their percentages of all."""
    total = df.agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(mol).alias("_mols"))
    g = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(mol).alias("n_mols"))
    g = g.crossJoin(F.broadcast(total))  # one row
    return g.select(cls, "n_rows", "n_mols", (100.0 * F.col("n_rows") / F.col("_rows")).alias("pct_rows"), (100.0 * F.col("n_mols") / F.col("_mols")).alias("pct_mols"))


def count_by(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def summary(df: DataFrame, column: str, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """n, mean, population deviation, minimum, maximum, 95th and 99th percentile.

    Percentiles are exact, by radix selection where a group has very many distinct values (see ``quantiles``). With
    ``accuracy`` they come from sketches of bounded size in one pass, within 1 / accuracy of the rank.
    """
    shares = (0.95, 0.99)
    basic = [F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")]
    if accuracy is not None:
        g = df.groupBy(*by).agg(*basic, F.percentile_approx(column, F.array(*map(F.lit, shares)), F.lit(accuracy)).alias("_p"))
    elif not by:
        g = df.agg(*basic).withColumn("_p", _quantiles_of_all(df, column, shares))
    else:
        keyed = df.select(F.struct(F.lit(1), *by).alias("_g"), *by, column)
        g = keyed.groupBy("_g", *by).agg(*basic)
        g = g.join(exact_quantiles(keyed, F.col(column), shares, ["_g"]).withColumnRenamed("quantiles", "_p"), "_g", "left").drop("_g")
    return g.select("*", F.col("_p")[0].alias("p95"), F.col("_p")[1].alias("p99")).drop("_p")


def best_row(df: DataFrame, column: str, tie: str, largest: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The ``tie`` value of the row with the least (or largest) ``column``; the first one on ties."""
    order = F.struct((-F.col(column) if largest else F.col(column)).alias("v"), F.col(tie).alias("t"))
    return df.groupBy(*by).agg(F.min_by(tie, order).alias(f"best_{tie}"), (F.max(column) if largest else F.min(column)).alias(f"best_{column}"))


def min_max_scale(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0, name: str = "scaled") -> DataFrame:
    """A column scaled to [low, high] by its extremes, which come from one small aggregate; a constant column is ``low``."""
    ends = F.broadcast(df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")))  # one row
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    scaled = F.coalesce((high - low) * (F.col(column) - F.col("_lo")) / span, F.when(F.col(column).isNotNull(), F.lit(0.0))) + low
    return df.crossJoin(ends).withColumn(name, scaled).drop("_lo", "_hi")


def gaps(train: str, val: str) -> list[Column]:
    """Difference of two metrics, and the signed root of it."""
    d = F.col(val) - F.col(train)
    return [d.alias("gap"), (F.signum(d) * F.sqrt(F.abs(d))).alias("root_gap")]


def block_offsets(df: DataFrame, order: str, size: str) -> DataFrame:
    """Start and end (exclusive) of blocks laid end to end; one row for each block of a configuration, so few."""
    end = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("end", end).withColumn("start", F.col("end") - F.col(size))
