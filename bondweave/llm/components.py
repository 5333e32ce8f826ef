"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hot_keys, join_spread, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest node that each node of ``links`` can reach, as (node, root).

    Alternates the large-star and small-star steps, which keep the number of links from growing and
    shrink every component to one star in a logarithmic number of rounds. The links of a hub are never
    brought to one task: minima are aggregates that Spark combines before the shuffle, and go back to the
    links of a hub by broadcast (of the hubs only, whose number has a bound). Each round is written to the shared folder, so lineage stays short. Links to oneself and nulls are ignored;
    an empty table has no components.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    e = materialize(e, "links")
    for _ in range(max_rounds):
        rows = 2 * e.count()
        # Large star: every neighbour above u is tied to the least of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = materialize(hot_keys(least, "u", "n", rows), "hubs")
        least = least.select("u", F.least("u", "m").alias("m"))
        large = join_spread(both, least, "u", hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: neighbours below u, and u itself, are tied to the least of them.
        large = materialize(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = materialize(hot_keys(low, "u", "n", rows), "hubs")
        small = join_spread(large, low.select("u", "m"), "u", hubs).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        new = materialize(small, "links")
        same = new.join(e, ["u", "v"], "left_anti").limit(1).count() == 0 and new.count() * 2 == rows
        e = new
        if same:
            roots = e.select("v").distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
