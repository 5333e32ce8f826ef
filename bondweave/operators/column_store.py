"""Features by column: blocks of rows, each kept sparse or dense by how full its column is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, so that no array is longer.
BLOCK = 65_536
# Fixed value: below this share of values that are not zero a column is kept sparse.
DENSITY = 0.0075


def to_columns(df: DataFrame, row: str, values: Column, block: int = BLOCK, density: float = DENSITY) -> DataFrame:
    """(column, block, sparse, first, gaps, values) from rows numbered by ``row`` (from 0) and ``values``, an array of struct(column, value).

    Values of zero and nulls are not kept. Of a sparse column a block has its first row, the distances between the following
    ones, and their values; of a dense one all values of the block up to its last one that is not zero, from its first row on. How full a
    column is counts over the whole table. A hot column is cut into blocks like any other.
    """
    each = df.select(F.col(row).cast("long").alias("row"), F.inline(values.cast("array<struct<column:bigint,value:double>>")))
    each = each.where("value <> 0")
    n_rows = df.count()
    full = each.groupBy("column").agg(F.count(F.lit(1)).alias("n")).select("column", (F.col("n") < F.lit(density) * n_rows).alias("sparse"))
    blocks = each.groupBy("column", F.floor(F.col("row") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("cells"))
    joined = blocks.join(full, "column")
    first = F.when(F.col("sparse"), F.col("cells")[0]["row"]).otherwise(F.col("block") * block)
    gaps = F.transform(F.sequence(F.lit(1), F.size("cells") - 1), lambda i: F.get("cells", i)["row"] - F.get("cells", i - 1)["row"])
    # Zeros up to each value, then the value: linear in the block.
    before = lambda i: F.coalesce(F.get("cells", i - 2)["row"], F.col("block") * block - 1)
    padded = lambda i: F.concat(F.array_repeat(F.lit(0.0), (F.get("cells", i - 1)["row"] - before(i) - 1).cast("int")), F.array(F.get("cells", i - 1)["value"]))
    dense = F.flatten(F.transform(F.sequence(F.lit(1), F.size("cells")), padded))
    none = F.array().cast("array<bigint>")
    return joined.select("column", "block", "sparse", first.alias("first"), F.when(F.col("sparse") & (F.size("cells") > 1), gaps).otherwise(none).alias("gaps"), F.when(F.col("sparse"), F.transform("cells", lambda c: c["value"])).otherwise(dense).alias("values"))


def from_columns(store: DataFrame) -> DataFrame:
    """(row, column, value): what the store keeps, without zeros."""
    each = store.where("sparse").select("column", "block", "first", "values", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "gaps")).alias("k", "gap"))
    each = each.select("column", "block", "first", F.get("values", F.col("k")).alias("value"), "k", "gap")
    steps = F.sum("gap").over(Window.partitionBy("column", "block").orderBy("k"))  # a block's rows, no more
    sparse = each.select((F.col("first") + steps).alias("row"), "column", "value")
    dense = store.where("NOT sparse").select("column", "first", F.posexplode("values").alias("k", "value")).select((F.col("first") + F.col("k")).alias("row"), "column", "value")
    return sparse.unionByName(dense.where("value <> 0"))
