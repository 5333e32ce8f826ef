"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, utf8_size

N_SHARDS = 40
#: Rows that one logical partition, and one block of a shard, hold on average; with more than MAX_PARTS of
#: them the partitions grow instead, so the matrix on the driver stays within MAX_PARTS times the shards.
PART_ROWS, MAX_PARTS = 4096, 50_000
#: Populations from which numpy draws hypergeometric variates.
NUMPY_LIMIT = 10**9


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard, drawn exactly as a uniform shuffle of all rows would.

    Shard sizes are at most one apart, the first ones larger. Row by row, a partition's rows are a draw
    without replacement from the places that are left in the shards.
    """
    total = sum(counts)
    left = np.array([total // n_shards + (j < total % n_shards) for j in range(n_shards)], np.int64)
    rng = np.random.default_rng(seed)
    rows = np.zeros((len(counts), n_shards), np.int64)
    for i, n in enumerate(counts):
        # One shard after the other, each against all that are left.
        rest, need = int(left.sum()), int(n)
        for j in range(n_shards):
            rest -= int(left[j])
            got = _draw(rng, int(left[j]), rest, need)
            rows[i, j], need = got, need - got
        left -= rows[i]
    return rows


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric variate, exact for populations of any size.

    Beyond numpy's limit a binomial variate is accepted with the ratio of the two laws to its maximum, so
    the time does not depend on ``n``. The ratio is nearly constant, as a partition's rows are few beside
    the population; of a larger draw the complement is drawn.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    if 2 * n > total:
        return good - _draw(rng, good, bad, total - n)

    def log_ratio(k: int) -> float:
        return _log_falling(good, k) + _log_falling(bad, n - k)

    # The ratio is log-concave in k and rises up to this k.
    top = log_ratio(min(max(good * (n - 1) // total + 1, n - bad, 0), n, good))
    while True:
        k = int(rng.binomial(n, good / total))
        if n - bad <= k <= good and math.log(1 - rng.random()) <= log_ratio(k) - top:
            return k


def _log_falling(g: int, k: int) -> float:
    """Logarithm of g (g - 1) ... (g - k + 1) / g^k; by Stirling's series where terms would cancel."""
    if g - k < 1_000_000:
        return math.lgamma(g + 1) - math.lgamma(g - k + 1) - k * math.log(g)
    return -(g - k + 0.5) * math.log1p(-k / g) - k + (1 / g - 1 / (g - k)) / 12


def shard(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 11, part_rows: int = PART_ROWS, id_col: str = "doc_id") -> DataFrame:
    """Deal all rows of ``docs`` to shards uniformly at random; adds ``shard`` and ``slot`` to all columns.

    Shard sizes are at most one apart, and slots run from 0 without gaps in each shard. Steps: rows fall
    into logical partitions by a hash of all their columns, so neither an id nor a text of very many rows
    gathers in one; the counts of these (all that reaches the driver) give the communication matrix; each
    partition permutes its rows by hash and cuts them into shares by its row of the matrix; the exchange brings rows to blocks of shards; each block permutes again. Block sizes
    follow from the counts alone, so no second look at the data is needed to number the slots.

    Everything depends on the rows and ``seed`` only: lost executors, reruns and other partitionings
    give the same rows. Repeated rows are told apart by their place among equals, and where one row is repeated more
    often than a partition has rows, its copies are dealt to the partitions in turn; nulls hash like values;
    with fewer rows than shards some shards stay empty; an empty table gives no rows; columns that are
    named ``shard`` or ``slot`` are replaced, others keep their values whatever their names; texts may be of any length.
    Rows are dealt singly: a group of equal texts can be larger than a shard, so whole groups and counts at most one
    apart exclude each other.
    """
    cols = [c for c in docs.columns if c not in ("shard", "slot")]
    total = docs.select(id_col).count()
    parts = min(MAX_PARTS, max(1, -(-total // part_rows)))

    part_of = F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(parts)).cast("int")
    packed = docs.select(F.struct(*cols).alias("row"), part_of.alias("_part"), F.xxhash64(F.lit(seed + 2), *cols).alias("_h"), F.col(id_col).alias("_id"))
    per_part = {r["_part"]: r["n"] for r in packed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = 2 * max(part_rows, total // parts)
    over = [i for i, n in per_part.items() if n > full]
    if over:
        packed, per_part = _spread_equal_rows(packed, per_part, over, parts, full)
    counts = [per_part.get(i, 0) for i in range(parts)]
    matrix = communication_matrix(counts, n_shards, seed)
    spark = docs.sparkSession
    ends = matrix.cumsum(axis=1).tolist()
    shares = spark.createDataFrame([(i, e) for i, e in enumerate(ends)], "_part int, _ends array<bigint>")

    blocks = min(MAX_PARTS // n_shards + 1, max(1, -(-total // (n_shards * part_rows))))
    block_of = F.pmod(F.xxhash64(F.lit(seed + 1), "_part", "_rn"), F.lit(blocks)).cast("int")
    shard_of = F.size(F.filter("_ends", lambda e: e < F.col("_rn")))
    # Places (part, rn) are known from the counts; count them by block for the offsets of slots.
    places = spark.createDataFrame([(i, n, e) for i, (n, e) in enumerate(zip(counts, ends)) if n], "_part int, _n bigint, _ends array<bigint>")
    places = places.repartition(min(parts, 1000)).select("_part", "_ends", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_rn"))
    in_block = places.select(shard_of.alias("shard"), block_of.alias("_block")).groupBy("shard", "_block").count()
    offsets = in_block.select("shard", "_block", (F.sum("count").over(Window.partitionBy("shard").orderBy("_block")) - F.col("count")).alias("_offset"))

    # Numbered in the order of their hashes first, then permuted by these numbers, so equal rows do not stay side by side.
    numbered = packed.withColumn("_no", F.row_number().over(Window.partitionBy("_part").orderBy("_h", "_id")))
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 4), "_part", "_no"), "_no")
    dealt = numbered.withColumn("_rn", F.row_number().over(local))
    dealt = dealt.join(shares, "_part").withColumn("shard", shard_of).withColumn("_block", block_of)
    again = Window.partitionBy("shard", "_block").orderBy(F.xxhash64(F.lit(seed + 3), "_part", "_rn"), "_part", "_rn")
    return dealt.withColumn("_at", F.row_number().over(again)).join(offsets, ["shard", "_block"]).select("row.*", "shard", (F.col("_offset") + F.col("_at") - 1).alias("slot"))


def _spread_equal_rows(packed: DataFrame, per_part: dict[int, int], over: list[int], parts: int, full: int) -> tuple[DataFrame, dict[int, int]]:
    """The rows with the copies of any row that ``full`` others equal dealt to the partitions in turn, and the counts that follow.

    Copies are alike, so one stands for all: it is kept with their number, and they are made again where they are dealt.
    There are no more such rows than partitions.
    """
    rows = packed.where(F.col("_part").isin(over)) if len(over) <= 1000 else packed
    groups = rows.groupBy("_part", "_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > full)
    groups = materialize(groups, "equal-rows")
    counts = dict(per_part)
    for r in groups.collect():
        counts[r["_part"]] -= r["_n"]
        for k in range(min(parts, r["_n"])):
            at = (r["_part"] + k) % parts
            counts[at] = counts.get(at, 0) + r["_n"] // parts + (k < r["_n"] % parts)
    hot = F.broadcast(groups)
    cold = packed.join(hot.select("_part", "_h"), ["_part", "_h"], "left_anti")
    one = packed.join(hot.select("_part", "_h"), ["_part", "_h"], "left_semi").groupBy("_part", "_h").agg(F.first("row").alias("row"), F.first("_id").alias("_id"))
    turns = one.join(hot, ["_part", "_h"]).withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(parts)).cast("int") - 1)))
    turns = turns.withColumn("_times", F.floor(F.col("_n") / parts) + (F.col("_k") < F.col("_n") % parts).cast("int"))
    again = turns.select("row", F.pmod(F.col("_part") + F.col("_k"), F.lit(parts)).cast("int").alias("_part"), "_h", "_id", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_c")).drop("_c")
    return cold.unionByName(again), counts


def sharded_digest(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The contract's digest of ``shard``: the size is the text's UTF-8 bytes plus 16."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (utf8_size(F.col("text")) + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = shard(narrow, n_shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
