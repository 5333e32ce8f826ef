import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bondweave.operators import quantiles, stats

SHARES = (0.0, 0.1, 0.25, 0.5, 0.95, 0.999, 1.0)


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_equals_numpy(spark, few):
    rnd = random.Random(5)
    groups = {
        "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) for _ in range(500)],
        "near": [1.0 + i * 2.0**-52 for i in range(300)],
        "ties": [rnd.choice([-1.5, 0.0, -0.0, 2.0]) for _ in range(400)],
        "one": [7.25],
        None: [float(i) for i in range(11)],
        "ends": [-math.inf, math.inf, 1.0, 5e-324, -5e-324],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    rnd.shuffle(rows)
    got = {r.k: r.quantiles for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), F.col("v"), SHARES, ["k"], few).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        xs = sorted(vs)
        for s, q in zip(SHARES, got[g]):
            p = s * (len(xs) - 1)
            lo, hi = math.floor(p), math.ceil(p)
            want = xs[lo] if lo == hi else (hi - p) * xs[lo] + (p - lo) * xs[hi]
            assert q == want or (math.isnan(q) and math.isnan(want)), (g, s, q, want)


def test_equals_sparks_own_percentile(spark):
    df = spark.range(20_000).selectExpr("id % 3 AS k", "sin(id) * 1000 AS v")
    want = {r.k: list(r.p) for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("p")).collect()}
    assert {r.k: list(r.quantiles) for r in quantiles.exact_quantiles(df, F.col("v"), SHARES, ["k"], few=10).collect()} == want


def test_bits_keep_the_order(spark):
    values = [-math.inf, -1e300, -2.0, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, math.inf, math.nan]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    keys = [r.k & (2**64 - 1) for r in df.select("i", quantiles.ordered_bits(F.col("v")).alias("k")).orderBy("i").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_no_values_and_bad_shares(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert quantiles.exact_quantiles(none, F.col("v"), [0.5]).collect() == []
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(none, F.col("v"), [1.5])
    row = stats.summary(none, "v").collect()
    assert [r.n for r in row] == [0] and row[0].p95 is None
    assert [r.n for r in stats.density_profile(none, F.col("v")).collect()] == [0]


def test_a_hot_group_meets_no_single_task(spark):
    """The plan of a level sums counts before it shuffles them."""
    df = spark.range(5000).selectExpr("'hot' AS k", "rand(3) AS v")
    got = quantiles.exact_quantiles(df, F.col("v"), [0.5], ["k"], few=100).first()
    assert abs(got.quantiles[0] - np.median([r.v for r in df.collect()])) < 1e-12
