import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bondweave.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
BIG = 2**63 - 1


def plain(rows, is_anchor, k=10, n_positives=5, low=30, high=90):
    """Every anchor beside every row, in Python's integers."""
    part = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    part = [(i, l, [max(-BIG - 1, min(BIG, x)) for x in v]) for i, l, v in part]
    out = []
    for at, (anchor, label, a) in enumerate(part):
        if anchor is None or not is_anchor(anchor):
            continue
        score = lambda v: max(-BIG, min(BIG, sum(x * y for x, y in zip(a, v))))
        scored = sorted((-score(v), i is None, i or 0, i, l) for n, (i, l, v) in enumerate(part) if n != at)
        for neg_p, _, _, p, _ in [s for s in scored if s[4] == label][:n_positives]:
            fits = [s for s in scored if s[4] != label and low * -neg_p <= 100 * -s[0] <= high * -neg_p][:k]
            out += [(anchor, p, r + 1, s[3], -neg_p, -s[0]) for r, s in enumerate(fits)]
    return sorted(map(str, out))


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS uid", "2 AS v", "3 AS score")
    return sorted(str(tuple(r)) for r in hard_negatives.mine(hard_negatives.integer_vectors(df), F.col("id") % 10 == 0, **how).collect())


@pytest.mark.parametrize("sizes", [(16_384, 1_024, 64), (7, 3, 2)])
def test_against_every_row(spark, monkeypatch, sizes):
    for name, n in zip(("BLOCK_ROWS", "BLOCK_ANCHORS", "AT_ONCE"), sizes):
        monkeypatch.setattr(hard_negatives, name, n)
    rnd = random.Random(2)
    few = [-0.5, -0.004, 0.0, 0.1, 0.25, 0.5, 0.9]  # many ties
    rows = [(i, [rnd.choice(few) for _ in range(4)], rnd.choice([0, 0, 0, 1, 2])) for i in rnd.sample(range(1000), 150)]
    rows += [(10, [0.5] * 4, 0), (10, [0.5] * 4, 0), (10, [0.5] * 4, 1), (20, [0.25] * 4, 7), (None, [0.9] * 4, 0), (None, [0.3] * 4, 1)]
    rows += [(30, None, 1), (31, [0.5] * 4, None), (40, [0.1, None, 0.1, 0.1], 1), (41, [math.nan] * 4, 1), (42, [math.inf] * 4, 1), (43, [-math.inf, 0.0, 0.0, 0.0], 2)]
    rows += [(50, [], 1), (51, [0.5], 1), (60, [0.5] * 7, 1)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, k=3, n_positives=2, low=-50, high=100) == plain(rows, lambda i: i % 10 == 0, 3, 2, -50, 100)


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(0, [1e10, 3.0], 0), (1, [1e10, 2.0], 0), (2, [0.8e10, 1.0], 1), (3, [0.8e10, 1.1], 1), (4, [1e300, 0.0], 0), (5, [1e17, 1e17], 1), (10, [1e17, -1e300], 1), (6, [1e5, 1e3], 0), (7, [1e4, 5.0], 1)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_empty_no_anchor_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 0), (2, [0.4], 1)]) == []
    assert mined(spark, [(i, [0.5], 0) for i in range(20)]) == []


def test_hot_label_does_not_gather_in_a_task(spark):
    rows = spark.range(4000).selectExpr("id AS vec_id", "array(rand(1), rand(2)) AS embedding", "int(id % 40 == 1) AS label")
    got = hard_negatives.mine(hard_negatives.integer_vectors(rows), F.col("id") % 1000 == 0)
    assert {r["anchor_id"] for r in got.collect()} <= {0, 1000, 2000, 3000}


def test_reading_stops_within_the_limits():
    negated = np.array([-9, -8, -8, -5, -5, -1, 3])
    wanted = np.array([True, False, True, True, True, True, True])
    assert hard_negatives.read_below(negated, np.arange(7), wanted, 2, 8, 2).tolist() == [2, 3]
    assert hard_negatives.read_below(negated, np.arange(7), wanted, -3, 8, 10).tolist() == [2, 3, 4, 5, 6]
    assert hard_negatives.read_below(negated, np.arange(7), wanted, 10, 20, 2).tolist() == []
    assert hard_negatives.limits(10, 30, 90) == (3, 9) and hard_negatives.limits(7, 30, 90) == (3, 6) and hard_negatives.limits(-10, 30, 90) == (-3, -9)
