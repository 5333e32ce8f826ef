import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bondweave.llm import sharding


def test_matrix_margins():
    for counts, shards in (([5, 0, 7, 100], 3), ([1], 40), ([0, 0], 4), ([10] * 50, 7)):
        m = sharding.communication_matrix(counts, shards, 1)
        assert m.sum(axis=1).tolist() == counts
        sizes = m.sum(axis=0)
        assert sizes.max() - sizes.min() <= 1 and (m >= 0).all()


def test_matrix_is_hypergeometric():
    """The first cell over many seeds has the mean and variance of a uniform shuffle."""
    first = np.array([sharding.communication_matrix([30, 70], 4, s)[0, 0] for s in range(4000)])
    n, good, total = 30, 25, 100
    assert abs(first.mean() - n * good / total) < 0.15
    assert abs(first.var() - n * good / total * (1 - good / total) * (total - n) / (total - 1)) < 0.3


def test_large_populations():
    rng = np.random.default_rng(0)
    got = [sharding._draw(rng, 3 * 10**9, 10**9, 200) for _ in range(200)]
    assert abs(np.mean(got) - 150) < 3


def test_draws_beyond_numpy(monkeypatch):
    """Draws by rejection have the probabilities of the law, also with more draws than rows of a kind."""
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 1)
    rng, runs = np.random.default_rng(4), 20_000
    for good, bad, n in ((6, 9, 5), (3, 30, 20), (12, 4, 10), (5, 5, 1), (2, 7, 9)):
        got = np.bincount([sharding._draw(rng, good, bad, n) for _ in range(runs)], minlength=good + 1) / runs
        want = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if k <= n else 0 for k in range(good + 1)]
        assert np.abs(got - want).max() < 0.015
    for g, k in ((2 * 10**9, 1), (10**10, 5000), (3 * 10**6, 40_000)):
        assert abs(sharding._log_falling(g, k) - np.log1p(-np.arange(k) / g).sum()) < 1e-6


def test_matrix_of_a_very_large_table():
    counts = [5 * 10**5] * 8000  # four billion rows
    m = sharding.communication_matrix(counts, 10, 3)
    assert m.sum(axis=1).tolist() == counts and (m.sum(axis=0) == 4 * 10**8).all()
    spread = (m - 5 * 10**4) / np.sqrt(5 * 10**4 * 0.9)
    assert abs(spread.mean()) < 0.02 and abs(spread.var() - 1) < 0.03


def test_hot_id_is_spread(spark):
    """A third of the rows without an id do not gather in one logical partition, and the deal stays whole."""
    df = spark.range(6000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "concat('t', id) AS text")
    out = sharding.shard(df, 40, part_rows=100)
    got = out.collect()
    assert sorted(r.text for r in got) == sorted(f"t{i}" for i in range(6000))
    assert sorted(Counter(r.shard for r in got).values()) == [150] * 40
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(df.repartition(5), 40, part_rows=100).collect()))


def test_every_row_once_without_gaps(spark):
    rows = [(i, f"t{i % 50}") for i in range(2003)] + [(7, "t7"), (7, "t7"), (None, None), (None, ""), (9999, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS slot", "1 AS _x")
    out = sharding.shard(df, 40, part_rows=100)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "_x", "shard", "slot"]
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(a), str(b)) for a, b in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(df.repartition(3), 40, part_rows=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shuffle_is_uniform(spark):
    """Each input position is about equally likely in each shard, and order within shards is unrelated to ids."""
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    got = sharding.shard(df, 8, part_rows=300).toPandas()
    halves = got.assign(low=got.doc_id < 2000).groupby("shard").low.mean()
    assert ((halves - 0.5).abs() < 0.1).all()
    corr = got.groupby("shard")[["doc_id", "slot"]].apply(lambda g: np.corrcoef(g.doc_id, g.slot)[0, 1])
    assert (corr.abs() < 0.2).all()


def test_digest_and_few_rows(spark):
    rows = [(1, "é"), (2, None), (3, "")]
    got = {r.doc_id: r for r in sharding.sharded_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["size"] for i in (1, 2, 3)] == [18, 16, 16]
    assert got[1].text_crc32 == zlib.crc32("é".encode()) and got[2].text_crc32 == got[3].text_crc32 == 0
    assert {r.slot for r in got.values()} == {0} and got[1].law == "rows" and got[1].grown_shard is None
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_equal_rows_are_spread(spark):
    """A third of the rows without an id and with one text; every row still gets a place of its own."""
    df = spark.range(6000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "if(id % 3 = 0, 'same', concat('t', id)) AS text")
    out = sharding.shard(df, 40, part_rows=100)
    got = out.collect()
    assert sorted(str(r.text) for r in got) == sorted(["same"] * 2000 + [f"t{i}" for i in range(6000) if i % 3])
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(150)) for s in slots.values()) and len(slots) == 40
    same = Counter(r.shard for r in got if r.text == "same")
    assert 20 < min(same.values()) and max(same.values()) < 85
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(df.repartition(5), 40, part_rows=100).collect()))
    every = spark.range(5000).selectExpr("1 AS doc_id", "'x' AS text")
    assert Counter(r.shard for r in sharding.shard(every, 7, part_rows=50).collect()) == Counter({0: 715, 1: 715} | {i: 714 for i in range(2, 7)})


def test_columns_of_any_name_keep_their_values(spark):
    names = ["_part", "_rn", "_ends", "_h", "_id", "_at", "_block", "_offset", "row", "_n", "_k", "_times"]
    df = spark.range(50).select(F.col("id").alias("doc_id"), *[(F.col("id") * 100 + i).alias(n) for i, n in enumerate(names)])
    out = sharding.shard(df, 4, part_rows=10)
    assert out.columns == [*df.columns, "shard", "slot"]
    assert all(r[n] == r.doc_id * 100 + i for r in out.collect() for i, n in enumerate(names))
