import random

import pytest
from pyspark.sql import functions as F

from bondweave.operators import lookup, order, pairs, splits


def frame(spark, n=200, seed=0):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("abc"), rnd.choice([None, 1, 2]), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "i long, k string, x int, t double"), rows


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_ordinals_are_those_of_a_sort(spark, n):
    df, rows = frame(spark, n)
    got = {r.i: r.rn for r in order.with_ordinal(df.repartition(5), ["x", "k", "t"], ranges=6).collect()}
    want = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1], r[3]))
    assert got == {r[0]: p for p, r in enumerate(want, 1)}


def runs(values):
    out = []
    for p, v in enumerate(values, 1):
        if out and out[-1][0] == v:
            out[-1][2] = p
        else:
            out.append([v, p, p])
    return sorted(map(str, map(tuple, out)))


@pytest.mark.parametrize("n", [0, 1, 60])
def test_runs(spark, n):
    df, rows = frame(spark, n)
    got = order.run_groups(df, ["x"], ["i"]).collect()
    assert sorted(str((r.x, r["first"], r["last"])) for r in got) == runs([r[2] for r in rows])
    by = order.run_groups(df, ["x"], ["i"], ["k"]).where("k = 'a'").collect()
    assert sorted(str((r.x, r["first"], r["last"])) for r in by) == runs([r[2] for r in rows if r[1] == "a"])
    index = {r.x: r.starts for r in order.run_index(df, ["x"], ["i"]).collect()}
    assert sum(map(len, index.values())) == len(got)


def test_limits(spark):
    df, _ = frame(spark, 50)
    ids = lambda x: sorted(r.i for r in x.collect())
    assert ids(order.limit_rows(df, 3, ["i"])) == [0, 1, 2]
    assert ids(order.limit_rows(df, 0.5, ["i"])) == list(range(25))
    assert ids(order.limit_rows(df, 0.07, ["i"])) == [0, 1, 2]
    assert ids(order.limit_rows(df, (5, 8), ["i"])) == [5, 6, 7]
    assert ids(order.limit_rows(df, [1, 49, 99], ["i"])) == [1, 49]
    assert ids(order.limit_rows(df, [], ["i"])) == []
    with pytest.raises(TypeError):
        order.limit_rows(df, "3", ["i"])
    with pytest.raises(ValueError):
        order.limit_rows(df, 1.5, ["i"])


def test_arrange_keeps_first_appearance(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None), (4, "a"), (5, None)], "i long, k string")
    got = [r.i for r in order.arrange(df, "k", ["i"]).orderBy("rn").collect()]
    assert got == [0, 2, 1, 4, 3, 5]


def test_delete_nothing_is_no_error(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert df.select(order.delete_places(F.col("a"), []).alias("a"), order.delete_places(F.col("a"), [1]).alias("b")).first() == ([1, 2, 3], [1, 3])


PAIRS = [(0, "m", "p", "q", 1.0), (1, "m", "q", "p", 3.0), (2, "m", "p", "p", 5.0), (3, "m", "NONE", "p", 6.0), (4, "m", "p", "NONE", 7.0), (5, "n", "p", "q", 8.0), (6, "m", None, "p", 9.0), (7, "m", "p", None, 10.0), (8, "m", "p", "p", 11.0)]


def test_pairs(spark):
    df = spark.createDataFrame(PAIRS, "i long, mol string, x string, y string, t double")
    d = lambda **k: {r.i: r.t for r in pairs.dedup_pairs(df, ["mol"], ("x", "y"), ["i"], **k).collect()}
    assert sorted(d()) == [0, 2, 3, 5, 6]
    assert d(mean_of=["t"]) == {0: 2.0, 2: 8.0, 3: 6.5, 5: 8.0, 6: 9.5}
    assert sorted(d(ordered=True)) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert sorted(d(keep_if=(F.col("x") == "NONE") | (F.col("y") == "NONE"))) == [0, 2, 3, 4, 5, 6]
    once = pairs.dedup_pairs(df, ["mol"], ("x", "y"), ["i"])
    assert pairs.dedup_pairs(once, ["mol"], ("x", "y"), ["i"]).count() == once.count()
    swapped = df.select("i", "mol", F.col("y").alias("x"), F.col("x").alias("y"), "t")
    assert {r.i for r in pairs.dedup_pairs(swapped, ["mol"], ("x", "y"), ["i"]).collect()} == set(d())
    assert pairs.dedup_pairs(df.limit(0), ["mol"], ("x", "y"), ["i"]).collect() == []


def test_reverse(spark):
    df = spark.createDataFrame(PAIRS, "i long, mol string, x string, y string, t double")
    got = sorted((r.i, r.turn, r.x, r.y) for r in pairs.reverse_augment(df, ("x", "y")).where("i < 3").collect())
    assert got == [(0, 0, "p", "q"), (0, 1, "q", "p"), (1, 0, "q", "p"), (1, 1, "p", "q"), (2, 0, "p", "p")]
    assert pairs.reverse_augment(df, ("x", "y"), skip_identical=False).count() == 18


def test_columns_compare_whole_values(spark):
    df = spark.createDataFrame([(0, "m", "abc"), (1, "m", "abd"), (2, "m", "abc")], "i long, mol string, c string")
    assert sorted(r.i for r in pairs.dedup_column(df, ["mol"], "c", ["i"]).collect()) == [0, 1]


@pytest.mark.parametrize("cut", ["shuffled", "bottom", "top"])
@pytest.mark.parametrize("n", [1, 10, 101])
def test_splits_are_exact_and_stable(spark, n, cut):
    df = spark.range(n).withColumnRenamed("id", "key")
    plan = splits.SplitPlan(0.15, 0.25, cut)
    got = {r.key: r.split for r in splits.split_keys(df, "key", plan).collect()}
    sizes = {s: sum(v == s for v in got.values()) for s in ("train", "val", "test")}
    test = -(-15 * n // 100)
    val = min(-(-25 * n // 100), n - test)
    assert sizes == {"test": test, "val": val, "train": n - test - val} and len(got) == n
    again = {r.key: r.split for r in splits.split_keys(df.repartition(7), "key", plan).collect()}
    assert again == got
    if cut != "shuffled":
        rest = sorted(k for k, s in got.items() if s != "test")
        chosen = sorted(k for k, s in got.items() if s == "val")
        assert chosen == (rest[:val] if cut == "bottom" else rest[len(rest) - val :])


def test_shares():
    assert splits.share_of(5, 20) == 0.25 and splits.share_of(0.5, 20) == 0.5 and splits.share_of(0.5, 100, golden=True) == 0.1
    assert splits.split_shares((7, 2, 1), 10) == (0.7, 0.2, 0.1)
    train, val, test = splits.split_shares(0.4, 100, transfer=0.25)
    assert (round(train, 9), round(val, 9), round(test, 9)) == (0.6, 0.1, 0.3)
    for bad in ((1, 2), (0, 0, 0), (-1, 1, 1)):
        with pytest.raises(ValueError):
            splits.split_shares(bad, 10)
    with pytest.raises(ValueError):
        splits.SplitPlan(0.8, 0.3)


def test_leaks(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val"), (None, "train"), (None, "test")], "k string, split string")
    assert sorted(map(str, splits.drop_repeats_from_held_out(df, ["k"]).collect())) == sorted(map(str, df.where("split = 'train' OR k = 'b'").collect()))
    assert splits.drop_repeats_from_held_out(df, ["k"], to_train=True).where("split = 'train'").count() == 4


def test_repeated_rows_and_null_keys_stay(spark):
    scope = spark.createDataFrame([(1,), (5,)], "k int")
    df = spark.createDataFrame([(1, 9), (1, 9), (2, 5), (3, 4), (None, 5), (None, None)], "k int, alt int")
    assert sorted(map(tuple, lookup.in_scope(df, scope, "k", "alt").collect()), key=str) == sorted([(1, 9), (1, 9), (2, 5), (None, 5)], key=str)
    twice = pairs.compute_once(df, ["k"], lambda keys: keys.withColumn("double", keys.k * 2))
    assert sorted(((str(r.k), r.double) for r in twice.collect()), key=str) == sorted([("1", 2), ("1", 2), ("2", 4), ("3", 6), ("None", None), ("None", None)], key=str)


def test_runs_of_the_whole_table_across_ranges(spark):
    """Against a plain loop, with long runs, null keys, and more ranges than rows."""
    import random
    from itertools import groupby

    rnd = random.Random(3)
    for n in (0, 1, 5, 700):
        keys = [k for _ in range(n) for k in [rnd.choice(["a", "b", None])] * rnd.choice([1, 1, 60])][:n]
        df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
        want, at = [], 1
        for k, run in groupby(keys):
            size = len(list(run))
            want.append((k, at, at + size - 1))
            at += size
        assert sorted(map(tuple, order.run_groups(df, ["k"], ["i"]).collect()), key=str) == sorted(want, key=str)


def test_rows_side_by_side(spark):
    import pytest

    a, b = spark.range(50).selectExpr("id AS x"), spark.range(50).selectExpr("100 - id AS y")
    assert {(r.x, r.y) for r in order.zip_rows(a, b, ["x"], ["y"]).collect()} == {(i, 51 + i) for i in range(50)}
    with pytest.raises(ValueError):
        order.zip_rows(a, b.limit(3), ["x"], ["y"])
