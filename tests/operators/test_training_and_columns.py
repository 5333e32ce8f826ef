import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bondweave.operators import checkpoints, column_store, graph, models, reactions, reduction, training

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(3000).selectExpr("id", "sin(id) * 4 AS x", "cos(id * 7) AS z", "(id * 37) % 11 * 1.0 AS u").withColumn("y", 2 * F.col("x") - 3 * F.col("z") + 0.5 * F.col("u") + 1).cache()


# Singular values and topics


def test_singular_values_equal_those_of_gram_sums(spark):
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    m = reduction.truncated_svd(spark.read.parquet(f"{SF}/lineitem.parquet"), names, 3)
    sums = ", ".join(f"sum(CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE))" for a in names for b in names)
    gram = np.array(duckdb.sql(f"SELECT {sums} FROM '{SF}/lineitem.parquet'").fetchall()[0]).reshape(4, 4)
    want = np.sqrt(np.sort(np.linalg.eigvalsh(gram))[::-1][:3])
    assert np.abs(m.values / want - 1).max() < 1e-6
    assert np.abs(m.components.T @ m.components - np.eye(3)).max() < 1e-9
    assert np.abs(gram @ m.components - m.components * m.values**2).max() < 1e-6 * want[0] ** 2


def test_many_features_few_values(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 5)) @ rng.standard_normal((5, 40)) + 1e-3 * rng.standard_normal((200, 40))
    names = [f"f{i}" for i in range(40)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None,) * 40], ", ".join(f"{n} double" for n in names))
    m = reduction.truncated_svd(df, names, 5)
    assert np.abs(m.values / np.linalg.svd(x, compute_uv=False)[:5] - 1).max() < 1e-6
    lengths = m.project(df.na.drop(), []).agg(*[F.sqrt(F.sum(F.col(f"sv_{i + 1}") ** 2)) for i in range(5)]).first()
    assert np.abs(np.array(lengths) / m.values - 1).max() < 1e-6
    with pytest.raises(ValueError):
        reduction.truncated_svd(df, names, 41)


def test_topics_of_two_kinds_of_rows(spark):
    rnd = random.Random(4)
    rows = [(i, sorted(rnd.sample(range(0, 10) if i % 2 else range(10, 20), 5))) for i in range(120)] + [(999, [])]
    got = {r.id: r.topics for r in reduction.topics(spark.createDataFrame(rows, "id long, bits array<int>"), 20, 2, ["id"], passes=30).collect()}
    assert all(abs(sum(t) - 1) < 1e-6 for t in got.values()) and list(got[999]) == [0.5, 0.5]
    tops = [{int(np.argmax(got[i])) for i in range(120) if i % 2 == odd} for odd in (0, 1)]
    assert len(tops[0]) == len(tops[1]) == 1 and tops[0] != tops[1]


# Training


def test_training_learns_and_stops(spark, data):
    m = training.train(data, ["x", "z", "u"], "y", F.col("id") % 5 == 0, epochs=60, batch=64, start=0.05, partitions=2)
    losses = [h[3] for h in m.history]
    assert losses[0] > 1 and min(losses) < 0.02
    curve = m.curve(spark).collect()
    assert [r.epoch for r in curve] == list(range(len(curve))) and abs(curve[0].rate - 0.05) < 1e-12
    off = data.select(F.avg(F.abs(m.prediction() - F.col("y")))).first()[0]
    assert off < 0.3
    again = training.train(data, ["x", "z", "u"], "y", F.col("id") % 5 == 0, epochs=3, batch=64, start=0.05, partitions=2)
    assert np.allclose([h[3] for h in again.history], losses[:3], rtol=1e-6)


def test_early_stop_keeps_the_best_epoch(spark, data):
    m = training.train(data, ["u"], "y", F.col("id") % 5 == 0, epochs=50, patience=2, start=5.0, partitions=2)
    losses = [h[3] for h in m.history]
    best = int(np.argmin(losses))
    assert len(losses) == min(50, best + 3)
    mse = data.where("id % 5 = 0").select(F.avg(training.huber(m.prediction() - F.col("y")))).first()[0]
    assert abs(mse - losses[best]) < 1e-6


def test_rows_that_cannot_be_learned_from(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (2.0, float("nan")), (float("inf"), 1.0), (3.0, 4.0)], "x double, y double")
    m = training.train(df, ["x"], "y", F.lit(False), epochs=2, partitions=1)
    assert len(m.history) == 2 and abs(m.means[0] - 2.0) < 1e-12
    with pytest.raises(ValueError):
        training.train(df.limit(0), ["x"], "y", F.lit(False), epochs=1)


# Inner outputs, boosting, importances


def test_leaves_feed_a_second_model(spark, data):
    leaves, sizes = models.with_leaves(data, ["x", "z", "u"], "y")
    counts = leaves.select(F.posexplode("leaves").alias("t", "leaf")).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max("leaf").alias("most")).collect()
    assert len(counts) == 20 == len(sizes) and all(r.n == 3000 and r.most < sizes[r.t] for r in counts)
    bits = leaves.withColumn("bits", models.leaf_bits("leaves", sizes))
    assert bits.where(F.size(F.array_distinct("bits")) != 20).count() == 0
    from pyspark.ml.regression import LinearRegression

    from bondweave.operators.bits import to_vector

    second = bits.select("y", to_vector(F.col("bits"), sum(sizes)).alias("features"))
    assert LinearRegression(labelCol="y", regParam=0.01).fit(second).summary.r2 > 0.8


def test_boosting_beats_one_tree_and_ranks_features(spark, data):
    one, many = models.boost(data, ["x", "z", "u"], "y", rounds=1), models.boost(data, ["x", "z", "u"], "y", rounds=6)
    off = lambda b: b.predict(data).select(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert off(many) < off(one) and 1 < len(many.trees) == len(many.weights) <= 6
    assert max(many.importances(), key=lambda x: x[1])[0] == "x" and abs(sum(w for _, w in many.importances()) - 1) < 1e-9
    assert set(many.predict(data).columns) == {*data.columns, "prediction"}


def test_boosting_stores_no_more_than_its_rounds_read(monkeypatch, data):
    """The rows once, and once for each round that another one follows."""
    written, stored = [], checkpoints.stored
    monkeypatch.setattr(checkpoints, "stored", lambda df, label: written.append(label) or stored(df, label))
    assert len(models.boost(data, ["x", "z", "u"], "y", rounds=2).trees) == len(written) == 2


def test_permutation_importances(spark, data):
    rows = data.withColumn("noise", F.rand(3))
    model = models.fit(rows, ["x", "z", "u", "noise"], "y")
    got = {r.feature: r.mean for r in models.permutation_importances(rows, ["x", "z", "u", "noise"], "y", model).collect()}
    assert got["x"] > got["z"] > got["u"] > 0.5 and abs(got["noise"]) < 1e-3


@pytest.fixture(scope="module")
def counted(spark):
    """3,000 rows in one partition, in order of a feature, of 60 distinct vectors."""
    rows = spark.range(3000).selectExpr("id div 600 * 1.0D AS x", "id % 4 * 1.0D AS z", "id % 3 * 2.0D AS u", "sin(id) AS e")
    return rows.withColumn("y", 2 * F.col("x") - F.col("z") * F.col("u") + F.col("e")).repartition(1).sortWithinPartitions("x", "e").cache()


def test_few_vectors_grow_the_trees_of_their_rows(spark, counted, monkeypatch):
    names, read = ["x", "z", "u"], []
    run = lambda: (models.importances(counted, names, "y", "boosted", seeds=(1,)), models.boost(counted, names, "y", rounds=4))
    stored = checkpoints.stored
    monkeypatch.setattr(checkpoints, "stored", lambda df, label: read.append(label) or stored(df, label))
    assert models.few_vectors(counted, names)
    trees, boosted = run()
    assert read.count("boost-rows") == 1  # rows are not written anew with their weights
    monkeypatch.setattr(models, "few_vectors", lambda *_: False)
    trees_of_rows, boosted_of_rows = run()
    assert np.allclose(*([r.mean for r in t.orderBy("feature").collect()] for t in (trees, trees_of_rows)), atol=1e-9)
    assert np.allclose(boosted.weights, boosted_of_rows.weights) and len(boosted.trees) == 4
    off = boosted.predict(counted, "p").join(boosted_of_rows.predict(counted, "q"), [*names, "e"]).select(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert off < 1e-9


def test_trees_of_a_forest_have_samples_of_the_rows(spark, counted, monkeypatch):
    names = ["x", "z", "u"]
    drawn = counted.select("*", F.rand(1).alias("_u0"), F.rand(2).alias("_u1"))
    sample = models._vectors(drawn, names, "y", [models._poisson(F.col(c)) for c in ("_u0", "_u1")]).agg(F.count(F.lit(1)), F.sum("_w0"), F.sum("_w1"), F.sum(F.col("_w0") * F.col("_y0"))).first()
    assert sample[0] == 60 and all(abs(n - 3000) < 5 * 3000**0.5 for n in sample[1:3]) and sample[1] != sample[2]
    assert abs(sample[3] - drawn.agg(F.sum(models._poisson(F.col("_u0")) * F.col("y"))).first()[0]) < 1e-6
    shares = spark.range(100_000).select(F.rand(3).alias("u")).select(models._poisson(F.col("u")).alias("k")).groupBy("k").count().collect()
    assert all(abs(r["count"] / 1e5 - np.exp(-1) / math.factorial(int(r.k))) < 0.01 for r in shares) and len(shares) > 5
    forest = models.fit(counted, names, "y", "forest")
    assert len([s for s in forest.stages if hasattr(s, "trees")]) == 20
    told = models.predict(counted, forest)
    assert set(told.columns) == {*counted.columns, "prediction"}
    monkeypatch.setattr(models, "few_vectors", lambda *_: False)
    of_rows = models.predict(counted, models.fit(counted, names, "y", "forest"))
    off = lambda t: t.select(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert abs(off(told) - off(of_rows)) < 0.15 * off(of_rows)


def test_vectors_whose_rows_weigh_nothing(counted):
    got = models._vectors(counted, ["x", "z", "u"], "y", [F.when(F.col("x") == 0, 0.0).otherwise(2.0)]).groupBy((F.col("x") == 0).alias("none")).agg(F.count("_y0").alias("n"), F.sum("_w0").alias("w"))
    assert sorted(map(tuple, got.collect())) == [(False, 48, 4800.0), (True, 12, 0.0)]


def test_a_target_that_is_missing_is_not_skipped(spark, counted):
    spoilt = counted.withColumn("y", F.when(F.col("e") < 0.99, F.col("y")))
    for kind in ("forest", "boosted"):
        with pytest.raises(Exception):
            models.fit(spoilt, ["x", "z", "u"], "y", kind)


def test_permuted_rows_are_dealt_without_a_join(spark, counted, monkeypatch):
    """Every trial holds all rows, a feature's values in another order whatever order they came in; few vectors are predicted once each."""
    names, seen, predict = ["x", "z", "u"], [], models.predict
    model = models.fit(counted, names, "y", "forest")
    monkeypatch.setattr(models, "predict", lambda df, m: seen.append(df) or predict(df, m))
    monkeypatch.setattr(models, "BLOCK", 500)
    got = {r.feature: r.mean for r in models.permutation_importances(counted, names, "y", model).collect()}
    assert seen.pop().count() == 60
    monkeypatch.setattr(models, "few_vectors", lambda *_: False)
    plain = {r.feature: r.mean for r in models.permutation_importances(counted, names, "y", model).collect()}
    dealt = seen.pop()
    assert not any(w in dealt._jdf.queryExecution().optimizedPlan().toString() for w in ("Join", "Repartition", "Window"))
    want = counted.groupBy("x").count().collect()
    for r in range(3):
        trial = dealt.where((F.col("_t.i") == 0) & (F.col("_t.r") == r))
        assert sorted(trial.groupBy("x").count().collect()) == sorted(want)
    # The values of x fall on all rows alike: dealt at random they tell nothing of y any more.
    assert abs(dealt.where("_t.i = 0").select(F.corr("x", "_y")).first()[0]) < 0.05 < dealt.where("_t.i < 0").select(F.corr("x", "_y")).first()[0]
    assert all(abs(got[f] - plain[f]) < 0.1 * plain["x"] for f in names) and plain["x"] > plain["z"] > 0.2


# Columns


@pytest.mark.parametrize("density", [0.0, 0.2, 2.0])
def test_columns_come_back(spark, density):
    rnd = random.Random(6)
    rows = [(i, {c: rnd.choice([0.0, 1.0, -2.5, 1e-300]) for c in rnd.sample(range(30), rnd.randint(0, 8))} | {77: 3.0}) for i in range(500)]
    df = spark.createDataFrame(rows, "n long, v map<long,double>")
    store = column_store.to_columns(df, "n", F.map_entries("v"), block=64, density=density)
    got = sorted((r.row, r.column, r.value) for r in column_store.from_columns(store).collect())
    assert got == sorted((i, c, x) for i, v in rows for c, x in v.items() if x)
    kinds = {r.sparse for r in store.collect()}
    assert kinds == ({False} if density == 0 else {True} if density == 2 else {True, False})
    assert max(len(r["values"]) for r in store.collect()) <= 64


def test_columns_of_nothing(spark):
    df = spark.createDataFrame([(0, {}), (1, {5: None})], "n long, v map<long,double>")
    store = column_store.to_columns(df, "n", F.map_entries("v"))
    assert store.collect() == [] and column_store.from_columns(store).collect() == []


# The table function


def test_reactions_in_sql(spark):
    bonds = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 2), (2, 0, 0, 1), (2, 1, 1, 2), (2, 2, 2, 0), (2, 3, 2, 3)], "mol long, bond long, a long, b long")
    atoms = spark.createDataFrame([(m, i, "CHON"[i]) for m in (1, 2) for i in range(4)], "mol long, atom long, symbol string")
    got = sorted(map(tuple, reactions.reactions_of(bonds, atoms).collect()))
    assert got == [(1, 0, "C", "HO"), (1, 1, "CH", "O"), (2, 3, "CHO", "N")]
    cores = bonds.select("mol", F.col("bond").alias("core"))
    assert got == sorted((r.mol, r.core, r.frag_x, r.frag_y) for r in graph.fragment_names(bonds, atoms, cores).collect())
    assert reactions.reactions_of(bonds.limit(0), atoms).collect() == []


def test_table_function_of_large_molecules_without_atoms(spark):
    """More atoms than one word holds, a ring, a repeated bond and a self-loop; one shuffle, and a row a molecule for the function."""
    edges = [(i, i + 1) for i in range(90)] + [(10, 14), (3, 4), (50, 50), (200, 201)]
    rows = [(m, i, a, b, "CHON"[a % 4], "CHON"[b % 4]) for m in (1, 2) for i, (a, b) in enumerate(edges)]
    bonds = spark.createDataFrame(rows, "mol long, bond long, a long, b long, symbol_a string, symbol_b string")
    got = sorted(map(tuple, reactions.reactions_of(bonds).collect()))
    assert got and got == sorted(map(tuple, graph.fragment_names(bonds, None, None).collect()))
    assert reactions.reactions_of(bonds)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
