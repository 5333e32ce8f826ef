import pytest
from pyspark.sql import functions as F

from bondweave.operators import models
from bondweave.operators.model_store import ModelStore, weights_table


@pytest.fixture
def data(spark):
    return spark.range(200).selectExpr("id", "id * 1.0 AS x", "sin(id) AS z", "id * 3.0 + 2 AS y")


def scores(df):
    return [round(r.p, 9) for r in df.orderBy("id").select(F.col("prediction").alias("p")).collect()]


@pytest.mark.parametrize("kind", ["linear", "forest", "boosted"])
def test_loaded_in_another_session_it_scores_alike(spark, data, tmp_path, kind):
    model = models.fit(data, ["x", "z"], "y", kind)
    ModelStore(spark, f"file://{tmp_path}").register(42, 1, model)
    other = ModelStore(spark.newSession(), f"file://{tmp_path}")
    assert scores(models.predict(data, other.load(42, 1))) == scores(models.predict(data, model))


def test_equal_models_are_stored_once_and_the_last_version_counts(spark, data, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    a, b = models.fit(data, ["x", "z"], "y"), models.fit(data, ["x", "z"], "y")
    c = models.fit(data.where("id < 50"), ["z"], "y")
    same = {store.register(1, 1, a), store.register(1, 2, b)}
    assert len(same) == 1 and store.register(1, 3, c) not in same
    assert len([p for p in (tmp_path / "models").iterdir()]) == 2
    store.register(1, 3, a)
    assert [(r.seed, r.run, r.content in same) for r in store.entries().collect()] == [(1, 1, True), (1, 2, True), (1, 3, True)]
    store.unregister(1, 2)
    assert [r.run for r in store.entries().collect()] == [1, 3]
    with pytest.raises(KeyError):
        store.unregister(1, 2)
    with pytest.raises(KeyError):
        store.load(9, 9)


def test_two_writers_of_one_version(spark, data, tmp_path, monkeypatch):
    one, two = ModelStore(spark, str(tmp_path)), ModelStore(spark, str(tmp_path))
    model = models.fit(data, ["x"], "y")
    content = one.register(5, 1, model)
    late = one._log()
    logs = iter([[e for e in late if False], late])  # the second writer has not seen the first one's entry yet
    monkeypatch.setattr(two, "_log", lambda: next(logs))
    two._append(5, 1, "other")
    assert one._current() == {(5, 1): "other"} and len(one._log()) == 2 and content
    assert not [p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("_new")]


def test_scores_of_all_runs(spark, data, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    for run, kind in ((1, "linear"), (2, "forest"), (3, "linear")):
        store.register(7, run, models.fit(data, ["x", "z"], "y", kind))
    out = store.score(data, 7, [0.5, 0.25, 0.25], 1.0)
    assert {"p1", "p2", "p3", "mean", "ensemble"} <= set(out.columns) or {"p1", "p2", "p3"} <= set(out.columns)
    assert out.where("p1 <> p3").count() == 0
    with pytest.raises(KeyError):
        store.score(data, 8)


def test_weights(spark, data):
    rows = {r.feature: r.weight for r in weights_table(spark, models.fit(data, ["x", "z"], "y"), ["x", "z"]).collect()}
    assert abs(rows["x"] - 3) < 1e-6 and abs(rows["z"]) < 1e-6 and abs(rows[None] - 2) < 1e-4
