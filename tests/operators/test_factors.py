import numpy as np
import pytest
from pyspark.sql import functions as F

from bondweave.operators import factors


def frame(spark, x, extra=()):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + list(extra)
    return names, spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(3)


def test_factor_analysis_explains_the_covariances(spark):
    rng = np.random.default_rng(1)
    loadings = rng.standard_normal((7, 2))
    x = rng.standard_normal((800, 2)) @ loadings.T + rng.standard_normal((800, 7)) * np.linspace(0.3, 0.9, 7) + 5
    names, df = frame(spark, x, [(9000, *[None] * 7)])
    m = factors.factor_analysis(df, names, 2)
    cov = np.cov(x.T, bias=True)
    assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(np.diag(m.components @ m.components.T) + m.noise, np.diag(cov))

    def loss(noise):  # what is left after the best loadings of this noise: minus twice the log likelihood of a row
        s = np.sqrt(noise)
        v = np.linalg.eigvalsh(cov / np.outer(s, s))[::-1]
        return np.log(noise).sum() + (np.log(np.maximum(v[:2], 1)) + np.minimum(v[:2], 1)).sum() + v[2:].sum()

    assert all(loss(m.noise) <= loss(m.noise * np.exp(0.02 * rng.standard_normal(7))) for _ in range(50))
    # Scores are the expected factors given a row, by the formula for joint normal variables.
    inverse = np.linalg.inv(m.components @ m.components.T + np.diag(m.noise))
    got = {r[0]: r[1:] for r in m.project(df, ["id"]).collect()}
    want = (x - x.mean(axis=0)) @ inverse @ m.components
    assert np.allclose([got[i] for i in range(800)], want) and got[9000] == (None, None)


def test_sparse_components(spark):
    rng = np.random.default_rng(2)
    common = rng.standard_normal((400, 2)) * (5, 3)
    x = np.hstack([common[:, [0]].repeat(3, 1), common[:, [1]].repeat(3, 1)]) + 0.3 * rng.standard_normal((400, 6))
    names, df = frame(spark, x)
    plain = factors.sparse_components(df, names, 2, 0.0)
    vectors = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs((vectors * plain.components).sum(axis=0)), 1, atol=1e-4)
    sparse = factors.sparse_components(df, names, 2, 0.1)
    assert (np.abs(sparse.components[:3, 0]) > 0.3).all() and (sparse.components[3:, 0] == 0).all()
    assert (np.abs(sparse.components[3:, 1]) > 0.3).all() and (sparse.components[:3, 1] == 0).all()
    assert (factors.sparse_components(df, names, 2, 50.0).components == 0).all()
    scores = sparse.project(df, ["id"]).orderBy("id").toPandas()
    assert np.allclose(scores[["c_1", "c_2"]], (x - x.mean(axis=0)) @ sparse.components)


def test_non_negative_factors(spark):
    rng = np.random.default_rng(3)
    atoms, codes = np.array([[1, 1, 0, 0, 0], [0, 0, 1, 2, 1.0]]), rng.random((150, 2)) * (rng.random((150, 2)) < 0.7)
    names, df = frame(spark, codes @ atoms, [(9000, 1.0, None, 1.0, 1.0, 1.0)])
    m = factors.non_negative_factors(df, names, 2)
    assert m.losses[-1] < 1e-4 * m.losses[0] and (m.atoms >= 0).all() and all(b <= a * (1 + 1e-6) for a, b in zip(m.losses, m.losses[1:]))
    unit = atoms / np.linalg.norm(atoms, axis=1, keepdims=True)
    assert np.allclose(np.sort(m.atoms @ unit.T, axis=None)[-2:], 1, atol=1e-2)
    got = {r.id: r.codes for r in m.project(df.withColumn("codes", F.lit("x")), ["id"]).collect()}
    assert got[9000] is None and len(got) == 151
    assert np.allclose(np.array([got[i] for i in range(150)]) @ m.atoms, codes @ atoms, atol=0.05)
    with pytest.raises(ValueError):
        factors.non_negative_factors(df.withColumn("f0", F.lit(-1.0)), names, 2)


def test_dictionary_of_sparse_codes(spark):
    rng = np.random.default_rng(4)
    atoms = np.linalg.qr(rng.standard_normal((6, 6)))[0][:3]
    codes = rng.standard_normal((300, 3)) * (rng.random((300, 3)) < 0.35) * 4
    names, df = frame(spark, codes @ atoms)
    m = factors.dictionary(df, names, 3, 0.5)
    assert np.allclose(np.linalg.norm(m.atoms, axis=1), 1) and all(b < a * (1 + 1e-9) for a, b in zip(m.losses, m.losses[1:]))
    assert np.allclose(np.abs(m.atoms @ atoms.T).max(axis=0), 1, atol=0.02)
    got = np.array([r.codes for r in m.project(df, ["id"]).orderBy("id").collect()])
    x = codes @ atoms
    slope = (got @ m.atoms - x) @ m.atoms.T  # the codes are best: the slope is -l1 times their sign, or within l1 of zero
    assert np.allclose(slope[got != 0], -0.5 * np.sign(got[got != 0]), atol=1e-4) and (np.abs(slope[got == 0]) <= 0.5 + 1e-4).all()


def test_tables_without_rows(spark):
    names, df = frame(spark, np.ones((2, 2)))
    for fit in (lambda d: factors.factor_analysis(d, names, 1), lambda d: factors.sparse_components(d, names, 1, 0.1), lambda d: factors.non_negative_factors(d, names, 1), lambda d: factors.dictionary(d, names, 1, 0.1)):
        with pytest.raises(ValueError):
            fit(df.limit(0))
    same = factors.factor_analysis(df, names, 1)  # rows that are all alike
    assert np.isfinite(same.components).all() and np.isfinite(same.weights).all()
