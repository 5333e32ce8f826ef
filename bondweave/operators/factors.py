"""Factor analysis, sparse components, non-negative factors and dictionaries of a table's features.

The first two need the features' covariances only, one pass; the others alternate: each pass finds the rows' codes inside
the tasks and sums up two small matrices, from which the driver improves the atoms. No row leaves the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reduction import _gram_times


@dataclass
class Linear:
    """Scores that are linear in the features: (x - mean) times ``weights``. ``components`` has a column for each of them."""

    features: list[str]
    mean: np.ndarray
    components: np.ndarray
    weights: np.ndarray
    noise: np.ndarray | None = None

    def project(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and columns c_1, c_2 and so on; null where a feature is null."""
        out = []
        for i, ws in enumerate(self.weights.T):
            terms = [(F.col(f).cast("double") - float(m)) * float(w) for f, m, w in zip(self.features, self.mean, ws)]
            out.append(sum(terms[1:], terms[0]).alias(f"c_{i + 1}"))
        return df.select(*keep, *out)


def covariances(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariances of the rows without a null, centred before they are multiplied."""
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).na.drop()
    n, *mean = rows.agg(F.count(F.lit(1)), *[F.avg(f) for f in features]).first()
    if not n:
        raise ValueError("no row has all features")
    centred = rows.select(*[(F.col(f) - m).alias(f) for f, m in zip(features, mean)])
    return np.array(mean), _gram_times(centred, features, np.eye(len(features))) / n


def _upright(components: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest entry of each is positive."""
    signs = np.sign(components[np.abs(components).argmax(axis=0), range(components.shape[1])])
    return components * np.where(signs == 0, 1, signs)


def factor_analysis(df: DataFrame, features: Sequence[str], k: int, tolerance: float = 1e-13, max_rounds: int = 20_000) -> Linear:
    """Loadings (``components``) and variances of the features' own noise that make the covariances most likely.

    Each round takes the noise as known, scales the features by it, and reads the best loadings off the leading
    eigenvectors; it ends when the noise stands still. Scores are the factors' expected values given a row.
    """
    if not 0 < k <= len(features):
        raise ValueError("as many factors as features at most")
    mean, cov = covariances(df, features)
    own = np.diag(cov).copy()
    least = 1e-12 * max(own.max(), 1e-300)
    noise = np.maximum(own / 2, least)
    for _ in range(max_rounds):
        scale = np.sqrt(noise)
        values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
        loadings = scale[:, None] * vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k] - 1, 0))
        now = np.maximum(own - (loadings**2).sum(axis=1), least)
        still = np.abs(now - noise).max() <= tolerance * own.max()
        noise = now
        if still:
            break
    loadings = _upright(loadings)
    scaled = loadings / noise[:, None]
    return Linear(list(features), mean, loadings, scaled @ np.linalg.inv(np.eye(k) + loadings.T @ scaled), noise)


def sparse_components(df: DataFrame, features: Sequence[str], k: int, l1: float, ridge: float = 1e-6, tolerance: float = 1e-10, max_rounds: int = 1_000) -> Linear:
    """Principal directions of which small entries are zero: the elastic-net form, on the covariances alone.

    ``l1`` is a share of the largest variance along a direction; 0 gives the principal components. Directions have length one,
    or zero if the penalty leaves them no entry.
    """
    if not 0 < k <= len(features) or l1 < 0 or ridge <= 0:
        raise ValueError("as many components as features at most, no negative penalty, and a ridge")
    mean, cov = covariances(df, features)
    values, vectors = np.linalg.eigh(cov)
    top = max(values[-1], 1e-300)
    cov = cov / top
    step = 1 / (1 + ridge)
    frame = vectors[:, ::-1][:, :k]
    sparse = frame.copy()
    for _ in range(max_rounds):
        before, aim = sparse, cov @ frame
        for _ in range(200):
            moved = sparse - step * (cov @ sparse + ridge * sparse - aim)
            moved = np.sign(moved) * np.maximum(np.abs(moved) - step * l1 / 2, 0)
            done = np.abs(moved - sparse).max() <= tolerance
            sparse = moved
            if done:
                break
        left, _, right = np.linalg.svd(cov @ sparse, full_matrices=False)
        frame = left @ right
        if np.abs(sparse - before).max() <= tolerance:
            break
    length = np.linalg.norm(sparse, axis=0)
    unit = _upright(sparse / np.where(length > 0, length, 1))
    return Linear(list(features), mean, unit, unit)


@dataclass
class Coded:
    """Atoms (rows of ``atoms``, of length one) and the rule that gives a row its codes; ``losses`` holds one number a pass: squares of what is left, and penalties, in the mean."""

    features: list[str]
    atoms: np.ndarray
    code: Callable[[np.ndarray, np.ndarray], np.ndarray]
    losses: list[float]

    def project(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and ``codes``, an array with a number for each atom; null where a feature is null."""
        names, atoms, code = list(keep), self.atoms, self.code
        inner = [f"x{i}" for i in range(len(self.features))]
        rows = df.select(F.struct(*names).alias("kept"), *[F.col(f).cast("double").alias(x) for f, x in zip(self.features, inner)])

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.columns[1:])
                whole = ~np.isnan(x).any(axis=1)
                found = iter(code(x[whole], atoms).tolist())
                column = pa.array([next(found) if w else None for w in whole.tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["kept", "codes"])

        schema = T.StructType([rows.schema["kept"], T.StructField("codes", T.ArrayType(T.DoubleType()))])
        return rows.mapInArrow(codes, schema).select("kept.*", "codes")


def _matrix(columns: Sequence[pa.Array]) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])


def _alternate(df: DataFrame, features: Sequence[str], k: int, code, improve, passes: int, tolerance: float, seed: int, positive: bool, l1: float = 0.0) -> Coded:
    """Codes of all rows and better atoms in turn, until the loss stands still. Rows with a null are left out."""
    if k < 1:
        raise ValueError("at least one atom")
    d = len(features)
    rows = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).na.drop()
    start = np.random.default_rng(seed).standard_normal((k, d))
    atoms = np.abs(start) if positive else start
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    losses: list[float] = []
    for _ in range(passes):

        def partial(batches: Iterator[pa.RecordBatch], atoms: np.ndarray = atoms) -> Iterator[pa.RecordBatch]:
            total, square, n = np.zeros((k, k + d)), 0.0, 0
            for batch in batches:
                x = _matrix(batch.columns)
                a = code(x, atoms)
                total += a.T @ np.hstack((a, x))
                square, n = square + float(((x - a @ atoms) ** 2).sum() + 2 * l1 * np.abs(a).sum()), n + len(x)
            sums = pa.array([[square, float(n), *total.ravel().tolist()]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([sums], names=["sums"])

        parts = rows.mapInArrow(partial, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
        sums = [r["v"] for r in sorted(parts.groupBy("at").agg(F.sum("v").alias("v")).collect(), key=lambda r: r["at"])]
        if not sums or not sums[1]:
            raise ValueError("no row has all features")
        losses.append(sums[0] / sums[1])
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[0]:
            break
        both = np.array(sums[2:]).reshape(k, k + d)
        atoms = improve(atoms, both[:, :k], both[:, k:])
    return Coded(list(features), atoms, code, losses)


def _unit(atoms: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Atoms of length one; one that no row uses stays as it was."""
    length = np.linalg.norm(atoms, axis=1, keepdims=True)
    return np.where(length > 1e-300, atoms / np.where(length > 1e-300, length, 1), before)


def non_negative_factors(df: DataFrame, features: Sequence[str], k: int, passes: int = 60, steps: int = 200, tolerance: float = 1e-9, seed: int = 42) -> Coded:
    """Atoms and codes without negative entries whose products come near the features, which must not be negative either."""
    if df.where(F.least(*[F.col(f) for f in features], F.lit(0)) < 0).limit(1).count():
        raise ValueError("negative features have no non-negative factors")

    def code(x: np.ndarray, atoms: np.ndarray) -> np.ndarray:
        aim, inner = x @ atoms.T, atoms @ atoms.T
        a = np.ones_like(aim)
        for _ in range(steps):  # each row by itself, so codes do not depend on how rows are dealt
            a *= aim / np.maximum(a @ inner, 1e-300)
        return a

    def improve(atoms: np.ndarray, aa: np.ndarray, ax: np.ndarray) -> np.ndarray:
        better = atoms
        for _ in range(steps):
            better = better * (ax / np.maximum(aa @ better, 1e-300))
        return _unit(better, atoms)

    return _alternate(df, features, k, code, improve, passes, tolerance, seed, True)


def dictionary(df: DataFrame, features: Sequence[str], k: int, l1: float, passes: int = 60, steps: int = 200, tolerance: float = 1e-9, seed: int = 42) -> Coded:
    """Atoms of which few make up a row: codes pay ``l1`` for each unit, so most are zero. There may be more atoms than features."""

    def code(x: np.ndarray, atoms: np.ndarray) -> np.ndarray:
        aim, inner = x @ atoms.T, atoms @ atoms.T
        step = 1 / max(np.linalg.eigvalsh(inner)[-1], 1e-300)
        a = np.zeros_like(aim)
        for _ in range(steps):
            a = a - step * (a @ inner - aim)
            a = np.sign(a) * np.maximum(np.abs(a) - step * l1, 0)
        return a

    def improve(atoms: np.ndarray, aa: np.ndarray, ax: np.ndarray) -> np.ndarray:
        better = atoms.copy()
        for _ in range(20):
            for j in np.flatnonzero(np.diag(aa) > 1e-300):
                moved = better[j] + (ax[j] - aa[j] @ better) / aa[j, j]
                better[j] = moved / max(np.linalg.norm(moved), 1e-300)
        return _unit(better, atoms)

    return _alternate(df, features, k, code, improve, passes, tolerance, seed, False, l1)
