"""Truncated singular values by subspace iteration, and topics of sparse bits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import to_vector


@dataclass
class TruncatedSVD:
    """The ``k`` largest singular values of a table's features, and their directions as columns of ``components``."""

    features: list[str]
    values: np.ndarray
    components: np.ndarray

    def project(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Columns sv_1 to sv_k: a row's features along each direction."""
        along = [sum((F.col(f).cast("double") * float(w) for f, w in zip(self.features, c)), F.lit(0.0)) for c in self.components.T]
        return df.select(*keep, *[x.alias(f"sv_{i + 1}") for i, x in enumerate(along)])


def _gram_times(df: DataFrame, features: Sequence[str], directions: np.ndarray) -> np.ndarray:
    """X'X times ``directions``: each task multiplies its own rows, batch by batch, and hands on one small matrix; Spark sums these up."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(directions)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += x.T @ (x @ directions)
        out = pa.array(total.tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), out], names=["row", "sums"])

    parts = df.select(*[F.col(f).cast("double") for f in features]).na.drop().mapInArrow(partial, "row int, sums array<double>")
    summed = parts.groupBy("row").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(directions.shape[1])])
    return np.array([list(r)[1:] for r in sorted(summed.collect(), key=lambda r: r["row"])]).reshape(directions.shape)


def truncated_svd(df: DataFrame, features: Sequence[str], k: int, oversample: int = 8, tolerance: float = 1e-13, max_passes: int = 60, seed: int = 42) -> TruncatedSVD:
    """Singular values and right singular vectors of the table whose columns are ``features``; rows with a null are left out.

    Starts from random directions, a few more than ``k``, and multiplies them by the features' Gram matrix, which is never
    built: each pass over the rows moves two matrices of features times directions. Passes end when the values stand
    still. Signs are fixed so that a direction's largest component is positive.
    """
    d = len(features)
    if not 0 < k <= d:
        raise ValueError("as many values as features at most")
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + oversample))))
    values = np.zeros(q.shape[1])
    for _ in range(max_passes):
        product = _gram_times(df, features, q)
        inner = q.T @ product
        now, turn = np.linalg.eigh((inner + inner.T) / 2)
        now, turn = now[::-1], turn[:, ::-1]
        vectors, still = q @ turn, np.abs(now - values)[:k].max(initial=0) <= tolerance * max(now[0], 1e-300)
        values = now
        if still or q.shape[1] == d:
            break
        q, _ = np.linalg.qr(product)
    vectors = vectors[:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])
    return TruncatedSVD(list(features), np.sqrt(np.clip(values[:k], 0, None)), vectors * np.where(signs == 0, 1, signs))


def topics(df: DataFrame, n_bits: int, k: int, keep: Sequence[str], bits: str = "bits", seed: int = 42, passes: int = 10) -> DataFrame:
    """``keep`` and ``topics``: each row's shares of ``k`` topics of its bits, by latent Dirichlet allocation; rows without a bit share all alike."""
    vectors = df.withColumn("_v", to_vector(F.col(bits), n_bits))
    model = LDA(k=k, seed=seed, maxIter=passes, featuresCol="_v", topicDistributionCol="_t").fit(vectors)
    shares = F.when(F.size(bits) > 0, vector_to_array("_t")).otherwise(F.array_repeat(F.lit(1.0 / k), k))
    return model.transform(vectors).select(*keep, shares.alias("topics"))
