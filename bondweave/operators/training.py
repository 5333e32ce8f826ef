"""Mini-batch training: Huber loss, Adam, the published learning rates, early stop, and a table of every epoch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import learning_rates
from . import checkpoints

# Fixed values of the published training: width of the Huber loss, rows of a batch, epochs at most, and epochs without gain before it stops.
DELTA, BATCH, EPOCHS, PATIENCE = 3.5, 512, 100, 20
_ADAM = (0.9, 0.999, 1e-7)


@dataclass
class Trained:
    """A linear model of standardised features, and what each epoch came to."""

    features: list[str]
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    history: list[tuple[int, float, float, float]] = field(default_factory=list)

    def prediction(self) -> Column:
        x = [(F.col(f).cast("double") - float(m)) / float(s) for f, m, s in zip(self.features, self.means, self.scales)]
        return sum((c * float(w) for c, w in zip(x, self.weights)), F.lit(float(self.weights[-1])))

    def curve(self, spark: SparkSession) -> DataFrame:
        """(epoch, rate, train_loss, val_loss), the losses before the epoch's average of weights counts for the next."""
        return spark.createDataFrame(self.history, "epoch int, rate double, train_loss double, val_loss double")


def huber(error: Column, delta: float = DELTA) -> Column:
    e = F.abs(error)
    return F.when(e <= delta, e * e / 2).otherwise(delta * (e - delta / 2))


def train(df: DataFrame, features: Sequence[str], target: str, validation: Column, epochs: int = EPOCHS, batch: int = BATCH, patience: int = PATIENCE, delta: float = DELTA, start: float = 0.0015, seed: int = 42, partitions: int | None = None) -> Trained:
    """Fit on the rows that are not ``validation``, and keep the weights of the epoch with the least validation loss.

    Rows are dealt to partitions and ordered by hash once, and written; in each epoch every task takes Adam steps on mini-batches
    of its own rows, in an order that the epoch turns, and the tasks' weights are averaged by their rows. So an epoch is one pass and
    hands on one row a task, whatever the table's size. Training stops after ``patience`` epochs without gain. Rows with a
    null or no finite value are left out. Reruns over the same rows and ``partitions`` agree up to the order of sums.
    """
    spark, n = df.sparkSession, len(features)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    rows = df.select(*cols, F.col(target).cast("double").alias("y"), F.coalesce(validation, F.lit(False)).alias("val"))
    names = [*[f"x{i}" for i in range(n)], "y"]
    for c in names:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    # One copy of the rows, with the place of each by hash: no epoch shuffles them again.
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), *names)).repartition(parts, F.col("h")).sortWithinPartitions("h").drop("h")
    rows = checkpoints.stored(rows, "training-rows")
    learn, check = rows.where("NOT val").select(*names), rows.where("val")
    moments = learn.agg(*[F.avg(c) for c in names[:-1]], *[F.stddev_pop(c) for c in names[:-1]], F.count(F.lit(1))).first()
    if not moments[-1]:
        raise ValueError("no rows to learn from")
    means, scales = np.array(moments[:n], float), np.array([s or 1.0 for s in moments[n : 2 * n]], float)
    rates = spark.range(1).select(learning_rates(F.lit(max(epochs, 1)), start)).first()[0]
    model = Trained(list(features), means, scales, np.zeros(n + 1))
    best, kept, weights = float("inf"), model.weights, model.weights

    for epoch, rate in enumerate(rates[:epochs]):
        now = weights.copy()

        def steps(batches: Iterator[pa.RecordBatch], w=now, rate=rate, epoch=epoch) -> Iterator[pa.RecordBatch]:
            w, first, second, t, seen, loss = w.copy(), np.zeros(n + 1), np.zeros(n + 1), 0, 0, 0.0
            rng = np.random.default_rng(seed + epoch)
            for b in batches:
                a = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                a = a[rng.permutation(len(a))]
                for k in range(0, len(a), batch):
                    x, y = np.hstack([(a[k : k + batch, :n] - means) / scales, np.ones((len(a[k : k + batch]), 1))]), a[k : k + batch, n]
                    e = x @ w - y
                    loss += float(np.where(np.abs(e) <= delta, e * e / 2, delta * (np.abs(e) - delta / 2)).sum())
                    g = x.T @ np.clip(e, -delta, delta) / len(e)
                    t, seen = t + 1, seen + len(e)
                    first, second = _ADAM[0] * first + (1 - _ADAM[0]) * g, _ADAM[1] * second + (1 - _ADAM[1]) * g * g
                    w -= rate * (first / (1 - _ADAM[0] ** t)) / (np.sqrt(second / (1 - _ADAM[1] ** t)) + _ADAM[2])
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([(w * seen).tolist()], pa.list_(pa.float64())), pa.array([seen], pa.int64()), pa.array([loss], pa.float64())], names=["w", "n", "loss"])

        each = learn.mapInArrow(steps, "w array<double>, n bigint, loss double")
        got = each.agg(*[F.sum(F.col("w")[j]) for j in range(n + 1)], F.sum("n"), F.sum("loss")).first()
        weights = np.array(got[: n + 1], float) / got[n + 1]
        model.weights = weights
        renamed = Trained([f"x{i}" for i in range(n)], means, scales, weights)
        val = check.select(huber(renamed.prediction() - F.col("y"), delta).alias("l")).agg(F.avg("l")).first()[0]
        val = got[n + 2] / got[n + 1] if val is None else val  # without validation rows the training loss decides
        model.history.append((epoch, float(rate), got[n + 2] / got[n + 1], float(val)))
        if val < best:
            best, kept, since = val, weights, 0
        else:
            since += 1
            if since >= patience:
                break
    model.weights = kept
    return model
