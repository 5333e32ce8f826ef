"""Predictions: ensembles, error columns, assembled results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import label


def ensemble(columns: Sequence[str], weights: Sequence[float] | None = None, bias: float = 0.0) -> Column:
    """Mean of predictions, or their weighted sum plus a bias."""
    if weights is None:
        return reduce(lambda a, b: a + b, map(F.col, columns)) / len(columns)
    if len(weights) != len(columns):
        raise ValueError("one weight for each prediction")
    return reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in zip(columns, weights)]) + float(bias)


def with_ensembles(df: DataFrame, columns: Sequence[str], weights: Sequence[float], bias: float, mean: str = "mean", weighted: str = "ensemble") -> DataFrame:
    return df.select("*", ensemble(columns).alias(mean), ensemble(columns, weights, bias).alias(weighted))


def performance_columns(df: DataFrame, predictions: Sequence[str], targets: Sequence[str], notion: Sequence[str] = ("BDE",), digits: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """For each prediction its target, itself, signed error (target - prediction) and absolute error.

    Prediction i belongs to target i modulo their number. Errors of unknown targets are null.
    """
    out = []
    for i, p in enumerate(predictions):
        t, n = targets[i % len(targets)], notion[i % len(notion)]
        signed = F.col(t) - F.col(p)
        for term, c in (("Target", F.col(t)), ("Predict", F.col(p)), ("RelError", signed), ("AbsError", F.abs(signed))):
            out.append((F.bround(c, digits) if digits is not None else c).alias(label(i, n, term)))
    return df.select(*keep, *out)


def render(df: DataFrame, keys: Sequence[str], models: Sequence[str], target: str) -> DataFrame:
    """One row for each key with its predictions as records (model, value), in the order given, and its reference."""
    records = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("value")) for m in models])
    return df.select(*keys, records.alias("predictions"), F.col(target).alias("reference"))


def reference_column(df: DataFrame, mode: int, performance: Sequence[str], analysis: Sequence[str] = (), features: Sequence[str] = (), btype: str = "btype", feature: int | str | None = None) -> Column:
    """The column that a mode number stands for: -1 the bond type, then the performance columns, then the analysis
    columns, and beyond these a feature by place or name."""
    if mode == -1:
        return F.col(btype)
    known = [*performance, *analysis]
    if 0 <= mode < len(known):
        return F.col(f"`{known[mode]}`")
    if isinstance(feature, int) and 0 <= feature < len(features):
        return F.col(f"`{features[feature]}`")
    if isinstance(feature, str) and feature in features:
        return F.col(f"`{feature}`")
    raise ValueError(f"mode {mode} and feature {feature!r} stand for no column")


def result_table(df: DataFrame, info: Sequence[str], environment: Sequence[str], predictions: Sequence[str], targets: Sequence[str], analysis: Sequence[str] = (), notion: Sequence[str] = ("BDE",), digits: int = 4) -> DataFrame:
    """One table of results: what a reaction is, its environment, what was predicted and how far off, and what else was computed, rounded."""
    rounded = df.select("*", *[F.bround(a, digits).alias(f"_{a}") for a in analysis])
    keep = [*info, *environment, *[f"_{a}" for a in analysis]]
    out = performance_columns(rounded, predictions, targets, notion, digits, keep)
    performance = [c for c in out.columns if c not in keep]
    return out.select(*info, *environment, *[F.col(f"`{c}`") for c in performance], *[F.col(f"_{a}").alias(a) for a in analysis])


def split_tables(df: DataFrame, keys: Sequence[str], models: Sequence[str], target: str, split: str = "split", digits: int = 4) -> DataFrame:
    """Predictions of every model for every split as one long table: (split, model, keys, target, predict, error, abs_error)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])).alias("m")
    error = F.col(target) - F.col("m.p")
    out = df.select(split, *keys, F.col(target), each)
    return out.select(split, F.col("m.model").alias("model"), *keys, F.bround(target, digits).alias("target"), F.bround("m.p", digits).alias("predict"), F.bround(error, digits).alias("error"), F.bround(F.abs(error), digits).alias("abs_error"))
