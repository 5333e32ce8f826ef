"""Reference tables: build, attach, test membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what an output shows where no reference is known.
MISSING = -9999.0
#: Templates that are filled in one call, at most.
MAX_TEMPLATES = 10_000


def build_reference(df: DataFrame, keys: Sequence[str], values: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row for each key, with the values of its last row by ``order_by``."""
    last = F.max_by(F.struct(*values), F.struct(*order_by)).alias("_v")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col("_v")[v].alias(v) for v in values])


def attach_reference(df: DataFrame, reference: DataFrame, keys: Sequence[str], default: float | None = None) -> DataFrame:
    """Left join of one reference row at most; Spark broadcasts the reference if it is small, else shuffles both.

    Misses are null, or ``default`` at the output edge.
    """
    values = [c for c in reference.columns if c not in keys]
    out = df.join(reference, list(keys), "left")
    return out if default is None else out.fillna(default, values)


def known(column: str) -> Column:
    """A value above the sentinel: a reference was found."""
    return F.col(column) > MISSING + 1


def membership(df: DataFrame, reference: DataFrame, keys: Sequence[str], name: str = "known") -> DataFrame:
    """Adds whether a row's keys occur in ``reference``."""
    distinct = reference.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(distinct, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def in_scope(df: DataFrame, scope: DataFrame, key: str, retry: str | None = None) -> DataFrame:
    """Rows whose ``key`` is in ``scope``, or else whose ``retry`` (such as a canonical form) is; repeated rows stay."""
    known = scope.select(F.col(key).alias("_k")).distinct()
    if not retry:
        return df.join(known, F.col(key) == F.col("_k"), "left_semi")
    first, second = known.select(F.col("_k").alias("_k1")), known.select(F.col("_k").alias("_k2"))
    tried = df.join(first, F.col(key) == F.col("_k1"), "left").join(second, F.col(retry) == F.col("_k2"), "left")
    return tried.where(F.col("_k1").isNotNull() | F.col("_k2").isNotNull()).drop("_k1", "_k2")


def scope_counts(atoms: DataFrame, scope: Sequence[str], by: str = "mol", symbol: str = "symbol") -> DataFrame:
    """(by, in_scope, symbol, n): element counts inside and outside the scope."""
    return atoms.groupBy(by, F.col(symbol).isin(list(scope)).alias("in_scope"), symbol).agg(F.count(F.lit(1)).alias("n"))


def status(n_outside: str) -> list[Column]:
    """Status and message of a molecule from its number of atoms outside the scope."""
    outside = F.col(n_outside) > 0
    return [F.when(outside, "Out-of-Range").otherwise("OK").alias("status"), F.when(outside, "WARNING").otherwise("INFO").alias("level")]


def fill_templates(templates: DataFrame, fillers: DataFrame, template: str, filler: str, name: str = "filled") -> DataFrame:
    """Every template with every filler in place of its first placeholder ({} or {n}).

    Templates are a list written by hand: more than MAX_TEMPLATES of them are an error, so they can be broadcast to the fillers, of
    which there may be any number.
    """
    n = templates.limit(MAX_TEMPLATES + 1).count()
    if n > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    both = fillers.crossJoin(F.broadcast(templates)).select(*templates.columns, *fillers.columns)
    return both.withColumn(name, F.expr(f"concat(split({template}, '[{{][0-9]*[}}]', 2)[0], cast({filler} as string), coalesce(split({template}, '[{{][0-9]*[}}]', 2)[1], ''))"))
