"""Roles of the columns of a reaction table, resolved once when a table is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Canonical names, in order.
INFO = ("mol", "rad_x", "rad_y", "bidx", "btype")


@dataclass(frozen=True)
class ReactionSchema:
    """Where each role is in a source: a column name or a position. ``None`` leaves an optional role out."""

    mol: int | str = 0
    radicals: tuple[int | str, int | str] | None = (1, 2)
    bidx: int | str | None = 3
    btype: int | str | None = 4
    targets: tuple[int | str, ...] = (5,)

    def roles(self) -> dict[str, int | str]:
        found: dict[str, int | str | None] = {"mol": self.mol, "bidx": self.bidx, "btype": self.btype}
        found["rad_x"], found["rad_y"] = self.radicals or (None, None)
        names = ["target"] if len(self.targets) == 1 else [f"target_{i}" for i in range(len(self.targets))]
        found |= dict(zip(names, self.targets))
        order = [*INFO, *names]
        return {k: found[k] for k in order if found[k] is not None}

    def project(self, df: DataFrame, with_target: bool = True) -> DataFrame:
        """The roles as canonical columns. Positions are those of the source as read, before any narrowing."""
        chosen: dict[str, str] = {}
        for role, where in self.roles().items():
            if role.startswith("target") and not with_target:
                continue
            if isinstance(where, int) and not 0 <= where < len(df.columns):
                raise ValueError(f"{role}: position {where} is outside the {len(df.columns)} columns")
            name = df.columns[where] if isinstance(where, int) else where
            if name not in df.columns:
                raise ValueError(f"{role}: there is no column {name!r}")
            if name in chosen.values():
                raise ValueError(f"{role}: column {name!r} has another role already")
            chosen[role] = name
        return df.select(*[F.col(f"`{name}`").alias(role) for role, name in chosen.items()])


def require_columns(df: DataFrame, **types: str) -> DataFrame:
    """``df`` if it has the named columns of the given simple types, else an error that lists what is wrong."""
    have = dict(df.dtypes)
    wrong = [f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in types.items() if have.get(c) != t]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df


def require_range(df: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """``df`` with a check that fails the job at the first value outside [low, high] of a column; nulls pass."""
    for column, (low, high) in bounds.items():
        inside = F.col(column).isNull() | F.col(column).between(low, high)
        df = df.where(F.coalesce(F.assert_true(inside, F.concat(F.lit(f"{column} outside [{low}, {high}]: "), F.col(column).cast("string"))).isNull(), F.lit(True)))
    return df


def require_homogeneous(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` if the columns have one type, else an error that lists them."""
    types = dict(df.dtypes)
    if len({types[c] for c in columns}) > 1:
        raise TypeError(", ".join(f"{c}: {types[c]}" for c in columns))
    return df
