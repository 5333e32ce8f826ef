"""Scalar functions: labels, bond types, stability, schedules."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outer electrons of the main-group elements by group, and the periods' first and last elements.
PERIODS = ((1, 2), (3, 10), (11, 18), (19, 36), (37, 54), (55, 86), (87, 118))

# The ranges of atomic numbers that count as transition metals, which are never stable.
TRANSITION = ((21, 30), (39, 48), (57, 80), (89, 112))


def label(i: int, notion: str, term: str) -> str:
    return f"#{i}-{notion}: {term}"


def label_column(i: str, notion: str, term: str) -> Column:
    return F.format_string("#%d-%s: %s", F.col(i), F.col(notion), F.col(term))


def parse_label(column: str) -> list[Column]:
    """Number, notion and term of a label; nulls where the text is none."""
    pattern = r"^#(\d+)-(.+): (.+)$"
    ok = F.col(column).rlike(pattern)
    part = lambda g: F.when(ok, F.regexp_extract(column, pattern, g))
    return [part(1).cast("long").alias("i"), part(2).alias("notion"), part(3).alias("term")]


def bond_type(a: str, b: str) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "-")


def ring_class(in_ring: str, in_ring6: str, aromatic: str, conjugated: str) -> Column:
    """Five classes of a bond, the most specific first."""
    return (
        F.when(~F.col(in_ring) & F.col(conjugated), "Chain (conjugated)")
        .when(~F.col(in_ring), "Chain")
        .when(F.col(aromatic), "Aromatic")
        .when(F.col(in_ring6), "Six-ring")
        .otherwise("Other ring")
    )


def bond_state(in_ring: str, aromatic: str, atom_in_ring: str, atom_aromatic: str) -> Column:
    """What rings a bond has to do with: it lies in one, or one of its atoms does (``atom_`` columns: either atom)."""
    return (
        F.when(F.col(in_ring) & F.col(aromatic), "aro-ring")
        .when(F.col(in_ring), "non-aro-ring")
        .when(~F.col(atom_in_ring), "non-ring")
        .when(F.col(atom_aromatic), "aro-ring-att")
        .otherwise("non-aro-ring-att")
    )


def detailed_bond_type(btype: Column | None, state: Column, conjugated: str) -> Column:
    """Bond type and state as one text, with a mark for conjugated bonds; the state alone without a type."""
    text = state if btype is None else F.concat_ws(", ", btype, state)
    return F.concat(text, F.when(F.col(conjugated), " (c)").otherwise(""))


def outer_electrons(z: str) -> Column:
    """Outer electrons of an atomic number by its place in its period; null for transition metals and beyond."""
    c = F.col(z)
    first = F.when(c <= 2, c)
    for low, high in PERIODS[1:]:
        place = c - low + 1
        width = high - low + 1
        inside = F.when(place <= 2, place).when(place > width - 6, place - (width - 8))
        first = F.coalesce(first, F.when((c >= low) & (c <= high), inside))
    return first


def stable_atom(z: str, valence: str, charge: str) -> Column:
    """Outer electrons, valence and charge fill the shell: exactly 2 for hydrogen and helium, exactly 8 for all others;
    transition metals, and whatever is not known, are not stable."""
    n = outer_electrons(z) + F.col(valence) - F.col(charge)
    metal = reduce(lambda a, b: a | b, [F.col(z).between(low, high) for low, high in TRANSITION])
    return F.coalesce(~metal & (n == F.when(F.col(z) <= 2, 2).otherwise(8)), F.lit(False))


def fixed(column: str, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", F.col(column).cast("double"))


def is_isomeric(column: str) -> Column:
    return F.contains(column, F.lit("/")) | F.contains(column, F.lit("@"))


def is_fragment(column: str) -> Column:
    """One molecule only: not null, and without a dot."""
    return F.coalesce(~F.contains(column, F.lit(".")), F.lit(False))


def two_fragments(column: str) -> list[Column]:
    """The first two parts between dots in sorted order; null where there are not two."""
    parts = F.array_sort(F.split(column, "\\."))
    two = F.size(parts) >= 2
    return [F.when(two, F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(("frag_x", "frag_y"))]


def placeholders(column: str) -> Column:
    return F.regexp_extract_all(column, F.lit(r"\{\d*\}"), F.lit(0))


def bits_of_string(column: str) -> Column:
    """Places (from 0) of the ones in a text of zeros and ones."""
    at = F.sequence(F.lit(0), F.length(column) - 1)
    return F.when(F.length(column) > 0, F.filter(at, lambda i: F.substring(F.col(column), i + 1, F.lit(1)) == "1")).otherwise(F.array().cast("array<int>"))


def model_name(seed: str, run: str, epoch: str) -> Column:
    return F.concat(F.lit("S"), F.col(seed), F.lit("-R"), F.col(run), F.lit("-E"), F.lpad(F.col(epoch).cast("string"), 3, "0"))


# Fixed values of the published training schedule: drops at single epochs, and the exponents of the
# steady factors up to an epoch (exclusive); epochs count from 0, the warm-up multiplies by WARM_UP.
DROPS = {20: 2.5, 30: 2.5, 50: 4.0}
WARM_UP, WARM_UP_EPOCHS = 1.18, 6
EXPONENTS = ((13, -0.0275 / 2.5), (35, -0.0375 / 2.5), (50, -0.01 / 1.75))
LAST_EXPONENT = -0.01 / 2.25


def rate_factor(epoch: Column) -> Column:
    """By what the learning rate of the epoch before is multiplied."""
    f = F.lit(math.exp(LAST_EXPONENT))
    for stop, e in reversed(EXPONENTS):
        f = F.when(epoch < stop, F.lit(math.exp(e))).otherwise(f)
    f = F.when(epoch <= WARM_UP_EPOCHS, F.lit(WARM_UP)).otherwise(f)
    for at, by in DROPS.items():
        f = F.when(epoch == at, F.lit(1 / by)).otherwise(f)
    return f


def learning_rates(n: Column, start: float = 0.0015) -> Column:
    """Learning rates of epochs 0 to n - 1 as an array."""
    step = lambda acc, e: F.array_append(acc, F.element_at(acc, -1) * rate_factor(e))
    more = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(more, F.array(F.lit(start)), step)


def layer_size(n: int, m: int) -> int:
    """Width of a layer between n inputs and m outputs."""
    return int(math.sqrt(n * math.log2(m)))


def target_scale(column: str, low: float, high: float) -> Column:
    """A target scaled so that [low, high] becomes [0, 1]; ``unscale`` undoes it."""
    return (F.col(column) - low) / (high - low)


def unscale(column: str, low: float, high: float) -> Column:
    return F.col(column) * (high - low) + low


def arrays_equal(a: str, b: str) -> Column:
    """Same length, same elements in the same order; nulls equal each other, inside and as a whole."""
    return F.col(a).eqNullSafe(F.col(b))


def narrowest_integer(bound: int) -> str:
    """The smallest Spark type that holds all numbers from -bound to ``bound``. Spark's integers are signed."""
    if bound < 0:
        raise ValueError("a bound is not negative")
    for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)):
        if bound < 1 << bits:
            return name
    raise ValueError(f"no integer type holds {bound}")
