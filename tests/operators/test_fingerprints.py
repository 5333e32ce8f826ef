"""Fingerprints of hand-made molecules beside plain enumeration."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bondweave.operators import fingerprints as fp

BONDS = "mol long, bond long, a long, b long"
ATOMS = "mol long, atom long, symbol string, in_ring boolean"


def frames(spark, bonds, atoms=None):
    atoms = atoms or sorted({(m, x) for m, _, a, b in bonds for x in (a, b)})
    return spark.createDataFrame(bonds, BONDS), spark.createDataFrame([(m, x, "CHON"[x % 4], x % 2 == 0) for m, x in atoms], ATOMS)


def plain_paths(bonds, longest):
    near = {}
    for _, _, a, b in bonds:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, front = [], [(x,) for x in near]
    for _ in range(longest):
        front = [(*p, n) for p in front for n in near[p[-1]] if n not in p]
        out += [p for p in front if p[0] < p[-1]]
    return out


@pytest.fixture(scope="module")
def random_bonds():
    rnd = random.Random(8)
    return [(1, i, a, b) for i, (a, b) in enumerate({tuple(sorted(rnd.sample(range(9), 2))) for _ in range(13)})]


def test_every_simple_path_once(spark, random_bonds):
    bonds, atoms = frames(spark, random_bonds)
    got = fp.simple_paths(bonds, atoms, 5, F.col("symbol")).collect()
    assert Counter(tuple(r.path) for r in got) == Counter(plain_paths(random_bonds, 5))
    for r in got:
        names = ["CHON"[x % 4] for x in r.path]
        assert r.label == min("-".join(names), "-".join(names[::-1])) and r.length == len(r.path) - 1


def test_ring_torsions_and_pairs(spark):
    ring = [(1, i, i, (i + 1) % 6) for i in range(6)]
    bonds, atoms = frames(spark, ring)
    assert sum(r.n for r in fp.torsions(bonds, atoms, F.lit("C")).collect()) == 6
    assert {r.label: r.n for r in fp.atom_pairs(bonds, atoms, F.lit("C")).collect()} == {"C~1~C": 6, "C~2~C": 6, "C~3~C": 3}
    assert fp.simple_paths(bonds, atoms, 7, F.lit("C")).groupBy("length").count().count() == 5


def test_parts_lone_atoms_and_repeated_bonds(spark):
    bonds, atoms = frames(spark, [(1, 0, 0, 1), (1, 1, 0, 1), (1, 2, 2, 3), (2, 0, 5, 6)], [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 5), (2, 6), (3, 7)])
    paths = fp.path_counts(fp.simple_paths(bonds, atoms, 4, F.lit("x")))
    assert sorted((r.mol, r.length, r.n) for r in paths.collect()) == [(1, 1, 2), (2, 1, 1)]
    rings = fp.circular(bonds, atoms, 1, F.col("symbol")).collect()
    assert Counter((r.mol, r.radius) for r in rings) == {(1, 0): 5, (1, 1): 5, (2, 0): 2, (2, 1): 2, (3, 0): 1, (3, 1): 1}
    assert fp.simple_paths(bonds.limit(0), atoms.limit(0), 2, F.lit("x")).collect() == []


def test_environments_with_equal_bonds_stay_once(spark):
    bonds, atoms = frames(spark, [(1, 0, 0, 1), (1, 1, 1, 2)])
    every = fp.circular(bonds, atoms, 3, F.col("symbol")).count()
    once = fp.circular(bonds, atoms, 3, F.col("symbol"), redundant=False).collect()
    # Radius 0: three atoms; then the bond of each end, and the whole chain once.
    assert every == 12 and Counter(r.radius for r in once) == {0: 3, 1: 3}


def test_min_hashes_estimate_jaccard(spark):
    rnd = random.Random(1)
    rows, pairs = [], []
    for i in range(0, 40, 2):
        base = [rnd.randrange(2**32) for _ in range(200)]
        changed = [x if rnd.random() < i / 40 else rnd.randrange(2**32) for x in base]
        rows += [(i, sorted(set(base))), (i + 1, sorted(set(changed)))]
        pairs.append((i, i + 1))
    hashed = fp.min_hashes(spark.createDataFrame(rows, "mol long, shingles array<long>"), 256)
    got = fp.similarities(spark.createDataFrame(pairs, "a long, b long"), hashed).collect()
    assert len(got) == 20 and max(abs(r.estimate - r.exact) for r in got) < 0.12
    assert sum(r.estimate - r.exact for r in got) / 20 < 0.03


def test_bonds_that_carry_their_ends_need_no_atoms(spark, random_bonds):
    """A ring, a repeated bond, one from both ends and a self-loop."""
    odd = [(2, i, a, b) for i, (a, b) in enumerate([(7, 3), (3, 7), (7, 3), (5, 5), (5, 3), (40, 100), (100, 9)])]
    bonds, atoms = frames(spark, random_bonds + odd)
    record = lambda c: F.struct(F.col(c).alias("atom"), F.element_at(F.array(*map(F.lit, "CHON")), (F.col(c) % 4 + 1).cast("int")).alias("symbol"))
    carried = bonds.withColumns({"end_a": record("a"), "end_b": record("b")})
    label = F.concat("symbol", F.col("degree").cast("string"))
    got = {r.mol: r for r in fp.molecules(carried, None, label).collect()}
    assert got == {r.mol: r for r in fp.molecules(bonds, atoms, label).collect()}
    near = {m: {} for m in got}
    for m, _, a, b in random_bonds + odd:
        near[m].setdefault(a, set()).add(b)
        near[m].setdefault(b, set()).add(a)
    for m, r in got.items():
        assert r.atoms == sorted(near[m]) and r.near == [sorted(r.atoms.index(o) + 1 for o in near[m][a]) for a in r.atoms]
        assert r.label == [f"{'CHON'[a % 4]}{len(near[m][a])}" for a in r.atoms]


def test_sets_are_hashed_once_for_all_pairs(spark, random_bonds):
    bonds, atoms = frames(spark, [(m, i, a, b + m) for m in range(1, 5) for _, i, a, b in random_bonds] + [(9, 0, 1, 2)])
    environments = fp.circular(bonds, atoms, 2, F.col("symbol"))
    hashed = fp.hashed_sets(environments, 32)
    assert sorted(hashed.collect()) == sorted(fp.min_hashes(fp.shingle_sets(environments), 32).collect())
    asked = [(1, 2), (1, 2), (3, 3), (2, 1), (4, 9), (9, 77), (77, 1)]
    found = fp.similarities(spark.createDataFrame(asked, "a long, b long"), hashed)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("collect_set(") == 1
    sets = {r.mol: r for r in hashed.collect()}
    want = [(a, b, sum(x == y for x, y in zip(sets[a].minima, sets[b].minima)) / 32, len({*sets[a].shingles} & {*sets[b].shingles}) / len({*sets[a].shingles} | {*sets[b].shingles})) for a, b in asked if 77 not in (a, b)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == 5


def test_layers_are_named(spark):
    bonds, atoms = frames(spark, [(1, 0, 0, 1)])
    assert len(fp.layered_bits(bonds, atoms, 2, 4096).first().bits) == 3
    assert len(fp.layered_bits(bonds, atoms, 2, 4096, layers=("length",)).first().bits) == 1
    with pytest.raises(ValueError, match="colour"):
        fp.layered_bits(bonds, atoms, 2, 64, layers=("colour",))
