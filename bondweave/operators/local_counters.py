"""Counters of a bond's neighbourhood: its own atoms and kind (level 0), and what is around (level 1)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import bit, incidence, once

# Symbols, hybridisations and bond kinds that share a counter, in order.
CORE_SYMBOLS = ("F", "Cl", "Br", "I", "P", "S", "C", "H", "O", "N")
NEAR_SYMBOLS = ("F-Cl", "Br-I", "P-S", "C", "H", "O", "N")
HYBRIDS = ("S", "SP", "SP2", "SP3", "SP3D-SP3D2")
CORE_KINDS = ("SINGLE", "DOUBLE-DATIVE", "TRIPLE", "AROMATIC")
NEAR_KINDS = ("SINGLE", "AROMATIC", "DOUBLE-DATIVE-TRIPLE")


def _count(condition: Column, label: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("int").alias(label)


_ATOM_FIELDS = ("atom", "symbol", "hybrid", "aromatic", "in_ring", "in_ring6", "charge")
_LINK_FIELDS = ("bond", "a", "b", "kind", "b_ring", "b_ring6", "conjugated")
_FLAGS, _LINK_FLAGS = ("Aromatic", "Ring", "Stable-Ring", "PCharge", "NCharge", "NumPCharge", "NumNCharge"), ("RING", "STABLE-RING", "Conjugated")


def _place(value: Column, names: tuple[str, ...]) -> Column:
    """Which of ``names`` holds the value, from 1, a name of several values counted for each; 0 if none does."""
    return F.coalesce(F.array_position(F.array(*[F.lit(p) for n in names for p in n.split("-")]), value), F.lit(0)).cast("int")


def _tally(places: list[tuple[Column, tuple[str, ...]]], flags: list[Column], *sums: Column) -> Column:
    """What a record adds to the counters: two to a long, 32 bits each, which no list outgrows; then sums, a long each.
    A long is looked up by the places, so that the expression stays short enough to be compiled."""
    longs: dict[int, list[Column]] = {}
    lane = 0
    for place, names in places:
        of_place = [None] + [lane + i for i, n in enumerate(names) for _ in n.split("-")]
        for j in range(lane // 2, (lane + len(names) - 1) // 2 + 1):
            values = F.array(*[F.lit(0 if k is None or k // 2 != j else 1 << 32 * (k % 2)).cast("long") for k in of_place])
            longs.setdefault(j, []).append(F.get(values, place))
        lane += len(names)
    for i, c in enumerate(flags, lane):
        longs.setdefault(i // 2, []).append(F.when(c, F.lit(1 << 32 * (i % 2)).cast("long")).otherwise(F.lit(0).cast("long")))
    c = [reduce(lambda x, y: x + y, longs[j]) for j in sorted(longs)]
    return F.struct(*[x.alias(f"t{i}") for i, x in enumerate([*c, *sums])]).alias("tally")


def _atom_code(x: Callable[[str], Column]) -> Column:
    """An atom's record as numbers; its field is ``x(name)``."""
    flags = [x(c).alias(c) for c in ("aromatic", "in_ring", "in_ring6", "charge")]
    return F.struct(x("atom").alias("atom"), F.xxhash64(*[x(f) for f in _ATOM_FIELDS]).alias("key"), _place(x("symbol"), CORE_SYMBOLS).alias("symbol"), _place(x("hybrid"), HYBRIDS).alias("hybrid"), *flags)


def _atom_record(code: Column) -> Column:
    """(atom, key, tally): counters of the symbols and hybridisations of level 0, then ``_FLAGS``."""
    charge = lambda sign: F.when(code["charge"] * sign > 0, (code["charge"] * sign).cast("long")).otherwise(F.lit(0).cast("long"))
    tally = _tally([(code["symbol"], CORE_SYMBOLS), (code["hybrid"], HYBRIDS)], [code["aromatic"], code["in_ring"], code["in_ring6"], code["charge"] > 0, code["charge"] < 0], charge(1), charge(-1))
    return F.struct(code["atom"].alias("atom"), code["key"].alias("key"), tally)


_ATOM_LONGS, _LINK_LONGS = len(CORE_SYMBOLS + HYBRIDS + _FLAGS[:-2]) // 2 + 2, -(-len(CORE_KINDS + _LINK_FLAGS) // 2)


def _sum(tallies: Column, longs: int) -> Column:
    names = [f"t{i}" for i in range(longs)]
    return F.aggregate(tallies, F.struct(*[F.lit(0).cast("long").alias(n) for n in names]), lambda t, x: F.struct(*[(t[n] + x[n]).alias(n) for n in names]))


def _by_name(records: str, name: str, tallies: dict[str, int]) -> Column:
    """Records by their ``name``; those that share one are added. Mostly none do."""
    names = F.array_distinct(F.transform(records, lambda x: x[name]))
    of = lambda n, field: _sum(F.transform(F.filter(records, lambda x: x[name].eqNullSafe(n)), lambda x: x[field]), tallies[field]).alias(field)
    return F.transform(names, lambda n: F.struct(n.alias(name), *[of(n, field) for field in tallies]))


def _different(records: str, name: str) -> Column:
    """How many there are by this field."""
    return F.size(F.array_distinct(F.transform(records, lambda x: x[name])))


def _lane(tally: str, i: int) -> Column:
    long = F.col(tally)[f"t{i // 2}"]
    return (F.call_function("shiftright", long, F.lit(32)) if i % 2 else long.bitwiseAND(F.lit(2**32 - 1))).cast("int")


def _read(tally: str, first: int, names: tuple[str, ...], wanted: str) -> Column:
    """A counter of several values, such as those of level 1: those counted apart, added."""
    return reduce(lambda x, y: x + y, [_lane(tally, first + i) for i, n in enumerate(names) if set(n.split("-")) <= set(wanted.split("-"))])


def _atom_counters(level: int, tally: str, symbols: tuple[str, ...]) -> list[Column]:
    c = [_read(tally, 0, CORE_SYMBOLS, s).alias(f"L{level} - {s}") for s in symbols]
    # Sulphur and the hybridisation S have one letter: where both are counted, the second name says which it is.
    c += [_read(tally, len(CORE_SYMBOLS), HYBRIDS, s).alias(f"L{level} - {s}" + " (hybrid)" * (s in symbols)) for s in HYBRIDS]
    c += [_lane(tally, len(CORE_SYMBOLS + HYBRIDS) + i).alias(f"L{level} - {n}") for i, n in enumerate(_FLAGS[:-2])]
    return c + [F.col(tally)[f"t{_ATOM_LONGS - 2 + i}"].cast("int").alias(f"L{level} - {n}") for i, n in enumerate(_FLAGS[-2:])]


def _bond_counters(level: int, tally: str, kinds: tuple[str, ...]) -> list[Column]:
    """Named apart from the atoms' counters: Spark takes names that differ in case for the same."""
    c = [_read(tally, 0, CORE_KINDS, s).alias(f"L{level} bond - {s}") for s in kinds]
    return c + [_lane(tally, len(CORE_KINDS) + i).alias(f"L{level} bond - {n}") for i, n in enumerate(_LINK_FLAGS)]


def label_table(counters: DataFrame, keys: tuple[str, ...] = ("mol", "bond")) -> DataFrame:
    """(position, label, total): the counters' labels in their order from 0, as few rows as there are labels, and what each comes to in the table."""
    labels = [c for c in counters.columns if c not in keys]
    sums = counters.agg(*[F.coalesce(F.sum(F.col(f"`{c}`")), F.lit(0)).cast("long").alias(f"t{i}") for i, c in enumerate(labels)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("label"), F.col(f"t{i}").alias("total")) for i, c in enumerate(labels)])
    return sums.select(F.inline(rows))


def local_counters(atoms: DataFrame | None, bonds: DataFrame) -> DataFrame:
    """54 counters for every bond of atoms(mol, atom, symbol, hybrid, aromatic, in_ring, in_ring6, charge) and
    bonds(mol, bond, a, b, kind, b_ring, b_ring6, conjugated).

    Level 0 counts the bond's two atoms and itself, level 1 the atoms and bonds next to them, the bond's own
    excluded. Molecules are small: their atoms and bonds meet in one row and are counted there. What each atom and bond adds
    to the counters is told once, as a few longs, and a bond's counters are sums of those around it: rows by bond are only
    written, not grouped. ``atoms`` may be None if the bonds carry their ends, as records end_a and end_b with the
    atoms' columns but mol: no join is needed then. Equal records count once, others of one atom or bond are added.
    """
    # Records are made before they are gathered, as an aggregate would evaluate their expressions one by one, and in two steps.
    bits = bit(F.xxhash64("a")).bitwiseOR(bit(F.xxhash64("b"))).alias("bits")
    link = F.struct("bond", "key", "a", "b", "bits", _tally([(F.col("kind"), CORE_KINDS)], [F.col(c) for c in ("b_ring", "b_ring6", "conjugated")]))
    ends = {n: _atom_code(lambda f, n=n: F.col(n)[f]) for n in ("end_a", "end_b")} if atoms is None else {}
    made = once(bonds, ["mol", "bond", "a", "b", "b_ring", "b_ring6", "conjugated"], key=F.xxhash64(*_LINK_FIELDS), bits=bits, kind=_place(F.col("kind"), CORE_KINDS), **ends)
    if atoms is None:
        rows = once(made, ["mol"], link=link, ends=F.array(_atom_record(F.col("end_a")), _atom_record(F.col("end_b"))))
        rows = rows.groupBy("mol").agg(F.collect_list("link").alias("links"), F.flatten(F.collect_list("ends")).alias("records"))
    else:
        rows = once(made, ["mol"], link=link).groupBy("mol").agg(F.collect_list("link").alias("links"))
        listed = once(once(atoms, ["mol"], code=_atom_code(F.col)), ["mol"], record=_atom_record(F.col("code")))
        rows = rows.join(listed.groupBy("mol").agg(F.collect_list("record").alias("records")), "mol", "left")
        rows = rows.withColumn("records", F.coalesce("records", F.array().cast(rows.schema["records"].dataType)))
    rows = once(rows, ["mol", "records"], links=F.when(_different("links", "key") == F.size("links"), F.col("links")).otherwise(F.array_distinct("links")))
    # An atom is read off its first record; if records of one atom differ, off their sum.
    rows = once(rows, ["mol", "links"], records=F.when(_different("records", "key") == _different("records", "atom"), F.col("records")).otherwise(F.array_distinct("records")), apart=_different("records", "key") != _different("records", "atom"))
    whole = F.transform("records", lambda x: F.struct(x["atom"].alias("atom"), x["tally"].alias("tally")))
    rows = once(rows, ["mol", "links"], atoms=F.when(F.col("apart"), _by_name("records", "atom", {"tally": _ATOM_LONGS})).otherwise(whole))
    at = lambda end, own: end.isin(own["a"], own["b"])
    # Bonds that share an end share its bit; few others do, and the ends themselves decide.
    near = lambda own: F.filter("links", lambda e: (e["bits"].bitwiseAND(own["bits"]) != 0) & (e["bond"] != own["bond"]) & (at(e["a"], own) | at(e["b"], own)))
    rows = once(rows, ["mol", "atoms"], each=F.transform("links", lambda own: F.struct(own.alias("own"), near(own).alias("near"))))
    # The far ends of the bonds beside it; of a bond between the same two atoms both.
    others = lambda x: F.flatten(F.transform(x["near"], lambda e: F.array(F.when(at(e["a"], x["own"]), e["b"]), F.when(at(e["b"], x["own"]), e["a"]))))
    told = F.transform("each", lambda x: F.struct(x["own"].alias("own"), F.array_distinct(F.array(x["own"]["a"], x["own"]["b"])).alias("ends"), F.array_distinct(others(x)).alias("others"), _sum(F.transform(x["near"], lambda e: e["tally"]), _LINK_LONGS).alias("b1")))
    rows = once(rows, ["mol"], ids=F.transform("atoms", lambda x: x["atom"]), tallies=F.transform("atoms", lambda x: x["tally"]), each=told)
    found = lambda ids: F.filter(F.transform(ids, lambda i: F.get("tallies", F.array_position("ids", i).cast("int") - 1)), lambda t: t.isNotNull())
    counted = F.transform("each", lambda x: F.struct(x["own"]["bond"].alias("bond"), _sum(found(x["ends"]), _ATOM_LONGS).alias("a0"), _sum(found(x["others"]), _ATOM_LONGS).alias("a1"), x["own"]["tally"].alias("b0"), x["b1"].alias("b1")))
    rows = once(rows, ["mol"], counted=counted)
    added = _by_name("counted", "bond", {"a0": _ATOM_LONGS, "a1": _ATOM_LONGS, "b0": _LINK_LONGS, "b1": _LINK_LONGS})
    rows = rows.select("mol", F.inline(F.when(_different("counted", "bond") == F.size("counted"), F.col("counted")).otherwise(added)))
    return rows.select("mol", "bond", *_atom_counters(0, "a0", CORE_SYMBOLS), *_atom_counters(1, "a1", NEAR_SYMBOLS), *_bond_counters(0, "b0", CORE_KINDS), *_bond_counters(1, "b1", NEAR_KINDS))


STEREO = ("Stereo Chemistry", "Count Z-Bonds", "Count E-Bonds", "Cis Bond", "Cis Atom (C)", "Cis Atom (N)", "Trans Bond", "Trans Atom (C)", "Trans Atom (N)")


def stereo_counters(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """The nine stereo counters of every bond, given a column ``stereo`` ('Z', 'E' or null) of bonds: whether the
    molecule has stereo bonds, how many of each, cis or trans bonds beside the bond, and carbon or nitrogen atoms at their far ends."""
    of_mol = bonds.groupBy("mol").agg(F.count_if(F.col("stereo") == "Z").alias("_z"), F.count_if(F.col("stereo") == "E").alias("_e"))
    inc = incidence(bonds)
    marked = inc.join(bonds.where("stereo IS NOT NULL").select("mol", "bond", "stereo"), ["mol", "bond"]).join(atoms.select("mol", F.col("atom").alias("other"), "symbol"), ["mol", "other"])
    beside = inc.select("mol", F.col("bond").alias("core"), "atom").join(marked, ["mol", "atom"]).where("core <> bond")
    c = []
    for s, name in (("Z", "Cis"), ("E", "Trans")):
        here = F.col("stereo") == s
        c += [_count(here, f"{name} Bond"), _count(here & (F.col("symbol") == "C"), f"{name} Atom (C)"), _count(here & (F.col("symbol") == "N"), f"{name} Atom (N)")]
    near = beside.groupBy("mol", F.col("core").alias("bond")).agg(*c)
    base = bonds.select("mol", "bond").join(of_mol, "mol").select("mol", "bond", ((F.col("_z") + F.col("_e")) > 0).cast("int").alias(STEREO[0]), F.col("_z").cast("int").alias(STEREO[1]), F.col("_e").cast("int").alias(STEREO[2]))
    return base.join(near, ["mol", "bond"], "left").na.fill(0).select("mol", "bond", *STEREO)
