"""Fingerprints of small graphs: simple paths, atom pairs, circular environments and their MinHash.

A molecule's atoms come into one row, numbered by place, and everything is enumerated there: one shuffle by molecule,
whatever the length of paths or the radius. Hashes are the first 32 bits of MD5 over texts, so any engine can repeat
them; the families follow the ideas of the published fingerprints, not the bits of any chemistry toolkit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import WORD, ball, balls, has, once, steps

#: Fixed value: the largest prime below 2^32, for the hash functions of MinHash.
PRIME = 4_294_967_291
LAYERS = ("length", "symbols", "ring")


def text_hash(text: Column) -> Column:
    """The first 32 bits of a text's MD5, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def molecules(bonds: DataFrame, atoms: DataFrame | None, label: Column) -> DataFrame:
    """One row for each molecule: ``atoms`` in order, and by their places ``label`` and ``near``, the places of the atoms bonded to each.

    ``label`` is an expression of the columns of ``atoms`` (mol, atom, ...) and ``degree``. Repeated bonds count once. Without ``atoms`` the
    bonds carry the records (atom, ...) of their ends, ``end_a`` and ``end_b``, and nothing is joined.
    """
    if atoms is None:
        fields = [c for c in bonds.schema["end_a"].dataType.names if c not in ("mol", "degree")]
        links = bonds.groupBy("mol").agg(F.collect_list(F.struct("a", "b", "end_a", "end_b")).alias("_l"))
        rows = once(links, ["mol"], _a=F.col("_l.a"), _b=F.col("_l.b"), _records=F.concat("_l.end_a", "_l.end_b"))
        ids = F.concat("_a", "_b")
    else:
        fields = [c for c in atoms.columns if c not in ("mol", "degree")]
        links = bonds.groupBy("mol").agg(F.collect_list(F.struct("a", "b")).alias("_l"))
        rows = atoms.groupBy("mol").agg(F.collect_list(F.struct(*fields)).alias("_records")).join(links, "mol", "left")
        rows = once(rows, ["mol", "_records"], _a=F.coalesce("_l.a", F.array().cast("array<bigint>")), _b=F.coalesce("_l.b", F.array().cast("array<bigint>")))
        ids = F.col("_records.atom")
    place = lambda atom: F.array_position("_atoms", atom)
    rows = once(rows, ["mol", "_a", "_b", "_records"], _ids=ids, _atoms=F.sort_array(F.array_distinct(ids)))
    rows = once(rows, ["mol", "_ids", "_records", "_atoms"], _a=F.transform("_a", place), _b=F.transform("_b", place), _n=F.size("_atoms") + 1)
    # A bond seen from an end is one number, so that telling apart and sorting look at numbers only: the end's place, then the other's.
    seen = lambda x, y: F.zip_with(x, y, lambda p, q: p * F.col("_n") + q)
    rows = once(rows, ["mol", "_ids", "_records", "_atoms", "_n"], _ends=F.sort_array(F.array_distinct(F.concat(seen("_a", "_b"), seen("_b", "_a")))))
    parts = {"_from": F.transform("_ends", lambda e: F.floor(e / F.col("_n")).cast("int")), "_to": F.transform("_ends", lambda e: (e % F.col("_n")).cast("int"))}
    each = once(rows, ["mol", "_ids", "_records", "_atoms"], **parts).select("*", F.posexplode("_atoms").alias("_at", "_atom"))
    at = F.col("_at") + 1
    first, last = F.array_position("_from", at), F.size("_from") - F.array_position(F.reverse("_from"), at) + 1
    each = each.withColumn("_first", first.cast("int")).withColumn("degree", F.when(F.col("_first") > 0, last - F.col("_first") + 1).otherwise(0).cast("int"))
    each = each.withColumn("_near", F.slice("_to", F.greatest("_first", F.lit(1)), F.col("degree"))).withColumn("_record", F.element_at("_records", F.array_position("_ids", F.col("_atom")).cast("int")))
    each = each.select("mol", "_at", "degree", "_near", *[F.col("_record")[c].alias(c) for c in fields])
    named = each.select("mol", F.struct("_at", "atom", label.cast("string").alias("label"), F.col("_near").alias("near")).alias("_x"))
    listed = named.groupBy("mol").agg(F.sort_array(F.collect_list("_x")).alias("_x"))
    return once(listed, ["mol"], atoms=F.col("_x.atom"), label=F.col("_x.label"), near=F.col("_x.near"))


def _walks(rows: DataFrame, longest: int) -> DataFrame:
    """``rows`` of ``molecules`` for every simple path of 1 to ``longest`` bonds, from its end with the lesser place to the other: its places
    p0 to p<longest>, 0 after its end. A path goes on to each neighbour that it has not met, or ends (0)."""
    keep = [c for c in rows.columns]
    walks = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("near"))).alias("p0")) if longest else rows
    for k in range(1, longest + 1):
        met = [F.col(f"p{i}") for i in range(k)]
        ahead = F.element_at("near", F.greatest(met[-1], F.lit(1)))
        ends = F.array(F.lit(0))
        onward = F.when(met[-1] == 0, ends).otherwise(F.concat(ends, ahead)) if k > 1 else ahead
        walks = walks.select("*", F.explode(onward).alias(f"p{k}")).where((F.col(f"p{k}") == 0) | ~F.col(f"p{k}").isin(*met))
    last = F.coalesce(*[F.when(F.col(f"p{k}") > 0, F.col(f"p{k}")) for k in range(longest, 0, -1)])
    return walks.where(F.col("p0") < last).select(*keep, *[f"p{k}" for k in range(longest + 1)])


def _bonds_of(longest: int) -> Column:
    return reduce(lambda x, y: x + y, [F.when(F.col(f"p{k}") > 0, 1).otherwise(0) for k in range(1, longest + 1)])


def _read(names: str, longest: int) -> Column:
    """The path's names joined by ``-`` from the end that reads less."""
    told = [F.when(F.col(f"p{k}") > 0, F.element_at(names, F.greatest(f"p{k}", F.lit(1)))) for k in range(longest + 1)]
    return F.least(F.concat_ws("-", *told), F.concat_ws("-", *told[::-1]))


def simple_paths(bonds: DataFrame, atoms: DataFrame, longest: int, label: Column) -> DataFrame:
    """(mol, length, path, label): every simple path of 1 to ``longest`` bonds, once, as atoms in order.

    ``label`` joins the atoms' labels by ``-`` from the end that reads less. A molecule's paths grow as rows from its row, so
    ``longest`` bounds the work as the molecule's branching to that power; molecules are small, and 7 bonds the custom.
    """
    if longest < 1:
        raise ValueError("a path has a bond")
    walks = _walks(molecules(bonds, atoms, label), longest)
    places = F.array(*[F.element_at("atoms", F.greatest(f"p{k}", F.lit(1))) for k in range(longest + 1)])
    return walks.select("mol", _bonds_of(longest).alias("length"), F.slice(places, F.lit(1), _bonds_of(longest) + 1).alias("path"), _read("label", longest).alias("label"))


def path_counts(paths: DataFrame) -> DataFrame:
    """(mol, length, label, n). Those of three bonds are the torsions."""
    return paths.groupBy("mol", "length", "label").agg(F.count(F.lit(1)).alias("n"))


def torsions(bonds: DataFrame, atoms: DataFrame, label: Column) -> DataFrame:
    """(mol, label, n): paths of four atoms by their labels."""
    return path_counts(simple_paths(bonds, atoms, 3, label).where("length = 3")).drop("length")


def bits_of(features: DataFrame, feature: str, n_bits: int) -> DataFrame:
    """(mol, bits): the features of each molecule folded into ``n_bits`` places by their hash."""
    bit = F.pmod(text_hash(F.col(feature)), F.lit(n_bits)).cast("int")
    return features.select("mol", bit.alias("bit")).groupBy("mol").agg(F.array_sort(F.collect_set("bit")).alias("bits"))


def layered_bits(bonds: DataFrame, atoms: DataFrame, longest: int, n_bits: int, symbol: str = "symbol", ring: str = "in_ring", layers: Sequence[str] = LAYERS) -> DataFrame:
    """(mol, bits): each path sets a bit for each layer that looks at it: its length alone, its symbols, its ring membership."""
    of = {"length": F.lit("*"), "symbols": F.col(symbol), "ring": F.when(F.col(ring), "r").otherwise("c")}
    unknown = set(layers) - set(of)
    if unknown:
        raise ValueError(f"no layer {sorted(unknown)[0]}")
    every = F.concat_ws("|", *[of[name] for name in layers])
    # A layer reads its own part of each atom's label, from the end that reads less in that layer.
    part = lambda k: F.transform("label", lambda x: F.get(F.split(x, "\\|"), F.lit(k)))
    names = {f"layer{k}": part(k) for k in range(len(layers))}
    walks = _walks(once(molecules(bonds, atoms, every), ["mol", "near"], **names), longest)
    each = F.array(*[F.struct(F.lit(name + ":").alias("layer"), F.col(f"layer{k}").alias("names")) for k, name in enumerate(layers)])
    told = walks.select("mol", *[f"p{k}" for k in range(longest + 1)], F.inline(each)).select("mol", F.concat("layer", _read("names", longest)).alias("feature"))
    return bits_of(told.distinct(), "feature", n_bits)


def atom_distances_all(bonds: DataFrame, atoms: DataFrame, label: Column, farthest: int = 30) -> DataFrame:
    """(mol, a, b, label_a, label_b, distance): the bonds between all atoms a < b of a molecule that are connected within ``farthest`` bonds."""
    rows = molecules(bonds, atoms, label)
    rows = once(rows, ["mol", "atoms", "label"], balls=balls("near", F.least(F.lit(farthest), F.size("near"))))
    of_atom = lambda a, i: F.struct(a.alias("a"), i.alias("place"), F.transform("balls", lambda w: F.transform(w, lambda level: F.get(level, i))).alias("lists"))
    each = rows.select("mol", "atoms", "label", F.inline(F.transform("atoms", of_atom)))
    each = each.select("mol", "atoms", "label", "a", "place", F.posexplode("lists").alias("word", "levels"))
    each = each.select("mol", "label", "a", "place", "levels", "word", F.posexplode(F.slice("atoms", F.col("word") * WORD + 1, WORD)).alias("at", "b"))
    each = each.withColumn("at", F.col("at") + F.col("word") * WORD).where(F.col("at") > F.col("place")).where(has(ball(F.col("levels"), farthest), F.col("at")))
    name = lambda place: F.element_at("label", F.col(place) + 1)
    return each.select("mol", "a", "b", name("place").alias("label_a"), name("at").alias("label_b"), steps(farthest).alias("distance"))


def atom_pairs(bonds: DataFrame, atoms: DataFrame, label: Column, farthest: int = 30) -> DataFrame:
    """(mol, label, n): pairs of atoms by both labels, the lesser first, and the bonds between them."""
    d = atom_distances_all(bonds, atoms, label, farthest)
    told = F.concat_ws("~", F.least("label_a", "label_b"), F.col("distance").cast("string"), F.greatest("label_a", "label_b"))
    return d.groupBy("mol", told.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def circular(bonds: DataFrame, atoms: DataFrame, radius: int, label: Column, redundant: bool = True) -> DataFrame:
    """(mol, atom, radius, identifier): what surrounds each atom to each radius from 0 on.

    An identifier is the atom's label, or for a larger radius the MD5 of its last identifier and, in order, those of the atoms
    bonded to it. Without ``redundant`` of the environments of one molecule that have the same bonds only one stays, of the
    least radius, then identifier, then atom; radius 0, which has no bonds, always stays.
    """
    places = F.sequence(F.lit(1), F.size("near"))
    zero = F.struct(F.array("label").alias("names"), F.array(F.transform(places, lambda i: F.array(i))).alias("balls"))
    kind = "struct<names:array<array<string>>,balls:array<array<array<int>>>>"

    def step(acc: Column, _: Column) -> Column:
        last, ball = F.element_at(acc["names"], -1), F.element_at(acc["balls"], -1)
        name = lambda i: F.md5(F.concat(F.element_at(last, i), F.lit("("), F.array_join(F.sort_array(F.transform(F.element_at("near", i), lambda n: F.element_at(last, n))), ","), F.lit(")")).cast("binary"))
        wider = lambda i: F.array_union(F.element_at(ball, i), F.flatten(F.transform(F.element_at(ball, i), lambda x: F.element_at("near", x))))
        return F.struct(F.concat(acc["names"], F.array(F.transform(places, name))).alias("names"), (acc["balls"] if redundant else F.concat(acc["balls"], F.array(F.transform(places, wider)))).alias("balls")).cast(kind)

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(radius)), zero.cast(kind), step) if radius > 0 else zero.cast(kind)
    inside = lambda ball: F.array_sort(F.array_distinct(F.flatten(F.transform(ball, lambda x: F.transform(F.element_at("near", x), lambda y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")))))))
    rows = once(molecules(bonds, atoms, label), ["mol", "atoms", "near"], g=grown)
    if redundant:
        levels = rows.select("mol", F.col("atoms").alias("atom"), F.posexplode("g.names").alias("radius", "identifier"))
        return levels.select("mol", "radius", F.inline(F.arrays_zip("atom", "identifier"))).select("mol", "atom", "radius", "identifier")
    fields = lambda r, i: [F.element_at("atoms", i).alias("atom"), r.alias("radius"), F.element_at(F.element_at("g.names", r + 1), i).alias("identifier")]
    bonds_of = lambda r, i: F.when(r > 0, inside(F.element_at(F.element_at("g.balls", F.greatest(r, F.lit(1))), i))).alias("inside")
    each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda r: F.transform(places, lambda i: F.struct(*fields(r, i), bonds_of(r, i)))))
    found = rows.select("mol", F.inline(each))
    some = found.where("radius > 0").groupBy("mol", "inside").agg(F.min(F.struct("radius", "identifier", "atom")).alias("x"))
    return found.where("radius = 0").drop("inside").unionByName(some.select("mol", "x.atom", "x.radius", "x.identifier"))


def shingle_sets(environments: DataFrame, least_radius: int = 1) -> DataFrame:
    """(mol, shingles): the distinct hashes of a molecule's environments of ``least_radius`` or more; a molecule without any is left out."""
    return _hashes(environments, least_radius).groupBy("mol").agg(F.sort_array(F.collect_set("x")).alias("shingles"))


def _hashes(environments: DataFrame, least_radius: int) -> DataFrame:
    return environments.where(F.col("radius") >= least_radius).select("mol", text_hash(F.col("identifier")).alias("x"))


def _factor(i: int, first: int) -> int:
    return int(hashlib.md5(str(i).encode()).hexdigest()[first - 1 : first + 6], 16) + 1


def _hash(i: int, x: Column) -> Column:
    return (F.lit(_factor(i, 1)).cast("long") * x + F.lit(_factor(i, 8)).cast("long")) % PRIME


def min_hashes(sets: DataFrame, k: int = 64) -> DataFrame:
    """Add ``minima``: for each of ``k`` functions (a * x + b) mod PRIME the least value over the shingles; a and b come from the MD5 of its number."""
    factors = F.array(*[F.struct(F.lit(_factor(i, 1)).cast("long").alias("a"), F.lit(_factor(i, 8)).cast("long").alias("b")) for i in range(k)])
    return sets.withColumn("minima", F.transform(factors, lambda f: F.array_min(F.transform("shingles", lambda x: (f["a"] * x + f["b"]) % PRIME))))


def hashed_sets(environments: DataFrame, k: int = 64, least_radius: int = 1) -> DataFrame:
    """(mol, shingles, minima): what ``min_hashes`` adds to ``shingle_sets``, by one aggregate over the environments, without lambdas."""
    minima = F.array(*[F.min(_hash(i, F.col("x"))) for i in range(k)])
    return _hashes(environments, least_radius).groupBy("mol").agg(F.sort_array(F.collect_set("x")).alias("shingles"), minima.alias("minima"))


def similarities(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(a, b, estimate, exact): the share of equal minima of two molecules, and the Jaccard similarity of their shingles.

    ``hashed`` has a row a molecule and is worked out once: each pair asks for both its molecules by one join, and their sets meet by one shuffle.
    """
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("int").alias("n"))
    asked = counted.select("a", "b", "n", F.inline(F.array(*[F.struct(F.col(c).alias("mol"), F.lit(i).alias("side")) for i, c in enumerate("ab")])))
    # Spark guesses the size of arrays and would broadcast sets that are far larger.
    told = asked.join(hashed.select("mol", F.struct("shingles", "minima").alias("one")).hint("merge"), "mol")
    met = told.withColumn("two", F.lead("one").over(Window.partitionBy("a", "b").orderBy("side"))).where("side = 0 AND two IS NOT NULL")
    equal = F.aggregate(F.zip_with("one.minima", "two.minima", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    exact = F.size(F.array_intersect("one.shingles", "two.shingles")) / F.size(F.array_union("one.shingles", "two.shingles"))
    each = met.select("a", "b", "n", (equal / F.size("one.minima")).alias("estimate"), exact.alias("exact"))
    return each.select("a", "b", "estimate", "exact", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("n")).drop("n")


def folded(sets: DataFrame, n_bits: int) -> DataFrame:
    """(mol, bits): shingles folded into ``n_bits`` places."""
    return sets.select("mol", F.array_sort(F.array_distinct(F.transform("shingles", lambda x: (x % n_bits).cast("int")))).alias("bits"))
