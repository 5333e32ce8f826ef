import math
import random

import pytest
from pyspark.sql import functions as F

from bondweave.operators import bits, filters, graph, local_counters, lookup, models, score, stats


def random_graphs(n, seed):
    rnd = random.Random(seed)
    rows = []
    for m in range(n):
        edges = {tuple(sorted(rnd.sample(range(8), 2))) for _ in range(rnd.randint(1, 11))}
        rows += [(m, i, a, b) for i, (a, b) in enumerate(sorted(edges))]
    return rows


def line_distances(edges, core):
    dist, front = {core: 0}, [core]
    while front:
        nxt = []
        for e in front:
            for f in edges:
                if f not in dist and {edges[f][0], edges[f][1]} & {edges[e][0], edges[e][1]}:
                    dist[f] = dist[e] + 1
                    nxt.append(f)
        front = nxt
    return dist


def side(edges, core):
    out = {}
    for label, start in (("y", edges[core][1]), ("x", edges[core][0])):
        seen, stack = {start}, [start]
        while stack:
            x = stack.pop()
            for e, (a, b) in edges.items():
                if e != core and x in (a, b) and (o := a if x == b else b) not in seen:
                    seen.add(o)
                    stack.append(o)
        out |= dict.fromkeys(seen, label)
    return out


def test_environments_and_fragments(spark):
    rows = random_graphs(25, 1)
    b = spark.createDataFrame(rows, "mol long, bond long, a long, b long")
    by = {}
    for m, i, x, y in rows:
        by.setdefault(m, {})[i] = (x, y)
    cores = b.select("mol", F.col("bond").alias("core"))
    got = {}
    for r in graph.environments(b, cores, [0, 1, 3]).collect():
        got.setdefault((r.mol, r.core, r.radius), {})[r.bond] = r.dist
    for m, edges in by.items():
        for core in edges:
            d = line_distances(edges, core)
            for radius in (0, 1, 3):
                assert got[m, core, radius] == {e: k for e, k in d.items() if k <= radius}
    sides = {}
    for r in graph.break_bonds(b, cores).collect():
        sides.setdefault((r.mol, r.core), {})[r.atom] = r.side
    assert sides == {(m, core): side(edges, core) for m, edges in by.items() for core in edges}


def test_core_to_hydrogen_stays(spark):
    b = spark.createDataFrame([(0, 0, 1, 9), (0, 1, 1, 2), (0, 2, 2, 9)], "mol long, bond long, a long, b long")
    got = graph.bond_environment(b, spark.createDataFrame([(0, 0)], "mol long, core long"), 2, F.col("b") != 9).collect()
    assert sorted((r.bond, r.dist) for r in got) == [(0, 0), (1, 1)]
    assert graph.bond_environment(b.limit(0), b.limit(0).select("mol", F.col("bond").alias("core")), 2).collect() == []


def test_counters(spark):
    atoms = spark.createDataFrame(
        [(0, 0, "C", "SP3", False, False, False, 0), (0, 1, "Cl", "SP3", False, False, False, -1), (0, 2, "S", "S", True, True, True, 2)],
        "mol long, atom long, symbol string, hybrid string, aromatic boolean, in_ring boolean, in_ring6 boolean, charge int",
    )
    bonds = spark.createDataFrame([(0, 0, 0, 1, "SINGLE", False, False, False), (0, 1, 0, 2, "DOUBLE", True, False, True)], "mol long, bond long, a long, b long, kind string, b_ring boolean, b_ring6 boolean, conjugated boolean")
    out = local_counters.local_counters(atoms, bonds)
    assert len(out.columns) == 2 + 54
    r = out.where("bond = 0").first().asDict()
    assert (r["L0 - C"], r["L0 - Cl"], r["L0 - SP3"], r["L0 - NCharge"], r["L0 - NumNCharge"]) == (1, 1, 2, 1, 1)
    assert (r["L1 - P-S"], r["L1 - S"], r["L1 - Aromatic"], r["L1 - NumPCharge"], r["L0 - S"], r["L0 - S (hybrid)"]) == (1, 1, 1, 2, 0, 0)
    assert (r["L0 bond - SINGLE"], r["L1 bond - DOUBLE-DATIVE-TRIPLE"], r["L1 bond - RING"], r["L1 bond - Conjugated"]) == (1, 1, 1, 1)


def test_morgan_bits_follow_structure_not_numbers(spark):
    def mol(m, shift):
        return [(m, 0, 0 + shift, 1 + shift), (m, 1, 1 + shift, 2 + shift), (m, 2, 2 + shift, 3 + shift)]

    b = spark.createDataFrame(mol(0, 0) + mol(1, 40), "mol long, bond long, a long, b long")
    atoms = b.select("mol", F.explode(F.array("a", "b")).alias("atom")).distinct().withColumn("symbol", F.when(F.col("atom") % 4 == 3, "O").otherwise("C"))
    got = {r.mol: r.bits for r in graph.morgan_bits(b, atoms, 2, 4096).collect()}
    assert got[0] == got[1] and len(got[0]) > 4


def test_bits(spark):
    df = spark.createDataFrame([(0, [0, 2, 5]), (1, [2, 3]), (2, [2])], "i long, bits array<int>")
    assert sorted(r.bit for r in bits.constant_bits(df, 7).collect()) == [1, 2, 4, 6]
    assert bits.constant_bits(df, 7, legacy_small_n=True).count() == 0
    kept, (once,) = bits.fit_prune(df, [], 7)
    assert kept == [0, 3, 5] and sorted(r.bits for r in once.collect()) == [[], [0, 5], [3]]
    assert bits.prune_bits(once, [1, 2]).collect() == bits.prune_bits(bits.prune_bits(once, [1, 2]), [1, 2]).collect()
    assert bits.prune_bits(df, []).collect() == df.collect()
    assert df.select(bits.concat_bits([("bits", 6), ("bits", 6)])).first()[0] == [0, 2, 5, 6, 8, 11]
    assert df.select(bits.to_vector(F.col("bits"), 6)).first()[0].toArray().tolist() == [1, 0, 1, 0, 0, 1]
    assert bits.reconcile(["a", "b", "c", "d"], ["a", "d"]) == [1, 2]
    with pytest.raises(ValueError):
        bits.reconcile(["a", "b"], ["b", "a"])


def test_rule_means(spark):
    rows = [(1, 10.0, 0), (1, 20.0, 1), (2, 10.0, 0), (2, 30.0, 0), (3, 5.0, 1), (4, 0.0, 1), (4, 10.0, 0), (4, 20.0, 0), (5, 1.0, 1), (5, 1.0, 1), (5, 1.0, 1), (5, 9.0, 0)]
    got = {r.g: (r.t, r.recommend) for r in stats.rule_mean(spark.createDataFrame(rows, "g long, t double, rec int"), ["g"], {"t": 4}, "rec").collect()}
    assert got == {1: (18.0, -1), 2: (20.0, 0), 3: (5.0, -1), 4: (4.5, -1)}


def test_statistics(spark):
    e = spark.createDataFrame([(x,) for x in (0.0, -0.1, 0.25, 4.99, 5.0, -7.5, 100.0)], "e double")
    assert {r.bin: r.n for r in stats.histogram(e, "e").collect()} == {0: 2, 1: 1, 19: 1, 20: 3}
    r = stats.quality_report(e, "e").first()
    assert r.n == 7 and math.isclose(r.below_1, 300 / 7) and math.isclose(r.above_5, 200 / 7)
    one = spark.createDataFrame([(3.0,)], "x double")
    assert stats.min_max_scale(one, "x", 2, 4).first().scaled == 2
    assert stats.best_row(spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 1.0)], "epoch long, loss double"), "loss", "epoch").first().best_epoch == 2


def test_lookup(spark):
    ref = lookup.build_reference(spark.createDataFrame([(1, 0, 5.0), (1, 1, None), (2, 0, 7.0)], "k long, i long, v double"), ["k"], ["v"], ["i"])
    probe = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    got = {r.k: r.v for r in lookup.attach_reference(probe, ref, ["k"], lookup.MISSING).collect()}
    assert got == {1: -9999.0, 2: 7.0, 3: -9999.0, None: -9999.0}
    assert {r.k: r.known for r in lookup.membership(probe, ref, ["k"]).collect()} == {1: True, 2: True, 3: False, None: False}


def test_filters(spark):
    df = spark.createDataFrame([("C", "Cl", ["C", "H"]), ("Cl", "C", ["H", "H"]), ("C", "C", ["C"])], "sa string, sb string, na array<string>")
    n = lambda c: df.where(c).count()
    assert n(filters.element_pair(("Cl",))) == 2 and n(filters.element_pair(("C", "Cl"))) == 2 and n(filters.element_pair(("C", "C"))) == 1
    assert n(filters.has_neighbors("na", {"H": 1})) == 2 and n(filters.has_neighbors("na", {"H": 1}, strict=True)) == 0
    assert n(filters.allowed_class("sa", [], ["C"])) == 0 and n(filters.allowed_class("sa", ["C", "Cl"], ["C", "Cl"])) == 3
    with pytest.raises(ValueError):
        filters.element_pair(())


def test_scores_and_models(spark):
    rnd = random.Random(3)
    rows = [(i, x := rnd.random(), y := rnd.random(), 3 * x - 2 * y + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, x double, y double, t double")
    p = models.predict(df, models.fit(df, ["x", "y"], "t"))
    assert p.agg(F.max(F.abs(F.col("t") - F.col("prediction")))).first()[0] < 1e-3
    imp = {r.feature: r.mean for r in models.importances(df, ["x", "y"], "t").collect()}
    assert imp["x"] > imp["y"] and math.isclose(sum(imp.values()), 1, rel_tol=1e-6)
    assert models.principal_components(df, ["x", "y"], 1, ["i"]).columns == ["i", "pc_1"]
    reg = models.Registry(weights={0: (0.5, {1: 0.25, 2: 0.75})})
    m = models.fit(df, ["x", "y"], "t")
    reg.register(0, 1, m)
    reg.register(0, 2, m)
    r = reg.score(df, 0).first()
    assert math.isclose(r.mean, r.p1) and math.isclose(r.ensemble, r.p1 + 0.5)
    perf = score.performance_columns(df.withColumn("p", F.col("t") - 1), ["p"], ["t"], keep=["i"])
    assert perf.columns[1:] == ["#0-BDE: Target", "#0-BDE: Predict", "#0-BDE: RelError", "#0-BDE: AbsError"]
    assert math.isclose(perf.first()["#0-BDE: RelError"], 1)
