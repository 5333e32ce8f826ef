import pytest
from pyspark.sql import functions as F

from bondweave.operators import graph, local_counters, pairs, splits
from bondweave.sources import tables


def test_cleanup_numbers_and_checks(spark, monkeypatch):
    df = spark.createDataFrame([(2, "a", "b", 1.0), (1, "x", "y", 2.0), (1, "y", "x", 4.0), (1, None, "x", 5.0)], "mol long, x string, y string, t double")
    out = pairs.cleanup(df, ["mol"], ("x", "y"), ["mol", "t"], ["t"]).orderBy("rn").collect()
    assert [(r.rn, r.mol, r.t) for r in out] == [(1, 1, 3.0), (2, 1, 5.0), (3, 2, 1.0)]
    monkeypatch.setattr(pairs, "dedup_pairs", lambda df, *a: df)
    with pytest.raises(ValueError, match="twice"):
        pairs.cleanup(df, ["mol"], ("x", "y"), ["mol", "t"])


def test_radius_list():
    assert graph.radius_list([2, 4, 2, 0]) == [4, 2, 0] and graph.radius_list(3) == [3]
    for bad in ([], [1, 2, 3, 4], [-1], [1.5], [True]):
        with pytest.raises(ValueError):
            graph.radius_list(bad)


def test_masks_and_shared_rows(spark):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (2, "val"), (3, None), (4, "test")], "id long, split string")
    inside, outside = splits.masks(df, ["val", "test"])
    assert sorted(r.id for r in inside.collect()) == [2, 2, 4] and sorted(r.id for r in outside.collect()) == [1, 3]
    assert splits.masks(df, [])[0].count() == 0
    shared = splits.share_rows(df, F.col("id") > 1, "val")
    assert sorted((r.id, str(r.split)) for r in shared.collect()) == [(1, "train"), (2, "val"), (2, "val"), (3, "None"), (3, "val"), (4, "test"), (4, "val")]


def test_sorted_scan_and_file_to_file(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n2,x\n1,y\n3,z\n")
    rows = tables.scan_sorted(spark, str(tmp_path / "in.csv"), "a int, b string", ["a"], ascending=False)
    assert [r.a for r in rows.collect()] == [3, 2, 1]
    tables.transform_file(spark, str(tmp_path / "in.csv"), str(tmp_path / "out.parquet"), lambda df: df.where("a > 1"), "a int, b string")
    tables.transform_file(spark, str(tmp_path / "out.parquet"), str(tmp_path / "back.csv"), lambda df: df.withColumn("a", F.col("a") * 10))
    assert sorted(r.a for r in tables.scan_csv(spark, str(tmp_path / "back.csv"), "a int, b string").collect()) == [20, 30]


def test_label_table(spark):
    df = spark.createDataFrame([(1, 0, 2, None), (1, 1, 3, 5)], "mol long, bond long, `L0 - C` int, `L0 - H` int")
    assert [tuple(r) for r in local_counters.label_table(df).collect()] == [(0, "L0 - C", 5), (1, "L0 - H", 5)]


def test_rows_that_always_stay(spark):
    rows = [(1, "a", "b", 1.0, 0), (1, "b", "a", 3.0, 1), (1, "a", "b", 5.0, 2), (1, None, "b", 7.0, 3), (1, "b", None, 9.0, 4), (None, "a", "b", 2.0, 5), (None, "a", "b", 4.0, 6)]
    df = spark.createDataFrame(rows, "mol long, x string, y string, t double, n int")
    keep = F.col("x").isNull() | F.col("y").isNull() | (F.col("n") == 2)
    got = pairs.dedup_pairs(df, ["mol"], ("x", "y"), ["n"], ["t"], keep_if=keep).collect()
    assert sorted((r.n, r.t) for r in got) == [(0, 3.0), (2, 3.0), (3, 8.0), (4, 8.0), (5, 3.0)]
    assert sorted(r.n for r in pairs.dedup_pairs(df, ["mol"], ("x", "y"), ["n"], keep_if=F.lit(True)).collect()) == list(range(7))
    assert sorted(r.n for r in pairs.dedup_pairs(df, ["mol"], ("x", "y"), ["n"], keep_if=F.lit(None).cast("boolean")).collect()) == [0, 3, 5]


def test_too_many_templates(spark, monkeypatch):
    from bondweave.operators import lookup

    t, f = spark.createDataFrame([("a{}",), ("b{0}c",)], "t string"), spark.createDataFrame([(1,), (2,)], "f int")
    assert sorted(r.filled for r in lookup.fill_templates(t, f, "t", "f").collect()) == ["a1", "a2", "b1c", "b2c"]
    monkeypatch.setattr(lookup, "MAX_TEMPLATES", 1)
    with pytest.raises(ValueError):
        lookup.fill_templates(t, f, "t", "f")


def test_stereo_counts_far_atoms(spark):
    """Beside bond 0 (C-O) lies a cis bond from O to N, and none from C."""
    bonds = spark.createDataFrame([(1, 0, 0, 1, None), (1, 1, 1, 2, "Z"), (1, 2, 2, 3, None)], "mol long, bond long, a long, b long, stereo string")
    atoms = spark.createDataFrame([(1, 0, "C"), (1, 1, "O"), (1, 2, "N"), (1, 3, "C")], "mol long, atom long, symbol string")
    got = {r.bond: r.asDict() for r in local_counters.stereo_counters(bonds, atoms).collect()}
    pick = lambda b: tuple(got[b][n] for n in ("Cis Bond", "Cis Atom (C)", "Cis Atom (N)"))
    assert pick(0) == (1, 0, 1) and pick(1) == (0, 0, 0) and pick(2) == (1, 0, 0)
