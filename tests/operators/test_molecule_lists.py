from pyspark.sql import functions as F

from bondweave.operators import graph
from bondweave.sources import molecules


def test_valid_and_rejected_lines(spark, tmp_path):
    good = ["0:C,1:H,2:Cl|0-1,0-2", " 7:N |", "3:C", "1:C, 2:C | 1-2"]
    bad = {"": "empty", "   ": "empty", "C,H|0-1": "atoms", "|0-1": "atoms", "0:C,0:H|": "repeated atom", "0:C,1:H|0=1": "bonds", "0:C|0-1": "unknown atom", "0:C,1:C|1-1": "loop", "0:carbon|": "atoms", "99999999999999999999:C|": "atoms"}
    (tmp_path / "a.txt").write_text("\n".join(good[:2] + list(bad)[:5]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(good[2:] + list(bad)[5:]) + "\n")
    valid, rejected = molecules.read_molecules(spark, str(tmp_path))
    assert sorted(r.line for r in valid.collect()) == sorted(good)
    assert {r.line: r.reason for r in rejected.collect()} == bad
    first = valid.where("line LIKE '0:C,1:H%'").first()
    assert [tuple(a) for a in first.atoms] == [(0, "C"), (1, "H"), (2, "Cl")] and [tuple(b) for b in first.bonds] == [(0, 1), (0, 2)]
    counts = molecules.counts_by_file(valid, rejected, F.substring_index("file", "/", -1))
    assert {r.file: (r.molecules, r.bonds, r.rejected) for r in counts.collect()} == {"a.txt": (2, 2, 5), "b.txt": (2, 1, 5)}


def test_metrics_come_with_the_action(spark, tmp_path):
    df, seen = molecules.measured(spark.range(100), largest=F.max("id"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 100, "largest": 99}
    for name, n in (("x", 10), ("y", 1000)):
        spark.range(n).write.parquet(str(tmp_path / name))
    runs = molecules.timed_runs(spark, [str(tmp_path / "x"), str(tmp_path / "y")], spark.read.parquet, repeats=2)
    got = {r.source[-1]: r for r in molecules.timing(runs).collect()}
    assert (got["x"].rows, got["y"].rows, got["x"].runs) == (10, 1000, 2) and got["y"].rate > got["x"].rate > 0


def test_every_code_of_a_review(spark):
    bonds = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 2), (2, 0, 0, 1), (2, 1, 1, 2), (2, 2, 2, 0)], "mol long, bond long, a long, b long")
    atoms = spark.createDataFrame([(1, 0, "C"), (1, 1, "O"), (1, 2, "H"), (2, 0, "C"), (2, 1, "C"), (2, 2, "C")], "mol long, atom long, symbol string")
    fragments = graph.fragment_names(bonds, atoms, bonds.select("mol", F.col("bond").alias("core")))
    rows = [(1, 0, "HO", "C", "k"), (1, 0, "C", "O", "k"), (1, 0, "N", "HO", "k"), (1, 0, None, "C", "k"), (2, 0, "C", "CC", "k"), (1, 9, "C", "HO", "k"), (1, 1, "CO", "H", "k"), (1, 1, "C", "HO", "k")]
    df = spark.createDataFrame(rows, "mol long, bidx long, frag_x string, frag_y string, note string")
    got = sorted(map(tuple, graph.review_reactions(df, bonds, atoms, fragments).collect()), key=str)
    want = [
        (1, 0, "HO", "C", "k", "C-O", 1, 1),
        (1, 0, "C", "HO", "k", "C-O", 0, 1),  # a hydrogen is missing: the fragments found take their place
        (1, 0, "N", "HO", "k", "ERROR", 0, -99),
        (1, 0, None, "C", "k", "ERROR", 0, -999),
        (2, 0, "C", "CC", "k", "ERROR", 0, -999),  # a ring
        (1, 9, "C", "HO", "k", None, 0, 0),
        (1, 1, "CO", "H", "k", "H-O", 1, 1),
        (1, 1, "C", "HO", "k", "ERROR", 1, -99),
    ]
    assert got == sorted(want, key=str)
