import math

import pytest
from pyspark.sql import functions as F

from bondweave.functions import scalar
from bondweave.schema import ReactionSchema, require_columns
from bondweave.sources import config, tables
from bondweave.streaming import requests


def test_roles(spark):
    df = spark.createDataFrame([("m", "x", "y", 3, "C-H", 1.5, "note")], "a string, b string, c string, d int, e string, f double, g string")
    assert ReactionSchema().project(df).columns == ["mol", "rad_x", "rad_y", "bidx", "btype", "target"]
    assert ReactionSchema(mol="g", radicals=None, bidx=None, btype=None, targets=("f",)).project(df).first() == ("note", 1.5)
    assert ReactionSchema().project(df, with_target=False).columns[-1] == "btype"
    for bad in (ReactionSchema(mol=9), ReactionSchema(mol="zz"), ReactionSchema(mol=1)):
        with pytest.raises(ValueError):
            bad.project(df)
    with pytest.raises(TypeError):
        require_columns(df, a="int")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"m,{i}", i / 2) for i in range(20)], "i long, m string, t double")
    path = str(tmp_path / "out.csv")
    tables.write_csv(df, path, one_file=True)
    assert tables.header_of(spark, path) == ["i", "m", "t"]
    back = tables.scan_csv(spark, path, "i long, m string, t double")
    assert sorted(back.collect()) == sorted(df.collect())
    assert tables.scan_csv(spark, path, columns=[1, "i"]).columns == ["m", "i"]
    assert sorted(int(r.i) for r in tables.scan_csv(spark, path, skip=15).collect()) == list(range(15, 20))
    assert tables.scan_csv(spark, path, limit=3).count() == 3
    both = tables.union_files(spark, [path, path], "i long, m string, t double")
    assert both.groupBy("file").count().first()["count"] == 40


def test_labels_rows_and_paths(spark, tmp_path):
    tables.write_labels(spark, ["a", "b c", "d"], str(tmp_path / "labels"))
    assert tables.read_labels(spark, str(tmp_path / "labels")) == ["a", "b c", "d"]
    spark.range(100).write.parquet(str(tmp_path / "p"))
    assert tables.scan_parquet(spark, str(tmp_path / "p"), "row").columns == ["id", "row"]
    good, bad = tables.split_valid(spark.createDataFrame([(1,), (None,), (5,)], "x int"), F.col("x") > 2)
    assert (good.count(), bad.count()) == (1, 2)
    assert tables.with_extension("a", "csv") == tables.with_extension("a.csv", ".csv") == "a.csv" and tables.without_extension("d/a.csv") == "d/a"


def test_config(tmp_path):
    path = str(tmp_path / "c.yaml")
    config.save({"a": 1, "b": {"c": [1, 2], "d": "x"}}, path)
    assert config.merge(config.load(path), {"b": {"d": "y"}}) == {"a": 1, "b": {"c": [1, 2], "d": "y"}}
    assert config.merge(config.load(path), {"b": {"d": "y"}, "n": 1}, replace=True) == {"a": 1, "b": {"d": "y"}, "n": 1}
    with pytest.raises(KeyError):
        config.merge({"a": 1}, {"z": 2})


# Published learning rates of epochs 0, 1, 6, 7, 13, 20, 30, 35, 50 and 51.
RATES = {0: 0.0015, 1: 0.00177, 6: 0.0040493312295359985, 7: 0.004005032674738681, 13: 0.003734267714447737, 20: 0.0013651454873541203, 30: 0.0004770997336281645, 35: 0.0004467554121649322, 50: 0.00010310180595153701, 51: 0.00010264459248540277}


def test_published_learning_rates(spark):
    rates = spark.range(1).select(scalar.learning_rates(F.lit(52))).first()[0]
    assert len(rates) == 52 and all(math.isclose(rates[e], r, rel_tol=1e-12) for e, r in RATES.items())
    assert spark.range(1).select(scalar.learning_rates(F.lit(1))).first()[0] == [0.0015]


def test_scalars(spark):
    one = spark.createDataFrame([("C-Cl.O/", 12, "B.A.C", "0101", 6, 4, 0, None)], "s string, n int, f string, b string, z int, v int, q int, e string")
    r = one.select(scalar.is_isomeric("s"), scalar.is_fragment("s"), scalar.is_fragment("e"), *scalar.two_fragments("f"), scalar.bits_of_string("b"), scalar.stable_atom("z", "v", "q"), scalar.fixed("n"), scalar.bond_type("f", "s")).first()
    assert list(r) == [True, False, False, "A", "B", [1, 3], True, "12.00", "B.A.C-C-Cl.O/"]
    assert one.select(*scalar.parse_label("s")).first() == (None, None, None)
    z = {row.id: row.o for row in spark.range(1, 55).select("id", scalar.outer_electrons("id").alias("o")).collect()}
    assert [z[i] for i in (1, 2, 3, 6, 9, 10, 17, 20, 26, 31, 35, 53)] == [1, 2, 1, 4, 7, 8, 7, 2, None, 3, 7, 7]
    assert scalar.layer_size(1024, 256) == int(math.sqrt(1024 * 8))


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:06:00")], "k long, s string").selectExpr("k", "CAST(s AS TIMESTAMP) AS ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ref = spark.createDataFrame([(1, 9.0)], "k long, v double")

    def run(df, mode="append"):
        q = df.writeStream.format("memory").queryName("t").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{hash(str(df))}")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table("t").collect()

    assert sorted((r.k, r.v) for r in run(requests.score(stream, ref, ["k"], -9999.0))) == [(1, 9.0), (1, 9.0), (2, -9999.0)]
    assert sorted(r.k for r in run(requests.recent_once(stream, ["k"]))) == [1, 2]
    assert [r.n for r in run(requests.counts_by_window(stream), "complete")] == [3]


def test_octets_follow_their_definition(spark):
    """Hydrogen and helium want exactly 2, others exactly 8, and transition metals are never stable."""
    rows = [(1, 1, 0, True), (1, 0, 0, False), (2, 0, 0, True), (6, 4, 0, True), (6, 3, 0, False), (4, 0, 0, False), (26, 2, 0, False), (30, 0, 0, False), (8, 2, 0, True), (7, 4, 1, True), (17, 0, -1, True), (35, 1, 0, True), (57, 5, 0, False), (82, 4, 0, True), (None, 4, 0, False)]
    df = spark.createDataFrame(rows, "z int, v int, q int, want boolean")
    assert [(r.z, r.ok) for r in df.withColumn("ok", scalar.stable_atom("z", "v", "q")).collect()] == [(z, w) for z, _, _, w in rows]


def test_integer_types():
    assert [scalar.narrowest_integer(n) for n in (0, 127, 128, 32767, 32768, 2**31 - 1, 2**31)] == ["tinyint", "tinyint", "smallint", "smallint", "int", "int", "bigint"]


def test_ranges_and_types_are_required(spark):
    import pytest

    from bondweave.schema import require_homogeneous, require_range

    df = spark.createDataFrame([(1, 2.0), (5, None)], "a int, b double")
    assert require_range(df, a=(1, 5), b=(0, 3)).count() == 2
    with pytest.raises(Exception, match="a outside"):
        require_range(df, a=(1, 4)).collect()
    with pytest.raises(TypeError):
        require_homogeneous(df, "a", "b")
