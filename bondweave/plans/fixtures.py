"""Reaction tables, small graphs and ordered events, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of the reaction table.
ORDER = ["mol", "bidx", "pk", "sk", "target", "qty", "ship"]

ELEMENTS = ("C", "H", "O", "N", "F", "Cl", "Br", "S")
#: Orders that make up a molecule, and atoms on each side; molecules grow in number with the tables, never in size.
ORDERS, ATOMS = 5, 16
#: Bonds that one task works on.
ROWS = 100_000
#: Up to so many tasks a shuffle writes each one's rows to a file as they come; beyond, Spark holds and sorts all rows of the task that deals them.
FILES = 200

# The same tables as common table expressions, for the SQL of the catalogue.
RX = """rx AS (SELECT CAST(l_orderkey AS BIGINT) AS mol, CAST(l_partkey % 5 AS BIGINT) AS rad_x, CAST(l_suppkey % 5 AS BIGINT) AS rad_y,
  CAST(l_linenumber AS BIGINT) AS bidx, least(l_returnflag, l_linestatus) || '-' || greatest(l_returnflag, l_linestatus) AS btype,
  CAST(l_extendedprice AS DOUBLE) AS target, CAST(l_partkey AS BIGINT) AS pk, CAST(l_suppkey AS BIGINT) AS sk, CAST(l_quantity AS DOUBLE) AS qty,
  l_shipdate AS ship, CAST(l_discount AS DOUBLE) AS disc, CAST(l_tax AS DOUBLE) AS tax, l_returnflag AS flag, l_linestatus AS state FROM lineitem)"""
MG = f"""mg AS (SELECT mol, CAST(row_number() OVER (PARTITION BY mol ORDER BY a, b) - 1 AS BIGINT) AS bond, a, b FROM (
  SELECT DISTINCT CAST(l_orderkey // {ORDERS} AS BIGINT) AS mol, CAST(l_partkey % {ATOMS} AS BIGINT) AS a, CAST({ATOMS} + l_suppkey % {ATOMS} AS BIGINT) AS b FROM lineitem))"""
PREDS = """preds AS (SELECT *, target * (1 - disc) AS p1, target * (1 - tax) AS p2, target * 0.95 AS p3 FROM rx)"""


def rx(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c = F.col
    return t.select(
        c("l_orderkey").cast("long").alias("mol"),
        (c("l_partkey") % 5).cast("long").alias("rad_x"),
        (c("l_suppkey") % 5).cast("long").alias("rad_y"),
        c("l_linenumber").cast("long").alias("bidx"),
        F.concat_ws("-", F.least("l_returnflag", "l_linestatus"), F.greatest("l_returnflag", "l_linestatus")).alias("btype"),
        c("l_extendedprice").cast("double").alias("target"),
        c("l_partkey").cast("long").alias("pk"),
        c("l_suppkey").cast("long").alias("sk"),
        c("l_quantity").cast("double").alias("qty"),
        c("l_shipdate").alias("ship"),
        c("l_discount").cast("double").alias("disc"),
        c("l_tax").cast("double").alias("tax"),
        c("l_returnflag").alias("flag"),
        c("l_linestatus").alias("state"),
    )


def mg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bonds(mol, bond, a, b); bonds are numbered from 0 by their atoms. Rows are dealt by molecule once, ROWS to a task, and what works by molecule
    needs no other shuffle; the number of tasks grows with the table, and what one of them holds does not. A scan's task may read any number of
    rows, so those for more than FILES tasks are first dealt to FILES: what the dealing holds is then a FILES-th of the table."""
    from pyspark.sql import Window

    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tasks = max(spark.sparkContext.defaultParallelism, -(-t.count() // ROWS))
    mol = F.expr(f"l_orderkey div {ORDERS}").cast("long")
    if tasks > FILES:
        t = t.select("l_orderkey", "l_partkey", "l_suppkey").repartition(FILES, mol)
    e = t.select(
        mol.alias("mol"),
        (F.col("l_partkey") % ATOMS).cast("long").alias("a"),
        (ATOMS + F.col("l_suppkey") % ATOMS).cast("long").alias("b"),
    ).repartition(tasks, "mol").distinct()
    return e.select("mol", (F.row_number().over(Window.partitionBy("mol").orderBy("a", "b")) - 1).cast("long").alias("bond"), "a", "b")


def all_bonds(bonds: DataFrame) -> DataFrame:
    """Every bond of every molecule, as core."""
    return bonds.select("mol", F.col("bond").alias("core"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arithmetic models beside the target."""
    t = F.col("target")
    return rx(spark, sf_dir).select("*", (t * (1 - F.col("disc"))).alias("p1"), (t * (1 - F.col("tax"))).alias("p2"), (t * 0.95).alias("p3"))


def element(atom: str | Column):
    at = F.col(atom) if isinstance(atom, str) else atom
    return F.element_at(F.array(*[F.lit(e) for e in ELEMENTS]), (at % len(ELEMENTS) + 1).cast("int"))


def _properties(at: Column) -> list[Column]:
    """Invented properties that follow from an atom's number."""
    hybrid = F.element_at(F.array(*[F.lit(h) for h in ("S", "SP", "SP2", "SP3", "SP3D")]), (at % 5 + 1).cast("int"))
    return [at.alias("atom"), element(at).alias("symbol"), hybrid.alias("hybrid"), (at % 3 == 0).alias("aromatic"), (at % 2 == 0).alias("in_ring"), (at % 4 == 0).alias("in_ring6"), (at % 3 - 1).cast("int").alias("charge")]


def atoms(bonds: DataFrame) -> DataFrame:
    """Atoms of the graphs with invented properties that follow from their numbers."""
    a = bonds.select("mol", F.explode(F.array("a", "b")).alias("atom")).distinct()
    return a.select("mol", *_properties(F.col("atom")))


def with_ends(bonds: DataFrame) -> DataFrame:
    """Bonds that carry the records of ``atoms`` of their ends, so that no table of atoms is needed beside them."""
    return bonds.withColumns({f"end_{n}": F.struct(*_properties(F.col(n))) for n in ("a", "b")})


def bits(bonds: DataFrame) -> DataFrame:
    """(mol, bits): bits below 64 from the bonds, bit 64 always set, bit 65 never."""
    bit = ((F.col("a") * 31 + F.col("b") * 17) % 64).cast("int")
    return bonds.groupBy("mol").agg(F.array_sort(F.array_union(F.collect_set(bit), F.array(F.lit(64)))).alias("bits"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")
