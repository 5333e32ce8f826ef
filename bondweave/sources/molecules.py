"""Lists of molecules in text files: valid ones, rejected ones with a reason, and what each file and run came to."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A line: atoms as number:symbol, a bar, bonds as number-number.
_ATOM, _BOND = r"^\s*(\d+):([A-Z][a-z]?)\s*$", r"^\s*(\d+)-(\d+)\s*$"


def as_line(atoms: Column, bonds: Column) -> Column:
    """A molecule's line from arrays of (atom, symbol) and (a, b)."""
    a = F.transform(atoms, lambda x: F.concat_ws(":", x["atom"].cast("string"), x["symbol"]))
    b = F.transform(bonds, lambda x: F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string")))
    return F.concat_ws("|", F.array_join(a, ","), F.array_join(b, ","))


def read_molecules(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Valid molecules (file, line, atoms, bonds) and rejected lines (file, line, reason) of text files, one scan each.

    ``line`` is the text. Reasons: ``empty``, ``atoms`` (none, or not number:symbol), ``repeated atom``, ``bonds`` (not
    number-number), ``unknown atom`` of a bond, ``loop``. A molecule without bonds is valid. Nothing is dropped: each line is in one of the
    two tables.
    """
    text = spark.read.text(path if isinstance(path, str) else list(path)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    side = lambda i: F.filter(F.split(F.coalesce(F.get(F.split("line", r"\|", 2), F.lit(i)), F.lit("")), ","), lambda s: F.trim(s) != "")
    text = text.select("file", "line", F.inline(F.array(F.struct(side(0).alias("as"), side(1).alias("bs")))))
    part = lambda s, pattern, i: F.regexp_extract(s, pattern, i)
    atoms = F.transform("as", lambda s: F.struct(F.try_to_number(part(s, _ATOM, 1), F.lit("999999999999999999")).cast("long").alias("atom"), part(s, _ATOM, 2).alias("symbol")))
    bonds = F.transform("bs", lambda s: F.struct(F.try_to_number(part(s, _BOND, 1), F.lit("999999999999999999")).cast("long").alias("a"), F.try_to_number(part(s, _BOND, 2), F.lit("999999999999999999")).cast("long").alias("b")))
    rows = text.select("file", "line", "as", "bs", F.inline(F.array(F.struct(atoms.alias("atoms"), bonds.alias("bonds")))))
    known = F.transform("atoms", lambda a: a["atom"])
    reason = (
        F.when(F.trim("line") == "", "empty")
        .when((F.size("as") == 0) | F.exists("as", lambda s: ~s.rlike(_ATOM)) | F.exists("atoms", lambda a: a["atom"].isNull()), "atoms")
        .when(F.size(F.array_distinct(known)) < F.size(known), "repeated atom")
        .when(F.exists("bs", lambda s: ~s.rlike(_BOND)), "bonds")
        .when(F.exists("bonds", lambda b: ~F.array_contains(known, b["a"]) | ~F.array_contains(known, b["b"]) | b["a"].isNull() | b["b"].isNull()), "unknown atom")
        .when(F.exists("bonds", lambda b: b["a"] == b["b"]), "loop")
    )
    judged = rows.select("file", "line", "atoms", "bonds", reason.alias("reason"))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").select("file", "line", "reason")


def counts_by_file(valid: DataFrame, rejected: DataFrame, file: Column | None = None) -> DataFrame:
    """(file, molecules, bonds, rejected) of each file; ``file`` may shorten its name."""
    name = F.col("file") if file is None else file
    ok = valid.select(name.alias("file"), F.lit(1).alias("m"), F.size("bonds").alias("b"), F.lit(0).alias("r"))
    bad = rejected.select(name.alias("file"), F.lit(0).alias("m"), F.lit(0).alias("b"), F.lit(1).alias("r"))
    return ok.unionByName(bad).groupBy("file").agg(F.sum("m").alias("molecules"), F.sum("b").alias("bonds"), F.sum("r").alias("rejected"))


def measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df``, and an observation that holds its rows and ``metrics`` (aggregates) once an action has run: no pass of their own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]), seen


def timed_runs(spark: SparkSession, sources: Sequence[str], work: Callable[[str], DataFrame], repeats: int = 1) -> DataFrame:
    """(source, repeat, rows, seconds, rows_per_second): each source's work carried out in full, its rows counted on the way.

    ``sources`` names the files of a batch, few; the work on each is a Spark job.
    """
    rows = []
    for source in sources:
        for k in range(repeats):
            df, seen = measured(work(source))
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            rows.append((source, k, int(seen.get["rows"]), took, seen.get["rows"] / took))
    return spark.createDataFrame(rows, "source string, repeat int, rows bigint, seconds double, rows_per_second double")


def timing(runs: DataFrame) -> DataFrame:
    """(source, runs, rows, mean, std, rate): seconds over the repeats of each source, and its rows a second."""
    g = runs.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.max("rows").alias("rows"), F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("std"))
    return g.withColumn("rate", F.col("rows") / F.col("mean"))
