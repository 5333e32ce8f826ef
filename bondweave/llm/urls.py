"""URL filters as a sort-merge range join: a sorted sweep with a stack of active nested rules."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: URLs that set the cuts between ranges: a sample by hash, so many for each range. The cuts decide
#: which task sweeps a URL, never its result.
CUT_SAMPLE = 50

# The rules of the contract (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return _lower(host)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a dot: a host's subdomains are exactly the keys that start with its key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit(".")))


def rules_frame(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by range and key, rules before URLs of the same key. The stack holds the rules of
    the hosts that enclose the current key, innermost last; what no longer encloses it is popped."""
    at, stack = None, []  # stack: (host key, {path: (rule, verdict)}, lengths of these paths, longest first)
    for pdf in batches:
        found = []
        for rng, key, path, verdict, rule in zip(pdf["range"], pdf["key"], pdf["path"], pdf["verdict"], pdf["rule"]):
            if rng != at:
                at, stack = rng, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            best = None
            if rule is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, paths, lengths = stack[-1]
                paths[path] = (rule, verdict)
                if len(path) not in lengths:
                    insort(lengths, len(path), key=lambda n: -n)
            else:
                for _, paths, lengths in stack:
                    # A look-up for each length, so a host may have any number of rules.
                    fits = next((paths[path[:n]] for n in lengths if path[:n] in paths), None)
                    # Longest host and path together; the deeper host wins a tie, as it comes later.
                    if fits and (best is None or len(fits[0]) >= len(best[0])):
                        best = fits
            found.append(best or (None, None))
        is_url = pdf["rule"].isna()
        pdf = pdf.assign(rule=[f[0] for f in found], verdict=[f[1] for f in found])
        yield pdf.loc[is_url, ["id", "host", "path", "rule", "verdict"]]


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", ranges: int | None = None, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``: the longest rule that fits its URL.

    A rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with its
    path. No rule gives a null ``rule`` and the default verdict. Null URLs and those without :// have an
    empty host and path, which no rule with a host fits. Repeated rows stay; of rules with one host and
    path the least verdict counts (allow before block); no rules or an empty table work like any other.

    Keys are cut into ranges by (host key, path, id), so a hot host is split. A rule goes to every range
    that its host interval meets: one or two, unless it encloses whole ranges. Within a range a sweep
    over the sorted keys meets rules and URLs in one pass; its state is the stack of enclosing rules.
    """
    spark = pages.sparkSession
    url = F.col("_url")
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url")).select("id", host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    spread = F.lower(F.hex(F.xxhash64("id", "host", "path")))
    urls = urls.withColumn("place", F.concat("key", F.lit("\x00"), F.col("path"), F.lit("\x00"), spread))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The sample: places whose hash lies below a share of all hashes, so about as many whatever the table's size; a repeated one counts once.
    share = CUT_SAMPLE * ranges / max(1, pages.count())
    below = F.lit(True) if share >= 1 else F.shiftrightunsigned(F.xxhash64("place"), 32) < int(share * 2**32)
    sample = sorted(r[0] for r in urls.where(below).select("place").distinct().collect())
    cuts = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return place.map(lambda p: bisect_right(cuts, p)).astype("int32")

    @F.pandas_udf("array<int>")
    def ranges_met(key: pd.Series) -> pd.Series:
        # Keys with this prefix lie in [key, key with its last dot made a slash).
        return key.map(lambda k: list(range(bisect_right(cuts, k), bisect_right(cuts, k[:-1] + "/" if k else "\U0010ffff") + 1)))

    id_type = urls.schema["id"].dataType
    none = F.lit(None).cast("string")
    r = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    r = r.withColumn("key", host_key(_lower(F.col("host")))).withColumn("range", F.explode(ranges_met("key")))
    r = r.select("range", "key", "path", "verdict", F.concat("host", "path").alias("rule"), F.lit("").alias("place"), F.lit(None).cast(id_type).alias("id"), none.alias("host"))
    u = urls.select(range_of("place").alias("range"), "key", "path", none.alias("verdict"), none.alias("rule"), "place", "id", "host")
    events = r.unionByName(u).repartitionById(ranges, "range").sortWithinPartitions("range", "key", F.col("rule").isNull(), "place").drop("place")
    found = events.mapInPandas(_sweep, T.StructType([T.StructField("id", id_type)] + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
