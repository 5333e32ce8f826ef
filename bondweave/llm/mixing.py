"""Mixing sources to target weights with hash-threshold histograms.

Everything here is DataFrame and SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import with_ordinal
from ._common import broadcast_if_small, materialize, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
#: Bits of the hash that one histogram resolves, and how many are nested before the boundary is settled.
LEVEL_BITS = 12
LEVELS = 5
#: At most so many sources are broadcast, about 100 bytes each.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets (source, source_size, target) from a table with one row (source, source_size) for each source.

    Sources in code-point order, null last, get ``weights`` in turn and share the sum of all sizes by
    weight. A target stops at ``cap`` times its source's size, and the excess is shared among the others
    by weight until none is above. The level (target per weight of those below their caps) rises with each
    round of sums, one row each, until no more sources are capped, so no task ever holds all sources.
    """
    ranked = with_ordinal(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rn")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_rn") - 1) % len(weights) + 1).cast("int"))
    t = ranked.select("source", "source_size", w.alias("w"), (F.col("source_size").cast("double") * cap).alias("cap"))
    t = materialize(t, "source-weights")
    level, capped = 0.0, F.lit(False)
    while True:
        free = ~capped
        r = t.agg(F.sum(F.col("source_size").cast("double")).alias("total"), F.sum(F.when(capped, F.col("cap"))).alias("caps"), F.sum(F.when(free, F.col("w"))).alias("w")).first()
        if not r["w"]:
            level = float("inf")
            break
        new = ((r["total"] or 0.0) - (r["caps"] or 0.0)) / r["w"]
        if new <= level:
            break
        level = new
        capped = F.col("cap") / F.col("w") < level
    return t.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def _bucket(h: Column, level: int) -> Column:
    return F.shiftrightunsigned(h, 64 - LEVEL_BITS * (level + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the place in hash order up to which rows are taken, so that their sizes use up ``budget``.

    ``rows``: (source, h, size); ``budgets``: (source, budget). Returns (source, cut, copies, take, rest): rows whose
    leading 60 bits of h lie below ``cut`` (unsigned) are taken; of the ``copies`` rows at the cut, which are one row or equal
    ones, ``take`` are, as many as come nearest to the budget, and ``rest`` of it is left (below 0: so much is too much). Each
    level sums sizes by source and hash bucket, finds the bucket in which the budget is used up, and only
    the rows of that bucket go on to the next level, which splits it finer, until it holds one hash. Sources whose rows do
    not use up the budget are not returned. A window never holds more than the 4096 buckets of one source.
    """
    state = budgets.select(F.col("source").alias("_of"), F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    settled = []
    for level in range(LEVELS):
        inside = rows.join(state, F.col("source").eqNullSafe(F.col("_of")))
        if level:
            inside = inside.where(F.shiftrightunsigned("h", 64 - LEVEL_BITS * level) == F.col("prefix"))
        sums = [F.sum("size").cast("double").alias("s"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left"), F.first("prefix").alias("prefix"), F.min("h").alias("low"), F.max("h").alias("high")]
        hist = inside.groupBy("source", _bucket(F.col("h"), level).alias("b")).agg(*sums)
        hist = hist.withColumn("upto", F.sum("s").over(Window.partitionBy("source").orderBy("b")))
        found = hist.where("upto >= left").groupBy("source").agg(F.min_by(F.struct("b", "s", "n", "upto", "left", "prefix", "low", "high"), "b").alias("x"))
        rest = F.col("x.left") - (F.col("x.upto") - F.col("x.s"))
        prefix = F.shiftleft("x.prefix", LEVEL_BITS) + F.col("x.b")
        one = (F.col("x.low") == F.col("x.high")) | F.lit(level == LEVELS - 1)  # of one hash: finer buckets settle nothing more
        each = F.col("x.s") / F.col("x.n")
        take = F.least(F.round(rest / each), F.col("x.n")).cast("long")
        at = F.when(one, F.struct(_top("x.low").alias("cut"), F.col("x.n").alias("copies"), take.alias("take"), (rest - take * each).alias("rest"))).alias("at")
        found = materialize(found.select(F.col("source").alias("_of"), rest.alias("left"), prefix.alias("prefix"), at), "boundary")
        settled.append(found.where("at IS NOT NULL"))
        state = found.where("at IS NULL").drop("at")
        if not state.limit(1).count():
            break
    return reduce(DataFrame.unionByName, settled).select(F.col("_of").alias("source"), "at.*")


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _top(h: str = "h") -> Column:
    return F.shiftrightunsigned(h, 64 - LEVEL_BITS * LEVELS)


def source_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, int]:
    """How each source meets its target, and the number of sources, from rows (source, h, size).

    (_source, source_size, target, full, cut, copies, take, rest, cut2, copies2, take2): ``full`` whole passes, and one more
    over the rows below ``cut`` and ``take`` of those at it (null: no partial pass). What that leaves of the budget,
    ``rest``, goes to rows after it that are no larger, up to ``cut2`` in the same way (null: all of them).
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(cap))).otherwise(0)
    targets = materialize(targets.withColumn("full", whole.cast("long")), "mix-targets")
    budgets = targets.where("source_size > 0").select("source", (F.col("target") - F.col("full") * F.col("source_size")).alias("budget")).where("budget > 0.5")
    first = thresholds(rows.select("source", "h", "size"), budgets)
    known = first.withColumnRenamed("source", "_first")
    after = rows.join(known, F.col("source").eqNullSafe(F.col("_first"))).where((_top() > F.col("cut")) & (F.col("size") <= F.col("rest")))
    second = thresholds(after.select("source", "h", "size"), first.select("source", F.col("rest").alias("budget")).where("budget > 0.5"))
    second = second.select(F.col("source").alias("_second"), F.col("cut").alias("cut2"), F.col("copies").alias("copies2"), F.col("take").alias("take2"))
    plan = targets.join(known, F.col("source").eqNullSafe(F.col("_first")), "left").join(second, F.col("source").eqNullSafe(F.col("_second")), "left")
    plan = materialize(plan.select(F.col("source").alias("_source"), "source_size", "target", "full", "cut", "copies", "take", "rest", "cut2", "copies2", "take2"), "mix-plan")
    return plan, plan.count()


def _with_passes(rows: DataFrame, plan: DataFrame, n_sources: int, size: Column, spread: Column) -> DataFrame:
    """Add ``passes``: how often the mix takes each row; needs columns source and h.

    Only of equal rows at a cut some are taken and some not. These are numbered, in the order of ``spread`` and then as
    they are stored, in ranges that split them however many they are; most sources have one row there, and no such step.
    """
    joined = rows.join(broadcast_if_small(plan, n_sources, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")))
    fits = size <= F.col("rest")
    first, second = F.coalesce(_top() == F.col("cut"), F.lit(False)), F.coalesce((_top() == F.col("cut2")) & fits, F.lit(False))
    after = (_top() > F.col("cut")) & (F.col("cut2").isNull() | (_top() < F.col("cut2"))) & fits
    partial = F.when(first, F.col("take") > 0).when(second, F.col("take2") > 0).otherwise(F.coalesce((_top() < F.col("cut")) | after, F.lit(False)))
    passes = F.col("full") + partial.cast("long")
    some = lambda copies, take: (F.col(copies) > 1) & (F.col(take) > 0) & (F.col(take) < F.col(copies))
    if not plan.where(some("copies", "take") | some("copies2", "take2")).limit(1).count():
        return joined.withColumn("passes", passes)
    split = (first & some("copies", "take")) | (second & F.coalesce(some("copies2", "take2"), F.lit(False)))
    split = F.coalesce(split, F.lit(False))
    kept = [c for c in joined.columns if c not in ("_spread", "_nth")]
    shared = materialize(joined.where(split).select(*kept, first.alias("_at_first"), spread.alias("_spread")), "rows-at-cuts").withColumn("_nth", F.monotonically_increasing_id())
    numbered = with_ordinal(shared.withColumn("_none", F.col("source").isNull()), ["_none", "source", "_at_first", "_spread", "_nth"], "_rn")
    numbered = materialize(numbered, "numbered-rows")
    starts = numbered.groupBy("source", "_at_first").agg((F.min("_rn") - 1).alias("_start")).select(F.col("source").alias("_of"), F.col("_at_first").alias("_which"), "_start")
    ranked = numbered.join(broadcast_if_small(starts, 2 * n_sources, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_of")) & (F.col("_at_first") == F.col("_which")))
    taken = F.col("_rn") - F.col("_start") <= F.when(F.col("_at_first"), F.col("take")).otherwise(F.col("take2"))
    return joined.where(~split).withColumn("passes", passes).unionByName(ranked.select(*kept, (F.col("full") + taken.cast("long")).alias("passes")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """Mix of all documents: (doc_id, size, source, source_size, target, taken), one row for each document.

    A source's target is met by whole passes over it, as many as fit (``cap`` at most), and by one
    partial pass: the documents whose hash of id, text and ``seed`` lies below the source's threshold,
    the document at the threshold if that comes nearer, and then such as still fit into what is left. So each source is
    off by half of its largest document at most.
    ``taken`` is the number of words that the mix takes from a document, repeats counted. Reruns and
    other partitionings agree. Null and empty texts have size 0 and are in every pass that takes their
    hash; repeated rows share a hash, and of those at a threshold as many are taken as it asks for; a null source is a source of its own, null ids are
    hashed like any value; an empty table gives no rows.
    """
    narrow = materialize(docs.select("doc_id", word_count(F.col("text")).alias("size"), "source", _hash(seed).alias("h")), "mix-sizes")
    plan, n = source_plan(narrow, weights, cap)
    mixed = _with_passes(narrow, plan, n, F.col("size"), F.xxhash64("doc_id"))
    return mixed.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as ``mix`` takes it, with all its columns.

    Texts are read once for their sizes and once for the result, and never shuffled: whether a row is
    taken shows from its hash and its source's row of the plan.
    """
    kept = F.struct(*docs.columns).alias("row")  # whatever the columns' names, none clashes with the plan's
    rows = materialize(docs.select(word_count(F.col("text")).alias("size"), "source", _hash(seed).alias("h")), "mix-sizes")
    plan, n = source_plan(rows, weights, cap)
    wide = docs.select(kept, "source", _hash(seed).alias("h"), "text")
    mixed = _with_passes(wide, plan, n, word_count(F.col("text")), F.xxhash64(F.to_json("row"))).where("passes > 0")
    again = mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    return again.select("row.*")
