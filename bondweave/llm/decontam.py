"""Benchmark decontamination by spaced-seed hashing.

Everything here is DataFrame and SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_KEYS, broadcast_if_small, fresh, join_salted, materialize, salts_of

#: Token positions that each seed looks at; the others are ignored. Together the two hit every run of
#: WINDOW aligned tokens in which at most three are substituted, wherever these are.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 3, 5, 7))
#: A shorter item must be hit within its own width. With this one, the masks hit every item of MIN_TOKENS or
#: more under all substitutions that SHARE leaves; it is sought for items shorter than WINDOW only.
SHORT_MASK = (0, 1, 2, 5, 6)
ALL_MASKS = (*MASKS, SHORT_MASK)
#: An overlap counts if, of so many aligned tokens (all of a shorter item), this share is equal.
WINDOW = 16
SHARE = 0.8
#: Items with fewer tokens name nothing in particular and are not sought, unless ``min_tokens`` says so; then
#: they are found where all their tokens occur unchanged.
MIN_TOKENS = 8
#: Seeds that are broadcast at most, some 40 bytes each; beyond, the join shuffles.
BROADCAST_SEEDS = 1_000_000
BROADCAST_ITEMS = 20_000
#: Parts into which the hits of an item are cut where items are joined by a shuffle.
SALTS = 16
#: One document in so many shows which seeds are hot, where seeds are too many to broadcast.
HOT_SAMPLE = 16


def tokens(text: Column) -> Column:
    """Lower-cased runs between white space and ASCII punctuation; the first and last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+", -1)


def _seed(toks: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(toks, at + o) for o in mask])


def _positions(toks: Column) -> Column:
    """Where the shortest seed has room; a longer one reads nulls beyond the end, on both sides alike."""
    last = F.size(toks) - (min(m[-1] for m in ALL_MASKS) + 1)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _places(toks: Column, exact: tuple[int, ...]) -> Column:
    """Positions of a document to probe: all of them where short items are sought, which may stand at its end."""
    if not exact:
        return _positions(toks)
    return F.sequence(F.lit(0), F.size(toks) - 1)  # there is one token at least


def _exact(toks: Column, at: Column, n: int) -> Column:
    """Hash of n tokens in a row, for items too short for masks."""
    return F.xxhash64(F.lit(1000 + n), *[F.get(toks, at + o) for o in range(n)])


def item_seeds(items: DataFrame) -> DataFrame:
    """(h, before, item, at, len) for all positions of the items' tokens and all masks that their length asks for.

    ``before`` is the same mask's hash one token earlier, by which a hit that only continues a run is known.
    """
    at, toks = F.col("at"), F.col("toks")
    each = [F.struct(_seed(toks, at, k, m).alias("h"), F.when(at > 0, _seed(toks, at - 1, k, m)).alias("before")) for k, m in enumerate(ALL_MASKS)]
    rows = items.select("item", "toks", F.explode(_positions(toks)).alias("at"))
    rows = rows.select("item", "at", F.size("toks").alias("len"), F.explode(F.when(F.size("toks") < WINDOW, F.array(*each)).otherwise(F.array(*each[: len(MASKS)]))).alias("s"))
    rows = rows.select("s.h", "s.before", "item", "at", "len").where(F.col("len") >= MIN_TOKENS)
    n = F.size("toks")
    whole = F.coalesce(*[F.when(n == k, _exact(toks, F.lit(0), k)) for k in range(1, MIN_TOKENS)])
    short = items.where(n < MIN_TOKENS).select(whole.alias("h"), F.lit(None).cast("long").alias("before"), "item", F.lit(0).alias("at"), n.alias("len"))
    return rows.unionByName(short)


def _hits_in_scan(rows: DataFrame, seeds: DataFrame, masks: tuple[tuple[int, ...], ...], exact: tuple[int, ...]) -> DataFrame:
    """First hits of runs (id, toks, p, item, at, len): all positions are probed where the text is read."""
    toks, p = F.col("toks"), F.col("p")
    each = [_seed(toks, p, k, m) for k, m in enumerate(masks)] + [_exact(toks, p, n) for n in exact]
    rows = rows.select("id", "toks", F.explode(_places(toks, exact)).alias("p"))
    rows = rows.select("id", "toks", "p", F.posexplode(F.array(*each)).alias("k", "h"))
    earlier = F.coalesce(*[F.when(F.col("k") == k, _seed(toks, p - 1, k, m)) for k, m in enumerate(masks)])
    return rows.join(seeds, "h").where((p == 0) | F.col("before").isNull() | (F.col("before") != earlier))


def _hits_by_shuffle(rows: DataFrame, seeds: DataFrame, masks: tuple[tuple[int, ...], ...], exact: tuple[int, ...]) -> DataFrame:
    """The same for seeds too many to broadcast: only hashes and places are shuffled to them.

    Hits then return to their texts by id and a hash of the tokens, so repeated rows do not multiply.
    """
    toks, p = F.col("toks"), F.col("p")
    rows = rows.withColumn("doc", F.xxhash64("toks"))
    each = [F.struct(_seed(toks, p, k, m).alias("h"), F.when(p > 0, _seed(toks, p - 1, k, m)).alias("earlier")) for k, m in enumerate(masks)]
    each += [F.struct(_exact(toks, p, n).alias("h"), F.lit(None).cast("long").alias("earlier")) for n in exact]
    places = rows.select("id", "doc", "toks", F.explode(_places(toks, exact)).alias("p")).select("id", "doc", "p", F.explode(F.array(*each)).alias("s"))
    places = places.select("id", "doc", "p", "s.*")
    # Which hashes are hot shows in a sample of the documents; it decides how the join is dealt, never what it finds.
    some = materialize(places.where(F.pmod(F.xxhash64("doc", "id"), F.lit(HOT_SAMPLE)) == 0).groupBy("h").agg(F.count(F.lit(1)).alias("n")), "hot-seeds")
    seen = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = join_salted(places, seeds, "h", materialize(salts_of(some, "h", "n", seen), "hot-seeds"), ["id", "doc", "p"])
    hits = hits.where((p == 0) | F.col("before").isNull() | (F.col("before") != F.col("earlier")))
    hits = materialize(hits.select(F.col("id").alias("_id"), F.col("doc").alias("_doc"), "p", "item", "at", "len").distinct(), "seed-hits")
    few = broadcast_if_small(hits, hits.count(), BROADCAST_SEEDS)
    return rows.join(few, F.col("id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc")))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, item, matched, overlap): each document that overlaps a benchmark item, with the best overlap.

    ``overlap`` is the number of aligned tokens that document and item share a place for, ``matched``
    how many of them are equal. A pair is reported if some WINDOW consecutive aligned tokens (all, if the
    item is shorter) are equal in SHARE of the places or more, so substituted tokens are tolerated.

    Each document's positions are hashed under fixed masks in the scan, probed against the items' seeds,
    and only the first hit of each run leaves with the few tokens beside it. Texts are not shuffled unless
    the seeds and their hits are both too many to broadcast, and then once.
    Verification joins these with the items' tokens. Items of ``min_tokens`` up to MIN_TOKENS tokens are
    found where they stand unchanged; shorter ones are not sought. Null and empty texts and empty tables
    give no pairs; repeated rows and items with one id count once; null ids are reported like any; texts
    may be of any length, as only places and hashes are multiplied; no columns but the four named are read.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.filter(tokens(F.col(item_text_col)), lambda t: t != "").alias("toks")).where(F.size("toks") >= max(1, min_tokens)).distinct()
    items = materialize(items, "items")
    seeds = materialize(item_seeds(items).distinct(), "seeds")
    n_seeds, n_items = seeds.count(), items.count()
    lengths = [r[0] for r in items.select(F.size("toks").alias("n")).where(F.col("n") < WINDOW).distinct().collect()]  # fewer than WINDOW
    masks = ALL_MASKS if any(n >= MIN_TOKENS for n in lengths) else MASKS
    exact = tuple(sorted(n for n in lengths if n < MIN_TOKENS))

    toks, p = F.col("toks"), F.col("p")
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("toks"))
    hits = _hits_in_scan(rows, F.broadcast(seeds), masks, exact) if n_seeds <= BROADCAST_SEEDS else _hits_by_shuffle(rows, seeds, masks, exact)
    low = F.greatest(p - F.col("at"), F.lit(0))
    offset = low - (p - F.col("at"))
    length = F.least(F.size("toks") - low, F.col("len") - offset)
    cut = hits.select("id", "item", offset.alias("offset"), F.slice("toks", low + 1, length).alias("part"))

    known = items.select(F.col("item").alias("_item"), F.col("toks").alias("whole"))
    same = F.col("item").eqNullSafe(F.col("_item"))
    if n_items > BROADCAST_ITEMS:  # the hits of a popular item are cut into parts, each with a copy of the item
        known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        cut = cut.withColumn("salt", F.pmod(F.xxhash64("id", "offset", "part"), F.lit(SALTS)))
        same &= F.col("salt") == F.col("_salt")
    pairs = cut.join(broadcast_if_small(known, n_items, BROADCAST_ITEMS), same)
    pairs = pairs.withColumn("eq", F.zip_with("part", F.slice("whole", F.col("offset") + 1, F.size("part")), lambda a, b: (a == b).cast("int")))
    width = F.least(F.lit(WINDOW), F.size("whole"))

    def equal_from(i: Column) -> Column:
        return F.aggregate(F.slice("eq", i, width), F.lit(0), lambda acc, x: acc + x)

    starts = F.when(F.size("eq") >= width, F.sequence(F.lit(1), F.size("eq") - width + 1))
    good = F.exists(starts, lambda i: equal_from(i) >= F.ceil(width * SHARE))
    best = pairs.where(good).select("id", "item", F.struct(F.aggregate("eq", F.lit(0), lambda a, x: a + x).alias("matched"), F.size("eq").alias("overlap")).alias("b"))
    return best.groupBy("id", "item").agg(F.max("b").alias("b")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.matched", "b.overlap")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that overlap no benchmark item; all columns stay. Rows without an id can't be named, so they stay."""
    bad = materialize(find_contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(broadcast_if_small(bad, bad.count(), BROADCAST_KEYS), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents whose text overlaps no benchmark item; all columns stay.

    Whether a row goes depends on its text alone, so rows are named by a hash of it: an id may be null,
    and rows that share one are judged each by its own text.
    """
    (name,) = fresh(docs.columns, "_text")
    named = docs.withColumn(name, F.xxhash64("text"))
    bad = materialize(find_contaminated(named, benchmark, id_col=name).select(name).distinct(), "contaminated")
    return named.join(broadcast_if_small(bad, bad.count(), BROADCAST_KEYS), name, "left_anti").select(*docs.columns)
