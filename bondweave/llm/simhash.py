"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import hot_keys, join_spread, materialize
from .components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Sets of four byte positions. Any five of the eight positions contain one of these sets (they form the
#: Steiner system of quadruples on eight points: the affine planes of the 3-cube), so two fingerprints that
#: agree in five bytes or more meet in at least one posting.
QUADS = tuple(q for q in ((a, b, c, a ^ b ^ c) for a in range(8) for b in range(a + 1, 8) for c in range(b + 1, 8)) if q[3] > q[2])
#: A posting with more entries is linked through hubs, which takes rows in proportion to its length.
DENSE = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash (unsigned) of a text's word shingles, repeats included; 0 where there are no words.

    A-Z are lower-cased; a text with fewer words than a shingle is one shingle; a bit is 1 if it is set
    in over half of the shingles' XXH64 values.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    h = np.fromiter((digest(whole[s:e], SEED) for s, e in spans), np.uint64, n - shingle + 1)
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # bounds memory for very long texts
        set_in += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return signed(text)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _byte(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 8 * i).bitwiseAND(F.lit(255))


def _posting_key(quad: int, positions: tuple[int, ...]) -> Column:
    """The bytes at four positions, and which positions these are, in one long."""
    packed = [F.shiftleft(_byte("fp", i), 8 * k) for k, i in enumerate(positions)]
    return reduce(lambda x, y: x.bitwiseOR(y), packed, F.lit(quad << 32).cast("long"))


def index_entries(fps: DataFrame) -> DataFrame:
    """Entries (key, fp) of the inverted index over distinct fingerprints: one for each set of positions."""
    keys = F.array(*[_posting_key(k, q) for k, q in enumerate(QUADS)])
    return fps.select(F.explode(keys).alias("key"), "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Distinct links (a, b), a < b, between distinct fingerprints at ``max_bits`` (3 at most) or fewer differing bits.

    Postings up to ``dense`` entries are joined with themselves: each pair's shared positional bytes are
    tallied, and pairs below the guaranteed minimum are dropped (``max_bits`` differing bits touch as many
    bytes at most, so 8 - ``max_bits`` agree). What is left is brought together and verified by its bits.
    Longer postings are linked through hubs instead of pairs, which loses no connection (see ``_hub_links``).
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the index guarantees links of at most 3 differing bits")
    entries = index_entries(fps)
    long = materialize(entries.groupBy("key").count().where(F.col("count") > dense).select("key"), "dense-postings")
    short = entries.join(long, "key", "left_anti")
    left, right = short.withColumnRenamed("fp", "a"), short.withColumnRenamed("fp", "b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((F.when(F.shiftrightunsigned(diff, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))
    met = left.join(right, (left.key == right.key) & (F.col("a") < F.col("b"))).select("a", "b", shared.alias("shared"))
    tallied = met.where(F.col("shared") >= 8 - max_bits).select("a", "b").distinct()
    pairs = tallied.where(F.bit_count(diff) <= max_bits)
    if long.limit(1).count():
        pairs = pairs.unionByName(_hub_links(entries.join(long, "key", "left_semi"), max_bits))
    return pairs.distinct()


def _hub_links(entries: DataFrame, max_bits: int) -> DataFrame:
    """Links that connect the same fingerprints as all near pairs of each posting, in rows linear in its length.

    Two values differ in d = i + j bits exactly if some hub lies i bits from one and j bits from the other.
    Every entry goes to the hubs within 1 bit (near) and 2 bits (far) in the four bytes that the posting
    leaves open. A near entry lies within 3 bits of all others at its hub, so it is the centre of a star there.
    For ``max_bits`` 2, far entries stop at 1 bit, for 1 near entries are the hub itself, for 0 nothing is left.
    """
    near, far = {3: (1, 2), 2: (1, 1), 1: (0, 1), 0: (0, 0)}[max_bits]
    bits = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    one = F.array(F.lit(0).cast("long"))
    quad_bits = F.array(*[F.lit(sum(255 << (8 * i) for i in q) - ((1 << 64) if 7 in q else 0)).cast("long") for q in QUADS])
    e = entries.withColumn("fixed", F.element_at(quad_bits, (F.shiftrightunsigned("key", 32) + 1).cast("int")))
    open_bits = F.filter(bits, lambda m: m.bitwiseAND(F.col("fixed")) == 0)
    e = e.withColumn("open", open_bits)
    two = F.flatten(F.transform("open", lambda x: F.transform(F.filter("open", lambda y: y > x), lambda y: x.bitwiseOR(y))))
    masks = [one, F.col("open"), two][: far + 1]
    e = e.withColumn("mask", F.explode(F.concat(*masks)))
    e = e.select("key", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("hub"), (F.bit_count("mask") <= near).alias("near"))
    centre = e.where("near").groupBy("key", "hub").agg(F.min("fp").alias("centre"))
    star = e.join(centre, ["key", "hub"]).where(F.col("fp") != F.col("centre"))
    star = star.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= max_bits)
    return star.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Fingerprint and class of every document, as (id, fp, component_id).

    A class holds all documents that reach one another over links of ``max_bits`` or fewer differing bits;
    its id is the smallest id in it. Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows come back as often as they go in; a null id is never a class id unless its class has no
    other; an empty table gives no rows. Columns other than the two named are not read.

    Equal fingerprints are one node, so exact copies cost no links. The index, the links and the
    components work on distinct fingerprints, 8 bytes each; texts are read once and not shuffled.
    """
    doc_fp = materialize(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")), "fingerprints")
    fps = doc_fp.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    comp = connected_components(links(fps.select("fp"), max_bits))
    linked = fps.join(comp, fps.fp == comp.node).groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = materialize(linked, "class-ids")
    large = materialize(hot_keys(linked, "root", "n", comp.count()), "large-classes")
    of_linked = join_spread(comp, linked.drop("n"), "root", large).select(F.col("node").alias("fp"), "component_id")
    # Only fingerprints of several rows or with links need a class from elsewhere.
    shared = fps.where("rows > 1").join(of_linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    classes = materialize(of_linked.unionByName(shared), "classes")
    hot = materialize(hot_keys(fps, "fp", "rows", doc_fp.count()), "hot-fingerprints")
    return join_spread(doc_fp, classes, "fp", hot, "left").select(F.col("id").alias(id_col), "fp", F.coalesce("component_id", "id").alias("component_id"))


def keep_one_per_class(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Documents with one row of each near-duplicate class: that of the smallest id; all columns stay.

    Of rows that share an id one stays, the first by the hash of its columns. Rows without an id cannot
    be told apart, so all of them stay.
    """
    found = materialize(near_duplicates(docs, shingle=shingle, max_bits=max_bits).where("doc_id IS NOT NULL"), "found")
    least = found.where("doc_id = component_id").select("doc_id")
    losers = found.where("doc_id <> component_id").select("doc_id").distinct().join(least, "doc_id", "left_anti")
    kept = docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
    repeated = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.limit(1).count():
        # Aggregates rather than a ranking, so that an id of very many rows never meets in one task.
        of_repeated, h = kept.join(repeated, "doc_id", "left_semi"), F.xxhash64(*docs.columns)
        first = of_repeated.select(F.col("doc_id").alias("_of"), h.alias("_h")).groupBy("_of").agg(F.min("_h").alias("_h"))
        one = of_repeated.select(F.struct(*docs.columns).alias("_row"), "doc_id", h.alias("_mine")).join(first, (F.col("doc_id") == F.col("_of")) & (F.col("_mine") == F.col("_h")))
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(one.select("_row.*").distinct())
    return kept
