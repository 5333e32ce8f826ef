"""Near copies by Jaccard similarity of five-word shingles: SimHash fingerprints and MinHash bands find candidates, exact sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import BROADCAST_KEYS, broadcast_if_small, fresh, hot_keys, join_salted, join_spread, materialize, salts_of
from .components import connected_components

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
#: Texts meet if all minima of one band are equal: at similarity 0.8 with probability 1 - (1 - 0.8^5)^24 = 0.99993.
BANDS, ROWS = 24, 5

#: Buckets of the sketches that rule pairs out before their sets are brought together.
PARITY_BITS = 1024
#: Hashes that a task holds before it hands rows on.
HELD = 1 << 18

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 values of a text's five-word shingles; A-Z are lower-cased.

    A text with fewer words is one shingle, and so are null texts and those without a word, which are all alike.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n)
    return np.unique(h)


def band_keys(text: str | None) -> np.ndarray:
    """One hash for each band of MinHash values, with the band's number in it."""
    h = shingles(text)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):  # bounds memory for very long texts
        least = np.minimum(least, ((h[k : k + 4096, None] ^ _XOR) * _ODD).min(axis=0))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64)


def _hashes(texts: DataFrame, of_text: Callable[[str | None], np.ndarray], name: str, sketch: bool = False) -> DataFrame:
    """(node, name) with the hashes of each text of (node, text), and its ``sketch`` if wanted. Rows leave a task as soon as they have HELD hashes together,
    so its memory is bounded by that and one text."""

    def frame(nodes: list[int], found: list[np.ndarray]) -> pd.DataFrame:
        out = pd.DataFrame({"node": nodes, name: [h.view(np.int64) for h in found]})
        return out.assign(sketch=[parities(h) for h in found]) if sketch else out

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes: list[int] = []
        found: list[np.ndarray] = []
        size = 0
        for pdf in batches:
            for node, text in zip(pdf["node"], pdf["text"]):
                nodes.append(node)
                found.append(of_text(text))
                size += len(found[-1])
                if size >= HELD:
                    yield frame(nodes, found)
                    nodes, found, size = [], [], 0
        if nodes:
            yield frame(nodes, found)

    return texts.select("node", "text").mapInPandas(rows, f"node long, {name} array<long>" + ", sketch array<long>" * sketch)


def parities(h: np.ndarray) -> np.ndarray:
    """A set's sketch: for each of PARITY_BITS buckets of hashes whether it holds an odd number."""
    odd = np.bincount((h & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _may_be_similar(x: str, y: str, n: str, m: str) -> Column:
    """False only for sets that cannot be similar enough: their sketches differ in no more bits than the sets in elements,
    and sets of SIMILARITY differ in (1 - s) / (1 + s) of their elements at most."""
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(PARITY_BITS // 64)])
    return differ <= (F.col(n) + F.col(m)) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar enough. The pairs of a hot node are cut into parts, each with a copy of its set."""
    pairs = materialize(pairs, "pairs")
    total = pairs.count()
    salts = {c: materialize(salts_of(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, "n", total), "hot-nodes") for c in "ab"}
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    # Of sets whose sizes differ too much neither intersection is computed.
    sizes = F.least(F.size("x"), F.size("y")) >= SIMILARITY * F.greatest(F.size("x"), F.size("y"))
    joined = join_salted(join_salted(pairs, left, "a", salts["a"], ["b"]), right, "b", salts["b"], ["a"])
    return joined.where(sizes).where(both >= SIMILARITY * (F.size("x") + F.size("y") - both)).select("a", "b")


def fingerprint_pairs(by_text: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes of (node, text) that op6's SimHash index links: texts of one fingerprint with the least of them, and the
    least texts of fingerprints at three or fewer differing bits."""
    fps = materialize(by_text.select("node", simhash.fingerprint_column(F.col("text")).alias("fp")).distinct(), "fingerprints")
    least = materialize(fps.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-least")
    hot = materialize(hot_keys(least, "fp", "n", fps.count()), "hot-fingerprints")
    same = join_spread(fps, least.where("n > 1").select("fp", "least"), "fp", hot).select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.links(least.select("fp"))
    x, y = (least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in "ab")
    near = near.join(x, "a").join(y, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return materialize(same.unionByName(near).where("a <> b").distinct(), "fingerprint-pairs")


def links(docs: DataFrame, node: Column, text_col: str = "text") -> DataFrame:
    """Links (a, b) between nodes (texts, by hash) that connect all candidates of SIMILARITY or more.

    Candidates come from SimHash fingerprints, by op6's index, and from the bands of MinHash, which also find what differs in more bits.
    First the pairs by fingerprint are compared, and every node of a bucket with the bucket's least, in rows linear in its length. Nodes
    that these links connect need no further comparison. Of the others in a bucket a pair's sets are brought
    together only if their sketches allow SIMILARITY. So no pair's evidence is lost, and neither a bucket of many
    copies of one text costs much, nor one of many texts that are somewhat alike.
    """
    by_text = docs.select(node.alias("node"), F.col(text_col).alias("text"))
    keyed = _hashes(by_text, band_keys, "keys")
    entries = materialize(keyed.select("node", F.explode("keys").alias("key")).distinct(), "bands")
    least = entries.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most"), F.count(F.lit(1)).alias("n")).where("a < most")
    least = materialize(least, "least")
    hot = materialize(hot_keys(least, "key", "n", entries.count()), "hot-buckets")
    entries = materialize(join_spread(entries, least.select("key", "a"), "key", hot), "buckets")
    alike = fingerprint_pairs(by_text)
    nodes = materialize(entries.select("node").unionByName(alike.select(F.explode(F.array("a", "b")).alias("node"))).distinct(), "candidates")
    sets = by_text.join(broadcast_if_small(nodes, nodes.count(), BROADCAST_KEYS), "node", "left_semi")
    sets = materialize(_hashes(sets, shingles, "set", sketch=True).groupBy("node").agg(F.first("set").alias("set"), F.first("sketch").alias("sketch")), "shingles")

    stars = entries.where("node <> a").select("a", F.col("node").alias("b")).unionByName(alike).distinct()
    near = materialize(_similar(stars, sets), "stars")
    of = connected_components(near)
    placed = entries.select("key", "node").join(of, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    placed = materialize(placed.join(mixed, "key", "left_semi"), "mixed")
    placed = placed.join(sets.select("node", "sketch", F.size("set").alias("n")), "node")
    # The pairs of a hot bucket are cut into a grid of parts, by its nodes' hashes on both sides.
    counts = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    grid = materialize(salts_of(counts, "key", "n", placed.count()).select(F.col("key").alias("_hot"), F.ceil(F.sqrt("salts")).cast("int").alias("g")), "grids")
    placed = placed.join(F.broadcast(grid), F.col("key") == F.col("_hot"), "left").withColumn("g", F.coalesce("g", F.lit(1))).drop("_hot")
    cell, cells = F.pmod(F.xxhash64("node"), F.col("g")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    left = placed.select("key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("sketch").alias("x"), F.col("n").alias("na"), cell.alias("i"), cells.alias("j"))
    right = placed.select(F.col("key").alias("_key"), F.col("node").alias("b"), F.col("root").alias("rb"), F.col("sketch").alias("y"), F.col("n").alias("nb"), cell.alias("_j"), cells.alias("_i"))
    apart = (F.col("key") == F.col("_key")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))
    rest = left.join(right, apart & _may_be_similar("x", "y", "na", "nb")).select("a", "b").distinct()
    return near.unionByName(_similar(rest.join(stars, ["a", "b"], "left_anti"), sets))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with one row of each class of near copies; all columns stay.

    A class holds all texts that reach one another over pairs of SIMILARITY or more. Its row of the least
    id stays (a null id only if there is no other), ties by hashes of text and row. Rows are told apart by
    text and by all columns, not by id, so an id may be repeated or null. Rows of one class are told by
    hashes of 64 bits; rows equal in all columns are one. Null texts and those without a word are alike.
    An empty table stays empty; columns may have any names. Texts are shuffled only
    where the rows that go are too many to broadcast.
    """
    node, h = F.xxhash64(text_col), F.xxhash64(*docs.columns)
    names = fresh(docs.columns, "_node", "_h")
    of = connected_components(links(docs, node, text_col))
    keys = docs.select(node.alias("node"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), node.alias("node"), h.alias("h")).alias("row"))
    first = keys.groupBy("node").agg(F.min("row").alias("row")).join(of, "node", "left")
    first = first.groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("row").alias("row"))
    first = materialize(first.select(F.col("row.node").alias(names[0]), F.col("row.h").alias(names[1])), "first-rows")
    rows = docs.select(node.alias(names[0]), h.alias(names[1])).groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
    losers = materialize(rows.join(first, names, "left_anti").select(*names), "other-rows")
    kept = docs.withColumns(dict(zip(names, (node, h)))).join(broadcast_if_small(losers, losers.count(), BROADCAST_KEYS), names, "left_anti")
    repeated = materialize(rows.where("times > 1").join(first, names, "left_semi").select(*names), "repeated-rows")
    n = repeated.count()
    if n:
        repeated = broadcast_if_small(repeated, n, BROADCAST_KEYS)
        once = kept.join(repeated, names, "left_semi").dropDuplicates(names)
        kept = kept.join(repeated, names, "left_anti").unionByName(once)
    return kept.select(*docs.columns)
