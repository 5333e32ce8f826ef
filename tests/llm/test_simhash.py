import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bondweave.llm import simhash


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    """rows: (id, fp). Class of each row by trying all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [min([d for d in least[find(i)] if d is not None], default=None) for i in range(len(rows))]


TEXTS = [None, "", " \t\n", "one", "one two", "One TWO three", "one two three", "a b c a b c a b c", "É é straße x", "w " * 70000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_whole_query_small(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(30):
        base = [rnd.choice(vocab) for _ in range(120)]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 2])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (None, "  "), (5, rows[5][1]), (950, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted(map(tuple, simhash.near_duplicates(df).select("doc_id", "fp", "component_id").collect()), key=str)
    plain = [(d, plain_fingerprint(t)) for d, t in rows]
    want = sorted([(d, np.uint64(f).astype(np.int64).item(), c) for (d, f), c in zip(plain, plain_classes(plain))], key=str)
    assert got == want


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
@pytest.mark.parametrize("dense", [0, 6, 1024])
def test_links_connect_like_all_pairs(spark, dense, max_bits):
    """With ``dense`` 0 all postings go through hubs, with 1024 none."""
    rnd = random.Random(dense)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(9):
            fps.add(base)
            base ^= sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) & (2**64 - 1)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = [np.uint64(f).astype(np.int64).item() for _, f in rows]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = [tuple(r) for r in simhash.links(df, max_bits, dense).collect()]
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert all(a < b and bits(a, b) <= max_bits for a, b in got) and len(got) == len(set(got))

    def classes(pairs):
        root = {s: s for s in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {s: find(s) for s in signed}

    everything = [(a, b) for a in signed for b in signed if a < b and bits(a, b) <= max_bits]
    assert classes(got) == classes(everything)
    if dense == 1024:
        assert sorted(got) == sorted(everything)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_one_per_class(df).collect() == []


def test_one_row_of_each_class_stays(spark):
    t = " ".join(f"v{i}" for i in range(80))
    rows = [(3, t, "a"), (1, t, "b"), (1, t, "b"), (7, "other words here entirely", None), (None, t, "n"), (9, t, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.keep_one_per_class(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.component_id) for r in kept.collect()) == [("1", "b"), ("7", None), ("None", "n")]


def test_one_row_of_an_id_with_many(spark):
    rows = [(4, f"text number {i % 50} of one id", "_h") for i in range(400)] + [(5, "something else altogether", "x"), (None, "no id", "y"), (None, "no id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h string")
    kept = simhash.keep_one_per_class(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == [4, 5, None, None]
    assert sorted(map(str, kept.collect())) == sorted(map(str, simhash.keep_one_per_class(df.repartition(3)).collect()))


def test_a_star_is_never_one_task(spark):
    """The links of a hub of 100 000 nodes, and the rows of one fingerprint, are spread over the tasks that read them."""
    from bondweave.llm import _common
    from bondweave.llm.components import connected_components

    star = spark.range(1, 100_001).select(F.lit(0).alias("a"), F.col("id").alias("b")).repartition(16)
    got = connected_components(star.unionByName(spark.createDataFrame([(200_001, 200_002)], "a long, b long")))
    assert got.where("root = 0").count() == 100_001 and got.where("root = 200001").count() == 2
    both = star.select(F.col("a").alias("u"), "b")
    least = both.groupBy("u").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = _common.hot_keys(least, "u", "n", 100_000)
    spread = _common.join_spread(both, least.select("u", "m"), "u", hubs)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 20_000
