import random
from itertools import combinations

import numpy as np
import xxhash

from bondweave.llm import near_copies


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(x, y):
    return len(x & y) >= near_copies.SIMILARITY * len(x | y)


def plain_classes(texts):
    """Classes of distinct texts over all pairs."""
    of, root = {t: sets(t) for t in texts}, {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in combinations(of, 2):
        if similar(of[a], of[b]):
            root[find(a)] = find(b)
    return {t: find(t) for t in of}


def test_copies_with_changed_words_go(spark):
    """Pairs near the limit, which three bits of a fingerprint miss, chains, and a large class beside others."""
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    rows, hub = [], rnd.choices(vocab, k=150)
    for i in range(240):
        words = list(hub) if i % 3 == 0 else rnd.choices(vocab, k=rnd.randint(3, 150)) if i % 3 == 1 or not rows else rnd.choice(rows)[1].split()
        for _ in range(rnd.randint(0, 3) if i % 3 != 1 else 0):
            if words:
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " "), (903, "a b"), (904, "A  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns
    of = plain_classes([t for _, t in rows])
    want = {}
    for i, t in rows:
        want.setdefault(of[t], i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want.values())
    assert len(want) < 200


def test_rows_are_told_apart_by_text_not_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, a), (3, b), (8, a), (8, a), (None, b), (None, "of its own"), (4, "x y z"), (4, "p q r"), (4, "p q r")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, a), (3, b), (None, "of its own"), (4, "x y z"), (4, "p q r")], key=str)


def test_empty_table(spark):
    assert near_copies.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_rule_out_no_similar_pair():
    """Sketches differ in no more bits than their sets in elements."""
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 5, 50, 400, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for changed in (0, 1, n // 10, n // 2):
            y = np.unique(np.concatenate((x[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64))))
            differ = int(np.unpackbits((near_copies.parities(x) ^ near_copies.parities(y)).view(np.uint8)).sum())
            assert differ <= len(np.setxor1d(x, y))


def test_columns_of_any_name_keep_their_values(spark):
    from pyspark.sql import functions as F

    names = ["_node", "_h", "node", "h", "root", "row", "times", "_node_"]
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("w x y z "), (F.col("id") % 30).cast("string")).alias("text"), *[(F.col("id") * 100 + i).alias(n) for i, n in enumerate(names)])
    out = near_copies.keep_one(df)
    assert out.columns == df.columns and out.count() == 30
    assert all(r[n] == r.doc_id * 100 + i for r in out.collect() for i, n in enumerate(names))


def test_hot_centres_and_buckets_are_cut_into_parts(spark, monkeypatch):
    """With every node and bucket of a few rows hot, the classes are the same."""
    from bondweave.llm import _common

    rnd = random.Random(9)
    hub = [f"h{i}" for i in range(60)]
    rows = [(i, " ".join(hub[:k] + [f"c{i}"] + hub[k + 1 :])) for i in range(60) for k in [rnd.randrange(60)]]
    rows += [(100 + i, " ".join(f"w{rnd.randrange(400)}" for _ in range(40))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, near_copies.keep_one(df).collect()))
    assert len(want) < 40
    monkeypatch.setattr(_common, "HOT", 10**6)
    assert sorted(map(str, near_copies.keep_one(df).collect())) == want


def test_simhash_finds_candidates_without_bands(spark, monkeypatch):
    """Texts that share no band's bucket still meet by their fingerprints."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), "something else that nobody wrote before"]
    monkeypatch.setattr(near_copies, "band_keys", lambda text: np.array([xxhash.xxh64_intdigest((text or "").encode(), 1)], np.uint64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [0, 2]
