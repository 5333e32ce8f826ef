import random

from bondweave.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * w[s] for s in sizes}
        capped |= over


def test_targets(spark):
    rnd = random.Random(3)
    for n in (1, 2, 5, 40):
        sizes = {f"s{i}é" if i else None: rnd.choice([0, 1, 10, 1000, 10**6]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mix_meets_targets(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)]
    rows += [(None, "one two", "a"), (5000, None, "a"), (5001, "", "zero"), (7, "x y", "b"), (7, "x y", "b"), (6000, "w " * 50000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS target", "2 AS h")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        s[0] += r.taken
        s[3] += r["size"]
        assert r.taken in [k * r["size"] for k in range(4)]
    want = plain_targets({s: v[2] for s, v in by.items()})
    for s, (taken, target, size, summed) in by.items():
        assert size == summed and abs(target - want[s]) < 1e-3
        largest = 50000 if s == "long" else 60
        assert abs(taken - target) <= (31 if s != "long" else largest), s


def test_documents_as_often_as_taken(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 4}", "keep") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, passes string")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for r in mixing.mix(df).collect():
        assert times.get(r.doc_id, 0) * r["size"] == r.taken


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).collect() == [] and mixing.mix_documents(df).collect() == []


def half_of_largest(got):
    """Each source's taken words beside its target: off by half of its largest document at most."""
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, r.target, 0])
        s[0] += r.taken
        s[2] = max(s[2], r["size"])
        assert r.taken in [k * r["size"] for k in range(4)]
    for source, (taken, target, largest) in by.items():
        assert abs(taken - target) <= largest / 2 + 0.5, (source, taken, target, largest)
    return by


def test_few_and_repeated_documents_meet_targets(spark):
    """Sources of one, two and fifty equal documents beside a large one."""
    for sizes in ({"a": [1000] * 50, "b": [2500, 2500], "c": [700]}, {"a": [900], "b": [40] * 30}, {"a": [5] * 3 + [60] * 2, "b": [1], "c": [0, 0]}):
        for equal in (True, False):
            rows = [(1 if equal else 100 * k + i, "w " * n, s) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
            df = spark.createDataFrame(rows, "doc_id long, text string, source string")
            got = mixing.mix(df).collect()
            assert len(got) == len(rows)
            half_of_largest(got)
            assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))


def test_documents_of_repeated_rows(spark):
    """Rows equal in id and text but not in other columns: as many come out as the digest takes, in every run."""
    rows = [(1, "w " * 100, "a", i % 3) for i in range(50)] + [(i, "v " * 10, "b", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    taken = sum(r.taken for r in mixing.mix(df).collect() if r.source == "a")
    one, two = mixing.mix_documents(df), mixing.mix_documents(df.repartition(4))
    assert one.columns == df.columns and one.where("source = 'a'").count() * 100 == taken
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
