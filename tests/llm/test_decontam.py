import random
import re
from itertools import combinations

import pytest
from bondweave.llm import decontam


def toks(text):
    return [t for t in re.split(r"[\s!-/:-@\[-`{-~]+", (text or "").lower()) if t]


def plain(doc, item):
    """Whether some diagonal holds a window with enough equal places."""
    width = min(decontam.WINDOW, len(item))
    if len(item) < decontam.MIN_TOKENS:
        return False
    for d in range(-len(item) + 1, len(doc)):
        eq = [a == b for a, b in zip(doc[max(d, 0) :], item[max(-d, 0) :])]
        if any(sum(eq[i : i + width]) >= decontam.SHARE * width for i in range(len(eq) - width + 1)):
            return True
    return False


def test_masks_hit_any_three_substitutions():
    for bad in combinations(range(decontam.WINDOW), 3):
        assert any(all(o + i not in bad for i in m) for m in decontam.MASKS for o in range(decontam.WINDOW - m[-1]))


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_against_all_diagonals(spark, monkeypatch, limit):
    """With seeds and items broadcast, and with all of them shuffled."""
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", limit)
    monkeypatch.setattr(decontam, "BROADCAST_ITEMS", limit)
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, words(n)) for i, n in enumerate([40, 30, 25, 17, 16, 12, 9, 7, 3, 60])] + [(20, ["Same"] * 30)]
    docs = []
    for i in range(300):
        body = words(rnd.randint(0, 120))
        if rnd.random() < 0.7:
            part = list(rnd.choice(items)[1])
            if rnd.random() < 0.4 and len(part) > 20:
                k = rnd.randint(0, len(part) - 16)
                part = part[k : k + rnd.randint(12, 30)]
            if len(part) >= 16:
                for _ in range(rnd.randint(0, len(part) // 6)):
                    part[rnd.randrange(len(part))] = rnd.choice(vocab)
            at = rnd.randint(0, len(body))
            body = body[:at] + part + body[at:]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(body)))
    docs += [(1000, None), (1001, ""), (1002, " ".join(words(40_000) + items[0][1])), (None, " ".join(items[1][1])), (5, docs[5][1])]
    bench = [(i, " ".join(w)) for i, w in items] + [(30, None), (31, ""), (0, " ".join(items[0][1]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS item", "1 AS toks")
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "2 AS doc_id")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contaminated(d, b).collect()}
    want = {(i, j) for i, t in docs for j, u in bench if plain(toks(t), toks(u))}
    assert got == want
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns
    bad = {i for i, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i is None or i not in bad)


def test_large_benchmarks_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_ITEMS", 0)
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, "a b " + text), (2, "clean text")], "doc_id long, text string")
    got = decontam.find_contaminated(d, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 7, 30, 30)]


def test_empty_and_native(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some text that is clean and long enough to be tried for seeds")], "doc_id long, text string")
    found = decontam.find_contaminated(one, bench)
    assert found.collect() == [] and decontam.find_contaminated(none, bench).collect() == []
    assert decontam.drop_contaminated(one, bench).count() == 1
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_masks_hit_all_substitutions_of_short_items():
    for width in range(decontam.MIN_TOKENS, decontam.WINDOW):
        for bad in combinations(range(width), width - -int(-width * decontam.SHARE // 1)):
            assert any(all(o + i not in bad for i in m) for m in decontam.ALL_MASKS for o in range(width - m[-1])), (width, bad)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_short_items_with_substitutions(spark, monkeypatch, limit):
    """Every tolerated pattern of substitutions at each width under WINDOW, and one too many."""
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", limit)
    items = {w: [f"i{w}x{k}" for k in range(w)] for w in range(decontam.MIN_TOKENS, decontam.WINDOW)}
    docs, want = [], set()
    for w, item in items.items():
        most = w - -int(-w * decontam.SHARE // 1)
        for n in (most, most + 1):
            for bad in combinations(range(w), n):
                text = ["before", "it", *["other" if k in bad else t for k, t in enumerate(item)], "and", "more", "words", "after", "it"]
                if n == most:
                    want.add((len(docs), w))
                docs.append((len(docs), " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(w, " ".join(t)) for w, t in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_contaminated(d, b).collect()} == want


def test_rows_are_dropped_by_text_not_id(spark):
    leak = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "a b " + leak), (1, "clean text"), (None, leak), (None, "clean text"), (None, None), (2, leak + " c")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontam.drop_contaminated_texts(d, spark.createDataFrame([(7, leak)], "item_id long, text string"))
    assert kept.columns == d.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "clean text"), (None, "clean text"), (None, None)], key=str)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_shortest_items_are_found_unchanged(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", limit)
    monkeypatch.setattr(decontam, "BROADCAST_ITEMS", limit)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 12)}
    docs, want = [], set()
    for n, item in items.items():
        for before, after in (("", ""), ("a b", ""), ("", "c d"), ("a b c d e f g h i", "j k")):
            want.add((len(docs), n))
            docs.append((len(docs), f"{before} {' '.join(item)} {after}".strip()))
        if n < decontam.MIN_TOKENS:
            docs.append((len(docs), "a b " + " ".join([*item[:-1], "other"]) + " c d"))
    d = spark.createDataFrame(docs + [(900, None), (901, "")], "doc_id long, text string")
    b = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    found = lambda **k: {(r.doc_id, r.item_id) for r in decontam.find_contaminated(d, b, **k).collect()}
    assert found(min_tokens=1) == want
    assert found(min_tokens=3) == {(i, n) for i, n in want if n >= 3}
    assert found() == {(i, n) for i, n in want if n >= decontam.MIN_TOKENS}


def test_columns_of_any_name_keep_their_values(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30)), 7 * i, "t", "e") for i in range(6)], "doc_id long, text string, _text long, toks string, item string")
    bench = spark.createDataFrame([(1, " ".join(f"w3x{j}" for j in range(20)))], "item_id long, text string")
    out = decontam.drop_contaminated_texts(docs, bench)
    assert out.columns == docs.columns and sorted((r.doc_id, r._text, r.toks, r.item) for r in out.collect()) == [(i, 7 * i, "t", "e") for i in range(6) if i != 3]


def test_hot_seed_by_shuffle(spark, monkeypatch):
    """One line in every document, with seeds too many to broadcast: the pairs are the same."""
    line = " ".join(f"licence{j}" for j in range(20))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {line} c{i}") for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, line), (2, "x " + line), (3, " ".join(f"q{j}" for j in range(30)))], "item_id long, text string")
    want = sorted(map(str, decontam.find_contaminated(docs, bench).collect()))
    assert len(want) == 600
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert sorted(map(str, decontam.find_contaminated(docs, bench).collect())) == want
