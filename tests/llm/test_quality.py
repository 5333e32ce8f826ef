import random
import re
from collections import Counter

import numpy as np
import pytest

from bondweave.llm import quality


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a", "a a a", "a a a a", "a b c a b c", "x y\nx y\n x y\n\n\n", "# * é😀 <|>", "   a", "a\x0bb\x0cc\rd", "w " * 60_000, " ".join(map(str, range(30_000)))]


@pytest.mark.parametrize("text", TEXTS)
def test_statistics(text):
    assert quality.statistics(text)[:5] == plain(text)


def test_statistics_random():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bb", " ", " ", "\n", "#", "c"]) for _ in range(rnd.randint(0, 80)))
        assert quality.statistics(text)[:5] == plain(text)


def corpus(rnd, n):
    vocab = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(vocab, k=rnd.randint(60, 200))
        bad = i % 7 == 0
        if bad:
            words = [w + "###" if i % 2 else w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_verdicts_follow_labels(spark):
    docs, labels = corpus(random.Random(1), 900)
    extra = [(5000, None), (5001, "few words"), (None, docs[1][1]), (1, docs[1][1]), (5002, " ".join(["same three words"] * 40)), (5003, docs[1][1] + " x" * 100_000)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "'clash' AS kept", "1 AS score")
    lab = spark.createDataFrame([x for x in labels if x[0] % 3] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    by = {r.doc_id: r for r in got}
    unseen = [(i, q) for i, q in labels if i % 3 == 0]
    assert np.mean([by[i].kept for i, q in unseen if q]) > 0.97
    assert np.mean([not by[i].kept for i, q in unseen if not q]) > 0.9
    assert not by[5000].kept and not by[5001].kept and not by[5002].kept and by[5002].base_failed
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_without_labels_the_base_rules_decide(spark):
    d = spark.createDataFrame([(1, "w" + " v%d" * 60 % tuple(range(60))), (2, "short")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in quality.judge(d, none).collect()} == {1: True, 2: False}
    assert quality.judge(d.limit(0), none).collect() == []


def test_path_lengths():
    """A lone far row has a shorter path than the crowd, in every forest."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    far = np.full((1, 6), 9.0)
    f = quality.grow(x, np.vstack([x, far]))
    assert f.score(far)[0] > f.score(x).max()
