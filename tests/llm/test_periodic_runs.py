import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bondweave.llm import periodic_runs, queries
from bondweave.llm.periodic_runs import find_runs, next_smaller, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_exponent=4, min_length=6):
    """Every period, every maximal stretch, none of a smaller period."""
    w = np.asarray(words)
    n, out = len(w), []
    for q in range(1, n // min_exponent + 1):
        equal = np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]])
        edges = np.flatnonzero(np.diff(equal))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = end - start + q
            x = w[start : start + length]
            if length >= max(min_length, min_exponent * q) and not any((x[:-d] == x[d:]).all() for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


sequences = st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=5), st.integers(1, 7)), max_size=8).map(lambda xs: [w for part, times in xs for w in part * times])


@settings(max_examples=400, deadline=None)
@given(sequences, st.integers(2, 5), st.integers(0, 8))
def test_equals_all_periods(words, min_exponent, min_length):
    assert find_runs(words, min_exponent, min_length) == plain_runs(words, min_exponent, min_length)


@settings(max_examples=100, deadline=None)
@given(sequences)
def test_next_smaller_suffix(words):
    want = [next((j for j in range(i + 1, len(words)) if words[j:] < words[i:]), len(words)) for i in range(len(words))]
    assert next_smaller(words, periodic_runs.CommonParts(words)) == want


def test_long_repetitive_texts_in_near_linear_time():
    rnd = random.Random(3)
    unit = [rnd.randrange(40) for _ in range(900)]
    words = [0] * 40_000 + [1] + unit * 40 + [2, 3] * 9_000
    assert (0, 40_000, 1) in find_runs(words)
    assert {q for _, _, q in find_runs(words)} >= {1, 2, 900}
    thue = [bin(i).count("1") % 2 for i in range(50_000)]  # its hashes collide more often than those of other texts; it has no cubes
    assert find_runs(thue) == []
    assert find_runs(thue, 2) == plain_runs_of_small_periods(thue, 200)


def plain_runs_of_small_periods(words, most):
    w, out = np.asarray(words), []
    for q in range(1, most):
        equal = np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]])
        edges = np.flatnonzero(np.diff(equal))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = end - start + q
            x = w[start : start + length]
            if length >= max(6, 2 * q) and not any((x[:-d] == x[d:]).all() for d in range(1, q)):
                out.append((start, length, q))
    big = [r for r in find_runs(words, 2) if r[2] >= most]
    assert all((w[s : s + n - q] == w[s + q : s + n]).all() for s, n, q in big)
    return sorted(out + big, key=lambda r: (r[0], r[2]))


def test_collapsing_overlapping_runs():
    words = [b"a", b"a", b"a", b"a", b"a", b"a", b"b"]
    assert without_repeats(words, [(0, 6, 1)]) == [b"a", b"b"]
    assert without_repeats(words, [(0, 6, 1), (2, 5, 2)]) == [b"a"]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None:
        words = planted(doc_id, words)
    number = {}
    runs = plain_runs([number.setdefault(w, len(number)) for w in words]) if words else []
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), len(words))


def test_query_equals_all_periods_on_the_whole_table(spark):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    got = sorted(str(tuple(r)) for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(str(expected(d["doc_id"], d["text"])) for d in docs)


def test_edge_cases(spark):
    tens = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \n\t ", "a", "a a a a a a", "a a " * 6, "x y " * 4 + "x", "é " * 7 + "é\x0b\x0cé", "\x1c a" * 8, " ".join(str(i % 7) for i in range(30_000))]
    rows = [(tens[k], t) for k, t in enumerate(texts)] + [(1, t) for t in texts] + [(None, "b " * 8), (None, None), (-tens[0], "c " * 9), (1, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "'x' AS id", "2 AS collapsed", "3 AS n_words")
    df = periodic_runs.with_planted_runs(df)
    assert {"runs", "id", "collapsed"} <= set(df.columns)
    got = periodic_runs.runs_digest(periodic_runs.runs_of_texts(df)).collect()
    want = [expected(i, t) for i, t in rows if not (t and len(t) > 20_000)]
    assert sorted(str(tuple(r)) for r in got if r["n_words"] < 20_000) == sorted(map(str, want))
    assert {r["length"] for r in got if r["n_words"] > 20_000} >= {30_000}


def test_empty_table_and_other_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert periodic_runs.runs_digest(periodic_runs.runs_of_texts(none)).collect() == []
    one = periodic_runs.runs_of_texts(spark.createDataFrame([("k", "a b a b a b a b z")], "key string, body string"), id_col="key", text_col="body").first()
    assert (one["key"], [tuple(r) for r in one["runs"]], one["collapsed"]) == ("k", [(0, 8, 2)], "a b z")


@pytest.mark.parametrize("words", [[], [0], [0] * 5, [0] * 6, [0, 1] * 3, [0, 1] * 4])
def test_least_lengths(words):
    assert find_runs(words) == plain_runs(words)
