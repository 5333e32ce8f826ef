import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bondweave.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for rank, r in enumerate(secrets.RULES):
        if r.kind != "assign":
            out += [(m.start(), rank, r.kind, m.end()) for m in re.finditer(r.pattern, text) if len(m[0]) >= r.min_chars]
    return sorted(out)


TEXTS = [
    None, "", "no", "TOKEN = 'abcdef'", "token=short", "token=secret:abcdefghi", "token: token: abcdef", "pAssWd\"  :   \"x1/+=_.-", "apikey=abcdefg api_key=abcdefg api__key=abcdefg",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "é😀AKIAAKIA" + "B" * 20, "deadbeef" * 3, "deadbee" * 3 + "xx", "g" + "0123456789abcdef" * 4 + "g" + "f" * 24,
    "secret = " + "f" * 40, "ghp_" + "a1" * 20, "xoxb-1234567890-abc", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "-----BEGIN RSA PRIVATE KEY-----", "a" * 23 + "é" + "a" * 24, "secret=secret=secret=abc",
    "ſecret=abcdefgh toKen=abcdefgh", "x" * 300_000 + " password=hunter22", "\n".join(["token=abcdef12"] * 300),
]


def test_against_plain_scan(spark):
    rnd = random.Random(6)
    bits = ["token", "=", " ", "secret", ":", "'", "abcdef", "AKIA", "B" * 9, "f" * 13, "0" * 12, "é", "api_key", "PASSWORD", "passwd", "\n"]
    texts = TEXTS + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "token=abcdefgh", "c"), (None, None, "c"), (3, TEXTS[3], "c"), (3, "token=other77", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.find_secrets(df).collect()]
    assert sorted(map(str, got)) == sorted(str((i, plain(t))) for i, t, _ in rows)


def test_digest(spark):
    df = spark.createDataFrame([(1, "token=" + "a" * 24), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.secrets_digest(secrets.find_secrets(df)).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 0, 1)
    assert got[1].spans == "assign:0:30,hex:6:30" and got[1].base_sha256 == hashlib.sha256(b"assign:0:30,hex:6:30").hexdigest()
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("abcd", [[{"abc", "bcd"}]]),
        ("ABC|xyz", [[{"abc"}, {"xyz"}]]),
        ("ab[cd]", [[{"abc"}, {"abd"}]]),
        ("abc+d?", []),
        ("abc.*def", [[{"abc"}], [{"def"}]]),
        ("abc?d", [[{"abd"}, {"abc", "bcd"}]]),
        ("[0-9a-f]+", []),
        ("ab|xyz", []),
    ],
)
def test_trigram_queries(pattern, want):
    got = secrets.trigram_query(pattern)
    assert [sorted(map(sorted, g)) for g in got] == [sorted(map(sorted, g)) for g in want]


def test_queries_hold_for_every_match():
    rnd = random.Random(8)
    for rule in secrets.RULES:
        for _ in range(300):
            text = "".join(rnd.choice(["TOKEN", "=", "abcdef", "passwd", "AKIA", "X" * 16, "ghs_", "q" * 36, "xoxa-", "1234567890"]) for _ in range(5))
            if re.search(rule.pattern, text):
                low = text.lower()
                assert all(any(all(t in low for t in alt) for alt in g) for g in secrets.trigram_query(rule.pattern))


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found = secrets.secrets_digest(secrets.find_secrets(df))
    assert found.collect() == []
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("piece", ["secret=", "secret=abcdef ", "deadbeef" * 4 + "\n", "AKIA" + "B" * 20 + " ", "token:"])
def test_dense_texts_take_time_in_proportion(spark, piece):
    """5 MB of matches, beside a plain scan."""
    import time

    n = 5_000_000 // len(piece)
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(piece), (F.col("id") + n).cast("int")).alias("text"))
    began = time.perf_counter()
    (got,) = secrets.secrets_digest(secrets.find_secrets(df)).collect()
    assert time.perf_counter() - began < 40
    want = plain(piece * n)
    assert got.spans == ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in want)


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh")], "doc_id long, text string")
    assert "Exchange" not in secrets.find_secrets(df)._jdf.queryExecution().executedPlan().toString()
