"""Each stage on its own input, against a plain version, at a size where trying all pairs is possible."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from bondweave.llm import decontam, quality, simhash

WORDS = ["".join(random.Random(i).choices("abcdefghij", k=2 + i % 7)) for i in range(900)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    text = lambda n: " ".join(rnd.choices(WORDS, k=n))
    items = [(i, text(30)) for i in range(6)]
    docs, labels = [], []
    for i in range(260):
        body = text(rnd.randint(60, 160))
        if i % 11 == 0:
            body = " ".join(w + "###" for w in body.split())
        elif i % 13 == 0:
            body = body + " " + items[i % 6][1]
        elif i % 17 == 0:
            body = docs[i // 2][1]
        elif i % 19 == 0:
            words = docs[i - 3][1].split()
            words[5] = "changed"
            body = " ".join(words)
        docs.append((i, body, "en", f"s{i % 3}" if i % 3 else None, len(body)))
        labels.append((i, 0 if i % 11 == 0 else 1, 0))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, "too short", "en", "s1", 9)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_one_by_one(spark, corpus):
    from test_decontam import plain as overlaps
    from test_decontam import toks
    from test_near_copies import plain_classes

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = docs.columns
    items = [toks(r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        after = stage(spark, docs, corpus)
        rows = after.toPandas()
        ids = Counter(rows.doc_id)
        if name == "quality_rules":
            known = before.assign(bad=[i % 11 == 0 or i >= 1000 for i in before.doc_id])
            assert not set(known[known.doc_id >= 1000].doc_id) & set(ids)
            assert np.mean([i in ids for i in known[~known.bad].doc_id]) > 0.97 and np.mean([i in ids for i in known[known.bad].doc_id]) < 0.2
            stats_ok = [quality.statistics(t)[0] >= quality.MIN_WORDS for t in rows.text]
            assert all(stats_ok)
        elif name == "near_dedup":
            of, first = plain_classes(list(before.text)), {}
            for d, t in sorted(zip(before.doc_id, before.text)):
                first.setdefault(of[t], d)
            assert set(ids) == set(first.values()) and max(ids.values()) == 1 and len(ids) < len(before)
        elif name == "decontamination":
            assert set(ids) == {d for d, t in zip(before.doc_id, before.text) if not any(overlaps(toks(t), w) for w in items)}
        elif name == "mixing":
            assert set(ids) <= set(before.doc_id) and max(ids.values()) <= 3
            words = sum(len(t.split()) for t in rows.text)
            assert abs(words - sum(len(t.split()) for t in before.text)) < 3 * 160
        else:
            assert ids == Counter(before.doc_id)
            sizes = Counter(rows.shard)
            assert max(sizes.values()) - min(sizes.values()) <= 1
            assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
        assert after.columns == (names if name != "sharding" else [*names, "shard", "slot"])
        docs = spark.createDataFrame(after.collect(), after.schema)


def test_whole_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    again = corpus_pipeline.run(spark, corpus)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect())) and out.count() > 100
    assert simhash.MAX_BITS == 3 and decontam.WINDOW == 16


def test_empty_documents(spark, corpus, tmp_path):
    import shutil

    shutil.copytree(corpus, tmp_path / "sf")
    shutil.rmtree(tmp_path / "sf/documents.parquet")
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(str(tmp_path / "sf/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).collect() == []
