import json
import os

from bondweave.streaming import memo


def run(spark, tmp_path, batches, **how):
    """Each batch of (key, second) is a file; all are read in turn, one a micro-batch."""
    source = tmp_path / "in"
    source.mkdir()
    n = 0
    for i, requests in enumerate(batches):
        lines = []
        for key, second in requests:
            lines.append(json.dumps({"mol": key, "ts": f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z", "n": n}))
            n += 1
        (source / f"{i:03d}.json").write_text("\n".join(lines))
        os.utime(source / f"{i:03d}.json", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("mol string, ts timestamp, n long").option("maxFilesPerTrigger", 1).json(str(source))
    out = memo.remembered(stream, "mol", "ts", "n", lambda k: float(len(k or "")), **how)
    name = f"memo_{tmp_path.name.replace('-', '_')}"
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    return sorted((r.place, r.key, r.answer, r.hit) for r in spark.table(name).collect())


def plain(batches, entries, seconds):
    known, out, n = {}, [], 0
    for requests in batches:
        for k, second in requests:
            hit = k in known and second - known[k] <= seconds
            if not hit:
                known.pop(k, None)
                if len(known) >= entries:
                    known.pop(min(known, key=known.get))
                known[k] = second
            out.append((n, k, float(len(k or "")), hit))
            n += 1
    return out


def test_repeats_get_the_stored_answer_and_the_oldest_goes(spark, tmp_path):
    batches = [[(f"m{i}", i // 10) for i in range(2048)] + [("m5", 300)], [("m7", 301), ("new", 302), ("m0", 303), ("m7", 304)], [("m1", 305), ("new", 306)]]
    got = run(spark, tmp_path, batches)
    assert got == plain(batches, 2048, 600)
    # The 2,049th key pushed out m0, whose return pushed out m1.
    assert {k: h for _, k, _, h in got if k in ("m0", "m1")} == {"m0": False, "m1": False}
    assert [h for _, k, _, h in got if k == "new"] == [False, True]


def test_entries_expire_by_the_requests_own_times(spark, tmp_path):
    batches = [[("a", 0), ("a", 600), (None, 600)], [("a", 601), (None, 700), ("a", 1201)], [("a", 1202)]]
    got = run(spark, tmp_path, batches)
    assert [h for *_, h in got] == [False, True, False, False, True, True, False]


def test_shards_share_the_entries(spark, tmp_path):
    batches = [[(k, 0) for k in "abcd"], [(k, 1) for k in "abcd"]]
    assert [h for *_, h in run(spark, tmp_path, batches, entries=64, shards=4)] == [False] * 4 + [True] * 4
