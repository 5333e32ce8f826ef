import gzip
import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from bondweave.llm import warc

SCHEMA = "page_id long, url string, html string"
LONG = "<p>x</p>" * 20


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / f"a b {uuid.uuid4().hex[:6]}")


def plain(pages):
    """Which page is a response and which one revisits it, by a dictionary."""
    rows = [(i, (h or "").encode()) for i, _, h in pages]
    least = {}
    for i, b in rows:
        if len(b) >= 100:
            least.setdefault(b, []).append(i)
    out = []
    for i, b in rows:
        ids = [x for x in least.get(b, []) if x is not None]
        first = min(ids) if ids else None
        again = first is not None and i != first
        out.append(str((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None)))
    return sorted(out)


PAGES = [(5, "http://a/", LONG), (3, "http://b/\r\nX: y", LONG), (9, None, LONG), (9, None, LONG), (3, "http://b/", LONG), (1, "http://c/", None), (2, " é\u4e2d ", ""), (4, "u", "short"), (6, "u", "short"), (None, "n", LONG), (None, "n", "n" * 200), (None, "m", "n" * 200)]
PAGES += [(10, "http://l/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40_000), (11, "x", "\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 9), (12, "x", "é" * 50), (13, "x", "é" * 50), (14, "x", "e" * 99), (15, "x", "e" * 99)]


def read_back(spark, pages, **options):
    df = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "1 AS payload", "'x' AS first", "2 AS n", "'y' AS _digest", "3 AS warc_type")
    path = f"{warc.shared_dir(spark)}/t-{uuid.uuid4().hex}"
    warc.write_warc(warc.records_of_pages(df), path, **options)
    return path, sorted(str(tuple(r)) for r in warc.archive_digest(spark, path).collect())


@pytest.mark.parametrize("options", [{}, {"compression": "gzip"}, {"fileBytes": "300"}])
def test_pages_come_back(spark, options):
    assert read_back(spark, PAGES, **options)[1] == plain(PAGES)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_KEYS", 0)
    assert read_back(spark, PAGES)[1] == plain(PAGES)


def test_empty_table(spark):
    path, rows = read_back(spark, [])
    assert rows == [] and warc.read_warc(spark, path).count() == 0


def test_all_headers_and_bodies(spark):
    path, _ = read_back(spark, PAGES)
    rows = {r["page_id"]: r for r in warc.read_warc(spark, path, warc.DEFAULT_SCHEMA + ", page_id bigint").where("page_id IN (2, 3, 10, 9)").collect()}
    assert bytes(rows[10]["payload"]).decode() == PAGES[12][2] and rows[10]["http_head"].startswith("HTTP/1.1 200 OK")
    assert rows[9]["warc_type"] == "revisit" and rows[9]["payload"] == b"" and rows[9]["warc_target_uri"] is None
    assert rows[9]["warc_refers_to"] in {r["warc_record_id"] for r in warc.read_warc(spark, path, "warc_record_id string, page_id bigint").where("page_id = 3").collect()}
    assert rows[2]["warc_target_uri"] == "%20é\u4e2d%20" and rows[2]["headers"]["warc-type"] == "response"


def test_predicates_go_to_the_source_and_bodies_stay(spark):
    path, _ = read_back(spark, PAGES)
    df = warc.read_warc(spark, path, "warc_type string, page_id bigint, warc_target_uri string").where("warc_type = 'revisit' AND page_id > 4 AND warc_target_uri IS NULL")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert sorted(r["page_id"] for r in df.collect()) == [9, 9]
    every = warc.read_warc(spark, path, "warc_type string, page_id bigint, warc_target_uri string").collect()
    for predicate, plainly in (
        ("page_id <=> NULL", lambda r: r["page_id"] is None),
        ("NOT (page_id = 3)", lambda r: r["page_id"] not in (3, None)),
        ("page_id IN (1, 2, NULL)", lambda r: r["page_id"] in (1, 2)),
        ("NOT page_id IN (1, 2)", lambda r: r["page_id"] not in (1, 2, None)),
        ("warc_target_uri LIKE 'http://%' AND page_id <= 5", lambda r: (r["warc_target_uri"] or "").startswith("http://") and r["page_id"] <= 5),
        ("warc_target_uri LIKE '%a%' OR page_id = 1", lambda r: "a" in (r["warc_target_uri"] or "") or r["page_id"] == 1),
    ):
        got = warc.read_warc(spark, path, "warc_type string, page_id bigint, warc_target_uri string").where(predicate)
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in every if plainly(r)), predicate


def test_headers_alone_seek_past_bodies(tmp_path):
    big = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5000000\r\n\r\n" + b"x" * 5_000_000 + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(big * 2)
    reader = warc.WarcReader({"path": str(tmp_path)}, __import__("pyspark").sql.types.StructType().add("warc_type", "string"))
    read = []

    class Counted(__import__("io").BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    assert [r for _, r in reader._rows(Counted(big * 2), "a")] == [("resource",), ("resource",)] and not read


def test_archives_of_others(spark, folder):
    os.makedirs(folder + "/deep")
    one = "WARC/1.0\r\nwarc-type: warcinfo\r\nX-Note: a\r\n  folded\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    two = "WARC/1.1\nWARC-Type: response\nContent-Type: application/http\nContent-Length: 9\n\nno head\r\n\r\n\r\n".encode()
    open(folder + "/x.warc", "wb").write(one + two)
    open(folder + "/deep/y.warc.gz", "wb").write(gzip.compress(two) + gzip.compress(one))
    open(folder + "/z.txt", "wb").write(b"no archive")
    rows = warc.read_warc(spark, folder, "warc_type string, x_note string, payload binary, offset bigint, archive string").orderBy("archive", "offset").collect()
    assert [(r["warc_type"], r["x_note"], bytes(r["payload"])) for r in rows] == [("response", None, b"no head\r\n"), ("warcinfo", "a folded", b"abc"), ("warcinfo", "a folded", b"abc"), ("response", None, b"no head\r\n")]
    assert warc.read_warc(spark, folder + "/x.warc", "warc_type string").count() == 2


@pytest.mark.parametrize("broken", [b"GET / HTTP/1.1\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])
def test_broken_records_are_errors(spark, folder, broken):
    os.makedirs(folder)
    open(folder + "/b.warc", "wb").write(broken)
    with pytest.raises(Exception, match="b.warc"):
        warc.read_warc(spark, folder, "warc_type string, payload binary").collect()


def test_only_committed_files_count(spark):
    path, rows = read_back(spark, PAGES)
    local = path.replace("file://", "")
    open(f"{local}/part-99999-lost.warc", "wb").write(b"half a rec")
    assert sorted(str(tuple(r)) for r in warc.archive_digest(spark, path).collect()) == rows
    df = spark.createDataFrame([(77, "u", "more")], SCHEMA)
    warc.write_warc(warc.records_of_pages(df), path)
    assert warc.archive_digest(spark, path).count() == len(rows) + 1
    warc.write_warc(warc.records_of_pages(df), path, mode="overwrite")
    assert [r["page_id"] for r in warc.archive_digest(spark, path).collect()] == [77]


def test_files_share_tasks_up_to_a_size_and_types_prune_them(spark):
    path, _ = read_back(spark, PAGES, fileBytes="1")
    n = len(PAGES)
    scan = lambda **o: warc.read_warc(spark, path, "warc_type string, page_id bigint", **o)
    assert scan(taskBytes="1").rdd.getNumPartitions() == n and scan().rdd.getNumPartitions() == 1
    assert scan(taskBytes="1").where("warc_type = 'revisit'").rdd.getNumPartitions() == sum("revisit" in r for r in plain(PAGES))


def test_missing_columns_are_named(spark):
    with pytest.raises(Exception, match="warc_record_id"):
        warc.write_warc(spark.range(1).select(F.lit("x").alias("warc_type")), f"{warc.shared_dir(spark)}/no")
