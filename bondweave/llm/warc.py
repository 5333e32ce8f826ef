"""WARC archives as a Spark data source: files are the partitions, headers come first, bodies only when asked for.

A column of the schema is a header of the record: ``warc_target_uri`` is ``WARC-Target-URI``, ``page_id`` is ``Page-ID``.
Five names mean something else: ``payload`` (the body, for HTTP records without the HTTP head), ``http_head``, ``headers``
(all of them, names in lower case), ``archive`` (the file) and ``offset`` (the record's place in it). A scan whose schema
names neither ``payload`` nor ``http_head`` goes from header to header; predicates on headers are looked at before a body
is read. Archives are read and written through Arrow's file systems: local and shared folders, HDFS and object stores.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import BROADCAST_KEYS, hot_keys, join_spread, materialize, shared_dir

DEFAULT_SCHEMA = "warc_type string, warc_record_id string, warc_target_uri string, warc_date string, content_type string, content_length bigint, warc_payload_digest string, warc_refers_to string, headers map<string,string>, http_head string, payload binary, archive string, offset bigint"
BODY = ("payload", "http_head")
NOT_HEADERS = (*BODY, "headers", "archive", "offset")
#: Bytes of one file before the writer begins another, and of the files that one reading task takes.
FILE_BYTES, TASK_BYTES = 1 << 30, 1 << 27
#: Bytes of bodies that a reading task hands on at once.
BATCH_BYTES = 1 << 23
#: Equal payloads of fewer bytes are all kept.
LEAST_SHARED = 100
#: Fixed value: the profile of a record that stands for a payload stored elsewhere.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "_manifest-"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a Spark path; a path without a scheme is local."""
    if re.match(r"file:/+", path):
        path = "/" + re.sub(r"^file:/+", "", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(quote(path, safe=":/@%?=&"))


def header_name(column: str) -> str:
    upper = {"warc": "WARC", "uri": "URI", "id": "ID", "ip": "IP"}
    return "-".join(upper.get(part, part.capitalize()) for part in column.split("_"))


def header_value(value: object) -> str:
    """A value in one line: control characters and outer blanks as percent codes, all else as it is."""
    text = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))
    return re.sub(r"^ +| +$", lambda m: "%20" * len(m[0]), text)


# Reading


def _truth(f: ds.Filter, values: dict[str, object]) -> bool | None:
    """What a predicate says of a record's headers; null meets null as in SQL."""
    if isinstance(f, ds.Not):
        inner = _truth(f.child, values)
        return None if inner is None else not inner
    have = values[f.attribute[0]]
    if isinstance(f, ds.IsNull):
        return have is None
    if isinstance(f, ds.IsNotNull):
        return have is not None
    if isinstance(f, ds.EqualNullSafe):
        return have == f.value
    if have is None or getattr(f, "value", have) is None:
        return None
    if isinstance(f, ds.In):
        return True if have in [v for v in f.value if v is not None] else None if None in f.value else False
    compare = {ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: str.__contains__}
    return compare[type(f)](have, f.value)


_KNOWN = (ds.EqualTo, ds.EqualNullSafe, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.In, ds.IsNull, ds.IsNotNull, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)


def _attribute(f: ds.Filter) -> str | None:
    """The one column that a predicate of a known kind is about."""
    while isinstance(f, ds.Not):
        f = f.child
    return f.attribute[0] if isinstance(f, _KNOWN) and len(f.attribute) == 1 else None


def read_headers(stream: io.BufferedIOBase, archive: str) -> tuple[int, dict[str, str]] | None:
    """Place and headers (names in lower case) of the next record, from where the last one ended; None at the end of the file."""
    line = b"\r\n"
    while line in (b"\r\n", b"\n"):
        at = stream.tell()
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"{archive}: no record begins at {at}")
    headers: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError(f"{archive}: the record at {at} is cut short")
        text = line.decode("utf-8", "replace").strip("\r\n")
        if text[:1] in (" ", "\t") and name:  # a folded line
            headers[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        headers.setdefault(name, value.strip(" \t"))
    if not headers.get("content-length", "").isdigit():
        raise ValueError(f"{archive}: the record at {at} has no length")
    return at, headers


@dataclass
class ArchiveFiles(ds.InputPartition):
    """Files for one task."""

    files: tuple[str, ...]

    def __init__(self, files: tuple[str, ...]):
        super().__init__(files)
        self.files = files


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.filters: list[ds.Filter] = []
        for f in schema:
            if f.name not in NOT_HEADERS and not isinstance(f.dataType, (T.StringType, T.LongType, T.IntegerType)):
                raise ValueError(f"header column {f.name} must be a string, int or bigint")

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            name = _attribute(f)
            if name is not None and name not in (*BODY, "headers", "offset"):
                self.filters.append(f)
            else:
                yield f

    def _files(self) -> list[tuple[str, int, list[str] | None]]:
        """(file, bytes, record types if known): those that the manifests of committed writes name, else all archives below the path."""
        store, path = _located(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [(path, info.size, None)]
        below = store.get_file_info(fs.FileSelector(path, recursive=True))
        manifests = [x.path for x in below if x.base_name.startswith(_MANIFEST)]
        if not manifests:
            return sorted((x.path, x.size, None) for x in below if re.search(r"\.warc(\.gz)?$", x.path))
        named = []
        for m in manifests:
            with store.open_input_stream(m) as f:
                folder = m.rsplit("/", 1)[0]
                named += [(f"{folder}/{x['file']}", x["bytes"], x["types"]) for x in json.loads(f.read())]
        return sorted(named, key=lambda x: x[0])

    def partitions(self) -> list[ArchiveFiles]:
        of_type = [f for f in self.filters if _attribute(f) == "warc_type"]
        dealt: list[list[str]] = []
        size = self.task_bytes
        for name, n_bytes, types in self._files():
            if types is not None and not any(all(_truth(f, {"warc_type": t}) for f in of_type) for t in types):
                continue
            if size + n_bytes > self.task_bytes:
                dealt.append([])
                size = 0
            dealt[-1].append(name)
            size += n_bytes
        return [ArchiveFiles(tuple(x)) for x in dealt] or [ArchiveFiles(())]

    def _rows(self, stream: io.BufferedIOBase, archive: str) -> Iterator[tuple[int, tuple]]:
        """(bytes of the body, row) of each record that the predicates let through."""
        names = [f.name for f in self.schema]
        asked = {f.name: f.dataType for f in self.schema} | {a: T.StringType() for a in map(_attribute, self.filters) if a not in names}
        body_wanted = any(n in BODY for n in names)
        while (found := read_headers(stream, archive)) is not None:
            at, headers = found
            length, begins = int(headers["content-length"]), stream.tell()
            values: dict[str, object] = {"archive": archive, "offset": at, "headers": headers}
            for name, kind in asked.items():
                if name not in NOT_HEADERS:
                    text = headers.get(name.replace("_", "-"))
                    values[name] = text if text is None or isinstance(kind, T.StringType) else int(text)
            if all(_truth(f, values) for f in self.filters):
                if body_wanted:
                    body = stream.read(length)
                    if len(body) < length:
                        raise ValueError(f"{archive}: the record at {at} is cut short")
                    end = body.find(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else -1
                    head = end + 4 if end >= 0 else 0
                    values["http_head"] = body[:head].decode("utf-8", "replace") if head else None
                    values["payload"] = body[head:]
                yield length if body_wanted else 0, tuple(values[n] for n in names)
            stream.seek(begins + length)

    def read(self, partition: ArchiveFiles) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        store, _ = _located(self.path)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for archive in partition.files:
            rows, size = [], 0
            with store.open_input_file(archive) as raw:
                stream = gzip.GzipFile(fileobj=raw) if archive.endswith(".gz") else io.BufferedReader(raw, 1 << 16)
                for n, row in self._rows(stream, archive):
                    rows.append(row)
                    size += n
                    if size >= BATCH_BYTES or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


# Writing


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[dict]


class WarcWriter(ds.DataSourceArrowWriter):
    """Tasks write files under names of their own; what a commit lists in a manifest counts, so files of lost or repeated tasks do not."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.names = [f.name for f in schema]
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.packed = options.get("compression", "none") == "gzip"
        missing = {"warc_type", "warc_record_id", "warc_date"} - set(self.names)
        if missing:
            raise ValueError(f"a WARC record needs {', '.join(sorted(missing))}")

    def _record(self, row: dict) -> bytes:
        head = (row.get("http_head") or "").encode()
        payload = row.get("payload")
        payload = b"" if payload is None else payload
        lines = [f"{header_name(n)}: {header_value(row[n])}\r\n" for n in self.names if n not in NOT_HEADERS and n != "content_length" and row[n] is not None]
        top = f"WARC/1.1\r\n{''.join(lines)}Content-Length: {len(head) + len(payload)}\r\n\r\n".encode()
        record = b"".join([top, head, payload, b"\r\n\r\n"])
        return gzip.compress(record, mtime=0) if self.packed else record

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _located(self.path)
        store.create_dir(folder, recursive=True)
        files: list[dict] = []
        out = None
        try:
            for batch in iterator:
                columns = {n: batch.column(i) for i, n in enumerate(self.names)}
                for i in range(batch.num_rows):
                    row = {n: c[i].as_buffer() if n == "payload" and c[i].is_valid else c[i].as_py() for n, c in columns.items()}
                    record = self._record(row)
                    if out is None or files[-1]["bytes"] >= self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append({"file": f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}", "bytes": 0, "records": 0, "types": []})
                        out = store.open_output_stream(f"{folder}/{files[-1]['file']}", compression=None)
                    out.write(record)
                    files[-1]["bytes"] += len(record)
                    files[-1]["records"] += 1
                    if row["warc_type"] not in files[-1]["types"]:
                        files[-1]["types"].append(row["warc_type"])
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _located(self.path)
        store.create_dir(folder, recursive=True)
        old = [x.path for x in store.get_file_info(fs.FileSelector(folder, recursive=True)) if x.is_file] if self.overwrite else []
        files = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{folder}/{_MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())
        new = {f"{folder}/{f['file']}" for f in files}
        for path in old:
            if path not in new:
                store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _located(self.path)
        for f in [f for m in messages if m for f in m.files]:
            store.delete_file(f"{folder}/{f['file']}")


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return DEFAULT_SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()}, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def read_warc(spark: SparkSession, path: str, schema: str = DEFAULT_SCHEMA, **options: str) -> DataFrame:
    """Records of the archives at ``path``, a file or a folder, ``.warc`` or ``.warc.gz``, in the columns of ``schema``.

    Headers that a record lacks are null. Where the writer left manifests, only the files that they name are read. A file
    is the unit of a task; small ones share a task up to ``taskBytes``. Broken records are an error that names file and
    place. An empty folder gives no rows. Turns on Spark's setting for predicates in Python data sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def write_warc(records: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Write rows as records: ``warc_type``, ``warc_record_id`` and ``warc_date`` are required, null headers are left out,
    a null ``payload`` is an empty one. Options: ``compression`` (none, or gzip with a member for each record), ``fileBytes``."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode(mode).options(**options).save(path)


# Pages


def _record_id(page: Column, url: Column) -> Column:
    """A name that depends on id and URL alone, so that a revisit can name its response without meeting it."""
    h = F.sha2(F.concat_ws("\n", F.coalesce(page.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))), 256)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(h, 1, 32), r"(.{8})(.{4}).(.{3}).(.{3})(.{12})", "$1-$2-8$3-8$4-$5"), F.lit(">"))


def records_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least_shared: int = LEAST_SHARED, id_col: str = "page_id") -> DataFrame:
    """One record for each row of ``pages`` (id, url, html): a response with its payload, or a revisit that names one.

    Of rows with equal payloads of ``least_shared`` bytes or more, those of the smallest id are responses and the others
    revisit them; rows that repeat the smallest id are all responses, and null ids come last, so they are responses only
    where all ids of a payload are null. Null html is an empty payload, a null URL a record without a target. Other
    columns are left out.

    Only digests are grouped, summed up before they are shuffled. The few that occur twice are broadcast up to
    ``BROADCAST_KEYS``; beyond that the pages are joined with them, without bringing the rows of a hot digest together.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("_digest", F.sha2("payload", 256))
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("url"))
    shared = p.where(F.col("payload_bytes") >= least_shared).groupBy("_digest").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("page_id", "url"), order).alias("first")).where("n > 1")
    shared = materialize(shared, "shared-payloads")
    groups, rows = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    firsts = shared.select("_digest", "first")
    if groups <= BROADCAST_KEYS:
        joined = p.join(F.broadcast(firsts), "_digest", "left")
    else:
        joined = join_spread(p, firsts, "_digest", hot_keys(shared, "_digest", "n", rows), "left")
    again = F.col("first").isNotNull() & (F.col("payload_bytes") >= least_shared) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    when = lambda value: F.when(again, value)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        _record_id(F.col("page_id"), F.col("url")).alias("warc_record_id"),
        F.lit(date).alias("warc_date"),
        F.col("url").alias("warc_target_uri"),
        when(_record_id(F.col("first.page_id"), F.col("first.url"))).alias("warc_refers_to"),
        when(F.col("first.url")).alias("warc_refers_to_target_uri"),
        when(F.lit(SAME_PAYLOAD)).alias("warc_profile"),
        F.concat(F.lit("sha256:"), F.col("_digest")).alias("warc_payload_digest"),
        F.lit("application/http;msgtype=response").alias("content_type"),
        F.col("page_id"),
        when(F.col("first.page_id")).alias("refers_to_page_id"),
        "payload_bytes",
        head.alias("http_head"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive_digest(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archived pages: responses from the payloads that are read,
    revisits from their headers, in a scan that reads no body."""
    headers = f"warc_type string, page_id {id_type}, refers_to_page_id {id_type}, payload_bytes bigint, warc_payload_digest string"
    full = read_warc(spark, path, f"{headers}, payload binary").where("warc_type = 'response'")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("refers_to_page_id").alias("refers_to"))
    lean = read_warc(spark, path, headers).where("warc_type = 'revisit'")
    return full.unionByName(lean.select("page_id", "payload_bytes", F.substring("warc_payload_digest", 8, 64).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("refers_to_page_id").alias("refers_to")))


def archived(pages: DataFrame) -> str:
    """Write the records of ``pages`` to a new folder of the shared storage and return its path."""
    path = f"{shared_dir(pages.sparkSession)}/pages-{uuid.uuid4().hex}"
    write_warc(records_of_pages(pages), path)
    return path
