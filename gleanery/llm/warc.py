"""WARC archives as a Spark data source: files are planned into partitions, filters on the record's headers are pushed
down, headers are parsed first, and the content of records that nobody wants is skipped.

Written archives are gzipped record by record. Each member's extra field `sl` gives its compressed and plain length, so that
a reader which has seen the headers can seek to the next record without inflating this one; members without that field, as
other writers make them, are inflated to their end, and plain archives are skipped by Content-Length. A payload is read
only if the schema asks for it and the headers pass.

`archive` writes a table of pages: of equal payloads one is kept as a response, the others become revisits of it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import shared_dir, written

RECORD = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_type string, content_length long, "
    "headers map<string,string>, http_status int, http_headers map<string,string>, payload binary, file string, offset long"
)
#: Columns that a record's own headers give: filters on these, and on file and offset, are pushed down.
OWN = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type", "content_length": "content-length"}
HTTP = ("http_status", "http_headers", "payload")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that one read takes, that a batch of rows holds, and of files that one partition takes together.
STEP, BATCH, BUNDLE = 1 << 16, 8 << 20, 64 << 20
URN = "urn:page:"


def opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path)


def lines_of(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line of a block of headers, and the headers under their names as written. Folded lines are joined."""
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    name = None
    for line in rest:
        if name and line[:1] in (" ", "\t"):
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            out[name] = value.strip()
    return first, out


class Plain:
    """A record of a plain archive."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.buffer = file, b""
        file.seek(at)
        self.at = at

    def more(self) -> bytes:
        return self.file.read(STEP)

    def until_blank(self) -> bytes:
        """What stands before the next blank line; the whole rest if there is none."""
        seen = 0
        while (end := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buffer)
            if not (some := self.more()):
                end = seen
                break
            self.buffer += some
        head, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
        self.at += end + 4
        return head

    def take(self, n: int) -> bytes:
        parts, held = [self.buffer], len(self.buffer)
        while held < n and (some := self.more()):
            parts.append(some)
            held += len(some)
        whole = b"".join(parts)
        if len(whole) < n:
            raise ValueError("an archive ends within a record")
        self.buffer = whole[n:]
        self.at += n
        return whole[:n]

    def after(self, left: int) -> int:
        """Where the next record begins, `left` bytes of this one's content being unread."""
        return self.at + left + 4


class Zipped(Plain):
    """A record of an archive that is gzipped record by record."""

    def __init__(self, file: pa.NativeFile, at: int):
        super().__init__(file, at)
        self.start, self.raw, self.inflate = at, file.read(STEP), zlib.decompressobj(31)
        self.read, self.length = at + len(self.raw), member_length(self.raw)

    def more(self) -> bytes:
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.file.read(STEP)
                self.read += len(self.raw)
                if not self.raw:
                    raise ValueError("an archive ends within a record")
            out, self.raw = self.inflate.decompress(self.raw, STEP), self.inflate.unconsumed_tail
            if out:
                return out
        return b""

    def after(self, left: int) -> int:
        if self.length:
            return self.start + self.length
        while self.more():
            pass
        return self.read - len(self.inflate.unused_data)


def member_length(raw: bytes) -> int:
    """The compressed length of a gzip member by its extra field `sl`; 0 without one."""
    if len(raw) >= 12 and raw[3] & 4:
        at, end = 12, 12 + struct.unpack_from("<H", raw, 10)[0]
        while at + 4 <= min(end, len(raw)):
            name, n = raw[at : at + 2], struct.unpack_from("<H", raw, at + 2)[0]
            if name == b"sl" and n == 8 and at + 12 <= len(raw):
                return struct.unpack_from("<I", raw, at + 4)[0]
            at += 4 + n
    return 0


def member(record: bytes) -> bytes:
    """A record as a gzip member that tells its length, where 32 bits can."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = deflate.compress(record) + deflate.flush()
    total = 10 + 2 + 12 + len(data) + 8
    known = (total, len(record)) if max(total, len(record)) < 1 << 32 else (0, 0)
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBBH", 0, 0, 255, 12) + b"sl" + struct.pack("<HII", 8, *known)
    return head + data + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def own_columns(headers: dict[str, str]) -> dict:
    low = {k.lower(): v for k, v in headers.items()}
    out = {c: low.get(h) for c, h in OWN.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c].strip("<>") if out[c] else out[c]
    out["content_length"] = int(out["content_length"]) if out["content_length"] else 0
    return out


def holds(f: ds.Filter, row: dict) -> bool | None:
    """Whether a filter holds for a record; None where SQL would say null."""
    if isinstance(f, ds.Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    value = row[f.attribute[0]]
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return (value is None) == isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None:
        return None
    return TESTS[type(f)](value, f.value)


TESTS = {
    ds.EqualTo: lambda a, b: a == b, ds.In: lambda a, b: a in b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: lambda a, b: b in a,
}


def pushable(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return pushable(f.child)
    sound = isinstance(f, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe, *TESTS)) and len(f.attribute) == 1 and f.attribute[0] in (*OWN, "file", "offset")
    return sound and not (isinstance(f, ds.In) and None in f.value)


@dataclass
class Bundle(ds.InputPartition):
    """Whole files that one task reads."""

    paths: list[tuple[str, int]]


class WarcReader(ds.DataSourceReader):
    """Options: path (a file, or a folder with its subfolders; names that begin with _ or . are left out), bundle_bytes."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.most, self.filters = int(options.get("bundle_bytes", BUNDLE)), []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Bundle]:
        source, path = opened(self.path)
        info = source.get_file_info(path)
        if info.type == files.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == files.FileType.File else source.get_file_info(files.FileSelector(path, recursive=True))
        inside = [(x.path, x.size) for x in found if x.type == files.FileType.File and not any(p[:1] in "_." for p in x.path.removeprefix(path).strip("/").split("/") if p)]
        out: list[Bundle] = []
        held = self.most
        own = [f for f in self.filters if (f.child if isinstance(f, ds.Not) else f).attribute == ("file",)]
        for path, size in sorted(inside):
            if not all(holds(f, {"file": path}) for f in own):
                continue
            if held + size > self.most:
                out.append(Bundle([]))
                held = 0
            out[-1].paths.append((path, size))
            held += size
        return out or [Bundle([])]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        rows, held = [], 0
        for path, size in partition.paths:
            for row in self.records(path, size):
                rows.append(row)
                held += 500 + len(row.get("payload") or b"")
                if held >= BATCH:
                    yield batch_of(rows, kinds)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows, kinds)

    def records(self, path: str, size: int) -> Iterator[dict]:
        names = set(self.schema.names)
        inner = names & set(HTTP)
        with opened(self.path)[0].open_input_file(path) as file:
            at = 0
            zipped = size >= 2 and file.read(2) == b"\x1f\x8b"
            while at < size:
                record = Zipped(file, at) if zipped else Plain(file, at)
                version, headers = lines_of(record.until_blank())
                if not version.startswith("WARC/"):
                    raise ValueError(f"{path} at {at}: not a WARC record")
                row = own_columns(headers) | {"file": path, "offset": at}
                left = row["content_length"]
                if all(holds(f, row) for f in self.filters):
                    row["headers"] = headers
                    if inner:
                        row |= http_of(record, row, left, "payload" in names)
                        left = row.pop("left")
                    yield row
                at = record.after(left)


def http_of(record: Plain, row: dict, length: int, payload: bool) -> dict:
    """The columns of HTTP, and how many bytes of the record are still unread. A revisit has no payload of its own; a
    record that isn't HTTP is all payload."""
    if not (row["content_type"] or "").startswith("application/http"):
        return {"payload": record.take(length), "left": 0} if payload and row["record_type"] != "revisit" else {"left": length}
    before = record.at
    line, headers = lines_of(record.until_blank())
    left = max(0, length - (record.at - before))
    status = line.split(" ")[1:2]
    out = {"http_status": int(status[0]) if status and status[0].isdigit() else None, "http_headers": headers, "left": left}
    if payload and row["record_type"] != "revisit":
        out |= {"payload": record.take(left), "left": 0}
    return out


def batch_of(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    def cell(value, kind: pa.DataType):
        return list(value.items()) if pa.types.is_map(kind) and value is not None else value

    return pa.RecordBatch.from_arrays([pa.array([cell(r.get(f.name), f.type) for r in rows], f.type) for f in kinds], schema=kinds)


@dataclass
class Written(ds.WriterCommitMessage):
    paths: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    """Writes rows with any of record_id, record_type, target_uri, date, refers_to, payload_digest, content_type,
    payload_bytes and payload as records. Options: path, roll_bytes (an archive is closed at that size), software.

    Each attempt of a task writes below _temporary; only the files of attempts that Spark commits are moved to the folder."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], schema.names, overwrite
        self.roll, self.software, self.run = int(options.get("roll_bytes", 256 << 20)), options.get("software", "gleanery"), uuid.uuid4().hex
        self.date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        target, path = opened(self.path)
        folder, paths, out = f"{path}/_temporary/{self.run}", [], None
        target.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= self.roll:
                        if out is not None:
                            out.close()
                        paths.append(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                        out = target.open_output_stream(paths[-1], compression=None)
                        out.write(member(record_bytes({"record_type": "warcinfo", "record_id": f"urn:uuid:{uuid.uuid4()}", "content_type": "application/warc-fields", "payload": f"software: {self.software}\r\nformat: WARC File Format 1.1\r\n".encode()}, self.date)))
                    out.write(member(record_bytes(row, self.date)))
        finally:
            if out is not None:
                out.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        target, path = opened(self.path)
        target.create_dir(path, recursive=True)
        if self.overwrite:
            for old in target.get_file_info(files.FileSelector(path)):
                if old.type == files.FileType.File and ".warc" in old.base_name:
                    target.delete_file(old.path)
        for m in messages:
            for p in m.paths if m else []:
                target.move(p, f"{path}/{p.rsplit('/', 1)[1]}")
        self.cleaned()

    def abort(self, messages: list[Written | None]) -> None:
        self.cleaned()

    def cleaned(self) -> None:
        target, path = opened(self.path)
        for folder in (f"{path}/_temporary/{self.run}", f"{path}/_temporary"):
            if target.get_file_info(folder).type == files.FileType.Directory and (folder.endswith(self.run) or not target.get_file_info(files.FileSelector(folder))):
                target.delete_dir(folder)


def record_bytes(row: dict, date: str) -> bytes:
    kind, payload = row.get("record_type") or "resource", row.get("payload") or b""
    content, mime = payload, row.get("content_type") or "application/octet-stream"
    if kind in ("response", "revisit"):
        n = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
        content = f"HTTP/1.1 200 OK\r\nContent-Type: {one_line(mime)}\r\nContent-Length: {n}\r\n\r\n".encode() + (b"" if kind == "revisit" else payload)
        mime = "application/http; msgtype=response"
    head = {
        "WARC-Type": kind, "WARC-Record-ID": row.get("record_id") and f"<{row['record_id']}>", "WARC-Date": row.get("date") or date, "WARC-Target-URI": row.get("target_uri"),
        "WARC-Payload-Digest": row.get("payload_digest"), "WARC-Refers-To": row.get("refers_to") and f"<{row['refers_to']}>", "WARC-Profile": IDENTICAL if kind == "revisit" else None, "Content-Type": mime, "Content-Length": str(len(content)),
    }
    lines = "".join(f"{k}: {one_line(v)}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + content + b"\r\n\r\n"


def one_line(value: str) -> str:
    """A header's value: line ends in it would begin another header."""
    return " ".join(value.splitlines())


class WarcSource(ds.DataSource):
    """format("warc"); see WarcReader and WarcWriter. The schema asked for decides what is read of a record."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: str = RECORD) -> DataFrame:
    """The records under `path`, with those columns of RECORD that `columns` (a schema) names. Without http columns and the
    payload, nothing but the records' headers is read.

    Each query on the result pushes at least one filter, one that always holds: without any, Spark 4.1 would plan it with
    the filters that the query before it on the same DataFrame had pushed."""
    register(spark)
    names = StructType.fromDDL(columns).names
    wanted = columns if "file" in names else f"{columns}, file string"
    return spark.read.format("warc").schema(wanted).load(path).filter("file is not null").select(*names)


def base32(hexed: Column) -> Column:
    """The base32 of 20 bytes given in hexadecimal: eight digits of 40 bits each time."""
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(payload: Column) -> Column:
    return base32(F.sha1(payload))


def new_folder(spark: SparkSession) -> str:
    """A folder for archives, where all executors can read and write."""
    return f"{shared_dir(spark)}/gleanery-warc-{uuid.uuid4().hex}"


def archive(pages: DataFrame, path: str, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row of `pages` to archives under `path`, its payload the html in UTF-8 (null: empty).

    Of records with equal payloads of at least `least_bytes` bytes, that with the smallest id is a response, the others are
    revisits of it, without a payload; smaller ones are all responses. Payloads are equal if their SHA-1 and length are.
    Rows that share the smallest id of a group are all responses; a null id comes last, and with null ids alone all are
    responses. An empty table writes no archive; further columns are not carried. The number of copies of one payload
    doesn't matter: groups are minima by partial aggregation, and revisits are looked up in the table of those.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), digest(F.col("payload")).alias("sha"))
    groups = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha", "payload_bytes").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = written(groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), "firsts")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    records = rows.join(firsts, ["sha", "payload_bytes"], "left").select(
        F.concat(F.lit(URN), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(again, F.concat(F.lit(URN), F.col("first").cast("string"))).alias("refers_to"), F.concat(F.lit("sha1:"), F.col("sha")).alias("payload_digest"), F.lit("text/html; charset=utf-8").alias("content_type"),
        "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").option("path", path).save()


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of the archived pages. Responses are read with
    their payload, whose own length and digest are given; intact says whether that is the recorded digest. Of revisits only
    headers are read: digest and length are those of the payload they repeat, as recorded."""
    common = "record_id string, record_type string, refers_to string, payload_digest string"
    own = read(spark, path, f"{common}, payload binary").filter("record_type = 'response'")
    again = read(spark, path, f"{common}, http_headers map<string,string>").filter("record_type = 'revisit'")

    def page(c: str) -> Column:
        return F.substring(c, len(URN) + 1, 40).try_cast("long")

    recorded = F.regexp_replace("payload_digest", "^sha1:", "")
    own = own.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), (digest(F.col("payload")) == recorded).alias("intact"))
    again = again.select(page("record_id").alias("page_id"), F.col("http_headers")["Content-Length"].cast("long").alias("payload_bytes"), recorded.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), F.lit(None).cast("boolean").alias("intact"))
    return own.unionByName(again)
